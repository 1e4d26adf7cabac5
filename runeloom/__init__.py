"""Character-set analytics over tables of documents, expressed as Spark plans."""
