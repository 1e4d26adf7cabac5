"""Exact duplicates by content sort, with DataFrame functions only.

Normalised texts are range-partitioned by sampled splitters and sorted by Spark's external sort, so equal
texts become neighbours; the window over whole texts compares each with the next in full. A splitter is the
first HEAD characters with a hash of the whole text, so what the driver samples doesn't grow with the texts, and
texts that begin alike don't fill one range. A text that the
sample shows to be frequent is dealt out in shares, by a hash of the id, in as many ranges as its frequency asks
for; its shares are put together by digest afterwards, from one row a share.

An empty table gives no rows, and columns but the id and the text have no part. Null text counts as empty, so all null and empty texts are one group. Of equal texts the row with the most code
points before normalisation stays, then that with the smallest id; a null id comes after all others. Rows
repeated with the same id are counted each and kept or dropped alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Characters that don't count in a comparison.
WHITE = " \t\n\x0b\x0c\r"
HEAD = 64
#: Rows of the sample that shows which texts are frequent; half as many texts at most can be seen twice.
SAMPLED = 20_000


def normalised(text):
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def frequent_texts(docs: DataFrame, text: str, ranges: int) -> list:
    """(mark, shares) of texts of which a sample holds a few: the hash, and about one share for each range that the text would fill.
    At most 2 * ranges texts can be so frequent."""
    n = docs.count()
    drawn = min(1.0, SAMPLED / max(n, 1))
    return (
        docs.select(normalised(F.col(text)).alias("norm"), F.rand(7).alias("draw")).where(F.col("draw") < drawn).groupBy(F.xxhash64("norm").alias("mark")).count()
        .where(F.col("count") >= max(3.0, n * drawn / ranges / 2))
        .select("mark", F.ceil(F.col("count") * (2 * ranges) / (n * drawn)).cast("int").alias("shares"))
        .collect()
    ) if n else []


def share_of(hot: list):
    """The share of a row by its columns id and norm; rows of one id and text are in one share."""
    if not hot:
        return F.lit(0)
    return F.coalesce(F.pmod(F.xxhash64("id"), F.create_map(*[F.lit(v) for r in hot for v in (r.mark, r.shares)])[F.xxhash64("norm")]), F.lit(0))


def distinct_rows(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one of each group of equal texts, of repeated rows one as well. Rows move once,
    with their original text, from which the other is made anew where they meet."""
    ranges = partitions(docs)
    hot = frequent_texts(docs, text, ranges)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, F.col(id).cast("long").alias("id"), normalised(F.col(text)).alias("norm"))
    placed = own.select("row", "id", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("mark"), share_of(hot).cast("int").alias("share"))
    by = ["head", "mark", *(["share"] if hot else [])]
    whole = F.col("row").getField(text)
    dealt = placed.repartitionByRange(ranges, *by).withColumns({"norm": normalised(whole), "size": F.length(F.coalesce(whole.cast("string"), F.lit("")))})
    better = Window.partitionBy(*by, "norm").orderBy(F.col("size").desc(), F.col("id").asc_nulls_last(), whole)
    first = dealt.withColumn("place", F.row_number().over(better)).where("place = 1")
    if not hot:
        return first.select("row.*")
    rank = lambda size: F.struct((-size).alias("size"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    texts = own.where(F.xxhash64("norm").isin([r.mark for r in hot]))
    best = cut(texts.groupBy(F.xxhash64("norm").alias("mark"), sha.alias("sha")).agg(F.min(rank(F.length(F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))))).alias("best")))  # at most 2 * ranges texts, but for equal hashes
    found = first.withColumn("sha", F.when(F.col("mark").isin([r.mark for r in hot]), sha)).join(F.broadcast(best), ["mark", "sha"], "left")
    return found.where(F.col("best").isNull() | F.col("best").eqNullSafe(rank(F.col("size")))).select("row.*")


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for every input row."""
    ranges = partitions(docs)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("size"), normalised(F.col(text)).alias("norm"))
    hot = frequent_texts(docs, text, ranges)
    mark, share = F.xxhash64("norm"), share_of(hot)
    shared = ["share"] if hot else []  # a constant would cost the window an exchange of its own
    dealt = rows.withColumns({"head": F.substring("norm", 1, HEAD), "mark": mark, "share": share.cast("int")}).repartitionByRange(ranges, "head", "mark", *shared)
    equal = Window.partitionBy("head", "mark", *shared, "norm")
    better = equal.orderBy(F.col("size").desc(), F.col("id").asc_nulls_last())
    found = dealt.select(
        "id", "size", "share", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
        F.first(F.struct("size", "id")).over(better).alias("best"), F.row_number().over(better).alias("place"), F.count(F.lit(1)).over(equal).alias("n"),
    )
    if not hot:
        return found.select(F.col("id").alias(id), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("best.id")).alias("kept"), F.col("sha").alias("text_sha256"))
    found = cut(found.select("id", "sha", "best", "place", "n", "share"))
    marks = found.where("share > 0").select("sha").distinct()  # at most 2 * ranges texts
    whole = (
        found.where("place = 1").join(F.broadcast(marks), "sha", "left_semi").groupBy("sha")
        .agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("best.size")).alias("size"), F.col("best.id").isNull().alias("none"), F.col("best.id").alias("id"))).alias("first"))
    )
    keep = F.when(F.col("all").isNull(), F.col("best.id")).otherwise(F.col("first.id"))
    return found.join(F.broadcast(whole), "sha", "left").select(F.col("id").alias(id), keep.alias("keep_id"), F.coalesce("all", "n").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
