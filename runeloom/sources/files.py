"""Documents from files and from tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Lexical normal form: no `.` parts, `..` folded where a part precedes it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(p))))
    joined = F.array_join(F.when(F.size(parts) > 0, fold).otherwise(F.array().cast("array<string>")), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path relative to root, content) of every file below root; raises if there is none. Names that begin with a dot or an underscore are Spark's to
    leave out; links are read as what they lead to."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(root).select("path", "content")
    if files.select("path").isEmpty():
        raise ValueError(f"no file below {root}")
    clean = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/") + "/"
    return files.select(F.when(clean.contains(base), F.substring_index(clean, base, -1)).otherwise(clean).alias("path"), "content")


def tracked(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Of the files those that a list of paths (a table of tracked files, as version control gives it) names; the default where none is named.
    Raises if that is none at all."""
    kept = files.join(listed.select(normal_path(F.col("path")).alias("_listed")).distinct(), normal_path(F.col("path")) == F.col("_listed"), "left_semi")
    if kept.select("path").isEmpty():
        raise ValueError("none of the listed files is there")
    return kept


def named(files: DataFrame, paths: list[str]) -> DataFrame:
    """(..., ord): the files that are named or lie below a named folder, each once; ord is the number of the first name that takes it, by which, and then by
    path, a report is in the order of the names."""
    first = F.lit(None).cast("int")
    for k in reversed(range(len(paths))):
        p = paths[k].rstrip("/")
        first = F.when(F.lit(p in ("", ".")) | (F.col("path") == p) | F.startswith(F.col("path"), F.lit(p + "/")), F.lit(k)).otherwise(first)
    return files.withColumn("ord", first).where("ord is not null").dropDuplicates(["path"])


def documents(table: DataFrame, path: Column, text: str = "text") -> DataFrame:
    """(path, text) of a table's rows."""
    return table.select(path.alias("path"), F.col(text).alias("text"))


def text_of(files: DataFrame) -> DataFrame:
    """(path, text) of files whose content is text; binary and broken ones are left out (see operators.check.skipped)."""
    good = ~F.contains(F.col("content"), F.lit(b"\0")) & F.is_valid_utf8(F.col("content").cast("string"))
    return files.where(good).select("path", F.col("content").cast("string").alias("text"))


def lossy(files: DataFrame) -> DataFrame:
    """(path, text) of every file, what can't be decoded replaced."""
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def capped(files: DataFrame, size: int = 16 << 20) -> DataFrame:
    """Contents cut at `size` bytes, back to a whole character and before an unfinished emoji sequence of up to 64 bytes."""
    @F.pandas_udf("binary")
    def cut(body: pd.Series) -> pd.Series:
        def one(x):
            if x is None or len(x) <= size:
                return x
            end = size
            while end > max(0, size - 3) and x[end] & 0xC0 == 0x80:  # a character has at most three such bytes; others aren't text
                end -= 1
            tail = x[max(0, end - 64) : end].decode(errors="ignore")
            k = len(tail)
            while k and (tail[k - 1] in "\u200d\ufe0f\u20e3" or (k > 1 and tail[k - 2] == "\u200d") or 0x1F1E6 <= ord(tail[k - 1]) <= 0x1F1FF or 0x1F3FB <= ord(tail[k - 1]) <= 0x1F3FF or 0xE0020 <= ord(tail[k - 1]) <= 0xE007E):
                k -= 1
            return x[: end - len(tail[k:].encode())]

        return body.map(one)

    return files.withColumn("content", F.when(F.octet_length("content") > size, cut(F.substring(F.col("content"), 1, size + 4))).otherwise(F.col("content")))
