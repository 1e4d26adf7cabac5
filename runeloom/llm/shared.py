"""The folder that driver and executors share, joins on keys of which a few are frequent, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session names none, a temporary one if all runs on this machine, as in tests, else ValueError."""
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None):
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, as a table in the shared folder."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frequent(counted: DataFrame, n: str = "n") -> tuple[DataFrame, int]:
    """Those keys of `counted`, a row for each, that would overfill a task, at most two for each partition, so that they may be
    broadcast; and the number of rows beyond which one does."""
    partitions = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = (counted.agg(F.sum(n)).first()[0] or 0) // (2 * partitions) + 1
    return counted.where(F.col(n) > limit), limit


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The rows with what `counted` says of their key; it has a row for each key, with the number n of rows that have it, and is
    read more than once. Rows of frequent keys stay where they are; the others move by key."""
    hot, _ = frequent(counted, n)
    if hot.isEmpty():
        return rows.join(counted, key)
    hot = cut(hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(counted.join(F.broadcast(hot.select(key)), key, "left_anti"), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def join_shared(rows: DataFrame, table: DataFrame, key: str, other: str, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with `table` on key. Rows of a frequent key are dealt by the column `other` over several tasks, each with a
    copy of the key's rows of the table. counted: the number n of rows by key, if it is known; else rows is read once more for it."""
    counted = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))) if counted is None else counted
    hot, limit = frequent(counted)
    if hot.isEmpty():
        return rows.join(table, key)
    hot = F.broadcast(cut(hot.select(key, F.ceil(F.col("n") / limit).cast("int").alias("_shares"))))
    shares = F.coalesce("_shares", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_share", F.pmod(F.xxhash64(other), shares).cast("int")).drop("_shares")
    copied = table.join(hot, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    return dealt.join(copied, [key, "_share"]).drop("_share")


def components(links: DataFrame) -> DataFrame:
    """(node, component), the smallest node reachable, for every node that the links (a, b) touch; two longs.

    Alternates large-star and small-star until no edge moves, so the rounds grow with the logarithm of a
    component's size; every round keeps one edge for a node, and a hub's neighbours are never held in one place. Whether edges
    moved is told by their number and two sums of 64-bit hashes.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both.where("v > u"), cut(least.where("n > 0")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(*x).cast("decimal(38,0)")) for x in (("u", "v"), ("v", "u"))]).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = now
