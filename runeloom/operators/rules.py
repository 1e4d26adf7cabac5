"""Paths and rules as relations: the last rule that matches wins, field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import globs
from ..plans.config import Config

#: Rules beyond this number aren't broadcast; no configuration that a person writes comes near it.
MOST = 100_000


def rules_table(spark: SparkSession, config: Config) -> DataFrame:
    """(ord, pattern, regex, sets, family, default_level, origin), a row for each rule."""
    rows = [(k, r.pattern, globs.to_regex(r.pattern), "+".join(dict.fromkeys(["ascii", *r.sets])) if r.sets or r.hazards else None, r.family, r.default_level, r.origin) for k, r in enumerate(config.rule_list)]
    return spark.createDataFrame(rows, "ord int, pattern string, regex string, sets string, family string, default_level string, origin string")


def resolved(paths: DataFrame, config: Config) -> DataFrame:
    """(path, sets, winner, family, default_level, levels) of each path; levels are `target=level` in order of the targets' first appearance. A join on the rules' patterns with one row a path after it,
    partial aggregates before its exchange. For scans use the CASE chain of operators.check, which joins nothing."""
    if len(config.rule_list) > MOST:
        raise ValueError(f"more than {MOST} rules")
    rules = F.broadcast(rules_table(paths.sparkSession, config))
    last = lambda c, has: F.expr(f"max_by({c}, ord) FILTER (WHERE {has} IS NOT NULL)")
    each = paths.select("path").distinct()
    named = [(k, n, globs.to_regex(r.pattern), t, x) for k, r in enumerate(config.rule_list) for n, (t, x) in enumerate(r.levels)]
    table = F.broadcast(paths.sparkSession.createDataFrame(named, "ord int, place int, regex string, target string, level string"))
    last_level = F.max_by("level", F.struct("ord", "place"))
    levels = each.join(table, F.expr("path rlike regex")).groupBy("path", "target").agg(F.min(F.struct("ord", "place")).alias("first"), last_level.alias("level"))
    levels = levels.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat("target", F.lit("="), "level").alias("said")))), lambda x: x["said"]), " ").alias("levels"))
    found = each.join(rules, F.expr("path rlike regex"), "left").groupBy("path")
    return found.agg(
        F.coalesce(last("sets", "sets"), F.lit("ascii")).alias("sets"), last("origin", "sets").alias("winner"),
        F.coalesce(last("family", "family"), F.lit("text")).alias("family"), last("default_level", "default_level").alias("default_level"),
    ).join(levels, "path", "left").withColumn("levels", F.coalesce("levels", F.lit("")))
