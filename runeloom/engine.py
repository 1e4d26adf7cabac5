"""The verbs over tables of documents: check, fix, stats, explain, sets, init and guard."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import icu
from .operators import check as ops
from .operators import explain, report
from .operators import sets as set_ops
from .plans.config import LINTS, LEVELS, Config, ConfigError, level_of
from .plans.maps import sequence_entries
from .streaming import guard as guard_ops


class Engine:
    """A configuration bound to a session. Everything is validated here, before any plan is built."""

    def __init__(self, spark: SparkSession, config: Config | None = None, **layers):
        config = config or Config(locale=icu.locale_set(spark), **layers)
        self.spark = spark
        sequences = icu.sequences(spark)
        if config.builtin_map:
            config.map.entries = {**sequence_entries(list(sequences)), **config.map.entries}
        asked = any(level_of(config.law(r.pattern.strip("/").replace("*", "x") or "x"), "confusable") for r in config.rule_list) or any("confusable" in dict(r.levels) or "pedantic" in dict(r.levels) for r in config.rule_list)
        self.bench = ops.Bench(_plain(config), sequences, icu.confusables(spark) if asked else frozenset())
        self.config = config

    def check(self, documents: DataFrame, remedies: bool = False) -> DataFrame:
        return ops.findings(documents, self.bench, remedies)

    def summary(self, documents: DataFrame) -> DataFrame:
        return report.summary(self.check(documents))

    def fix(self, documents: DataFrame) -> DataFrame:
        return ops.fixed(documents, self.bench)

    def rewrites(self, documents: DataFrame) -> DataFrame:
        return ops.rewrites(documents, self.bench)

    def leftovers(self, documents: DataFrame, original: bool = False) -> DataFrame:
        """Findings in the texts as rewritten, at their places in the output or in the original."""
        return ops.leftovers(documents, self.bench, original)

    def drift(self, documents: DataFrame) -> DataFrame:
        """What a rewrite would change and leave, in one row."""
        return ops.drift(documents, self.bench)

    def write_fixed(self, documents: DataFrame, path: str) -> None:
        """Rewrites all texts and commits them together, in one pass: one that can't be rewritten fails the job, and nothing is left of it."""
        out = self.fix(documents)
        failed = F.raise_error(F.concat(F.coalesce("path", F.lit("")), F.lit(": "), F.col("error")))
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        existed = files.exists(target)
        try:
            out.select("path", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("output")).alias("text")).write.parquet(path)
        except Exception as e:
            if not existed:
                files.delete(target, True)
            if "USER_RAISED_EXCEPTION" in str(e):
                raise ConfigError(str(e).split("USER_RAISED_EXCEPTION", 1)[1].split("\n", 1)[0].strip("] ")) from None
            raise

    def stats(self, documents: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
        """Characters outside the set, bytes and tokens; tokens are bytes / 4, or those of a vocabulary: the path of its rank file, read by the
        driver, and the pattern by which it cuts texts."""
        if ranks is None:
            return ops.stats(documents, self.bench)
        if pattern is None:
            raise ConfigError("a vocabulary's tokens need the pattern by which it cuts texts")
        with open(ranks, "rb") as f:
            return ops.merged_tokens(documents, self.bench, f.read(), pattern)

    def explain(self, path: str) -> dict:
        return self.config.explain(path)

    def explain_text(self, path: str | None = None, json: bool = False) -> str:
        return explain.document(self.config, path) if json else "\n".join(explain.text(self.config, path))

    def sets(self, names: list[str] | None = None) -> DataFrame:
        return set_ops.listing(set_ops.set_ranges(self.spark, self.config.catalog, names))

    def list_sets(self, names: list[str] | None = None, only_locales: bool = False, containing: str | None = None) -> list[dict]:
        """Sets with their kind, purpose and ranges: presets and declared ones; locales as well if a character is asked for."""
        known = icu.locales(self.spark) if only_locales or containing is not None else None
        return explain.listed(self.config, names, known, only_locales, containing)

    def containing(self, character: str) -> list[str]:
        catalog = self.config.catalog
        return [n for n in catalog.names() if any(a <= ord(character) <= b for a, b in catalog.resolve(n))]

    def init(self, documents: DataFrame, keep_fixable: bool = False) -> list[str]:
        return set_ops.draft(documents, self.config, keep_fixable, lambda: icu.locales(self.spark))

    def init_text(self, documents: DataFrame, keep_fixable: bool = False, skipped: int = 0) -> list[str]:
        """The draft with its reasons."""
        return set_ops.draft_text(documents, self.bench, keep_fixable, lambda: icu.locales(self.spark), skipped)

    def guard(self, events: DataFrame, payload: str = "payload", files: DataFrame | None = None) -> DataFrame:
        """What is decided about each event; with files, read events are judged by the rules of the path they name."""
        return guard_ops.guard(events, self.bench, payload, files)

    def lints_in(self, text: str) -> list[tuple[int, str]]:
        """Hazards of one text."""
        from .plans.config import Law

        return [(at, lint) for at, lint, _, _ in self.bench.judge(Law(sets=("any",))).findings(text) if LINTS[lint] == "hazard"]


def scan_str(text: str, allowed) -> list[tuple[int, int, int, str]]:
    """(line, column, byte, character) of every character that the predicate rejects."""
    from .functions.judge import Places

    places = Places(text)
    return [(*places.of(k), c) for k, c in enumerate(text) if not allowed(c)]


def scan_bytes(data: bytes, allowed):
    """(text, hits), or the reason why the bytes aren't text."""
    from .functions.judge import unreadable

    return unreadable(data) or (data.decode(), scan_str(data.decode(), allowed))


def _plain(config: Config) -> Config:
    """The configuration as workers get it: names that only the driver can look up are resolved."""
    if config.locale is None:
        return config
    from .plans.config import Member

    own = copy.copy(config)
    own.catalog = copy.copy(config.catalog)
    own.catalog.sets = dict(config.catalog.sets)
    for name in {n for r in config.rule_list for n in r.sets if n != "ascii" and n not in config.catalog.sets}:
        own.catalog.sets[name] = [Member("range", a, b) for a, b in config.catalog.resolve(name)]
    own.catalog.locale = own.locale = None
    return own


__all__ = ["Engine", "Config", "LEVELS", "scan_str", "scan_bytes"]
