"""Findings, rewrites and counts of a table of documents.

`documents` everywhere is a DataFrame with the columns path and text, or path and content (bytes). The law of a path is
resolved beside the scan, once for each distinct path in a task; a text is walked once. Texts that a pattern shows to hold
nothing of interest never leave the JVM. No operator here shuffles, but for a scan of fewer partitions than there are cores, whose rows
are dealt out; null texts count as empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import chars
from ..functions.judge import Judge, Places, unreadable
from ..functions.rewrite import Fixed, MapCycle, NotIdempotent, Rewriter
from ..plans.config import LEVELS, LINTS, Config, Law
from ..sources.spread import spread
from . import native, plain

FINDINGS = "path string, line int, column int, byte long, codepoint string, character string, set string, lint string, level string, replacement string, fixable boolean"
ROWS = 256


class Bench:
    """Judges and rewriters by law, made once in a worker."""

    def __init__(self, config: Config, sequences: tuple[str, ...], confusables: frozenset[str]):
        self.config, self.sequences, self.confusables = config, sequences, confusables
        self.law = lru_cache(4096)(config.law)
        self.judge = lru_cache(64)(self._judge)
        self.rewriter = lru_cache(64)(lambda law: Rewriter(config.map, self.judge(law)))
        self.plain = lru_cache(64)(lambda law: plain.Plain(self, law))

    def _judge(self, law: Law) -> Judge:
        own = self.config.catalog
        excused = "".join(c for c, names in (("\u200c", ("persian", "hindi")), ("\u200d", ("hindi",))) if any(n in law.sets and n in own.presets for n in names))
        return Judge(law, own.union(law.sets, law.family), self.config.strict, self.sequences, self.confusables, excused)

    def __reduce__(self):
        return Bench, (self.config, self.sequences, self.confusables)


def mapped(documents: DataFrame, bench: Bench, schema: str, each, some=None, kind: str | None = None) -> DataFrame:
    """`each(bench, path, text)` gives rows of the schema for every text; some: a condition on path and text that those with any
    rows meet; kind: what `plain.taken` calls these rows, if it makes them for the texts that it can."""
    out = to_arrow_schema(StructType.fromDDL(schema))
    sent = documents.sparkSession.sparkContext.broadcast(bench)
    bytes_ = "text" not in documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                if kind is not None and not bytes_:
                    made, left = plain.taken(own, part.column(0), part.column(1), kind, out)
                    yield from made
                    part = part.take(pa.array(left))
                rows: list[tuple] = []
                for path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if skip and text is None:
                        continue
                    if bytes_:
                        if unreadable(text or b""):
                            continue
                        text = (text or b"").decode()
                    rows.extend(each(own, path or "", text or ""))
                    if len(rows) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    documents = spread(documents.select("path", "content" if bytes_ else "text"))
    skip = some is not None and not bytes_
    if skip:  # a condition in the projection, as a filter would be moved to before the rows are dealt out
        documents = documents.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text", F.when(some(F.col("path"), F.col("text")), F.col("text")))
    return documents.mapInArrow(run, schema)


def _row(judge: Judge, path: str, place: tuple[int, int, int], lint: str, level: int, c: str, replacement=None, fixable=False) -> tuple:
    return (path, *place, chars.spelled(ord(c)), c, "hazard" if LINTS[lint] == "hazard" else judge.name, lint, LEVELS[level], replacement, fixable)


def findings(documents: DataFrame, bench: Bench, remedies: bool = False) -> DataFrame:
    """A row for each finding. With `remedies`, replacement and fixable say what running the rewrite does at its place."""

    def each(own: Bench, path: str, text: str):
        judge = own.judge(own.law(path))
        found = judge.findings(text)
        if not found:
            return
        to: dict[int, str] = {}
        left: set[int] | None = None
        if remedies:
            try:
                fixed = own.rewriter(own.law(path)).fix(text)
                to = {at: x for at, _, x in fixed.rewrites}
                left = still(own, path, text, fixed)
            except (MapCycle, NotIdempotent):
                pass
        places = Places(text)
        for at, lint, level, c in found:
            yield _row(judge, path, places.of(at), lint, level, c, to.get(at), left is not None and at not in left)

    return mapped(documents, bench, FINDINGS, each, lambda path, text: native.suspect(bench, path, text), "remedies" if remedies else "findings")


def still(own: Bench, path: str, text: str, fixed) -> set[int]:
    """Places of the original that the rewrite leaves as findings."""
    judge = own.judge(own.law(path))
    return {fixed.origin(at) for at, *_ in judge.findings(fixed.output)}


def skipped(files: DataFrame) -> DataFrame:
    """(path, reason, byte, line, column) of contents that aren't text. Whole-file tests stay in the scan's stage; only broken
    ones are looked at in Python."""
    schema = "path string, reason string, byte long, line int, column int"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            rows = [(p, *u) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (u := unreadable(c))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    body = F.col("content")
    broken = files.where(F.contains(body, F.lit(b"\0")) | ~F.is_valid_utf8(body.cast("string")))
    return broken.select("path", "content").mapInArrow(run, schema)


def rewrites(documents: DataFrame, bench: Bench) -> DataFrame:
    """A row for each rewrite: the finding at its place, or outside-set at level allow, and `to`."""

    def each(own: Bench, path: str, text: str):
        law = own.law(path)
        fixed = own.rewriter(law).fix(text)
        if not fixed.rewrites:
            return
        judge = own.judge(law)
        found = {at: (lint, level, c) for at, lint, level, c in judge.findings(text)}
        places = Places(text)
        for at, c, to in fixed.rewrites:
            lint, level, c = found.get(at, ("outside-set", 0, c))
            yield (*_row(judge, path, places.of(at), lint, level, c, to, True), to)

    return mapped(documents, bench, FINDINGS + ", to string", each, lambda path, text: native.touched(bench, path, text), "rewrites")


FIXED = "output string, n_rewrites long, n_unmapped long, error string"


def _one(own: Bench, path: str, text: str) -> tuple[str, int, int, str | None]:
    try:
        got = own.rewriter(own.law(path)).fix(text)
        return got.output, len(got.rewrites), len(got.unmapped), None
    except (MapCycle, NotIdempotent) as e:
        return text, 0, 0, str(e)


def fixed(documents: DataFrame, bench: Bench) -> DataFrame:
    """(path, output, n_rewrites, n_unmapped, error): each text rewritten; one that can't be is left as it is. Where single characters
    alone are at stake, a law's rewrite is a translation by Spark's functions; other texts, such as those with emoji sequences or
    words, are walked."""
    if "text" not in documents.columns:
        return mapped(documents, bench, "path string, " + FIXED, lambda own, path, text: [(path, *_one(own, path, text))])
    sent = documents.sparkSession.sparkContext.broadcast(bench)

    @F.pandas_udf(FIXED)
    def walked(path: pd.Series, text: pd.Series) -> pd.DataFrame:
        own = sent.value
        rows = [(None, None, None, None) if t is None else _one(own, p or "", t) for p, t in zip(path, text)]
        out = pd.DataFrame(rows, columns=["output", "n_rewrites", "n_unmapped", "error"], dtype=object)
        return out.astype({"n_rewrites": "Int64", "n_unmapped": "Int64"})

    own = spread(documents.select("path", F.coalesce("text", F.lit("")).alias("text")))
    own = own.withColumn("simple", native.fixed(bench, F.col("path"), F.col("text")))
    own = own.withColumn("walked", walked("path", F.when(F.col("simple").isNull(), F.col("text"))))
    return own.select("path", *[F.coalesce(F.col(f"simple.{c}"), F.col(f"walked.{c}")).alias(c) for c in ("output", "n_rewrites", "n_unmapped")], F.col("walked.error").alias("error"))


def leftovers(documents: DataFrame, bench: Bench, original: bool = False) -> DataFrame:
    """Findings in the texts as rewritten, in one pass. original: at the places of the original text that they come from, as a rewrite that is
    only tried reports them; else at those of the output. A text that can't be rewritten keeps its own findings."""

    def each(own: Bench, path: str, text: str):
        law = own.law(path)
        judge = own.judge(law)
        try:
            done = own.rewriter(law).fix(text)
        except (MapCycle, NotIdempotent):
            done = Fixed(text)
        found = judge.findings(done.output)
        if not found:
            return
        places = Places(text if original else done.output)
        for at, lint, level, c in sorted(((done.origin(at), *x) for at, *x in found), key=lambda x: x[0]) if original else found:
            yield _row(judge, path, places.of(at), lint, level, c)

    return mapped(documents, bench, FINDINGS, each, lambda path, text: native.suspect(bench, path, text) | native.touched(bench, path, text), "origins" if original else "leftovers")


def drift(documents: DataFrame, bench: Bench) -> DataFrame:
    """(files, drifted, rewrites, leftovers, failed, code), one row: what trying a rewrite says of a corpus, in one pass. A file drifts if anything in it would be
    rewritten; code is 1 if one does, if a denied or forbidden finding is left, or if a text can't be rewritten."""
    def each(own: Bench, path: str, text: str):
        law, failed = own.law(path), 0
        try:
            done = own.rewriter(law).fix(text)
        except (MapCycle, NotIdempotent):
            done, failed = Fixed(text), 1
        levels = [level for _, _, level, _ in own.judge(law).findings(done.output)]
        yield 1, int(bool(done.rewrites)), len(done.rewrites), len(levels), sum(x >= plain.BAD for x in levels), failed

    parts = mapped(documents, bench, ", ".join(f"{c} long" for c in plain.DRIFT), each, lambda path, text: native.suspect(bench, path, text) | native.touched(bench, path, text), "drift")
    out = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in plain.DRIFT])
    code = ((F.col("drifted") > 0) | (F.col("bad") > 0) | (F.col("failed") > 0)).cast("int")
    return out.select("files", "drifted", "rewrites", "leftovers", "failed", code.alias("code"))


def outside_counts(documents: DataFrame, config: Config) -> DataFrame:
    """(path, outside, bytes): characters outside each document's set, by pattern alone. One projection over the scan: a branch
    for each law, so that every pattern is a literal and compiled once."""
    text = F.coalesce("text", F.lit(""))
    count = lambda law: F.regexp_count(text, F.lit(chars.java_class(config.catalog.union(law.sets, law.family), True)))
    return documents.select("path", native.by_law(config, F.col("path"), count).cast("long").alias("outside"), F.octet_length(text).cast("long").alias("bytes"))


def stats(documents: DataFrame, bench: Bench) -> DataFrame:
    """(path, outside, bytes, tokens, tokens_after, method): tokens are bytes / 4, rounded up, now and after a rewrite."""
    if "text" not in documents.columns:
        def each(own: Bench, path: str, text: str):
            n, after = (len(x.encode()) for x in (text, _one(own, path, text)[0]))
            yield path, sum(1 for _ in own.judge(own.law(path)).outside.finditer(text)), n, -(-n // 4), -(-after // 4), "bytes/4"

        return mapped(documents, bench, "path string, outside long, bytes long, tokens long, tokens_after long, method string", each)
    count = lambda law: F.regexp_count("text", F.lit(chars.java_class(bench.config.catalog.union(law.sets, law.family), True)))
    own = spread(documents.select("path", F.coalesce("text", F.lit("")).alias("text")))
    own = own.withColumn("outside", native.by_law(bench.config, F.col("path"), count).cast("long")).withColumn("bytes", F.octet_length("text").cast("long"))
    own = own.withColumn("simple", native.output(bench, F.col("path"), F.col("text")))
    sent = documents.sparkSession.sparkContext.broadcast(bench)

    @F.pandas_udf("long")
    def walked(path: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else len(_one(sent.value, p or "", t)[0].encode()) for p, t in zip(path, text)], dtype="Int64")

    after = F.coalesce(F.octet_length("simple").cast("long"), walked("path", F.when(F.col("simple").isNull(), F.col("text"))))
    quarter = lambda c: F.expr(f"({c} + 3) div 4")
    return own.withColumn("after", after).select("path", "outside", "bytes", quarter("bytes").alias("tokens"), quarter("after").alias("tokens_after"), F.lit("bytes/4").alias("method"))


def merged_tokens(documents: DataFrame, bench: Bench, rank_file: bytes, pattern: str) -> DataFrame:
    """(path, outside, bytes, tokens, tokens_after, method): as stats(), with the tokens of a byte-level vocabulary's merges in place of an estimate.
    rank_file: lines of a token in base 64 and its rank; pattern: how texts are cut before they are merged."""
    if "text" not in documents.columns:
        raise ValueError("tokens are counted of texts")
    own = spread(documents.select("path", F.coalesce("text", F.lit("")).alias("text")))
    count = lambda law: F.regexp_count("text", F.lit(chars.java_class(bench.config.catalog.union(law.sets, law.family), True)))
    sent = documents.sparkSession.sparkContext.broadcast((rank_file, pattern, bench))

    @F.pandas_udf("tokens long, tokens_after long")
    def counted(path: pd.Series, text: pd.Series) -> pd.DataFrame:
        ranks, cut, bench_ = sent.value
        encoder = tokenizer(ranks, cut)
        rows = []
        for p, t in zip(path, text):
            n = len(encoder.encode_ordinary(t))
            output = _one(bench_, p or "", t)[0]
            rows.append((n, n if output == t else len(encoder.encode_ordinary(output))))
        return pd.DataFrame(rows, columns=["tokens", "tokens_after"])

    own = own.withColumn("outside", native.by_law(bench.config, F.col("path"), count).cast("long")).withColumn("bytes", F.octet_length("text").cast("long"))
    return own.withColumn("n", counted(F.coalesce("path", F.lit("")), F.col("text"))).select("path", "outside", "bytes", "n.tokens", "n.tokens_after", F.lit("bpe").alias("method"))


@lru_cache(2)
def tokenizer(rank_file: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def located(documents: DataFrame, keep: Column | None = None) -> DataFrame:
    """Every character with line, column and byte, in DataFrame functions: lines are exploded, then characters.

    keep: a condition on `character`; give one, as it is tested before positions are worked out, on whole texts and lines."""
    lines = documents.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("row", "body"))
    before = Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("base", F.coalesce(F.sum(F.octet_length("body") + 1).over(before), F.lit(0)))
    each = lines.select("path", (F.col("row") + 1).alias("line"), "base", "body", F.posexplode(F.split("body", "")).alias("at", "character")).where("character <> ''")
    if keep is not None:
        each = each.where(keep)
    return each.select("path", "line", (F.col("at") + 1).alias("column"), (F.col("base") + F.octet_length(F.substring("body", F.lit(1), F.col("at")))).cast("long").alias("byte"), "character")
