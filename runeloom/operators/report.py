"""Aggregates over findings, and the forms in which they are reported."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import safe_column, uri_column
from ..plans.config import GROUPS, LINTS

VERSION = "0.2.0"


def summary(findings: DataFrame) -> DataFrame:
    """One row for each path, code point, lint and set: its first finding and how many there are. Partial aggregates first."""
    rest = [c for c in findings.columns if c not in ("path", "codepoint", "lint", "set")]
    first = F.min_by(F.struct(*rest), "byte")
    return findings.groupBy("path", "codepoint", "lint", "set").agg(first.alias("first"), F.count(F.lit(1)).alias("count")).select("path", "codepoint", "lint", "set", *[F.col(f"first.{c}").alias(c) for c in rest], "count")


def tally(findings: DataFrame) -> DataFrame:
    """(findings, files, most): how many, in how many files, and the three most frequent code points."""
    by = findings.groupBy("codepoint").agg(F.count(F.lit(1)).alias("n"))
    top = by.orderBy(F.desc("n"), "codepoint").limit(3).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "codepoint"))).alias("top"))
    whole = findings.agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("path").alias("files"))
    return whole.crossJoin(top).select("findings", "files", F.array_join(F.transform("top", lambda x: F.concat(x["codepoint"], F.lit(" x"), (-x["n"]).cast("string"))), ", ").alias("most"))  # one row with one row


def lint_tally(findings: DataFrame) -> DataFrame:
    """Findings by lint, in order of first appearance."""
    return findings.groupBy("lint").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "byte")).alias("first")).select("lint", "n", F.col("first.path").alias("first_path"), F.col("first.byte").alias("first_byte"))


def total(stats: DataFrame) -> DataFrame:
    """Sums over all files; null where there are none."""
    return stats.agg(*[F.sum(c).alias(c) for c in ("outside", "bytes", "tokens", "tokens_after")], F.count(F.lit(1)).alias("files"))


def exit_code(findings: DataFrame, skipped: DataFrame | None = None) -> int:
    """1 if anything is denied or forbidden or isn't UTF-8, else 0."""
    bad = not findings.where(F.col("level").isin("deny", "forbid")).isEmpty()
    return int(bad or (skipped is not None and not skipped.where("reason = 'not-utf8'").isEmpty()))


def _last() -> Column:
    pedantic = [k for k, g in LINTS.items() if g == "pedantic"]
    return F.when(F.col("lint").isin(pedantic), F.col("lint")).otherwise(F.col("set"))


def human(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, byte, row): a line of text for each finding; with a limit, the first ones in order of path and byte."""
    note = F.when(F.col("level") == "warn", F.lit(" (warn)")).otherwise(F.lit(""))
    usual = F.concat(F.col("codepoint"), F.lit(" "), _last())
    damaged = F.concat(F.lit('double-encoded "'), F.col("character"), F.lit('" ('), F.col("codepoint"), F.lit(")"))
    row = F.concat(safe_column(F.col("path")), F.lit(":"), F.col("line"), F.lit(":"), F.col("column"), F.lit(" "), F.when(F.col("lint") == "double-encoded", damaged).otherwise(usual), note)
    out = findings.select("path", "byte", row.alias("row"))
    return out if limit is None else out.orderBy("path", "byte").limit(limit)


def summary_rows(groups: DataFrame) -> DataFrame:
    """(path, byte, row) of a summary's groups."""
    to = F.when(F.col("replacement").isNotNull(), F.concat(F.lit(' -> "'), F.col("replacement"), F.lit('"'))).otherwise(F.lit(""))
    return groups.select("path", "byte", F.concat(safe_column(F.col("path")), F.lit(":"), F.col("line"), F.lit(":"), F.col("column"), F.lit(" "), F.col("codepoint"), F.lit(" "), _last(), F.lit(" x"), F.col("count"), to).alias("row"))


def json_rows(findings: DataFrame) -> DataFrame:
    """(path, byte, document): each finding as a JSON object, null members kept."""
    keys = ["path", "line", "column", "byte", "codepoint", "character", *["to"] * ("to" in findings.columns), "set", "lint", "level", "replacement", "fixable", *["count"] * ("count" in findings.columns)]
    return findings.select("path", "byte", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("document"))


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=True, separators=(",", ":"))


def _list(rows: Iterator) -> Iterator[str]:
    yield "["
    for k, x in enumerate(rows):
        yield ("," if k else "") + (x if isinstance(x, str) else _dump(x))
    yield "]"


def _found(findings: DataFrame) -> Iterator[dict]:
    return (json.loads(r.document) for r in json_rows(findings).orderBy("path", "byte").toLocalIterator())


def _left(skipped: DataFrame | None) -> list[dict]:
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in skipped.select("path", "reason", "byte", "line", "column").orderBy("path").toLocalIterator()] if skipped is not None else []


def json_pieces(verb: str, parts: dict) -> Iterator[str]:
    """A document in ASCII, piece by piece: schema and verb, then the parts, of which a DataFrame of findings, groups, rewrites or statistics is
    read a partition at a time. What is skipped is a DataFrame too."""
    yield f'{{"schema":1,"verb":{_dump(verb)}'
    for key, part in parts.items():
        yield f",{_dump(key)}:"
        if not isinstance(part, DataFrame):
            yield _dump(part)
        elif key == "skipped":
            yield _dump(_left(part))
        elif key == "files":
            yield from _list(_stats_row(r) for r in part.orderBy("path").toLocalIterator())
        else:
            yield from _list(_found(part))
    yield "}"


def json_document(verb: str, key: str, findings: DataFrame, skipped: DataFrame | None = None) -> str:
    """The document of a check: `violations`, or `groups` of a summary. For a report that is held at once; write the pieces, or json_rows(), where it's large."""
    return "".join(json_pieces(verb, {key: findings, "skipped": skipped if skipped is not None else []}))


def json_fix(rewrites: DataFrame, unmapped: DataFrame, skipped: DataFrame | None = None) -> str:
    """The document of a rewrite: what is rewritten, and the findings that are left."""
    return "".join(json_pieces("fix", {"rewrites": rewrites, "unmapped": unmapped, "skipped": skipped if skipped is not None else []}))


def _method(name: str) -> str:
    return "estimate" if name == "bytes/4" else name


def _stats_row(r) -> dict:
    method = _method(r["method"])
    return {"path": r["path"], "outside": r["outside"], "bytes": r["bytes"], "tokens_now": {"tokens": r["tokens"], "method": method}, "tokens_after": {"tokens": r["tokens_after"], "method": method}}


def json_stats(stats: DataFrame, skipped: DataFrame | None = None) -> str:
    """The document of statistics: a row for each file and their total, null where there is none."""
    row, method = total(stats).first(), _method((stats.select("method").first() or ["bytes/4"])[0])
    whole = {"files": row.files, "outside": row.outside, "bytes": row.bytes, "tokens_now": {"tokens": row.tokens, "method": method}, "tokens_after": {"tokens": row.tokens_after, "method": method}} if row.files else None
    return "".join(json_pieces("stats", {"files": stats, "total": whole, "skipped": skipped if skipped is not None else []}))


def json_error(verb: str, message: str) -> str:
    """The document of a run that failed."""
    return "".join(json_pieces(verb, {"error": message}))


def _count(n: int, method: str) -> str:
    return f"~{n}" if _method(method) == "estimate" else str(n)


def stats_rows(stats: DataFrame) -> DataFrame:
    """(path, row) of each file."""
    tilde = F.when(F.col("method") == "bytes/4", F.lit("~")).otherwise(F.lit(""))
    merged = F.when(F.col("method") == "bpe", F.lit(" (bpe)")).otherwise(F.lit(""))
    row = F.concat(safe_column(F.col("path")), F.lit(" outside="), F.col("outside"), F.lit(" bytes="), F.col("bytes"), F.lit(" tokens="), tilde, F.col("tokens"), F.lit("->"), tilde, F.col("tokens_after"), merged)
    return stats.select("path", row.alias("row"))


def stats_text(stats: DataFrame) -> Iterator[str]:
    """The rows in order of their paths, and the total where there are several."""
    yield from (r.row for r in stats_rows(stats).orderBy("path").toLocalIterator())
    whole = total(stats).first()
    if whole.files > 1:
        method = stats.select("method").first()[0]
        yield f"TOTAL files={whole.files} outside={whole.outside} bytes={whole.bytes} tokens={_count(whole.tokens, method)}->{_count(whole.tokens_after, method)}" + " (bpe)" * (method == "bpe")


def text(rows: DataFrame, limit: int | None = None) -> Iterator[str]:
    """Lines of a report, in order; beyond a limit, how many more there are."""
    kept = rows.orderBy("path", "byte")
    yield from (r.row for r in (kept if limit is None else kept.limit(limit)).toLocalIterator())
    if limit is not None and (more := rows.count() - limit) > 0:
        yield f"... {more} more"


def tally_text(findings: DataFrame) -> str:
    """The closing line of a check; empty where there is nothing to say."""
    t = tally(findings).first()
    plural = lambda n, noun: f"{n} {noun}" + "s" * (n != 1)
    return f"{plural(t.findings, 'finding')} in {plural(t.files, 'file')}; most: {t.most}" if t.findings else ""


def fix_tally(rewrites: int, left: int, wrote: bool) -> str:
    """The closing line of a rewrite."""
    return f"{'rewrote' if wrote else 'would rewrite'} {rewrites}; {left} left"


def sarif_results(findings: DataFrame) -> DataFrame:
    """(path, byte, result): each finding as a SARIF result."""
    level = F.when(F.col("level") == "warn", F.lit("warning")).when(F.col("level") == "allow", F.lit("none")).otherwise(F.lit("error"))
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), (F.col("column") + 1).alias("endColumn"))
    uri = F.concat(F.when(F.col("path").startswith("/"), F.lit("file://")).otherwise(F.lit("")), uri_column(F.col("path")))
    where = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    message = F.struct(F.concat(F.col("codepoint"), F.lit(" (set in force: "), F.col("set"), F.lit(")")).alias("text"))
    return findings.select("path", "byte", F.to_json(F.struct(F.col("lint").alias("ruleId"), level.alias("level"), message.alias("message"), F.array(where).alias("locations"))).alias("result"))


_WORDS = {"allow": "none", "warn": "warning", "deny": "error", "forbid": "error"}


def _unread(r: dict) -> dict:
    where: dict = {"artifactLocation": {"uri": ("file://" if r["path"].startswith("/") else "") + quote(r["path"], safe="/-._~")}}
    if r["reason"] != "binary":
        where["region"] = {"startLine": r["line"], "startColumn": r["column"], "byteOffset": r["byte"]}
    said = ("note", "not read: binary") if r["reason"] == "binary" else ("warning", f"not read: invalid UTF-8 at {r['line']}:{r['column']}")
    return {"level": said[0], "message": {"text": said[1]}, "locations": [{"physicalLocation": where}]}


def sarif_pieces(findings: DataFrame, skipped: DataFrame | None = None) -> Iterator[str]:
    """A SARIF 2.1.0 log in ASCII, piece by piece: the lints as rules, the findings as results, files that weren't read as notifications."""
    rules = [{"id": x, "defaultConfiguration": {"level": _WORDS[GROUPS[g]]}, "properties": {"tags": [g]}} for x, g in LINTS.items()]
    yield '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":' + _dump({"driver": {"name": "runeloom", "version": VERSION, "rules": rules}}) + ',"columnKind":"unicodeCodePoints","results":'
    yield from _list(_dump(json.loads(r.result)) for r in sarif_results(findings).orderBy("path", "byte").toLocalIterator())
    yield ',"invocations":' + _dump([{"executionSuccessful": True, "toolExecutionNotifications": [_unread(r) for r in _left(skipped)]}]) + "}]}"


def sarif_document(findings: DataFrame, skipped: DataFrame | None = None) -> str:
    return "".join(sarif_pieces(findings, skipped))
