"""The engine's queries over a folder of tables, with SQL for those that SQL can express.

The tables hold accented letters only, so most queries first put in characters that the operators look for, by the same
replacements here and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Config, Engine
from .functions import chars
from .operators import check, report, rules, sets
from .plans.config import PRESETS
from .sources import files
from .sources.spread import spread

#: What stands for what: a dash, a zero-width space, an override, a decomposed letter, line ends, a no-break space.
INJECTED = [("\u00f1", "\u2014"), ("\u00fc", "\u200b"), ("\u00df", "\u202e"), ("\u00e7", "c\u0327"), (", ", ",\r\n"), (". ", ". \n"), ("\u00ea", "\u00a0")]
GERMAN = "german U+00C4 U+00D6 U+00DC U+00DF U+00E4 U+00F6 U+00FC"
RULES = ["* ascii+cr !unicode-space=warn !crlf=warn !trailing-whitespace=warn !final-newline=warn", "*.fr any", "*.de ascii+german+cr"]
PLAIN = ["* ascii", "*.de german"]
PATH = "concat(source, '/', doc_id, '.', lang)"


def injected(text: Column, pairs=INJECTED) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def injected_sql(pairs=INJECTED, text: str = "text") -> str:
    for old, new in pairs:
        text = f"replace({text}, {quoted(old)}, {quoted(new)})"
    return text


def docs(spark: SparkSession, d: str, pairs=()) -> DataFrame:
    table = spread(spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", "lang", "text"))
    return table.select(F.expr(PATH).alias("path"), injected(F.col("text"), pairs).alias("text"))


def engine(spark: SparkSession, rules_: list[str], **more) -> Engine:
    return Engine(spark, Config(rules=rules_, sets=[GERMAN], **more))


# Over raw texts.


def check_summary(spark, d):
    out = engine(spark, PLAIN).summary(docs(spark, d))
    return out.select("path", "codepoint", "lint", "set", "level", "count", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "byte")


def scan_located(spark, d):
    beyond = F.col("character").rlike(r"[^\x00-\x7F]")
    table = docs(spark, d).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return check.located(table, beyond).select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "byte", "character")


def stats_outside(spark, d):
    return check.outside_counts(docs(spark, d), Config(rules=PLAIN, sets=[GERMAN]))


def stats_total(spark, d):
    return report.total(engine(spark, PLAIN).stats(docs(spark, d)).drop("method"))


def sets_needed(spark, d):
    return sets.needed(docs(spark, d)).select("pattern", "character", "files", F.col("first").alias("first_path"))


def sets_containing(spark, d):
    points = docs(spark, d).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0)))).alias("c")).distinct().select(F.ascii("c").alias("cp"))
    return sets.containing(sets.set_ranges(spark, Config(sets=[GERMAN]).catalog), points).select(F.col("cp").cast("long").alias("cp"), F.col("set").alias("name"))


def sets_coalesced(spark, d):
    table = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("set"), F.col("l_partkey").cast("int").alias("start"), (F.col("l_partkey") + F.col("l_linenumber") % 3).cast("int").alias("end"))
    return sets.coalesced(table).select(F.col("set").alias("name"), F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"))


def sets_listing(spark, d):
    return sets.listing(sets.set_ranges(spark, Config().catalog))


def init_draft(spark, d):
    lines = engine(spark, PLAIN).init(docs(spark, d, INJECTED))
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "ord int, line string")


def init_survey(spark, d):
    e = engine(spark, PLAIN)
    return sets.surveyed(sets.survey(docs(spark, d, INJECTED), e.bench)).select("pattern", "kind", "character", "lint", "n", "files", F.col("first").alias("first_path"))


def init_unfixed(spark, d):
    e = engine(spark, PLAIN)
    return sets.unfixed(sets.survey(docs(spark, d, INJECTED), e.bench), {"*.de": [(0x2014, 0x2014)], "*.fr": [(0xA0, 0xFF)]}).select("pattern", "findings", "files")


def rules_resolved(spark, d):
    config = Config(rules=["* ascii", "src1/ greek !warn", "*.de german @emoji", "src1*/**/1?.fr any", "src7/*.en !deny !crlf=warn", "/src3/** latin1+cr !crlf=deny !pedantic=warn", "*.fr !pedantic=deny !crlf=allow !pedantic=allow"], sets=[GERMAN])
    return rules.resolved(docs(spark, d), config)


def paths_normal(spark, d):
    raw = F.expr("""CASE doc_id % 6 WHEN 0 THEN concat('./', source, '/../', lang, '//', doc_id, '/./../x') WHEN 1 THEN concat('/', source, '/../../', lang) WHEN 2 THEN concat('../', source, '/..')
        WHEN 3 THEN '' WHEN 4 THEN concat(source, '/./', lang, '/') ELSE concat('../../', lang, '/..x/.') END""")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", files.normal_path(raw).alias("path"))


def files_skipped(spark, d):
    body = F.expr(f"{PATH}").alias("path"), F.expr("CASE WHEN doc_id % 5 = 0 THEN concat(encode(text, 'UTF-8'), X'FF41') WHEN doc_id % 7 = 0 THEN concat(encode(text, 'UTF-8'), X'00') ELSE encode(text, 'UTF-8') END").alias("content")
    out = check.skipped(spark.read.parquet(f"{d}/documents.parquet").select(*body))
    return out.select("path", "reason", "byte", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"))


# Over texts with characters put in.


def _findings(spark, d, remedies=False):
    return engine(spark, RULES).check(docs(spark, d, INJECTED), remedies)


def check_findings(spark, d):
    return _findings(spark, d).select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "byte", "codepoint", "set", "lint", "level")


def check_tally(spark, d):
    return report.tally(_findings(spark, d))


def check_lint_tally(spark, d):
    return report.lint_tally(_findings(spark, d))


def check_levels(spark, d):
    return _findings(spark, d).groupBy("path").agg(F.max(F.when(F.col("level").isin("deny", "forbid"), 1).otherwise(0)).cast("long").alias("code"))


def check_human(spark, d):
    return report.human(_findings(spark, d)).select("row")


def check_human_first(spark, d):
    return report.human(_findings(spark, d), 100).select("row")


def check_strict(spark, d):
    found = Engine(spark, Config(rules=RULES, sets=[GERMAN], strict=True)).check(docs(spark, d, INJECTED))
    return found.groupBy("lint", "level").agg(F.count(F.lit(1)).alias("n"))


def check_remedies(spark, d):
    found = engine(spark, ["* ascii+cr"]).check(docs(spark, d, INJECTED), True)
    return found.groupBy("codepoint", "replacement", "fixable").agg(F.count(F.lit(1)).alias("n"))


def check_json(spark, d):
    return report.json_rows(_findings(spark, d)).select("path", "byte", "document")


def check_sarif(spark, d):
    return report.sarif_results(_findings(spark, d)).select("path", "byte", "result")


def fix_documents(spark, d):
    out = engine(spark, ["* ascii+cr"]).fix(docs(spark, d, INJECTED))
    return out.select("path", F.md5(F.col("output").cast("binary")).alias("output_md5"), "n_rewrites", "n_unmapped")


def fix_rewrites(spark, d):
    out = engine(spark, ["* ascii+cr"]).rewrites(docs(spark, d, INJECTED))
    return out.select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "byte", "codepoint", "lint", "to")


def fix_leftovers(spark, d):
    out = engine(spark, ["* ascii+cr"]).leftovers(docs(spark, d, INJECTED))
    return out.select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "byte", "codepoint")


def fix_drift(spark, d):
    out = engine(spark, ["* ascii+cr"]).drift(docs(spark, d, INJECTED))
    return out.select("files", "drifted", "rewrites", "leftovers", "failed", F.col("code").cast("long").alias("code"))


def fix_left_at_origin(spark, d):
    out = engine(spark, ["* ascii+cr"]).leftovers(docs(spark, d, INJECTED), True)
    return out.select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "byte", "codepoint", "lint")


def stats_files(spark, d):
    return engine(spark, ["* ascii+cr"]).stats(docs(spark, d, INJECTED))


UNICODE = [("\u00e7", "c\u0327"), ("\u00df", "\ufb01"), ("\u00e8", "\u0430"), ("\u00e9", "\u00e2\x80\x94")]


def lints_unicode(spark, d):
    e = engine(spark, ["* any !not-nfc=warn !nfkc-compat=warn !confusable=warn"])
    return e.check(docs(spark, d, UNICODE)).groupBy("lint").agg(F.count(F.lit(1)).alias("n"))


def lints_mixed_script(spark, d):
    return engine(spark, ["* any !mixed-script=warn"]).check(docs(spark, d, [("\u00e8", "\u0430")])).select("path", "byte", "character", "lint")


def guard_events(spark, d):
    table = spark.read.parquet(f"{d}/conversations.parquet")
    payload = F.to_json(F.struct(F.lit("PostToolUse").alias("hook_event_name"), F.struct(injected(F.col("text")).alias("stdout"), F.array("role").alias("roles")).alias("tool_response")))
    out = Engine(spark).guard(table.select("conv_id", "turn", payload.alias("payload")))
    return out.select("conv_id", "turn", "event", "verdict", F.col("findings").cast("long").alias("n"), "reason", "decision")


def guard_reads(spark, d):
    table = docs(spark, d, INJECTED)
    call = F.struct(F.lit("PreToolUse").alias("hook_event_name"), F.lit("Read").alias("tool_name"), F.lit("/corpus").alias("cwd"), F.struct(F.concat(F.lit("./"), F.col("path")).alias("file_path")).alias("tool_input"))
    events = table.select("path", F.to_json(call).alias("payload"))
    body = F.expr("CASE WHEN path LIKE '%5.%' THEN concat(encode(text, 'UTF-8'), X'FF') ELSE encode(text, 'UTF-8') END")
    out = engine(spark, RULES).guard(events, files=table.select(F.concat(F.lit("/corpus/"), F.col("path")).alias("path"), body.alias("content")))
    return out.select("path", "event", "verdict", F.col("findings").cast("long").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        check_summary, scan_located, stats_outside, stats_total, sets_needed, sets_containing, sets_coalesced, sets_listing, init_draft, init_survey, init_unfixed, rules_resolved, paths_normal, files_skipped,
        check_findings, check_tally, check_lint_tally, check_levels, check_human, check_human_first, check_strict, check_remedies, check_json, check_sarif, fix_documents, fix_rewrites, fix_leftovers, fix_left_at_origin, fix_drift, stats_files,
        lints_unicode, lints_mixed_script, guard_events, guard_reads,
    )
}


def _chars(pairs=()) -> str:
    """Every character with its place, and what stands around it."""
    return f"""
d AS (SELECT {PATH} AS path, lang, {injected_sql(pairs)} AS text FROM documents),
c AS (SELECT path, lang, length(text) AS size, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM d WHERE text <> ''),
p AS (SELECT *, unicode(ch) AS cp, 1 + coalesce(sum((ch = chr(10))::INT) OVER w, 0)::BIGINT AS line, (i - coalesce(max(CASE WHEN ch = chr(10) THEN i END) OVER w, 0))::BIGINT AS col, coalesce(sum(strlen(ch)) OVER w, 0)::BIGINT AS byte,
             lead(ch) OVER (PARTITION BY path ORDER BY i) AS next FROM c WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


_POINT = "'U+' || lpad(upper(hex(cp)), greatest(4, length(hex(cp)))::INT, '0')".replace("hex(cp)", "to_hex(cp)")
_ASCII = "(cp IN (9, 10) OR cp BETWEEN 32 AND 126)"
_GERMAN = "cp IN (196, 214, 220, 223, 228, 246, 252)"
_FOUND = (
    "WITH" + _chars(INJECTED)
    + f""",
q AS (SELECT *, CASE WHEN cp = 8238 THEN 'bidi-control' WHEN cp = 8203 THEN 'invisible'
   WHEN NOT ({_ASCII} OR cp = 13 OR lang = 'fr' OR (lang = 'de' AND {_GERMAN})) THEN 'outside-set' WHEN cp = 160 THEN 'unicode-space' WHEN cp = 13 AND next = chr(10) THEN 'crlf'
   WHEN cp = 32 AND (next IS NULL OR next = chr(10)) AND lag(ch) OVER (PARTITION BY path ORDER BY i) <> ' ' THEN 'trailing-whitespace' WHEN next IS NULL AND cp <> 10 THEN 'final-newline' END AS lint FROM p),
f AS (SELECT path, line, col, byte, {_POINT} AS codepoint, ch, lint, CASE WHEN cp IN (8238, 8203) THEN 'hazard' WHEN lang = 'fr' THEN 'ascii+any' WHEN lang = 'de' THEN 'ascii+german+cr' ELSE 'ascii+cr' END AS set,
   CASE WHEN cp IN (8238, 8203) THEN 'forbid' WHEN lint = 'outside-set' THEN 'deny' ELSE 'warn' END AS level FROM q WHERE lint IS NOT NULL)"""
)
_HUMAN = "SELECT path || ':' || line || ':' || col || ' ' || codepoint || ' ' || CASE WHEN level = 'warn' THEN lint || ' (warn)' ELSE set END AS row FROM f"
_TO = "CASE cp WHEN 8212 THEN '--' WHEN 8203 THEN '' WHEN 8238 THEN '' WHEN 160 THEN ' ' END"
_FIXED = [("\u2014", "--"), ("\u200b", ""), ("\u202e", ""), ("\u00a0", " ")]
_BEYOND = f"NOT ({_ASCII} OR cp = 13)"


_ASCII_SET = "U+0009-U+000A U+0020-U+007E"
#: Controls, and what is ignorable by default.
_HAZARD_SET = "U+0000-U+0008 U+000B-U+000C U+000E-U+001F U+007F-U+009F U+00AD U+034F U+061C U+115F-U+1160 U+17B4-U+17B5 U+180B-U+180F U+200B-U+200F U+202A-U+202E U+2060-U+206F U+3164 U+FE00-U+FE0F U+FEFF U+FFA0 U+FFF0-U+FFF8 U+1BCA0-U+1BCA3 U+1D173-U+1D17A U+E0000-U+E0FFF"


def _ranges_sql(more: dict[str, str]) -> str:
    """Ranges of all sets from their lines alone: words taken apart, labels of other families left out, neighbours joined."""
    rows = ", ".join(f"({quoted(n)}, {quoted(x)})" for n, x in {**PRESETS, "ascii": _ASCII_SET, "hazard": _HAZARD_SET, **more}.items())
    return f"""
l(name, line) AS (VALUES {rows}), w AS (SELECT name, unnest(string_split(line, ' ')) AS word FROM l), v AS (SELECT name, string_split(replace(replace(word, 'text:', ''), 'U+', '0x'), '-') AS ends FROM w WHERE word NOT LIKE 'emoji:%'),
e AS (SELECT name, ends[1]::INT AS a, ends[-1]::INT AS b FROM v), o AS (SELECT *, coalesce(a > 1 + max(b) OVER (PARTITION BY name ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY name ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o), r AS (SELECT name, min(a) AS a, max(b) AS b FROM g GROUP BY name, island)"""


def _after() -> str:
    return "WITH" + _chars([*INJECTED, *_FIXED])


SQL: dict[str, str] = {
    "check_summary": "WITH" + _chars() + f""",
f AS (SELECT path, {_POINT} AS codepoint, line, col, byte, CASE WHEN lang = 'de' THEN 'ascii+german' ELSE 'ascii' END AS set FROM p WHERE NOT ({_ASCII} OR (lang = 'de' AND {_GERMAN})))
SELECT path, codepoint, 'outside-set' AS lint, set, 'deny' AS level, count(*) AS count, arg_min(line, byte) AS line, arg_min(col, byte) AS col, min(byte) AS byte FROM f GROUP BY path, codepoint, set""",
    "scan_located": "WITH" + _chars() + "\nSELECT path, line, col, byte, ch AS character FROM p WHERE cp > 127",
    "stats_outside": "WITH" + _chars() + f"\nSELECT path, (count(*) FILTER (WHERE NOT ({_ASCII} OR (lang = 'de' AND {_GERMAN}))))::BIGINT AS outside, sum(strlen(ch))::BIGINT AS bytes FROM p GROUP BY path",
    "stats_total": "WITH" + _chars() + f""",
s AS (SELECT path, count(*) FILTER (WHERE NOT ({_ASCII} OR (lang = 'de' AND {_GERMAN}))) AS outside, sum(strlen(ch)) AS bytes, sum(CASE WHEN cp = 171 OR cp = 187 THEN 1 ELSE strlen(ch) END) AS after FROM p GROUP BY path)
SELECT sum(outside)::BIGINT AS outside, sum(bytes)::BIGINT AS bytes, sum((bytes + 3) // 4)::BIGINT AS tokens, sum((after + 3) // 4)::BIGINT AS tokens_after, count(*) AS files FROM s""",
    "sets_needed": "WITH" + _chars() + f"\nSELECT '*.' || lang AS pattern, ch AS character, count(DISTINCT path) AS files, min(path) AS first_path FROM p WHERE NOT {_ASCII} GROUP BY lang, ch",
    "sets_containing": "WITH" + _chars() + "," + _ranges_sql({"german": GERMAN.removeprefix("german ")}) + "\nSELECT DISTINCT cp::BIGINT AS cp, name FROM (SELECT DISTINCT cp FROM p WHERE cp > 127) JOIN r ON cp BETWEEN a AND b",
    "sets_listing": "WITH" + _ranges_sql({}) + """, s AS (SELECT *, 'U+' || lpad(upper(to_hex(a)), greatest(4, length(to_hex(a)))::INT, '0') AS f, 'U+' || lpad(upper(to_hex(b)), greatest(4, length(to_hex(b)))::INT, '0') AS t FROM r)
SELECT name AS set, sum(b - a + 1)::BIGINT AS size, string_agg(CASE WHEN a = b THEN f ELSE f || '-' || t END, ' ' ORDER BY a) AS ranges FROM s GROUP BY name""",
    "init_survey": "WITH" + _chars(INJECTED) + f""", k AS (SELECT *, CASE WHEN cp IN (8238, 8203) THEN 'hazard' WHEN cp IN (8212, 160, 171, 187) THEN 'fixable' ELSE 'needed' END AS kind FROM p WHERE NOT {_ASCII})
SELECT '*.' || lang AS pattern, kind, ch AS character, CASE cp WHEN 8238 THEN 'bidi-control' WHEN 8203 THEN 'invisible' END AS lint, count(*) AS n, count(DISTINCT path) AS files, min(path) AS first_path FROM k GROUP BY ALL""",
    "init_unfixed": "WITH" + _chars(INJECTED) + " SELECT '*.' || lang AS pattern, count(*) AS findings, count(DISTINCT path) AS files FROM p WHERE cp IN (8212, 160, 171, 187) AND NOT (lang = 'de' AND cp = 8212) AND NOT (lang = 'fr' AND cp < 256) GROUP BY lang",
    "sets_coalesced": """
WITH t AS (SELECT l_returnflag AS name, l_partkey AS a, l_partkey + l_linenumber % 3 AS b FROM lineitem), x AS (SELECT DISTINCT name, unnest(range(a, b + 1)) AS v FROM t),
g AS (SELECT name, v, v - row_number() OVER (PARTITION BY name ORDER BY v) AS island FROM x) SELECT name, min(v)::BIGINT AS first, max(v)::BIGINT AS last FROM g GROUP BY name, island""",
    "rules_resolved": f"""
WITH d AS (SELECT DISTINCT {PATH} AS path FROM documents),
r(ord, rx, sets, family, lvl) AS (VALUES (0, '^.*$', 'ascii', NULL, NULL), (1, '^([^/]*/)*src1(/[^/]*)*$', 'ascii+greek', NULL, 'warn'), (2, '^([^/]*/)*[^/]*\\.de$', 'ascii+german', 'emoji', NULL),
  (3, '^src1[^/]*(/[^/]*)*/1[^/]\\.fr$', 'ascii+any', NULL, NULL), (4, '^src7/[^/]*\\.en$', NULL, NULL, 'deny'), (5, '^src3(/[^/]*)*$', 'ascii+latin1+cr', NULL, NULL)),
v(ord, place, rx, target, level) AS (VALUES (4, 0, '^src7/[^/]*\\.en$', 'crlf', 'warn'), (5, 0, '^src3(/[^/]*)*$', 'crlf', 'deny'), (5, 1, '^src3(/[^/]*)*$', 'pedantic', 'warn'), (6, 0, '^([^/]*/)*[^/]*\\.fr$', 'pedantic', 'deny'), (6, 1, '^([^/]*/)*[^/]*\\.fr$', 'crlf', 'allow'), (6, 2, '^([^/]*/)*[^/]*\\.fr$', 'pedantic', 'allow')),
x AS (SELECT path, target, arg_max(level, ord * 10 + place) AS level, min(ord * 10 + place) AS first FROM d JOIN v ON regexp_matches(path, rx) GROUP BY path, target),
y AS (SELECT path, string_agg(target || '=' || level, ' ' ORDER BY first) AS levels FROM x GROUP BY path),
m AS (SELECT * FROM d JOIN r ON regexp_matches(path, rx))
SELECT path, coalesce(arg_max(sets, ord) FILTER (WHERE sets IS NOT NULL), 'ascii') AS sets, 'argument[' || max(ord) FILTER (WHERE sets IS NOT NULL) || ']' AS winner,
       coalesce(arg_max(family, ord) FILTER (WHERE family IS NOT NULL), 'text') AS family, arg_max(lvl, ord) FILTER (WHERE lvl IS NOT NULL) AS default_level, coalesce(any_value(levels), '') AS levels FROM m LEFT JOIN y USING (path) GROUP BY path""",
    "paths_normal": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang || '/x' WHEN 1 THEN '/../' || lang WHEN 2 THEN '..' WHEN 3 THEN '' WHEN 4 THEN source || '/' || lang ELSE '../../' || lang || '/..x' END AS path FROM documents",
    "files_skipped": f"""
SELECT {PATH} AS path, CASE WHEN doc_id % 5 = 0 THEN 'not-utf8' ELSE 'binary' END AS reason, CASE WHEN doc_id % 5 = 0 THEN strlen(text)::BIGINT END AS byte,
       CASE WHEN doc_id % 5 = 0 THEN len(string_split(text, chr(10)))::BIGINT END AS line, CASE WHEN doc_id % 5 = 0 THEN (length(string_split(text, chr(10))[-1]) + 1)::BIGINT END AS col
FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""",
    "check_findings": _FOUND + " SELECT path, line, col, byte, codepoint, set, lint, level FROM f",
    "check_tally": _FOUND + ", t AS (SELECT codepoint, count(*) AS n FROM f GROUP BY codepoint ORDER BY n DESC, codepoint LIMIT 3) SELECT (SELECT count(*) FROM f) AS findings, (SELECT count(DISTINCT path) FROM f) AS files, (SELECT string_agg(codepoint || ' x' || n, ', ' ORDER BY n DESC, codepoint) FROM t) AS most",
    "check_lint_tally": _FOUND + " SELECT lint, count(*) AS n, arg_min(path, (path, byte)) AS first_path, arg_min(byte, (path, byte)) AS first_byte FROM f GROUP BY lint",
    "check_levels": _FOUND + " SELECT path, max(CASE WHEN level IN ('deny', 'forbid') THEN 1 ELSE 0 END)::BIGINT AS code FROM f GROUP BY path",
    "check_human": _FOUND + " " + _HUMAN,
    "check_human_first": _FOUND + " " + _HUMAN + " ORDER BY path, byte LIMIT 100",
    "check_json": _FOUND + " SELECT path, byte, json_object('path', path, 'line', line, 'column', col, 'byte', byte, 'codepoint', codepoint, 'character', ch, 'set', set, 'lint', lint, 'level', level, 'replacement', NULL, 'fixable', false)::VARCHAR AS document FROM f",
    "check_sarif": _FOUND + """ SELECT path, byte, json_object('ruleId', lint, 'level', CASE level WHEN 'warn' THEN 'warning' ELSE 'error' END, 'message', json_object('text', codepoint || ' (set in force: ' || set || ')'),
  'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', path), 'region', json_object('startLine', line, 'startColumn', col, 'endColumn', col + 1)))))::VARCHAR AS result FROM f""",
    "check_strict": _FOUND + " SELECT lint, CASE WHEN level = 'warn' THEN 'deny' ELSE level END AS level, count(*) AS n FROM f GROUP BY ALL",
    "check_remedies": "WITH" + _chars(INJECTED) + f" SELECT {_POINT} AS codepoint, {_TO} AS replacement, {_TO} IS NOT NULL OR cp IN (171, 187) AS fixable, count(*) AS n FROM p WHERE {_BEYOND} GROUP BY ALL",
    "fix_documents": "WITH" + _chars(INJECTED) + f""", o AS (SELECT {PATH} AS path, {injected_sql([*INJECTED, *_FIXED])} AS output FROM documents),
n AS (SELECT path, count(*) FILTER (WHERE {_TO} IS NOT NULL) AS r, count(*) FILTER (WHERE {_BEYOND} AND {_TO} IS NULL) AS u FROM p GROUP BY path)
SELECT path, md5(output) AS output_md5, coalesce(r, 0)::BIGINT AS n_rewrites, coalesce(u, 0)::BIGINT AS n_unmapped FROM o LEFT JOIN n USING (path)""",
    "fix_rewrites": "WITH" + _chars(INJECTED) + f" SELECT path, line, col, byte, {_POINT} AS codepoint, CASE cp WHEN 8238 THEN 'bidi-control' WHEN 8203 THEN 'invisible' ELSE 'outside-set' END AS lint, {_TO} AS \"to\" FROM p WHERE {_TO} IS NOT NULL",
    "fix_leftovers": _after() + f" SELECT path, line, col, byte, {_POINT} AS codepoint FROM p WHERE {_BEYOND}",
    "fix_left_at_origin": "WITH" + _chars(INJECTED) + f" SELECT path, line, col, byte, {_POINT} AS codepoint, 'outside-set' AS lint FROM p WHERE {_BEYOND} AND {_TO} IS NULL AND cp NOT IN (171, 187)",
    "fix_drift": "WITH" + _chars(INJECTED) + f""", t AS (SELECT path, count(*) FILTER (WHERE {_TO} IS NOT NULL OR cp IN (171, 187)) AS r, count(*) FILTER (WHERE {_BEYOND} AND {_TO} IS NULL AND cp NOT IN (171, 187)) AS u FROM p GROUP BY path)
SELECT (SELECT count(*) FROM documents) AS files, count(*) FILTER (WHERE r > 0) AS drifted, sum(r)::BIGINT AS rewrites, sum(u)::BIGINT AS leftovers, 0::BIGINT AS failed, (max(r) > 0 OR max(u) > 0)::BIGINT AS code FROM t""",
    "stats_files": "WITH" + _chars(INJECTED) + f""", s AS (SELECT path, (count(*) FILTER (WHERE {_BEYOND}))::BIGINT AS outside, sum(strlen(ch))::BIGINT AS bytes, sum(coalesce(strlen({_TO}), strlen(ch)))::BIGINT AS after FROM p GROUP BY path)
SELECT path, outside, bytes, (bytes + 3) // 4 AS tokens, (after + 3) // 4 AS tokens_after, 'bytes/4' AS method FROM s""",
    "lints_unicode": """
WITH n AS (SELECT unnest([{'lint': 'not-nfc', 'ch': '\u00e7'}, {'lint': 'nfkc-compat', 'ch': '\u00df'}, {'lint': 'confusable', 'ch': '\u00e8'}, {'lint': 'double-encoded', 'ch': '\u00e9'}]) AS k, text FROM documents),
s AS (SELECT k.lint AS lint, sum(length(text) - length(replace(text, k.ch, '')))::BIGINT AS n FROM n GROUP BY 1) SELECT lint, n FROM s WHERE n > 0""",
    "lints_mixed_script": "WITH" + _chars([("\u00e8", "\u0430")]) + """,
w AS (SELECT *, regexp_matches(ch, '[\\p{L}\\p{N}\\p{M}]') AS inner_, cp = 1072 AS cyr, regexp_matches(ch, '\\p{L}') AND cp <> 1072 AS lat FROM p),
n AS (SELECT *, sum((NOT inner_)::INT) OVER (PARTITION BY path ORDER BY i) AS word FROM w),
m AS (SELECT path, greatest(min(i) FILTER (WHERE cyr), min(i) FILTER (WHERE lat)) AS i FROM n WHERE inner_ GROUP BY path, word HAVING count(*) FILTER (WHERE cyr) > 0 AND count(*) FILTER (WHERE lat) > 0)
SELECT path, byte, ch AS character, 'mixed-script' AS lint FROM p JOIN m USING (path, i)""",
    "guard_events": f"""
WITH d AS (SELECT conv_id, turn, {injected_sql()} AS t FROM conversations),
n AS (SELECT *, length(t) - length(replace(t, {quoted(chr(0x202E))}, '')) AS b, length(t) - length(replace(t, {quoted(chr(0x200B))}, '')) AS z FROM d),
k AS (SELECT *, CASE WHEN b > 0 THEN 'block' WHEN z > 0 THEN 'note' ELSE 'silent' END AS verdict, left(t, strpos(t, CASE WHEN b > 0 THEN {quoted(chr(0x202E))} ELSE {quoted(chr(0x200B))} END)::INT - 1) AS head FROM n),
s AS (SELECT *, ' at tool_response.stdout line ' || len(string_split(head, chr(10))) || ' column ' || (length(string_split(head, chr(10))[-1]) + 1) AS spot FROM k),
r AS (SELECT *, CASE verdict WHEN 'block' THEN 'the tool output holds ' || b || ' characters of hidden or direction-changing text, the first U+202E bidi-control' || spot || '; treat it as untrusted'
                             WHEN 'note' THEN 'the tool output holds ' || z || ' invisible characters, the first U+200B invisible' || spot END AS reason FROM s)
SELECT conv_id, turn, 'output' AS event, verdict, (b + z)::BIGINT AS n, reason, CASE verdict WHEN 'block' THEN '{{"decision":"block","reason":"' || reason || '"}}'
       WHEN 'note' THEN '{{"hookSpecificOutput":{{"hookEventName":"PostToolUse","additionalContext":"' || reason || '"}}}}' END AS decision FROM r""",
    "guard_reads": _FOUND + f""", a AS (SELECT path, count(*) AS found, count(*) FILTER (WHERE set = 'hazard') AS hazards, count(*) FILTER (WHERE ch = chr(8238)) AS b FROM f GROUP BY path), g AS (SELECT d.path, d.path LIKE '%5.%' AS odd, a.* EXCLUDE (path) FROM d LEFT JOIN a USING (path))
SELECT path, 'read' AS event, CASE WHEN b > 0 THEN 'deny' WHEN found > 0 AND NOT odd THEN 'note' ELSE 'silent' END AS verdict, (CASE WHEN odd AND b > 0 THEN hazards WHEN odd THEN 0 ELSE coalesce(found, 0) END)::BIGINT AS n FROM g""",
}
