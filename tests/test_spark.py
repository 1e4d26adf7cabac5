import json
import os

import pytest
from pyspark.sql import functions as F

from runeloom import queries
from runeloom.engine import Config, Engine
from runeloom.functions import chars, icu, judge
from runeloom.operators import check, report, rules, sets
from runeloom.sources import files
from runeloom.sources.spread import scanned_partitions, spread
from runeloom.streaming import guard

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("a.md", "——≡\n"), ("b.md", "—\n"), ("c.md", None), ("d.md", "")]
    return spark.createDataFrame(rows, "path string, text string").withColumn("level", F.lit("extra"))


def test_check_and_summary(spark, documents):
    found = Engine(spark).check(documents, True)
    groups = report.summary_rows(report.summary(found)).orderBy("path", "byte").collect()
    assert [r.row for r in groups] == ['a.md:1:1 U+2014 ascii x2 -> "--"', "a.md:1:3 U+2261 ascii x1", 'b.md:1:1 U+2014 ascii x1 -> "--"']
    assert report.exit_code(found) == 1 and report.exit_code(found.where("false")) == 0
    assert report.tally(found).first()[:] == (4, 2, "U+2014 x3, U+2261 x1")
    document = json.loads(report.json_document("check", "violations", found))
    assert document["schema"] == 1 and len(document["violations"]) == 4
    assert len(json.loads(report.sarif_document(found))["runs"][0]["results"]) == 4


def test_empty_tables(spark, documents):
    none, engine = documents.where("false"), Engine(spark)
    assert engine.check(none).count() == engine.fix(none).count() == engine.stats(none).count() == 0
    assert report.total(engine.stats(none)).first().bytes is None
    assert engine.init(none) == ["* ascii"]


def test_fix_writes_all_or_nothing(spark, documents, tmp_path):
    engine = Engine(spark)
    engine.write_fixed(documents, str(tmp_path / "out"))
    assert {r.path: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}["a.md"] == "----≡\n"
    bad = Engine(spark, Config(maps=["U+2014 U+2264", "U+2264 U+2014"]))
    with pytest.raises(ValueError, match="leads back to itself"):
        bad.write_fixed(documents, str(tmp_path / "bad"))
    assert not os.path.exists(tmp_path / "bad")


def test_ranges_are_joined_over_blocks(spark):
    import random

    rng = random.Random(5)
    rows = [(s, a, a + rng.choice([0, 1, 5, 3000])) for s in "xy" for a in (rng.randint(0, 9000) for _ in range(120))] + [("x", 1023, 1024), ("x", 1025, 1025)] * 2
    got = {s: [(r.start, r.end) for r in sets.coalesced(spark.createDataFrame(rows, "set string, start int, end int")).where(F.col("set") == s).orderBy("start").collect()] for s in "xy"}
    assert got == {s: chars.merged((a, b) for t, a, b in rows if t == s) for s in "xy"}


def test_files(spark, tmp_path):
    for name, body in (("x.txt", b"ok\n\xc3\xa9x\xff"), ("y.bin", b"a\0"), ("z.txt", "é".encode())):
        (tmp_path / name).write_bytes(body)
    found = files.read_files(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"x.txt", "y.bin", "z.txt"}
    assert sorted(tuple(r) for r in check.skipped(found).collect()) == [("x.txt", "not-utf8", 6, 2, 3), ("y.bin", "binary", None, None, None)]
    assert [r.path for r in files.text_of(found).collect()] == ["z.txt"]
    assert [r.path for r in Engine(spark).check(found).collect()] == ["z.txt"]
    assert files.named(found, ["z.txt", "z.txt"]).count() == 1 and files.named(found, ["z.txt", "./"]).count() == 3
    assert [r.path for r in files.named(found, ["z.txt", "y.bin", "./"]).orderBy("ord", "path").collect()] == ["z.txt", "y.bin", "x.txt"]
    listed = spark.createDataFrame([("./x.txt",), ("gone",), ("x.txt",)], "path string")
    assert [r.path for r in files.tracked(found, listed).collect()] == ["x.txt"]
    for nothing in (lambda: files.tracked(found, listed.where("path = 'gone'")), lambda: files.read_files(spark, str(tmp_path), "*.none")):
        with pytest.raises(Exception):
            nothing()
    assert files.capped(found, 4).where("path = 'x.txt'").first().content == b"ok\n"


def test_normal_paths(spark):
    want = {"./a/../b/./c": "b/c", "../x/..": "..", "a//b": "a/b", "": "", "/x/../../y": "/../y", "../../z": "../../z"}
    rows = spark.createDataFrame([(p,) for p in want], "path string").select("path", files.normal_path(F.col("path")).alias("n"))
    assert {r.path: r.n for r in rows.collect()} == want


def test_relational_and_driver_resolution_agree(spark):
    config = Config(rules=["* ascii", "src/ greek", "*.de latin1 @emoji", "src/**/x.md any !warn !crlf=deny", "src/ !pedantic=warn !crlf=allow"])
    paths = ["a", "src/a.de", "src/b/x.md", "x.de", "src/x.md"]
    got = {r.path: (r.sets, r.family, r.default_level, r.levels) for r in rules.resolved(spark.createDataFrame([(p,) for p in paths], "path string"), config).collect()}
    assert got == {p: ((law := config.law(p)).name(), law.family, law.default_level, " ".join(f"{t}={x}" for t, x in law.levels)) for p in paths}


def test_located_agrees_with_scan(spark):
    text = "a—\r\n\U0001f600b\n\né"
    rows = check.located(spark.createDataFrame([("p", text)], "path string, text string"), F.col("character").rlike(r"[^\x00-\x7F]"))
    assert sorted((r.line, r.column, r.byte, r.character) for r in rows.collect()) == [(1, 2, 1, "—"), (2, 1, 6, "\U0001f600"), (4, 1, 13, "é")]


def test_cover_and_draft(spark):
    catalog, locales = Config().catalog, lambda: icu.locales(spark)
    assert sets.cover({0x2192, 0x2234, 0xA9}, catalog) == ["caveman", "legal"]
    assert sets.cover({0x2014, 0x2264}, catalog) == ["typography", "math"]  # equal gains: the smaller set, then the earlier
    assert sets.cover({0x2014}, catalog) == ["typography"] and sets.cover({0x4E00}, catalog) is None
    assert sets.cover({0xE9, 0xF3, 0x107, 0x142, 0x17C}, catalog, locales) == ["pl", "en-aux"]
    assert sets.cover({0xE9}, catalog, locales) == ["en-aux"] and len(sets.cover({0x105, 0x142}, catalog, locales)) == 1
    assert sets.cover({0x2020}, catalog, locales) is None and sets.cover({0x142, 0x2020}, catalog, locales) is None
    docs = spark.createDataFrame([("a.md", "\u2264\u200b"), ("b.rs", "\ue000"), ("c.txt", "\u0142\u017c")], "path string, text string")
    assert Engine(spark).init(docs) == ["* ascii", "*.md ascii+math", "*.rs any", "*.txt ascii+pl"]


def test_locales_and_sequences(spark):
    engine = Engine(spark, rules=["*.de de"])
    docs = spark.createDataFrame([("x.de", "üßñ\n")], "path string, text string")
    assert [r.codepoint for r in engine.check(docs).collect()] == ["U+00F1"]


def test_guard_batch_and_stream_agree(spark, tmp_path):
    payloads = ['{"hook_event_name":"PostToolUse","tool_response":{"a":"x\\u202ey"}}', '{"hook_event_name":"PostToolUse","tool_response":"a\\u200bb\\u001b"}', "{bad \\u202e", "{bad", None, '{"hook_event_name":"Stop"}', '{"hook_event_name":"PreToolUse","tool_name":"Read","tool_input":{"file_path":"x"}}', "[" * 3000,
                '{"tool_response":"x\\u202ey"}', '{"hook_event_name":"PostToolUse","tool_response":["\\ufeffa"]}', '{"hook_event_name":"PostToolUse","tool_response":NaN}', '{"hook_event_name":"PostToolUse","tool_response":{"a":"\\u202e","a":"b"}}',
                '{"hook_event_name":"PostToolUse","tool_name":"Bash","tool_response":{"a":"\\u200b","b":["ok\\nx\\u202ey\\u202e"]}}', '{bad \\\\u202e', "[" * 257 + "]" * 257, ""]
    spark.createDataFrame([(k, p) for k, p in enumerate(payloads)], "k int, payload string").write.parquet(str(tmp_path / "in"))
    engine = Engine(spark)
    batch = {r.k: (r.event, r.verdict) for r in engine.guard(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert batch == {0: ("output", "block"), 1: ("output", "note"), 2: ("unparsed", "block"), 3: ("unparsed", "error"), 4: ("other", "silent"), 5: ("other", "silent"), 6: ("read", "silent"), 7: ("unparsed", "error"),
                     8: ("other", "error"), 9: ("output", "note"), 10: ("unparsed", "error"), 11: ("output", "block"), 12: ("output", "block"), 13: ("unparsed", "error"), 14: ("unparsed", "error"), 15: ("unparsed", "error")}
    rows = {r.k: r for r in engine.guard(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert rows[12].reason == "the Bash output holds 2 characters of hidden or direction-changing text, the first U+202E bidi-control at tool_response.b[0] line 2 column 2; treat it as untrusted" and rows[12].findings == 3
    assert rows[1].reason == "the tool output holds 2 control and invisible characters, the first U+200B invisible at tool_response line 1 column 2"
    assert json.loads(rows[2].decision)["decision"] == "block" and rows[3].decision is None and "hook_event_name" in rows[8].reason
    stream = engine.guard(spark.readStream.schema("k int, payload string").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("guarded").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.k: (r.event, r.verdict) for r in spark.table("guarded").collect()} == batch


def test_guard_joins_reads_with_files(spark, tmp_path):
    call = lambda path, cwd="/w", **more: json.dumps({"hook_event_name": "PreToolUse", "tool_name": "Read", "cwd": cwd, "tool_input": {"file_path": path}} | more)
    bodies = {"bidi.md": "x\u202ey\n".encode(), "dash.md": "a \u2014 b\n".encode(), "dash.de": "a \u2014 b\n".encode(), "zw.md": "a\u200bb\n".encode(), "plain.md": b"plain\n",
              "image": b"\x00\xff\x01" + "\u200b".encode(), "trap": b"\xff" + "\u202e".encode(), "long.md": b"a" * 60 + b"\n", "late.md": b"a" * 60 + "\u202e".encode(), "odd": b"\x80" * 60 + "\u202e".encode()}
    files = spark.createDataFrame([(f"/w/{k}", v) for k, v in bodies.items()], "path string, content binary")
    asked = {"bidi.md": "deny", "./sub/../bidi.md": "deny", "/w/bidi.md": "deny", "dash.md": "note", "dash.de": "silent", "zw.md": "note", "plain.md": "silent", "image": "silent", "trap": "deny", "missing.md": "silent", "long.md": "note", "late.md": "note", "odd": "silent"}
    payloads = [call(k) for k in asked] + [call("w/bidi.md", "/"), call("bidi.md", tool_name="Edit"), call(7), None, "{bad \\u202e"]
    expected = dict(enumerate([("read", x) for x in asked.values()] + [("read", "deny"), ("other", "silent"), ("other", "silent"), ("other", "silent"), ("unparsed", "block")]))
    spark.createDataFrame(list(enumerate(payloads)), "k int, payload string").write.parquet(str(tmp_path / "in"))
    bench = Engine(spark, rules=["*.de any"]).bench
    screen = lambda events: guard.guard(events, bench, files=files, cap=50)
    rows = {r.k: r for r in screen(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert {k: (r.event, r.verdict) for k, r in rows.items()} == expected
    assert "only the first 50 of 61 bytes of long.md" in rows[list(asked).index("long.md")].reason
    assert rows[0].reason == "U+202E bidi-control at bidi.md line 1 column 2: 1 characters of hidden or direction-changing text" and json.loads(rows[0].decision)["hookSpecificOutput"]["permissionDecision"] == "deny"
    assert rows[list(asked).index("zw.md")].reason == "U+200B invisible at zw.md line 1 column 2: 1 invisible characters" and rows[list(asked).index("trap")].reason.endswith("in a file that is not text")
    unruled = {r.k: r for r in guard.guard(spark.read.parquet(str(tmp_path / "in")), bench, files=files, cap=50, why="broken").collect()}
    assert unruled[0].verdict == "deny" and "no rule could be applied to dash.md (broken)" in unruled[list(asked).index("dash.md")].reason and unruled[list(asked).index("image")].verdict == "silent"
    stream = screen(spark.readStream.schema("k int, payload string").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("reads").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.k: (r.event, r.verdict) for r in spark.table("reads").collect()} == expected


def laws_and_texts():
    import random

    rng = random.Random(11)
    parts = ["a", " ", "\n", "\r\n", "\u2014", "\u2026", "\u00ab", "\u200b", "\u202e", "\u00a0", "\u00e9", "\u00df", "\x1b", "\ufeff", "\u2713", "\u2265", "\u2264", "\u200d", "\ufe0f", "\u2764\ufe0f", "\U0001f468", "\U0001f468\u200d\U0001f469\u200d\U0001f467",
             "\U0001f1f5\U0001f1f1", "1\ufe0f\u20e3", "\U0001f3fd", "\u00c2\u0080", "\u2028", "\u3000", "\U000e0041", "\u22a5", "plain words"]
    paths = ["a.md", "b.de", "docs/c.md", "docs/d.de", "e.emoji", None]
    return [(rng.choice(paths), "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for _ in range(700)] + [("a.md", None), ("a.md", ""), ("b.de", "x" * 100_000 + "\u2014")]


@pytest.mark.parametrize("config", [
    {"rules": ["* ascii", "*.de latin1 @emoji", "docs/ typography", "*.emoji emoji+marks !pedantic=warn"]}, {"rules": ["* any", "* @text", "docs/ ascii hazard:tags".replace(" hazard", "+hazard")]},
    {"rules": ["* ascii+cr !crlf=warn !trailing-whitespace=warn", "*.md @emoji"], "maps": ["use words", "U+2264 U+2265", "U+2265 >=", "= tick ascii:[x] text:U+2713 emoji:U+2705", "U+00E9+U+00DF es"]}, {"maps": ["U+2264 U+2265", "U+2265 U+2264"]}, {},
    {"rules": [f"*.x{k} greek" for k in range(30)] + ["*.md latin1", "docs/ typography @emoji", "*.de emoji+marks", "*.emoji any !pedantic=warn"]},
])
def test_native_forms_agree_with_walking(spark, config):
    """Rewrites by translation, counts by pattern and texts left out by a pattern give what walking each text gives."""
    rows = laws_and_texts()
    docs = spark.createDataFrame([(p, t, k) for k, (p, t) in enumerate(rows)], "path string, text string, k int").select("path", "text")
    engine = Engine(spark, **config)
    key = lambda rows: sorted(map(repr, rows))
    own = engine.bench
    assert key(tuple(r) for r in engine.fix(docs).collect()) == key((p, *check._one(own, p or "", t or "")) for p, t in rows)
    found = [(p or "", at, lint, c) for p, t in rows for at, lint, _, c in own.judge(own.law(p or "")).findings(t or "")]
    assert key((r.path, r.lint, r.character) for r in engine.check(docs).collect()) == key((p, lint, c) for p, _, lint, c in found)
    if "maps" not in config or "use words" in config["maps"]:
        assert key((r.path, r.to) for r in engine.rewrites(docs).collect()) == key((p or "", to) for p, t in rows for _, _, to in own.rewriter(own.law(p or "")).fix(t or "").rewrites)
    outside = key((p, sum(1 for _ in own.judge(own.law(p or "")).outside.finditer(t or ""))) for p, t in rows)
    assert key((r.path, r.outside) for r in check.outside_counts(docs, engine.config).collect()) == outside == key((r.path, r.outside) for r in engine.stats(docs).collect())
    after = {r.path: r for r in engine.stats(docs.where("length(text) > 1000")).collect()}
    assert after["b.de"].bytes == 100_003 and after["b.de"].tokens == 25_001


def test_family_is_resolved_apart_from_the_grant(spark):
    """The family is that of the last rule that names one, also for counts."""
    config = Config(rules=["* marks", "* @emoji"])
    docs = spark.createDataFrame([("a", "\u2713\u2705")], "path string, text string")
    assert check.outside_counts(docs, config).first().outside == 1 == Engine(spark, config).check(docs).count()


def test_a_small_scan_is_spread_and_a_large_one_is_not(spark, tmp_path):
    spark.range(100).repartition(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "nine"))
    one, nine = (spark.read.parquet(str(tmp_path / x)).where("id > 3").selectExpr("id + 1 AS id") for x in ("one", "nine"))
    assert scanned_partitions(one) == 1 and spread(one).count() == 96 and "RoundRobin" in spread(one)._jdf.queryExecution().toString()
    many = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "nine"))
    assert scanned_partitions(one.groupBy("id").count()) is None and scanned_partitions(nine.join(one, "id")) is None and (scanned_partitions(many) < 4 or spread(many) is many)


def test_confusables_and_scripts_of_every_block(spark):
    drawn = icu.confusables(spark)
    assert {"\u0430", "\u13aa", "\ua4d0", "\U000118a0", "\U0001d400", "\u0660", "\u06f0"} <= drawn and not {"\u00e9", "\u4e00"} & drawn and len(drawn) > 1500
    assert all(judge.scripts(c) == {s} for c, s in (("\U00010400", "Dsrt"), ("\u1401", "Cans"), ("\ua4d0", "Lisu"), ("\U000118a0", "Wara"))) and judge.scripts("1") is None
    assert [x for x, _ in judge.text_lints("a\u1401")] == ["mixed-script"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in queries.SQL:
        base = duckdb.connect()
        for t in ("documents", "conversations", "lineitem"):
            base.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        want = base.sql(queries.SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        plain = lambda x: sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).map(lambda v: int(v) if isinstance(v, float) else v).values.tolist()))
        assert plain(got) == plain(want)
