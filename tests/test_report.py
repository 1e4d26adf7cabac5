"""Reports of all verbs as whole documents and whole lines."""

import json

import pytest

from runeloom.engine import Config, Engine
from runeloom.operators import check, explain, report, sets
from runeloom.plans.config import ConfigError

FOUND = '{"path":"src/a.rs","line":2,"column":5,"byte":7,"codepoint":"U+2014","character":"\\u2014",%s"set":"ascii","lint":"outside-set","level":"deny","replacement":"--","fixable":true}'


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([("src/a.rs", "ab\nabcd—x")], "path string, text string")


@pytest.fixture(scope="module")
def skipped(spark):
    body = [("b.bin", b"a\0"), ("a.txt", b"x" * 17 + b"\xff")]
    return check.skipped(spark.createDataFrame(body, "path string, content binary"))


SKIPPED = '[{"path":"a.txt","reason":"not-utf8","byte":17,"line":1,"column":18},{"path":"b.bin","reason":"binary"}]'


def test_check_documents(spark, documents, skipped):
    found = Engine(spark).check(documents, True)
    assert report.json_document("check", "violations", found) == '{"schema":1,"verb":"check","violations":[' + FOUND % "" + '],"skipped":[]}'
    none = found.where("false")
    assert report.json_document("check", "violations", none) == '{"schema":1,"verb":"check","violations":[],"skipped":[]}'
    assert report.json_document("check", "violations", none, skipped) == '{"schema":1,"verb":"check","violations":[],"skipped":' + SKIPPED + "}"
    groups = report.json_document("check", "groups", report.summary(found))
    assert groups == '{"schema":1,"verb":"check","groups":[' + (FOUND % "")[:-1] + ',"count":1}],"skipped":[]}'
    assert report.json_error("fix", 'bad "x"') == '{"schema":1,"verb":"fix","error":"bad \\"x\\""}'


def test_a_path_is_escaped_and_ascii(spark):
    docs = spark.createDataFrame([('a"é\n.md', "—")], "path string, text string")
    text = report.json_document("check", "violations", Engine(spark).check(docs))
    assert text.isascii() and json.loads(text)["violations"][0]["path"] == 'a"é\n.md'
    result = json.loads(report.sarif_document(Engine(spark).check(docs)))["runs"][0]["results"][0]
    assert result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a%22%C3%A9%0A.md"


def test_fix_documents(spark, documents, skipped):
    engine = Engine(spark)
    text = report.json_fix(engine.rewrites(documents), engine.leftovers(documents), skipped)
    assert text == '{"schema":1,"verb":"fix","rewrites":[' + FOUND % '"to":"--",' + '],"unmapped":[],"skipped":' + SKIPPED + "}"
    left = spark.createDataFrame([("src/a.rs", "—≤\n")], "path string, text string")
    unmapped = json.loads(report.json_fix(engine.rewrites(left), engine.leftovers(left)))["unmapped"]
    assert [(x["codepoint"], x["column"], x["byte"], x["fixable"]) for x in unmapped] == [("U+2264", 3, 2, False)]
    assert [(r.codepoint, r.column, r.byte) for r in engine.leftovers(left, original=True).collect()] == [("U+2264", 2, 3)]
    assert engine.drift(left).first()[:] == (1, 1, 1, 1, 0, 1) and engine.drift(left.where("false")).first()[:] == (0, 0, 0, 0, 0, 0)
    assert Engine(spark, maps=["U+2264 U+2265", "U+2265 U+2264"]).drift(left).first().code == 1
    assert report.fix_tally(3, 1, False) == "would rewrite 3; 1 left"


def test_stats_documents(spark, skipped):
    docs = spark.createDataFrame([("b.md", "—" * 4), ("a.md", "x" * 9)], "path string, text string")
    rows = Engine(spark).stats(docs)
    one = '"outside":4,"bytes":12,"tokens_now":{"tokens":3,"method":"estimate"},"tokens_after":{"tokens":2,"method":"estimate"}}'
    assert report.json_stats(rows.where("path = 'b.md'"), skipped) == '{"schema":1,"verb":"stats","files":[{"path":"b.md",' + one + '],"total":{"files":1,' + one + ',"skipped":' + SKIPPED + "}"
    assert report.json_stats(rows.where("false")) == '{"schema":1,"verb":"stats","files":[],"total":null,"skipped":[]}'
    assert list(report.stats_text(rows)) == ["a.md outside=0 bytes=9 tokens=~3->~3", "b.md outside=4 bytes=12 tokens=~3->~2", "TOTAL files=2 outside=4 bytes=21 tokens=~6->~5"]
    assert list(report.stats_text(rows.where("path = 'a.md'"))) == ["a.md outside=0 bytes=9 tokens=~3->~3"]


def test_tokens_by_merges(spark, tmp_path):
    """Tokens of a vocabulary given by its rank file: single bytes, and one pair that merges."""
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"--", b"ab"]
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(x) + b" %d\n" % k for k, x in enumerate(ranks)))
    docs = spark.createDataFrame([("a.md", "ab—"), ("b.md", None), ("c.md", "ab ab")], "path string, text string")
    rows = Engine(spark).stats(docs, str(tmp_path / "ranks"), r"[a-z]+|[^a-z]+")
    assert {r.path: (r.outside, r.bytes, r.tokens, r.tokens_after, r.method) for r in rows.collect()} == {"a.md": (1, 5, 4, 2, "bpe"), "b.md": (0, 0, 0, 0, "bpe"), "c.md": (0, 5, 3, 3, "bpe")}
    assert list(report.stats_text(rows))[::3] == ["a.md outside=1 bytes=5 tokens=4->2 (bpe)", "TOTAL files=3 outside=1 bytes=10 tokens=7->5 (bpe)"]
    assert json.loads(report.json_stats(rows))["total"]["tokens_now"] == {"tokens": 7, "method": "bpe"}
    with pytest.raises(ConfigError):
        Engine(spark).stats(docs, str(tmp_path / "ranks"))


def test_human_reports(spark):
    docs = spark.createDataFrame([("a.md", "——≥"), ("b.md", "—")], "path string, text string")
    found = Engine(spark).check(docs)
    rows = report.human(found)
    assert list(report.text(rows, 2)) == ["a.md:1:1 U+2014 ascii", "a.md:1:2 U+2014 ascii", "... 2 more"] and len(list(report.text(rows))) == 4
    assert list(report.text(report.summary_rows(report.summary(found)), 2))[-1] == "... 1 more"
    assert report.tally_text(found) == "4 findings in 2 files; most: U+2014 x3, U+2265 x1" and report.tally_text(found.where("false")) == ""
    assert report.tally_text(found.where("path = 'b.md'")) == "1 finding in 1 file; most: U+2014 x1"


def test_sarif(spark, documents, skipped):
    run = json.loads(report.sarif_document(Engine(spark).check(documents), skipped))["runs"][0]
    assert run["tool"]["driver"]["rules"][0] == {"id": "bidi-control", "defaultConfiguration": {"level": "error"}, "properties": {"tags": ["hazard"]}}
    assert {r["id"]: r["defaultConfiguration"]["level"] for r in run["tool"]["driver"]["rules"]}["crlf"] == "none"
    result = run["results"][0]
    assert result["message"]["text"] == "U+2014 (set in force: ascii)" and result["locations"][0]["physicalLocation"]["region"] == {"startLine": 2, "startColumn": 5, "endColumn": 6}
    notes = run["invocations"][0]["toolExecutionNotifications"]
    assert [n["level"] for n in notes] == ["warning", "note"] and notes[0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 18, "byteOffset": 17} and "region" not in notes[1]["locations"][0]["physicalLocation"]


def test_explanations():
    config = Config(rules_text="* ascii\ndocs/** math @emoji !pedantic=warn !warn\n", rules=["*.x !crlf=deny"])
    text = explain.document(config, "docs/a.x")
    origin = '{"kind":"file","path":"rules","line":2}'
    assert text.endswith('"rule":{"pattern":"docs/**","sets":["math"],"family":"emoji","levels":[{"target":"pedantic","level":"warn"}],"default_level":"warn","origin":' + origin + '},"effective":{"family":{"name":"emoji","origin":' + origin + '},"default_level":{"level":"warn","origin":' + origin + '},"levels":[{"target":"pedantic","level":"warn","origin":' + origin + '},{"target":"crlf","level":"deny","origin":{"kind":"argument","index":0}}]}}')
    assert text.startswith('{"schema":1,"verb":"explain","path":"docs/a.x","set":{"name":"ascii+math","ranges":[{"start":"U+0009","end":"U+000A"}')
    assert explain.text(config, "docs/a.x") == ["path docs/a.x", "set ascii+math", "pattern docs/**", "sets math", "family emoji", "levels pedantic=warn", "level warn", "origin rules:2", "effective family emoji rules:2", "effective level warn rules:2", "effective level pedantic=warn rules:2", "effective level crlf=deny argument[0]"]
    assert json.loads(explain.document(Config(), None))["rule"] is None and explain.text(Config(), None) == ["path (all)", "set ascii", "rule none: no rule grants a set", "effective family text default"]


def test_set_listings(spark):
    engine = Engine(spark, sets=["mine x U+2014"], rules=["* @emoji"])
    every = engine.list_sets()
    assert [x["name"] for x in every][-1] == "mine" and all(x["kind"] == "preset" and x["description"] for x in every[:-1])
    assert {x["name"] for x in engine.list_sets(containing="U+2014")} == {"typography", "any", "mine"}
    assert any(a <= 0x2705 <= b for a, b in engine.list_sets(["marks"])[0]["ranges"])  # at the family of all paths
    assert engine.list_sets(["de", "mine", "de"])[0]["kind"] == "locale" and len(engine.list_sets(["mine", "mine"])) == 1
    assert {x["kind"] for x in engine.list_sets(only_locales=True)} == {"locale"} and "de" in {x["name"] for x in engine.list_sets(containing="ä")}
    assert explain.sets_text(engine.list_sets(["mine"])) == ["mine: declared by this configuration", "  U+0078 U+2014"]
    assert explain.sets_document(engine.list_sets(["mine"]), "U+0078") == '{"schema":1,"verb":"sets","containing":"U+0078","sets":[{"name":"mine","kind":"declared","description":null,"ranges":[{"start":"U+0078","end":"U+0078"},{"start":"U+2014","end":"U+2014"}]}]}'
    for bad in (["nothing"], None):
        with pytest.raises(ConfigError):
            engine.list_sets(bad, containing=None if bad else "ab")


def test_layers_of_files():
    layers = {"rules_text": "* latin1", "files": [("rules", "more", "*.md greek\n* @emoji"), ("sets", "own", "mine x")], "rules": ["*.txt mine"], "sets": ["mine y"]}
    config = Config(**layers)
    assert [r.origin for r in config.rule_list] == ["rules:1", "more:1", "more:2", "argument[0]"] and config.law("a.md").sets == ("ascii", "greek")
    assert [c for c in "xy" if any(a <= ord(c) <= b for a, b in config.catalog.resolve("mine"))] == ["y"]
    assert [r.origin for r in Config(**layers, no_files=True).rule_list] == ["argument[0]"]
    with pytest.raises(ConfigError):
        Config(files=[("other", "x", "")])


def test_survey_and_draft(spark, monkeypatch):
    rows = [("a.md", "≤​——"), ("b.md", "—❤️"), ("c.rs", "plain"), ("d.txt", ""), ("e.py", "— "), ("f.py", "â\u0080\u0094")]
    docs = spark.createDataFrame(rows, "path string, text string")
    engine = Engine(spark)
    found = {(r.pattern, r.kind, r.character): (r.lint, r.n, r.files, r.first) for r in sets.surveyed(sets.survey(docs, engine.bench)).collect()}
    assert found["*.md", "fixable", "—"] == (None, 3, 2, "a.md") and found["*.md", "hazard", "​"] == ("invisible", 1, 1, "a.md") and found["*.md", "sequence", None] == (None, 1, 1, "b.md")
    assert found["*.py", "hazard", "—"] == ("double-encoded", 1, 1, "f.py") and ("*.rs", "needed", None) not in found
    left = {r.pattern: (r.findings, r.files) for r in sets.unfixed(sets.survey(docs, engine.bench), {"*.py": [(0xA0, 0xA0)]}).collect()}
    assert left == {"*.md": (3, 2), "*.py": (1, 1)}
    text = engine.init_text(docs, skipped=2)
    assert "# 6 files read, 2 skipped." in text and "# Plain ASCII, no line needed: *.rs (1)" in text and "*.txt any" in text and "# Hazard, never granted: U+200B invisible in a.md" in text
    assert "# Rewritten; until then check reports 3 in 2 files: U+2014" in text and "# Needs no grant." in text and any(x.startswith("*.md ascii+math") for x in text)
    monkeypatch.setattr(sets, "MOST", 2)
    with pytest.raises(ValueError):
        engine.init(docs)
    monkeypatch.undo()
    assert any(x.startswith("*.py ascii+typography") for x in engine.init_text(docs, keep_fixable=True)) and engine.init_text(docs.where("false"))[2] == "# 0 files read, 0 skipped."
