"""Texts whose characters are judged one by one give, in arrays, what walking them gives."""

import random

import pyarrow as pa
import pytest

from runeloom.engine import Engine
from runeloom.functions import chars
from runeloom.operators import check, plain
from runeloom.plans.config import Config

PARTS = ["a", " ", "\n", "\r\n", "\t", "\x07", "\u2014", "\u2026", "\u00ab", "\u200b", "\u202e", "\u00a0", "\u00e9", "\u2265", "\u2028", "\u3000", "\U00010348", "plain words", "\n\n"]
WIDER = ["\u00e2\u0080\u0094", "\ufeff", "\u2764\ufe0f", "\U0001f468\u200d\U0001f469", "1\ufe0f\u20e3", "\u22a5"]
CONFIGS = [
    {"rules": ["* ascii+cr"]}, {"rules": ["* ascii", "*.de latin1 !unicode-space=warn", "docs/ typography", "*.fr ascii !crlf=warn"]}, {"rules": ["* any", "* @text !confusable=warn !nfkc-compat=deny"]},
    {"maps": ["use words", "U+2265 >=", "U+2026 U+00E9", "U+2014 U+000A"]}, {"rules": ["* ascii"], "strict": True},
]


def rows(seed=3):
    rng = random.Random(seed)
    paths = ["a.md", "b.de", "docs/c.md", "e.fr", None]
    made = [(rng.choice(paths), "".join(rng.choice(PARTS + WIDER * (rng.random() < 0.2)) for _ in range(rng.randint(0, 25)))) for _ in range(500)]
    return made + [("a.md", None), ("a.md", ""), ("b.de", "x" * 100_000 + "\u2014\n\u00e9"), (None, "\u2014" * 60_000)]


@pytest.mark.parametrize("config", CONFIGS)
def test_arrays_agree_with_the_walk(spark, config):
    """Bytes are always walked, so they say what texts are to give, places and all."""
    docs = spark.createDataFrame(rows(), "path string, text string")
    walked = docs.selectExpr("coalesce(path, '') AS path", "encode(coalesce(text, ''), 'UTF-8') AS content")
    engine = Engine(spark, **config)
    for get in (engine.check, lambda d: engine.check(d, True), engine.rewrites, engine.leftovers, lambda d: engine.leftovers(d, True), engine.drift):
        got, want = (sorted(map(repr, map(tuple, get(d).collect()))) for d in (docs, walked))
        assert got == want


@pytest.mark.parametrize("ranges", [[(0, 8), (0x7F, 0x9F), (0xAB, 0xAB), (0x1F1E6, 0x1F1FF)], [(0xA0, 0xA0)], [(9, 9), (0x41, 0x42)], [(0x20, 0x10FFFF)], []])
def test_a_pattern_for_long_texts_matches_the_same_characters(spark, ranges):
    points = spark.createDataFrame([(chr(p),) for p in [*range(0x200), 0xFFFF, *range(0x1F1E0, 0x1F210), 0x10FFFF]], "c string")
    got = points.selectExpr(f"c RLIKE r'{chars.java_search(ranges)}' AS s", f"c RLIKE r'{chars.java_class(ranges)}' AS w", "c").collect()
    assert all(r.s == r.w == chars.contains(ranges, ord(r.c)) for r in got)


@pytest.mark.parametrize("large", [False, True])
def test_plain_texts_are_not_walked(large):
    """Single characters, tables of any slice, nulls and empty texts are told at once; only texts with sequences are left."""
    bench = check.Bench(Config(rules=["* ascii+cr"]), (), frozenset())
    texts = pa.array(["skipped \u2014", "a\u2014\r\n\u00e9\u200b\u2014", None, "", "x\u2764\ufe0f", "\u00e9\n\u2014\u00e9"], pa.large_string() if large else pa.string()).slice(1)
    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("byte", pa.int64()), ("codepoint", pa.string()), ("replacement", pa.string())])
    told = lambda kind: plain.taken(bench, pa.array(["p", None, None, "q", "r"]), texts, kind, schema)
    batches, left = told("rewrites")
    assert left.tolist() == [3]
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == [("p", 1, 2, 1, "U+2014", "--"), ("p", 2, 2, 8, "U+200B", ""), ("p", 2, 3, 11, "U+2014", "--"), ("r", 2, 1, 3, "U+2014", "--")]
    assert [tuple(r.values()) for b in told("leftovers")[0] for r in b.to_pylist()] == [("p", 2, 1, 5, "U+00E9", None), ("r", 1, 1, 0, "U+00E9", None), ("r", 2, 3, 5, "U+00E9", None)]
    counts = pa.schema([(c, pa.int64()) for c in plain.DRIFT])
    assert [tuple(r.values()) for b in plain.taken(bench, pa.array(["p", None, None, "q", "r"]), texts, "drift", counts)[0] for r in b.to_pylist()] == [(4, 2, 4, 3, 3, 0)]
