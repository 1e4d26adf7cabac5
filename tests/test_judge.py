import random

import pytest

from runeloom.engine import scan_bytes, scan_str
from runeloom.functions.judge import double_encoded, unreadable
from runeloom.operators.check import Bench
from runeloom.plans.config import Config
from runeloom.plans.maps import sequence_entries

ZWJ, VS = "‍", "️"
FAMILY = f"\U0001f468{ZWJ}\U0001f469{ZWJ}\U0001f467"
POLAND, GERMANY = "\U0001f1f5\U0001f1f1", "\U0001f1e9\U0001f1ea"
KEYCAP = f"1{VS}⃣"
SEQUENCES = (FAMILY, KEYCAP, POLAND, GERMANY, "❤" + VS)
PEDANTIC = "* any !pedantic=warn"


def bench(*rules, maps=(), builtin=True):
    config = Config(rules=list(rules), maps=list(maps), builtin_map=builtin)
    if builtin:
        config.map.entries = {**sequence_entries(list(SEQUENCES)), **config.map.entries}
    return Bench(config, SEQUENCES, frozenset("ар"))


def found(rule, text, path="a.md"):
    own = bench(rule)
    return [(lint, len(text[:at].encode())) for at, lint, _, _ in own.judge(own.law(path)).findings(text)]


@pytest.mark.parametrize(("rule", "text", "want"), [
    ("* any", "hi\U000e0041\U000e0042\n", [("tag-character", 2), ("tag-character", 6)]),
    ("* any", "a\x1bb﻿c​\n", [("control-character", 1), ("stray-bom", 3), ("invisible", 7)]),
    ("* any", "﻿hello\n", []), ("* ascii", "﻿hello\n", [("outside-set", 0)]), ("* ascii", "a​\n", [("invisible", 1)]),
    ("* emoji", FAMILY, [("outside-set", 4), ("outside-set", 11)]), ("* emoji", f"\U0001f600{ZWJ}\U0001f600", [("invisible", 4)]),
    ("* emoji", "❤" + VS, []), ("* ascii", "❤" + VS, [("outside-set", 0), ("outside-set", 3)]), ("* persian", "م‌م", []), ("* any", "a‌b", [("invisible", 1)]),
    ("* ascii+cr !pedantic=warn", "@echo off\r\n", [("crlf", 9)]), ("* ascii !pedantic=warn", "one  \ntwo\n", [("trailing-whitespace", 3)]),
    ("* ascii !pedantic=warn", "fn f() {}", [("final-newline", 8)]), ("* ascii !pedantic=warn", "a ", [("trailing-whitespace", 1)]), (PEDANTIC, "aλ", [("final-newline", 1)]),
    (PEDANTIC, "café\n", [("not-nfc", 3)]), (PEDANTIC, "xﬁ\n", [("nfkc-compat", 1)]), (PEDANTIC, "5 μm\n", [("mixed-script", 4)]), (PEDANTIC, "р\n", [("confusable", 0)]),
    (PEDANTIC, "가\n", [("not-nfc", 0)]), (PEDANTIC, "x̣́\n", [("not-nfc", 1)]), (PEDANTIC, "", []), (PEDANTIC, "\n", []),
    ("* any", "ââ\u0080\u0094\n", [("double-encoded", 2)]), ("* ascii", "café", [("outside-set", 3)]),
])
def test_findings(rule, text, want):
    assert found(rule, text) == want


def test_characters_of_no_script():
    """Each unassigned or private character is a finding of its own, and words end at it."""
    assert found("* any !mixed-script=warn", "\u0378 a\u0378b \ue000\n") == [("mixed-script", 0), ("mixed-script", 4), ("mixed-script", 8)]


def test_a_rewrite_that_changes_more_than_it_reports_raises():
    from runeloom.functions.rewrite import Touched, untouched

    untouched("a-b", "a+b", [[1, 2, "+", 1]])
    with pytest.raises(Touched):
        untouched("a-b", "a+c", [[1, 2, "+", 1]])


def test_double_encoded_runs():
    assert double_encoded("â\u0080\u0094") == [(0, 3, "—")] and double_encoded("Â\u0080") == [(0, 2, "\x80")]
    assert double_encoded("ð\u009f\u0091\u008d") == [(0, 4, "\U0001f44d")]
    assert not double_encoded("café") and not double_encoded("Ã©") and not double_encoded("à\u0080\u0080")


def fixed(text, *rules, maps=()):
    own = bench(*rules, maps=maps)
    return own.rewriter(own.law("a")).fix(text)


@pytest.mark.parametrize(("text", "want"), [
    ("a—b", "a--b"), ("—–", "---"), ("a❤b", "a❤b"), ("a​b", "ab"), ("é—é", "é--é"), (f"a{KEYCAP}b", "a1b"), (f"a{POLAND}b", "a PL b"),
    (POLAND + GERMANY, "PL DE"), ("\U0001f1fd\U0001f1fa\U0001f1f8", "\U0001f1fd\U0001f1fa\U0001f1f8"), (FAMILY, FAMILY), ("â\u0080\u0094", "--"), ("a\x1bb", "a\x1bb"), ("", ""),
])
def test_fix_to_ascii(text, want):
    assert fixed(text).output == want


def test_fix_with_other_grants_and_maps():
    assert fixed(FAMILY, "* emoji").output == "\U0001f46a"
    assert fixed("a\U0001f44d\U0001f3fdb", maps=["U+1F44D +1"]).output == "a+1b"
    assert fixed("a✓b", maps=["= tick ascii:[x] text:U+2713 emoji:U+2705"]).output == "a[x]b"
    words = {"⊥owns": "not owns", "a⊥b": "a not b", "1⊥_x": "1 not _x", "⊥∀": "not all", "(⊥)": "(not)", "⊥​x": "not x", "a→b": "a->b"}
    for text, want in words.items():
        assert fixed(text, maps=["use words"]).output == want
    got = fixed("—x≤\n—")
    assert got.rewrites == [(0, "—", "--"), (4, "—", "--")] and got.unmapped == [(3, "≤")]


def test_fix_is_idempotent_and_leaves_the_rest():
    rng = random.Random(3)
    parts = ["a", " ", "\n", "—", "​", "é", FAMILY, POLAND, KEYCAP, "‮", VS, "⊥", "â\u0080\u0094", "\x1b", "﻿", "\U0001f3fd"]
    for rule in ("* ascii", "* emoji", "* any", "* typography+caveman"):
        own = bench(rule, maps=["use words"])
        rewriter = own.rewriter(own.law("x"))
        for _ in range(250):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
            got = rewriter.fix(text)
            assert rewriter.fix(got.output).output == got.output
            assert all(text[at] == c for at, c, _ in got.rewrites)
            if not got.rewrites:
                assert got.output == text


def test_map_cycle():
    with pytest.raises(ValueError):
        fixed("≤", maps=["U+2264 U+2265", "U+2265 U+2264"])


def test_scan():
    ascii_ = str.isascii
    assert scan_str("é​", ascii_) == [(1, 1, 0, "é"), (1, 2, 2, "​")]
    assert scan_str("a\r\n​b", ascii_) == [(2, 1, 3, "​")]
    assert scan_bytes(b"ab\xffcd", ascii_) == ("not-utf8", 2, 1, 3)
    assert unreadable("ok\néx".encode() + b"\xff") == ("not-utf8", 6, 2, 3)
    assert unreadable(b"\0\xff")[0] == "binary" and unreadable(b"") is None
