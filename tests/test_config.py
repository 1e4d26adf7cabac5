import random
import re

import pytest

from runeloom.functions import chars
from runeloom.plans import globs
from runeloom.plans.config import LEVELS, PRESETS, Catalog, Config, ConfigError, closest, level_of, parse_rule, parse_set


def test_preset_sizes():
    catalog = Catalog()
    want = {"caveman": 32, "box": 224, "math": 15, "typography": 15, "emoji": 2491, "legal": 3, "cr": 1, "hindi": 130}
    assert {n: chars.size(catalog.resolve(n)) for n in want} == want
    assert set(PRESETS) <= set(catalog.names())
    assert len(chars.presentation_bases()) == 207


def test_ranges_merge():
    rng = random.Random(1)
    for _ in range(300):
        ranges = [(a, a + rng.randint(0, 5)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        got = chars.merged(ranges)
        assert {c for a, b in got for c in range(a, b + 1)} == {c for a, b in ranges for c in range(a, b + 1)}
        assert all(b + 1 < c for (_, b), (c, _) in zip(got, got[1:]))


@pytest.mark.parametrize(("pattern", "path", "want"), [
    ("*.md", "a/b.md", True), ("/a", "b/a", False), ("a/", "x/a/b", True), ("a/**", "a", True), ("**/b", "b", True), ("a/**/c", "a/c", True),
    ("a/b", "x/a/b", False), ("a?c", "abc", True), ("a*c", "a/c", False), ("[x]", "[x]", True), ("[x]", "x", False),
])
def test_globs(pattern, path, want):
    assert globs.matches(pattern, path) is want


def brute_glob(parts, path):
    if not parts:
        return not path
    if parts[0] == "**":
        return any(brute_glob(parts[1:], path[k:]) for k in range(len(path) + 1))
    one = re.escape(parts[0]).replace(r"\*", ".*").replace(r"\?", ".")
    return bool(path) and re.fullmatch(one, path[0]) is not None and brute_glob(parts[1:], path[1:])


def test_globs_against_a_recursive_matcher():
    rng = random.Random(2)
    for _ in range(4000):
        parts = [rng.choice(["**", "a", "*", "a*", "?b", "ab"]) for _ in range(rng.randint(1, 4))]
        path = [rng.choice(["a", "ab", "b", "aab"]) for _ in range(rng.randint(1, 4))]
        assert globs.matches("/" + "/".join(parts), "/".join(path)) == brute_glob(parts, path), (parts, path)


def test_the_last_rule_wins_by_field():
    config = Config(rules=["* caveman !warn", "*.md math @emoji", "docs/** !pedantic=deny", "docs/a.md !crlf=allow"])
    law = config.law("docs/a.md")
    assert law.sets == ("ascii", "math") and law.family == "emoji" and law.default_level == "warn"
    assert LEVELS[level_of(law, "crlf")] == "allow" and LEVELS[level_of(law, "not-nfc")] == "deny" and LEVELS[level_of(law, "outside-set")] == "warn"
    assert LEVELS[level_of(law, "invisible")] == "forbid" and LEVELS[level_of(law, "outside-set", True)] == "deny"


def test_forbid_is_a_floor_and_hazard_grants_warn():
    law = Config(rules=["* !outside-set=forbid", "* !outside-set=allow"]).law("x")
    assert LEVELS[level_of(law, "outside-set")] == "allow"  # one target keeps its last level
    law = Config(rules=["* !forbid", "* !outside-set=allow"]).law("x")
    assert LEVELS[level_of(law, "outside-set")] == "forbid"
    law = Config(rules=["docs/* hazard:tags"], strict=True).law("docs/x")
    assert LEVELS[level_of(law, "tag-character", True)] == "warn"


@pytest.mark.parametrize("line", ["a.md", "* @", "* a++b", "* ascii any", "* !loud", "* !nothing=warn", "* !hazard=warn", "* hazard:tags", "a hazard:bidi", "* @a @b"])
def test_bad_rules(line):
    with pytest.raises(ConfigError):
        parse_rule(line, "test")


@pytest.mark.parametrize("config", [{"rules": ["* mat"]}, {"sets": ["any a"]}, {"sets": ["xx yy", "yy xx"]}, {"rules": ["* @none"]}, {"maps": ["a b"]}, {"rules": ["* ascii\n* any"]}, {"sets": ["x U+D800"]}, {"sets": ["x U+5-U+4"]}])
def test_bad_configs(config):
    with pytest.raises(ConfigError):
        Config(**config)


@pytest.mark.parametrize("maps", [["family ascii emoji"], ["family a b", "family b a"], ["family a none"], ["= x none:y"], ["family text emoji"]])
def test_families_without_a_way_to_ascii(maps):
    with pytest.raises(ConfigError):
        Config(maps=maps)


def test_families_in_any_order():
    own = Config(maps=["= x fancy:U+2713 ascii:y", "family fancy plain", "family plain text"]).map
    assert own.way("fancy", "t") == ["fancy", "plain", "text", "ascii"] and own.target("x", lambda c: True, "fancy") == "\u2713" and own.target("x", str.isascii, "fancy") == "y"


def test_only_a_line_feed_ends_a_line():
    config = Config(rules_text="# one\x85two\n* ascii\u2028\r\n\n*.md math\x0c!warn\n")
    assert [(r.origin, r.pattern, r.sets, r.default_level) for r in config.rule_list] == [("rules:2", "*", ["ascii"], None), ("rules:4", "*.md", ["math"], "warn")]


def test_sets_lines_and_labels():
    name, members = parse_set("s x U+41-U+43 math text:U+2713 emoji:U+2705", "t")
    catalog = Catalog([(name, members)])
    assert chars.contains(catalog.resolve("s", "text"), 0x2713) and not chars.contains(catalog.resolve("s", "text"), 0x2705)
    assert chars.contains(catalog.resolve("s", "emoji"), 0x2705) and chars.contains(catalog.resolve("s"), 0x42)
    assert closest("typografy", PRESETS) == "typography" and closest("zzzzzz", PRESETS) is None


def test_export_and_explain():
    config = Config(rules=["* ascii", "*.md math"], sets=["s x"])
    assert config.export("args", "a.txt") == ["--no-files", "--rule", "* ascii", "--set", "s x"]
    assert config.export("lines") == ["# rules", "* ascii", "*.md math", "# sets", "s x", "# maps"]
    strict = Config(rules=["*.md math"], strict=True, builtin_map=False, maps=["U+2264 <="])
    assert strict.export("lines")[0] == "# with: --no-builtin-map --strict" and strict.export("args")[:3] == ["--no-files", "--no-builtin-map", "--strict"]
    prompt = config.export("prompt", "a.md")
    assert "- ascii+math (pattern `*.md`)" in prompt and "- U+2014 -> '--'" in prompt
    assert sum("->" in x for x in config.export("prompt")) == 26 == len(config.map.entries) and "- `*.md`: ascii+math" in config.export("prompt")
    assert config.explain("a.md")["winner"] == "argument[1]" and config.explain("a.md")["set"] == "ascii+math"
