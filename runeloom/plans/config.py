"""Rules, sets and maps: their line grammars, their layers, and how a name resolves.

Sources come in the order builtin, files, arguments; a later line wins. Everything is validated before a plan is
built, and what is wrong raises ConfigError with the line's origin.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..functions import chars
from . import globs

LEVELS = ("allow", "warn", "deny", "forbid")
#: Lints by name, with their groups, in the order of the registry.
LINTS = {
    **dict.fromkeys(chars.HAZARDS, "hazard"), "double-encoded": "hazard", "outside-set": "charset",
    **dict.fromkeys(["not-nfc", "nfkc-compat", "unicode-space", "mixed-script", "confusable", "crlf", "trailing-whitespace", "final-newline"], "pedantic"),
}
GROUPS = {"hazard": "forbid", "charset": "deny", "pedantic": "allow"}
#: Who claims a byte that several lints point at: the first.
CLAIMS = [*chars.HAZARDS, "double-encoded", "outside-set", "unicode-space", "crlf", "trailing-whitespace", "final-newline", "nfkc-compat", "confusable", "not-nfc", "mixed-script"]


class ConfigError(ValueError):
    pass


def fail(origin: str, why: str) -> None:
    raise ConfigError(f"{origin}: {why}")


def closest(name: str, known: Iterable[str]) -> str | None:
    """The first of the known names within two edits."""
    best = None
    for other in known:
        row = list(range(len(other) + 1))
        for i, a in enumerate(name, 1):
            row, above = [i], row
            for j, b in enumerate(other, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
        if 0 < row[-1] <= 2 and (best is None or row[-1] < best[0]):
            best = (row[-1], other)
    return best and best[1]


def unknown(origin: str, kind: str, name: str, known: Iterable[str]) -> None:
    near = closest(name, known)
    fail(origin, f"unknown {kind} `{name}`" + (f"; did you mean `{near}`?" if near else ""))


def lines(text: str, name: str) -> list[tuple[str, str]]:
    """(origin, line) of each line that isn't blank or a comment; all lines count for the number, and a line feed alone ends one."""
    return [(f"{name}:{n}", x.strip()) for n, x in enumerate(text.split("\n"), 1) if x.strip() and not x.strip().startswith("#")]


def code_point(word: str, origin: str) -> int:
    digits = word[2:]
    if not re.fullmatch("[0-9A-Fa-f]+", digits) or int(digits, 16) > 0x10FFFF or 0xD800 <= int(digits, 16) <= 0xDFFF:
        fail(origin, f"`{word}` is not a code point")
    return int(digits, 16)


@dataclass(frozen=True)
class Member:
    kind: str  # range, named
    start: int = 0
    end: int = 0
    ref: str = ""
    family: str | None = None


def parse_set(line: str, origin: str) -> tuple[str, list[Member]]:
    """`<name> <member>...`: one character, U+X, U+X-U+Y, a set's name, or family:member."""
    name, *words = line.split()
    if not words:
        fail(origin, f"set `{name}` has no member")
    out = []
    for word in words:
        family, body = None, word
        if len(word) > 2 and ":" in word[1:-1]:
            family, body = word.split(":", 1)
        if len(body) == 1:
            out.append(Member("range", ord(body), ord(body), family=family))
        elif m := re.fullmatch(r"(U\+[^-]*)-(U\+[^-]*)", body):
            a, b = code_point(m[1], origin), code_point(m[2], origin)
            if a > b:
                fail(origin, f"`{body}` runs backwards")
            out.append(Member("range", a, b, family=family))
        elif body.startswith("U+"):
            out.append(Member("range", c := code_point(body, origin), c, family=family))
        else:
            out.append(Member("named", ref=body, family=family))
    return name, out


_R = lambda text: " ".join(text.split())
PRESETS = {
    "caveman": "U+2192 U+2234 U+2200 U+2203 U+22A5 U+2260 U+2208 U+2209 U+2264 U+2265 U+00A7 U+21D2 U+2235 U+00B7 U+00D7 U+2228 U+2227 U+00AC U+2190 U+2194 U+21D4 U+2248 U+2205 U+2286 U+222A U+2229 U+2191 U+2193 U+2261 U+03A3 U+27FA U+2287",
    "box": "U+2500-U+257F U+25A0-U+25FF",
    "math": "U+00D7 U+00F7 U+00B1 U+00B0 U+00B2 U+00B3 U+2264 U+2265 U+2260 U+2248 U+221E U+00B5 U+221A U+2211 U+03C0",
    "legal": "U+00A9 U+00AE U+2122",
    "typography": "U+2014 U+2013 U+2018 U+2019 U+201C U+201D U+2026 U+00AB U+00BB U+00A0 U+2212 U+201A U+201B U+201E U+201F",
    "emoji": "U+1F300-U+1F3FA U+1F400-U+1FAFF U+2600-U+27BF",
    "marks": "U+26A0 text:U+2713 text:U+2717 text:U+2192 emoji:U+2705 emoji:U+274C emoji:U+27A1",
    "cr": "U+000D", "latin1": "U+0080-U+00FF", "latin-ext": "U+0100-U+017F", "cyrillic": "U+0400-U+04FF", "greek": "U+0370-U+03FF", "arabic": "U+0600-U+06FF",
    "persian": "U+0600-U+061B U+061D-U+06FF U+200C", "hindi": "U+0900-U+097F U+200C-U+200D", "any": "U+0000-U+D7FF U+E000-U+10FFFF",
}
#: Order in which a draft of rules tries them.
DRAFTED = ("caveman", "typography", "math", "legal", "marks", "box", "emoji", "cr")
FAMILIES = {"text": "ascii", "emoji": "text"}


class Catalog:
    """Named sets; `locale` finds ranges of names that no line declares."""

    def __init__(self, declared: Iterable[tuple[str, list[Member]]] = (), builtin: bool = True, locale=None):
        self.locale = locale
        self.sets: dict[str, list[Member]] = {}
        self.presets = set(PRESETS) if builtin else set()
        if builtin:
            for name, body in PRESETS.items():
                self.sets[name] = parse_set(f"{name} {body}", "builtin")[1]
        self.own: list[str] = []
        for name, members in declared:
            self.sets[name] = members
            self.presets.discard(name)
            self.own = [x for x in self.own if x != name] + [name]

    def names(self) -> list[str]:
        return ["ascii", *sorted(self.sets)]

    def resolve(self, name: str, family: str = "text", origin: str = "sets", _on: tuple[str, ...] = ()) -> list[chars.Range]:
        """The set's ranges: of labelled members those of the family."""
        if name in _on:
            fail(origin, "sets in a circle: " + " -> ".join([*_on, name]))
        if name == "ascii":
            return list(chars.ASCII)
        if name == "hazard":
            return chars.merged(r for x in chars.HAZARDS.values() for r in x)
        if name.startswith("hazard:") and name[7:] in chars.HAZARDS:
            return chars.merged(chars.HAZARDS[name[7:]])
        if name not in self.sets:
            if self.locale and (found := self.locale(name)) is not None:
                return chars.merged(found)
            unknown(origin, "set", name, self.names())
        out: list[chars.Range] = []
        for m in self.sets[name]:
            if m.family is None or m.family == family:
                out += [(m.start, m.end)] if m.kind == "range" else self.resolve(m.ref, family, origin, (*_on, name))
        return chars.merged(out)

    def union(self, names: Iterable[str], family: str = "text", origin: str = "sets") -> list[chars.Range]:
        return chars.merged(r for x in names for r in self.resolve(x, family, origin))


@dataclass
class Rule:
    pattern: str
    origin: str
    sets: list[str] = field(default_factory=list)
    hazards: list[str] = field(default_factory=list)
    family: str | None = None
    levels: list[tuple[str, str]] = field(default_factory=list)
    default_level: str | None = None
    line: str = ""


def parse_rule(line: str, origin: str) -> Rule:
    """`<glob> <set>[+<set>] [@family] [!level] [!target=level]`."""
    pattern, *fields = line.split()
    rule = Rule(pattern, origin, line=" ".join(line.split()))
    for word in fields:
        if word[0] == "@":
            if len(word) == 1 or rule.family is not None:
                fail(origin, "a rule names one family after `@`")
            rule.family = word[1:]
        elif word[0] == "!":
            target, eq, level = word[1:].rpartition("=")
            if level not in LEVELS:
                unknown(origin, "level", level, LEVELS)
            if not eq:
                if rule.default_level is not None:
                    fail(origin, "one level per rule")
                rule.default_level = level
                continue
            if target not in LINTS and target not in GROUPS:
                unknown(origin, "lint or group", target, [*LINTS, *GROUPS])
            if (target == "hazard" or LINTS.get(target) == "hazard") and level != "forbid":
                fail(origin, f"`{target}` can't be lowered")
            rule.levels.append((target, level))
        else:
            if rule.sets or rule.hazards:
                fail(origin, "one set list per rule")
            for name in word.split("+"):
                if not name:
                    fail(origin, "an empty name in the set list")
                if name.startswith("hazard:"):
                    if name != "hazard:tags":
                        fail(origin, f"`{name}` can't be granted; only `hazard:tags` can")
                    if not globs.narrow(pattern):
                        fail(origin, "a hazard is granted only where the pattern's first segment is literal")
                    rule.hazards.append("tags")
                else:
                    rule.sets.append(name)
    if not (rule.sets or rule.hazards or rule.family or rule.levels or rule.default_level):
        fail(origin, "a rule names a set, an `@family` or a `!level`")
    return rule


@dataclass(frozen=True)
class Law:
    """What a path is judged by, once its rules are resolved."""

    sets: tuple[str, ...] = ("ascii",)
    family: str = "text"
    levels: tuple[tuple[str, str], ...] = ()
    default_level: str | None = None
    hazards: tuple[str, ...] = ()

    def name(self) -> str:
        return "+".join(self.sets)


def resolve(rules: list[Rule], path: str) -> tuple[Law, dict]:
    """The last matching rule wins, field by field; with the origins of what it decided."""
    law, origins = {"sets": ("ascii",), "family": "text", "hazards": (), "default_level": None}, {"set": None, "pattern": None, "family": None, "level": None, "rule": None, "levels": {}}
    levels: dict[str, str] = {}
    for rule in rules:
        if not globs.matches(rule.pattern, path):
            continue
        if rule.sets or rule.hazards:
            law["sets"], law["hazards"] = tuple(dict.fromkeys(["ascii", *rule.sets])), tuple(rule.hazards)
            origins["set"], origins["pattern"], origins["rule"] = rule.origin, rule.pattern, rule
        if rule.family:
            law["family"], origins["family"] = rule.family, rule.origin
        if rule.default_level:
            law["default_level"], origins["level"] = rule.default_level, rule.origin
        for target, level in rule.levels:
            levels[target] = level  # keeps the place of the target's first appearance
            origins["levels"][target] = rule.origin
    return Law(levels=tuple(levels.items()), **law), origins


def level_of(law: Law, lint: str, strict: bool = False) -> int:
    """The directives in order, the bare level first; nothing lowers a forbid."""
    group = LINTS[lint]
    if lint == "tag-character" and "tags" in law.hazards:
        return 1
    level = GROUPS[group]
    for target, stated in [("charset", law.default_level)] * (law.default_level is not None) + list(law.levels):
        if level == "forbid":
            break
        if target in (lint, group):
            level = stated
    return 2 if strict and level == "warn" else LEVELS.index(level)


@dataclass
class Config:
    """All layers, of which a later line wins: builtin, then the files of the corpus (`..._text`), then more files by name
    (`files`: kind, name, text), then arguments. `no_files` leaves out both kinds of files. sugar: `pedantic` and `fidelity` append rules;
    `strict` makes every warning a denial."""

    rules: list[str] = field(default_factory=list)
    sets: list[str] = field(default_factory=list)
    maps: list[str] = field(default_factory=list)
    rules_text: str = ""
    sets_text: str = ""
    maps_text: str = ""
    files: list[tuple[str, str, str]] = field(default_factory=list)
    no_files: bool = False
    pedantic: bool = False
    fidelity: str | None = None
    strict: bool = False
    builtin_sets: bool = True
    builtin_map: bool = True
    locale: object = None

    def __post_init__(self):
        if unknown_kinds := {k for k, _, _ in self.files} - {"rules", "sets", "maps"}:
            raise ConfigError(f"unknown kind of file: {', '.join(sorted(unknown_kinds))}")

        def given(text: str, more: list[str], kind: str) -> list[tuple[str, str]]:
            read = [] if self.no_files else [(kind, text), *((name, body) for k, name, body in self.files if k == kind)]
            return [x for name, body in read for x in lines(body, name)] + [(f"argument[{k}]", one(x, kind)) for k, x in enumerate(more)]

        self.rule_list = [parse_rule(x, o) for o, x in given(self.rules_text, self.rules, "rules")]
        if self.pedantic:
            self.rule_list.append(parse_rule("* !pedantic=warn", "pedantic"))
        if self.fidelity:
            self.rule_list.append(parse_rule(f"* @{self.fidelity}", "fidelity"))
        self.set_lines, self.map_lines = given(self.sets_text, self.sets, "sets"), given(self.maps_text, self.maps, "maps")
        declared = []
        for o, x in self.set_lines:
            name, members = parse_set(x, o)
            if name in ("ascii", "any") or name.startswith("hazard"):
                fail(o, f"the name `{name}` is reserved")
            declared.append((name, members))
        self.catalog = Catalog(declared, self.builtin_sets, self.locale)
        from .maps import Map

        self.map = Map.parse(self.map_lines, self.builtin_map)
        for name in self.catalog.sets:
            self.catalog.resolve(name, origin="sets")
        known = {"ascii", *FAMILIES, *self.map.families}
        for rule in self.rule_list:
            if rule.family and rule.family not in known:
                unknown(rule.origin, "family", rule.family, known)
            for name in rule.sets:
                self.catalog.resolve(name, rule.family or "text", rule.origin)

    def law(self, path: str) -> Law:
        return resolve(self.rule_list, path)[0]

    def explain(self, path: str) -> dict:
        """Which rule decided what for a path."""
        law, origins = resolve(self.rule_list, path)
        levels = {x: LEVELS[level_of(law, x, self.strict)] for x in LINTS}
        return {"path": path, "set": law.name(), "sets": list(law.sets), "hazards": list(law.hazards), "family": law.family, "pattern": origins["pattern"], "winner": origins["set"], "family_from": origins["family"], "level_from": origins["level"], "levels": levels, "effective": self.catalog.union(law.sets, law.family)}

    def switches(self) -> list[str]:
        """The settings that are no lines."""
        return ["--no-builtin-map"] * (not self.builtin_map) + ["--no-builtin-sets"] * (not self.builtin_sets) + ["--strict"] * self.strict

    def export(self, form: str, path: str | None = None) -> list[str]:
        """The configuration as flags that need no files (args), as the lines of its files (lines), or in words (prompt); a path
        narrows the rules to those that match it."""
        rules = [r.line for r in self.rule_list if path is None or globs.matches(r.pattern, path)]
        sections = {"rule": rules, "set": [x for _, x in self.set_lines], "map": [x for _, x in self.map_lines]}
        if form == "args":
            return ["--no-files", *self.switches(), *(w for kind, found in sections.items() for x in found for w in (f"--{kind}", x))]
        if form == "lines":
            return [*([f"# with: {' '.join(self.switches())}"] if self.switches() else []), *(x for kind, found in sections.items() for x in (f"# {kind}s", *found))]
        if form != "prompt":
            raise ConfigError(f"unknown form `{form}`: args, lines or prompt")
        return self._prompt(path)

    def _prompt(self, path: str | None) -> list[str]:
        granting = [r for r in self.rule_list if r.sets or r.hazards]
        if path is not None:
            law, origins = resolve(self.rule_list, path)
            why = f" (pattern `{origins['pattern']}`)" if origins["pattern"] else " (no rule matches, so the default)"
            place, names, fidelity, family, grants = f"`{path}`", list(law.sets), law.family, law.family, [f"- {law.name()}{why}"]
            allowed = self.catalog.union(law.sets, law.family)
        else:
            law = Law()
            place, family, allowed = "this corpus", "text", list(chars.ASCII)
            names = list(dict.fromkeys(["ascii", *(n for r in granting for n in r.sets)]))
            grants = ["- a path that no pattern matches: ascii", *(f"- `{r.pattern}`: {'+'.join(dict.fromkeys(['ascii', *r.sets]))}" for r in granting), "(the last matching pattern wins)"]
            named = [f"`{r.pattern}` @{r.family}" for r in self.rule_list if r.family]
            fidelity = "text" + (f"; by pattern, the last match wins: {', '.join(named)}" if named else "")
        spell = lambda ranges: " ".join(chars.spelled(a) if a == b else f"{chars.spelled(a)}-{chars.spelled(b)}" for a, b in ranges)
        shown = lambda text: " ".join(chars.spelled(ord(c)) for c in text)
        out = [f"Text in {place} may hold the characters of the sets below; any other is reported.", "Allowed:", *grants, f"Fidelity: {fidelity}.", "Sets:"]
        out += [f"- {n}: {spell(self.catalog.resolve(n, family))}" for n in names]
        inside = {p for a, b in allowed for p in range(a, b + 1)} if sum(b - a + 1 for a, b in allowed) < 200_000 else None
        fits = lambda text: all(ord(c) in inside if inside is not None else chars.contains(allowed, ord(c)) for c in text)
        told = [f"- {shown(x)} -> {to!r}{' (a word)' if word else ''}" for x, (to, word) in self.map.entries.items() if not fits(x) and fits(to)]
        out += [f"- {', '.join(shown(m) for g in groups for m in g[1] if not fits(m))} -> {to!r}" for name, groups in self.map.classes.items() if (to := self.map.target(name, fits, self.map.fidelity)) is not None] + (["Write instead:", *told] if told else [])
        out.append("Never write, whatever the sets allow: " + "; ".join(f"{x} ({spell(r)})" for x, r in chars.HAZARDS.items() if not (x == "tag-character" and "tags" in law.hazards)) + ".")
        levels = [f"{x} ({LEVELS[k]})" for x, g in LINTS.items() if g == "pedantic" and (k := level_of(law, x, self.strict))]
        return out + ([f"Reported as well: {', '.join(levels)}."] if levels else [])


def one(text: str, flag: str) -> str:
    if "\n" in text or not text.strip() or text.strip().startswith("#"):
        raise ConfigError(f"a {flag} argument is exactly one line")
    return text.strip()
