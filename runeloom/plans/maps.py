"""Rewrite maps: entries, words, classes with families, and which of them applies at a place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .config import FAMILIES, code_point, fail

_FOLDS = {"--": "2014", "-": "2013 2212 2010 2011", "'": "2018 2019 201A 201B", '"': "201C 201D 201E 201F 00AB 00BB", "...": "2026", " ": "00A0", "": "200B FEFF FE0E FE0F 1F3FB 1F3FC 1F3FD 1F3FE 1F3FF"}
BUILTIN = {chr(int(x, 16)): (to, False) for to, body in _FOLDS.items() for x in body.split()}
WORDS = {chr(0x22A5): ("not", True), chr(0x2234): ("so", True), chr(0x2235): ("because", True), chr(0x2200): ("all", True), chr(0x2208): ("in", True), chr(0x2203): ("exists", True), chr(0x2260): ("!=", False), chr(0x2192): ("->", False), chr(0x21D2): ("=>", False)}
_PEOPLE = {0x1F466, 0x1F467, 0x1F468, 0x1F469, 0x1F9D1, 0x1F9D2}


def sequence_entries(sequences: list[str]) -> dict[str, tuple[str, bool]]:
    """What listed emoji sequences are rewritten to: keycaps to their key, flags to their letters, joined ones to one emoji."""
    out: dict[str, tuple[str, bool]] = {}
    for s in sequences:
        points = [ord(c) for c in s if c != "\ufe0f"]
        if s[-1] == "\u20e3":
            for form in (s, s.replace("\ufe0f", "")):
                out[form] = (s[0], False)
        elif all(0x1F1E6 <= p <= 0x1F1FF for p in points):
            out[s] = ("".join(chr(p - 0x1F1E6 + 65) for p in points), True)
        elif points[-1] == 0xE007F:
            name = "".join(chr(p - 0xE0000) for p in points[1:-1]).upper()
            out[s] = (name[:2] + "-" + name[2:], True)
        elif "\u200d" in s:
            body = [p for p in points if p != 0x200D and not 0x1F3FB <= p <= 0x1F3FF]
            to = body[0]
            if body[0] in _PEOPLE and 0x2764 in body:
                to = 0x1F48F if 0x1F48B in body else 0x1F491
            elif 0x1F91D in body[1:]:
                pair = {body[0], body[-1]}
                to = {frozenset({0x1F468}): 0x1F46C, frozenset({0x1F469}): 0x1F46D, frozenset({0x1F468, 0x1F469}): 0x1F46B}.get(frozenset(pair), body[0])
            elif body[:2] == [0x1FAF1, 0x1FAF2]:
                to = 0x1F91D
            elif len(body) > 1 and all(p in _PEOPLE for p in body):
                to = 0x1F46A
            out[s] = (chr(to), False)
    return out


def text_of(word: str, origin: str) -> str:
    """A word of a map line: U+X+U+Y... or as it stands."""
    if word.startswith("U+"):
        return "".join(chr(code_point("U+" + x, origin)) for x in word[2:].split("+U+"))
    return word


@dataclass
class Map:
    entries: dict[str, tuple[str, bool]] = field(default_factory=dict)
    classes: dict[str, list[tuple[str, list[str]]]] = field(default_factory=dict)
    families: dict[str, str] = field(default_factory=lambda: dict(FAMILIES))
    fidelity: str = "ascii"

    @classmethod
    def parse(cls, given: list[tuple[str, str]], builtin: bool = True) -> Map:
        """`<from> [<to>]`, `word <from> <to>`, `family <name> <parent>`, `= <class> family:member,...`, `use words`; the later line wins."""
        own = cls(dict(BUILTIN) if builtin else {})
        declared: dict[str, str] = {}
        used: dict[str, str] = {}
        for origin, line in given:
            words = line.split()
            if words == ["use", "words"]:
                for k, v in WORDS.items():
                    own._put(k, *v)
            elif words[0] == "word":
                if len(words) != 3:
                    fail(origin, "`word` takes what to replace and one word")
                own._entry(words[1], words[2], True, origin)
            elif words[0] == "family":
                if len(words) != 3:
                    fail(origin, "`family` takes a name and a parent")
                if words[1] == "ascii":
                    fail(origin, "the family `ascii` has no parent")
                own.families[words[1]] = words[2]
                declared[words[1]] = origin
            elif words[0] == "=":
                if len(words) < 3:
                    fail(origin, "`=` takes a class and members")
                members = []
                for part in words[2:]:
                    family, colon, body = part.partition(":")
                    if not colon:
                        fail(origin, f"`{part}` names no family")
                    used[family] = origin
                    members.append((family, [text_of(x, origin) for x in body.split(",") if x]))
                own.classes.pop(words[1], None)
                own.classes[words[1]] = members
            elif len(words) > 2:
                fail(origin, "a map line takes what to replace and at most one replacement")
            else:
                own._entry(words[0], words[1] if len(words) > 1 else "", False, origin)
        for family, origin in (declared | used).items():
            own.way(family, origin)
        for family in own.families:
            own.way(family, "map")
        return own

    def way(self, family: str, origin: str) -> list[str]:
        """The families from one to `ascii`, in which members are looked for; one that doesn't get there raises."""
        out = [family]
        while out[-1] != "ascii":
            if out[-1] not in self.families:
                fail(origin, f"unknown family `{out[-1]}`")
            if self.families[out[-1]] in out:
                fail(origin, "families in a circle: " + " -> ".join([*out, self.families[out[-1]]]))
            out.append(self.families[out[-1]])
        return out

    def _entry(self, source: str, to: str, word: bool, origin: str) -> None:
        source = text_of(source, origin)
        if source.isascii():
            fail(origin, "what is replaced can't be all ASCII")
        self._put(source, text_of(to, origin), word)

    def _put(self, source: str, to: str, word: bool) -> None:
        self.entries.pop(source, None)
        self.entries[source] = (to, word)

    def index(self) -> dict[str, list[tuple[str, str | None, bool, str | None]]]:
        """Candidates (source, to, word, class) by first character: longest in bytes first, entries before classes."""
        all_ = [(s, to, word, None) for s, (to, word) in self.entries.items()]
        all_ += [(m, None, False, name) for name, groups in self.classes.items() for _, ms in groups for m in ms if not m.isascii()]
        out: dict[str, list] = {}
        for x in sorted(all_, key=lambda x: (-len(x[0].encode()), x[3] is not None)):
            out.setdefault(x[0][0], []).append(x)
        return out

    def target(self, name: str, allowed: Callable[[str], bool], fidelity: str) -> str | None:
        """The class's first member, on the way from a family to ascii, of which every character is allowed."""
        for family in self.way(fidelity, "map"):
            for own, members in self.classes[name]:
                if own == family:
                    for m in members:
                        if all(map(allowed, m)):
                            return m
        return None
