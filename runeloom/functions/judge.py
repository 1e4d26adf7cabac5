"""What one text's findings are under a law. Pure functions over a string; operators apply them to columns.

A place is an index of code points until a finding is made; line and column count from 1, in code points, and only LF
ends a line; byte counts from 0 in UTF-8.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

import regex

from ..plans.config import CLAIMS, LINTS, Law, level_of
from . import chars

_SELECTORS = "\ufe0e\ufe0f"
_JOINED = regex.compile("[\u200d\ufe0f\u20e3\U0001f1e6-\U0001f1ff\U000e0020-\U000e007f]")
_RUN = regex.compile("[\u00c2-\u00df][\u0080-\u00bf]|[\u00e0-\u00ef][\u0080-\u00bf]{2}|[\u00f0-\u00f4][\u0080-\u00bf]{3}")
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}\p{M}]+")
_UNKNOWN = regex.compile(r"\p{sc=Zzzz}")
_SEGMENT = regex.compile(r"(?:(?=\p{ccc=0})\p{NFC_QC=Yes}|^)(?:(?!\p{ccc=0})[\s\S]|(?!\p{NFC_QC=Yes})[\s\S])*")
_WHITE = frozenset(chr(c) for a, b in chars.WHITE for c in range(a, b + 1))
_SPACE = frozenset(chr(c) for a, b in chars.SPACES for c in range(a, b + 1))
_CLASS = {chr(c): name for name in reversed(chars.HAZARDS) for a, b in chars.HAZARDS[name] for c in range(a, b + 1)}
RANK = {x: k for k, x in enumerate(CLAIMS)}
# The scripts of Unicode by their short names, less those that go with any (Zyyy, Zinh) or with none (Zzzz).
SCRIPTS = """Adlm Aghb Ahom Arab Armi Armn Avst Bali Bamu Bass Batk Beng Bhks Bopo Brah Brai Bugi Buhd Cakm Cans Cari Cham Cher Chrs
Copt Cpmn Cprt Cyrl Deva Diak Dogr Dsrt Dupl Egyp Elba Elym Ethi Gara Geor Glag Gong Gonm Goth Gran Grek Gujr Gukh Guru Hang Hani
Hano Hatr Hebr Hira Hluw Hmng Hmnp Hung Ital Java Kali Kana Kawi Khar Khmr Khoj Kits Knda Krai Kthi Lana Laoo Latn Lepc Limb Lina
Linb Lisu Lyci Lydi Mahj Maka Mand Mani Marc Medf Mend Merc Mero Mlym Modi Mong Mroo Mtei Mult Mymr Nagm Nand Narb Nbat Newa Nkoo
Nshu Ogam Olck Onao Orkh Orya Osge Osma Ougr Palm Pauc Perm Phag Phli Phlp Phnx Plrd Prti Rjng Rohg Runr Samr Sarb Saur Sgnw Shaw
Shrd Sidd Sidt Sind Sinh Sogd Sogo Sora Soyo Sund Sunu Sylo Syrc Tagb Takr Tale Talu Taml Tang Tavt Telu Tfng Tglg Thaa Thai Tibt
Tirh Tnsa Todr Tols Toto Tutg Ugar Vaii Vith Wara Wcho Xpeo Xsux Yezi Yiii Zanb Berf Tayo""".split()


def _known(name: str):
    try:
        return regex.compile(r"\p{scx=%s}" % name)
    except regex.error:
        return None  # newer than the tables at hand


_SCRIPT = {s: p for s in SCRIPTS if (p := _known(s))}
_WIDE = {"Hani": {"Hanb", "Jpan", "Kore"}, "Hira": {"Jpan"}, "Kana": {"Jpan"}, "Hang": {"Kore"}, "Bopo": {"Hanb"}}


@dataclass
class Judge:
    """A law made ready: the set as a pattern, levels by lint, and the tables that its lints need."""

    law: Law
    ranges: list[chars.Range]
    strict: bool = False
    sequences: tuple[str, ...] = ()
    confusables: frozenset[str] = frozenset()
    excused: str = ""
    levels: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.levels = {x: level_of(self.law, x, self.strict) for x in LINTS}
        self.name = self.law.name()
        self.outside = regex.compile(chars.python_class(self.ranges, True))
        loud = [r for x in chars.HAZARDS.values() for r in x] + chars.SPACES
        suspect = chars.python_class(chars.merged(loud))
        deep = any(self.levels[x] for x in ("nfkc-compat", "confusable"))
        self.suspect = regex.compile(f"{chars.python_class(self.ranges, True)}|{suspect}" + ("|[^\\x00-\\x7f]" if deep else ""))
        self.lists = sequence_index(self.sequences)
        self.inside = lru_cache(4096)(lambda c: self.outside.match(c) is None)

    def exempt(self, text: str) -> set[int]:
        """Joiners, selectors and tags inside listed emoji sequences: longest first, left to right."""
        out: set[int] = set()
        if not self.lists or not _JOINED.search(text):
            return out
        at = 0
        while at < len(text):
            for s in self.lists.get(text[at], ()):
                if text.startswith(s, at):
                    out.update(k for k in range(at, at + len(s)) if text[k] in _CLASS)
                    at += len(s)
                    break
            else:
                at += 1
        return out

    def selectors(self, text: str) -> set[int]:
        """Variation selectors right after a granted character that they vary."""
        bases = chars.presentation_bases()
        return {m.start() for m in _VARIED.finditer(text) if m.start() and text[m.start() - 1] in bases and self.inside(text[m.start() - 1])}

    def hazard_at(self, text: str, at: int, exempt: set[int], whole: bool = True) -> str | None:
        c = text[at]
        name = _CLASS.get(c)
        if name is None or at in exempt or c in self.excused or (name == "stray-bom" and at == 0 and whole):
            return None
        return name

    def char_lints(self, c: str):
        if c in _SPACE:
            yield "unicode-space"
        if not c.isascii():
            if self.levels["nfkc-compat"] and unicodedata.normalize("NFKC", c) != unicodedata.normalize("NFC", c):
                yield "nfkc-compat"
            if c in self.confusables:
                yield "confusable"

    def findings(self, text: str, whole: bool = True) -> list[tuple[int, str, int, str]]:
        """(place, lint, level, character), by place; one for each place, of the strongest lint that speaks. whole: whether the text
        begins a file, where a byte order mark may stand."""
        best: dict[int, tuple[str, str]] = {}

        def claim(at: int, lint: str) -> None:
            if self.levels[lint] and (at not in best or RANK[lint] < RANK[best[at][0]]):
                best[at] = (lint, text[at])

        exempt, kept = self.exempt(text), self.selectors(text)
        for m in self.suspect.finditer(text):
            at = m.start()
            if at in kept:
                continue
            c = text[at]
            if lint := self.hazard_at(text, at, exempt, whole):
                claim(at, lint)
            if not self.inside(c):
                claim(at, "outside-set")
            if at not in best:
                for lint in self.char_lints(c):
                    claim(at, lint)
        for lint, at in line_lints(text) if any(self.levels[x] for x in ("crlf", "trailing-whitespace", "final-newline")) else ():
            claim(at, lint)
        if not text.isascii() and (self.levels["not-nfc"] or self.levels["mixed-script"]):
            for lint, at in text_lints(text):
                claim(at, lint)
        for at, n, said in double_encoded(text):
            for k in range(at, at + n):
                best.pop(k, None)
            best[at] = ("double-encoded", said)
        return [(at, lint, self.levels[lint], c) for at, (lint, c) in sorted(best.items())]


_VARIED = regex.compile(f"[{_SELECTORS}]")


def sequence_index(sequences) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for s in sorted(sequences, key=lambda s: -len(s.encode())):
        out.setdefault(s[0], []).append(s)
    return out


def line_lints(text: str):
    """crlf, trailing-whitespace and final-newline with their places."""
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        stop = len(text) if end < 0 else end
        if end > at and text[end - 1] == "\r":
            yield "crlf", end - 1
            stop -= 1
        begin = stop
        while begin > at and text[begin - 1] in _WHITE:
            begin -= 1
        if begin < stop:
            yield "trailing-whitespace", begin
        at = stop + 1 if end < 0 else end + 1
    if text and not text.endswith("\n"):
        yield "final-newline", len(text) - 1


@lru_cache(8192)
def scripts(c: str) -> frozenset[str] | None:
    """The character's scripts with those that writing systems add; None for one that goes with any."""
    found = {s for s, p in _SCRIPT.items() if p.match(c)}
    if not found:
        return None
    return frozenset(found.union(*(_WIDE.get(s, ()) for s in found)))


def text_lints(text: str):
    """not-nfc and mixed-script with their places. A character of no script at all, as an unassigned one, goes with nothing, itself included."""
    if unicodedata.normalize("NFC", text) != text:
        for m in _SEGMENT.finditer(text):
            own = m[0]
            made = unicodedata.normalize("NFC", own)
            if made != own:
                yield "not-nfc", m.start() + min(next((k for k, (a, b) in enumerate(zip(own, made)) if a != b), min(len(own), len(made))), len(own) - 1)
    for m in _UNKNOWN.finditer(text):
        yield "mixed-script", m.start()
    for m in _WORD.finditer(text):
        if m[0].isascii():
            continue
        left = None
        for k, c in enumerate(m[0]):
            own = scripts(c)
            if own is not None:
                left = own if left is None else left & own
                if not left:
                    yield "mixed-script", m.start() + k
                    break


def double_encoded(text: str) -> list[tuple[int, int, str]]:
    """(place, length, character) of runs that are one character's UTF-8 read as Latin-1, with a control among them."""
    out = []
    at = 0
    while not text.isascii() and (m := _RUN.search(text, at)):
        at = m.end()
        try:
            said = m[0].encode("latin-1").decode()
            fits = any("\x80" <= c <= "\x9f" for c in m[0])
        except UnicodeDecodeError:
            fits = False
        if fits:
            out.append((m.start(), len(m[0]), said))
        else:
            at = m.start() + 1
    return out


class Places:
    """Lines, columns and bytes of places of one text, asked in rising order."""

    def __init__(self, text: str):
        self.text, self.at, self.byte = text, 0, 0
        self.begins = [0]
        k = text.find("\n")
        while k >= 0:
            self.begins.append(k + 1)
            k = text.find("\n", k + 1)
        self.ascii = text.isascii()

    def of(self, at: int) -> tuple[int, int, int]:
        line = bisect_right(self.begins, at)
        if self.ascii:
            return line, at - self.begins[line - 1] + 1, at
        if at < self.at:
            self.at = self.byte = 0
        self.byte += len(self.text[self.at : at].encode())
        self.at = at
        return line, at - self.begins[line - 1] + 1, self.byte


def unreadable(data: bytes) -> tuple[str, int | None, int | None, int | None] | None:
    """(reason, byte, line, column) of bytes that aren't text: a NUL makes them binary, else where UTF-8 breaks off."""
    if b"\0" in data:
        return "binary", None, None, None
    try:
        data.decode()
    except UnicodeDecodeError as e:
        good = data[: e.start].decode()
        return "not-utf8", e.start, good.count("\n") + 1, len(good) - (good.rfind("\n") + 1) + 1
    return None
