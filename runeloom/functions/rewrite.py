"""Rewriting one text under a law and a map until nothing changes."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

from ..plans.maps import Map
from .judge import _CLASS, Judge, double_encoded


class MapCycle(ValueError):
    pass


class NotIdempotent(ValueError):
    pass


class Touched(ValueError):
    pass


def untouched(text: str, output: str, spans: list[list]) -> None:
    """Raises unless the output is the text with the spans replaced and everything between them as it was."""
    built, at = [], 0
    for begin, end, to, _ in spans:
        built += [text[at:begin], to]
        at = end
    if "".join(built) + text[at:] != output:
        raise Touched("a rewrite changed what it doesn't report")


@dataclass
class Fixed:
    """rewrites: (place in the original, character there, what is written); unmapped: (place in the output, character)."""

    output: str
    rewrites: list[tuple[int, str, str]] = field(default_factory=list)
    unmapped: list[tuple[int, str]] = field(default_factory=list)
    #: For each pass: starts of stretches of its output, where they come from, and whether they were written (1) or copied (-1).
    passes: list[tuple[list[int], list[int], list[int]]] = field(default_factory=list)

    def origin(self, place: int) -> int:
        """The place in the original of a place in the output: as of the last stretch that begins at or before it."""
        for starts, origins, kinds in reversed(self.passes):
            i = bisect_right(starts, place) - 1
            place = origins[i] + (place - starts[i] if kinds[i] < 0 else 0)
        return place


def _joins(c: str) -> bool:
    return c.isalnum() or c == "_"


class Rewriter:
    """A map's candidates made ready for a judge's set."""

    PASSES = 3

    def __init__(self, map_: Map, judge: Judge):
        self.map, self.judge, self.index = map_, judge, map_.index()
        granted = "tags" in judge.law.hazards
        self.allowed = lru_cache(4096)(lambda c: judge.inside(c) or (granted and _CLASS.get(c) == "tag-character"))
        self.granted = granted

    def _resolve(self, text: str, at: int, barred: str | None) -> tuple[int, str, bool] | None:
        ok = self.allowed if barred is None else (lambda c: c != barred and self.allowed(c))
        for source, to, word, name in self.index.get(text[at], ()):
            if text.startswith(source, at) and not all(map(ok, source)):
                if name is not None:
                    to = self.map.target(name, ok, self.map.fidelity)
                if to is not None:
                    return len(source), to, word
        return None

    def _expand(self, to: str, within: tuple[str, ...]) -> str:
        """The replacement rewritten to its own fixed point. There are finitely many, so one without a fixed point comes within itself."""
        if to.isascii() and all(map(self.allowed, to)):
            return to
        if to in within:
            raise MapCycle("a map entry leads back to itself")
        return self._walk(to, {}, set(), {}, (*within, to))[0]

    def _walk(self, text: str, hazards: dict[int, bool], kept: set[int], restores: dict[int, tuple[int, str]], within: tuple[str, ...] = ()):
        """(output, spans (from, to, written), unmapped places of the output)."""
        out: list[str] = []
        last, length = "", 0  # last character written; length of the output
        spans: list[list] = []
        unmapped: list[tuple[int, str]] = []
        gap = pair = False
        at = 0

        def emit(piece: str) -> None:
            nonlocal gap, last, length
            if gap and piece and _joins(piece[0]):
                spans[-1][2] += " "
                out.append(" ")
                length += 1
            gap = gap and not piece
            if piece:
                out.append(piece)
                last, length = piece[-1], length + len(piece)

        while at < len(text):
            c = text[at]
            flag = "\U0001f1e6" <= c <= "\U0001f1ff"
            found = None
            if not (pair and flag):
                if at in restores:
                    n, said = restores[at]
                    found = (n, said, False)
                elif not c.isascii() or at in hazards or c in self.index:
                    found = self._resolve(text, at, c if at in hazards else None)
                    if found is not None:
                        n, to, word = found
                        if not n or any(k in kept for k in range(at, at + n)):
                            found = None
                        else:
                            to = self._expand(to, within)
                            found = (n, to, word) if all(map(self.allowed, to)) else None
                    if found is None and hazards.get(at):
                        found = (1, "", False)
            pair = not pair if found is None and flag else False
            if found is None:
                emit(c)
                if not self.allowed(c) and at not in kept:
                    unmapped.append((length - 1, c))
                at += 1
                continue
            n, to, word = found
            if word and last and _joins(last) and to and _joins(to[0]):
                to = " " + to
            emit(to)
            if word:
                gap = bool(to) and _joins(to[-1])
            spans.append([at, at + n, to, length - len(to)])
            at += n
        return "".join(out), spans, unmapped

    def _pass(self, text: str):
        judge = self.judge
        exempt = kept = set()
        hazards: dict[int, bool] = {}
        if not text.isascii() or judge.suspect.search(text):
            exempt, kept = judge.exempt(text), judge.selectors(text)
            for m in judge.suspect.finditer(text):
                at = m.start()
                if at not in kept and (name := judge.hazard_at(text, at, exempt)) and not (self.granted and name == "tag-character"):
                    hazards[at] = name != "control-character"
        restores = {at: (n, said) for at, n, said in double_encoded(text)}
        return self._walk(text, hazards, kept, restores)

    def fix(self, text: str) -> Fixed:
        if text.isascii() and not self.judge.suspect.search(text):
            return Fixed(text)
        done = Fixed(text)
        for k in range(self.PASSES + 2):
            output, spans, done.unmapped = self._pass(done.output)
            untouched(done.output, output, spans)
            if output == done.output:
                done.rewrites = [(at, c, to) for at, (c, to) in sorted({at: (c, to) for at, c, to in done.rewrites}.items())]
                return done
            if k > self.PASSES:
                break
            done.rewrites += [(at := done.origin(begin), text[at : at + 1], to) for begin, _, to, _ in spans]
            starts, origins, kinds = [0], [0], [-1]
            for begin, end, to, where in spans:
                starts += [where, where + len(to)]
                origins += [begin, end]
                kinds += [1, -1]
            done.passes.append((starts, origins, kinds))
            done.output = output
        raise NotIdempotent("the rewrite doesn't settle")
