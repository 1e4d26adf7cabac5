"""Findings and rewrites of many texts at once, in arrays.

Under a law whose lints look at single characters, a text without characters that act with their neighbours (`native.Translation`) is judged
and rewritten a character at a time. Then all that is to be known of a place is its character: characters beyond plain ASCII are found in the
bytes of a slice of texts, their lines, columns and bytes are counted there, and rows are taken from a table of the law's characters.
Other texts, and all texts of other laws, are left to the walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions import chars
from ..plans.config import LEVELS, LINTS, Law
from . import native

#: Lints that look at more than one character.
_WIDER = ("crlf", "trailing-whitespace", "final-newline", "not-nfc", "mixed-script")
_WIDTH = np.array([0 if 0x80 <= b < 0xC0 else 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], np.int8)
_LOOKED_AT = np.array([b >= 0xC0 or b == 0x7F or (b < 0x20 and b not in (9, 10)) for b in range(256)])
ROWS = 50_000
#: What trying a rewrite counts, over any number of texts; `bad`: leftovers that are denied or forbidden.
DRIFT = ("files", "drifted", "rewrites", "leftovers", "bad", "failed")
BAD = LEVELS.index("deny")


class Plain:
    """A law's characters, each looked at once: what is found there and what is written."""

    def __init__(self, bench, law: Law):
        self.judge, made = bench.judge(law), native.Translation(bench, law)
        self.to, self.hard = made.to, made.hard_points
        found = self.judge.findings
        self.fits = not any(self.judge.levels[x] for x in _WIDER) and not any("\n" in c + to or any(map(found, to)) for c, to in self.to.items())
        self.number = np.full(0x100, -1, np.int32)
        self.rows: list[tuple] = []

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """The rows of characters in the law's table, which new ones are added to."""
        top = int(points.max(initial=0))
        if top >= len(self.number):
            self.number = np.concatenate([self.number, np.full(top + 1 - len(self.number), -1, np.int32)])
        got = self.number[points]
        new = np.unique(points[got < 0])
        if len(new):
            for p in new.tolist():
                self.number[p] = len(self.rows)
                self.rows.append(self._row(p))
            got = self.number[points]
            self._table()
        return got

    def _row(self, p: int) -> tuple:
        c, hard = chr(p), p in self.hard
        to = None if hard else self.to.get(c)
        lint, level = next(((x, n) for _, x, n, _ in ([] if hard else self.judge.findings(c))), (None, 0))
        return c, chars.spelled(p), lint, level, to, hard

    def _table(self) -> None:
        c, spelled, lint, level, to, hard = zip(*self.rows)
        self.found = np.array([x is not None for x in lint])
        self.written = np.array([x is not None for x in to])
        self.alone = ~np.array(hard)
        self.bad = np.array(level) >= BAD
        self.longer = np.array([len(t) - 1 if t is not None else 0 for t in to], np.int64)
        self.heavier = np.array([len(t.encode()) - len(x.encode()) if t is not None else 0 for x, t in zip(c, to)], np.int64)
        lint = [x or "outside-set" for x in lint]  # of what is rewritten without being a finding
        text = lambda x: pa.array(x, pa.string())
        self.columns = {"codepoint": text(spelled), "character": text(c), "set": text(["hazard" if LINTS[x] == "hazard" else self.judge.name for x in lint]), "lint": text(lint),
                        "level": text([LEVELS[x] for x in level]), "to": text(to), "fixable": pa.array(self.written)}


class Places:
    """Characters beyond plain ASCII in a slice of texts: code points, the texts that hold them, and where in these they stand."""

    def __init__(self, texts: pa.Array):
        _, offsets, data = texts.buffers()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        self.begins = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        first, last = self.begins[[0, -1]]
        bytes_ = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.empty(0, np.uint8)
        self.begins -= first
        self.at = np.flatnonzero(_LOOKED_AT[bytes_])
        lead = bytes_[self.at]
        width = _WIDTH[lead]
        self.more = width.astype(np.int64) - 1
        self.valid = int(self.more.sum()) == int(np.count_nonzero((bytes_ & 0xC0) == 0x80))
        self.points = lead.astype(np.int32)
        for w in (2, 3, 4):
            some = np.flatnonzero(width == w)
            at = self.at[some]
            points = self.points[some] & (0xFF >> (w + 1))
            for k in range(1, w):
                points = points << 6 | bytes_[np.minimum(at + k, len(bytes_) - 1)] & 0x3F
            self.points[some] = points
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.at, self.begins)))
        begin = self.begins[self.text]
        ends = np.flatnonzero(bytes_ == 10)
        ended = np.searchsorted(ends, self.at)
        self.line = ended - np.searchsorted(ends, begin) + 1
        self.line_begin = np.maximum(begin, np.concatenate([[-1], ends])[ended] + 1)
        self.column = self.at - self.line_begin - self.since(self.more, self.line_begin) + 1
        self.byte = self.at - begin

    def since(self, weights: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The sum of the weights of characters that stand from `begin` on, before each."""
        before = np.concatenate([[0], np.cumsum(weights)])
        return before[:-1] - before[np.searchsorted(self.at, begin)]


def taken(own, paths: pa.Array, texts: pa.Array, kind: str, schema: pa.Schema) -> tuple[Iterator[pa.RecordBatch], np.ndarray]:
    """(batches, the numbers of the texts that are to be walked). kind: findings, remedies, rewrites, leftovers, origins, which are
    leftovers at their places in the original, or drift, a row of counts for all texts that aren't walked."""
    there = np.asarray(texts.is_valid())
    places = Places(texts)
    if not places.valid:
        return (_drift(places, [], there, schema) if kind == "drift" else iter(())), np.flatnonzero(there)
    laws = [own.law(p or "") if t else None for p, t in zip(paths.to_pylist(), there)]
    kinds = {law: k for k, law in enumerate(dict.fromkeys(x for x in laws if x is not None))}
    which = np.array([-1 if x is None else kinds[x] for x in laws], np.int32)
    walk = np.zeros(len(texts), bool)
    made = []
    for law, k in kinds.items():
        table = own.plain(law)
        if not table.fits:
            walk |= which == k
            continue
        mine = np.flatnonzero(which[places.text] == k)
        if not len(mine):
            continue
        number = table.numbers(places.points[mine])
        walk[places.text[mine[~table.alone[number]]]] = True
        made.append((table, mine, number))
    return (_drift(places, made, walk, schema) if kind == "drift" else _batches(paths, places, made, walk, kind, schema)), np.flatnonzero(walk)


def _drift(places: Places, made: list, walk: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    drifted = np.zeros(len(walk), bool)
    counts = dict.fromkeys(DRIFT, 0)
    for table, mine, number in made:
        text = places.text[mine]
        number, text = number[~walk[text]], text[~walk[text]]
        written, left = table.written[number], table.found[number] & ~table.written[number]
        drifted[text[written]] = True
        for name, x in (("rewrites", written), ("leftovers", left), ("bad", left & table.bad[number])):
            counts[name] += int(np.count_nonzero(x))
    counts |= {"files": int(np.count_nonzero(~walk)), "drifted": int(np.count_nonzero(drifted))}
    yield pa.RecordBatch.from_arrays([pa.array([counts[f.name]], f.type) for f in schema], schema=schema)


def _batches(paths: pa.Array, places: Places, made: list, walk: np.ndarray, kind: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    line, column, byte = places.line, places.column, places.byte
    if kind == "leftovers":  # places in the texts as rewritten
        longer, heavier = np.zeros((2, len(places.at)), np.int64)
        for table, mine, number in made:
            longer[mine], heavier[mine] = table.longer[number], table.heavier[number]
        column, byte = column + places.since(longer, places.line_begin), byte + places.since(heavier, places.begins[places.text])
    paths = paths.fill_null("")
    for table, mine, number in made:
        told = table.written[number] if kind == "rewrites" else table.found[number]
        if kind in ("leftovers", "origins"):
            told = told & ~table.written[number]
        told &= ~walk[places.text[mine]]
        mine, number = mine[told], number[told]
        for k in range(0, len(mine), ROWS):
            at, row = mine[k : k + ROWS], pa.array(number[k : k + ROWS])
            of = {name: x.take(row) for name, x in table.columns.items()}
            of |= {"path": paths.take(pa.array(places.text[at])), "line": line[at], "column": column[at], "byte": byte[at]}
            of["replacement"] = of["to"] if kind in ("remedies", "rewrites") else pa.nulls(len(at), pa.string())
            if kind not in ("remedies", "rewrites"):
                of["fixable"] = pa.array(np.zeros(len(at), bool))
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in (of[f.name],)], schema=schema)
