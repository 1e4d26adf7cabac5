"""License notices inside documents, by patience alignment with templates.

A run of three words that a template holds too says where a copy of the template would begin. Places are tried in the order
of how many runs speak for them, and each copy is aligned alone, between the copies found before, in a region as
long as the template, or longer by a quarter or a half at each end if more is aligned then; a place within an eighth of
the template's length of one that was tried isn't tried. A stretch of runs with one copy
at most is also aligned as a whole. The region and the template are aligned: words that occur once in both are anchors, the longest
run of anchors in order is kept, and the gaps between them are aligned the same way (equal words at a gap's ends are
taken first). Coverage is the share of the template's words that are aligned.

Templates are a parameter: (license, text) rows, at most TEMPLATES bytes in all, which is checked before they are
broadcast. A template needs three words. Null and empty texts hold nothing; repeated rows are scanned each, an empty table gives no
rows, and other columns have no part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import ALNUM, Words, map_slices, mix

TEMPLATES, SEED = 16 << 20, 3
#: Notices of one line as they stand in files.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
]


def texts() -> list[tuple[str, str]]:
    """Whole license texts and the standard headers of files, from the folder beside this module."""
    return [(p.name.removesuffix(".txt").removesuffix(".header"), p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]


def seeds_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the run of SEED words at each word of a column, and which of them lie in one text."""
    n = len(words.hashes)
    made = np.zeros(n, np.uint64)
    ok = np.zeros(n, bool)
    if n >= SEED:
        run = words.hashes[: n - SEED + 1]
        for k in range(1, SEED):
            run = mix(run * np.uint64(0xD6E8FEB86659FD93) + words.hashes[k : n - SEED + 1 + k])
        made[: len(run)] = run
        ok[: len(run)] = words.row[: len(run)] == words.row[SEED - 1 :]
    return made, ok


class Templates:
    """Templates with an index of their runs of SEED words."""

    def __init__(self, texts: list[str]):
        words = Words(pa.array(texts, pa.string()), ALNUM)
        self.hashes, self.from_ = words.hashes, words.from_
        made, ok = seeds_of(words)
        at = np.flatnonzero(ok)
        order = np.argsort(made[at], kind="stable")
        self.place = at[order]  # the word at which each seed begins, by fingerprint
        self.item = words.row[self.place]
        self.keys, first = np.unique(made[self.place], return_index=True)
        self.first = np.append(first, len(self.place))
        self.quick = np.zeros(1 << 20, bool)
        self.quick[self.keys >> np.uint64(44)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words of the column at which a seed begins, and its number."""
        made, ok = seeds_of(words)
        at = np.flatnonzero(self.quick[made >> np.uint64(44)] & ok)
        if not len(self.keys):
            return at[:0], at[:0]
        key = np.minimum(np.searchsorted(self.keys, made[at]), len(self.keys) - 1)
        good = self.keys[key] == made[at]
        return at[good], key[good]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of equal words of a and b, in order, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once_a, once_b = {}, {}
        for n in range(i, j):
            once_a[a[n]] = -1 if a[n] in once_a else n
        for n in range(k, m):
            once_b[b[n]] = -1 if b[n] in once_b else n
        anchors = [(n, to) for x, n in once_a.items() if n >= 0 and (to := once_b.get(x, -1)) >= 0]
        # longest increasing subsequence of the places in b
        tails, ends, back = [], [], []
        for at, (_, to) in enumerate(anchors):
            p = bisect_left(tails, to)
            tails[p:p + 1], ends[p:p + 1] = [to], [at]
            back.append(ends[p - 1] if p else -1)
        chain, at = [], ends[-1] if ends else -1
        while at >= 0:
            chain.append(anchors[at])
            at = back[at]
        before = (i - 1, k - 1)
        for n, to in [*chain[::-1], (j, m)]:
            if n < j:
                out.append((n, to))
            if chain:
                todo.append((before[0] + 1, n, before[1] + 1, to))
            before = (n, to)
    return sorted(out)


def copies(body: np.ndarray, hashes: np.ndarray, place: np.ndarray, shift: np.ndarray, low: int, high: int, least: float) -> list[list[tuple[int, int]]]:
    """The copies of a template among the words low to high of a text, each as pairs of (template word, text word).

    place, in order, and shift have the word and the word less its place in the template of each seed hit."""
    size, words = len(body), body.tolist()
    upto = np.append(0, np.cumsum(np.isin(hashes[low:high], body)))

    def fits(a: int, b: int) -> list[tuple[int, int]]:
        if b <= a or upto[b - low] - upto[a - low] < least * size:  # an upper bound of what can be aligned
            return []
        pairs = aligned(words, hashes[a:b].tolist())
        return [(i, a + k) for i, k in pairs] if len(pairs) >= least * size else []

    found: list[list[tuple[int, int]]] = []
    starts: list[int] = []
    live = np.ones(len(place), bool)
    order = np.argsort(shift, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(shift[order]) > 0))
    tails = np.append(heads[1:], len(order))
    tried: list[int] = []
    for n in np.argsort(heads - tails, kind="stable").tolist():
        alive = order[heads[n] : tails[n]]
        alive = alive[live[alive]]
        if not len(alive):
            continue
        at = int(shift[alive[0]])
        k = bisect_left(tried, at - size // 8)
        if k < len(tried) and tried[k] <= at + size // 8:  # its regions lie within those tried there
            continue
        insort(tried, at)
        k = bisect_left(starts, int(place[alive[0]]))
        left, right = found[k - 1][-1][1] + 1 if k else low, starts[k] if k < len(starts) else high
        best: list[tuple[int, int]] = []
        for more in dict.fromkeys((0, size // 4, size // 2)):
            pairs = fits(max(left, at - more), min(right, at + size + more))
            if len(pairs) > len(best):
                best = pairs
        if best:
            found.insert(k, best)
            starts.insert(k, best[0][1])
            live[np.searchsorted(place, best[0][1]) : np.searchsorted(place, best[-1][1] + 1)] = False
    # a stretch that holds one copy at most is aligned as a whole too, as its words may stand far apart
    first = int(place[0])
    for n, here in enumerate(place.tolist()):
        if n + 1 == len(place) or place[n + 1] - first > size + size // 2:
            a, b = max(low, first - size // 2), min(high, here + size)
            met = _overlapping(found, a, b)
            if len(met) <= 1 and (not met or len(found[met[0]]) < size) and (pairs := fits(a, b)):
                met = _overlapping(found, pairs[0][1], pairs[-1][1] + 1)
                if len(met) <= 1 and all(len(found[k]) < len(pairs) for k in met):
                    k = met[0] if met else sum(x[0][1] < pairs[0][1] for x in found)
                    found[k : k + len(met)] = [pairs]
            if n + 1 < len(place):
                first = int(place[n + 1])
    return found


def _overlapping(found: list[list[tuple[int, int]]], a: int, b: int) -> list[int]:
    """Numbers of the passages, which lie in order, that share a word with a to b, two at most."""
    k = bisect_left(found, a, key=lambda x: x[-1][1])
    return [n for n in (k, k + 1) if n < len(found) and found[n][0][1] < b]


def passages(templates: Templates, words: Words, least: float) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(row, template, pairs) of every copy of a template."""
    at, key = templates.hits(words)
    repeat = templates.first[key + 1] - templates.first[key]
    which = np.repeat(templates.first[key], repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    at = np.repeat(at, repeat)
    t, row = templates.item[which], words.row[at]
    size = templates.from_[t + 1] - templates.from_[t]
    fit = np.flatnonzero(words.from_[row + 1] - words.from_[row] >= least * size)
    fit = fit[np.lexsort((at[fit], t[fit], row[fit]))]
    at, t, row, shift = at[fit], t[fit], row[fit], (at - (templates.place[which] - templates.from_[t]))[fit]
    bounds = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(t) != 0))) if len(at) else at
    for i, j in zip(bounds.tolist(), [*bounds[1:].tolist(), len(at)]):
        r, k = int(row[i]), int(t[i])
        body = templates.hashes[templates.from_[k] : templates.from_[k + 1]]
        for pairs in copies(body, words.hashes, at[i:j], shift[i:j], int(words.from_[r]), int(words.from_[r + 1]), least):
            yield r, k, pairs


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, licenses array of (license, coverage, start, end)), a row for every input row: the passages, in code
    points, that cover at least `least` of a template; of overlapping ones the one with more aligned words, less the
    template's words that aren't aligned. The templates are NOTICES and texts() unless others are given."""
    templates = NOTICES + texts() if templates is None else templates
    if sum(len(x.encode()) for _, x in templates) > TEMPLATES:
        raise ValueError(f"the templates have more than {TEMPLATES} bytes")
    names = [x for x, _ in templates]
    sent = docs.sparkSession.sparkContext.broadcast(Templates([x for _, x in templates]))

    def make():
        own = sent.value

        def step(part: pa.RecordBatch) -> dict:
            words = Words(part.column(1), ALNUM)
            points = None
            out: list[list] = [[] for _ in range(len(part))]
            for row, t, pairs in passages(own, words, least):
                if points is None:
                    points = np.append(0, np.cumsum((words.data & 0xC0) != 0x80))
                base = points[words.bounds[row]]
                size = int(own.from_[t + 1] - own.from_[t])
                out[row].append((size - 2 * len(pairs), -len(pairs) / size, int(points[words.starts[pairs[0][1]]] - base), int(points[words.ends[pairs[-1][1]] - 1] + 1 - base), names[t]))
            for row, found in enumerate(out):
                if found:
                    kept: list = []
                    for x in sorted(found):
                        k = bisect_left(kept, x[2], key=lambda y: y[2])
                        if (not k or kept[k - 1][3] <= x[2]) and (k == len(kept) or kept[k][2] >= x[3]):
                            kept.insert(k, x)
                    out[row] = [{"license": x[4], "coverage": -x[1], "start": x[2], "end": x[3]} for x in kept]
            return {"id": part.column(0), "licenses": out}

        return step

    return map_slices(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), make, "id long, licenses array<struct<license: string, coverage: double, start: long, end: long>>").withColumnRenamed("id", id)
