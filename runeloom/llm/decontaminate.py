"""Test items that leaked into training documents.

Words are runs of letters and digits, with A-Z lower-cased. A seed is an ordered pair of words of an item at most REACH
words apart, however far apart they are within that reach, so that it outlives words put in, left out or replaced beside it. A
first pass over all documents counts in how many each seed occurs. Of the seeds that begin in each stretch of STRETCH words of
an item the KEPT rarest are its rare seeds: rarity is a rank among the item's own seeds, so whether a copy is found doesn't
depend on how many documents there are. A second pass joins every whole document with the items over the rare seeds. Where
at least two of an item's lie within reach of one another (one, if it has no more), the item is aligned with the passage
around them (Smith-Waterman over words: 2 for a match, -1 for a mismatch or a gap). The passage is as wide as any alignment
through a seed can be that scores `least`: all gaps of an item of n words come to at most 2 * (1 - least) * n. A pair is reported if
the best local alignment reaches `least` of the score of a whole copy.

Items are taken in blocks of BLOCK bytes of text, each broadcast (some 10 times its text, for the first pass) and joined with all
documents, so any number of items is dealt with. An item of one word or none, or with null text, is never found; null and empty documents hold
nothing, and empty tables give no rows. Repeated items and documents are reported each, and so are those with a null id.
Other columns have no part. An alignment holds one row of its matrix at a time, so a long item with a long passage takes
time, but no more memory than they do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import ALNUM, Words, keep_slices, map_slices, mix, release, slices, small_batches

REACH, STRETCH, KEPT, BLOCK = 3, 8, 10, 4 << 20
#: Bytes of documents that are searched at once, and cells of alignment rows held at once.
SLICE, CELLS = 1 << 20, 1 << 20


def pairs_of(words: Words, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each word of a column with the one `reach` later, and whether both lie in one text."""
    n = len(words.hashes)
    made, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n > reach:
        made[: n - reach] = mix(words.hashes[: n - reach] * np.uint64(0xD6E8FEB86659FD93) + words.hashes[reach:])
        ok[: n - reach] = words.row[: n - reach] == words.row[reach:]
    return made, ok


class Items:
    """Test items with an index of their seeds."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        words = Words(pa.array(texts, pa.string()), ALNUM)
        self.ids = pa.array(ids, pa.int64())
        self.from_ = words.from_
        self.vocabulary, codes = np.unique(words.hashes, return_inverse=True)
        self.codes = codes.astype(np.int32)  # the items' words by number
        made, at = [], []
        for reach in range(1, REACH + 1):
            own, ok = pairs_of(words, reach)
            at.append(np.flatnonzero(ok))
            made.append(own[at[-1]])
        key, place = np.concatenate(made), np.concatenate(at)
        order = np.lexsort((place, key))
        self.place = place[order].astype(np.int32)  # of each seed, by fingerprint
        self.item = words.row[self.place].astype(np.int32)
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(order))
        self._index()

    def _index(self) -> None:
        self.quick = np.zeros(1 << 22, bool)
        self.quick[self.keys >> np.uint64(42)] = True

    def keep(self, often: np.ndarray) -> Items:
        """The same items with their rare seeds alone; often: in how many documents each seed occurs."""
        key = np.repeat(np.arange(len(self.keys)), np.diff(self.first))
        stretch = (self.place - self.from_[self.item]) // STRETCH
        order = np.lexsort((self.keys[key], often[key], stretch, self.item))
        item, part = self.item[order], stretch[order]
        head = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (part[1:] != part[:-1]))) if len(order) else order
        rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
        rare = np.sort(order[rank < KEPT])
        own = Items.__new__(Items)
        own.ids, own.from_, own.vocabulary, own.codes = self.ids, self.from_, self.vocabulary, self.codes
        own.place, own.item = self.place[rare], self.item[rare]
        own.keys, first = np.unique(self.keys[key[rare]], return_index=True)
        own.first = np.append(first, len(rare))
        own._index()
        own.seeds = np.bincount(own.item, minlength=len(self.from_) - 1)
        return own

    def codes_of(self, words: Words) -> np.ndarray:
        """The numbers of a column's words, -1 for those that no item has."""
        if not len(self.vocabulary):
            return np.full(len(words.hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words.hashes, at, -1).astype(np.int32)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words of the column at which a seed begins, and its number."""
        at, keys = [], []
        for reach in range(1, REACH + 1) if len(self.keys) else ():
            made, ok = pairs_of(words, reach)
            some = np.flatnonzero(self.quick[made >> np.uint64(42)] & ok)
            key = np.minimum(np.searchsorted(self.keys, made[some]), len(self.keys) - 1)
            good = self.keys[key] == made[some]
            at.append(some[good])
            keys.append(key[good])
        return (np.concatenate(at), np.concatenate(keys)) if at else (np.zeros(0, np.int64),) * 2


def _align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair of rows, and the column of b where it ends. Rows are padded with different values."""
    n, width = b.shape
    across = np.arange(width, dtype=np.int32)
    above = np.zeros((n, width), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        same = a[:, i : i + 1] == b
        now = np.zeros((n, width), np.int32)
        now[:, 1:] = above[:, :-1]
        now += np.where(same, 2, -1).astype(np.int32)
        np.maximum(now, above - 1, out=now)
        np.maximum(now, 0, out=now)
        above = np.maximum.accumulate(now + across, axis=1) - across  # gaps along b
        row = above.argmax(axis=1)
        top = above[np.arange(n), row]
        better = top > best
        best[better], end[better] = top[better], row[better]
    return best, end


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best local score of each pair of rows, by the diagonals of all matrices at once. Rows are padded with different values."""
    (rows, n), width = a.shape, b.shape[1]
    small = np.int16 if 2 * n < 2**15 else np.int32
    last = np.ascontiguousarray(a[:, ::-1].T)  # row k belongs to word n - 1 - k
    around = np.full((width + 2 * n - 2, rows), -3, np.int32)
    around[n - 1 : n - 1 + width] = b.T
    best, before, above = np.zeros((n, rows), small), np.zeros((n + 1, rows), small), np.zeros((n + 1, rows), small)
    now = np.zeros((n + 1, rows), small)  # its last row stands for no word and stays 0
    step, three, one = np.empty((n, rows), small), small(3), small(1)
    for d in range(n + width - 1):
        np.multiply(last == around[d : d + n], three, out=step, casting="unsafe")
        step += before[1:]  # 3 more than a mismatch for a match
        np.maximum(step, above[:n], out=step)
        np.maximum(step, above[1:], out=step)
        step -= one
        np.maximum(step, 0, out=now[:n])
        np.maximum(best, now[:n], out=best)
        before, above, now = above, now, before
    return best.max(axis=0).astype(np.int32)


def _padded(values: np.ndarray, begin: np.ndarray, size: np.ndarray, fill: int, reverse: bool = False) -> np.ndarray:
    at = np.arange(int(size.max(initial=1)))
    inside = at < size[:, None]
    place = begin[:, None] + (size[:, None] - 1 - at if reverse else at)
    return np.where(inside, values[np.where(inside, place, 0)], values.dtype.type(fill))


def passages(items: Items, words: Words, least: float) -> tuple[np.ndarray, ...]:
    """(row, item, left, right): the words of each text among which an item may be found, the right end exclusive."""
    at, key = items.hits(words)
    repeat = items.first[key + 1] - items.first[key]
    which = np.repeat(items.first[key], repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    at, item = np.repeat(at, repeat), items.item[which]
    size = items.from_[item + 1] - items.from_[item]
    before = items.place[which] - items.from_[item]  # words of the item before the seed
    row = words.row[at]
    slack = np.floor(2 * (1 - least) * size).astype(np.int64)
    order = np.lexsort((at, item, row))
    at, item, row, size, before, slack = (x[order] for x in (at, item, row, size, before, slack))
    same = (row[1:] == row[:-1]) & (item[1:] == item[:-1]) if len(at) else np.zeros(0, bool)
    # hits of one alignment are at most the item and its gaps apart
    head = np.flatnonzero(np.append(True, ~same | (at[1:] - at[:-1] > size[1:] + slack[1:]))) if len(at) else at
    count = np.diff(np.append(head, len(at)))
    left = np.minimum.reduceat(at - before - slack, head) if len(at) else at
    right = np.maximum.reduceat(at + size - before + slack, head) if len(at) else at
    keep = count >= np.minimum(2, items.seeds[item[head]])
    head, left, right = head[keep], left[keep], right[keep]
    row, item = row[head], item[head]
    return row, item, np.maximum(left, words.from_[row]), np.minimum(right, words.from_[row + 1])


def find(items: Items, column: pa.Array, least: float, spans: bool = True) -> dict:
    """Leaks in a slice of documents: row, item, score, and, if asked for, the passage in code points. items: with rare seeds alone."""
    words = Words(column, ALNUM)
    row, item, left, right = passages(items, words, least)
    size = items.from_[item + 1] - items.from_[item]
    none = {"row": np.zeros(0, np.int64), "item": np.zeros(0, np.int64), "score": np.zeros(0), "start": np.zeros(0, np.int64), "end": np.zeros(0, np.int64)}
    out = []
    codes = items.codes_of(words) if len(row) else words.hashes
    order = np.lexsort((size, right - left))  # of like widths, so that little is padding
    at = len(order)
    while at:  # widest first
        part = order[max(0, at - max(1, CELLS // int((right - left)[order[at - 1]]))) : at]
        at -= len(part)
        a = _padded(items.codes, items.from_[item[part]], size[part], -2)
        share = _scores(a, _padded(codes, left[part], right[part] - left[part], -3)) / (2.0 * size[part])
        good = np.flatnonzero(share >= least)
        if not len(good):
            continue
        part, share = part[good], share[good]
        if not spans:
            out.append((row[part], item[part], share, part, part))
            continue
        # the passage ends where the best alignment does; aligned backwards from there, it ends at its first word
        _, end = _align(a[good], _padded(codes, left[part], right[part] - left[part], -3))
        a = _padded(items.codes, items.from_[item[part]], size[part], -2, True)
        _, back = _align(a, _padded(codes, left[part], end + 1, -3, True))
        out.append((row[part], item[part], share, words.starts[left[part] + end - back], words.ends[left[part] + end]))
    if not out:
        return none
    row, item, share, start, end = (np.concatenate(x) for x in zip(*out))
    if spans:
        points = np.append(0, np.cumsum((words.data & 0xC0) != 0x80))
        base = points[words.bounds[row]]
        start, end = points[start] - base, points[end] - base
    return {"row": row, "item": item, "score": share, "start": start, "end": end}


def blocks(items: DataFrame, limit: int) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator():
        ids.append(r.id)
        texts.append(r.text)
        size += len(r.text)
        if size >= limit:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def _rare(docs: DataFrame, items: DataFrame, block: int) -> Iterator[Items]:
    """The items in blocks, with their rare seeds: those that the fewest of all documents hold."""
    for own in blocks(items, block):
        sent = docs.sparkSession.sparkContext.broadcast(own)

        def count(batches, sent=sent):
            total = np.zeros(len(sent.value.keys), np.int64)
            width = np.int64(len(total) + 1)
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    words = Words(part.column(0), ALNUM)
                    at, key = sent.value.hits(words)
                    total += np.bincount(np.unique(words.row[at] * width + key) % width, minlength=len(total))
            release()
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["seed", "n"])

        counts = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()  # a row for each seed of the block at most
        often = np.zeros(len(own.keys), np.int64)
        often[counts["seed"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
        yield own.keep(often)


def _tables(docs: DataFrame, benchmark: DataFrame, id: str, text: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    small_batches(docs)
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), items


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, item_id, score, start, end): the best passage of each document for each item that it holds."""
    docs, items = _tables(docs, benchmark, id, text, item_id, item_text)
    spark = docs.sparkSession
    found = []
    for own in _rare(docs, items, block):
        sent = spark.sparkContext.broadcast(own)

        def make(sent=sent):
            def step(part: pa.RecordBatch) -> dict:
                got = find(sent.value, part.column(1), least)
                return {"id": part.column(0).take(pa.array(got["row"])), "item_id": sent.value.ids.take(pa.array(got["item"])), **{k: got[k] for k in ("score", "start", "end")}}

            return step

        found.append(map_slices(docs, make, "id long, item_id long, score double, start long, end long", limit=SLICE))
    if not found:
        found = [spark.createDataFrame([], "id long, item_id long, score double, start long, end long")]
    best = reduce(DataFrame.union, found).groupBy("id", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("start"), "end")).alias("best"))
    return best.select(F.col("id").alias(id), F.col("item_id").alias("item_id"), F.col("best.score").alias("score"), (-F.col("best.start")).alias("start"), F.col("best.end").alias("end"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents, with all their columns, that hold no item. Each row is decided by its own text, whatever its id, and stays where it is."""
    searched, items = _tables(docs, benchmark, id, text, item_id, item_text)
    for own in _rare(searched, items, block):
        sent = docs.sparkSession.sparkContext.broadcast(own)

        def make(sent=sent):
            def step(column: pa.Array) -> np.ndarray:
                keep = np.ones(len(column), bool)
                keep[find(sent.value, column, least, False)["row"]] = False
                return keep

            return step

        docs = keep_slices(docs, make, text, limit=SLICE)
    return docs
