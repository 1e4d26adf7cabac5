"""Arrow columns as numpy arrays, and the word fingerprints that several operators share.

Texts never become Python objects here: words are fingerprinted from the column's UTF-8 bytes, so a slice of a few
megabytes costs a handful of array operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.spread import spread

#: Bytes of text that a step sees at once; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20

WHITE = bytes([0x20, *range(0x09, 0x0E)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets, from 0; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or not column.buffers()[2]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold at most `limit` bytes of text, or one row."""
    _, bounds = utf8(batch.column(text))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def small_batches(df: DataFrame) -> None:
    """Has the session send Python at most 8 MB of a task's rows at once, where it would send more. No result depends on it."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int((conf.get(key, None) or "0").rstrip("bB") or 0) not in range(1, (8 << 20) + 1):
        conf.set(key, str(8 << 20))


_HELD: list[tuple[Any, Any]] = []


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, kept by this worker until something else is asked for: one worker serves all operators in turn."""
    if not _HELD or _HELD[0][0] != key:
        _HELD.clear()
        _HELD.append((key, make()))
    return _HELD[0][1]


def release() -> None:
    """Gives memory that a task no longer needs back to the system, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_slices(df: DataFrame, make: Callable[[], Callable], schema: str, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """`make()` runs once in a task; what it returns maps each slice to a dict of columns."""
    small_batches(df)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, text, limit):
                got = step(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)
        release()

    return spread(df).mapInArrow(run, schema)


def keep_slices(df: DataFrame, make: Callable[[], Callable], text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """The rows, with all their columns, of which what `make()` returns, given their texts, holds True."""
    if text not in df.columns:
        raise ValueError(f"no column {text}")
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, text, limit):
                yield part.filter(pa.array(step(part.column(text))))
        release()

    return spread(df).mapInArrow(run, df.schema)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _mix
#: Two primes and a base for each: a word's fingerprint is its bytes' polynomial modulo both, which no known pairs of words defeat.
_FIELDS = ((2**31 - 1, 1_203_418_267), (2**31 - 19, 748_291_603))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers, or more, of each field's base."""
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for prime, base in _FIELDS:
            own = np.ones(1, np.uint64)
            while len(own) < max(n, 1 << 12):
                own = np.concatenate([own, own * np.uint64(pow(base, len(own), prime)) % np.uint64(prime)])
            made.append(own)
        if n > 1 << 20:  # for one very long word; not kept
            return made
        _POWERS[:] = made
    return _POWERS


#: A byte's value with A-Z lower-cased; none is 0.
LOWER = np.array([(b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], np.uint64)
SPACED = np.array([b not in WHITE for b in range(256)])
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


class Words:
    """The words of a column: maximal runs of bytes that `member` holds, ended by the end of a text.

    starts, ends: byte positions in the column's data; row: the text of each; hashes: 64-bit fingerprints
    of the words with A-Z lower-cased.
    """

    def __init__(self, column: pa.Array, member: np.ndarray = SPACED):
        data, self.bounds = utf8(column)
        self.data = data
        inside = member[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        filled = np.flatnonzero(np.diff(self.bounds))
        heads, tails = self.bounds[filled], self.bounds[filled + 1] - 1
        first[heads] = inside[heads]
        last[tails] = inside[tails]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hashes = self._fingerprints(LOWER[data[inside]], self.ends - self.starts)
        #: Word k of text i lies at from_[i] <= k < from_[i + 1].
        self.from_ = np.searchsorted(self.starts, self.bounds)
        self.row = np.repeat(np.arange(len(column)), np.diff(self.from_))

    @staticmethod
    def _fingerprints(values: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A fingerprint of each word, from the values of all words' bytes in a row."""
        if not len(size):
            return np.zeros(0, np.uint64)
        begin = np.cumsum(size) - size
        place = np.arange(len(values)) - np.repeat(begin, size)
        longest = int(size.max())
        out = size.astype(np.uint64)
        for (prime, _), powers in zip(_FIELDS, _powers(longest)):
            part = values * powers[place]
            if longest >= 1 << 24:  # below it a sum stays under 2 ** 64
                part %= np.uint64(prime)
            out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + np.add.reduceat(part, begin) % np.uint64(prime))
        return out

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all runs of n words, and the text of each; a text of fewer words is one run."""
        count = np.diff(self.from_)
        runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        row = np.repeat(np.arange(len(count)), runs)
        at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + self.from_[row]
        made = np.full(len(row), n, np.uint64)
        upto = self.from_[row + 1]
        padded = np.append(self.hashes, np.uint64(0))
        for k in range(n):
            here = np.minimum(at + k, len(self.hashes))
            made = np.where(at + k < upto, _mix(made * np.uint64(0xD6E8FEB86659FD93) + padded[here]), made)
        return made, row


def distinct(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values once and in order, and rows + 1 bounds. row must not fall."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(rows + 1))


def fold(values: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """One order-free 64-bit fingerprint of each text's set; an empty set gives 0."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(_mix(values + np.uint64(seed)), out=sums[1:])
    return _mix(sums[bounds[1:]] - sums[bounds[:-1]])
