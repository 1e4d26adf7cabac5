"""Byte-level BPE encoding and decoding with numpy.

Texts are cut by the tokenizer's pattern. Pieces not seen lately are merged together: grouped by length
into padded matrices, every row merges its leftmost pair of least rank in each round, and finished rows
leave the matrix. A pair's merged token is found in an open-addressing table of 64-bit keys.

encode: null text counts as empty and gives no tokens; decode: null or empty ids give no bytes, a null or
unknown id raises. Repeated rows are encoded each, an empty table gives no rows; other columns of the input have no part and are
not carried. A piece of more than WIDEST bytes, such as a long run of letters, is merged by a heap over a linked list, in the same order of merges
and so with the same tokens, as a matrix of its width would cost the square of its length.
"""

from __future__ import annotations

import base64
import heapq
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import held, map_slices, release

#: Pieces whose tokens a worker remembers; beyond it all are forgotten.
CACHED = 120_000
#: Longer pieces are merged with a heap, so that one long run of letters costs n log n.
WIDEST = 128
_NONE = np.int32(2**31 - 1)


class Merges:
    """The merge table of a rank file: a pair merges where its bytes joined are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.fromiter(self.pairs.keys(), np.uint64, len(self.pairs))
        self.bits = max(10, int(len(keys) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.merged = np.full(1 << self.bits, _NONE, np.int32)
        at, left, values = self._slot(keys), np.arange(len(keys)), np.fromiter(self.pairs.values(), np.int32, len(keys))
        while len(left):  # of keys for one free slot the first takes it; the others move on
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            slots, first = np.unique(at[left[free]], return_index=True)
            took = left[free][first]
            self.keys[slots], self.merged[slots] = keys[took], values[took]
            left = np.setdiff1d(left, took, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token, which is also the rank, of each pair; _NONE where it doesn't merge. Ids below 0 never merge."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(keys)
        got = self.merged[at].copy()
        wrong = np.flatnonzero((self.keys[at] != keys) & (got != _NONE))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            got[wrong] = self.merged[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != keys[wrong]) & (got[wrong] != _NONE)]
        got[(self.keys[at] != keys) | (left < 0) | (right < 0)] = _NONE
        return got

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all pieces in one array, with the start and the number of each piece's."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start, count, chunks, filled = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [np.zeros(0, np.int32)], 0

        def emit(place: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            nonlocal filled
            count[place] = n
            start[place] = filled + np.cumsum(n) - n
            chunks.append(ids[np.arange(ids.shape[1]) < n[:, None]])
            filled += len(chunks[-1])

        widths = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, WIDEST]
        for low, width in zip([0, *widths], widths):
            picked = np.flatnonzero((sizes > low) & (sizes <= width))
            step = max(1, (1 << 20) // width)
            for at in range(0, len(picked), step):
                self._merge_block([pieces[i] for i in picked[at : at + step].tolist()], picked[at : at + step], width, emit)
        for i in np.flatnonzero(sizes > WIDEST):
            ids = np.array(self.merge_long(pieces[i]), np.int32)
            emit(np.array([i]), ids[None, :], np.array([len(ids)]))
        return np.concatenate(chunks), start, count

    def _merge_block(self, pieces: list[bytes], place: np.ndarray, width: int, emit) -> None:
        raw = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces]), np.uint8).reshape(len(pieces), width)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < sizes[:, None], self.bytes[raw], np.int32(-1))
        if width == 1:
            return emit(place, ids, sizes)
        rank = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while True:
            rows = np.arange(len(ids))
            best = rank.argmin(axis=1)  # the leftmost of equal ranks
            least = rank[rows, best]
            done = least == _NONE
            if done.any():
                emit(place[done], ids[done], sizes[done])
                if done.all():
                    return None
                going = ~done
                ids, rank, sizes, place, best, least = ids[going], rank[going], sizes[going], place[going], best[going], least[going]
                rows = np.arange(len(ids))
            ids[rows, best] = least
            cols = np.arange(width - 1)
            ids[:, :-1] = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)
            ids[:, -1] = -1
            sizes -= 1
            if width > 2:
                cols = np.arange(width - 2)
                rank[:, :-1] = np.take_along_axis(rank, cols + (cols >= best[:, None]), 1)
            rank[:, -1] = _NONE
            follows = np.minimum(best + 1, width - 1)
            rank[rows, best] = np.where(best + 1 < sizes, self.lookup(least, ids[rows, follows]), _NONE)
            before = np.flatnonzero(best > 0)
            rank[before, best[before] - 1] = self.lookup(ids[before, best[before] - 1], least[before])

    def merge_long(self, piece: bytes) -> list[int]:
        """The tokens of one long piece, by a heap of pairs over a linked list."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get((rank << 32) | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if (k := before[i]) >= 0 and (r := get((ids[k] << 32) | rank)) is not None:
                heapq.heappush(heap, (r, k, ids[k], rank))
        return [x for x in ids if x >= 0]


def ranks_of(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}


class Encoder:
    """Encodes texts. Pieces get slots, and their tokens lie in one array; when the slots are used up, all are forgotten."""

    def __init__(self, table: Merges, pattern: str, cached: int = CACHED):
        self.table, self.find, self.cached = table, regex.compile(pattern).findall, cached
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.tokens, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts in one array, and n + 1 bounds."""
        cut = [self.find(x) for x in texts]
        pieces = list(chain.from_iterable(cut))
        missed = set(pieces).difference(self.slot)
        if len(self.slot) + len(missed) > self.cached:
            self._forget()
            missed = set(pieces)
        if missed:
            tokens, start, count = self.table.merge([x.encode() for x in missed])
            self.slot.update(zip(missed, range(len(self.slot), len(self.slot) + len(missed))))
            self.start = np.concatenate([self.start, start + len(self.tokens)])
            self.count = np.concatenate([self.count, count])
            self.tokens = np.concatenate([self.tokens, tokens])
        slots = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        n = self.count[slots]
        ends = np.cumsum(n)
        flat = self.tokens[np.repeat(self.start[slots] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in cut], out=bounds[1:])
        return flat, np.append(0, ends)[bounds]


class Ranks:
    """What a worker keeps of a rank file, each part from when it is first asked for."""

    def __init__(self, rank_file: bytes):
        self.rank_file = rank_file
        self._encoders: dict[str, Encoder] = {}

    def encoder(self, pattern: str) -> Encoder:
        if pattern not in self._encoders:
            self._encoders = {pattern: Encoder(Merges(ranks_of(self.rank_file)), pattern)}
        return self._encoders[pattern]

    @cached_property
    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens by id in one array, and the bounds of each."""
        ranks = ranks_of(self.rank_file)
        vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            vocab[rank] = token
        return np.frombuffer(b"".join(vocab) or b"\0", np.uint8), np.append(0, np.cumsum([len(x) for x in vocab])).astype(np.int64)


def tables(rank_file: bytes) -> Ranks:
    return held(("ranks", rank_file), lambda: Ranks(rank_file))


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))


def _contents(vocabulary: tuple[np.ndarray, np.ndarray], flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes that runs of ids stand for."""
    blob, begins = vocabulary
    sizes = np.diff(begins)
    if len(flat) and (flat.dtype.kind == "f" or flat.min() < 0 or flat.max() >= len(sizes)):
        raise ValueError("a token id is null or not in the vocabulary")
    flat = flat.astype(np.int64, copy=False)
    ends = np.cumsum(sizes[flat])
    total = int(ends[-1]) if len(ends) else 0
    content = blob[np.arange(total) + np.repeat(begins[flat] - (ends - sizes[flat]), sizes[flat])]
    cuts = np.append(0, ends)[bounds].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(np.ascontiguousarray(content))])


def encode(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(id, token_ids array<int>) of every whole text, and with `decoded` the bytes that the ids stand for as `content`: one pass and one set of
    workers where both are asked for. path: the rank file, read by the driver and broadcast."""
    ranks = docs.sparkSession.sparkContext.broadcast(_read(path))

    def make():
        own = tables(ranks.value)
        encoder = own.encoder(pattern)

        def step(part: pa.RecordBatch) -> dict:
            flat, bounds = encoder.encode([x or "" for x in part.column(1).to_pylist()])
            return {"id": part.column(0), "token_ids": _lists(flat, bounds), **({"content": _contents(own.vocabulary, flat, bounds)} if decoded else {})}

        return step

    schema = "id long, token_ids array<int>" + ", content binary" * decoded
    return map_slices(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), make, schema, limit=1 << 19).withColumnRenamed("id", id)


def decode(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(id, token_ids, content binary): the bytes that the ids stand for."""
    ranks = encoded.sparkSession.sparkContext.broadcast(_read(path))

    def run(batches):
        vocabulary = tables(ranks.value).vocabulary
        for batch in batches:
            at, step = 0, max(1, len(batch) * (1 << 18) // max(1, batch.nbytes // 4))
            while at < len(batch):
                part = batch.slice(at, step)
                at += step
                lists = part.column(1)
                bounds = np.zeros(len(part) + 1, np.int64)
                np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=bounds[1:])
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, _contents(vocabulary, flat, bounds)], names=["id", "token_ids", "content"])
        release()

    return encoded.select(F.col(id).cast("long").alias("id"), F.col(ids).alias("token_ids")).mapInArrow(run, "id long, token_ids array<int>, content binary").withColumnRenamed("id", id)
