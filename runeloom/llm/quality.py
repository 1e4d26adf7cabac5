"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words, their shapes (runs of lower case, upper case, digits; marks as they are), pairs of
neighbouring shapes, words that repeat the one before, lines that occur before in the text, and its length. The terms of
a bounded sample of labelled rows, of which whole texts are read, have weights by how rare they are and, by a singular value
decomposition, a space of RANK dimensions. The sample's vectors and labels are broadcast; every document's cosines with all of
them are computed in blocks, and its VOTES nearest ones vote with their similarity as weight. Similarities are compared with
five decimals; of equal ones that of the smaller id votes.

Null texts count as empty. A text without terms in common with the sample gets the sample's share of label 1, and
0.5 if there was nothing to learn from, as when a table is empty. Labelled rows with a null id or label have no part; of
several labels of an id the largest counts, and of several texts that with the least hash. Repeated documents are scored each,
and other columns have no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import SPACED, Words, map_slices, mix, utf8
from .shared import cut

#: Labelled rows of the sample; kinds of terms, the most frequent ones; dimensions; neighbours.
SAMPLED, TERMS, RANK, VOTES = 3000, 6000, 48, 21
_SHAPE = np.array([ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)], np.uint8)
_LINES = np.array([b not in b"\r\n" for b in range(256)])


def _collapsed(column: pa.Array) -> pa.Array:
    """The texts with every byte replaced by its class and every run of a class by one."""
    data, bounds = utf8(column)
    data = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = data[1:] != data[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    kept = np.append(0, np.cumsum(keep))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(np.ascontiguousarray(kept[bounds])), pa.py_buffer(data[keep])])


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, fingerprint and weight of every term of the texts; the weight is the square root of the term's share."""
    words, shapes, lines = Words(column, SPACED), Words(_collapsed(column), SPACED), Words(column, _LINES)
    pair, pair_row = shapes.shingles(2)
    again = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (words.row[1:] == words.row[:-1])) + 1
    order = np.lexsort((lines.hashes, lines.row))
    same = (lines.hashes[order][1:] == lines.hashes[order][:-1]) & (lines.row[order][1:] == lines.row[order][:-1])
    repeated = lines.row[order][1:][same]
    count = np.diff(words.from_)
    size = np.floor(np.log2(np.maximum(count, 1))).astype(np.uint64)
    some = np.flatnonzero(count)
    row = np.concatenate([words.row, shapes.row, pair_row, words.row[again], repeated, some])
    kind = np.concatenate([mix(words.hashes + np.uint64(2)), shapes.hashes, mix(pair + np.uint64(1)), np.full(len(again), 2, np.uint64), np.full(len(repeated), 3, np.uint64), size[some] + np.uint64(100)])
    part = np.concatenate([1 / np.maximum(1, count)[words.row], 1 / np.maximum(1, count)[shapes.row], 1 / np.maximum(1, count)[pair_row], 1 / np.maximum(1, count)[words.row[again]], 1 / np.maximum(1, np.diff(lines.from_))[repeated], np.full(len(some), 0.05)])
    order = np.lexsort((kind, row))
    row, kind, part = row[order], kind[order], part[order]
    if not len(row):
        return row, kind, part
    head = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])))
    return row[head], kind[head], np.sqrt(np.add.reduceat(part, head))


class Model:
    """The latent space, the sample's vectors in it, and their labels. terms: the fingerprints and weights of each sampled text's terms."""

    def __init__(self, terms: list[tuple[np.ndarray, np.ndarray]], labels: list[int]):
        n = len(labels)
        row = np.repeat(np.arange(n), [len(k) for k, _ in terms])
        kind = np.concatenate([k for k, _ in terms] or [np.zeros(0, np.uint64)])
        part = np.concatenate([p for _, p in terms] or [np.zeros(0)])
        known, often = np.unique(kind, return_counts=True)
        top = np.sort(np.lexsort((known, -often))[:TERMS])
        top = top[often[top] > 1]
        self.kinds = known[top]
        self.weight = np.log((1 + n) / (1 + often[top])) + 1
        self.labels = np.array(labels, np.float32)
        self.prior = float(self.labels.mean()) if labels else 0.5
        matrix = self._matrix(row, kind, part, n)
        rank = min(RANK, *matrix.shape)
        if not rank:
            self.space, self.vectors = np.zeros((len(self.kinds), 1), np.float32), np.zeros((n, 1), np.float32)
            return
        draw = np.random.default_rng(5).standard_normal((matrix.shape[1], rank + 16)).astype(np.float32)
        for _ in range(4):
            draw = np.linalg.qr(matrix.T @ (matrix @ draw))[0]
        _, _, turned = np.linalg.svd(matrix @ draw, full_matrices=False)
        self.space = (draw @ turned[:rank].T).astype(np.float32)
        self.vectors = self._unit(matrix @ self.space)

    @classmethod
    def of(cls, texts: list[str], labels: list[int]) -> Model:
        row, kind, part = terms(pa.array(texts, pa.string()))
        bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        return cls([(kind[a:b], part[a:b]) for a, b in zip(bounds, bounds[1:])], labels)

    def _matrix(self, row: np.ndarray, kind: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.kinds, kind), max(0, len(self.kinds) - 1))
        ok = self.kinds[at] == kind if len(self.kinds) else np.zeros(len(kind), bool)
        out = np.zeros((n, len(self.kinds)), np.float32)
        out[row[ok], at[ok]] = part[ok] * self.weight[at[ok]]
        return out

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size > 0, size, 1)

    def votes(self, cosine: np.ndarray) -> np.ndarray:
        """Which of the sample vote for each row: the most similar, of equal ones the first."""
        k = min(VOTES, cosine.shape[1])
        least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        above, equal = cosine > least, cosine == least
        return above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))

    def score(self, column: pa.Array) -> np.ndarray:
        row, kind, part = terms(column)
        out = np.full(len(column), self.prior)
        if not len(self.labels):
            return out
        for at in range(0, len(column), 256):
            a, b = np.searchsorted(row, [at, at + 256])
            own = self._unit(self._matrix(row[a:b] - at, kind[a:b], part[a:b], min(256, len(column) - at)) @ self.space)
            cosine = np.round(own @ self.vectors.T, 5)
            weight = np.where(self.votes(cosine), np.maximum(cosine, 0), 0).astype(np.float64) ** 8
            total = weight.sum(axis=1)
            out[at : at + 256] = np.where(total > 1e-9, weight @ self.labels.astype(np.float64) / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0, 1)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sampled: int = SAMPLED) -> Model:
    """A model of about `sampled` labelled rows, those whose ids hash lowest. The driver collects those of their terms that are among the
    TERMS most frequent, so what it holds is bounded however long their texts are and however often an id is repeated."""
    marks = labels.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    share = min(1.0, sampled / max(1, marks.count()))
    picked = marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).groupBy("id").agg(F.max("label").alias("label"))
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(id).cast("long").alias("id"), own.alias("text")).join(F.broadcast(picked), "id")
    texts = texts.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("one")).select("id", "label", F.col("one.text").alias("text"))

    def make():
        def step(part: pa.RecordBatch) -> dict:
            row, kind, weight = terms(part.column(2))
            bounds = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
            return {"id": part.column(0), "label": part.column(1), "kinds": pa.ListArray.from_arrays(bounds, pa.array(kind.view(np.int64))), "parts": pa.ListArray.from_arrays(bounds, pa.array(weight))}

        return step

    table = cut(map_slices(texts, make, "id long, label int, kinds array<long>, parts array<double>", limit=2 << 20))
    often = table.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = np.sort(np.array([r.kind for r in often.orderBy(F.desc("n"), "kind").limit(TERMS).collect()], np.int64))

    def frequent(batches):
        for batch in batches:
            kinds, parts = [], []
            for k, p in zip(batch.column(2), batch.column(3)):
                k, p = np.array(k.values, np.int64), np.array(p.values, np.float64)
                keep = np.isin(k, top)
                kinds.append(k[keep])
                parts.append(p[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.float64()))], names=batch.schema.names)

    rows = table.mapInArrow(frequent, table.schema).toArrow().sort_by("id")
    of = lambda name: [np.array(x.values) for x in rows[name].combine_chunks()] if len(rows) else []
    return Model([(k.astype(np.int64).view(np.uint64), p.astype(np.float64)) for k, p in zip(of("kinds"), of("parts"))], rows["label"].to_pylist())


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score from 0 to 1) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda part: {"id": part.column(0), "score": sent.value.score(part.column(1))}

    return map_slices(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), make, "id long, score double", limit=2 << 20).withColumnRenamed("id", id)
