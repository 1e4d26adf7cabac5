"""Token counts of whole texts by a sentencepiece model, without moving a pre-token between tasks.

No piece of the model holds a space after another character, so a text falls into units (a run of spaces
and what follows it up to the next space) that merge on their own; its count is the sum of theirs. Tier one
is a broadcast table of the lengths of frequent units, tier two a bounded memory of each worker for the rest,
which the library encodes.

Null text counts as empty and gives 0 tokens; repeated rows are counted each, an empty table gives no rows, and other columns have no
part. What the table and the memory hold has no bearing on any count.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import held, map_slices

#: Units in the broadcast table, and documents that are read to choose them: a cache, without bearing on any count.
FREQUENT, SAMPLED = 50_000, 500
#: Units that a worker remembers beside the table.
CACHED = 300_000
_SPACED = re.compile(" +[^ ]*")


@lru_cache(2)
def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """The library's processor; raises if the model's pieces cross a space, or if it rewrites texts."""
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    space = "▁"
    if any(space in own.id_to_piece(i).lstrip(space) for i in range(own.get_piece_size())):
        raise ValueError("a piece of this model crosses a space; texts can't be cut there")
    if own.encode("a  b ", out_type=str)[-1:] != [space]:
        raise ValueError("this model drops or merges spaces; texts can't be cut there")
    return own


def units(text: str) -> list[str]:
    """The text's units; the first is as if a space stood before it, as the library puts one there."""
    if not text:
        return []
    text = text.replace("▁", " ")  # the library makes the same symbol of both
    if "  " in text or text[0] == " " or text[-1] == " ":
        found = _SPACED.findall(" " + text)
        return [x[1:] for x in found]
    return text.split(" ")


class Counter2:
    """Counts tokens; each unit is looked up in the table, then in the worker's memory, then encoded."""

    def __init__(self, model: bytes, table: dict[str, int], cached: int = CACHED):
        self.own, self.cached, self.more = processor(model), cached, {}
        #: A last single space is the empty unit, which the library can't be given alone.
        self.table = {**table, "": len(self.own.encode("a ")) - len(self.own.encode("a"))}

    def count(self, texts: list[str]) -> list[int]:
        cut = [units(x) for x in texts]
        missed = set().union(*cut).difference(self.table, self.more) if cut else set()
        if missed:
            if len(self.more) + len(missed) > self.cached:
                self.more = {}
                missed = set().union(*cut).difference(self.table)
            order = list(missed)
            self.more.update(zip(order, map(len, self.own.encode(order, num_threads=1))))
        table, more = self.table, self.more
        both = {x: table[x] if x in table else more[x] for x in set().union(*cut)} if cut else {}
        if any(len(x) > 256 for x in missed):
            self.more = {k: v for k, v in more.items() if len(k) <= 256}
        return [sum(map(both.__getitem__, x)) for x in cut]


def frequent(docs: DataFrame, model: bytes, size: int = FREQUENT, sampled: int = SAMPLED) -> tuple[str, bytes]:
    """The table in compact form: units joined by spaces, which none contains after its first character, and a byte for each length."""
    own = processor(model)
    vocab = [own.id_to_piece(i)[1:] for i in range(own.get_piece_size()) if own.id_to_piece(i)[:1] == "▁"]
    seen: Counter[str] = Counter()
    for row in docs.select(F.substring(F.col("text"), 1, 20_000).alias("text")).where(F.col("text").isNotNull()).limit(sampled).collect():
        seen.update(units(row.text))
    chosen = [x for x, n in seen.most_common(size) if n > 1]
    chosen = [x for x in dict.fromkeys(chosen + vocab) if x and " " not in x and "▁" not in x][:size]
    kept = [(x, n) for x, n in zip(chosen, map(len, own.encode(chosen, num_threads=1))) if n < 256]
    return " ".join(x for x, _ in kept), bytes(n for _, n in kept)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text. path: the model's file, read by the driver."""
    with open(path, "rb") as f:
        model = f.read()
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((model, frequent(docs, model)))

    def make():
        own, (joined, lengths) = sent.value
        counter = held(("pieces", own, joined), lambda: Counter2(own, dict(zip(joined.split(" "), lengths)) if joined else {}))

        def step(part: pa.RecordBatch) -> dict:
            texts = [x or "" for x in part.column(1).to_pylist()]
            n = counter.count(texts)
            return {"id": part.column(0), "n_bytes": [len(x.encode()) for x in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return step

    return map_slices(docs, make, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id)
