"""Language identification by cross-parsing entropy.

A suffix automaton holds every substring of a language's training text. A text is parsed against it
greedily: each phrase is the longest match from where the last one ended, and a new phrase begins where no
transition is left. Phrases times log2 of the training length, over the text's length, estimates the bits a
symbol costs in that language; the language with the fewest such normalised phrases wins.

Texts are parsed in lock-step. A long text is cut into blocks that are parsed as if a phrase began with each; then
the phrase that is open at the end of a block is carried on into the next until it and the block's own parse begin a phrase at
the same symbol, from where they are one. So the phrases are those of the whole text, however it was cut.

A symbol is a lower-cased letter; runs of anything else are one gap. Null texts and texts without a letter are
`und` with score 0, as is every text when nothing could be learnt. Of equal languages the first by name wins. Repeated
rows are judged each, an empty table gives no rows, and columns but the id and the text have no part in a prediction.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import keep_slices, map_slices

BLOCK = 1024
#: The labelled sample: at most so many rows of a language, with at most so many characters in all.
DOCUMENTS, CHARACTERS = 120, 300_000
#: Letters with a symbol of their own; the rest share one.
LETTERS = 120
#: Letters drawn one by one, by which a text in no language is known.
NOISE = 20_000


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, with n + 1 bounds; gaps at a text's ends go."""
    lowered = [x.lower() for x in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in lowered])
    code = codes[points]
    head = np.ones(len(code), bool)
    head[1:] = (code[:-1] == 0) | (row[1:] != row[:-1])
    tail = np.ones(len(code), bool)
    tail[:-1] = row[1:] != row[:-1]
    keep = (code != 0) | ~head & ~tail
    code, row = code[keep], row[keep]
    # a gap before the end of a text may be left where the text ends in several
    return code, np.searchsorted(row, np.arange(len(texts) + 1))


class Automaton:
    """The suffix automaton of a text: edges as arrays, chained by state; states with many edges have an index of theirs."""

    MANY = 4

    def __init__(self, text: np.ndarray):
        self.head, self.width = array("i", [-1]), array("B", [0])  # of each state: its last edge, and how many it has
        self.symbol, self.target, self.next = array("B"), array("i"), array("i")
        self.wide: dict[int, dict[int, int]] = {}
        link, length, last = array("i", [-1]), array("i", [0]), 0
        edge, put, target = self.edge, self._put, self.target
        for c in text.tolist():
            new = self._state()
            length.append(length[last] + 1)
            link.append(0)
            at, found = last, -1
            while at >= 0 and (found := edge(at, c)) < 0:
                put(at, c, new)
                at = link[at]
            if at >= 0:
                to = target[found]
                if length[at] + 1 == length[to]:
                    link[new] = to
                else:
                    copy = self._state()
                    e = self.head[to]
                    while e >= 0:
                        put(copy, self.symbol[e], target[e])
                        e = self.next[e]
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and (e := edge(at, c)) >= 0 and target[e] == to:
                        target[e] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new

    def _state(self) -> int:
        self.head.append(-1)
        self.width.append(0)
        return len(self.head) - 1

    def edge(self, state: int, c: int) -> int:
        """The edge of a state for a symbol, or -1."""
        if self.width[state] > self.MANY:
            return self.wide[state].get(c, -1)
        e = self.head[state]
        while e >= 0 and self.symbol[e] != c:
            e = self.next[e]
        return e

    def _put(self, state: int, c: int, to: int) -> None:
        e = len(self.symbol)
        self.symbol.append(c)
        self.target.append(to)
        self.next.append(self.head[state])
        self.head[state] = e
        self.width[state] += 1
        if self.width[state] > self.MANY + 1:
            self.wide[state][c] = e
        elif self.width[state] > self.MANY:
            own = self.wide[state] = {}
            while e >= 0:
                own[self.symbol[e]] = e
                e = self.next[e]

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, symbol, target): the edges in order of their states, of which that of a number begins at first[number]."""
        width = np.frombuffer(self.width, np.uint8).astype(np.int64)
        owner = np.full(len(self.symbol), -1, np.int32)
        level, state = np.frombuffer(self.head, np.int32).copy(), np.arange(len(width), dtype=np.int32)
        following = np.frombuffer(self.next, np.int32)
        while len(level := level[keep := level >= 0]):
            state = state[keep]
            owner[level] = state
            level = following[level]
        order = np.argsort(owner, kind="stable")
        return np.append(0, np.cumsum(width)), np.frombuffer(self.symbol, np.uint8)[order].astype(np.int64), np.frombuffer(self.target, np.int32)[order]


def packed(first: np.ndarray, marks: np.ndarray, targets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The transitions with their rows laid over one another: the one of a state and a symbol, if there is one, stands in the cell
    base[state] + symbol, as the state and, below it, the target. Rows of several are put, large ones first, where drawn
    places are free; rows of one fill what is left."""
    width = np.diff(first)
    single = np.flatnonzero(width == 1)
    room = max(2 * (len(marks) - len(single)), len(marks) + len(marks) // 16) + size
    owner, to = np.full(room + size, -1, np.int32), np.zeros(room + size, np.int32)
    base = np.zeros(len(width), np.int32)
    rng = np.random.default_rng(11)
    for low, high in ((9, size), (5, 8), (3, 4), (2, 2)):
        todo = np.flatnonzero((width >= low) & (width <= high))
        while len(todo):
            n = width[todo]
            row = np.repeat(np.arange(len(todo)), n)
            at = np.repeat(first[todo], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            drawn = rng.integers(0, room, len(todo))
            cell = drawn[row] + marks[at]
            fits = np.bincount(row, owner[cell] >= 0, len(todo)) == 0
            open_ = fits[row]
            owner[cell[open_]] = todo[row[open_]]  # of rows drawn to one cell the last stays in it
            mine = open_ & (owner[cell] == todo[row])
            won = np.bincount(row, mine, len(todo)) == n
            owner[cell[mine & ~won[row]]] = -1
            base[todo[won]] = drawn[won]
            to[cell[won[row]]] = targets[at[won[row]]]
            todo = todo[~won]
    free = np.flatnonzero(owner[size:] < 0)[: len(single)] + size
    base[single] = free - marks[first[single]]
    owner[free], to[free] = single, targets[first[single]]
    return base, owner.astype(np.int64) << 32 | to


class Model:
    """Automata of all languages in one table; about 25 bytes for each symbol that was learnt."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        seen = Counter(c for x in samples.values() for c in x.lower() if c.isalpha())
        self.codes = letter_table().astype(np.uint8)  # 1: any other letter
        for k, (c, _) in enumerate(seen.most_common(LETTERS)):
            self.codes[ord(c)] = k + 2
        self.size = min(len(seen), LETTERS) + 2
        parts: list[tuple[np.ndarray, ...]] = []
        bits, roots, states, cells = [], [], 0, 0
        self.single = np.zeros((len(self.languages), self.size), np.int32)  # the state after a symbol alone, or the root
        for k, x in enumerate(self.languages):
            text = symbols([samples[x]], self.codes)[0]
            first, marks, targets = Automaton(text).edges()
            base, own = packed(first, marks, targets, self.size)
            parts.append((base + cells, np.where(own < 0, -1, own + ((states << 32) + states))))
            self.single[k] = states
            self.single[k, marks[: first[1]]] = targets[: first[1]] + states
            roots.append(states)
            bits.append(np.log2(max(2, len(text))))
            states, cells = states + len(base), cells + len(own)
        self.bits, self.roots = np.array(bits), np.array(roots, np.int32)
        self.base = np.concatenate([x.astype(np.int32, copy=False) for x, _ in parts] or [np.zeros(0, np.int32)])
        self.cells = np.concatenate([x for _, x in parts] or [np.zeros(0, np.int64)])

        # What letters drawn one by one, each as often as the samples hold it, cost in the language where they cost least.
        letters = [" ", *seen]
        often = np.array([sum(1 for x in samples.values() for c in x if not c.isalpha()), *seen.values()], float)
        drawn = np.random.default_rng(3).choice(len(letters), NOISE, p=often / often.sum()) if parts and seen else ()
        self.noise = float(self.entropies(["".join(letters[k] for k in drawn)])[0].min()) if len(drawn) else 0.0

    def _step(self, state: np.ndarray, symbol: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol each, and where a new phrase begins with it."""
        cell = self.cells[self.base[state] + symbol]
        fresh = (cell >> 32) != state
        return np.where(fresh, single, cell.astype(np.int32)), fresh

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol of each text by language, and the number of its symbols."""
        code, bounds = symbols(texts, self.codes)
        size = np.diff(bounds)
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        for cut in (False, True):
            some = np.flatnonzero((size > BLOCK) if cut else (size > 0) & (size <= BLOCK))
            if not len(some) or not self.languages:
                continue
            blocks = -(-size[some] // BLOCK)
            row = np.repeat(some, blocks)
            number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            begin = bounds[row] + BLOCK * number
            length = np.minimum(begin + BLOCK, bounds[row + 1]) - begin
            count, state, fresh = self._parse(code, begin, length, cut)
            if cut:
                count += self._joined(code, begin, length, number, fresh, state)
            for k in range(len(self.languages)):
                total[k] += np.bincount(row, count[k], len(texts)).astype(np.int64)
        return total * self.bits[:, None] / np.maximum(size, 1), size

    def _parse(self, code: np.ndarray, begin: np.ndarray, length: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Each block parsed alone: the number of its phrases and the state at its end by language, and if they are to be kept
        the places where a phrase begins, by place, language and block."""
        order = np.argsort(-length, kind="stable")
        widest = int(length[order[0]])
        active = np.searchsorted(-length[order], -np.arange(widest), "left")  # blocks longer than j
        at = begin[order]
        state = np.repeat(self.roots[:, None], len(begin), 1)
        count = np.ones(state.shape, np.int64)
        fresh = np.zeros((widest, *state.shape), bool) if keep else None
        for j, n in enumerate(active.tolist()):
            symbol = code[at[:n] + j].astype(np.int32)
            state[:, :n], now = self._step(state[:, :n], symbol, self.single[:, symbol])
            count[:, :n] += now
            if fresh is not None:
                fresh[j, :, order[:n]] = now.T
        counts, ends = np.empty_like(count), np.empty_like(state)
        counts[:, order], ends[:, order] = count, state
        return counts, ends, fresh

    def _joined(self, code: np.ndarray, begin: np.ndarray, length: np.ndarray, number: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> np.ndarray:
        """What is to be added to the phrases of each block, as one that isn't a text's first is entered with a phrase open."""
        later = np.flatnonzero(number)
        more = np.zeros(state.shape, np.int64)
        # A first symbol that the language lacks begins two phrases of a block that is parsed alone, but one of a block that is entered.
        more[:, later] -= fresh[0][:, later]
        fresh[0] = True
        entered = np.zeros_like(state)  # the state in which each later block is entered
        entered[:, later] = state[:, later - 1]
        lang, block = np.repeat(np.arange(len(state)), len(later)), np.tile(later, len(state))
        alone = more.copy()
        while len(block):
            own = entered[lang, block]
            got = alone[lang, block]
            left = state[lang, block]  # as the block's own parse leaves it, unless the two don't meet
            alive = np.arange(len(block))
            for j in range(int(length[block].max())):
                ended = length[block[alive]] <= j
                left[alive[ended]] = own[alive[ended]]
                alive = alive[~ended]
                if not len(alive):
                    break
                l, b = lang[alive], block[alive]
                symbol = code[begin[b] + j].astype(np.int32)
                own[alive], now = self._step(own[alive], symbol, self.single[l, symbol])
                begins = fresh[j, l, b]
                got[alive] += now.astype(np.int64) - begins
                alive = alive[~(now & begins)]
            left[alive] = own[alive]
            more[lang, block] = got
            # A block that was left in another state than was thought is followed by one to be entered anew.
            following = np.minimum(block + 1, len(begin) - 1)
            again = (following > block) & (number[following] > 0) & (entered[lang, following] != left)
            entered[lang[again], following[again]] = left[again]
            lang, block = lang[again], following[again]
        return more

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1 and bits a symbol of each text."""
        given = [x or "" for x in texts]
        if not self.languages:
            return ["und"] * len(given), np.zeros(len(given)), np.zeros(len(given))
        bits, size = self.entropies(given)
        best = bits.argmin(axis=0)
        least = bits[best, np.arange(len(given))]
        score = 1 / np.exp2(-4 * (bits - least)).sum(axis=0)
        has = size > 0
        return [self.languages[k] if x else "und" for k, x in zip(best, has)], np.where(has, score, 0.0), np.where(has, least, 0.0)


def learn(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """Training text by language, from a bounded sample of the labelled rows: in the order of a hash of the id at most
    DOCUMENTS whole texts of a language, those that still fit into CHARACTERS in all, or the shortest of them if none fits.
    Rows with a null label, id or text have no part; an empty table teaches nothing."""
    rows = labelled.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and id is not null and text is not null")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return ()
    place: Column = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 3 * DOCUMENTS / r["count"]))])
    drawn = rows.where(place < share[F.col("lang")] * 1_000_000)
    # Rows that repeat an id are no more than one: the first by text hash.
    sized = drawn.groupBy("lang", F.xxhash64("id").alias("h"), "id").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), F.length("text").alias("n"))).alias("one")).select("lang", "h", "id", "one.*").collect()
    by: dict[str, list] = {}
    for r in sorted(sized, key=lambda r: (r.lang, r.h, r.id)):
        by.setdefault(r.lang, []).append(r)
    chosen: dict[tuple[str, int, int], None] = {}
    for name, found in by.items():
        left, n = CHARACTERS, 0
        for r in found:
            if n < DOCUMENTS and r.n <= left:
                chosen[name, r.id, r.mark] = None
                left, n = left - r.n, n + 1
        if not n:
            r = min(found, key=lambda r: r.n)
            chosen[name, r.id, r.mark] = None
    texts = {(r.lang, r.id, r.mark): r.text for r in drawn.where(F.col("id").isin([k for _, k, _ in chosen])).withColumn("mark", F.xxhash64("text")).dropDuplicates(["lang", "id", "mark"]).collect()}
    return tuple((name, " ".join(texts[k] for k in chosen if k[0] == name)) for name in sorted(by))


def _sent(docs: DataFrame, samples: tuple[tuple[str, str], ...]):
    """The model, made by the driver and broadcast: its size is bounded by that of the sample."""
    return docs.sparkSession.sparkContext.broadcast(Model(dict(samples)))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits) of every whole text, by what learn() returned."""
    sent = _sent(docs, samples)

    def make():
        own = sent.value

        def step(part: pa.RecordBatch) -> dict:
            lang, score, bits = own.predict(part.column(1).to_pylist())
            return {"id": part.column(0), "lang_pred": lang, "score": score, "bits": bits}

        return step

    return map_slices(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), make, "id long, lang_pred string, score double, bits double", limit=1 << 20).withColumnRenamed("id", id)


def accepted(docs: DataFrame, samples: tuple[tuple[str, str], ...], least: int = 50, text: str = "text") -> DataFrame:
    """The documents, with all their columns, whose text is in a learnt language: it has letters, and where there are
    at least `least` symbols, they cost no more bits than letters drawn one by one do, each as often as the samples hold it. If nothing
    was learnt, all stay."""
    sent = _sent(docs, samples)

    def make():
        own = sent.value

        def step(column: pa.Array) -> np.ndarray:
            if not own.languages:
                return np.ones(len(column), bool)
            bits, size = own.entropies([x or "" for x in column.to_pylist()])
            return (size > 0) & ((size < least) | (bits.min(axis=0) <= own.noise))

        return step

    return keep_slices(docs, make, text, limit=1 << 20)
