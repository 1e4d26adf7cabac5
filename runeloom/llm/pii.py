"""Personal data in texts: four kinds by fixed patterns, more by a conditional random field.

Patterns, leftmost and without overlap for each kind: e-mail addresses, IPv4 addresses with parts up to 255, card
numbers of 13 to 19 digits that pass Luhn's test, phone numbers with a plus sign and 9 to 15 digits. A match that
fails its test is dropped and not tried again in part. Each pattern is run so that its time grows with the text's length
alone, whatever the text holds.

A linear-chain conditional random field over features of word shapes adds spans of the kinds phone (national forms), id
(identity and account numbers) and secret (keys and tokens). It is trained on the small labelled table EXAMPLES makes, and
decoded by Viterbi in numpy for many sequences at once. A sequence is a stretch around words with a digit: all three kinds
hold one, so names and addresses aren't found. An added span that touches one of a pattern is dropped. A sequence of any
length is decoded as a whole; a token takes some 50 bytes while it is, and its features are named for FEATURED tokens at a time.

Null texts count as empty and hold nothing; repeated rows are searched each, an empty table gives no rows, and other columns have
no part. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import map_slices

KINDS = ("email", "ip", "card", "phone", "id", "secret")
BASE = 4
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile("[0-9]")
# A match can begin only where a run of digits does, so later digits of a run needn't be tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE_RUN = re.compile(r"\+[0-9][ ().0-9-]++")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the four patterns, by kind and start."""
    out: list[Span] = []
    at, since = text.find("@"), 0
    while at >= 0:
        begin = since + len(text[since:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        since = found.end() if found else at + 1
        if found:
            out.append((0, begin, since))
        at = text.find("@", since)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        at = text.find("+")
        while at >= 0:
            m = _PHONE_RUN.match(text, at)
            body = m[0].rstrip(" ().-") if m else ""
            if len(body) >= 4:  # the pattern asks for a plus sign, a digit, something between, and a digit
                if 9 <= sum(map(body.count, "0123456789")) <= 15:
                    out.append((3, at, at + len(body)))
                at = text.find("+", at + len(body))
            else:
                at = text.find("+", at + 1)
    return out


# The conditional random field.

LABELS = ("O", "B-phone", "I-phone", "B-id", "I-id", "B-secret", "I-secret")
_OF = {"phone": 3, "id": 4, "secret": 5}
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_SOLID = re.compile(r"\S++")
#: Tokens whose features are named at once; those of a token look at NEAR tokens on either side.
FEATURED, NEAR = 4096, 3
_WORDS = {"tel", "phone", "call", "mobile", "fax", "telephone", "token", "key", "secret", "password", "api", "apikey", "bearer", "ssn", "iban", "id", "passport", "account", "version", "page", "year", "in", "no", "figure", "chapter"}


def shape(word: str) -> str:
    kind = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word[:64])
    return re.sub(r"(.)\1+", r"\1+", kind) if len(word) < 64 else "long" + ("0" if any(c.isdigit() for c in word[:64]) else "")


def features(text: str, tokens: list[tuple[int, int]]) -> list[list[str]]:
    """Names of each token's features."""
    own = []
    for k, (a, b) in enumerate(tokens):
        n = b - a
        word = text[a : min(b, a + 512)]  # what a longer word is like shows by then
        digits, upper = sum(map(str.isdigit, word[:64])), word.isupper()
        size = str(n) if n < 6 else "6-9" if n < 10 else "10-15" if n < 16 else "16-31" if n < 32 else "32+"
        kind = "hex" if n > 7 and re.fullmatch("[0-9a-f]+", word) else "mixed" if 0 < digits < n and n > 7 else "digits" if digits == n else "mark" if not word[0].isalnum() else "word"
        turns = sum(x.isdigit() != y.isdigit() for x, y in zip(word[:64], word[1:64]))
        own.append((shape(word)[:12], size, kind, upper, "many" if turns > 3 else str(turns), word.lower() if word.lower() in _WORDS or not word[0].isalnum() else "", k > 0 and tokens[k - 1][1] == a))
    out = []
    for k, (form, size, kind, upper, turns, word, joined) in enumerate(own):
        got = ["bias", f"s={form}", f"n={kind}{size}", f"t={kind}{turns}{upper}", f"j={joined}{kind}"]
        if word:
            got.append(f"w={word}")
        for d in (-3, -2, -1, 1, 2):
            if 0 <= k + d < len(own):
                near = own[k + d]
                got += [f"{d}k={near[2]}{near[1]}|{kind}{size}"]
                if near[5]:
                    got.append(f"{d}w={near[5]}|{kind}")
            else:
                got.append(f"{d}none")
        out.append(got)
    return out


def examples(seed: int = 3, count: int = 900) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: sentences of made-up words with spans (kind, start, end)."""
    r = random.Random(seed)
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: some(low, r.randint(2, 9)).capitalize() if r.random() < 0.2 else some(low, r.randint(2, 9))
    d = lambda n: some(num, n)

    def phone() -> str:
        return r.choice([lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(3)}/{d(7)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"])()

    def number() -> str:
        return r.choice([lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{some(up, 2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"{some(up, 2)}{d(20)}"])()

    def secret() -> str:
        return r.choice([lambda: "AKIA" + some(up + num, 16), lambda: some("abcdef" + num, r.choice([32, 40, 64])), lambda: "ghp_" + some(low + up + num, 36), lambda: "sk-" + some(low + up + num, r.randint(32, 48))])()

    def plain() -> str:
        return r.choice([
            lambda: f"version {d(1)}.{d(1)}", lambda: d(4), lambda: f"{d(1)},{d(3)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"page {d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: d(r.randint(1, 12)), lambda: f"{d(2)}%", lambda: f"{some(up, 1)}{d(2)}", lambda: f"{d(3)} {word()}",
            lambda: f"{word()}{d(2)}", lambda: d(16), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(2)}.{d(3)}.{d(1)}.{d(2)}", lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"{word()}.{d(2)}@mail{d(1)}.example.com", lambda: f"{d(4)}-{d(4)}", lambda: f"4.0.\n{word()}",
        ])()

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += "".join(word() + r.choice([" ", " ", " ", ", ", ". "]) for _ in range(r.randint(0, 5)))
            kind = r.choice(["phone", "id", "secret", "", "", ""])
            body = {"phone": phone, "id": number, "secret": secret, "": plain}[kind]()
            lead = {"phone": r.choice(["", "", "tel ", "call ", "phone: "]), "id": r.choice(["", "", "ssn ", "iban ", "id: "]), "secret": r.choice(["", 'token = "', "key: ", 'password = "', "secret=", 'api_key = "']), "": r.choice(["", "", "", "no ", "in "])}[kind]
            text += lead
            if kind:
                spans.append((kind, len(text), len(text) + len(body)))
            text += body + ('"' if lead.endswith('"') else "") + r.choice([" ", ". ", ", ", "\n"])
        out.append((text, spans))
    return out


class Field:
    """Weights of features and of transitions between labels."""

    def __init__(self, table: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60):
        self.index: dict[str, int] = {}
        sequences = []
        for text, spans in table:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            gold = []
            for a, b in tokens:
                hit = next((s for s in spans if a < s[2] and b > s[1]), None)
                gold.append(0 if hit is None else LABELS.index(("B-" if a <= hit[1] else "I-") + hit[0]))
            if tokens:
                sequences.append(([[self.index.setdefault(f, len(self.index)) for f in got] for got in features(text, tokens)], gold))
        self.width = max((len(got) for got, _ in sequences for got in got), default=1)
        self.emit, self.move = np.zeros((len(self.index) + 1, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
        self.barred = np.array([[b[0] == "I" and a[2:] != b[2:] for b in LABELS] for a in LABELS])  # a span begins with B
        self._train(sequences, rounds)

    def _pack(self, rows: list[list[int]]) -> np.ndarray:
        """The numbers of each token's features, padded with that of none."""
        out = np.full((len(rows), self.width), len(self.index), np.int64)
        for k, got in enumerate(rows):
            out[k, : len(got)] = got[: self.width]
        return out

    def _train(self, sequences, rounds: int) -> None:
        """Maximises the penalised likelihood by Adam steps over all sequences, with forward and backward sums."""
        ids = self._pack([got for x, _ in sequences for got in x])
        size = np.array([len(x) for x, _ in sequences])
        steps, n, labels = int(size.max()), len(sequences), len(LABELS)
        inside = np.arange(steps) < size[:, None]  # by sequence and place, as tokens are numbered
        gold = np.concatenate([np.array(y) for _, y in sequences])
        begins = np.cumsum(size) - size
        order = np.argsort(ids.ravel(), kind="stable")
        token, used = order // self.width, np.unique(ids)
        heads = np.searchsorted(ids.ravel()[order], used)

        def gathered(each: np.ndarray) -> np.ndarray:
            """Sums of the tokens' rows by feature."""
            out = np.zeros_like(self.emit)
            out[used] = np.add.reduceat(each[token], heads)
            return out

        want_emit, want_move = gathered(np.eye(labels)[gold]), np.zeros_like(self.move)
        follows = np.setdiff1d(np.arange(len(gold)), begins)
        np.add.at(want_move, (gold[follows - 1], gold[follows]), 1)
        both = inside[:, 1:].T
        inner = inside.T
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.emit, self.move)]
        for step in range(1, rounds + 1):
            score = np.zeros((n, steps, labels))
            score[inside] = self.emit[ids].sum(axis=1)
            score = score.transpose(1, 0, 2)
            move = np.where(self.barred, -1e4, self.move)
            ahead, back = np.zeros((steps, n, labels)), np.zeros((steps, n, labels))
            ahead[0] = score[0] + np.where([x[0] == "I" for x in LABELS], -1e4, 0)
            total = lambda x: (m := x.max(axis=1, keepdims=True))[:, 0] + np.log(np.exp(x - m).sum(axis=1))
            for t in range(1, steps):
                ahead[t] = np.where(inner[t][:, None], total(ahead[t - 1][:, :, None] + move) + score[t], ahead[t - 1])
            for t in range(steps - 2, -1, -1):
                back[t] = np.where(inner[t + 1][:, None], total(((score[t + 1] + back[t + 1])[:, None, :] + move).transpose(0, 2, 1)), 0)
            z = total(ahead[-1])
            each = np.exp(ahead + back - z[:, None])
            got_emit = gathered(each.transpose(1, 0, 2)[inside])
            pair = np.exp(ahead[:-1][:, :, :, None] + move + (score[1:] + back[1:])[:, :, None, :] - z[:, None, None]) * both[:, :, None, None]
            for k, (weights, grown) in enumerate(((self.emit, want_emit - got_emit), (self.move, want_move - pair.sum(axis=(0, 1))))):
                grown = grown / n - 1e-4 * weights
                mean, square = state[k]
                mean += 0.1 * (grown - mean)
                square += 0.01 * (grown**2 - square)
                weights += 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            self.emit[-1] = 0  # padding and features that training didn't have
        self.move = np.where(self.barred, -1e4, self.move)

    def emissions(self, text: str, tokens: np.ndarray) -> np.ndarray:
        """The scores of each token's labels by its features; tokens: rows of start and end."""
        out = np.zeros((len(tokens), len(LABELS)), np.float32)
        for at in range(0, len(tokens), FEATURED):
            low, high = max(0, at - NEAR), min(len(tokens), at + FEATURED + NEAR)
            near = [tuple(x) for x in tokens[low:high].tolist()]
            known = [[self.index.get(f, len(self.index)) for f in got] for got in features(text, near)[at - low : at - low + FEATURED]]
            out[at : at + len(known)] = self.emit[self._pack(known)].sum(axis=1)
        return out

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence by its emissions: Viterbi over many at once, longest first."""
        order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
        out: list[np.ndarray] = [np.zeros(0, np.int8) for _ in scores]
        at = 0
        move = self.move.astype(np.float32)
        while at < len(order):
            longest = max(1, len(scores[order[at]]))
            part = order[at : at + max(1, 60_000 // longest)]
            at += len(part)
            size = np.array([len(scores[k]) for k in part])
            score = np.zeros((longest, len(part), len(LABELS)), np.float32)
            for n, k in enumerate(part):
                score[: size[n], n] = scores[k]
            best = score[0] + np.where([x[0] == "I" for x in LABELS], np.float32(-1e4), np.float32(0))
            back = np.zeros(score.shape, np.int8)
            active = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than t
            for t in range(1, longest):
                n = active[t]
                both = best[:n, :, None] + move
                back[t, :n] = both.argmax(axis=1)
                best[:n] = both.max(axis=1) + score[t, :n]
                if not t % 4096:  # only differences matter
                    best -= best.max(axis=1, keepdims=True)
            label = best.argmax(axis=1)
            path = np.zeros((longest, len(part)), np.int8)
            for t in range(longest - 1, -1, -1):
                n = active[t]
                path[t, :n] = label[:n]
                label[:n] = back[t, np.arange(n), label[:n]]
            for n, k in enumerate(part):
                out[k] = path[: size[n], n]
        return out


@lru_cache(1)
def field() -> Field:
    return Field(examples())


def stretches(text: str) -> list[tuple[int, int]]:
    """Where the field is applied: words with a digit and some text on either side, joined where they meet."""
    out: list[list[int]] = []
    at = 0
    while digit := _DIGIT.search(text, at):
        # the word around the digit, by looking back no further than where the last word ended
        begin = digit.start()
        while begin > at and not text[begin - 1].isspace():
            begin -= 1
        at = end = _SOLID.match(text, digit.start()).end()
        a, b = max(0, begin - 40), min(len(text), end + 24)
        low = out[-1][1] if out else 0
        while low < a < begin and not text[a - 1].isspace():
            a += 1
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def added_spans(texts: list[str], base: list[list[Span]], own: Field) -> list[list[Span]]:
    where, scores, tokens = [], [], []
    for k, text in enumerate(texts):
        for a, b in stretches(text):
            found = np.fromiter((x for m in _TOKEN.finditer(text, a, b) for x in m.span()), np.int64).reshape(-1, 2)
            if len(found):
                where.append(k)
                tokens.append(found)
                scores.append(own.emissions(text, found))
    out: list[list[Span]] = [[] for _ in texts]
    for k, found, labels in zip(where, tokens, own.decode(scores) if scores else []):
        for first in np.flatnonzero(labels).tolist():
            kind = LABELS[labels[first]]
            if kind[0] == "I" and first and labels[first - 1] and LABELS[labels[first - 1]][2:] == kind[2:]:
                continue  # within a span
            end = first + 1
            while end < len(found) and LABELS[labels[end]] == "I-" + kind[2:]:
                end += 1
            a, b = int(found[first, 0]), int(found[end - 1, 1])
            if _DIGIT.search(texts[k], a, b):
                out[k].append((_OF[kind[2:]], a, b))
        if out[k] and base[k]:
            starts = sorted((x, y) for _, x, y in base[k])
            reach = np.maximum.accumulate([y for _, y in starts])
            begins = [x for x, _ in starts]
            out[k] = [s for s in out[k] if not (n := bisect_left(begins, s[2])) or reach[n - 1] <= s[1]]
    return out


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, added): arrays of (kind, start, end), by kind and start."""
    sent = docs.sparkSession.sparkContext.broadcast(field())

    def make():
        def step(part: pa.RecordBatch) -> dict:
            texts = [x or "" for x in part.column(1).to_pylist()]
            base = [base_spans(x) for x in texts]
            named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]
            return {"id": part.column(0), "base": list(map(named, base)), "added": list(map(named, added_spans(texts, base, sent.value)))}

        return step

    span = "array<struct<kind: string, start: long, end: long>>"
    return map_slices(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), make, f"id long, base {span}, added {span}").withColumnRenamed("id", id)


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(spelled(spans).encode()).hexdigest()
