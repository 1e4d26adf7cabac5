"""Each operator against a brute-force version, an exact round trip or accuracy on rows that it has not learnt from."""

import base64
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from runeloom.llm import byte_bpe, decontaminate, exact_dedup, language_id, license_scan, near_dup, pii, quality, queries, token_count, warc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def by_id(df):
    return {r[0]: r for r in df.collect()}


def crc(n, mod):
    return zlib.crc32(str(n).encode()) % mod


ODD = ["", None, " ", "\t\n", "a", "é", "日本語 text", "\U0001f600\U0001f468‍\U0001f469", "x" * 3000, "  two  spaces ", "▁under▁", "don't it's", "1234567 12", "\r\n\r\n a\n", "<s></s><unk>", "é", "\x00a\x00", "<|endoftext|>", "-" * 500 + "=" * 77, "ßüñ " * 40]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, percent=80):
    """Component of each id by comparing all pairs."""
    sets = {k: shingles(t, n) for k, t in rows}
    parent = {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * (same := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {k: top(k) for k in ids}, {k: len(v) for k, v in sets.items()}


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op1_language_id(spark, SF).collect()
    assert len(got) == len(truth) and all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    judged = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(judged) >= 0.95 * len(judged) > 100


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_cross_parsing_against_substrings(monkeypatch, block):
    """Phrases by the automaton are those that searching the training text for substrings gives, wherever texts are cut into blocks."""
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = random.Random(4)
    for _ in range(20):
        samples = {k: "".join(rng.choice("ab ") for _ in range(rng.choice([3, 60, 300]))).strip() or "a" for k in "xy"}
        own = language_id.Model(samples)
        texts = ["".join(rng.choice(rng.choice(["abc ", "ab", "a"])) for _ in range(rng.randint(0, 200))) for _ in range(3)] + [samples["x"] * 3]
        check_phrases(own, samples, texts)


def test_cross_parsing_of_long_texts():
    """Texts of many blocks, among them copies of the training text, in which a phrase is longer than a block."""
    rng = random.Random(9)
    samples = {k: "".join(rng.choice(letters) for _ in range(4000)).strip() for k, letters in (("x", "abcd "), ("y", "abef "))}
    texts = ["q" + samples["x"] * 2, "".join(rng.choice("abcdefq ") for _ in range(5000)), "a" * 3000, samples["y"][:2500] + "é" + samples["x"]]
    check_phrases(language_id.Model(samples), samples, texts)


def check_phrases(own, samples, texts):
    bits, size = own.entropies(texts)
    for i, text in enumerate(texts):
        code = language_id.symbols([text], own.codes)[0].tolist()
        for k, lang in enumerate(own.languages):
            train = bytes(language_id.symbols([samples[lang]], own.codes)[0].tolist())
            assert bits[k, i] == pytest.approx(phrases(code, train) * own.bits[k] / size[i] if size[i] else 0)


def phrases(code, train):
    """A symbol that the training text lacks ends a phrase wherever it stands."""
    n, held = 1, b""
    for c in code:
        if held + bytes([c]) in train:
            held += bytes([c])
        else:
            n, held = n + 1, bytes([c]) if bytes([c]) in train else b""
    return n


def test_language_sample(spark, monkeypatch):
    """Whole texts are learnt, as many as the bounds allow, and nothing of others; a repeated row once; the shortest if none fits."""
    monkeypatch.setattr(language_id, "CHARACTERS", 1000)
    rows = [(k, f"text {k} " * 20, "en") for k in range(40)] + [(3, "text 3 " * 20, "en")] * 5 + [(100, "lang " * 900, "de"), (101, "länger " * 300, "de"), (None, "x", "en"), (102, None, "en"), (103, "y", None), (104, "", "fr")]
    learnt = dict(language_id.learn(table(spark, rows, "doc_id long, text string, lang string")))
    assert learnt["de"] == "länger " * 300 and learnt["fr"] == ""
    found = learnt["en"].split("  ")
    assert 5 <= len(set(re.findall(r"\d+", learnt["en"]))) and len(learnt["en"]) <= 1010
    assert all(x.strip() in {t.strip() for _, t, _ in rows if t} for x in found)
    assert round(2 ** language_id.Model({"en": "abc" * 50_000}).bits[0]) == 150_000


def test_language_accepts_prose_with_a_secret_and_no_noise(spark):
    """Prose that holds a key stays; letters in no order, other scripts and texts without letters go; short texts with letters stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    learnt = language_id.learn(docs)
    rng = random.Random(2)
    prose = docs.where("lang = 'en' AND length(text) > 300").orderBy("doc_id").first().text
    draw = lambda letters, n=300: "".join(rng.choice(letters) for _ in range(n))
    rows = [(1, prose[:70] + " AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16) + " " + prose[70:90]), (2, draw("abcdefghijklmnopqrstuvwxyz")), (3, draw("абвгдежзиклмнопрст ")), (4, "1234 !!"), (5, None), (6, "xq"), (None, prose)]
    assert {r.doc_id for r in language_id.accepted(table(spark, rows), learnt).collect()} == {1, 6, None}
    assert {r.doc_id for r in language_id.accepted(table(spark, rows), ()).collect()} == {1, 2, 3, 4, 5, 6, None}


def test_language_query_against_substrings(spark):
    """Predictions of the query are those of searching all that was learnt for substrings."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learnt = dict(language_id.learn(docs.where(~(queries.fold_of("doc_id", 4) == 2))))
    own = language_id.Model(learnt)
    train = {x: bytes(language_id.symbols([t], own.codes)[0].tolist()) for x, t in learnt.items()}
    rows = docs.where("length(text) BETWEEN 40 AND 900").orderBy("doc_id").limit(25).collect()
    got = by_id(queries.op1_language_id(spark, SF))
    for r in rows:
        code = language_id.symbols([r.text], own.codes)[0].tolist()
        bits = {x: phrases(code, t) * own.bits[own.languages.index(x)] / len(code) for x, t in train.items()}
        best = min(sorted(bits), key=bits.get)
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].bits == pytest.approx(bits[best])
        assert got[r.doc_id].score == pytest.approx(1 / sum(2 ** (-4 * (b - bits[best])) for b in bits.values()))


def test_language_odd_texts(spark):
    got = by_id(language_id.identify(table(spark, list(enumerate(ODD))), (("de", "der hund ist"), ("en", "the dog is"))))
    assert len(got) == len(ODD)
    for k, x in enumerate(ODD):
        assert (got[k].lang_pred == "und") == (not any(c.isalpha() for c in x or "")), x
    assert {r.lang_pred for r in language_id.identify(table(spark, [(1, "abc")]), ()).collect()} == {"und"}
    assert language_id.learn(table(spark, [], "doc_id long, text string, lang string")) == ()


def test_bpe_as_the_library(spark):
    ranks = byte_bpe.ranks_of(open(RANKS, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(150).collect()]
    encoded = byte_bpe.encode(table(spark, list(enumerate(texts))), RANKS, public_tokenizers.PATTERN)
    got = by_id(byte_bpe.decode(encoded, RANKS))
    for k, x in enumerate(texts):
        assert list(got[k].token_ids) == library.encode_ordinary(x or ""), x
        assert bytes(got[k].content) == (x or "").encode()
    both = byte_bpe.encode(table(spark, list(enumerate(texts))), RANKS, public_tokenizers.PATTERN, decoded=True)
    assert {k: (list(r.token_ids), bytes(r.content)) for k, r in by_id(both).items()} == {k: (list(r.token_ids), bytes(r.content)) for k, r in got.items()}
    small = byte_bpe.Encoder(byte_bpe.Merges(ranks), public_tokenizers.PATTERN, cached=3)
    flat, bounds = small.encode(["a b c d e", "f g h"])
    assert flat[bounds[0] : bounds[1]].tolist() == library.encode_ordinary("a b c d e")
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [10**8])], "doc_id long, token_ids array<int>"), RANKS).collect()


def test_bpe_query(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = queries.op2_byte_bpe(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(rows[r.doc_id].encode()).hexdigest())


def test_patience_alignment():
    assert license_scan.aligned(list("abcde"), list("xabqcdey")) == [(0, 1), (1, 2), (2, 4), (3, 5), (4, 6)]
    assert license_scan.aligned([], list("a")) == []
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = license_scan.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert license_scan.aligned(a, a) == [(i, i) for i in range(len(a))]


def test_license_scan(spark):
    templates = [("X", "permission is hereby granted free of charge to any person obtaining a copy"), ("Y", "all rights are reserved by the authors of this work")]
    body = templates[0][1]
    edited = body.replace("hereby ", "")
    rows = [(1, "é Intro. " + body.upper() + "! End"), (2, "say " + edited), (3, body[:30]), (4, None), (5, ""), (6, body + "\n" + templates[1][1]), (7, body + " x " + body), (8, "word " * 5000)]
    got = {k: [(x.license, x.start, x.end) for x in r.licenses] for k, r in by_id(license_scan.scan(table(spark, rows), templates)).items()}
    assert got[1] == [("X", 9, 9 + len(body))] and got[2] == [("X", 4, 4 + len(edited))]
    assert got[3] == got[4] == got[5] == got[8] == [] and [x[0] for x in got[6]] == ["X", "Y"]
    assert got[7] == [("X", 0, len(body)), ("X", len(body) + 3, 2 * len(body) + 3)]
    with pytest.raises(ValueError):
        license_scan.scan(table(spark, rows), [("Z", "x" * (license_scan.TEMPLATES + 1))])


@pytest.mark.parametrize("between", ["", "and", "so it is", "one two three four five six"])
def test_license_copies_close_together(spark, between):
    """Each of several adjacent copies is found alone, edited ones too."""
    notice = "Licensed under the Apache License, Version 2.0."
    edited = "Licensed under the Apache License, Release 2.0."
    rows, expected = [], {}
    for n in range(1, 11):
        for k, each in enumerate(([notice] * n, [notice, edited] * n)):
            text, spans = "Some prose of the author stands before it. ", []
            for x in each:
                spans.append((len(text), len(text) + len(x) - 1))
                text += x + " " + between + " "
            rows.append((2 * n + k, text + "And some more prose stands after it."))
            expected[2 * n + k] = spans
    got = by_id(license_scan.scan(table(spark, rows), [("Apache-2.0", notice)]))
    assert {k: [(x.start, x.end) for x in r.licenses] for k, r in got.items()} == expected


def test_license_scan_against_all_windows(spark):
    """A document has a passage where alignment with every window of words finds one, whatever was edited."""
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(40)]
    templates = [("A", [f"a{k}" for k in range(14)]), ("B", [rng.choice(vocabulary) for _ in range(30)])]
    rows, want = [], {}
    for k in range(150):
        own = []
        for _ in range(rng.choice([0, 1, 1, 2])):
            own += [rng.choice(vocabulary) for _ in range(rng.randint(0, 15))]
            _, body = rng.choice(templates)
            rate = rng.choice([0, 0.05, 0.1, 0.2])
            edits = [(w, rng.choice(vocabulary), rng.random()) for w in body]
            own += [y for w, other, draw in edits for y in ([] if draw < rate / 3 else [w, other] if draw < rate * 2 / 3 else [other] if draw < rate else [w])]
        own += [rng.choice(vocabulary) for _ in range(rng.randint(0, 15))]
        rows.append((k, " ".join(own)))
        want[k] = {name for name, body in templates if any(len(license_scan.aligned(body, own[i:j])) >= 0.8 * len(body) for i in range(len(own)) for j in range(i + len(body) * 4 // 5, min(len(own), i + 2 * len(body)) + 1))}
    got = {r.doc_id: {x.license for x in r.licenses} for r in license_scan.scan(table(spark, rows), [(name, " ".join(body)) for name, body in templates]).collect()}
    assert all(got[k] <= want[k] for k in want)
    assert sum(len(got[k]) for k in want) >= 0.97 * sum(map(len, want.values())) > 60


def test_license_scan_of_long_and_repeated_texts(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    long = "word " * 200_000 + notice + " " + "licensed under the " * 20_000 + notice
    rows = [(1, long), (2, notice), (2, notice), (2, None), (None, notice)]
    got = sorted((r.doc_id or 0, [(x.start, x.end) for x in r.licenses]) for r in license_scan.scan(table(spark, rows)).collect())
    one = [(0, len(notice) - 1)]
    assert got[0] == (0, one) and got[2:] == [(2, []), (2, one), (2, one)]
    assert got[1][1][0] == (1_000_000, 1_000_000 + len(notice) - 1) and got[1][1][-1][1] == len(long) - 1


def test_license_texts(spark, tmp_path):
    """The query finds license texts and file headers, and tells a text from those that hold most of it."""
    known = license_scan.texts()
    rows = [(k, f"Copyright 2020 A. Author\n\n{x}\n\nint main() {{ return 0; }}") for k, (_, x) in enumerate(known)]
    rows += [(100 + k, "".join("# " + line + "\n" for line in x.splitlines()) + "import os") for k, (_, x) in enumerate(known)]
    rows += [(200, "The MIT License was chosen, and the terms of the license apply to all copies of the software."), (201, "word " * 3000)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(queries.op3_license_scan(spark, str(tmp_path)))
    assert len({name for name, _ in known}) > 20
    for k, (name, _) in enumerate(known):
        assert (got[k].license, got[100 + k].license, got[k].n_licenses, got[100 + k].n_licenses) == (name, name, 1, 1)
    assert got[200].n_licenses == got[201].n_licenses == 0


def test_license_query_finds_every_notice(spark):
    """Every notice that stands word for word in a document is found."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = by_id(queries.op3_license_scan(spark, SF))
    form = lambda x: " " + " ".join(re.findall("[a-z0-9]+", x.lower())) + " "
    notices = [form(x) for _, x in license_scan.NOTICES]
    holding = [r.doc_id for r in rows if any(x in form(r.text or "") for x in notices)]
    assert len(got) == len(rows) and holding and all(got[k].n_licenses > 0 for k in holding)


def smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_against_a_table():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        score, _ = decontaminate._align(np.array([a], np.int32), np.array([b], np.int32))
        assert score[0] == smith_waterman(a, b)
    for _ in range(20):
        pairs = [[[rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2)] for _ in range(7)]
        codes = [np.concatenate([x[k] for x in pairs]).astype(np.int32) for k in range(2)]
        sizes = [np.array([len(x[k]) for x in pairs]) for k in range(2)]
        a, b = (decontaminate._padded(c, np.cumsum(n) - n, n, fill) for c, n, fill in zip(codes, sizes, (-2, -3)))
        assert decontaminate._scores(a, b).tolist() == [smith_waterman(*x) for x in pairs]


def test_leaks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(30)]
    edited = [w if k % 7 else word() for k, w in enumerate(item)]
    docs = [(1, " ".join([word() for _ in range(200)] + item)), (2, "é " + " ".join(edited)), (3, " ".join(word() for _ in range(300))), (4, None), (5, ""), (6, " ".join(item[:4] + [word() for _ in range(40)])), (7, " ".join(item)), (7, " ".join(item)), (None, " ".join(item))]
    items = spark.createDataFrame([(10, " ".join(item).upper()), (11, "two words"), (12, None), (13, " ".join(word() for _ in range(20)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(table(spark, docs), items).collect()}
    assert set(got) == {(1, 10), (2, 10), (7, 10), (None, 10)}
    assert got[1, 10].score == 1 and docs[0][1][got[1, 10].start : got[1, 10].end] == " ".join(item)
    assert got[2, 10].score == pytest.approx(smith_waterman(item, edited) / 60)
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.clean(table(spark, docs), items).collect() if r.text) == sorted((k or 0, t) for k, t in docs if t and k in (3, 5, 6))
    assert {r.doc_id for r in decontaminate.clean(table(spark, docs), items).collect()} == {3, 4, 5, 6}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, [(1, docs[0][1])]), items.selectExpr("CAST(NULL AS long) item_id", "text")).collect()} == {(1, None)}
    assert decontaminate.leaks(table(spark, docs), items, block=1).count() == len(got)
    assert decontaminate.leaks(table(spark, docs), items.where("false")).count() == 0
    assert decontaminate.leaks(table(spark, []), items).count() == 0


def edited_corpus(n, rate, seed):
    """Documents of which some hold a copy of an item: with words replaced, put in and left out, two long insertions, or one half."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]
    prose = lambda m: rng.choices(vocabulary, weights, k=m)
    items, docs = [prose(rng.randint(8, 60)) for _ in range(20)], []
    for k in range(n):
        body = prose(rng.randint(20, 120))
        if k % 5 == 0:
            item, kind, own = rng.choice(items), rng.randrange(5), []
            for j, w in enumerate(item):
                draw = rng.random()
                if kind == 0:
                    own += prose(1) if draw < rate else [w]
                elif kind == 1:
                    own += [] if draw < rate / 3 else [w, *prose(1)] if draw < 2 * rate / 3 else prose(1) if draw < rate else [w]
                elif kind == 2:
                    own += prose(1) if j % 3 == 2 else [w]
                elif kind == 3:
                    own += [w, *(prose(8) if j in (len(item) // 3, 2 * len(item) // 3) else [])]
                elif j <= len(item) // 2:
                    own.append(w)
            at = rng.randint(0, len(body))
            body[at:at] = own
        docs.append(" ".join(body))
    return [" ".join(x) for x in items], docs


@pytest.mark.parametrize("n", [10, 1500, 3000])
@pytest.mark.parametrize("rate", [0.1, 0.2, 0.3])
def test_leaks_against_alignments_of_all_pairs(spark, n, rate):
    """Of all pairs of a document and an item that align well enough at least 0.9 are found, however many documents there are."""
    items, docs = edited_corpus(n, rate, n + int(10 * rate))
    own, words = decontaminate.Items(list(range(len(items))), items), decontaminate.Words(pa.array(docs), decontaminate.ALNUM)
    want = set()
    for i, size in enumerate(np.diff(own.from_)):
        for at in range(0, n, 500):
            part = np.arange(at, min(n, at + 500))
            a = decontaminate._padded(own.codes, np.repeat(own.from_[i], len(part)), np.repeat(size, len(part)), -2)
            score = decontaminate._scores(a, decontaminate._padded(own.codes_of(words), words.from_[part], np.diff(words.from_)[part], -3))
            want |= {(int(k), i) for k in part[score >= 0.4 * 2 * size]}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, list(enumerate(docs))), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and want


def test_leaks_with_few_seeds_in_common(spark):
    """Two insertions of eight words, every third word replaced, a word put in between all: each is found, alone or among many documents."""
    item = [f"w{k}" for k in range(24)]
    gaps = [y for k, w in enumerate(item) for y in ([w] + [f"x{k}{j}" for j in range(8)] * (k in (8, 16)))]
    docs = [(1, " ".join(gaps)), (2, " ".join(f"x{k}" if k % 3 == 2 else w for k, w in enumerate(item))), (3, " ".join(y for k, w in enumerate(item) for y in (w, f"x{k}")))]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for more in (0, 1500):
        rows = docs + [(10 + k, f"other {k} words") for k in range(more)]
        got = {r.doc_id: r.score for r in decontaminate.leaks(table(spark, rows), items).collect()}
        assert got == {k: pytest.approx(smith_waterman(item, t.split()) / 48) for k, t in docs}


def test_leaks_in_very_long_texts(spark):
    """A long document with many copies, and a long item with a long passage: no more memory than a few rows of the alignment."""
    item = [f"w{k % 700}x{k}" for k in range(1500)]
    docs = [(1, " ".join((item[:40] + ["y"] * 60) * 400)), (2, " ".join(["z"] * 30_000 + item))]
    items = spark.createDataFrame([(1, " ".join(item[:40])), (2, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(table(spark, docs), items).collect()}
    assert set(got) == {(1, 1), (2, 1), (2, 2)} and all(r.score == 1 for r in got.values()) and got[1, 1].start == 0 and got[2, 2].start == 60_000


def test_leaks_that_are_everywhere(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    got = decontaminate.leaks(table(spark, [(k, f"d{k} {item}") for k in range(300)]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.count() == 300


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_all_pairs(spark, n):
    rng = random.Random(n)
    rows, base = [], [[f"w{rng.randint(0, 300)}" for _ in range(60)] for _ in range(12)]
    for k in range(150):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            own[rng.randrange(len(own))] = f"w{rng.randint(0, 300)}"
        rows.append((k, " ".join(own)))
    common = " ".join(f"c{k}" for k in range(40))  # unlike documents with one passage
    rows += [(200 + k, common + " " + " ".join(f"u{k}x{j}" for j in range(20 + k))) for k in range(25)]
    rows += [(300, None), (301, ""), (302, " \t"), (303, "one"), (304, "ONE"), (305, "two words"), (306, "Two\nWords"), (307, "a b c d e"), (308, "é" * 4000)]
    component, size = components(rows, n)
    got = by_id(near_dup.near_duplicates(table(spark, rows), shingle=n))
    assert {k: r.component_id for k, r in got.items()} == component
    assert {k: r.n_shingles for k, r in got.items()} == size
    assert all(r.kept == (r.component_id == k) for k, r in got.items())


def test_near_duplicates_chain(spark):
    """A chain of small steps is one component, as large groups of copies are."""
    own, rows = [f"w{k}" for k in range(100)], []
    for k in range(40):
        rows.append((1000 - k, " ".join(own)))
        own[k * 2] = f"x{k}"
    rows += [(2000 + k, rows[0][1]) for k in range(200)]
    got = near_dup.near_duplicates(table(spark, rows), shingle=2).collect()
    assert {r.component_id for r in got} == set(components(rows[:40], 2)[0].values()) and len(got) == 240


def test_near_duplicates_of_null_ids_and_nothing(spark):
    got = near_dup.near_duplicates(table(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c")]), shingle=2).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got) == [(False, 1, True), (False, 1, True), (True, None, True)]
    assert near_dup.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("partitions", ["2", "60"])
def test_near_duplicates_with_hot_groups(spark, partitions):
    """A large group of near copies, a passage in very many unlike documents and one hub, where joins deal out frequent keys and where they don't."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(120):
        own = list(base)
        own[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(own)))
    common = " ".join(f"c{k}" for k in range(30))
    rows += [(200 + k, common + " " + " ".join(f"u{k}x{j}" for j in range(6 + k % 9))) for k in range(80)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = by_id(near_dup.near_duplicates(table(spark, rows + [(k, rows[0][1]) for k in range(400, 500)]), shingle=2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    component, size = components(rows, 2)
    assert {k: (r.component_id, r.n_shingles) for k, r in got.items() if k < 400} == {k: (component[k], size[k]) for k in component}
    assert all(r.component_id == 0 for k, r in got.items() if k >= 400)


def test_near_duplicates_of_one_id_with_two_texts(spark):
    """Rows that share an id are one node."""
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, one), (5, one + " end"), (5, two), (9, two + " end"), (7, "quite another text")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dup.near_duplicates(table(spark, rows), shingle=2).collect()}
    assert got == {(3, 29): 3, (5, 30): 3, (5, 29): 3, (9, 30): 3, (7, 2): 7}


def test_words_that_collide_modulo_a_power_of_two(spark):
    """Words whose polynomials are equal modulo 2 ** 64 for every odd base aren't one word."""
    form = lambda n, a, b: "".join(b if bin(i).count("1") % 2 else a for i in range(n))
    one, two = form(2048, "a", "b"), form(2048, "b", "a")
    got = by_id(near_dup.near_duplicates(table(spark, [(1, one), (2, two)]), shingle=1))
    assert (got[1].component_id, got[2].component_id) == (1, 2)


def test_circulant_signature():
    """Coordinate k is the least shifted place over the set, and equal sets agree whatever the slices."""
    own = near_dup._permutation()
    assert sorted(own[: near_dup.PLACES].tolist()) == list(range(near_dup.PLACES))
    values = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    one = near_dup.band_keys(values, np.array([0, 3000]), own)
    two = near_dup.band_keys(np.append(values[:5], values), np.array([0, 5, 3005]), own)
    assert (one[0] == two[1]).all() and (two[0] != two[1]).any()


# The patterns as the contract words them; without possessive forms, for short texts.
EMAIL, PHONE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IP, CARD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([ -]?[0-9])+")


def brute_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_patterns():
    rng = random.Random(5)
    for _ in range(30_000):
        text = "".join(rng.choice(["1", "4", "42", "255", "256", ".", ".", "-", " ", "+", "@", "a", "b.", "(", ")", "4111 1111 1111 1111", "é", "x@y.z", "+1 (555) 123-4567", "%"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == sorted(brute_spans(text)), text


def test_pii_query(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op6_pii(spark, SF).collect()
    assert len(got) == len(rows)
    added = 0
    for r in got:
        want = sorted(brute_spans(rows[r.doc_id]))
        spelled = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in want) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(filter(None, spelled.split(","))) <= set(every)
        added += len(every) - len(want)
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in (x.split(":") for x in every)]
        assert order == sorted(order)
    assert added > 0


def test_field_on_examples_that_it_has_not_seen():
    own = pii.field()
    table_ = pii.examples(seed=77, count=300)
    texts = [t for t, _ in table_]
    got = pii.added_spans(texts, [pii.base_spans(t) for t in texts], own)
    want = {(k, a, b) for k, (_, spans) in enumerate(table_) for _, a, b in spans}
    have = {(k, a, b) for k, spans in enumerate(got) for _, a, b in spans}
    assert len(want & have) >= 0.9 * len(want) and len(want & have) >= 0.85 * len(have)


def test_viterbi_against_all_paths():
    own = pii.Field(pii.examples(seed=9, count=60), rounds=10)
    from itertools import product

    tokens = np.array([m.span() for m in pii._TOKEN.finditer("tel 555-1234")])
    score = own.emissions("tel 555-1234", tokens)
    got = own.decode([score, score[:2], score[:0]])[0].tolist()
    first = np.where([x[0] == "I" for x in pii.LABELS], -1e4, 0)
    total = lambda p: first[p[0]] + sum(score[t, y] for t, y in enumerate(p)) + sum(own.move[a, b] for a, b in zip(p, p[1:]))
    assert total(got) == pytest.approx(max(map(total, product(range(len(pii.LABELS)), repeat=len(tokens)))))


def test_field_in_parts(monkeypatch):
    """Features named for a few tokens at a time give the same scores, and all sequences the same labels alone or together."""
    own = pii.field()
    texts = [t for t, _ in pii.examples(seed=5, count=40)] + [" ".join(t for t, _ in pii.examples(seed=6, count=60))]
    tokens = [np.array([m.span() for m in pii._TOKEN.finditer(t)]) for t in texts]
    whole = [own.emissions(t, x) for t, x in zip(texts, tokens)]
    monkeypatch.setattr(pii, "FEATURED", 5)
    assert all((own.emissions(t, x) == y).all() for t, x, y in zip(texts, tokens, whole))
    assert all((a == own.decode([y])[0]).all() for a, y in zip(own.decode(whole), whole))


def test_pii_in_very_long_texts():
    """A long run of letters before a digit, and a long list of numbers: time and memory grow with the length alone."""
    import time
    import tracemalloc

    own = pii.field()
    began = time.time()
    for text in ("a" * 1_000_000 + "1", "1" + "b" * 1_000_000, "a" * 1_000_000 + " tel (555) 123-4567 now", "é-" * 500_000 + "7"):
        assert pii.stretches(text)
        pii.added_spans([text], [pii.base_spans(text)], own)
    assert time.time() - began < 300  # in quadratic time each would take hours
    numbers = "12.5,17.25,801\n" * 8000 + "tel (555) 123-4567 now"  # some 70,000 tokens
    tracemalloc.start()
    got = pii.added_spans([numbers], [[]], own)[0]
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert (3, len(numbers) - len("(555) 123-4567 now"), len(numbers) - 4) in got


def test_added_spans_in_texts_of_others(spark):
    """Of phones and secrets as the documents hold them, which no example was made from, at least 0.9 are found whole."""
    form = re.compile(r"\(\d{3}\) \d{3}-\d{4}|(?<=token = \")[0-9a-f]{40}(?=\")")
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = {(k, m.start(), m.end()) for k, t in rows.items() for m in form.finditer(t) if not re.search(r"\+[0-9][ ().0-9-]*$", t[max(0, m.start() - 20) : m.start()])}
    got = {(r.doc_id, x.start, x.end) for r in pii.find(spark.read.parquet(f"{SF}/documents.parquet")).collect() for x in r.added}
    assert want and len(want & got) >= 0.9 * len(want)


def test_pii_odd_texts(spark):
    rows = list(enumerate([*ODD, "1" * 5000, "a@" * 3000, "+1" * 2000, "0" * 13, "mail a.b@c.de, 10.0.0.1"]))
    got = by_id(pii.find(table(spark, rows)))
    assert len(got) == len(rows) and [x.kind for x in got[len(rows) - 1].base] == ["email", "ip"] and not got[0].base and not got[1].added


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 1200
    rows = [(1, "http://a/ b", long), (2, "http://b", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "€" * 70_000), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n"), (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "y" * 1000), (12, "u", "y" * 1000), (12, "u", "y" * 1000), (None, "u", "z" * 2000), (None, "u", "y" * 1000)]
    pages = table(spark, rows, PAGES)
    got = warc.archived(pages, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    html = {}
    for k, _, x in rows:
        html.setdefault(k, []).append((x or "").encode())
    for r in got:
        assert (r.payload_bytes, r.payload_digest) in {(len(x), hashlib.sha1(x).hexdigest()) for x in html[r.page_id]}
    kind = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(1, "revisit", 2), (2, "response", None), (9, "response", None), (10, "response", None), (11, "revisit", 12), (12, "response", None), (None, "revisit", 12), (None, "response", None)} <= kind
    back = {r.id: bytes(r.payload).decode() for r in warc.read(spark, str(tmp_path / "a")).where("type = 'response'").collect()}
    assert "€" * 70_000 in back.values() and rows[7][2] in back.values()
    assert warc.archived(pages.where("false"), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("partitions", ["4", "64"])
def test_warc_of_one_hot_page(spark, partitions):
    """A page of which a third of all rows are copies, short and long, on few partitions and on many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(k, "u", "hot " * 400 if k % 3 == 0 else f"page {k // 7} " * (200 if k % 2 else 2)) for k in range(900)] + [(None, "u", "hot " * 400)]
        got = {r.page_id: r for r in warc.archived(table(spark, rows, PAGES)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    largest = {}
    for k, _, x in rows:
        if k is not None and len(x) >= 1000:
            largest[x] = max(k, largest.get(x, k))
    for k, _, x in rows:
        first = largest.get(x, k)
        assert got[k][1:] == (len(x), hashlib.sha1(x.encode()).hexdigest(), "response" if k == first else "revisit", None if k == first else first)


def test_archives_of_others(spark, tmp_path):
    """Gzip members by record, other record types and names, a digest in base 32, a plain body and line ends after the last record."""
    import gzip

    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\xc3\xa9</p>"
    record = lambda kind, name, body, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    parts = [record("warcinfo", "a", b"software: other\r\n"), record("request", "b", b"GET / HTTP/1.1\r\n\r\n"), record("response", "c", block, "WARC-Payload-Digest: sha1:ABCDEF\r\n"), record("metadata", "d", b"")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "crawl-00.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "w" / "crawl-01.warc").write_bytes(b"".join(parts).replace(b"uuid:c", b"uuid:e") + b"\r\n")
    assert {r.type for r in warc.read_records(spark, str(tmp_path / "w")).collect()} == {"warcinfo", "request", "response", "metadata"}
    assert sorted((r.id, r.type, bytes(r.payload).decode()) for r in warc.read(spark, str(tmp_path / "w")).collect()) == [("urn:uuid:c", "response", "<p>é</p>"), ("urn:uuid:e", "response", "<p>é</p>")]


def test_every_file_of_an_archive_begins_with_a_description(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 10)
    warc.write(table(spark, [(k, "u", f"page {k}") for k in range(95)], PAGES), str(tmp_path / "w"))
    files = list((tmp_path / "w").glob("part-*"))
    kinds = [[f["warc-type"] for f, _ in warc.parse(p.read_bytes())] for p in files]
    assert len(files) > 9 and all(x[0] == "warcinfo" and set(x[1:]) == {"response"} and len(x) <= 10 for x in kinds) and sum(len(x) - 1 for x in kinds) == 95


def test_broken_archives():
    def all_of(*a, **k):
        return b"".join(x + b"\r\n\r\n" for x in warc.records_of(*a, **k))

    data = all_of("urn:page:1:row0", "u", b"p" * 300, "d", None, segment=128)
    kinds = [f["warc-type"] for f, _ in warc.parse(data)]
    assert kinds[0] == "response" and set(kinds[1:]) == {"continuation"} and len(kinds) > 2
    for broken in (data[:-3], b"x" + data, data.replace(b"Content-Length: 1", b"Content-Length: 2", 1)):
        with pytest.raises((ValueError, KeyError)):
            list(warc.parse(broken))
    for size in (4, 5, 100):
        assert warc.unframed(warc.framed("aé€\U0001f600".encode() * 9, size)) == "aé€\U0001f600".encode() * 9
    with pytest.raises(ValueError):
        warc.unframed(b"5\r\nab")


def test_missing_segments(spark, tmp_path):
    parts = [x.decode() for x in warc.records_of("urn:page:1:row0", "u", b"p" * 300, "d", None, segment=128)]
    spark.createDataFrame([(x,) for x in parts[:1] + parts[2:]], "record string").coalesce(1).write.option("lineSep", warc.END).text(str(tmp_path / "w"))
    with pytest.raises(Exception, match="lacks a segment"):
        warc.read(spark, str(tmp_path / "w")).collect()


@pytest.mark.parametrize("sampled", [20_000, 40])
def test_exact_duplicates(spark, monkeypatch, sampled):
    monkeypatch.setattr(exact_dedup, "SAMPLED", sampled)  # few rows are seen, or all of them
    rng = random.Random(6)
    rows = [(k, rng.choice(["same text", "same  text", "s\tametext\n", None, "", " ", "é", f"own {k}", "h" * 70 + str(k % 3), "h" * 9000])) for k in range(600)] + [(5, "same text"), (None, "same  text"), (None, None)]
    groups = {}
    for k, x in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x or ""), []).append((-len(x or ""), k is None, k or 0))
    want = []
    for k, x in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", x or "")
        keep = min(groups[norm])[2]
        want.append((k, keep, len(groups[norm]), k == keep, hashlib.sha256(norm.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("sampled", [20_000, 40])
def test_distinct_rows(spark, monkeypatch, sampled):
    """One row of each group stays, whole, also where ids repeat or are null and where texts are frequent."""
    monkeypatch.setattr(exact_dedup, "SAMPLED", sampled)
    rng = random.Random(8)
    rows = [(k if k % 5 else None if k % 2 else 7, rng.choice(["same text", "same  text", None, "", " ", f"own {k % 90}", "h" * 70 + str(k % 3)]), k) for k in range(700)]
    got = exact_dedup.distinct_rows(table(spark, rows, "doc_id long, text string, extra int")).collect()
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]", "", x or "")
    groups = {}
    for k, x, e in rows:
        groups.setdefault(norm(x), []).append((-len(x or ""), k is None, k or 0))
    assert len(got) == len(groups) and all(tuple(r) in set(rows) for r in got)
    assert {norm(r.text): (-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in got} == {x: min(g) for x, g in groups.items()}
    assert exact_dedup.distinct_rows(table(spark, [])).count() == 0


def test_exact_duplicates_run_no_python(spark):
    plan = exact_dedup.exact_duplicates(table(spark, [(1, "a"), (2, "a")])).where("true")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op9_quality(spark, SF).collect()
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    judged = [r.predicted == labels[r.doc_id] for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert len(judged) > 50 and sum(judged) >= 0.85 * len(judged)


def test_quality_votes_against_all_cosines():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["Abc def. ", "XX 12 ", "a-b ", "zz\n"]) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    own = quality.Model.of(texts[:80], [k % 2 for k in range(80)])
    got = own.score(pa.array(texts[80:] + ["", None]))
    row, kind, part = quality.terms(pa.array(texts[80:]))
    vectors = own._unit(own._matrix(row, kind, part, 40) @ own.space)
    for k in range(40):
        cosine = np.round((vectors @ own.vectors.T)[k], 5)
        at = np.argsort(-cosine, kind="stable")[: quality.VOTES]  # of equal ones the first
        weight = np.maximum(cosine[at], 0) ** 8
        assert got[k] == pytest.approx((weight * own.labels[at]).sum() / weight.sum(), abs=1e-4)
    assert got[40] == got[41] == own.prior


def test_quality_query_against_one_text_at_a_time(spark):
    """Scores of the query are those of voting over all cosines, for each text alone."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels.where(~(queries.fold_of("doc_id", 3) == 1)))
    got = by_id(queries.op9_quality(spark, SF))
    for r in docs.orderBy("doc_id").limit(60).collect():
        row, kind, part = quality.terms(pa.array([r.text]))
        vector = model._unit(model._matrix(row, kind, part, 1) @ model.space)[0]
        near = sorted(range(len(model.labels)), key=lambda k: (-round(float(vector @ model.vectors[k]), 5), k))[: quality.VOTES]
        weight = [max(0.0, round(float(vector @ model.vectors[k]), 5)) ** 8 for k in near]
        assert got[r.doc_id].score == pytest.approx(sum(w * model.labels[k] for w, k in zip(weight, near)) / sum(weight), abs=0.01)


def test_quality_ties():
    """Of neighbours that are equally near the first of the sample vote."""
    own = quality.Model.of(["same words here"] * 60 + ["other thing"] * 3, [1] * 10 + [0] * 50 + [1] * 3)
    votes = own.votes(np.array([[0.5] * 60 + [0.9] * 3, [0.1] * 63], np.float32))
    assert np.flatnonzero(votes[0]).tolist() == [*range(quality.VOTES - 3), 60, 61, 62] and np.flatnonzero(votes[1]).tolist() == [*range(quality.VOTES)]
    assert own.score(pa.array(["same words here"]))[0] == pytest.approx(10 / 21)


def test_quality_learns_whole_texts(spark):
    """What marks a text after 30,000 characters is learnt; ids that repeat, empty tables and null labels change nothing."""
    rows = [(k, "plain words " * 3000 + ("!!! ### $$$ " * 400 if k % 2 else "quite so then " * 400)) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(3, 0), (31, None), (None, 1)], "doc_id long, quality int")
    docs = table(spark, rows + rows[:5] * 3 + [(50, None), (51, "")])
    model = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(model.labels) == 30 and all((got[k] >= 0.5) == bool(k % 2) for k in range(30, 40)) and got[50] == got[51] == model.prior
    assert (quality.learn(table(spark, rows), labels).vectors == model.vectors).all()
    assert quality.learn(docs.where("false"), labels).prior == quality.learn(docs, labels.where("false")).prior == 0.5


def test_quality_with_nothing_to_learn(spark):
    docs, labels = table(spark, [(1, "a"), (2, None)]), spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.learn(docs, labels)).collect()} == {0.5}


def test_token_counts_as_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice([" ", "  ", "a", "the", "▁", "é", "\n", "\t", "　", "12", ".", "​", "<s>"]) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    got = by_id(token_count.count_tokens(table(spark, list(enumerate(texts))), PIECES, limit=20))
    for k, x in enumerate(texts):
        n = len(library.encode(x or ""))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((x or "").encode()), n, n > 20), repr(x)


def test_token_counts_of_long_and_repeated_texts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    long = "word " * 100_000 + "x" * 100_000 + " " * 1000
    got = sorted(tuple(r) for r in token_count.count_tokens(table(spark, [(1, long), (2, "a b"), (2, "a b"), (2, None)]), PIECES).collect())
    assert got == [(1, len(long), len(library.encode(long)), True), (2, 0, 0, False), (2, 3, 2, False), (2, 3, 2, False)]


def test_token_count_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = by_id(queries.op10_token_count(spark, SF))
    assert len(got) == len(rows) and all(got[k].n_tokens == len(library.encode(x)) for k, x in rows.items())


def test_extra_columns_with_clashing_names(spark):
    """Columns named as the operators name their own have no part in any result."""
    rows = [(k, f"some words that number {k % 3} holds and the rest of it", "en", k) for k in range(9)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, label long")
    names = ["id", "n", "mark", "more", "bands", "size", "norm", "share", "component", "kept", "token_ids", "score", "_kept", "html", "h"]
    odd = plain.withColumns({x: F.lit("1") for x in names})
    items = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    runs = [
        lambda d: language_id.identify(d, language_id.learn(d)), lambda d: byte_bpe.encode(d, RANKS, public_tokenizers.PATTERN), license_scan.scan, lambda d: decontaminate.leaks(d, items),
        lambda d: near_dup.near_duplicates(d), pii.find, exact_dedup.exact_duplicates, lambda d: quality.score(d, quality.learn(d, d.withColumn("quality", F.lit(1)))), lambda d: token_count.count_tokens(d, PIECES),
    ]
    for run in runs:
        assert sorted(map(str, run(odd).collect())) == sorted(map(str, run(plain).collect()))
    pages = spark.createDataFrame([(1, "u", "x" * 2000), (2, "u", "x" * 2000)], PAGES)
    assert sorted(map(str, warc.archived(pages.withColumns({x: F.lit("1") for x in ("id", "sha", "first", "name", "type", "size")})).collect())) == sorted(map(str, warc.archived(pages).collect()))


def test_empty_tables(spark):
    none = table(spark, [], "doc_id long, text string, lang string")
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == license_scan.scan(none).count() == pii.find(none).count() == token_count.count_tokens(none, PIECES).count() == 0
    assert language_id.identify(none, language_id.learn(none)).count() == language_id.accepted(none, ()).count() == 0
