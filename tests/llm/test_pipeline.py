"""The pipeline against a brute-force version of each stage."""

import re

import public_tokenizers
import tiktoken
from test_operators import components

import corpus_pipeline
from runeloom.llm import byte_bpe

PROSE = {
    "en": "the people of the town were walking along the river and talking about the weather of that long winter while children played near an old bridge under grey clouds",
    "de": "die leute aus der kleinen stadt gingen am fluss entlang und sprachen über das wetter des langen winters während kinder bei einer alten brücke unter grauen wolken spielten",
}


def documents():
    rows = []
    for k in range(60):
        lang = "en" if k % 2 else "de"
        words = PROSE[lang].split()
        own = [*words[k % 9 :], *words[: k % 7], f"nummer{k}", *words[k % 5 : 20]]
        rows.append((k, " ".join(own[k % 4 :] + [f"{w}{k}" for w in words[:8]]), lang, "s", 0))
    rows += [(100 + k, rows[k][1].replace(" ", "  "), "en", "s", 0) for k in range(5)]  # exact copies, longer by spaces
    rows += [(200 + k, rows[k][1] + " end", "en", "s", 0) for k in range(10, 15)]  # near copies
    rows += [(300, "item " + ITEM + " after", "en", "s", 0), (301, None, None, None, None), (302, "", "en", "s", 0), (303, "1234 !! 77", "en", "s", 0), (304, "x", "en", "s", 0), (None, rows[3][1] + " quite other words stand here at the end of it", "en", "s", 0)]
    return rows


ITEM = "which of these seven planets has the largest number of known moons and who first described them"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [(k, t) for k, t, *_ in rows if re.search(r"[^\W\d_]", t or "")]
    groups = {}
    for k, t in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), k is None, k or 0, k, t))
    left = [min(g)[3:] for g in groups.values()]
    component, _ = components([x for x in left if x[0] is not None], 5)
    left = [(k, t) for k, t in left if k is None or component[k] == k]
    left = [(k, t) for k, t in left if ITEM not in t]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, left))
    ranks = byte_bpe.ranks_of(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(list(r.token_ids) == library.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids) for r in got)


def test_stages_on_nothing_and_with_more_columns(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([], documents()[:6]):
        docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS kept", "3 AS _kept", "4 AS score")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / f"{name}{len(rows)}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{len(rows)}"))
        assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == len(rows)
