"""The queries of this subpackage by name, over a folder of tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, exact_dedup, language_id, license_scan, near_dup, pii, quality, token_count, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    learnt = language_id.learn(docs.where(~held))
    return language_id.identify(docs, learnt).select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return both.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("content", 256).alias("decoded_sha256"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("licenses", lambda x: F.struct(x["coverage"].alias("coverage"), (-x["start"]).alias("start"), x["license"].alias("license"))))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), best["license"].alias("license"), best["coverage"].alias("coverage"),
                        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",").alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    order = F.array(*[F.lit(k) for k in pii.KINDS])
    by_kind = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(order, x["kind"]).alias("place"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"n_{k}")
    count = [of(k) for k in pii.KINDS[: pii.BASE]]
    return found.select("doc_id", *count, F.sha2(by_kind(F.col("base")).cast("binary"), 256).alias("base_sha256"), by_kind(F.concat("base", "added")).alias("spans"),
                        F.size(F.concat("base", "added")).cast("long").alias("n_spans"), F.size("added").cast("long").alias("n_added"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    model = quality.learn(docs, labels.where(~held))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_byte_bpe, op3_license_scan, op4_decontaminate, op5_near_dedup, op6_pii, op7_warc, op8_exact_dedup, op9_quality, op10_token_count)}

SQL: dict[str, str] = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER better AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER better AS kept, sha256(norm) AS text_sha256
FROM d WINDOW better AS (PARTITION BY norm ORDER BY size DESC, doc_id)""",
    "op5_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE w END AS sh FROM d),
c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
u AS (SELECT rep, n, unnest(sh) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.g = b.g AND a.rep <> b.rep AND 80 * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT rep AS node, rep AS reach FROM c UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a),
m AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(m.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.sh = c.sh AND len(s.sh) > 0 LEFT JOIN m ON m.node = c.rep""",
}
