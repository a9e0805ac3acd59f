"""Registered queries of the text operators: given tables in, contract columns out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayfold.llm.common import remainder
from wayfold.llm.divergence import audit_divergence
from wayfold.llm.exact_dedup import exact_groups
from wayfold.llm.jaccard_join import near_groups
from wayfold.llm.language import identify_language
from wayfold.llm.language_model import score_texts
from wayfold.llm.mixing import mix_to_targets
from wayfold.llm.packing import pack_sequences
from wayfold.llm.private_data import find_private, joined
from wayfold.llm.ranked_search import bm25_top
from wayfold.llm.spelling import spelling_variants
from wayfold.llm.token_files import read_token_files, write_token_files
from wayfold.llm.url_rules import HOST_RULES, PATTERN_RULES, judge_urls
from wayfold.llm.warc_archive import read_archive, write_archive
from wayfold.runtime import shared_dir


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as point records: the text stands in the address field."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("poi_id"), F.col("text").alias("address"), *more,
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(documents(spark, sf_dir), tokenizer_path()).withColumnRenamed("poi_id", "doc_id")


#: factors of the domains' shares before: poor tokens to three quarters, toxic ones to a half, the rest goes to the good ones
DOMAIN_TARGETS = {"good": 1.0, "poor": 0.75, "toxic": 0.5}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: toxic ones, and the others by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("poi_id"), domain.alias("category"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(documents(spark, sf_dir), labelled_domains(spark, sf_dir), DOMAIN_TARGETS, relative=True).withColumnRenamed("poi_id", "doc_id")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), remainder("poi_id", 7) == 2).withColumnRenamed("poi_id", "doc_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/wayfold/tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path, tokenizer_path())
    return read_token_files(spark, path).withColumnRenamed("poi_id", "doc_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).withColumnRenamed("poi_id", "doc_id")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_private(documents(spark, sf_dir))
    return got.select(
        F.col("poi_id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    asked = docs.filter(F.col("poi_id") % 100 == 0).select(F.col("poi_id").alias("query_id"), F.col("address").alias("text"))
    return bm25_top(docs, asked).withColumnRenamed("poi_id", "doc_id")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).withColumnRenamed("poi_id", "doc_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang")
    found = identify_language(docs, docs.filter(remainder("poi_id", 4) != 2))
    return found.select(F.col("poi_id").alias("doc_id"), (remainder("poi_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/wayfold/warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archive(pages, path, key="page_id", payload="html", uri="url", content_type="text/html; charset=utf-8")
    return read_archive(spark, path, key="page_id", kind="bigint", with_payload=False).drop("uri")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audit_divergence(documents(spark, sf_dir, F.col("lang").alias("province"), F.col("source").alias("dataset_id")))
    return got.withColumnsRenamed({"province": "lang", "dataset_id": "source"})


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), slip=97)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_lm_scores": op3_lm_scores,
    "op4_token_files": op4_token_files,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_rules": op6_url_rules,
    "op7_private_data": op7_private_data,
    "op8_bm25": op8_bm25,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_language": op10_language,
    "op11_warc": op11_warc,
    "op12_divergence": op12_divergence,
    "op13_spelling": op13_spelling,
}

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in HOST_RULES)
_BLOCKED = " OR ".join(f"regexp_matches(url, '{p}')" for v, p, _ in PATTERN_RULES if v == "block")
_LONGEST = "CASE " + " ".join(
    f"WHEN regexp_matches(url, '{p}') THEN '{p}'" for _, p, _ in sorted(PATTERN_RULES, key=lambda r: (len(r[1]), r[1]), reverse=True)) + " END"

ORACLE = {
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
vs AS (SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
ns AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (coalesce(ns.n, 0) + vs.v) AS p,
    1 + 1000000000::HUGEINT * (k.c + 1) // (vs.n + vs.v) AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN vs ON vs.lang = g.lang LEFT JOIN ns ON ns.lang = g.lang AND ns.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS v
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.v, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 200""",
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM p LEFT JOIN g ON p.h = g.h""",
    "op6_url_rules": rf"""
WITH rules(verdict, host, path) AS (VALUES {_RULES}),
u AS (SELECT row_number() OVER () AS rn, page_id, url,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fit AS (SELECT u.rn, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.rn)
SELECT page_id, u.host, u.path, rule, coalesce(fit.verdict, CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict,
  {_LONGEST} AS pattern FROM u LEFT JOIN fit ON u.rn = fit.rn""",
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
}
