"""The queries of the operators in this subpackage: each is (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, divergence, imatch, jaccard, langid, licences, pieces, prefixes, quality, sharding, substrings, urlrules, warc
from corpusmill.llm.shared import new_path, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_predict(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.shared_prefixes(table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(licences.scan(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op4_passages": op4_passages,
    "op5_warc": op5_warc,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_imatch": op3_imatch,
    "op8_url_rules": op8_url_rules,
    "op6_jaccard": op6_jaccard,
    "op7_decontamination": op7_decontamination,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_divergence": op12_divergence,
    "op13_licences": op13_licences,
}
ORACLES: dict[str, str] = {
    "op1_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f""",
    "op11_prefix_trie": prefixes.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_licences": licences.oracle(),
}
