"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_slack, chroma, codes, ctw, exact_dedup, language_id, licenses, manifest, mixing, packing, pii, simhash_dedup, toxicity
from .common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op2_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.lm_scores(documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op7_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.match(chroma.recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(documents(spark, sf_dir))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


def op12_va_file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack(documents(spark, sf_dir))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ctw_scores": op2_ctw_scores,
    "op3_personal_data": op3_personal_data,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_chroma_fingerprints": op7_chroma_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_mix_sources": op10_mix_sources,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_va_file_codes": op12_va_file_codes,
    "op13_bin_slack_packing": op13_bin_slack_packing,
}

ORACLE_SQL = {
    "op11_merkle_manifest": manifest.manifest_sql(),
    "op12_va_file_codes": codes.compress_sql(),
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
                     count(*) OVER (PARTITION BY norm) AS group_size
              FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
    """,
}
