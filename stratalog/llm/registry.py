"""Named queries of the training-data operators and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import decontam, hnsw, html_extract, langid, license_scan, lm_scoring, minhash, mixing, oracles, secret_scan, substring_dedup, token_alignment, vector_codes, warc
from stratalog.llm.common import id_fold, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = id_fold(F.col("doc_id"), 3)
    model = langid.train(docs.where(fold != 1))
    found = langid.predict(docs, model)
    return found.select("doc_id", (id_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_windows(table(spark, sf_dir, "documents")).drop("kept")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).drop("redacted")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("found")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring, "op2_hnsw": op2_hnsw, "op3_warc": op3_warc, "op4_langid": op4_langid, "op5_substring_dedup": op5_substring_dedup, "op6_decontam": op6_decontam, "op7_minhash": op7_minhash, "op8_html": op8_html, "op9_mixing": op9_mixing, "op10_secrets": op10_secrets, "op11_alignment": op11_alignment, "op12_vector_codes": op12_vector_codes, "op13_licenses": op13_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": oracles.WARC, "op5_substring_dedup": oracles.SUBSTRING, "op6_decontam": oracles.DECONTAM, "op7_minhash": oracles.MINHASH, "op9_mixing": mixing.ORACLE, "op12_vector_codes": oracles.vector_codes(), "op13_licenses": oracles.licenses()}
