"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm import decontam, htmltext, langid, lexical, linededup, merkle, packing, pii, quality, secretscan, simhash, tokenfile, urlfilter
from funnelkit.llm.shared import documents, new_path, ship

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE_END = 1
BYTE_BPE_END = 2


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = decontam.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return linededup.dedup_lines(documents(spark, sf_dir)).select("row.doc_id", "text", "n_lines", "n_removed")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = new_path(spark, "token-file")
    tokenfile.write(documents(spark, sf_dir), path, public_tokenizers.path(BYTE_BPE), BYTE_BPE_END)
    return tokenfile.read(spark, path)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.learn(docs.select("doc_id", "text", "lang")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urlfilter.judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), carry=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All documents packed for the word vocabulary."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), WORD_BPE_END)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return merkle.verified(merkle.build(documents(spark, sf_dir), claim=merkle.tampered()))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = htmltext.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("row.page_id", "row.url", "text", "n_chars")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return lexical.search_all(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_line_dedup, op3_token_file, op4_language, op5_secrets, op6_simhash, op7_url_filter,
        op8_quality_rules, op9_packing, op10_personal_data, op11_merkle_manifest, op12_html_text, op13_ranked_search)
}
