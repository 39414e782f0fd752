"""The registered queries of this subpackage, each a thin layer over its operator."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    byte_bpe,
    contamination,
    licenses,
    order_minhash,
    oracles,
    quality,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
    url_filter,
    vector_codes,
    whitening,
)
from gleaner.llm.common import table
from gleaner.session import materialise, ship_package

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def fold(folds: int) -> Column:
    """Remainder that splits held-out rows off."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


@query("op2_url_filter", oracles.URL_FILTER)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(quality.with_statistics(documents(spark, sf_dir)).select("doc_id", "statistics"))
    model = quality.fit(stats, table(spark, sf_dir, "labels"), fold(5) != 0)
    return quality.score(stats, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op7_licenses")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op8_contamination", oracles.CONTAMINATION)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = contamination.mark(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = byte_bpe.round_trip_digests(documents(spark, sf_dir))
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op10_order_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = order_minhash.compare_with_next(documents(spark, sf_dir))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query("op4_substring_dedup", oracles.SUBSTRING_DEDUP)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(documents(spark, sf_dir))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.components_of(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return made.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query("op12_sharding", oracles.SHARDING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(documents(spark, sf_dir), keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op13_vector_codes", oracles.VECTOR_CODES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return made.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
