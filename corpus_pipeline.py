"""A training-data pipeline: each stage one operator applied to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import byte_bpe, contamination, simhash, substring_dedup, toxicity
from gleaner.llm.common import table
from gleaner.llm.queries import fold
from gleaner.session import materialise, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the factorization machine does not reject."""
    ship_package(spark)
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    held = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return toxicity.score(held, machine).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash class: that of the smallest id, of the least text digest where ids are equal; a row without
    id stays if its class has none with one, and rows that are repeated stay once."""
    ship_package(spark)
    return simhash.one_per_class(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has; ``n_chars`` follows."""
    ship_package(spark)
    left = substring_dedup.without_repeats(docs)
    n_chars = F.length(F.coalesce(F.col("text"), F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", n_chars)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate."""
    ship_package(spark)
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to."""
    ship_package(spark)
    made = byte_bpe.round_trip_digests(docs.select("doc_id", "lang", "source", "text"))
    return made.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_array", drop_repeats),
    ("contamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The fitted model and the fingerprints cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one keeps is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
