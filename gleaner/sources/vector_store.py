"""Append-only vector tables keyed by a content hash and a model version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import lexicons as lx
from gleaner.functions import text as tx

VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("section_key", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("model_version", T.IntegerType()),
    ]
)
_KEY_FIELDS = ("source", "project", "title", "content", "retrieval_text")


def section_key(fields: tuple[str, ...] = _KEY_FIELDS) -> Column:
    """Hash of everything that feeds the embedding, so changed text gets a new key."""
    return F.sha2(F.to_json(F.array(*[tx.text_or_empty(f) for f in fields])), 256)


def read_vectors(spark: SparkSession, path: str, version: int = lx.VECTOR_VERSION) -> DataFrame:
    """Stored non-empty vectors of one model version; the version filter reaches the file scan."""
    stored = spark.read.schema(VECTOR_SCHEMA).parquet(path)
    return stored.filter((F.col("model_version") == version) & (F.size("embedding") > 0))


def missing_sections(sections: DataFrame, vectors: DataFrame, version: int = lx.VECTOR_VERSION) -> DataFrame:
    """Sections whose key has no vector of this version yet, one row per key."""
    current = vectors.filter((F.col("model_version") == version) & (F.size("embedding") > 0)).select("section_key")
    return sections.dropDuplicates(["section_key"]).join(current, "section_key", "left_anti")


def append_vectors(vectors: DataFrame, path: str, version: int = lx.VECTOR_VERSION) -> None:
    rows = vectors.select("section_key", F.col("embedding").cast("array<float>"), F.lit(version).alias("model_version"))
    rows.write.mode("append").parquet(path)
