"""Document tables: reading, validating, upserting and merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import lexicons as lx

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)


def read_json_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A JSON store: one array of ``{name, markdown, type}`` objects per file."""
    return spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=True)


def read_markdown_files(spark: SparkSession, path: str | Sequence[str], doc_type: str = "knowledge") -> DataFrame:
    """Markdown files, one row per file, named after the file and tagged with a type."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_name").alias("name"), F.col("value").alias("markdown"), F.lit(doc_type).alias("type")
    )


def read_table_documents(spark: SparkSession, path: str, name: str, text: str, doc_type: str = "knowledge") -> DataFrame:
    """A Parquet table with a name and a text column, projected to the document shape."""
    rows = spark.read.parquet(path)
    return rows.select(
        F.col(name).cast("string").alias("name"), F.col(text).alias("markdown"), F.lit(doc_type).alias("type")
    )


def valid_documents(documents: DataFrame) -> DataFrame:
    """Rows that have a name and a text, with the type defaulted; other columns are kept."""
    return documents.filter(F.col("name").isNotNull() & F.col("markdown").isNotNull()).withColumn(
        "type", F.coalesce("type", F.lit(lx.DEFAULT_DOCUMENT_TYPE))
    )


def knowledge_documents(documents: DataFrame) -> DataFrame:
    """Documents that may answer questions: style and converter rows are left out, a missing name is defaulted."""
    excluded = F.coalesce(F.col("type").isin(*lx.NON_KNOWLEDGE_TYPES), F.lit(False))
    name = F.when(F.coalesce("name", F.lit("")) == "", lx.DEFAULT_DOCUMENT_NAME).otherwise(F.col("name"))
    return documents.filter(~excluded).withColumn("name", name)


def latest_documents(
    versions: DataFrame, tombstones: DataFrame | None = None, key: str = "name", version: str = "version"
) -> DataFrame:
    """Upsert by key: the highest version wins, keys in the tombstone list are ignored.

    ``max_by`` combines on the map side, so a name with very many versions never gathers in one task.
    """
    packed = F.struct(*[c for c in versions.columns if c != key])
    latest = versions.groupBy(key).agg(F.max_by(packed, F.col(version)).alias("row"))
    latest = latest.select(key, "row.*")
    return latest if tombstones is None else latest.join(tombstones.select(key).distinct(), key, "left_anti")


def fill_missing(
    current: DataFrame, incoming: DataFrame, key: str = "name", only_type: str | None = None
) -> DataFrame:
    """Keep every current row and append the incoming rows whose key is absent.

    With ``only_type`` just incoming rows of that type qualify; without it appended rows get the default type.
    """
    if only_type is None:
        incoming = incoming.withColumn("type", F.lit(lx.DEFAULT_DOCUMENT_TYPE))
    else:
        incoming = incoming.filter(
            (F.col("type") == only_type) & F.col(key).isNotNull() & F.col("markdown").isNotNull()
        )
    added = incoming.join(current.select(key).distinct(), key, "left_anti")
    return current.unionByName(added.select(*current.columns))
