"""Snapshot export and restore: a folder of tables plus a one-row manifest, with a quality gate on restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import text as tx
from gleaner.sources.documents import DOCUMENT_SCHEMA

FILE_TABLES = ("glossary", "rules")
PREFERENCES = ("capture_hotkey", "active_project_id")


class SnapshotError(ValueError):
    """The snapshot cannot be written or restored."""


def document_violations(documents: DataFrame) -> DataFrame:
    """Rows breaking the gate, as ``(name, problem, n)``: missing fields, blank names, names repeated after trimming.

    Duplicates are counted with a map-side aggregate, so one name repeated for a third of the table stays cheap.
    """
    trimmed = documents.select(tx.trim("name").alias("name"), "markdown")
    per_name = trimmed.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("markdown").isNull().cast("long")).alias("missing_text")
    )
    problem = (
        F.when(F.col("name").isNull() | (F.col("name") == ""), "blank name")
        .when(F.col("missing_text") > 0, "missing text")
        .when(F.col("n") > 1, "duplicate name")
    )
    return per_name.select("name", problem.alias("problem"), "n").filter(F.col("problem").isNotNull())


def normalise_documents(documents: DataFrame) -> DataFrame:
    """Trimmed name and type; a blank type becomes the default."""
    kind = tx.trim(tx.text_or_empty("type"))
    return documents.select(
        tx.trim("name").alias("name"),
        "markdown",
        F.when(kind == "", lx.DEFAULT_DOCUMENT_TYPE).otherwise(kind).alias("type"),
    )


def normalise_file(rows: DataFrame) -> DataFrame:
    return rows.select(tx.trim("name").alias("name"), "markdown")


def file_violations(rows: DataFrame) -> DataFrame:
    blank = (tx.trim(tx.text_or_empty("name")) == "") | (tx.trim(tx.text_or_empty("markdown")) == "")
    return rows.filter(blank)


def _require_empty(violations: DataFrame, what: str) -> None:
    first = violations.limit(1).collect()
    if first:
        raise SnapshotError(f"{what}: {first[0].asDict()}")


def export_snapshot(
    path: str,
    documents: DataFrame,
    glossary: DataFrame | None = None,
    rules: DataFrame | None = None,
    preferences: dict[str, str] | None = None,
) -> None:
    """Write the validated tables and a manifest. Credentials are not part of any table written here."""
    spark = documents.sparkSession
    _require_empty(document_violations(documents), "documents")
    normalise_documents(documents).write.mode("error").parquet(f"{path}/documents")
    for name, rows in zip(FILE_TABLES, (glossary, rules), strict=True):
        if rows is not None:
            _require_empty(file_violations(rows), name)
            normalise_file(rows).write.mode("error").parquet(f"{path}/{name}")
    values = [((preferences or {}).get(key) or "").strip() for key in PREFERENCES]
    tables = ["documents"] + [n for n, rows in zip(FILE_TABLES, (glossary, rules), strict=True) if rows is not None]
    manifest = spark.range(1).select(
        F.lit(lx.SNAPSHOT_VERSION).alias("schema_version"),
        F.current_timestamp().alias("exported_at"),
        F.array(*map(F.lit, tables)).alias("tables"),
        *[F.lit(v).alias(k) for k, v in zip(PREFERENCES, values, strict=True)],
    )
    manifest.coalesce(1).write.mode("error").json(f"{path}/manifest")


def restore_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame | dict[str, str] | None]:
    """Read a snapshot back after checking version, names and uniqueness; raises ``SnapshotError`` on a violation."""
    manifest = spark.read.json(f"{path}/manifest").first()
    if manifest is None or manifest["schema_version"] != lx.SNAPSHOT_VERSION:
        raise SnapshotError("incompatible snapshot version")
    documents = spark.read.schema(DOCUMENT_SCHEMA).parquet(f"{path}/documents")
    _require_empty(document_violations(documents), "documents")
    out: dict[str, DataFrame | dict[str, str] | None] = {"documents": normalise_documents(documents)}
    for name in FILE_TABLES:
        out[name] = None
        if name in manifest["tables"]:
            rows = spark.read.parquet(f"{path}/{name}")
            _require_empty(file_violations(rows), name)
            out[name] = normalise_file(rows)
    out["preferences"] = {key: manifest[key] or "" for key in PREFERENCES}
    return out
