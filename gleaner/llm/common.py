"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Lower-cases A-Z only.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Runs of ASCII letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(c):
    """A column with only A-Z lower-cased."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def batched(array: pa.Array, max_bytes: int = 4 << 20) -> Iterator[list[str]]:
    """Texts of an Arrow column (null: empty) in lists of about ``max_bytes``, so that memory follows neither the
    batch size nor its longest neighbour; a single longer text is a list of its own."""
    part: list[str] = []
    size = 0
    for value in array:
        text = value.as_py() or ""
        if part and size + len(text) > max_bytes:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns_from_text(
    df: DataFrame,
    rows_of: Callable[[Sequence[str]], Sequence[tuple]],
    schema: T.StructType,
    text: str = "text",
) -> DataFrame:
    """``df`` with the columns of ``schema`` that ``rows_of`` computes from whole texts (null counts as empty).

    A narrow map: one Arrow scalar UDF, only the text column goes to Python, other columns stay in the JVM. Columns of
    ``df`` whose names clash with the new ones are replaced.
    """
    fields = list(schema.fields)
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            for part in batched(batch):
                for row in rows_of(part):
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, schema)
    source = F.col(text)
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    held = unused(df, "__made")
    made = df.withColumn(held, udf(source))
    return made.select(*[made[f"`{c}`"] for c in keep], *[F.col(held)[n].alias(n) for n in names])
