"""Session helpers shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON text) up to which a lookup side is broadcast. Above, the join is left to Spark (shuffle + AQE).
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def local_session(app: str = "gleaner", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass your own session to the operators instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("GLEANER_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names. Only a local session, whose tasks all run on this machine, may go
    without one and gets a private folder; anywhere else executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gleaner-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` stays within both bounds. Measuring stops after ``max_rows + 1`` rows, so it stays cheap on a side
    that turns out large."""
    size = F.length(F.to_json(F.struct("*"))).cast("long").alias("size")
    rows, total = df.limit(max_rows + 1).select(size).agg(F.count(F.lit(1)), F.sum("size")).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring that ``df`` stays within the bounds; otherwise return it unhinted."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Used for small tables that several branches of one plan read (a question table's postings, for example): the work
    is done once, the lineage is cut, and a lost executor can still read the files. They are deleted when the application
    ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/gleaner-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder; what is written there is deleted when the application ends."""
    path = f"{checkpoint_root(spark)}/gleaner-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    file_system.mkdirs(hadoop_path)
    file_system.deleteOnExit(hadoop_path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gleaner-package-")) / "gleaner.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
