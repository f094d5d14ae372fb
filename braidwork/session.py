"""Session defaults, and the folder that all executors share."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows that dealt() gives a task at most, on average.
TASK_ROWS = 500_000

#: Bytes of files up to which Spark may take a table of stored() for small. Files are many times smaller than the rows that a broadcast brings to the driver.
SMALL_FILES = 1 << 20


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("braidwork")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="braidwork-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, dropped by drop_scratch."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut and survives lost executors. Joins of a table of over SMALL_FILES are by merge, as Spark would tell by its files whether the driver can hold it."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out = out.hint("merge") if written_bytes(df.sparkSession, path) > SMALL_FILES else out
    out.stored_at = path
    return out


def written_bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def drop_stored(*tables: DataFrame | None) -> None:
    """Deletes what stored() wrote for these tables, once no frame reads them any more; others are left alone."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path in _scratch:
            discard(df.sparkSession, path)


def dealt(df: DataFrame, *keys: str, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by the keys to as many tasks as its rows ask for (rows: their number, else they are counted), so that what a task sorts doesn't grow with the table. Spark alone merges tasks by their compressed bytes, which tell little about rows of a few numbers."""
    n = df.count() if rows is None else rows
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(least, -(-n // task_rows)), *keys)


def memoised(spark: SparkSession, name: str, arguments: dict, build: Callable[[], DataFrame], root: str | None = None) -> DataFrame:
    """build(), written once for each set of arguments: the path is the key. A table that wasn't written to its end is written anew. root is a folder that all executors share, by default that of the session."""
    key = hashlib.sha256(json.dumps(arguments, sort_keys=True).encode()).hexdigest()[:32]
    path = f"{(root or shared_dir(spark)).rstrip('/')}/memo/{name}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes one scratch table that no frame reads any more."""
    delete(spark, path)
    _scratch.remove(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables; only for when no frame that reads them is still needed."""
    while _scratch:
        delete(spark, _scratch.pop())
