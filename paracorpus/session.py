"""Session settings and the one place where intermediate results are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "paracorpus", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; `conf` entries use `_` for `.`-free overrides."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only for a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="paracorpus-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and continue from the written table.

    Cuts the lineage, so a lost executor never makes Spark derive partition-dependent
    values (positions, range bounds) a second time with a different outcome.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder, for what `pin` does not write; `release` deletes it too."""
    _WRITTEN.append(f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables that `pin` has written so far and say how many; DataFrames built on them can no
    longer be evaluated. Results are lazy, so only the caller knows when that is."""
    paths, count = list(_WRITTEN), 0
    _WRITTEN.clear()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        count += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return count
