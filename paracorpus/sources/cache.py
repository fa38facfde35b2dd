"""A folder of converted items that grows by what is missing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paracorpus.operators.pairing import missing_items


def _committed(spark: SparkSession, folder: str) -> list[str]:
    """The batches whose write has ended: Spark's writers put _SUCCESS there last. One batch per run."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batches/*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(entry.getPath().getParent().toString() for entry in found)


def read_cache(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The items of all complete batches; no rows if there are none. What a broken run has left is not read."""
    batches = _committed(spark, folder)
    return spark.read.schema(schema).parquet(*batches) if batches else spark.createDataFrame([], schema)


def fill_cache(
    manifest: DataFrame, folder: str, convert: Callable[[DataFrame], DataFrame], key: str = "path"
) -> DataFrame:
    """The cache after every item of `manifest` that it lacked was converted and added.

    `convert` takes manifest rows and gives rows that have `key`, each item's once; it sees an item once, whatever
    the manifest repeats, and only what no complete batch holds. The rows of a run are one batch, written
    by Spark's committed output: it is there as a whole or not at all, so a run that breaks, or an executor that is
    lost, adds nothing half, and the next run converts what is still missing. Nothing missing, no
    batch. Runs must follow each other; two at a time may convert an item twice. An item that `convert`
    leaves out is tried again by the next run. Items with a null key are left out.
    """
    spark = manifest.sparkSession
    wanted = manifest.where(manifest[key].isNotNull()).dropDuplicates([key])
    schema = convert(wanted.limit(0)).schema
    cached = read_cache(spark, folder, schema).select(key)
    missing = missing_items(wanted, cached, key)
    if not missing.isEmpty():
        convert(missing).write.parquet(f"{folder}/batches/{uuid.uuid4().hex}")
    return read_cache(spark, folder, schema)
