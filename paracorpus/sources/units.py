"""Discrete unit sequences with their texts."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paracorpus.functions import text as T
from paracorpus.sources.corpus_tree import read_texts

# Names of unit files.
UNIT_FILES = "*_units.npy"


def _load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in batch["content"]]
        yield pd.DataFrame(
            {"path": batch["path"], "units": [a.astype(np.int32).ravel() for a in arrays]}
        )


def read_unit_files(spark: SparkSession, folder: str) -> DataFrame:
    """Columns (id, file, units) of the unit files of a folder."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", UNIT_FILES).load(folder)
    ).select("path", "content")
    arrays = files.mapInPandas(_load, "path string, units array<int>")
    return arrays.select(
        T.unit_stem(T.stem("path")).alias("id"),
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"),
        "units",
    )


def read_units(spark: SparkSession, folder: str, keep_unmatched: bool = False) -> DataFrame:
    """Columns (id, file, units, text): unit files with their text files.

    Files without a text are left out, or kept with a null text (the query side, where
    `with_reference` fills in the placeholder).
    """
    texts = read_texts(spark, folder, "txt").withColumnRenamed("stem", "id")
    return read_unit_files(spark, folder).join(texts, "id", "left" if keep_unmatched else "inner")


def read_unit_table(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from a parquet table of (id, units, text)."""
    return spark.read.parquet(path).select(
        F.col("id"), F.col("units").cast("array<int>"), T.strip("text").alias("text")
    )
