"""The recordings table: parquet or JSON files, or a JDBC table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paracorpus.operators.pairing import complete_only

# The columns that are used.
RECORDING_COLUMNS = [
    "id", "audio_path", "transcript", "english_translation", "dialect", "participant_id",
]


def select_recordings(df: DataFrame, require_complete: bool = False) -> DataFrame:
    """The six columns; optionally only rows with audio path, transcript and translation."""
    rows = df.select(*RECORDING_COLUMNS)
    return complete_only(rows) if require_complete else rows


def read_recordings(
    spark: SparkSession, source: str | dict, require_complete: bool = False
) -> DataFrame:
    """`source` is a parquet or .json path, or a dict of JDBC options.

    For JDBC give partitionColumn, lowerBound, upperBound and numPartitions among the options,
    otherwise the whole table arrives through one connection.
    """
    if isinstance(source, dict):
        table = spark.read.format("jdbc").options(**source).load()
    elif source.rstrip("/").endswith((".json", ".jsonl")):
        schema = ", ".join(f"{c} string" for c in RECORDING_COLUMNS)
        table = spark.read.schema(schema).json(source)
    else:
        table = spark.read.parquet(source)
    return select_recordings(table, require_complete)
