"""Speaker metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paracorpus.functions import text as T

# CSV header names and the columns they become.
HEADER = {
    "PARTICIPANT ID": "participant_id",
    "Dialect": "dialect",
    "Age Group": "age_group",
    "Gender": "gender",
}
SCHEMA = "participant_id string, dialect string, age_group string, gender string"


def one_per_participant(rows: DataFrame, row_no: str = "row_no") -> DataFrame:
    """Trim the id, drop blank ids, keep the last row of each id."""
    trimmed = rows.withColumn("participant_id", T.strip("participant_id"))
    latest = F.max_by(F.struct("dialect", "age_group", "gender"), row_no)
    return (
        trimmed.where(~T.is_blank("participant_id"))
        .groupBy("participant_id")
        .agg(latest.alias("latest"))
        .select("participant_id", "latest.*")
    )


def read_participants(spark: SparkSession, path: str) -> DataFrame:
    """One row per participant; an absent file gives an empty table."""
    try:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], SCHEMA)
        raise
    # A multi-line CSV is read by one task, top to bottom, so the running id is the row order.
    columns = [
        (F.col(f"`{name}`") if name in raw.columns else F.lit(None)).cast("string").alias(alias)
        for name, alias in HEADER.items()
    ]
    return one_per_participant(raw.select(*columns, F.monotonically_increasing_id().alias("row_no")))
