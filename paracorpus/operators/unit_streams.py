"""Unit streams in long form, and statistics of corpora and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paracorpus.functions import sequences as S


def dedupe_units(df: DataFrame, units: str = "units") -> DataFrame:
    """One row per utterance: `units` without repeats, and `durations`. Row-local."""
    runs = S.run_lengths(units)
    return df.withColumn("_runs", runs).select(
        *[c for c in df.columns if c != units],
        F.col("_runs.units").alias(units),
        F.col("_runs.durations").alias("durations"),
    )


def unit_runs(
    stream: DataFrame, key: str, order: list[str], unit: str, chunk: Column
) -> DataFrame:
    """Columns (key, run, unit, duration) of a stream with one row per frame.

    `chunk` is any coarse, non-decreasing function of the order (position // 100000, or the
    day). Runs are first found inside (key, chunk), so one endless stream is spread over many
    tasks. Then the pieces are joined across chunk borders: per key only one row per chunk
    takes part in that, however long the stream is. Frames without key or order are left out.
    """
    cells = stream.select(key, chunk.alias("_chunk"), *order, F.col(unit).alias("unit")).where(
        F.col(key).isNotNull() & F.col("_chunk").isNotNull()
    )
    inside = W.partitionBy(key, "_chunk").orderBy(*order)
    starts = F.coalesce((F.lag("unit").over(inside) != F.col("unit")).cast("long"), F.lit(1))
    pieces = (
        cells.withColumn("_starts", starts)
        .withColumn("_piece", F.sum("_starts").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(key, "_chunk", "_piece")
        .agg(F.first("unit").alias("unit"), F.count("*").alias("frames"))
    )
    borders = pieces.groupBy(key, "_chunk").agg(
        F.max("_piece").alias("_count"),
        F.min_by("unit", "_piece").alias("_first"),
        F.max_by("unit", "_piece").alias("_last"),
    )
    along = W.partitionBy(key).orderBy("_chunk")
    joined = F.coalesce((F.lag("_last").over(along) == F.col("_first")).cast("long"), F.lit(0))
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    offsets = borders.withColumn("_joined", joined).select(
        key,
        "_chunk",
        # runs that ended before this chunk's first piece is numbered
        (
            F.coalesce(F.sum("_count").over(earlier), F.lit(0)) - F.sum("_joined").over(upto)
        ).alias("_offset"),
    )
    return (
        pieces.join(offsets, [key, "_chunk"])
        .groupBy(key, (F.col("_offset") + F.col("_piece")).alias("run"))
        .agg(F.first("unit").alias("unit"), F.sum("frames").alias("duration"))
    )


def unit_stats(df: DataFrame, units: str = "units") -> DataFrame:
    return df.agg(F.count("*").alias("examples"), F.avg(F.size(units)).alias("mean_units"))


def corpus_stats(df: DataFrame, samples: str, words: str, rate: int = 16000) -> DataFrame:
    """Least, largest and mean length of the audio in seconds and of the text in words.

    `samples` and `words` are columns with the number of samples and of words.
    """
    length = S.seconds(samples, rate)
    return df.agg(
        F.min(length).alias("min_seconds"),
        F.max(length).alias("max_seconds"),
        F.avg(length).alias("mean_seconds"),
        F.min(words).alias("min_words"),
        F.max(words).alias("max_words"),
        F.avg(words).alias("mean_words"),
    )
