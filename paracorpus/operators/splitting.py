"""Reproducible train/validation split with an exact validation size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Hex digits of the hash that form a cell: 65,536 cells, so the table of counts is bounded.
CELL_DIGITS = 4


def split_exact(
    df: DataFrame, fraction: float = 0.1, seed: int = 42, id_col: str = "id"
) -> DataFrame:
    """Add `split`: the floor(fraction * n) rows with the smallest hash are 'validation'.

    The rows themselves are never shuffled. Counts per hash cell name the cell that holds the
    cut; only that cell (a 65,536th of the rows) is sorted to find the cut itself; then every
    row is compared with it. `id_col` must be unique.
    """
    key = F.col(id_col).cast("string")
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", key, F.lit(str(seed)))))
    cell = F.substring("_hash", 1, CELL_DIGITS)

    counts = hashed.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_rows"))
    running = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    everything = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    wanted = F.floor(F.sum("_rows").over(everything) * F.lit(fraction))
    cut = (
        counts.select(
            "_cell",
            "_rows",
            F.sum("_rows").over(running).alias("_upto"),
            wanted.alias("_wanted"),
        )
        .where((F.col("_wanted") <= F.col("_upto")) & (F.col("_wanted") > F.col("_upto") - F.col("_rows")))
        .select("_cell", (F.col("_wanted") - F.col("_upto") + F.col("_rows")).alias("_nth"))
    )
    inside = (
        hashed.select("_hash", key.alias("_key"), cell.alias("_cell"))
        .join(F.broadcast(cut), "_cell")
        .withColumn("_place", F.row_number().over(W.partitionBy("_cell").orderBy("_hash", "_key")))
    )
    last = inside.where(F.col("_place") == F.col("_nth")).select(
        F.concat_ws(":", "_hash", "_key").alias("_last")
    )
    chosen = F.concat_ws(":", "_hash", key) <= last.scalar()
    return hashed.withColumn(
        "split", F.when(chosen, "validation").otherwise("train")
    ).drop("_hash")
