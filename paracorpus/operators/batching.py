"""Fixed-size batches of label sequences, padded to a rectangle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paracorpus.operators.positions import with_position
from paracorpus.session import pin

# Fixed value: the label that a loss function ignores.
PADDING = -100


def pad_labels(
    df: DataFrame,
    batch_size: int = 16,
    bos: int = 1,
    labels: str = "labels",
    id_col: str = "id",
) -> DataFrame:
    """Columns (batch, id, labels): rows in id order, `batch_size` per batch.

    Each batch is padded to its longest row; when every row of a batch starts with `bos`, the
    first column goes. Ids are unique. The labels are written once, so that what derives them runs once. Only the
    id, the length and the first label of a row are sorted and numbered; the labels move once, to
    meet the shape of their batch.
    """
    df = pin(df.select(id_col, labels), "labels")
    whole_batch = W.partitionBy("batch")
    starts_with_bos = F.coalesce(F.get(labels, F.lit(0)) == bos, F.lit(False))
    narrow = df.select(id_col, F.size(labels).alias("_size"), starts_with_bos.alias("_bos"))
    shapes = (
        with_position(narrow, id_col)
        .withColumn("batch", F.floor(F.col("position") / batch_size))
        .select(
            id_col, "batch", F.max("_size").over(whole_batch).alias("_width"), F.bool_and("_bos").over(whole_batch).alias("_drop")
        )
    )
    shaped = df.select(id_col, labels).join(shapes, id_col)
    padded = F.concat(
        F.col(labels),
        F.array_repeat(F.lit(PADDING), (F.col("_width") - F.size(labels)).cast("int")),
    )
    kept = F.when(F.col("_drop"), F.slice(padded, F.lit(2), F.greatest(F.size(padded) - 1, F.lit(0))))
    return shaped.select("batch", id_col, kept.otherwise(padded).alias(labels))
