"""Similarity of two texts from the vectors of their tokens (greedy matching)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t


def _token_matrices(column: pa.Array) -> list[np.ndarray]:
    """One unit-length (tokens x dimension) matrix per row."""
    matrices = []
    vectors = column.flatten()
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    widths = np.asarray(vectors.value_lengths(), dtype=np.int64)
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    value_at = np.concatenate([[0], np.cumsum(widths)])
    at = 0
    for size in sizes:
        width = widths[at] if size else 0
        block = flat[value_at[at] : value_at[at + size]].reshape(size, width)
        norm = np.linalg.norm(block, axis=1, keepdims=True)
        matrices.append(block / np.where(norm > 0, norm, 1.0))
        at += size
    return matrices


SCORE = t.StructType([t.StructField(c, t.DoubleType()) for c in ("precision", "recall", "f1")])


@F.arrow_udf(SCORE)
def _greedy_match(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    rows = []
    for h, r in zip(_token_matrices(hyp), _token_matrices(ref)):
        if not len(h) or not len(r):
            rows.append((0.0, 0.0, 0.0))
            continue
        cosine = h @ r.T
        p, q = cosine.max(1).mean(), cosine.max(0).mean()
        rows.append((p, q, 2 * p * q / (p + q) if p + q else 0.0))
    columns = np.array(rows, dtype=np.float64).reshape(-1, 3).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["precision", "recall", "f1"])


def embedding_score(pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """Columns (id, precision, recall, f1) for rows with `hyp_vecs` and `ref_vecs`.

    Each is an array of token vectors of one text. Precision is the mean over hypothesis tokens
    of the best cosine to any reference token, recall the reverse, F1 their harmonic mean. A
    side without tokens scores 0.0. Row-local: the token pairs live only inside one matrix.
    """
    cast = [F.col(c).cast("array<array<double>>") for c in ("hyp_vecs", "ref_vecs")]
    return pairs.select(id_col, _greedy_match(*cast).alias("s")).select(
        id_col, "s.precision", "s.recall", "s.f1"
    )


def mean_embedding_f1(scores: DataFrame) -> DataFrame:
    """Mean F1 of a prediction set; 0.0 when nothing could be scored."""
    return scores.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("bertscore_f1"))
