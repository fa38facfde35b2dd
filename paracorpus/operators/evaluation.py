"""Corpus and sample scores of predictions: WER, CER, BLEU, chrF++, overlap, lengths.

Input everywhere: one row per prediction with string columns `reference` and `hypothesis`
(and `error` where failures are counted). `mode` is 'normalized' (default) or 'raw'.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from paracorpus.functions import text as T
from paracorpus.functions.scoring import pct, quality_band, ratio
from paracorpus.operators.edit_distance import edit_distances
from paracorpus.operators.pair_statistics import (
    ALL_PARTS,
    BLEU_ORDERS,
    CHRF_CHAR_ORDERS,
    CHRF_WORD_ORDERS,
    overlap_share,
    pair_statistics,
    prepared,
)
from paracorpus.session import pin

CHRF_BETA = 2


def _name(column: str, kind: str, n: int) -> str:
    return f"{kind}_{n}_{column}"


def _total(column: str, kind: str, n: int = 0) -> Column:
    return F.col(_name(column, kind, n))


# Which sums each part of the statistics yields: kind -> n-gram orders.
SUMS = {
    "rows": [0],
    "overlap": [0],
    "word_edit": [0],
    "char_edit": [0],
    "bleu": range(1, BLEU_ORDERS + 1),
    "char": range(1, CHRF_CHAR_ORDERS + 1),
    "word": range(1, CHRF_WORD_ORDERS + 1),
}
KINDS_OF_PART = {"ngrams": ("bleu",), "chars": ("char", "word")}


def _totals(pairs: DataFrame, mode: str, parts: tuple[str, ...]) -> DataFrame:
    """One row with a named column per sum; the closed forms read these."""
    kinds = ["rows"] + [k for part in parts for k in KINDS_OF_PART.get(part, (part,))]
    sums = [
        F.expr(
            f"coalesce(sum({column}) FILTER (WHERE kind = '{kind}' AND n = {n}), 0)"
            f" AS {_name(column, kind, n)}"
        )
        for kind in kinds
        for n in SUMS[kind]
        for column in (("hits", "share") if kind == "overlap" else ("hits", "hyp", "ref"))
    ]
    return pair_statistics(pairs, mode, parts).agg(*sums)


# --- closed forms over the partial sums --------------------------------------------------


def _error_rate(kind: str) -> Column:
    return ratio(_total("hits", kind), _total("ref", kind))


def _bleu() -> Column:
    hits = [_total("hits", "bleu", n).cast("double") for n in range(1, BLEU_ORDERS + 1)]
    grams = [_total("hyp", "bleu", n).cast("double") for n in range(1, BLEU_ORDERS + 1)]
    hyp_len, ref_len = grams[0], _total("ref", "bleu", 1).cast("double")
    logs, smooth = [], F.lit(1.0)
    for m, total in zip(hits, grams):
        smooth = F.when(m == 0, smooth * 2).otherwise(smooth)
        precision = F.when(m == 0, 100.0 / (smooth * total)).otherwise(100.0 * m / total)
        logs.append(F.log(precision))
    mean_log = sum(logs[1:], logs[0]) / BLEU_ORDERS
    brevity = F.when(hyp_len >= ref_len, 1.0).otherwise(F.exp(1 - ref_len / hyp_len))
    empty = F.least(*grams) == 0
    return F.when(empty | (F.greatest(*hits) == 0), 0.0).otherwise(brevity * F.exp(mean_log))


def _chrf() -> Column:
    orders = [("char", n) for n in range(1, CHRF_CHAR_ORDERS + 1)]
    orders += [("word", n) for n in range(1, CHRF_WORD_ORDERS + 1)]
    precision = recall = used = F.lit(0.0)
    for kind, n in orders:
        hits, hyp, ref = (_total(c, kind, n).cast("double") for c in ("hits", "hyp", "ref"))
        counted = (hyp > 0) & (ref > 0)
        precision = precision + F.when(counted, hits / hyp).otherwise(0.0)
        recall = recall + F.when(counted, hits / ref).otherwise(0.0)
        used = used + F.when(counted, 1.0).otherwise(0.0)
    p, r = precision / F.greatest(used, F.lit(1.0)), recall / F.greatest(used, F.lit(1.0))
    weight = float(CHRF_BETA**2)
    return F.when(p + r > 0, 100 * (1 + weight) * p * r / (weight * p + r)).otherwise(0.0)


def _overlap() -> Column:
    return F.coalesce(ratio(_total("share", "overlap") * 100, _total("hits", "overlap")), F.lit(0.0))


# --- corpus metrics ----------------------------------------------------------------------


def corpus_wer(pairs: DataFrame, mode: str = "normalized") -> DataFrame:
    """Word edits over reference words, with both sums."""
    return _totals(pairs, mode, ("word_edit",)).select(
        _total("hits", "word_edit").alias("word_edits"),
        _total("ref", "word_edit").alias("ref_words"),
        _error_rate("word_edit").alias("wer"),
    )


def corpus_cer(pairs: DataFrame, mode: str = "normalized") -> DataFrame:
    """Character edits over reference characters (spaces count), with both sums."""
    return _totals(pairs, mode, ("char_edit",)).select(
        _total("hits", "char_edit").alias("char_edits"),
        _total("ref", "char_edit").alias("ref_chars"),
        _error_rate("char_edit").alias("cer"),
    )


def word_accuracy(pairs: DataFrame, mode: str = "normalized") -> DataFrame:
    """1 - WER; negative when there are more edits than reference words."""
    return corpus_wer(pairs, mode).select((1 - F.col("wer")).alias("word_accuracy"))


def corpus_bleu(pairs: DataFrame, mode: str = "normalized") -> DataFrame:
    """BLEU-4 with exponential smoothing of empty orders, and the lengths behind it."""
    return _totals(pairs, mode, ("ngrams",)).select(
        _total("hyp", "bleu", 1).alias("hyp_len"),
        _total("ref", "bleu", 1).alias("ref_len"),
        *[_total("hits", "bleu", n).alias(f"match_{n}") for n in range(1, BLEU_ORDERS + 1)],
        *[_total("hyp", "bleu", n).alias(f"total_{n}") for n in range(1, BLEU_ORDERS + 1)],
        _bleu().alias("bleu"),
    )


def corpus_chrf(pairs: DataFrame, mode: str = "normalized") -> DataFrame:
    """chrF++: six character orders, two word orders, recall weighted twice."""
    return _totals(pairs, mode, ("chars",)).select(_chrf().alias("chrf"))


def word_overlap(pairs: DataFrame, mode: str = "normalized") -> DataFrame:
    """Mean share of distinct reference words present, in percent. Pure JVM plan."""
    share = overlap_share(T.words("hyp"), T.words("ref"))
    return prepared(pairs, mode).agg(
        F.coalesce(F.avg(share) * 100, F.lit(0.0)).alias("word_overlap")
    )


def length_stats(pairs: DataFrame, mode: str = "normalized") -> DataFrame:
    means = prepared(pairs, mode).agg(
        F.avg(T.word_count("hyp")).alias("mean_hypothesis_words"),
        F.avg(T.word_count("ref")).alias("mean_reference_words"),
    )
    return means.withColumn(
        "length_ratio", ratio("mean_hypothesis_words", "mean_reference_words")
    )


# --- per row -----------------------------------------------------------------------------


EDITS = t.StructType([t.StructField("words", t.LongType()), t.StructField("chars", t.LongType())])


@F.arrow_udf(EDITS)
def _row_edits(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    hyps, refs = hyp.to_pylist(), ref.to_pylist()
    by_word = edit_distances([h.split() for h in hyps], [r.split() for r in refs])
    return pa.StructArray.from_arrays(
        [pa.array(by_word, pa.int64()), pa.array(edit_distances(hyps, refs), pa.int64())],
        ["words", "chars"],
    )


def sample_scores(pairs: DataFrame, mode: str = "normalized") -> DataFrame:
    """The input rows with both scored texts and their WER and CER in percent.

    A reference that is empty after normalisation has no rate: null.
    """
    scored = prepared(pairs, mode).withColumn("edits", _row_edits("hyp", "ref"))
    return scored.select(
        *pairs.columns,
        F.col("ref").alias("reference_normalized"),
        F.col("hyp").alias("hypothesis_normalized"),
        pct(ratio("edits.words", T.word_count("ref"))).alias("wer_pct"),
        pct(ratio("edits.chars", F.length("ref"))).alias("cer_pct"),
    )


# --- counts and the summary --------------------------------------------------------------


def valid_pairs(pairs: DataFrame) -> DataFrame:
    """Rows where both raw texts hold something besides whitespace."""
    return pairs.where(~T.is_blank("hypothesis") & ~T.is_blank("reference"))


def split_failed(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored rows, failed rows). A missing reference is skipped and is no failure."""
    known = predictions.where(~T.is_blank("reference", stripped=False))
    return known.where(F.col("error").isNull()), known.where(F.col("error").isNotNull())


def run_counts(predictions: DataFrame) -> DataFrame:
    has_reference = ~T.is_blank("reference", stripped=False)
    failed = F.col("error").isNotNull()
    return predictions.agg(
        F.count_if(has_reference & ~failed).alias("processed"),
        F.count_if(has_reference & failed).alias("failed"),
        F.count_if(~has_reference).alias("skipped"),
    )


def evaluate_predictions(predictions: DataFrame, mode: str = "normalized") -> DataFrame:
    """`evaluate` of the rows that went well, with the counts of processed, failed and skipped rows
    beside the metrics, in one row. `predictions`: id, reference, hypothesis, error.

    They are written once first: a model behind them sees each row once, and counts and metrics are
    of the same predictions."""
    predictions = pin(predictions.select("id", "reference", "hypothesis", "error"), "predictions")
    counts = run_counts(predictions).withColumn("_one", F.lit(1))
    metrics = evaluate(split_failed(predictions)[0], mode).withColumn("_one", F.lit(1))
    return metrics.join(F.broadcast(counts), "_one").drop("_one")  # one row each


def evaluate(
    pairs: DataFrame, mode: str = "normalized", embedding_scores: DataFrame | None = None, id_col: str = "id"
) -> DataFrame:
    """All corpus metrics and the quality band in one row, from one pass over the pairs.

    `embedding_scores` (id, f1) comes from `embedding_score`; the scores of the pairs that are blank
    on neither side count. Without any the similarity is 0.0.
    """
    raw = _totals(pairs, mode, ALL_PARTS).select(
        _total("hits", "rows").alias("total_samples"),
        _bleu().alias("b"),
        _chrf().alias("c"),
        _error_rate("word_edit").alias("w"),
        _error_rate("char_edit").alias("e"),
        _overlap().alias("o"),
    )
    if embedding_scores is None:
        similarity = F.lit(0.0)
    else:
        scored = embedding_scores.join(valid_pairs(pairs).select(id_col).distinct(), id_col, "left_semi")
        similarity = F.coalesce(scored.agg(F.avg("f1").alias("mean_f1")).scalar(), F.lit(0.0))
    return raw.select(
        "total_samples",
        F.round("b", 2).alias("bleu"),
        F.round("c", 2).alias("chrf"),
        F.round(similarity, 4).alias("bertscore_f1"),
        pct("w").alias("wer_pct"),
        pct("e").alias("cer_pct"),
        pct(1 - F.col("w")).alias("word_accuracy_pct"),
        F.round("o", 2).alias("word_overlap_pct"),
        quality_band("b").alias("quality"),
    )
