"""Result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column names of the result files, from ours to the published ones.
SAMPLE_HEADER = {
    "id": "filename",
    "reference": "reference",
    "hypothesis": "hypothesis",
    "reference_normalized": "reference_normalized",
    "hypothesis_normalized": "hypothesis_normalized",
    "wer_pct": "wer_%",
    "cer_pct": "cer_%",
}
SUMMARY_HEADER = {
    "total_samples": "Total_Samples",
    "bleu": "BLEU",
    "chrf": "chrF++",
    "bertscore_f1": "BERTScore_F1",
    "wer_pct": "WER_%",
    "cer_pct": "CER_%",
    "word_overlap_pct": "Word_Overlap_%",
    "quality": "Quality",
}
# Columns of the summary beyond the published ones.
EXTRA_SUMMARY = {"word_accuracy_pct": "Word_Accuracy_%"}
# Quotes are doubled, so texts with commas, quotes and line breaks read back unchanged.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _renamed(df: DataFrame, header: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(name) for c, name in header.items()])


def write_samples(scores: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Per-sample CSV, one file per task."""
    _renamed(scores, SAMPLE_HEADER).write.mode(mode).csv(folder, **CSV)


def write_summary(
    summary: DataFrame, folder: str, mode: str = "overwrite", extra: dict[str, str] | None = None
) -> None:
    """The one-row summary as one CSV file; `extra` names further columns, such as `EXTRA_SUMMARY`."""
    _renamed(summary, SUMMARY_HEADER | (extra or {})).coalesce(1).write.mode(mode).csv(folder, **CSV)


def write_results_json(results: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8; characters outside ASCII stay readable."""
    results.write.mode(mode).json(folder, ignoreNullFields=False)


def write_bundle(summary: DataFrame, samples: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """A complete result: the summary row and the sample rows as two parquet tables.

    Samples stay rows, since lists of all of them in one record would need one task's memory.
    """
    summary.write.mode(mode).parquet(f"{folder}/metrics")
    samples.write.mode(mode).parquet(f"{folder}/samples")


def export_index(train: DataFrame, stats: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """A retrieval model: its training rows and a one-row table of figures."""
    train.write.mode(mode).parquet(f"{folder}/training")
    stats.write.mode(mode).parquet(f"{folder}/stats")


def read_bundle(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/metrics"), spark.read.parquet(f"{folder}/samples")


def read_index(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/training"), spark.read.parquet(f"{folder}/stats")
