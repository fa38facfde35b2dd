"""Small closed-form column expressions used in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paracorpus.functions.text import _col

# Upper edges of the BLEU bands, confidence tiers and bucket edges.
QUALITY_BANDS = [(10, "Poor"), (20, "Fair"), (30, "Good")]
TOP_BAND = "Excellent"
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.9, 0.7
BUCKET_EDGES = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def pct(value, digits: int = 2) -> Column:
    return F.round(_col(value) * 100, digits)


def quality_band(bleu) -> Column:
    bleu = _col(bleu)
    band = F
    for edge, name in QUALITY_BANDS:
        band = band.when(bleu < edge, name)
    return band.otherwise(TOP_BAND)


def tier(confidence) -> Column:
    confidence = _col(confidence)
    return (
        F.when(confidence >= HIGH_CONFIDENCE, "high")
        .when(confidence >= MEDIUM_CONFIDENCE, "medium")
        .otherwise("low")
    )


def ratio(numerator, denominator) -> Column:
    """Division that yields null, not an error, for an empty denominator."""
    return _col(numerator).cast("double") / F.nullif(_col(denominator).cast("double"), F.lit(0.0))
