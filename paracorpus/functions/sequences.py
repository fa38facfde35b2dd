"""Column functions over unit sequences (arrays). Row-local: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paracorpus.functions.text import _col


def prefix(seq, n: int) -> Column:
    return F.slice(_col(seq), 1, n)


def sorted_desc(seq) -> Column:
    return F.sort_array(_col(seq), asc=False)


def positional_similarity(left, right) -> Column:
    """Equal positions over the shorter length; 0.0 when either side is empty."""
    left, right = _col(left), _col(right)
    shorter = F.least(F.size(left), F.size(right))
    hits = F.zip_with(
        F.slice(left, F.lit(1), shorter),
        F.slice(right, F.lit(1), shorter),
        lambda a, b: F.when(a == b, 1).otherwise(0),
    )
    matches = F.aggregate(hits, F.lit(0), lambda total, hit: total + hit)
    return F.when(shorter > 0, matches.cast("double") / shorter).otherwise(F.lit(0.0))


def run_lengths(units) -> Column:
    """struct<units, durations> of a sequence with repeats collapsed.

    Both arrays have one entry per run, and the durations add up to the input length.
    """
    units = _col(units)
    numbered = F.transform(units, lambda u, i: F.struct(u.alias("unit"), i.alias("at")))
    previous = F.concat(F.array(F.lit(None)), units)
    starts = F.filter(
        F.zip_with(numbered, previous, lambda n, p: F.struct(n.unit, n.at, p.alias("before"))),
        lambda s: s.at.isNotNull() & ((s.at == 0) | (s.unit != s.before)),
    )
    begin = F.transform(starts, lambda s: s.at)
    end = F.concat(
        F.slice(begin, F.lit(2), F.greatest(F.size(begin) - 1, F.lit(0))), F.array(F.size(units))
    )
    return F.struct(
        F.transform(starts, lambda s: s.unit).alias("units"),
        F.when(
            F.size(units) > 0, F.zip_with(begin, end, lambda b, e: (e - b).cast("int"))
        ).otherwise(F.array().cast("array<int>")).alias("durations"),
    )


def expand_runs(units, durations) -> Column:
    """Inverse of `run_lengths`."""
    return F.flatten(F.zip_with(_col(units), _col(durations), F.array_repeat))


def seconds(samples, rate: int = 16000) -> Column:
    return _col(samples) / F.lit(float(rate))


def needs_resample(rate, target: int = 16000) -> Column:
    return _col(rate) != target


def needs_downmix(channels) -> Column:
    return _col(channels) > 1
