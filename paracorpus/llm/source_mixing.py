"""Mix sources to target weights by thresholds on a hash, found with nested histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paracorpus.llm.common import pin

#: Fixed values of the contract: the weights that sources take in turn, and the share of all sizes.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
#: Buckets per source and level, as a power of two: one row each, so windows over them are small.
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stable_hash(value: Column) -> Column:
    """60 bits of the value's md5; the same in every run, engine and partitioning."""
    text = F.coalesce(value.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = 2.0
) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Sources by code point, null last, take the weights in turn. Targets share `share` times all
    sizes by weight; a target stops at `most` times its source's size, and what it leaves is
    shared again by weight. That ends at one common level L with target = min(most * size, L *
    weight), so it is found in one pass over the sources in the order in which they stop. This is
    the list of corpora, two numbers a row: its windows run in one task.
    """
    first_to_stop = F.col("_limit") / F.col("_weight")
    by_stop = W.orderBy(first_to_stop, F.col("source").asc_nulls_last())
    rows = (
        sizes.withColumn("_place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")))
        .withColumn("_limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("_budget", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
        .withColumn("_stopped", F.coalesce(F.sum("_limit").over(by_stop.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(by_stop.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_stopped")) / F.col("_open"))
        # The first source, in this order, that does not stop sets the level for all after it.
        .withColumn("_turn", F.row_number().over(by_stop))
        .withColumn("_free", F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.struct("_turn", "_level"))).over(W.partitionBy()))
    )
    level = F.col("_free._level")
    return rows.select(
        "source",
        "source_size",
        F.when(level.isNull(), F.col("_limit")).otherwise(F.least(F.col("_limit"), level * F.col("_weight"))).alias("target"),
    )


def thresholds(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """source, rounds, bound: a document is taken `rounds` times, and once more if its hash < bound.

    `measured` has source, size, hash. Level 1 sums sizes in 4,096 hash buckets per source and finds
    the bucket where the running sum passes the budget; each further level looks only at the rows
    of that one bucket and splits it again, until it is a single hash value. Budgets nest: a smaller
    one has a smaller bound, so its documents are among those of a larger one. The boundary value
    itself is taken if that ends nearer to the budget.
    """
    budget = F.col("target") - F.col("source_size") * F.floor(F.col("target") / F.col("source_size"))
    at = targets.where("source_size > 0").select(
        "source",
        F.floor(F.col("target") / F.col("source_size")).cast("int").alias("rounds"),
        budget.alias("rest"),
        F.lit(0).cast("long").alias("low"),
    )
    same = F.col("m.source").eqNullSafe(F.col("a.source"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        width = 1 << (HASH_BITS - level * LEVEL_BITS)
        inside = (F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + width * (1 << LEVEL_BITS))
        histogram = (
            measured.alias("m")
            .join(at.select("source", "rounds", "rest", "low").alias("a"), same & inside)
            .groupBy(F.col("a.source").alias("source"), "rounds", "rest", "low", F.floor((F.col("hash") - F.col("low")) / width).cast("int").alias("bucket"))
            .agg(F.sum("size").alias("size"), F.min("hash").alias("least"), F.max("hash").alias("most"))
        )
        before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        at = pin(
            histogram.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
            # The last bucket that begins within the budget; it may end within it, too.
            .where(F.col("before") <= F.col("rest"))
            .groupBy("source", "rounds", "rest", "low")
            .agg(F.max_by(F.struct("bucket", "before", "size", "least", "most"), "bucket").alias("edge"))
            .select(
                "source",
                "rounds",
                (F.col("rest") - F.col("edge.before")).alias("rest"),
                (F.col("low") + F.col("edge.bucket").cast("long") * width).alias("low"),
                F.col("edge.size").alias("size"),
                F.col("edge.least").alias("least"),
                F.col("edge.most").alias("most"),
            ),
            "mix-level",
        )
        if at.where("least < most").isEmpty():
            break
    take_edge = 2 * F.col("rest") >= F.col("size")
    return at.select("source", "rounds", F.when(take_edge, F.col("least") + 1).otherwise(F.col("least")).alias("bound"))


def source_bounds(measured: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target, rounds, bound: one row per source, written."""
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = pin(source_targets(sizes, weights, share, most), "mix-targets")
    bounds = thresholds(measured, targets)
    return pin(
        targets.alias("t")
        .join(bounds.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left")
        .select("t.*", F.coalesce("rounds", F.lit(0)).alias("rounds"), F.coalesce("bound", F.lit(0)).alias("bound")),
        "mix-bounds",
    )


def measured_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size, hash of every document, written."""
    return pin(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            stable_hash(F.col(id_col)).alias("hash"),
        ),
        "mix-sizes",
    )


def copies_of(value: Column, most: float, rounds: str = "rounds", bound: str = "bound") -> Column:
    """How often a document is taken, from its hash and its source's rounds and bound."""
    return F.least(F.col(rounds) + (value < F.col(bound)).cast("int"), F.lit(int(most)))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = 2.0,
) -> DataFrame:
    """One row per row of `docs`: id, source, size, source_size, target, copies, taken.

    size is the number of words, taken = copies * size. Which documents are in depends only on the
    hash of their id: no sort, no window over documents, and reruns agree. The sizes are written
    once (id, source, size, hash) and read again by the histogram levels.

    A null text has size 0; a null source is a source of its own; documents of size 0 follow the
    same rule and take no words. All null ids share one hash, as do repeated ids: such rows are
    taken together. A source without words has target 0. No rows in, no rows out. Other columns
    are ignored.
    """
    measured = measured_sizes(docs, id_col, text_col, source_col)
    bounds = source_bounds(measured, weights, share, most)
    return (
        measured.alias("m")
        .join(bounds.alias("s"), F.col("m.source").eqNullSafe(F.col("s.source")))
        .select(
            F.col("id").alias(id_col),
            F.col("m.source").alias(source_col),
            "size",
            "source_size",
            "target",
            copies_of(F.col("hash"), most).alias("copies"),
        )
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def take_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = 2.0,
) -> DataFrame:
    """The rows of `docs`, each as often as `mix_sources` takes it. The texts stay where they are
    read: a row is judged by its own hash and its source's row of bounds."""
    bounds = source_bounds(measured_sizes(docs, id_col, text_col, source_col), weights, share, most)
    source, rounds, bound, copy = (_unused(docs, x) for x in ("_source", "_rounds", "_bound", "_copy"))
    bounds = bounds.select(F.col("source").alias(source), F.col("rounds").alias(rounds), F.col("bound").alias(bound))
    rows = docs.join(bounds, docs[source_col].eqNullSafe(F.col(source)))
    copies = F.array_repeat(F.lit(0), copies_of(stable_hash(docs[id_col]), most, rounds, bound))
    return rows.withColumn(copy, F.explode(copies)).select(*(docs[c] for c in docs.columns))


def _unused(docs: DataFrame, name: str) -> str:
    """The name, with as much behind it as makes it no column of `docs`."""
    names = {c.lower() for c in docs.columns}
    while name in names:
        name += "_"
    return name
