"""Exact duplicates by skew-safe combining: local, salted and global winners, by whole content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paracorpus.llm.common import pin


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256_bytes,
) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; the row with the largest id stays. Three stages, each of which
    groups by the digest *and* the text, so a clash of digests never merges different texts:

    1. every task combines its own copies (the partial aggregate before the first shuffle);
    2. (digest, text, salt) groups combine what the tasks sent; the salt comes from the id, so the
       copies of a very large group meet in `salts` tasks instead of one;
    3. the at most `salts` winners of each text combine into one.

    Rows then look up their group by digest. Only groups of two rows or more take part in that
    join; Spark splits a large group there, as nothing above the join needs its rows together.
    Digests that stand for several texts are looked up by text as well.

    A null text counts as empty. A null id never wins against another id; a group of null ids keeps
    them. Rows that repeat both id and text are one document: all of them are marked alike. No
    rows in, no rows out. Other columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    ).withColumn("_digest", digest(F.col("_text")))
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts))
    salted = (
        rows.withColumn("_salt", salt)
        .groupBy("_digest", "_text", "_salt")
        .agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    )
    # Dealt by digest alone, so both of the following aggregates find their rows in place.
    texts = (
        salted.repartition("_digest")
        .groupBy("_digest", "_text")
        .agg(F.max("_id").alias("_keep"), F.sum("_n").alias("_size"))
    )
    groups = pin(
        texts.groupBy("_digest")
        .agg(
            F.count(F.lit(1)).alias("_texts"),
            F.max("_keep").alias("_keep"),
            F.sum("_size").alias("_size"),
        )
        .where("_size > 1"),
        "exact-groups",
    )
    clashes = groups.where("_texts > 1").select("_digest")
    narrow = rows.select("_id", "_digest", F.sha2("_text", 256).alias("_sha"))
    found = narrow.join(groups, "_digest", "left").where("_texts is null or _texts = 1")
    if not clashes.isEmpty():
        mixed = rows.join(clashes, "_digest", "left_semi")
        salted = (
            mixed.withColumn("_salt", salt)
            .groupBy("_digest", "_text", "_salt")
            .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        )
        exact = salted.groupBy("_digest", "_text").agg(
            F.max("_keep").alias("_keep"), F.sum("_size").alias("_size")
        )
        apart = mixed.join(exact, ["_digest", "_text"]).select(
            "_id", F.sha2("_text", 256).alias("_sha"), "_keep", "_size"
        )
        found = found.select("_id", "_sha", "_keep", "_size").unionByName(apart)
    single = F.col("_size").isNull()
    keep = F.when(single, F.col("_id")).otherwise(F.col("_keep"))
    return found.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_dedup` marks as kept. Rows are known by id and text, as ids may repeat
    with other texts; rows that are alike in both stay or go together. Only ids and digests of dropped
    rows are joined, and rows without an id all stay."""
    dropped = found.where("not kept").select(F.col(id_col).alias("_dropped"), F.col("text_sha256").alias("_sha"))
    same = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == dropped["_sha"]
    return docs.join(dropped, (docs[id_col] == dropped["_dropped"]) & same, "left_anti")
