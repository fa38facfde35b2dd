"""Pair audio with text by file stem, look up speakers, and shape examples.

Joins carry no broadcast hints: adaptive execution broadcasts a side it has measured to be
small and splits partitions that turn out skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paracorpus.functions import text as T

# The columns of an example, in order.
EXAMPLE_COLUMNS = [
    "id", "audio", "transcript", "english_translation",
    "dialect", "participant_id", "age_group", "gender",
]
SPEAKER_COLUMNS = ["dialect", "age_group", "gender"]
# Rows of one speaker that meet in one task.
SPEAKER_ROWS = 1_000_000


def to_examples(df: DataFrame, mapping: dict[str, str | Column]) -> DataFrame:
    """Conform to the example columns, all strings; what `mapping` leaves out becomes null."""
    def value(name: str) -> Column:
        source = mapping.get(name)
        if source is None:
            return F.lit(None).cast("string")
        return (F.col(source) if isinstance(source, str) else source).cast("string")

    return df.select(*[value(name).alias(name) for name in EXAMPLE_COLUMNS])


def non_empty(df: DataFrame, column: str, strip: bool = True) -> DataFrame:
    return df.where(~T.is_blank(column, stripped=strip))


def complete_only(
    df: DataFrame, columns: tuple[str, ...] = ("audio_path", "transcript", "english_translation")
) -> DataFrame:
    """Rows in which none of the columns is null or empty."""
    for column in columns:
        df = df.where(~T.is_blank(column, stripped=False))
    return df


def pair_by_stem(audio: DataFrame, text: DataFrame) -> DataFrame:
    """Inner join on `stem`; files without a partner are left out."""
    return audio.join(text, "stem")


def pair_first_audio(text: DataFrame, audio: DataFrame, path: str = "path") -> DataFrame:
    """Every text with the first (smallest) audio path of its stem, of whatever extension."""
    first = audio.groupBy("stem").agg(F.min(path).alias(path))
    return text.join(first, "stem")


def coverage(audio: DataFrame, text: DataFrame) -> DataFrame:
    """How many audio files have a text: matched, total, share in percent."""
    known = text.select("stem").distinct().withColumn("_known", F.lit(1))
    joined = audio.select("stem").join(known, "stem", "left")
    return joined.agg(F.count("_known").alias("matched"), F.count("*").alias("total")).withColumn(
        "share", F.col("matched") * 100 / F.nullif(F.col("total"), F.lit(0))
    )


def missing_items(manifest: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Manifest rows that the cache does not hold yet."""
    return manifest.join(cached, key, "left_anti")


def with_participants(
    df: DataFrame, meta: DataFrame, id_col: str = "id", rows_per_task: int = SPEAKER_ROWS
) -> DataFrame:
    """Attach speaker attributes by the participant id in the stem; nulls where there is none.

    One speaker may hold most of the rows. Speakers are counted first (one narrow aggregate); those
    with more than `rows_per_task` rows are spread over as many salts as that takes, and their
    speaker row is repeated once per salt. Rows without an id go round the join. There are at
    most rows / rows_per_task such speakers, so their table is broadcast.
    """
    rows = df.withColumn("participant_id", T.participant_id(id_col))
    known, nameless = rows.where("participant_id is not null"), rows.where("participant_id is null")
    heavy = (
        known.groupBy("participant_id")
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > rows_per_task)
        .select("participant_id", F.ceil(F.col("_rows") / rows_per_task).alias("_salts"))
    )
    salts = F.coalesce("_salts", F.lit(1))
    salted = known.join(F.broadcast(heavy), "participant_id", "left").withColumn("_salt", F.pmod(F.xxhash64(id_col), salts)).drop("_salts")
    speakers = (
        meta.select("participant_id", *[T.blank_to_null(c).alias(c) for c in SPEAKER_COLUMNS])
        .join(F.broadcast(heavy), "participant_id", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
        .drop("_salts")
    )
    found = salted.join(speakers, ["participant_id", "_salt"], "left").drop("_salt")
    names = [c for c in df.columns if c != "participant_id"]
    return found.unionByName(nameless, allowMissingColumns=True).select(*names, "participant_id", *SPEAKER_COLUMNS)
