"""Word vocabulary and label sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from paracorpus.functions import text as T
from paracorpus.operators.positions import with_position

UNKNOWN = 0
# The most frequent words are looked up in the tasks: so many words of at most so many bytes, some
# 40 MB. All others are joined.
FREQUENT, WORD_BYTES = 500_000, 64


def fit_vocab(df: DataFrame, text: str = "text", min_count: int = 1) -> DataFrame:
    """Columns (word, count, word_id): ids from 1, most frequent first, then by word.

    Words are counted per task before the shuffle, so frequent words cost nothing extra.
    """
    counted = (
        df.select(F.explode(T.words(text)).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("count"))
        .where(F.col("count") >= min_count)
    )
    numbered = with_position(counted, F.desc("count"), F.asc("word"), name="word_id")
    return numbered.select("word", "count", (F.col("word_id") + 1).cast("int").alias("word_id"))


@F.arrow_udf(t.ArrayType(t.IntegerType()))
def _put(labels: pa.Array, at: pa.Array, ids: pa.Array) -> pa.Array:
    """Each row's labels with `ids` at the places `at`; one pass, whatever the length of a row."""
    sizes, put = (np.asarray(x.value_lengths().fill_null(0), np.int64) for x in (labels, at))
    offsets = np.append(0, np.cumsum(sizes))
    values = np.array(labels.flatten(), np.int32)
    values[np.repeat(offsets[:-1], put) + np.asarray(at.flatten(), np.int64)] = np.asarray(ids.flatten(), np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def encode_labels(
    df: DataFrame,
    vocab: DataFrame,
    text: str = "text",
    id_col: str = "id",
    frequent: int = FREQUENT,
) -> DataFrame:
    """Columns (id, labels): word ids in text order, unknown words as 0; a row for each row.

    The `frequent` words with the smallest ids, which make up nearly all tokens, are looked up where
    the text is read, without a shuffle. Only the other words of a text travel: they are joined to
    the rest of the vocabulary and put in their places, row by row, so rows may share an id. No rest
    word is frequent, so the join has no hot key.
    """
    entries = vocab.select("word", "word_id")
    in_head = (F.col("word_id") <= frequent) & (F.octet_length("word") <= WORD_BYTES)
    head = entries.where(in_head).toArrow()
    known, ids = head["word"].combine_chunks(), head["word_id"].combine_chunks()

    @F.arrow_udf("array<int>")
    def look_up(word_lists: pa.Array) -> pa.Array:
        place = pc.index_in(word_lists.values, value_set=known)
        labels = pc.fill_null(pc.take(ids, place), UNKNOWN).cast(pa.int32())
        return pa.ListArray.from_arrays(word_lists.offsets, labels)

    words = F.coalesce(T.words(text), F.array().cast("array<string>"))
    found = df.select(id_col, words.alias("words")).withColumn("labels", look_up("words"))
    rest = entries.where(~in_head)
    if rest.isEmpty():
        return found.select(id_col, "labels")
    # The first left-over word of a row, or a null for none, carries the labels of the row; the others must not, as
    # they would be copied for each word.
    at = F.filter(F.sequence(F.lit(0), F.size("words")), lambda i: F.get("labels", i) == UNKNOWN)
    at = F.when(F.size(at) > 0, at).otherwise(F.array(F.lit(None).cast("int")))
    left_over = F.transform(
        at, lambda i, nth: F.struct(i.alias("at"), F.get("words", i).alias("word"), F.when(nth == 0, F.col("labels")).alias("labels"))
    )
    numbered = found.withColumn("row", F.monotonically_increasing_id())
    tokens = numbered.select("row", id_col, F.explode(left_over).alias("token")).select("row", id_col, "token.labels", "token.at", "token.word")
    # collect_list keeps the one array there is; a maximum would copy it at each word.
    coded = tokens.join(rest, "word", "left")
    put = F.when(F.col("word_id").isNotNull(), F.struct("at", "word_id"))
    return (
        coded.groupBy("row")
        .agg(F.first(id_col).alias(id_col), F.get(F.collect_list("labels"), F.lit(0)).alias("labels"), F.collect_list(put).alias("put"))
        .select(id_col, _put("labels", "put.at", "put.word_id").alias("labels"))
    )
