"""Inputs of the registered queries, derived from whole tables of the driver's data."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paracorpus.functions import text as T
from paracorpus.operators.pairing import to_examples
from paracorpus.session import checkpoint_dir
from paracorpus.sources.folders import write_files
from paracorpus.sources.participants import one_per_participant

# What the simulated recogniser mishears (substitution, loss, insertion).
MISHEARD = [
    ("th", "t"), ("sch", "s"), ("eau", "o u"), (" la ", " "), (" of ", " "), (" en ", " em "),
]
# Codes of the event types.
UNIT_OF_EVENT = ["error", "click", "purchase", "view", "signup"]
TOKENS_PER_PAIR = 16
BATCH_SIZE, BOS = 16, 1
# The setting by which a session spreads small inputs.
INPUT_PARTITIONS = "paracorpus.input.partitions"


def table(
    spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, spread: bool = False
) -> DataFrame:
    """One of the driver's tables. `spread` is for CPU-heavy work: if the session names a number of partitions
    (`INPUT_PARTITIONS`), as for files too small to be split, the rows are dealt to that many."""
    df = spark.read.parquet(f"{folder}/{name}.parquet").select(*(columns or ["*"]))
    partitions = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(partitions)) if spread and partitions else df


def misheard(text) -> Column:
    value = F.col(text) if isinstance(text, str) else text
    for said, heard in MISHEARD:
        value = F.replace(value, F.lit(said), F.lit(heard))
    return value


def document_pairs(spark, folder) -> DataFrame:
    """Every document against what a recogniser made of it."""
    docs = table(spark, folder, "documents", ["doc_id", "text"], spread=True)
    return docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("reference"), misheard("text").alias("hypothesis")
    )


def spoken_pairs(spark, folder) -> DataFrame:
    """Every turn of every conversation against what a recogniser made of it."""
    return table(spark, folder, "conversations", ["conv_id", "turn", "text"], spread=True).select(
        F.concat_ws("_", "conv_id", "turn").alias("id"),
        F.col("text").alias("reference"),
        misheard("text").alias("hypothesis"),
    )


def reply_pairs(spark, folder) -> DataFrame:
    """User turns and the assistant turn that follows; `error` where none does."""
    turns = table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis")
    )
    return asked.join(replies, ["conv_id", "turn"], "left").select(
        F.concat_ws("_", "conv_id", "turn").alias("id"),
        "reference",
        "hypothesis",
        F.when(F.col("hypothesis").isNull(), "no reply").alias("error"),
    )


def named_documents(spark, folder) -> DataFrame:
    """Documents as files of a corpus tree: Spanish ones have no speaker in their name."""
    name = F.when(
        F.col("lang") != "es", F.concat(F.lit("P-"), "source", F.lit("-"), "lang", F.lit("_"), "doc_id")
    ).otherwise(F.concat(F.lit("x_"), "doc_id"))
    return table(spark, folder, "documents").withColumn("stem", name)


def hidden(stem) -> Column:
    """Two of five names begin as names that file listings often leave out."""
    first = F.when(F.col("doc_id") % 5 == 0, "_").when(F.col("doc_id") % 5 == 1, ".").otherwise("")
    return F.concat(first, stem)


def document_tree(spark, folder) -> str:
    """Every document as a text file of a corpus tree in the shared folder, all but the Spanish ones with an
    audio file of no content. Written anew for each query."""
    root = f"{checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}"
    docs = named_documents(spark, folder).withColumn("stem", hidden(F.col("stem"))).select("stem", "text", "lang")
    texts = docs.select(F.concat(F.lit(f"{root}/train/TXT/"), "stem", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    audio = docs.where("lang <> 'es'").select(F.concat(F.lit(f"{root}/train/AUDIO/"), "stem", F.lit(".wav")).alias("path"), F.lit("").alias("content"))
    write_files(texts.unionByName(audio))
    return root


def participants(spark, folder) -> DataFrame:
    """Speaker rows written down at each toxic document; the last one counts."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    flagged = table(spark, folder, "labels").where(F.col("toxic") == 1).select("doc_id")
    rows = docs.join(flagged, "doc_id").select(
        F.concat(F.lit(" P-"), "source", F.lit("-"), "lang").alias("participant_id"),
        F.when(F.col("n_chars") > 2000, "").otherwise(F.col("lang")).alias("dialect"),
        F.when(F.col("n_chars") > 1000, "30-45").otherwise("18-30").alias("age_group"),
        F.when(F.col("lang") == "en", "f").otherwise("m").alias("gender"),
        F.col("doc_id").alias("row_no"),
    )
    return one_per_participant(rows)


def tree_examples(spark, folder, split: str) -> DataFrame:
    """Labelled documents are the train split, the others the test split."""
    labelled = table(spark, folder, "labels").select("doc_id")
    how = "left_semi" if split == "train" else "left_anti"
    return to_examples(
        named_documents(spark, folder).join(labelled, "doc_id", how),
        {
            "id": "stem",
            "audio": F.concat(F.lit(f"{split}/AUDIO/"), "stem", F.lit(".wav")),
            "english_translation": "text",
            "participant_id": T.participant_id("stem"),
        },
    )


def recordings(spark, folder) -> DataFrame:
    """All turns as the recordings table; the opening turn has no transcript."""
    turns = table(spark, folder, "conversations")
    return turns.select(
        F.concat_ws("_", "conv_id", "turn").alias("id"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), "turn", F.lit(".m4a")).alias("audio_path"),
        F.when(F.col("turn") == 0, "").otherwise(F.col("text")).alias("transcript"),
        F.col("text").alias("english_translation"),
        F.concat(F.lit("d"), F.length("text") % 3).alias("dialect"),
        F.concat(F.lit("P-"), "conv_id").alias("participant_id"),
        "role",
    )


def audio_files(spark, folder) -> DataFrame:
    """No Spanish document has audio; the French ones have a second file type."""
    docs = named_documents(spark, folder).select("stem", "lang").where(F.col("lang") != "es")
    endings = F.when(F.col("lang") == "fr", F.array(F.lit(".wav"), F.lit(".mp3"))).otherwise(
        F.array(F.lit(".wav"))
    )
    files = docs.select("stem", F.explode(endings).alias("ending"))
    path = F.concat(F.lit("AUDIO/"), "stem", "ending")
    return files.select(T.stem(path).alias("stem"), path.alias("path"))


def text_files(spark, folder) -> DataFrame:
    """German documents have no text file."""
    docs = named_documents(spark, folder).where(F.col("lang") != "de")
    return docs.select(T.stem(F.concat(F.lit("TXT/"), "stem", F.lit(".txt"))).alias("stem"), "text")


def cached_audio(spark, folder) -> DataFrame:
    """The wav files are there already."""
    return audio_files(spark, folder).where(F.col("path").endswith(".wav")).select("path")


def _as_units(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("id"),
        F.transform(T.words(T.normalize("text")), F.length).alias("units"),
        F.col("lang").alias("text"),
    )


def _documents(spark, folder) -> DataFrame:
    return table(spark, folder, "documents", ["doc_id", "text", "lang"], spread=True)


def unit_sequences(spark, folder) -> DataFrame:
    """Every document as a unit sequence: the lengths of its words."""
    return _as_units(_documents(spark, folder))


def unit_queries(spark, folder) -> DataFrame:
    """Labelled documents ask."""
    labelled = table(spark, folder, "labels", ["doc_id"])
    return _as_units(_documents(spark, folder).join(labelled, "doc_id", "left_semi")).drop("text")


def unit_training(spark, folder) -> DataFrame:
    """The others answer with their language."""
    labelled = table(spark, folder, "labels", ["doc_id"])
    return _as_units(_documents(spark, folder).join(labelled, "doc_id", "left_anti"))


def unit_references(spark, folder) -> DataFrame:
    """The true language is known for documents of good quality only."""
    good = table(spark, folder, "labels").where(F.col("quality") == 1).select("doc_id")
    docs = table(spark, folder, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")
    return docs.select(F.col("doc_id").alias("id"), F.upper("lang").alias("text"))


def event_stream(spark, folder) -> DataFrame:
    unit = F.array_position(F.array(*map(F.lit, UNIT_OF_EVENT)), F.col("event_type")) - 1
    return table(spark, folder, "events").select("user_id", "ts", "event_id", unit.cast("int").alias("unit"))


def scored(spark, folder) -> DataFrame:
    """Events as retrieval results; every bucket edge and 1.0 itself occur."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        ((F.col("event_id") % 101) / F.lit(100.0)).alias("confidence"),
        (F.col("event_id") % 3 == 0).alias("correct"),
        "value",
    )


def frames(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")
    )


def codebook(spark, folder) -> DataFrame:
    """The first vector of each label."""
    first = F.min_by("embedding", "vec_id").cast("array<double>")
    return (
        table(spark, folder, "embeddings")
        .groupBy(F.col("label").alias("unit"))
        .agg(first.alias("vec"))
    )


def token_pairs(spark, folder) -> DataFrame:
    """Sixteen neighbouring vectors make one pair of texts, even ones the hypothesis."""
    vec = F.col("embedding").cast("array<double>")
    side = F.col("vec_id") % 2
    return (
        table(spark, folder, "embeddings")
        .groupBy(F.floor(F.col("vec_id") / TOKENS_PER_PAIR).alias("id"))
        .agg(
            F.collect_list(F.when(side == 0, vec)).alias("hyp_vecs"),
            F.collect_list(F.when(side == 1, vec)).alias("ref_vecs"),
        )
    )


def turn_vectors(spark, folder) -> DataFrame:
    """The token vectors of every turn whose place in its conversation has a pair of texts."""
    turns = table(spark, folder, "conversations", ["conv_id", "turn"])
    pairs = token_pairs(spark, folder).withColumnRenamed("id", "pair")
    return turns.join(pairs, turns["conv_id"] == pairs["pair"]).select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), "hyp_vecs", "ref_vecs"
    )


def labelled(spark, folder) -> DataFrame:
    """Label sequences; every second batch of documents starts with BOS throughout."""
    units = F.transform("units", lambda u: u + BOS + 1)
    starts = F.floor(F.col("id") / BATCH_SIZE) % 2 == 0
    return unit_sequences(spark, folder).select(
        "id", F.when(starts, F.concat(F.array(F.lit(BOS)), units)).otherwise(units).alias("labels")
    )


def blanks(spark, folder) -> DataFrame:
    """Documents with empty, blank and missing texts among them."""
    emptied = (
        F.when(F.col("lang") == "de", "")
        .when(F.col("lang") == "es", "   ")
        .when(F.col("lang") == "en", F.col("text"))
    )
    return table(spark, folder, "documents").select("doc_id", emptied.alias("text"))
