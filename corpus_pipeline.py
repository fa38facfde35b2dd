"""The corpus pipeline: five stages, each applied to all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paracorpus.llm import exact_dedup, jaccard_join, merge_automaton, source_mixing, toxicity
from paracorpus.llm.common import broadcast_if_small, checkpoint_dir, pin, table
from paracorpus.llm.queries import FOLD, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models do not call toxic. Models are fitted to the labelled ones among
    `docs`; texts are shuffled only if there are too many toxic ones to send their keys to the tasks.
    Null and empty texts score as texts without words; rows alike in id and text go together."""
    models, scale = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), FOLD)
    scored = toxicity.score_keys(docs, models, ["doc_id"])
    toxic = pin(scored.where(toxicity.is_toxic(F.col("difference"), scale)).select("_text"), "toxic")
    keyed = docs.withColumn("_text", toxicity.text_key(["doc_id"]))
    return keyed.join(broadcast_if_small(toxic), "_text", "left_anti").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id. Null texts are empty ones; rows without an id stay, and
    rows that repeat an id with another text are judged by that text."""
    return exact_dedup.keep_rows(docs, exact_dedup.exact_dedup(docs)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group joined by near-duplicate links the document with the smallest id. Texts without words
    are linked with nothing and stay; rows that repeat an id are judged by their own texts."""
    return jaccard_join.keep_rows(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Rows with equal ids are taken
    together; texts without words follow the same rule."""
    return source_mixing.take_mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left, null texts as empty ones."""
    return merge_automaton.encode_digests(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: The first stage scores texts with a fitted model and the last one runs a tokenizer; SQL has neither.
ORACLE_SQL = None
