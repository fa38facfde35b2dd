"""Folders of audio and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paracorpus.functions import text as T
from paracorpus.operators.pairing import (
    non_empty,
    pair_first_audio,
    to_examples,
    with_participants,
)
from paracorpus.sources.folders import list_folders, opened_by_tasks, read_files
from paracorpus.sources.participants import read_participants

# Names inside a corpus tree.
AUDIO_FOLDER, TEXT_FOLDER = "AUDIO", "TXT"
PARTICIPANT_FILE = "Participant_meta_data.csv"


def list_files(spark: SparkSession, folder: str, extension: str | None = None) -> DataFrame:
    """Columns (stem, path) of the files of a folder, of whatever name and size; sub-folders are not entered.

    A task lists the folder. On a file system that only Spark opens, Spark's own listing is used, which leaves
    out names that start with _ or . and has no other way in.
    """
    return _listed(spark, folder, extension).select(T.stem("path").alias("stem"), "path")


def _listed(spark: SparkSession, folder: str, extension: str | None) -> DataFrame:
    if opened_by_tasks(folder):
        files = list_folders(spark, [folder])
    else:
        files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"))
    return files.where(F.col("path").endswith(f".{extension.lstrip('.')}")) if extension else files


def read_texts(spark: SparkSession, folder: str, extension: str | None = None) -> DataFrame:
    """Columns (stem, text): whole UTF-8 files of whatever name, stripped; files without content have an
    empty text. Files are listed by one task and read by many."""
    files = _listed(spark, folder, extension)
    if opened_by_tasks(folder):
        found = read_files(files)
    else:
        found = spark.read.format("binaryFile").load(folder).select("path", "content").join(files.select("path"), "path", "left_semi")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return found.select(T.stem("path").alias("stem"), T.strip(text).alias("text"))


def read_corpus_tree(spark: SparkSession, root: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(texts, audio) of one split: (stem, text) and (stem, path)."""
    return (
        read_texts(spark, f"{root}/{split}/{TEXT_FOLDER}"),
        list_files(spark, f"{root}/{split}/{AUDIO_FOLDER}"),
    )


def read_tree_examples(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Examples of one split: texts with content, an audio file, and speaker attributes."""
    texts, audio = read_corpus_tree(spark, root, split)
    paired = pair_first_audio(non_empty(texts, "text"), audio)
    speakers = read_participants(spark, f"{root}/{PARTICIPANT_FILE}")
    return to_examples(
        with_participants(paired, speakers, "stem"),
        {
            "id": "stem", "audio": "path", "english_translation": "text",
            "dialect": "dialect", "participant_id": "participant_id",
            "age_group": "age_group", "gender": "gender",
        },
    )
