"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paracorpus.functions import sequences as S
from paracorpus.functions import text as T
from paracorpus.functions.scoring import quality_band
from paracorpus.operators import (
    batching,
    codebook,
    embeddings,
    positions,
    prediction,
    splitting,
    unit_streams,
)
from paracorpus.operators import confidence as C
from paracorpus.operators import evaluation as E
from paracorpus.operators import neighbours as N
from paracorpus.operators import pairing as P
from paracorpus.operators import vocabulary as vocab
from paracorpus.plans import views as V
from paracorpus.session import checkpoint_dir
from paracorpus.sources import cache
from paracorpus.sources.audio import conform_audio
from paracorpus.sources.corpus_tree import read_corpus_tree
from paracorpus.sources.examples import load_examples, recordings_to_examples
from paracorpus.sources.recordings import select_recordings

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def _digest(array) -> F.Column:
    """A long array as one comparable value."""
    return F.md5(F.array_join(F.transform(array, lambda x: x.cast("string")), " "))


# --- sources and preparation -------------------------------------------------------------


@query
def scan_recordings(spark, d):
    return select_recordings(V.recordings(spark, d))


@query
def complete_rows(spark, d):
    return select_recordings(V.recordings(spark, d), require_complete=True)


@query
def missing_items(spark, d):
    return P.missing_items(V.audio_files(spark, d), V.cached_audio(spark, d), "path")


@query
def fill_cache(spark, d):
    """A cache that holds the wav files is filled with what the manifest has besides, each item converted once."""
    folder = f"{checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}"

    def convert(early):
        return lambda files: files.select("path", F.md5("path").alias("digest"), F.lit(early).alias("early"))

    cache.fill_cache(V.cached_audio(spark, d), folder, convert(True))
    everything = V.audio_files(spark, d).select("path")
    return cache.fill_cache(everything.unionAll(everything), folder, convert(False))


@query
def conform_examples(spark, d):
    return recordings_to_examples(V.recordings(spark, d), cache="cache/audio")


@query
def non_empty_text(spark, d):
    return P.non_empty(V.blanks(spark, d), "text")


@query
def file_stem(spark, d):
    docs = V.named_documents(spark, d)
    path = F.concat(F.lit("AUDIO/"), "stem", F.lit(".wav"))
    units = F.concat(F.lit("units/"), "stem", F.lit("_units.npy"))
    return docs.select(path.alias("path"), T.stem(path).alias("stem"), T.unit_stem(T.stem(units)).alias("unit_stem"))


@query
def participant_id(spark, d):
    return V.named_documents(spark, d).select("stem", T.participant_id("stem").alias("participant_id"))


@query
def normalize_text(spark, d):
    docs = V.table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", T.normalize("text").alias("normalized"))


@query
def pair_by_stem(spark, d):
    paired = P.pair_by_stem(V.audio_files(spark, d), V.text_files(spark, d))
    return paired.select("stem", "path", F.length("text").alias("chars"))


@query
def pair_first_audio(spark, d):
    return P.pair_first_audio(V.text_files(spark, d).select("stem"), V.audio_files(spark, d))


@query
def corpus_tree_pairs(spark, d):
    """The texts of a folder tree with content, each with its first audio file, whatever their names."""
    texts, audio = read_corpus_tree(spark, V.document_tree(spark, d), "train")
    pairs = P.pair_first_audio(P.non_empty(texts, "text"), audio)
    return pairs.select("stem", "text", F.regexp_extract("path", "([^/]+)$", 1).alias("audio"))


@query
def pair_coverage(spark, d):
    return P.coverage(V.audio_files(spark, d), V.text_files(spark, d))


@query
def participant_lookup(spark, d):
    docs = V.named_documents(spark, d).select("stem")
    return P.with_participants(docs, V.participants(spark, d), "stem")


@query
def union_sources(spark, d):
    return load_examples(
        "train",
        recordings=lambda split: recordings_to_examples(V.recordings(spark, d)),
        tree=lambda split: V.tree_examples(spark, d, split),
    )


@query
def ingest_examples(spark, d):
    """Texts with content, their first audio file, their speakers, and the recordings beside them."""
    def tree(split):
        texts = P.non_empty(V.text_files(spark, d), "text")
        paired = P.pair_first_audio(texts, V.audio_files(spark, d))
        spoken = P.with_participants(paired, V.participants(spark, d), "stem")
        return P.to_examples(spoken, {
            "id": "stem", "audio": "path", "english_translation": "text", "dialect": "dialect",
            "participant_id": "participant_id", "age_group": "age_group", "gender": "gender",
        })

    return load_examples("train", recordings=lambda split: recordings_to_examples(V.recordings(spark, d)), tree=tree)


@query
def nth_item(spark, d):
    return positions.nth_item(V.table(spark, d, "documents", ["doc_id", "lang", "source"]), "doc_id", 7)


# --- training examples -------------------------------------------------------------------


@query
def split_exact(spark, d):
    return splitting.split_exact(V.table(spark, d, "documents", ["doc_id"]), 0.1, 42, "doc_id")


@query
def encode_labels(spark, d):
    docs = V.table(spark, d, "documents", ["doc_id", "text"], spread=True).select(
        F.col("doc_id").alias("id"), T.normalize("text").alias("text")
    )
    coded = vocab.encode_labels(docs, vocab.fit_vocab(docs))
    return coded.select("id", F.size("labels").alias("n"), _digest("labels").alias("labels"))


@query
def encode_labels_joined(spark, d):
    """The same with most words outside the tasks' table."""
    docs = V.table(spark, d, "documents", ["doc_id", "text"], spread=True).select(
        F.col("doc_id").alias("id"), T.normalize("text").alias("text")
    )
    coded = vocab.encode_labels(docs, vocab.fit_vocab(docs), frequent=1000)
    return coded.select("id", F.size("labels").alias("n"), _digest("labels").alias("labels"))


@query
def vocabulary(spark, d):
    docs = V.table(spark, d, "documents", ["text"])
    return vocab.fit_vocab(docs.select(T.normalize("text").alias("text")))


@query
def pad_labels(spark, d):
    padded = batching.pad_labels(V.labelled(spark, d), V.BATCH_SIZE, V.BOS)
    return padded.select("batch", "id", F.size("labels").alias("width"), _digest("labels").alias("labels"))


# --- evaluation --------------------------------------------------------------------------


@query
def corpus_wer(spark, d):
    return E.corpus_wer(V.spoken_pairs(spark, d))


@query
def corpus_cer(spark, d):
    return E.corpus_cer(V.spoken_pairs(spark, d))


@query
def sample_scores(spark, d):
    return E.sample_scores(V.spoken_pairs(spark, d)).drop("reference", "hypothesis")


@query
def reply_cer(spark, d):
    """Unrelated texts: rates far above one."""
    return E.corpus_cer(E.split_failed(V.reply_pairs(spark, d))[0])


@query
def corpus_bleu(spark, d):
    return _rounded(E.corpus_bleu(V.document_pairs(spark, d)), "bleu")


@query
def corpus_chrf(spark, d):
    return _rounded(E.corpus_chrf(V.document_pairs(spark, d)), "chrf")


@query
def word_overlap(spark, d):
    return _rounded(E.word_overlap(V.document_pairs(spark, d)), "word_overlap")


@query
def length_stats(spark, d):
    return _rounded(
        E.length_stats(V.document_pairs(spark, d)),
        "mean_hypothesis_words", "mean_reference_words", "length_ratio",
    )


@query
def valid_pairs(spark, d):
    return E.valid_pairs(V.reply_pairs(spark, d)).select("id", "reference", "hypothesis")


@query
def failed_counts(spark, d):
    return E.run_counts(V.reply_pairs(spark, d))


@query
def quality_bands(spark, d):
    return V.scored(spark, d).select("id", quality_band("value").alias("quality"))


@query
def embedding_score(spark, d):
    return _rounded(embeddings.embedding_score(V.token_pairs(spark, d)), "precision", "recall", "f1")


@query
def eval_summary(spark, d):
    """The flagship: every corpus metric in one row."""
    scores = embeddings.embedding_score(V.turn_vectors(spark, d))
    return E.evaluate(V.spoken_pairs(spark, d), embedding_scores=scores)


@query
def predict_and_evaluate(spark, d):
    """A model applied to every turn, and its metrics beside what went wrong."""
    turns = V.table(spark, d, "conversations", ["conv_id", "turn", "text"]).select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("text").alias("reference"), "text"
    )
    predicted = prediction.batch_predict(turns, _answering, column="text", reference="reference")
    return E.evaluate_predictions(prediction.predictions(predicted))


@query
def first_samples(spark, d):
    """The first ten samples with their error rates."""
    scores = E.sample_scores(positions.head_n(V.spoken_pairs(spark, d), "id", 10))
    return scores.select("id", "reference_normalized", "hypothesis_normalized", "wer_pct", "cer_pct")


@query
def eval_documents(spark, d):
    """The same over whole documents, where edit distance is out of reach for plain SQL."""
    return E.evaluate(V.document_pairs(spark, d))


@query
def eval_raw(spark, d):
    """Scores of the raw texts, tokenised by the published rules."""
    return E.evaluate(V.spoken_pairs(spark, d), mode="raw")


@query
def batch_predict(spark, d):
    turns = V.table(spark, d, "conversations", ["conv_id", "turn", "text"])
    return prediction.batch_predict(turns, _answering, column="text", out="hypothesis").drop("text")


def _answering():
    def answer(text):
        if "sch" in text:
            raise ValueError("not a language of this model")
        return text.replace("th", "z")

    return answer


# --- retrieval ---------------------------------------------------------------------------


@query
def units_scan(spark, d):
    rows = V.unit_sequences(spark, d)
    return rows.select("id", F.size("units").alias("n"), _digest("units").alias("units"), "text")


@query
def unit_stats(spark, d):
    return _rounded(unit_streams.unit_stats(V.unit_training(spark, d)), "mean_units")


@query
def unit_prefix(spark, d):
    return V.unit_sequences(spark, d).select(
        "id", *[F.array_join(S.prefix("units", n), " ").alias(f"first_{n}") for n in (10, 20, 30)]
    )


@query
def unit_text_roundtrip(spark, d):
    text = V.unit_sequences(spark, d).select("id", T.units_to_text("units").alias("text"))
    back = T.text_to_units(F.concat(F.lit("<unk> "), F.replace("text", F.lit(" 7 "), F.lit(" <unk> "))))
    return text.select("id", F.md5("text").alias("text"), _digest(back).alias("units"))


@query
def unit_similarity(spark, d):
    """Each reply against the turn before it."""
    pairs = V.reply_pairs(spark, d).where(F.col("error").isNull())
    units = [
        F.transform(T.words(T.normalize(c)), F.length) for c in ("reference", "hypothesis")
    ]
    return pairs.select("id", F.round(S.positional_similarity(*units), 9).alias("similarity"))


@query
def knn_topk(spark, d):
    best = N.knn(V.unit_queries(spark, d), V.unit_training(spark, d), k=3)
    return _rounded(best, "similarity", digits=9)


@query
def knn_translate(spark, d):
    return _rounded(_translated(spark, d), "confidence", digits=9)


@query
def knn_indexed(spark, d):
    """The translation of every query by an index that was written before."""
    folder = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    N.write_index(V.unit_training(spark, d), folder)
    return _rounded(N.translate_index(V.unit_queries(spark, d), folder), "confidence", digits=9)


@query
def reference_default(spark, d):
    queries = V.unit_queries(spark, d).select("id")
    return N.with_reference(queries, V.unit_references(spark, d))


@query
def exact_match(spark, d):
    results = N.with_reference(_translated(spark, d), V.unit_references(spark, d))
    return _rounded(C.exact_match(N.with_correct(results)), "accuracy")


def _translated(spark, d):
    return N.translate(V.unit_queries(spark, d), V.unit_training(spark, d))


@query
def retrieval_results(spark, d):
    """file, reference, translation, confidence, correct, num_units of every query."""
    return _rounded(N.result_table(_translated(spark, d), V.unit_references(spark, d)), "confidence", digits=9)


@query
def retrieval_details(spark, d):
    """The five best neighbours of every query beside its reference."""
    found = N.result_details(V.unit_queries(spark, d), V.unit_training(spark, d), V.unit_references(spark, d))
    return _rounded(found, "similarity", digits=9)


@query
def retrieval_nulls(spark, d):
    """Ranks and shares when every third training row has no text and every fifth query no result."""
    results = _translated(spark, d).withColumns({
        "translation": F.when(F.col("id") % 3 > 0, F.col("translation")),
        "confidence": F.when(F.col("id") % 5 > 0, F.round("confidence", 9)),
    })
    judged = N.with_correct(N.with_reference(results, V.unit_references(spark, d)))
    share = C.correct_share(judged).select("correct", F.round("share", 6).alias("share"))
    return C.rank_curve(judged).join(share, "correct")


# --- confidence --------------------------------------------------------------------------


@query
def confidence_stats(spark, d):
    return _rounded(
        C.confidence_stats(V.scored(spark, d)), "mean_confidence", "min_confidence", "max_confidence"
    )


@query
def confidence_buckets(spark, d):
    return _rounded(C.bucket_accuracy(V.scored(spark, d)), "accuracy")


@query
def confidence_hist(spark, d):
    return _rounded(C.histogram(V.scored(spark, d)), "low", "high", "mean")


@query
def confidence_tiers(spark, d):
    return C.tier_counts(V.scored(spark, d))


@query
def confidence_rank(spark, d):
    return C.rank_curve(V.scored(spark, d))


@query
def correct_share(spark, d):
    return _rounded(C.correct_share(V.scored(spark, d)), "share")


@query
def first_n_per_tier(spark, d):
    rows = V.scored(spark, d).withColumn("tier", C.tier("confidence"))
    return positions.first_n(rows, "tier", "id", 3).select("tier", "place", "id", "confidence", "correct")


# --- units and audio ---------------------------------------------------------------------


@query
def unit_runs(spark, d):
    stream = V.event_stream(spark, d)
    return unit_streams.unit_runs(stream, "user_id", ["ts", "event_id"], "unit", F.date_trunc("hour", "ts"))


@query
def unit_dedupe(spark, d):
    return unit_streams.dedupe_units(V.unit_sequences(spark, d).select("id", "units")).select(
        "id", _digest("units").alias("units"), _digest("durations").alias("durations")
    )


@query
def assign_units(spark, d):
    found = codebook.assign_units(V.frames(spark, d), V.codebook(spark, d))
    return _rounded(found.select("vec_id", "unit", "distance"), "distance")


@query
def fit_codebook(spark, d):
    """What holds for every good codebook: its size, that each unit is used, and that it costs no
    more than the vectors that came first."""
    frames = V.frames(spark, d)
    fitted = codebook.assign_units(frames, codebook.fit_codebook(frames, k=10))
    first = codebook.assign_units(frames, V.codebook(spark, d)).agg(F.sum("distance").alias("cost")).scalar()
    return fitted.agg(
        F.count_distinct("unit").alias("units_used"), F.count("unit").alias("frames"),
        (F.sum("distance") <= first).alias("no_dearer"),
    )


@query
def corpus_stats(spark, d):
    clips = V.table(spark, d, "documents", ["n_chars", "text"]).select(
        (F.col("n_chars") * 100).alias("samples"), T.word_count(T.normalize("text")).alias("words")
    )
    return _rounded(
        unit_streams.corpus_stats(clips, "samples", "words"),
        "min_seconds", "max_seconds", "mean_seconds", "mean_words",
    )


@query
def audio_conform(spark, d):
    """Each embedding played as a short stereo clip at 8 kHz."""
    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for vec in batch["vec"]:
                pcm = np.repeat(np.clip(vec, -1, 1) * 32767, 2).astype("<i2").tobytes()
                head = struct.pack(
                    "<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 2,
                    8000, 32000, 4, 16, b"data", len(pcm),
                )
                made.append(head + pcm)
            names = batch["vec_id"].astype(str)
            yield pd.DataFrame({"id": names, "path": "clips/" + names + ".wav", "content": made})

    made = V.frames(spark, d).select("vec_id", "vec").mapInPandas(
        clip, "id string, path string, content binary"
    )
    # At twice the rate every second sample is one of the input.
    heard = F.transform(F.filter("samples", lambda x, i: i % 2 == 0), lambda x: F.round(x * 32768).cast("int"))
    return conform_audio(made).select("id", "rate", "n", "channels_in", "rate_in", "error", _digest(heard).alias("heard"))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
