"""Bottom-k sketches of word shingles: fingerprints that can be merged and compared."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paracorpus.llm.shingles import shingle_hashes

#: Hashes kept per text.
K = 256


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct hashes; all of them if there are fewer."""
    return hashes[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two texts' shingles: sketches of parts give that of the whole."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated intersection over union: the share of the union's k smallest that both have. Exact
    for at most k shingles in all; two empty sketches have 1, an empty and another one 0."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has, from resemblance and the union's size; 1 if a is empty."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


#: Characters of text per range of ids, and the most ranges: their bounds are held by the driver.
RANGE_CHARS, MOST_RANGES = 8_000_000, 20_000
#: Stands for a null id in the order of ids: the smallest.
NO_ID = -(1 << 63)


def follow_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """range, guest, key, text: ranges of documents in descending order of ids, each closed by the
    first document of the next range as a guest (the last range by the first of all).

    One shuffle of the texts. The bounds come from quantiles of the ids; the driver holds one bound
    and one first id per range, at most `MOST_RANGES`, and no text.
    """
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    total = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    ranges = min(MOST_RANGES, total // RANGE_CHARS + 1)
    ids = docs.select(F.col(id_col).cast("long").alias("key"))
    at = [i / ranges for i in range(1, ranges)]
    bounds = np.array(sorted({int(x) for x in ids.approxQuantile("key", at, 0.25 / ranges)} if at else []), np.int64)

    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.searchsorted(bounds, batch.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    numbered = F.arrow_udf(number, T.IntegerType())
    firsts = dict(keyed.select("key").withColumn("range", numbered("key")).groupBy("range").agg(F.max("key")).collect())
    held = sorted(firsts)
    # The range that a range's first document also goes to: the one above it; the top's, to the lowest.
    goes_to = dict(zip(held, held[1:] + held[:1]))
    first_keys = np.array(sorted(firsts.values()), np.int64)
    targets = np.array([goes_to[r] for r in sorted(firsts, key=firsts.get)], np.int32)

    def guest_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys = batch.to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(first_keys, keys), len(first_keys) - 1)
            yield pa.array(np.where(first_keys[place] == keys, targets[place], -1).astype(np.int32))

    if not held:
        return keyed.select(F.lit(0).alias("range"), F.lit(False).alias("guest"), "key", "text")
    seats = F.array(
        F.struct(F.col("own").alias("range"), F.lit(False).alias("guest")),
        F.struct(F.col("other").alias("range"), F.lit(True).alias("guest")),
    )
    return (
        keyed.withColumn("own", numbered("key"))
        .withColumn("other", F.arrow_udf(guest_of, T.IntegerType())("key"))
        .select("key", "text", F.explode(F.filter(seats, lambda s: s["range"] >= 0)).alias("seat"))
        .select("seat.range", "seat.guest", "key", "text")
        .repartition(len(held), "range")
        .sortWithinPartitions("range", "guest", F.desc("key"), "text")
    )


FINGERPRINTS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, distinct_shingles double, edited_containment double"
)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likenesses.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many first
    ones (or all) of the next document in descending order of ids; the first follows the last.
    Fingerprints are base64 of the sorted k smallest 64-bit shingle hashes. near_edited and near_next
    estimate the resemblance to the edited text and to the next document, distinct_shingles the
    number of shingles, edited_containment how much of the edited text's shingles the text has.

    A null text counts as empty. Null ids come last; equal ids are ordered by text. A text without
    words has the empty fingerprint, which resembles another empty one fully and all others not at
    all. A single document is its own next one. Tasks stream sorted rows and hold two texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in FINGERPRINTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]

        def pack(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        rows, last = [], None
        for batch in batches:
            for place, guest, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                now = sketch(shingle_hashes(text), k)
                if last is not None and last[0] == place:
                    _, _, last_key, last_text, last_sketch = last
                    half = len(last_text) // 2
                    edited = last_text[: len(last_text) - half] + text[:half]
                    other = sketch(shingle_hashes(edited), k)
                    rows.append((
                        None if last_key == NO_ID else last_key, len(last_text),
                        hashlib.sha256(edited.encode()).hexdigest(), to_text(last_sketch), to_text(other),
                        resemblance(last_sketch, other, k), resemblance(last_sketch, now, k),
                        distinct(last_sketch, k), containment(other, last_sketch, k),
                    ))
                    if len(rows) == 500:
                        yield pack(rows)
                        rows = []
                # Of several guests (equal ids) the first closes the range.
                last = None if guest else (place, guest, key, text, now)
        if rows:
            yield pack(rows)

    return follow_in_order(docs, id_col, text_col).mapInArrow(run, FINGERPRINTS).withColumnRenamed("doc_id", id_col)
