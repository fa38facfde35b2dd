"""Sufficient statistics of (hypothesis, reference) pairs.

Every corpus metric is a closed form over a few sums, so one pass over the pairs is enough and
only some twenty tiny rows per slice leave a task. Columns of the result:

    kind   'bleu' | 'char' | 'word' | 'word_edit' | 'char_edit' | 'overlap' | 'rows'
    n      n-gram order, 0 where it does not apply
    hits   clipped matches / edits / scored rows
    hyp    n-grams, words or characters of the hypotheses
    ref    the same of the references
    share  sum of per-row shares ('overlap' only)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paracorpus.functions import text as T
from paracorpus.operators.edit_distance import edit_distances

BLEU_ORDERS = 4
CHRF_CHAR_ORDERS = 6
CHRF_WORD_ORDERS = 2
ALL_PARTS = ("ngrams", "chars", "word_edit", "char_edit", "overlap")

STATS_SCHEMA = "kind string, n int, hits long, hyp long, ref long, share double"
ARROW_COLUMNS = [
    ("kind", pa.string()), ("n", pa.int32()), ("hits", pa.int64()),
    ("hyp", pa.int64()), ("ref", pa.int64()), ("share", pa.float64()),
]
# Rows of one Arrow batch are counted in slices of about this many characters, which keeps
# the hash tables in the cache. A longer single text makes a slice of its own.
SLICE_CHARS = 128_000
# So many characters of a batch become Python strings and words at once.
PIECE_CHARS = 2_000_000
ASCII_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def clipped_matches(codes, hyp_sizes, ref_sizes, orders: int) -> list[tuple[int, int, int]]:
    """(matches, hypothesis n-grams, reference n-grams) for n = 1..orders.

    `codes` holds the symbol codes of all hypotheses, then of all references. An n-gram is
    known by the dense rank of (pair, gram), which grows one symbol per order.
    """
    sizes = np.concatenate([hyp_sizes, ref_sizes])
    pair = np.repeat(np.tile(np.arange(len(hyp_sizes)), 2), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    border = int(hyp_sizes.sum())
    alphabet = int(codes.max()) + 1 if len(codes) else 1
    gram = pair
    counts = []
    for n in range(1, orders + 1):
        width = len(codes) - n + 1
        if width <= 0:
            counts.append((0, 0, 0))
            continue
        whole = left[:width] >= n
        rank, distinct = pd.factorize(gram[:width] * alphabet + codes[n - 1 :])
        is_hyp = np.arange(width) < border
        in_hyp = np.bincount(rank[whole & is_hyp], minlength=len(distinct))
        in_ref = np.bincount(rank[whole & ~is_hyp], minlength=len(distinct))
        # A pair whose reference is too short for this order adds no hypothesis n-grams to chrF;
        # BLEU counts them. Both totals follow from the sizes alone.
        counts.append((int(np.minimum(in_hyp, in_ref).sum()), int(in_hyp.sum()), int(in_ref.sum())))
        gram = rank
    return counts


def _without_short_references(hyp_sizes, ref_sizes, n: int) -> int:
    grams = np.maximum(hyp_sizes - n + 1, 0)
    return int(grams[ref_sizes >= n].sum())


def _split_edge_punctuation(word: str) -> list[str]:
    if len(word) > 1 and word[-1] in ASCII_PUNCTUATION:
        return [word[:-1], word[-1]]
    if len(word) > 1 and word[0] in ASCII_PUNCTUATION:
        return [word[0], word[1:]]
    return [word]


def _sizes(items) -> np.ndarray:
    return np.fromiter((len(i) for i in items), dtype=np.int64, count=len(items))


def _codes(token_lists) -> np.ndarray:
    flat = [token for tokens in token_lists for token in tokens]
    return pd.factorize(np.array(flat, dtype=object))[0] if flat else np.zeros(0, np.int64)


def _char_codes(texts) -> np.ndarray:
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    return np.unique(raw, return_inverse=True)[1].astype(np.int64)


def _ngram_rows(hyp_tokens, ref_tokens):
    sizes = _sizes(hyp_tokens), _sizes(ref_tokens)
    counts = clipped_matches(_codes(hyp_tokens + ref_tokens), *sizes, BLEU_ORDERS)
    return [("bleu", n, *c, 0.0) for n, c in enumerate(counts, 1)]


def _chrf_rows(hyps, refs):
    squeezed = [["".join(t.split()) for t in side] for side in (hyps, refs)]
    split = [
        [[p for w in t.split() for p in _split_edge_punctuation(w)] for t in side]
        for side in (hyps, refs)
    ]
    rows = []
    for kind, (h, r), codes, orders in (
        ("char", squeezed, _char_codes(squeezed[0] + squeezed[1]), CHRF_CHAR_ORDERS),
        ("word", split, _codes(split[0] + split[1]), CHRF_WORD_ORDERS),
    ):
        sizes = _sizes(h), _sizes(r)
        for n, (hits, _, ref) in enumerate(clipped_matches(codes, *sizes, orders), 1):
            rows.append((kind, n, hits, _without_short_references(*sizes, n), ref, 0.0))
    return rows


def _edit_rows(hyps, refs, kinds):
    rows = []
    for kind in ("word_edit", "char_edit"):
        if kind in kinds:
            h, r = ([t.split() for t in hyps], [t.split() for t in refs]) if kind == "word_edit" else (hyps, refs)
            rows.append((kind, 0, sum(edit_distances(h, r)), sum(map(len, h)), sum(map(len, r)), 0.0))
    return rows


def _slices(batch: pa.RecordBatch, chars: int = SLICE_CHARS):
    size = np.cumsum(pc.add(pc.utf8_length(batch["hyp"]), pc.utf8_length(batch["ref"])).to_numpy(zero_copy_only=False).astype(np.int64))
    if not len(size):
        return
    part = size // chars
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _rows(batch: pa.RecordBatch, parts) -> Iterator[tuple]:
    """Partial sums of one Arrow batch."""
    yield ("rows", 0, batch.num_rows, 0, 0, 0.0)
    if "overlap" in parts:
        share = [s for s in batch["share"].to_pylist() if s is not None]
        yield ("overlap", 0, len(share), 0, 0, float(sum(share)))
    if "word_edit" in parts or "char_edit" in parts:
        for piece in _slices(batch, PIECE_CHARS):
            yield from _edit_rows(piece["hyp"].to_pylist(), piece["ref"].to_pylist(), parts)
    for piece in _slices(batch):
        if "ngrams" in parts:
            yield from _ngram_rows(
                *([t.split() for t in piece[c].to_pylist()] for c in ("hyp_tokens", "ref_tokens"))
            )
        if "chars" in parts:
            yield from _chrf_rows(piece["hyp"].to_pylist(), piece["ref"].to_pylist())


def _counter(parts):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*_rows(batch, parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, (_, kind) in zip(columns, ARROW_COLUMNS)],
                names=[name for name, _ in ARROW_COLUMNS],
            )
            # The worker stays; what the batch took goes back.
            del batch, columns
            pa.default_memory_pool().release_unused()

    return count


def overlap_share(hyp_words, ref_words) -> Column:
    """Share of the distinct reference words found in the hypothesis; null without any."""
    wanted = F.array_distinct(ref_words)
    found = F.array_intersect(hyp_words, ref_words)
    return F.when(F.size(wanted) > 0, F.size(found).cast("double") / F.size(wanted))


def prepared(pairs: DataFrame, mode: str = "normalized") -> DataFrame:
    """Columns hyp, ref (texts to score) from `hypothesis` and `reference`.

    Rows with a null or empty reference, or without a hypothesis, were never predictions and
    are left out, as everywhere in this package.
    """
    if mode not in ("normalized", "raw"):
        raise ValueError(f"mode must be 'normalized' or 'raw', not {mode!r}")
    shape = T.normalize if mode == "normalized" else T.collapse_spaces
    return pairs.where(
        F.col("hypothesis").isNotNull() & ~T.is_blank("reference", stripped=False)
    ).withColumns({"hyp": shape("hypothesis"), "ref": shape("reference")})


def pair_statistics(
    pairs: DataFrame, mode: str = "normalized", parts: tuple[str, ...] = ALL_PARTS
) -> DataFrame:
    """Partial sums over `pairs`; see the module text for the columns.

    Texts are normalised in the JVM, counted in Arrow batches, and summed natively by whichever
    metric reads the result. Nothing is shuffled here.
    """
    ready = prepared(pairs, mode)
    if mode == "raw":
        tokens = [T.tokenize_13a("hypothesis"), T.tokenize_13a("reference")]
    else:
        tokens = [F.col("hyp"), F.col("ref")]
    columns = [F.col("hyp"), F.col("ref")]
    if "overlap" in parts:
        columns.append(overlap_share(T.words("hyp"), T.words("ref")).alias("share"))
    if "ngrams" in parts:
        columns += [tokens[0].alias("hyp_tokens"), tokens[1].alias("ref_tokens")]
    return ready.select(*columns).mapInArrow(_counter(parts), STATS_SCHEMA)
