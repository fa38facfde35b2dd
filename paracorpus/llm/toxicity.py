"""Toxicity by two backoff models after Kneser and Ney, one of toxic and one of ordinary text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paracorpus.llm.bounded import is_frequent
from paracorpus.llm.chunks import coded_chunks
from paracorpus.llm.common import broadcast_if_small, giving_back, pin
from paracorpus.llm.merge_automaton import groups_by_length

#: Stems that there may be, for what is shared evenly among them.
STEMS = 1 << 20
#: Bytes of text that a task counts or scores at once.
GROUP_BYTES = 3_000_000
#: The most frequent pairs and words are looked up in the tasks, all others by a join: how many only
#: decides where a value is looked up. So are the most frequent stems.
FREQUENT_PAIRS, FREQUENT_WORDS, FREQUENT_STEMS = 1_000_000, 250_000, 250_000
#: A count n is discounted by this times its square root, as chance may have made it so much larger;
#: in the class with more text by as much as leaves the same share to the backoff in both classes,
#: so that expressions too rare to tell the classes apart speak for neither.
DISCOUNT = 2.0
#: Words that both classes have seen so often are contexts of word pairs; others go to the words.
LEAST_CONTEXT = 50
#: A word whose log-likelihoods differ by less counts as shared by the classes, and others by what is
#: beyond it: what topics and languages happen to be toxic more often moves common words by less.
MARGIN = 1.5
#: First letters of a word that its inflected forms share: the step between a word and the shared counts.
STEM = 4
#: Folds by crc32 of the id: counted, used to fit the final scale, and (0) never looked at.
COUNTED, SCALED = (1, 2, 3), (4,)
#: Bins of the histogram to which the scale is fitted.
BINS, REACH = 2000, 4.0
KINDS = ("toxic", "ordinary")
SIGNS = ".,;:!?|*#%&'\"()[]{}<>/\\-_=+~^`@$"


def words_of(chunks: list[str]) -> list[str]:
    """The word of each chunk: lower-cased, without signs at the ends; empty if nothing is left."""
    return [c.lower().strip(SIGNS) for c in chunks]


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text, before, word, names): for each word in turn the number of its text, and the places in
    `names` of the word before it and of itself. Place 0 is the start of a text."""
    codes, offsets, chunks = coded_chunks(texts)
    places = {"": 0}
    local = np.array([places.setdefault(w, len(places)) for w in words_of(chunks)] or [0], np.int64)
    word = local[codes]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))[word > 0]
    word = word[word > 0]
    before = np.concatenate(([0], word[:-1]))[: len(word)]
    before[1:][text[1:] != text[:-1]] = 0
    return text, before, word, list(places)


def joined(names: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.Array:
    """The keys of word pairs: the words with a blank between them, which no word has."""
    return pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), " ")


def count_pairs(labelled: DataFrame) -> DataFrame:
    """key, toxic, ordinary: in how many texts of either label each word pair occurs.

    `labelled` has text and toxic; key has both words as they are. Every word of every row is looked at, a pair counts once per text; pairs are combined in the tasks and again before the
    shuffle, and the table grows with the labelled texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), bool)
            for start, stop in groups_by_length(batch.column(0), GROUP_BYTES):
                text, before, word, names = coded_words(batch.column(0).slice(start, stop - start))
                n = len(names)
                once = np.unique((text * n + before) * n + word)
                pairs, place = np.unique(once % (n * n), return_inverse=True)
                marks = toxic[start:stop][once // (n * n)]
                hits, every = (np.bincount(place, x, len(pairs)).astype(np.int64) for x in (marks, np.ones(len(once))))
                key = joined(pa.array(names), pairs // n, pairs % n)
                yield pa.RecordBatch.from_arrays([key, pa.array(hits), pa.array(every - hits)], ["key", *KINDS])

    counted = labelled.select("text", F.col("toxic") == 1).mapInArrow(giving_back(run), "key string, toxic long, ordinary long")
    return counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


class Order:
    """Discounts of both classes at one order of the models, and what both leave over, the same for
    both: all of it if a class has no counts."""

    def __init__(self, table: DataFrame, columns: dict[str, str]) -> None:
        self.columns, self.total, self.factor, counts = columns, {}, dict.fromkeys(columns, DISCOUNT), {}
        for kind, column in columns.items():
            rows = table.where(F.col(column) > 0).groupBy(column).count().collect()
            counts[kind] = np.array([tuple(x) for x in rows] or [(0, 0)], np.float64).T
            self.total[kind] = float((counts[kind][0] * counts[kind][1]).sum())
        small, large = sorted(columns, key=self.total.get)
        self.empty, self.left = not self.total[small], 1.0
        if self.empty:
            return

        def left(kind: str, factor: float) -> float:
            n, rows = counts[kind]
            return float((np.minimum(n, factor * np.sqrt(n)) * rows).sum() / self.total[kind])

        self.left = left(small, DISCOUNT)
        low, high = 0.0, DISCOUNT * float(np.sqrt(counts[large][0].max()) + 1)
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if left(large, middle) < self.left else (low, middle)
        self.factor[large] = high

    def share(self, kind: str) -> Column:
        """A count less its discount, of all counts of the class."""
        n = F.col(self.columns[kind])
        return F.lit(0.0) if self.empty else F.greatest(n - self.factor[kind] * F.sqrt(n), F.lit(0.0)) / self.total[kind]


def beyond_margin(ratio: Column) -> Column:
    return F.signum(ratio) * F.greatest(F.abs(ratio) - MARGIN, F.lit(0.0))


def places(names: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each name stands in `known`; -1 if it does not."""
    return np.asarray(pc.index_in(names, value_set=known).fill_null(-1), np.int64)


def values_of(names: pa.Array, known: pa.Array, values: np.ndarray) -> np.ndarray:
    """The names' values, 0 without any."""
    at = places(names, known)
    return np.where(at >= 0, np.append(values, 0.0)[at], 0.0)


class Frequent:
    """What is looked up in the tasks: frequent pairs, words and stems, and the contexts of pairs. Names
    are Arrow columns, values arrays: a task holds them once, without an object for each."""

    def __init__(self, words: pa.Table, pairs: pa.Table, stems: pa.Table, contexts: pa.Table) -> None:
        of_words, self.stems, self.contexts = (x[0].combine_chunks().cast(pa.string()) for x in (words, stems, contexts))
        self.of_stem, self.after = (x[1].to_numpy() for x in (stems, contexts))
        halves = pc.list_flatten(pc.split_pattern(pairs["key"].combine_chunks().cast(pa.string()), " "))
        # Words of frequent pairs may be rare; they are looked up by the join.
        self.names = pc.unique(pa.concat_arrays([of_words, halves]))
        self.word = np.append(words["of_word"].to_numpy(), np.full(len(self.names) - len(words), np.nan))
        codes = places(halves, self.names)
        codes = codes[::2] << 32 | codes[1::2]
        order = np.argsort(codes)
        self.pairs, self.value = codes[order], pairs["value"].to_numpy()[order]


class ClassModels:
    """Both models as a table (key, value, n), all of it in the shared folder, and its frequent rows.

    The log-likelihood of a word after another, toxic minus ordinary and beyond `MARGIN`, is worked out
    from what contexts and the frequent stems, pairs and words say, and mended by the rows of rare
    words, stems and pairs in `values`, of which a text looks up each once.
    Pair, word, stem, shared counts: each step gets what the discounts of the step above left. A
    word's share of its stem comes from the counts that the classes share. All counted pairs take
    part; those whose discounts leave nothing have the value 0 and no row.
    """

    def __init__(
        self, pairs: DataFrame, frequent_pairs: int = FREQUENT_PAIRS, frequent_words: int = FREQUENT_WORDS, frequent_stems: int = FREQUENT_STEMS
    ) -> None:
        self._sent: Broadcast | None = None
        pairs = pairs.select(F.substring_index("key", " ", 1).alias("first"), F.substring_index("key", " ", -1).alias("word"), *KINDS)
        totals = pairs.groupBy("first").agg(*(F.sum(c).alias(f"{c}_n") for c in KINDS))
        least = F.least(*(F.col(f"{c}_n") for c in KINDS))
        totals = pin(totals.where(least >= LEAST_CONTEXT), "contexts")
        shares = [F.greatest(F.col(c) - DISCOUNT * F.sqrt(F.col(c) * F.col(f"{c}_n") / least), F.lit(0.0)) / F.col(f"{c}_n") for c in KINDS]
        # A discount is at least that of the factor itself, so smaller counts have no share.
        shared_pairs = pairs.where(F.greatest(*KINDS) > DISCOUNT**2).join(broadcast_if_small(totals, FREQUENT_WORDS), "first")
        shared_pairs = pin(
            shared_pairs.select("first", "word", F.expr("toxic + ordinary").alias("n"), *(x.alias(c) for x, c in zip(shares, KINDS))).where("toxic > 0 or ordinary > 0"),
            "pair-shares",
        )
        # What the discounts leave over goes to the words.
        rests = pin(shared_pairs.groupBy("first").agg(*((1 - F.sum(c)).alias(f"{c}_rest") for c in KINDS)), "rests")
        words = pin(pairs.groupBy("word").agg(*(F.sum((F.col(c) > 0).cast("long")).alias(c) for c in KINDS), F.count(F.lit(1)).alias("n")), "words")
        stem = F.substring("word", 1, STEM).alias("stem")
        stems = pin(words.groupBy(stem).agg(*(F.sum(c).alias(f"{c}_s") for c in KINDS), F.sum("n").alias("n_s")), "stems")
        of_words, of_stems = Order(words, {c: c for c in KINDS}), Order(stems, {c: f"{c}_s" for c in KINDS})
        n = stems.agg(F.coalesce(F.sum("n_s"), F.lit(0))).first()[0]
        # Half goes to the stems as they occur, half evenly to as many as there may be.
        shared = (F.col("n_s") / max(n, 1) + 1 / STEMS) / 2
        stems = stems.select("stem", "n_s", *((of_stems.share(c) + of_stems.left * shared).alias(f"{c}_stem") for c in KINDS))
        stems = pin(stems.withColumn("of_stem", F.log(F.col("toxic_stem") / F.col("ordinary_stem"))), "stem-values")
        within = F.least((F.col("n") + 1) / (F.col("n_s") + 1), F.lit(1.0))
        vocabulary = words.withColumn("stem", stem).join(stems, "stem")
        vocabulary = vocabulary.select(
            F.col("word").alias("name"), "n", "of_stem", *((of_words.share(c) + of_words.left * F.col(f"{c}_stem") * within).alias(f"{c}_p") for c in KINDS)
        )
        vocabulary = pin(vocabulary.withColumn("of_word", F.log(F.col("toxic_p") / F.col("ordinary_p"))), "vocabulary")
        valued = shared_pairs.join(broadcast_if_small(rests, FREQUENT_WORDS), "first").join(vocabulary.drop("n").withColumnRenamed("name", "word"), "word")
        t, o = (F.col(c) + F.col(f"{c}_rest") * F.col(f"{c}_p") for c in KINDS)
        after = F.log(F.col("toxic_rest") / F.col("ordinary_rest"))
        value = beyond_margin(F.log(t / o)) - beyond_margin(after + F.col("of_word"))
        valued = pin(valued.select(F.concat_ws(" ", "first", "word").alias("key"), value.alias("value"), "n").where("value <> 0"), "pair-values")
        sent_pairs, sent_words, sent_stems = (
            is_frequent(valued, frequent_pairs), is_frequent(vocabulary, frequent_words), is_frequent(stems, frequent_stems, "n_s")
        )
        rare_pairs, rare_words, rare_stems = valued.where(~sent_pairs), vocabulary.where(~sent_words), stems.where(~sent_stems)
        # A rare word is first taken for its stem, and a rare stem for none.
        self.values = (
            rare_pairs.select("key", "value", F.lit(None).cast("double").alias("of_stem"))
            .unionByName(rare_words.select(F.col("name").alias("key"), F.col("of_word").alias("value"), "of_stem"))
            .unionByName(rare_stems.select(stem_key(F.col("stem")).alias("key"), F.col("of_stem").alias("value"), F.lit(0.0).alias("of_stem")))
        )
        # If all rows of a kind are sent, no others are looked up.
        self.all_pairs, self.all_words, self.all_stems = rare_pairs.isEmpty(), rare_words.isEmpty(), rare_stems.isEmpty()
        self.frequent = Frequent(
            vocabulary.where(sent_words).select("name", "of_word").toArrow(),
            valued.where(sent_pairs).select("key", "value").toArrow(),
            stems.where(sent_stems).select("stem", "of_stem").toArrow(),
            rests.select("first", F.log(F.col("toxic_rest") / F.col("ordinary_rest"))).toArrow(),
        )

    def sent(self, spark: SparkSession) -> Broadcast:
        """The frequent rows as a broadcast, sent once for all texts that are scored with them."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self.frequent)
        return self._sent


def stem_key(stem: Column) -> Column:
    """Begins with two blanks, as no word or pair does."""
    return F.concat(F.lit("  "), stem)


LOOKED_UP = "key string, texts array<long>, counts array<int>, base array<double>, after array<double>"


def text_key(columns: list[str]) -> Column:
    """64 bits that stand for a row's columns and text while its keys are looked up."""
    return F.xxhash64(*columns, F.coalesce("text", F.lit("")))


def score_keys(docs: DataFrame, models: ClassModels, columns: list[str]) -> DataFrame:
    """_text, difference: the mean over the words of a text, 0 without words, for each `text_key`.

    Frequent keys are looked up in the tasks. Of the others each group of texts sends every distinct
    one once, with the texts that have it, to the join with the models' table; the sums per text are
    combined in the tasks before they are shuffled. Rows with equal keys have equal texts: their
    sums and their words both count as often as they occur.
    """
    shared = models.sent(docs.sparkSession)
    all_words, all_pairs, all_stems = models.all_words, models.all_pairs, models.all_stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for start, stop in groups_by_length(batch.column(0), GROUP_BYTES):
                ids = np.asarray(batch.column(1).slice(start, stop - start))
                text, before, word, names = coded_words(batch.column(0).slice(start, stop - start))
                n, listed = len(names), pa.array(names)
                place = places(listed, known.names)
                of_word = np.where(place >= 0, np.append(known.word, np.nan)[place], np.nan)
                rare = np.isnan(of_word)
                stems = pc.utf8_slice_codeunits(listed, 0, STEM)
                of_word[rare] = values_of(stems, known.stems, known.of_stem)[rare]
                after = values_of(listed, known.contexts, known.after)
                once, counts = np.unique((text * n + before) * n + word, return_counts=True)
                owner, pair = once // (n * n), once % (n * n)
                first, second = pair // n, pair % n
                ratio = of_word[second] + after[first]
                value = np.sign(ratio) * np.maximum(np.abs(ratio) - MARGIN, 0)
                code = np.where((place[first] >= 0) & (place[second] >= 0), place[first] << 32 | place[second], -1)
                at = np.minimum(np.searchsorted(known.pairs, code), max(len(known.pairs) - 1, 0))
                hit = known.pairs[at] == code if len(known.pairs) else np.zeros(len(code), bool)
                value[hit] += known.value[at[hit]]
                sums = np.bincount(owner, value * counts, stop - start)
                # The key of no value: the sums themselves.
                yield asked(pa.array([f"   {ids[0]}"]), np.zeros(len(ids), np.int64), ids, np.bincount(text, minlength=stop - start), sums)
                if not all_pairs:
                    # If all words are known here, another word was never counted, nor a pair of it.
                    rest = ~hit & ((place[second] >= 0) | (not all_words))
                    keys, group = np.unique(pair[rest], return_inverse=True)
                    yield asked(joined(listed, keys // n, keys % n), group, ids[owner[rest]], counts[rest])
                if not all_words:
                    rest = rare[second]
                    keys, group = np.unique(second[rest], return_inverse=True)
                    yield asked(listed.take(pa.array(keys)), group, ids[owner[rest]], counts[rest], after=after[first[rest]])
                if not all_stems:
                    rest = (rare & (places(stems, known.stems) < 0))[second]
                    keys, group = np.unique(second[rest], return_inverse=True)
                    blank = pc.binary_join_element_wise("  ", stems.take(pa.array(keys)), "")
                    yield asked(blank, group, ids[owner[rest]], counts[rest], after=after[first[rest]])

    rows = docs.select("text", text_key(columns)).mapInArrow(giving_back(run), LOOKED_UP)
    if not (all_words and all_pairs and all_stems):
        rows = rows.join(models.values, "key", "left").where("base is not null or value is not null")
    else:
        rows = rows.withColumns({"value": F.lit(0.0), "of_stem": F.lit(0.0)})
    # Shorter arrays are filled up with nulls; an array that is null would leave no row.
    lists = [F.coalesce(x, F.array().cast("array<double>")).alias(x) for x in ("base", "after")]
    rows = rows.select("value", "of_stem", "texts", "counts", *lists)
    each = rows.select("value", "of_stem", F.explode(F.arrays_zip("texts", "counts", "base", "after")).alias("x"))
    # A rare word was taken for one of which only the stem is known.
    gain = beyond_margin(F.col("x.after") + F.col("value")) - beyond_margin(F.col("x.after") + F.col("of_stem"))
    is_text = F.col("x.base").isNotNull()
    summed = each.groupBy(F.col("x.texts").alias("_text")).agg(
        F.sum(F.coalesce("x.base", F.col("x.counts") * F.coalesce(gain, "value"))).alias("total"), F.sum(F.when(is_text, F.col("x.counts")).otherwise(0)).alias("words")
    )
    return summed.select("_text", F.when(F.col("words") > 0, F.col("total") / F.col("words")).otherwise(0.0).alias("difference"))


def asked(keys: pa.Array, group: np.ndarray, ids: np.ndarray, counts: np.ndarray, base=None, after=None) -> pa.RecordBatch:
    """One row per key: the texts that have it, how often, for sums the sums, for words what the word before says."""
    order = np.argsort(group, kind="stable")
    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(keys))))).astype(np.int32))
    texts, many = (pa.ListArray.from_arrays(ends, pa.array(x[order], t)) for x, t in ((ids, pa.int64()), (counts, pa.int32())))
    more = [pa.nulls(len(keys), pa.list_(pa.float64())) if x is None else pa.ListArray.from_arrays(ends, pa.array(x[order], pa.float64())) for x in (base, after)]
    return pa.RecordBatch.from_arrays([keys, texts, many, *more], ["key", "texts", "counts", "base", "after"])



def score_texts(docs: DataFrame, models: ClassModels, columns: list[str]) -> DataFrame:
    """`columns` and `difference` of every row."""
    scores = score_keys(docs, models, columns)
    return docs.select(*columns, text_key(columns).alias("_text")).join(scores, "_text").select(*columns, "difference")


def fit_scale(scored: DataFrame) -> tuple[float, float]:
    """(slope, shift) of a logistic curve from difference to the chance of label 1.

    Fitted to a histogram of all rows (`BINS` rows at most), by Newton steps with a small penalty.
    """
    step = 2 * REACH / BINS
    bins = F.least(F.greatest(F.floor((F.col("difference") + REACH) / step), F.lit(0)), F.lit(BINS - 1))
    rows = scored.groupBy(bins.alias("bin")).agg(F.sum(F.col("toxic").cast("long")), F.count(F.lit(1))).collect()
    if not rows:
        return 1.0, 0.0
    at, ones, n = (np.array(c, float) for c in zip(*sorted(tuple(r) for r in rows)))
    x = np.stack([(at + 0.5) * step - REACH, np.ones(len(at))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.array([1e-3, 1e-3])
        slope = x.T @ (ones - n * p) - penalty * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        w = w + np.clip(move, -20, 20)
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, fold: str) -> tuple[ClassModels, tuple[float, float]]:
    """Models and scale from `docs` (doc_id, text) with `labels` (doc_id, toxic); `fold` is a SQL
    expression of doc_id that says which rows are counted, which set the scale, and which are unused.

    Labels are sent to the tasks if there are at most `SMALL_ROWS` of them, else both sides are
    shuffled; texts without a label are dropped before they are counted. Rows with a null label or
    id are no labels. A document with several labels counts once for each. The scale is fitted to
    documents that the models have not seen. Without any label both models are equal and every
    score is 0.5 or less, as is the share of toxic labels.
    """
    used = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").withColumn("_fold", F.expr(fold))
    texts = docs.select("doc_id", "text")

    def chosen(folds: tuple[int, ...]) -> DataFrame:
        return texts.join(broadcast_if_small(used.where(F.col("_fold").isin(*folds))), "doc_id").select("doc_id", "text", "toxic")

    models = ClassModels(pin(count_pairs(chosen(COUNTED)), "word-pairs"))
    return models, fit_scale(score_texts(chosen(SCALED), models, ["doc_id", "toxic"]))


def score_of(difference: Column, scale: tuple[float, float]) -> Column:
    slope, shift = scale
    return 1 / (1 + F.exp(-(slope * difference + shift)))


def is_toxic(difference: Column, scale: tuple[float, float]) -> Column:
    return score_of(difference, scale) >= 0.5


def score_toxicity(docs: DataFrame, models: ClassModels, scale: tuple[float, float]) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) for every row; null texts count as empty."""
    difference = F.col("difference")
    return score_texts(docs, models, ["doc_id"]).select(
        "doc_id", score_of(difference, scale).alias("score"), is_toxic(difference, scale).cast("int").alias("predicted")
    )
