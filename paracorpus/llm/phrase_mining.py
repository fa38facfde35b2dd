"""Collocations: frequent phrases of two and three words, mined shard by shard and counted globally."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paracorpus.llm.bounded import KeyFilter, key_filter
from paracorpus.llm.common import broadcast_if_small, pin
from paracorpus.llm.marked_words import text_bytes
from paracorpus.llm.shingles import mix

#: Shards of the corpus. A shard's support is its share of the global one, so more shards than a
#: fraction of the least count would make every phrase of a shard a candidate.
SHARDS = 4
#: Bytes of text that are counted at once in a task; one longer text is a group of its own.
GROUP_BYTES = 800_000
#: Parts of a language that are ranked on their own before the best of each are ranked together.
PARTS = 64
#: How much a longer phrase must have of a shorter one's count, in percent, to stand for it.
ABSORBED = 50
# Fixed values of the contract: signs that end a piece, and blanks between words.
SIGNS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes(b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256))
_KINDS = bytes(1 if b in BLANKS else 2 if b in SIGNS else 0 for b in range(256))
#: Bytes of a word that are hashed eight at a time for all words at once; longer ones go one by one.
LONG_WORD = 64
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each name, of its bytes and their number."""
    data, offsets = text_bytes(names.cast(pa.large_string()))
    sizes = np.diff(offsets)
    padded = np.append(data, np.zeros(8, np.uint8))
    # Eight bytes from every place on.
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    hashes = mix(sizes.astype(np.uint64) + _LEFT)
    for lane in range(0, min(LONG_WORD, int(sizes.max(initial=0))), 8):
        at = np.flatnonzero(sizes > lane)
        spare = np.maximum(8 - (sizes[at] - lane), 0).astype(np.uint64) * np.uint64(8)
        part = eight[offsets[:-1][at] + lane] << spare
        hashes[at] = mix(hashes[at] * _LEFT + part * _RIGHT)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
    return hashes


class Words:
    """The words of some texts. `code`: each word's place in `names`; `piece`: a number that changes with
    the piece and the text; `text`: the text it stands in; `hashes`: of the names."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = text_bytes(texts.cast(pa.large_string()).fill_null(""))
        data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
        kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
        inside = kind == 0
        # Words begin and end where blanks and signs do, and where texts do.
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        some = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][some], offsets[1:][some] - 1
        begins[first], ends[last] = inside[first], inside[last]
        starts = np.flatnonzero(begins)
        # Words end to end, without what stands between them.
        held = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - starts))
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(held), pa.py_buffer(data[inside])).dictionary_encode()
        self.code, self.names = np.asarray(coded.indices, np.int64), coded.dictionary.cast(pa.string())
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), starts) + self.text
        self.hashes = word_hashes(coded.dictionary)

    def follows(self) -> np.ndarray:
        """Whether the next word stands in the same piece, for each but the last word. Pieces are numbered
        upwards and a new text adds one, so equal numbers mean the same piece."""
        return self.piece[1:] == self.piece[:-1]


def phrase_key(group: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """A 64-bit key of a phrase in a group (unsigned, as are the hashes it is made of)."""
    key = mix(group + np.uint64(len(words)))
    for word in words:
        key = mix(key * _LEFT + word * _RIGHT)
    return key


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
    start = 0
    while start < len(texts):
        stop = min(len(texts), int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + GROUP_BYTES)) + 1)
        yield start, stop
        start = stop


class Phrases:
    """Distinct bigrams and trigrams of `Words` within groups of texts (`of_text`: each text's), as word codes.
    `language`: each group's language key, of which phrases' keys are made.

    Trigrams are only looked at where `keep` (for distinct bigrams) says yes for both bigrams.
    """

    def __init__(self, words: Words, of_text: np.ndarray, language: np.ndarray, word_ok: np.ndarray | None = None) -> None:
        self.words, self.language, v = words, language, max(len(words.names), 1)
        kind = of_text[words.text]
        both = words.follows()
        if word_ok is not None:
            both &= word_ok[:-1] & word_ok[1:]
        at = np.flatnonzero(both)
        made = (kind[at] * v + words.code[at]) * v + words.code[at + 1]
        pairs, place, self.counts = np.unique(made, return_inverse=True, return_counts=True)
        self.group, self.first, self.second = pairs // (v * v), pairs // v % v, pairs % v
        self.at, self.place = at, place
        self.keys = phrase_key(language[self.group], words.hashes[self.first], words.hashes[self.second])

    def triples(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group, first, second, third, key, count) of the trigrams that begin and end with kept bigrams."""
        words, v = self.words, max(len(self.words.names), 1)
        bigram = np.full(len(words.code), -1, np.int64)
        bigram[self.at] = np.where(keep[self.place], self.place, -1)
        at = np.flatnonzero((bigram[:-1] >= 0) & (bigram[1:] >= 0))
        made, counts = np.unique(bigram[at] * v + words.code[np.minimum(at + 2, len(words.code) - 1)], return_counts=True)
        pair, third = made // v, made % v
        group, first, second = self.group[pair], self.first[pair], self.second[pair]
        return group, first, second, third, phrase_key(self.language[group], *(words.hashes[x] for x in (first, second, third))), counts


def _tasks(docs: DataFrame, work, schema: str) -> DataFrame:
    """`work(texts, langs, shard keys, language keys)` over groups of texts, in tasks; it yields lists of columns."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _groups(batch.column(0)):
                text, lang, shard, of_lang = (c.slice(start, stop - start) for c in batch.columns)
                keys = (np.asarray(x, np.int64).view(np.uint64) for x in (shard, of_lang))
                for columns in work(text, lang, *keys):
                    yield pa.RecordBatch.from_arrays(columns, names)
        pa.default_memory_pool().release_unused()  # the worker stays, for other tasks

    return docs.select("text", "lang", "shard", "of_lang").mapInArrow(run, schema)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def local_key(shard: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The key of a phrase in a shard, from its key in the language as a whole."""
    return mix(key ^ mix(shard))


def local_words(docs: DataFrame) -> DataFrame:
    """shard, lang, key, n: all words of `docs` (text, lang, shard, of_lang) by 64-bit keys, combined in the tasks first."""

    def work(text, lang, shard, of_lang):
        words = Words(text)
        groups, first, of_text = np.unique(shard, return_index=True, return_inverse=True)
        v = max(len(words.names), 1)
        made, counts = np.unique(of_text[words.text] * v + words.code, return_counts=True)
        row = first[made // v]
        yield [_longs(groups[made // v]), lang.take(pa.array(row)), _longs(phrase_key(of_lang[row], words.hashes[made % v])), _longs(counts)]

    counted = _tasks(docs, work, "shard long, lang string, key long, n long")
    return counted.groupBy("shard", "lang", "key").agg(F.sum("n").alias("n"))


def local_phrases(docs: DataFrame, words: KeyFilter, bigrams: KeyFilter | None) -> DataFrame:
    """shard, key, n: phrases of a shard by 64-bit keys, complete for all that may have the local support.

    Without `bigrams` those of two words that are both in `words`, else those of three whose two bigrams
    are both in `bigrams`: a phrase is at most as frequent as its parts. Both hold `local_key`s. Phrases whose
    keys clash are counted together, which can only make more of them candidates.
    """
    sent = docs.sparkSession.sparkContext.broadcast((words, bigrams))

    def work(text, lang, shard, of_lang):
        of_word, of_bigram = sent.value
        found = Words(text)
        groups, whose, of_text = np.unique(shard, return_index=True, return_inverse=True)
        language = of_lang[whose]
        v = max(len(found.names), 1)
        made, place = np.unique(of_text[found.text] * v + found.code, return_inverse=True)
        keys = phrase_key(language[made // v], found.hashes[made % v])
        ok = of_word.has(local_key(groups[made // v], keys))[place]
        phrases = Phrases(found, of_text, language, ok)
        if of_bigram is None:
            group, keys, counts = phrases.group, phrases.keys, phrases.counts
        else:
            group, *_, keys, counts = phrases.triples(of_bigram.has(local_key(groups[phrases.group], phrases.keys)))
        yield [_longs(groups[group]), _longs(keys), _longs(counts)]

    counted = _tasks(docs, work, "shard long, key long, n long")
    return counted.groupBy("shard", "key").agg(F.sum("n").alias("n"))


def count_candidates(docs: DataFrame, candidates: KeyFilter) -> DataFrame:
    """lang, phrase, words, a: how often words and phrases occur in their language, for all that are candidates.

    Tasks leave out what is surely no candidate; the few others that the filter lets pass are counted
    like candidates. Counts are by the words themselves.
    """
    sent = docs.sparkSession.sparkContext.broadcast(candidates)

    def work(text, lang, shard, of_lang):
        known, found = sent.value, Words(text)
        language, first, of_text = np.unique(of_lang, return_index=True, return_inverse=True)
        v = max(len(found.names), 1)
        made, counts = np.unique(of_text[found.text] * v + found.code, return_counts=True)
        phrases = Phrases(found, of_text, language)
        levels = [
            (made // v, made % v, phrase_key(language[made // v], found.hashes[made % v]), counts),
            (phrases.group, phrases.first, phrases.second, phrases.keys, phrases.counts),
            phrases.triples(known.has(phrases.keys)),
        ]
        for n, (group, *parts, keys, counts) in enumerate(levels, 1):
            chosen = np.flatnonzero(known.has(keys))
            names = [found.names.take(pa.array(p[chosen])) for p in parts]
            phrase = pc.binary_join_element_wise(*names, " ") if n > 1 else names[0]
            yield [lang.take(pa.array(first[group[chosen]])), phrase, _longs(np.full(len(chosen), n)), _longs(counts[chosen])]

    counted = _tasks(docs, work, "lang string, phrase string, words long, a long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole numbers of up to 38 digits."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", a * a * million, left * right)


def frequent_phrases(docs: DataFrame, least: int = 10, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(sizes, phrases): lang, n (its words); and lang, phrase, words (1 to 3), a, with a of at least `least`.

    After Savasere, Omiecinski and Navathe: rows are dealt to shards by a hash of the text. A phrase with
    `least` occurrences has, in some shard, at least `least` times the share that the shard has of
    the language's words; so what reaches that in any shard is every candidate there is. Each shard is mined
    completely, level by level: words, then bigrams of frequent words, then trigrams of frequent
    bigrams. The union is counted over all texts.

    Between levels tasks get filters of a bounded size: at any size they only leave out what cannot
    count, and counts decide. Every level is an aggregate that combines before it shuffles, keyed by the
    phrase, so neither a shard nor a language is gathered anywhere.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    text = F.col("text").cast("string")
    docs = docs.select(text.alias("text"), lang.alias("lang"))
    docs = docs.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(shards)))
    docs = docs.select("text", "lang", F.xxhash64("shard", "lang").alias("shard"), F.xxhash64("lang").alias("of_lang"))
    words = pin(local_words(docs), "shard-words")
    here = pin(words.groupBy("lang", "shard").agg(F.sum("n").alias("here")), "shard-sizes")
    sizes = here.groupBy("lang").agg(F.sum("here").alias("n"))
    # If two languages had the same key, the smaller support holds for both.
    shares = here.join(sizes, "lang").groupBy("shard").agg(F.min(F.col("here") / F.col("n")).alias("share"))
    # A little less than the support, as shares are no exact numbers.
    support = broadcast_if_small(pin(shares.select("shard", (F.col("share") * least - 1e-6).alias("support")), "support"))

    def frequent(counted: DataFrame) -> DataFrame:
        return pin(counted.join(support, "shard").where("n >= support").select("shard", "key"), "local")

    def local_filter(keys: DataFrame) -> KeyFilter:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, key = (np.asarray(c).view(np.uint64) for c in batch.columns)
                yield pa.RecordBatch.from_arrays([_longs(local_key(shard, key))], ["key"])

        return key_filter(keys.mapInArrow(run, "key long"))

    one = frequent(words.select("shard", "key", "n"))
    of_word = local_filter(one)
    two = frequent(local_phrases(docs, of_word, None))
    three = frequent(local_phrases(docs, of_word, local_filter(two)))
    candidates = one.select("key").union(two.select("key")).union(three.select("key")).distinct()
    counted = count_candidates(docs, key_filter(pin(candidates, "candidates")))
    return sizes, pin(counted.where(F.col("a") >= least), "phrases")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language of `docs` (text, lang).

    Words are runs without blanks in pieces between signs, A-Z lower-cased; a null text is empty, a
    null language `und`. A phrase of two or three words scores as its worst cut; one that lies inside a longer
    frequent phrase with half its count is dropped. Repeated rows count as often as they occur.
    Joins are on (language, part), where a frequent word meets many phrases: adaptive execution
    splits such partitions. A language's phrases are ranked in parts first, so at most `PARTS` times
    `top` rows of a language meet in one task.
    """
    sizes, phrases = frequent_phrases(docs, least, shards)
    one, two, three = (phrases.where(F.col("words") == n).drop("words") for n in (1, 2, 3))
    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    start, end = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)

    def with_counts(table: DataFrame, part: Column, counts: DataFrame, name: str) -> DataFrame:
        found = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias(name))
        return table.withColumn("part", part).join(found, ["lang", "part"]).drop("part")

    inside = three.select("lang", F.explode(F.array(start, end)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = two.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {ABSORBED} * a").drop("longer")
    pairs = with_counts(with_counts(kept, first, one, "l"), last, one, "r")
    pairs = pairs.select("lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    triples = with_counts(with_counts(three, first, one, "l1"), end, two, "r1")
    triples = with_counts(with_counts(triples, start, two, "l2"), last, one, "r2")
    triples = triples.withColumn("s1", _score(F.col("a"), F.col("l1"), F.col("r1"))).withColumn("s2", _score(F.col("a"), F.col("l2"), F.col("r2")))
    early = F.col("s1") <= F.col("s2")
    triples = triples.select(
        "lang", "phrase", "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(broadcast_if_small(pin(sizes, "sizes")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
