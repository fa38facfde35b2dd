"""What may be sent to every task: frequent rows up to a bound, and filters of a bounded number of bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paracorpus.llm.shingles import mix

#: Classes of counts per doubling, when the most frequent rows are chosen.
CLASSES = 8
#: Bits of a filter per key, and at most.
BITS, MOST_BITS = 16, 1 << 27
#: Bits of a filter that a key sets.
PROBES = 3


def is_frequent(table: DataFrame, most: int, count: str = "n") -> Column:
    """Whether `count` (1 or more) reaches the smallest bound that at most `most` rows reach.

    Bounds are powers of 2 ** (1 / `CLASSES`), so the histogram has some 500 rows at any size and the
    most frequent rows always come first. No row at all is frequent only if equal ones are too many.
    """
    level = F.floor(F.log2(F.col(count)) * CLASSES)
    least, held = 64 * CLASSES, 0
    for row in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    return level >= least


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits that each 64-bit key sets in a filter of `bits` (a power of two)."""
    out = []
    for _ in range(PROBES):
        keys = mix(keys + np.uint64(0x9E3779B97F4A7C15))
        out.append(keys & np.uint64(bits - 1))
    return out


class KeyFilter:
    """A Bloom filter: tells of every key that was put in that it may be there, and of most others that they are not."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in places(keys, 64 * len(self.words)):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def key_filter(keys: DataFrame, most_bits: int = MOST_BITS) -> KeyFilter:
    """The filter of a table of keys (one long column; repeats allowed).

    It has `BITS` bits a key and `most_bits` at most, whatever the table's size: beyond that more keys
    pass that were not put in, none is refused that was. Tasks reduce keys to the filter's words,
    which are combined by an aggregate, and only words come to the driver.
    """
    n = keys.count()
    bits = 64
    while bits < min(n * BITS, most_bits):
        bits *= 2

    def run(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for at in places(np.asarray(batch.column(0)).view(np.uint64), bits):
                np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        for lo in range(0, len(used), 1 << 16):
            some = used[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(words[some].view(np.int64))], ["at", "word"])

    found = keys.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[np.asarray(found["at"])] = np.asarray(found["word"]).view(np.uint64)
    return KeyFilter(words)
