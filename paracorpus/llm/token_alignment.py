"""Alignment of two tokenizers' tokens over the same bytes, by skipping along diagonals."""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paracorpus.llm.bounded import is_frequent
from paracorpus.llm.common import pin
from paracorpus.llm.marked_words import MARK, coded_pieces, piece_tokenizer, strings_of, text_bytes, with_space
from paracorpus.llm.merge_automaton import byte_symbols, groups_by_length

#: Bytes of text whose distinct stretches are aligned at once; one longer text is a group of its own.
GROUP_BYTES = 1_000_000
#: Tokens of either side that are held as Python numbers at a time.
WINDOW = 1 << 17
#: Distinct stretches whose ids a worker remembers, and how many are encoded by one call.
REMEMBERED, AT_ONCE = 100_000, 5_000
#: Ends that are compared first at a new shift.
FIRST_STEP = 4
#: Pairs of ids whose counts are sent to the tasks; others are joined.
MOST_PAIRS = 1_000_000
#: A pair's number is its A id times this, and its B id.
SHIFT = 1 << 24
CODEC = "zstd"
# UTF-8 of the white space beyond ASCII, which the byte-level pattern knows.
WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def ragged(values: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of `values` with the given lengths, in the order of `codes`."""
    starts = np.cumsum(lengths) - lengths
    each = lengths[codes]
    ends = np.cumsum(each)
    return values[np.repeat(starts[codes] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]


def stretches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, strings): a space and text i are the strings[c] for c in codes[offsets[i]:offsets[i + 1]].

    Texts are cut before a space that follows another character and precedes one that is no white
    space. A word of the byte-level pattern ends before such a space, whatever is before it, and no
    piece crosses one, so no token of either side does. An empty text has no stretches.
    """
    data, offsets = text_bytes(with_space(texts))
    after = np.append(data, np.zeros(3, np.uint8))
    space = data == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    at = np.flatnonzero(start)
    blank = (after[at + 1] == 0x20) | ((after[at + 1] >= 0x09) & (after[at + 1] <= 0x0D)) | ((after[at + 1] >= 0x1C) & (after[at + 1] <= 0x1F))
    for code in WIDE_BLANKS:
        blank |= np.logical_and.reduce([after[np.minimum(at + 1 + k, len(after) - 1)] == b for k, b in enumerate(code)])
    # The end of a text is no character either; what follows there is the next text's space.
    blank |= np.isin(at + 1, offsets[1:])
    start[at[blank]] = False
    start[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return coded_pieces(data, offsets, np.flatnonzero(start))


class TokenPair:
    """Both tokenizers, the bytes of their tokens, and the ids of stretches."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True  # strings of special tokens in a text are plain text
        self.b = piece_tokenizer(b_path).library
        of_symbol = {s: b for b, s in enumerate(byte_symbols())}
        vocab = self.a.get_vocab()
        self.a_bytes: list[bytes] = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            if all(c in of_symbol for c in token):
                self.a_bytes[i] = bytes(of_symbol[c] for c in token)
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(self.b.get_piece_size())
        ]
        if max(len(self.a_bytes), len(self.b_bytes)) > SHIFT:
            raise ValueError(f"ids of {SHIFT} and more have no pair number")
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.memory: dict[str, tuple[bytes, bytes, bool]] = {}
        self.old: dict[str, tuple[bytes, bytes, bool]] = {}

    def _alone(self, string: str) -> tuple[bytes, bytes, bool]:
        """Ids of both sides, and whether the bytes of both sides' tokens are the string's. The second
        library puts the first space itself. No string is a space alone."""
        a, b = self.a.encode(string, add_special_tokens=False).ids, self.b.encode(string[1:])
        same = b"".join([self.a_bytes[i] for i in a]) == string.encode() == b"".join([self.b_bytes[i] for i in b])
        return np.array(a, np.uint32).tobytes(), np.array(b, np.uint32).tobytes(), same

    def _together(self, strings: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """The same for strings that may stand one after the other, by one call."""
        whole = "".join(strings)
        data, sides = whole.encode(), []
        stops = np.cumsum([len(s.encode()) for s in strings])  # of one string at least
        for ids, table, sizes in (
            (self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.a_bytes, self.a_sizes),
            (self.b.encode(whole[1:]), self.b_bytes, self.b_sizes),
        ):
            if b"".join([table[i] for i in ids]) != data:
                return list(map(self._alone, strings))
            ids = np.array(ids, np.uint32)
            ends = np.cumsum(sizes[ids])
            cuts = np.searchsorted(ends, stops) + 1
            if (ends[cuts - 1] != stops).any():
                return list(map(self._alone, strings))
            data_of, at = ids.tobytes(), (4 * cuts).tolist()
            sides.append([data_of[lo:hi] for lo, hi in zip([0, *at], at)])
        return list(zip(*sides, itertools.repeat(True)))

    def _encode(self, strings: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes, bool]]]:
        # A space at the end would join with the one that follows; a mark is another character for one side.
        joined = [s for s in strings if not s.endswith(" ") and MARK not in s]
        for lo in range(0, len(joined), AT_ONCE):
            some = joined[lo : lo + AT_ONCE]
            yield from zip(some, self._together(some))
        for s in strings:
            if s.endswith(" ") or MARK in s:
                yield s, self._alone(s)

    def forget(self) -> None:
        self.memory, self.old = {}, {}

    def ids(self, strings: pa.Array) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """Of distinct stretches: both sides' ids as little-endian u32, and whether the bytes agree."""
        strings = strings.to_pylist()
        if len(self.memory) > REMEMBERED:
            self.memory, self.old = {}, self.memory
        new = set(strings).difference(self.memory)
        self.memory.update({s: self.old[s] for s in new.intersection(self.old)})
        self.memory.update(self._encode(list(new.difference(self.old))))
        a, b, same = zip(*map(self.memory.__getitem__, strings)) if strings else ((), (), ())
        return list(a), list(b), np.array(same, bool)


@functools.lru_cache(maxsize=2)
def token_pair(a_path: str, b_path: str) -> TokenPair:
    """One per worker and pair of files; the files must be at these paths on every executor."""
    return TokenPair(a_path, b_path)


@dataclass
class Alignment:
    """Groups between places where tokens of both sides end, and links between tokens that share bytes.
    `first_a`, `first_b`: each group's first tokens. `a`, `b`: each link's tokens."""

    first_a: np.ndarray
    first_b: np.ndarray
    a: np.ndarray
    b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray, window: int = WINDOW) -> Alignment:
    """Align two ascending arrays of token ends whose last entries are equal.

    At a common end the places differ by a shift. Slices of both arrays at this shift are compared,
    each twice as long as the one before, and then halved, which finds how far the stretch of
    one-to-one groups goes in steps that grow with the logarithm of its length. At the first unequal
    ends a group of several tokens is resolved by moving on whichever side ends first, a link for
    each step; the group's end gives the next shift. Ends are held as numbers `window` at a time.
    """
    runs: list[tuple[int, int, int]] = []
    odd: list[tuple[int, int]] = []
    odd_a: list[int] = []
    odd_b: list[int] = []
    i = j = 0
    size = window
    while i < len(ends_a):
        at_a, at_b = i, j
        a, b = ends_a[i : i + size].tolist(), ends_b[j : j + size].tolist()
        n, m = len(a), len(b)
        x = y = 0
        while x < n and y < m:
            begun, step = x, FIRST_STEP
            while a[x : x + step] == b[y : y + step] and x < n:
                x += step
                y += step
                step *= 2
            x, y = min(x, n), min(y, m)
            while step > 1:
                step //= 2
                if x + step <= n and a[x : x + step] == b[y : y + step]:
                    x += step
                    y += step
            if x > begun:
                runs.append((at_a + begun, at_b + y - (x - begun), x - begun))
            if x >= n or y >= m:
                break
            # An irregular group.
            u, v, end_a, end_b = x, y, a[x], b[y]
            held = len(odd_a)
            odd_a.append(at_a + u)
            odd_b.append(at_b + v)
            while end_a != end_b:
                if end_a < end_b:
                    u += 1
                    if u >= n:
                        break
                    end_a = a[u]
                else:
                    v += 1
                    if v >= m:
                        break
                    end_b = b[v]
                odd_a.append(at_a + u)
                odd_b.append(at_b + v)
            if end_a != end_b:  # it goes on beyond the window
                del odd_a[held:], odd_b[held:]
                break
            odd.append((at_a + x, at_b + y))
            x, y = u + 1, v + 1
        i, j = at_a + x, at_b + y
        size = window if x else 2 * size
    starts = np.array(runs, np.int64).reshape(-1, 3)
    inside = np.arange(starts[:, 2].sum()) - np.repeat(np.cumsum(starts[:, 2]) - starts[:, 2], starts[:, 2])
    run_a, run_b = np.repeat(starts[:, 0], starts[:, 2]) + inside, np.repeat(starts[:, 1], starts[:, 2]) + inside
    first = np.array(odd, np.int64).reshape(-1, 2)
    first_a, first_b = np.append(run_a, first[:, 0]), np.append(run_b, first[:, 1])
    order = np.argsort(first_a, kind="stable")
    link_a, link_b = np.append(run_a, np.array(odd_a, np.int64)), np.append(run_b, np.array(odd_b, np.int64))
    by = np.argsort(link_a + link_b, kind="stable")  # of two links one is behind on neither side
    return Alignment(first_a[order], first_b[order], link_a[by], link_b[by])


class GroupNames:
    """Writes groups as `a1,a2|b1;a3|b2,b3;`."""

    def __init__(self, pair: TokenPair) -> None:
        sides = ((pair.a_bytes, ",|"), (pair.b_bytes, ",;"))
        names = [pa.array([f"{i}{sign}" for i in range(len(side))], pa.large_string()) for side, signs in sides for sign in signs]
        self.shifts = np.append(0, np.cumsum([len(x) for x in names]))[:-1]
        self.names = pa.concat_arrays(names)

    def __call__(self, a: np.ndarray, b: np.ndarray, found: Alignment, groups: np.ndarray) -> pa.Array:
        """A string for each stretch; groups[s]:groups[s + 1] are the groups of stretch s."""
        ends_a, ends_b = np.append(found.first_a, len(a))[1:], np.append(found.first_b, len(b))[1:]
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[ends_a - 1] = last_b[ends_b - 1] = True
        # Where each token stands if all of a group's A tokens come before its B tokens.
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(found.first_b, ends_a - found.first_a)] = a + np.where(last_a, self.shifts[1], self.shifts[0])
        order[np.arange(len(b)) + np.repeat(ends_a, ends_b - found.first_b)] = b + np.where(last_b, self.shifts[3], self.shifts[2])
        cuts = np.append(found.first_a + found.first_b, len(order))[groups]
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), self.names.take(pa.array(order)))
        return pc.binary_join(lists, pa.scalar("", pa.large_string()))


class AlignedTexts:
    """Texts of a group as stretches, and the alignment of the distinct ones, set end to end.

    Tokens of both sides end with a stretch, so the groups and links of a text are those of its
    stretches. `codes`, `offsets`: a text's stretches, none if its bytes differ on a side.
    `a`, `b`: ids of the distinct stretches in turn; `at_a`, `at_b`, `groups`, `links`: where those
    of each stretch begin; `numbers`: each link's pair.
    """

    def __init__(self, texts: pa.Array, pair: TokenPair) -> None:
        codes, offsets, strings = stretches(texts)
        a, b, same = pair.ids(strings)
        bad = np.append(0, np.cumsum(~same[codes]))
        good = bad[offsets[1:]] == bad[offsets[:-1]]
        self.codes = codes[np.repeat(good, np.diff(offsets))]
        self.offsets = np.append(0, np.cumsum(np.where(good, np.diff(offsets), 0)))
        # Stretches without equal bytes have no common ends; they stand in no text that is left.
        used = np.bincount(self.codes, minlength=len(strings)) > 0
        (self.a, self.at_a), (self.b, self.at_b) = (self._side(x, used) for x in (a, b))
        self.found = align(np.cumsum(pair.a_sizes[self.a]), np.cumsum(pair.b_sizes[self.b]))
        self.groups, self.links = (np.searchsorted(x, self.at_a) for x in (self.found.first_a, self.found.a))
        self.numbers = self.a[self.found.a] * SHIFT + self.b[self.found.b]

    @staticmethod
    def _side(ids: list[bytes], used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [x if u else b"" for x, u in zip(ids, used)]
        lengths = np.array(list(map(len, ids)), np.int64) // 4
        return np.frombuffer(b"".join(ids), np.uint32).astype(np.int64), np.append(0, np.cumsum(lengths))


class StretchedTexts:
    """Texts of a group as it is written: `offsets` and `codes` say which stretches a text has, `links`
    where a stretch's links begin, `numbers` which pairs these are."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, links: np.ndarray, numbers: np.ndarray) -> None:
        self.codes, self.offsets, self.links, self.numbers = codes, offsets, links, numbers

    def by_text(self, ends: np.ndarray) -> np.ndarray:
        """For each text the sum of what stretches have, given as running sums."""
        return np.diff(np.append(0, np.cumsum(np.diff(ends)[self.codes]))[self.offsets])

    def of_links(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, pair) of every occurrence of the chosen links (bool)."""
        each = np.diff(np.append(0, np.cumsum(chosen))[self.links])
        pairs = ragged(self.numbers[chosen], each, self.codes)
        text = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        return np.repeat(text, each[self.codes]), pairs

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, how many links of the texts hold each)."""
        times = np.repeat(np.bincount(self.codes, minlength=len(self.links) - 1), np.diff(self.links))
        pairs, place = np.unique(self.numbers, return_inverse=True)
        return pairs, np.bincount(place, times, len(pairs)).astype(np.int64)


GROUP_COLUMNS = {
    "id": "array<long>", "n_a": "array<long>", "n_b": "array<long>", "n_groups": "array<long>", "n_links": "array<long>",
    "groups_sha256": "array<string>", "codes": "binary", "offsets": "binary", "links": "binary", "numbers": "binary",
}
#: How the binary columns hold their numbers: as compressed bytes, which Spark moves whole, however many there are. All rows of
#: a file may stand in one batch, in the memory of the JVM.
KINDS = {"codes": "<i4", "offsets": "<i4", "links": "<i4", "numbers": "<i8"}


def _packed(numbers: np.ndarray) -> bytes:
    """The number of bytes as i64, and the bytes compressed."""
    data = numbers.tobytes()
    return struct.pack("<q", len(data)) + pa.compress(data, CODEC, asbytes=True)


def _unpacked(held: pa.Buffer, kind: str) -> np.ndarray:
    (size,) = struct.unpack("<q", held.slice(0, 8))
    return np.frombuffer(pa.decompress(held.slice(8), size, CODEC), kind)


def _group_row(ids: pa.Array, strings: pa.Array, pair: TokenPair, names: GroupNames) -> pa.RecordBatch:
    """One group of texts as a row. What it takes to make it goes before the next group begins."""
    found = AlignedTexts(strings, pair)
    texts = StretchedTexts(found.codes, found.offsets, found.links, found.numbers)
    written = strings_of(names(found.a, found.b, found.found, found.groups), found.codes, found.offsets, "")
    digests = [hashlib.sha256(t.as_buffer()[:-1]).hexdigest() if len(t.as_buffer()) else "" for t in written]
    del written
    sums = [texts.by_text(x) for x in (found.at_a, found.at_b, found.groups, found.links)]
    held = [ids, *map(pa.array, sums), pa.array(digests, pa.string())]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in held]
    packed = [pa.array([_packed(getattr(texts, c).astype(kind))], pa.binary()) for c, kind in KINDS.items()]
    return pa.RecordBatch.from_arrays([*lists, *packed], list(GROUP_COLUMNS))


def aligned_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each group of texts (`GROUP_COLUMNS`): what is known of each text before pairs are counted, and its
    links by stretch, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(a_path, b_path)
        names = GroupNames(pair)
        for batch in batches:
            for start, stop in groups_by_length(batch.column(1), GROUP_BYTES):
                yield _group_row(*(c.slice(start, stop - start) for c in batch.columns), pair, names)
                pa.default_memory_pool().release_unused()
        # The worker stays, for other tasks.
        pair.forget()
        pa.default_memory_pool().release_unused()

    chosen = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return chosen.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in GROUP_COLUMNS.items()))


def _stretched(batch: pa.RecordBatch, row: int) -> StretchedTexts:
    return StretchedTexts(*(_unpacked(batch[c][row].as_buffer(), kind).astype(np.int64) for c, kind in KINDS.items()))


def count_pairs(groups: DataFrame) -> DataFrame:
    """pair, b, n: how many links of all texts hold each pair of ids.

    Links are counted in the tasks, then by an aggregate that combines before it shuffles: the table
    has a row for each pair that ever meets, at most one per pair of vocabulary entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([*map(pa.array, _stretched(batch, row).counts())], ["pair", "n"])

    counted = groups.select("codes", "offsets", "links", "numbers").mapInArrow(run, "pair long, n long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n")).select("pair", (F.col("pair") % SHIFT).alias("b"), "n")


class PairCounts:
    """Frequent pairs in a task: their numbers in order, their counts, and whether these are their B id's highest."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> None:
        self.pairs, self.counts, self.best = pairs, counts, best

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, counts, best); 0 and False for pairs that are not here."""
        if not len(self.pairs):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        found = self.pairs[at] == pairs
        return found, np.where(found, self.counts[at], 0), found & self.best[at]


def _send(frequent: DataFrame) -> Broadcast:
    table = frequent.select("pair", "n", "is_best").toArrow()
    order = np.argsort(np.asarray(table["pair"]))
    return frequent.sparkSession.sparkContext.broadcast(PairCounts(*(np.asarray(table[c])[order] for c in ("pair", "n", "is_best"))))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    A, a byte-level tokenizer, reads a space and the text; B, a sentencepiece model, reads the text and puts
    the space itself. A text that is null, empty or has other bytes on a side has no tokens:
    zeros and ''. Repeated rows count as often as they occur, ids may be null or repeated.

    The texts are read once. What they come to is written by groups of texts, counted from there, and summed
    up with the counts. The `most_pairs` most frequent
    pairs (17 bytes each) are looked up in the tasks; a text's other pairs are written with their
    numbers of links, joined with the table of all pairs and summed by row, so no pair is left out.
    Each B id's highest count has one row per vocabulary entry.
    """
    groups = pin(aligned_groups(docs, a_path, b_path, id_col, text_col), "aligned-groups")
    counted = pin(count_pairs(groups), "pair-counts")
    highest = F.broadcast(counted.groupBy("b").agg(F.max("n").alias("most")))
    valued = counted.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    frequent = is_frequent(counted, most_pairs)
    sent = _send(valued.where(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                texts, n = _stretched(batch, row), len(batch["id"][row])
                here, counts, best = known.find(texts.numbers)
                sums = [texts.by_text(np.append(0, np.cumsum(x))[texts.links]) for x in (best.astype(np.int64), counts)]
                owner, rare = texts.of_links(~here)
                order = np.lexsort((rare, owner))
                rare, owner = rare[order], owner[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1])
                firsts = np.flatnonzero(new)
                ends = pa.array(np.searchsorted(owner[firsts], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (rare[firsts], np.diff(np.append(firsts, len(rare))))]
                narrow = [batch[c][row].values for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*narrow, *map(pa.array, sums), batch["groups_sha256"][row].values, *lists], columns)

    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "pairs", "times"]
    schema = ", ".join(f"{c} long" for c in columns[:7]) + ", groups_sha256 string, pairs array<long>, times array<long>"
    # Rows are numbered once they are written, as ids may repeat.
    rows = pin(groups.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "aligned")
    asked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    more = asked.join(valued.where(~frequent), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best")
    )
    added = {c: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))}
    out = rows.drop("pairs", "times").join(more, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *added.values(), "groups_sha256")
