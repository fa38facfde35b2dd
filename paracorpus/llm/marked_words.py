"""SentencePiece ids by a table of distinct marked words."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from paracorpus.llm.bounded import is_frequent
from paracorpus.llm.common import pin
from paracorpus.llm.merge_automaton import groups_by_length

# Fixed value: the character that stands for a space in pieces.
MARK = "▁"
#: Bytes of text whose distinct words are looked up at once; one longer text is a group of its own.
GROUP_BYTES = 6_000_000
#: Rows of the table that are sent to the tasks, and UTF-8 bytes of a word in it. Words beyond are
#: segmented where they stand.
MOST_WORDS, WORD_BYTES = 300_000, 48


class PieceTokenizer:
    """A model whose pieces never cross a mark: one mark is put in front of a text, nothing else is
    changed, and marks stand only at the beginning of pieces. So no merge joins what stands before a
    run of marks to the run, and the ids of a text are those of its marked words, one after the other."""

    def __init__(self, path: str) -> None:
        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
        if crossing or self.library.normalize("  a  Å ") != f"{MARK * 3}a{MARK * 2}Å{MARK}":
            raise ValueError(f"pieces of this model cross marks, or it changes texts: {crossing[:3]}")
        self.mark = self.library.piece_to_id(MARK)
        if self.library.is_unknown(self.mark):
            raise ValueError("this model has no piece for a mark alone")

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words, with a space for each mark. The library puts the first mark itself, but
        not before an empty text."""
        return [ids or [self.mark] for ids in self.library.encode([w[1:] for w in words], num_threads=1)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """What each marked word's ids say, its marks as spaces; the library drops the first."""
        return [" " + text for text in self.library.decode(ids, num_threads=1)]


@functools.lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One per worker and file; the file must be at this path on every executor."""
    return PieceTokenizer(path)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a large_string array."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def with_space(texts: pa.Array) -> pa.Array:
    """A space in front of every text that is not empty; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    space = pa.scalar(" ", pa.large_string())
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(space, texts, pa.scalar("", pa.large_string())))


def coded_pieces(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, text offsets, distinct strings) of the strings that begin at `starts` and together are `data`."""
    ends = np.append(starts, len(data)).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    coded = strings.dictionary_encode()
    return np.asarray(coded.indices, np.int64), np.searchsorted(starts, offsets), coded.dictionary


def marked_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, words): text i is words[c] for c in codes[offsets[i]:offsets[i + 1]].

    A marked word is a run of marks and what follows up to the next mark. Marks are spaces here, as
    the character itself and a space mean the same. A null or empty text has no words.
    """
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
    data, offsets = text_bytes(with_space(texts))
    space = data == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return coded_pieces(data, offsets, np.flatnonzero(start))


def word_table(docs: DataFrame, path: str, text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """word, ids, decoded: each marked word that more than one group of texts has, segmented once.

    Words are counted in the tasks, then by one aggregate on the word, so the shuffle has each
    distinct word of a group once. Of the words of at most `WORD_BYTES` bytes the `most_words` most frequent
    are in the table; a word that a single group has is segmented there, as often as in a table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in groups_by_length(batch.column(0), GROUP_BYTES):
                codes, _, words = marked_words(batch.column(0).slice(start, stop - start))
                n = pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))
                short = pc.less_equal(pc.binary_length(words), WORD_BYTES)
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), n], ["word", "n"]).filter(short)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_tokenizer(path)
        for batch in batches:
            ids = tokenizer.encode(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(tokenizer.decode(ids), pa.string())], ["word", "ids", "decoded"]
            )

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word string, n long")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    words = pin(counted.where("groups > 1").select("word", "n"), "marked-words")
    return words.where(is_frequent(words, most_words)).select("word").mapInArrow(segment, "word string, ids array<int>, decoded string")


class WordTable:
    """The table as it is in a task, and the way from texts to ids."""

    def __init__(self, sent: Broadcast, path: str) -> None:
        table = pa.ipc.open_stream(pa.py_buffer(sent.value)).read_all().combine_chunks()
        self.words, self.ids, self.decoded = (
            table[c].combine_chunks() if table[c].num_chunks else pa.array([], table[c].type) for c in ("word", "ids", "decoded")
        )
        self.tokenizer = piece_tokenizer(path)

    def look_up(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids, decoded) of distinct words: from the table, the others segmented here."""
        found = pc.index_in(words.cast(pa.string()), value_set=self.words)
        missing = pc.is_null(found)
        fresh = self.tokenizer.encode(words.filter(missing).to_pylist())
        ids = pa.concat_arrays([self.ids, pa.array(fresh, self.ids.type)])
        decoded = pa.concat_arrays([self.decoded, pa.array(self.tokenizer.decode(fresh), pa.string())])
        place = np.asarray(found.fill_null(0), np.int64).copy()
        miss = np.asarray(missing)
        place[miss] = len(self.words) + np.arange(len(fresh))
        return ids.take(pa.array(place)), decoded.take(pa.array(place))


def send_table(table: DataFrame) -> Broadcast:
    """At most `MOST_WORDS` rows of `WORD_BYTES` bytes and their ids, as one Arrow stream."""
    found = table.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    return table.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """id, ids (array of int), decoded: the ids of every whole text and what they decode to.

    The texts are read twice, for the table and for the ids; no text is shuffled. Null counts as
    empty and has no ids. Rows are returned as they come, ids null or repeated.
    """
    sent = send_table(word_table(docs, path, text_col, most_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(sent, path)
        for batch in batches:
            for start, stop in groups_by_length(batch.column(1), GROUP_BYTES):
                codes, offsets, words = marked_words(batch.column(1).slice(start, stop - start))
                ids, decoded = table.look_up(words)
                flat = ids.take(pa.array(codes))
                ends = np.append(0, np.cumsum(np.asarray(flat.value_lengths(), np.int64)))[offsets]
                joined = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.flatten())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), joined, texts_of(decoded, codes, offsets)], ["id", "ids", "decoded"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    return chosen.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def strings_of(strings: pa.Array, codes: np.ndarray, offsets: np.ndarray, between: str) -> pa.Array:
    """For each text its words' strings, joined."""
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), strings.cast(pa.large_string()).take(pa.array(codes)))
    return pc.binary_join(lists, pa.scalar(between, pa.large_string()))


def texts_of(decoded: pa.Array, codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each text's words as they decode, without the space that stands for the mark put in front."""
    data, ends = text_bytes(strings_of(decoded, codes, offsets, ""))
    keep = np.ones(len(data), bool)
    filled = ends[1:] > ends[:-1]
    keep[ends[:-1][filled]] = False
    ends = ends - np.append(0, np.cumsum(filled))
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data[keep])).cast(pa.string())


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: what `encode_documents` gives, reduced in the tasks.

    Ids are decimal with commas between them. An empty text has 0 tokens and the digests of the empty
    string. Nulls and repeated rows as there.
    """
    sent = send_table(word_table(docs, path, text_col, most_words))

    def digest(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(sent, path)
        for batch in batches:
            for start, stop in groups_by_length(batch.column(1), GROUP_BYTES):
                codes, offsets, words = marked_words(batch.column(1).slice(start, stop - start))
                ids, decoded = table.look_up(words)
                sizes = np.append(0, np.cumsum(np.asarray(ids.value_lengths(), np.int64)[codes]))[offsets]
                names = pc.binary_join(ids.cast(pa.list_(pa.string())), ",")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start), pa.array(np.diff(sizes)),
                        digest(strings_of(names, codes, offsets, ",")), digest(texts_of(decoded, codes, offsets)),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    out = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return chosen.mapInArrow(run, out).withColumnRenamed("id", id_col)
