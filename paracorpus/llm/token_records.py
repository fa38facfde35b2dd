"""Token ids in length-delimited binary records with masked checksums and an offset index."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paracorpus.llm.chunks import SIGNS, IdMemory, chunk_codes, ranges, signs_apart
from paracorpus.llm.common import broadcast_if_small
from paracorpus.llm.merge_automaton import all_letters, groups_by_length
from paracorpus.sources.folders import open_file

#: Characters of text per file: the ids of a file are read into memory at once.
SHARD_CHARS = 12_000_000
#: Fixed value: what is added to a rotated checksum, so that checksums of checksums stay sound.
MASK = 0xA282EAD8
END = b"\n"
#: Words that the library encodes by one call.
AT_ONCE = 500
#: Bytes before a payload: its length and the checksum of the length.
HEAD = 12


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """u64 length, u32 masked crc32 of the length, payload, u32 masked crc32 of the payload; all
    little-endian. The writer puts one line end after each frame."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def frames(content: bytes, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of the records of a file; raises if a length or a checksum is wrong."""
    at = start
    while at < len(content):
        length, check = struct.unpack_from("<QI", content, at)
        if masked(content[at : at + 8]) != check:
            raise ValueError(f"the length at byte {at} does not match its checksum")
        stop = at + HEAD + length
        payload = content[at + HEAD : stop]
        if len(payload) < length or masked(payload) != struct.unpack_from("<I", content, stop)[0]:
            raise ValueError(f"the record at byte {at} does not match its checksum")
        if content[stop + 4 : stop + 5] != END:
            raise ValueError(f"the record at byte {at} has no line end")
        yield at, payload
        at = stop + 5


def serialize(doc_id: int | None, ids: bytes) -> bytes:
    """A flag byte (1: the id is null), the id as i64, and the token ids as little-endian u16."""
    return struct.pack("<Bq", doc_id is None, doc_id or 0) + ids


def deserialize(payload: bytes) -> tuple[int | None, bytes]:
    null, doc_id = struct.unpack_from("<Bq", payload)
    return None if null else doc_id, payload[9:]


class ChunkEncoder:
    """Chunks to ids by the tokenizers library, each distinct word core once."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: A special token between words ends them and shows where they end, so one call takes many.
        self.mark, self.mark_id = next(iter(special.items()), (None, None))
        self.cores = IdMemory(self._encode)
        self.wide_letters = all_letters(path)
        #: Which ids end a word.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True

        self.signs = self._encode(pa.array([*SIGNS, ""], pa.large_string()))

    def _words(self, texts: pa.Array) -> np.ndarray:
        """Which texts normalisation leaves letters alone, which are one word."""
        words = np.array(pc.ascii_is_alpha(texts))
        wide = np.flatnonzero(~np.asarray(pc.string_is_ascii(texts)))
        words[wide] = self.wide_letters(texts.take(pa.array(wide)).to_pylist())
        return words

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, ids): the ids of text i are ids[starts[i] : starts[i] + sizes[i]]."""
        sizes, order, ids, strings = np.full(len(texts), -1), [], [], texts.to_pylist()

        def add(group: list[int] | np.ndarray, found: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
            sizes[group] = stops - starts
            order.extend(group)
            ids.append(found if len(starts) == 1 or (starts[1:] == stops[:-1]).all() else found[ranges(starts, stops - starts)])

        def ask(text: str) -> np.ndarray:
            (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            return np.array(found.ids, np.uint16)

        words = np.flatnonzero(self._words(texts)).tolist()
        for lo in range(0, len(words), AT_ONCE):
            group = words[lo : lo + AT_ONCE]
            found = ask(" ".join([strings[i] for i in group]))
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) == len(group) and stops[-1] == len(found):
                add(group, found, np.append(0, stops[:-1]), stops)
        plain = [i for i in np.flatnonzero(sizes < 0).tolist() if self.mark is not None and "<" not in strings[i] and strings[i]]
        for lo in range(0, len(plain), AT_ONCE):
            group = plain[lo : lo + AT_ONCE]
            found = ask(self.mark.join([strings[i] for i in group]))
            marks = np.flatnonzero(found == self.mark_id)
            add(group, found, np.append(0, marks + 1), np.append(marks, len(found)))
        for i in np.flatnonzero(sizes < 0).tolist():
            found = ask(strings[i])
            add([i], found, np.array([0]), np.array([len(found)]))
        starts = np.empty(len(texts), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return starts, sizes, np.concatenate(ids or [np.array([], np.uint16)])

    def library(self, texts: list[str]) -> list[bytes]:
        starts, sizes, ids = self._encode(pa.array(texts, pa.large_string()))
        return [ids[a : a + n].tobytes() for a, n in zip(starts, sizes)]

    def flat(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids): how many ids each chunk has, and the ids of all chunks in turn.

        Letters with one full stop, comma or the like are encoded as the letters and the sign,
        which the tokenizer splits too; all other chunks as they are. What counts are the characters after
        normalisation, which may end a letter with a mark that goes with the sign."""
        parts, part, sign = signs_apart(chunks, self.wide_letters)
        (starts, sizes, ids), (sign_starts, sign_sizes, sign_ids) = self.cores.of(parts), self.signs
        both = np.stack([sizes[part], sign_sizes[sign]], 1)
        places = np.stack([starts[part], len(ids) + sign_starts[sign]], 1)
        return both.sum(1), np.append(ids, sign_ids)[ranges(places.ravel(), both.ravel())]

    def __call__(self, chunks: list[str]) -> list[bytes]:
        sizes, ids = self.flat(pa.array(chunks, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One per worker and file; the file must be at this path on every executor."""
    return ChunkEncoder(path)


def encode_texts(texts: pa.Array, encoder: ChunkEncoder) -> list[bytes]:
    """The ids of each whole text as little-endian u16."""
    codes, offsets, chunks = chunk_codes(texts)
    sizes, ids = encoder.flat(chunks)
    each = sizes[codes]
    flat = ids[ranges((np.cumsum(sizes) - sizes)[codes], each)]
    at = np.append(0, np.cumsum(each))[offsets]
    return [flat[a:b].tobytes() for a, b in zip(at, at[1:])]


def write_token_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append `end_id`, and write `path`/records and `path`/index.

    The documents are range-partitioned and sorted by id (nulls first, equal ids by text), encoded,
    and written as one file of frames per partition by Spark's committed text output, which works
    on any file system and leaves no part of a lost task. File names ascend with the ids. The
    index is a separate table (file, record, offset, length, doc_id, n_tokens), so a reader may
    fetch records in any order. A null text counts as empty: its record has the end id alone.
    """
    end = struct.pack("<H", end_id)
    key, text = F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    total = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    files = max(1, -(-total // SHARD_CHARS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        for batch in batches:
            for start, stop in groups_by_length(batch.column(1)):
                ids = encode_texts(batch.column(1).slice(start, stop - start), encoder)
                out = [frame(serialize(d, x + end)) for d, x in zip(batch.column(0).slice(start, stop - start).to_pylist(), ids)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    ordered = docs.select(key, text).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    records = ordered.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", END.decode()).text(f"{path}/records")
    spark = docs.sparkSession
    index_records(spark, path).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/records").select("path", "content")


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (number in the file), offset, length, doc_id, n_tokens, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for n, (at, payload) in enumerate(frames(content.as_py())):
                    doc_id, ids = deserialize(payload)
                    rows.append((name.rsplit("/", 1)[-1], n, at, len(payload), doc_id, len(ids) // 2))
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    ["file", "record", "offset", "length", "doc_id", "n_tokens"],
                )

    schema = "file string, record long, offset long, length long, doc_id long, n_tokens long"
    return _files(spark, path).mapInArrow(run, schema)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """file, first: the number of ids in all files before it. One row per file."""
    sizes = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def read_token_records(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """file, doc_id, at (ids before it in its file), n_tokens, ids (bytes, `width` per id,
    little-endian): every record, in whatever order files are read; frames are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, at = [], 0
                for _, payload in frames(content.as_py()):
                    doc_id, ids = deserialize(payload)
                    n = len(ids) // 2
                    rows.append((name.rsplit("/", 1)[-1], doc_id, at, n, np.frombuffer(ids, "<u2").astype(f"<u{width}").tobytes()))
                    at += n
                    if len(rows) == 1000:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    def pack(rows: list) -> pa.RecordBatch:
        file, doc_id, at, n, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(file), *(pa.array(c, pa.int64()) for c in (doc_id, at, n)), pa.array(ids, pa.binary())],
            ["file", "doc_id", "at", "n_tokens", "ids"],
        )

    return _files(spark, path).mapInArrow(run, "file string, doc_id long, at long, n_tokens long, ids binary")


def read_shuffled(spark: SparkSession, path: str, seed: int = 0, width: int = 4) -> DataFrame:
    """doc_id, n_tokens, ids: every record, in an order that depends on `seed` alone, by way of the offset index.

    Only index rows are shuffled: they are dealt to tasks by a hash, and each task fetches its records where the
    index says they stand, through the file system that all executors share. Lengths and checksums are verified.
    """
    order = F.xxhash64(F.lit(seed), "file", "offset")
    dealt = spark.read.parquet(f"{path}/index").select("file", "offset", "length", order.alias("order"))
    dealt = dealt.repartitionByRange("order", "file", "offset").sortWithinPartitions("order", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            for lo in range(0, len(files), 200):
                rows: list = [None] * len(files[lo : lo + 200])
                opened = (None, None)
                # A file is opened once for the records of it that are due; they keep their places.
                for i in sorted(range(len(rows)), key=lambda i: (files[lo + i], offsets[lo + i])):
                    name = f"{path}/records/{files[lo + i]}"
                    if opened[0] != name:
                        if opened[1]:
                            opened[1].close()
                        opened = (name, open_file(name))
                    opened[1].seek(offsets[lo + i])
                    (_, payload), *_ = frames(opened[1].read(HEAD + lengths[lo + i] + 5))
                    doc_id, ids = deserialize(payload)
                    rows[i] = (doc_id, len(ids) // 2, np.frombuffer(ids, "<u2").astype(f"<u{width}").tobytes())
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return dealt.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def describe_token_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files.

    The starts of the files are one row per file, sent to the tasks while they are few.
    """
    return (
        read_token_records(spark, path)
        .select("file", "doc_id", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))
        .join(broadcast_if_small(file_starts(spark, path)), "file")
        .select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )
