"""Texts as chunks between blanks, and what each distinct chunk encodes to."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a task remembers; those that are not met again make room first.
REMEMBERED = 250_000
#: Signs that stand alone behind letters.
SIGNS = ".,;:!?"


def coded_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """`chunk_codes` with the chunks as Python strings."""
    codes, offsets, chunks = chunk_codes(texts)
    return codes, offsets, chunks.to_pylist()


def chunk_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, chunks): text i is chunks[c] for c in codes[offsets[i]:offsets[i + 1]].

    Chunks are what stands between runs of ASCII blanks, which no word of a white-space tokenizer
    spans. Empty ones may stand at the ends of a text. A null text is empty.
    """
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    coded = lists.flatten().dictionary_encode()
    offsets = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))))
    return np.asarray(coded.indices, np.int64), offsets, coded.dictionary


def signs_apart(chunks: pa.Array, are_words: Callable[[list[str]], Sequence[bool]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(parts, part, sign): chunk i is parts[part[i]] and behind it SIGNS[sign[i]], or nothing if sign[i] is -1.

    A sign is split from letters alone (`are_words`, which is asked about what is not ASCII). ASCII letters become lower case,
    so that a part stands for all chunks that differ in case or sign; other chunks are parts as they are.
    """
    chunks = chunks.cast(pa.large_string())
    bare = pc.ascii_rtrim(chunks, SIGNS)
    gone = np.asarray(pc.binary_length(chunks), np.int64) - np.asarray(pc.binary_length(bare), np.int64)
    plain = np.asarray(pc.ascii_is_alpha(bare)) & (gone <= 1)
    apart = plain & (gone == 1)
    wide = np.flatnonzero(~plain & (gone == 1) & ~np.asarray(pc.string_is_ascii(bare)))
    apart[wide] = are_words(bare.take(pa.array(wide)).to_pylist())
    parts = pc.if_else(pa.array(plain), pc.ascii_lower(bare), pc.if_else(pa.array(apart), bare, chunks)).dictionary_encode()
    sign = np.full(len(chunks), -1)
    sign[apart] = np.asarray(pc.index_in(pc.utf8_slice_codeunits(chunks.filter(pa.array(apart)), -1), value_set=pa.array(list(SIGNS), pa.large_string())))
    return parts.dictionary, np.asarray(parts.indices, np.int64), sign


def split_signs(chunks: pa.Array, is_word: Callable[[str], bool]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """`signs_apart` with the parts as Python strings, asking about one string at a time."""
    parts, part, sign = signs_apart(chunks, lambda texts: [is_word(t) for t in texts])
    return parts.to_pylist(), part, sign


class ChunkMemory(dict):
    """chunk -> what `encode` gives for it, for a list of chunks at a time.

    Two generations: when the new one is full it becomes the old one, and what is met again moves
    over, so frequent chunks stay and rare ones go.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence]) -> None:
        super().__init__()
        self.encode = encode
        self.old: dict = {}

    def of(self, chunks: Sequence[str]) -> list:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        new = set(chunks).difference(self)
        self.update({c: self.old[c] for c in new.intersection(self.old)})
        fresh = list(new.difference(self.old))
        self.update(zip(fresh, self.encode(fresh)))
        return list(map(self.__getitem__, chunks))


class IdMemory:
    """Distinct parts and their ids, as columns: a part costs some thirty bytes and no object.

    `encode` gives (starts, sizes, ids) of an array of parts. When more than `most` are held, only those of the last call stay.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = 4 * REMEMBERED) -> None:
        self.encode, self.most = encode, most
        self.names = pa.array([], pa.large_string())
        self.starts = self.sizes = np.array([], np.int64)
        self.ids = np.array([], np.uint16)

    def of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, ids): the ids of distinct part i are ids[starts[i] : starts[i] + sizes[i]]."""
        at = np.array(pc.index_in(parts, value_set=self.names).fill_null(-1), np.int64)
        fresh = at < 0
        if fresh.any():
            names = parts.filter(pa.array(fresh))
            starts, sizes, ids = self.encode(names)
            at[fresh] = len(self.names) + np.arange(len(names))
            self.names = pa.concat_arrays([self.names, names])
            self.starts, self.sizes = np.append(self.starts, len(self.ids) + starts), np.append(self.sizes, sizes)
            self.ids = np.append(self.ids, ids)
        found = self.starts[at], self.sizes[at], self.ids
        if len(self.names) > self.most:
            self.names, self.sizes = parts, found[1]
            self.ids = self.ids[ranges(*found[:2])]
            self.starts = np.cumsum(self.sizes) - self.sizes
        return found


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] ... starts[i] + sizes[i] - 1, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
