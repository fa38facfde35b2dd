"""Hashes of word shingles, alike in every process."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words per shingle.
WORDS = 5
#: Bytes of text that are hashed at once; a longer text is cut between words.
PIECE = 1 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
# Characters that separate words.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
#: An odd base and its inverse modulo 2^64, and their powers so far.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(2 * n, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.multiply.accumulate(factors)
    return _POWERS


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes in pieces of about `PIECE` that end between words; a longer word is not cut."""
    while len(data) > PIECE:
        blanks = _BLANK[data[PIECE:]]
        cut = PIECE + (int(blanks.argmax()) if blanks.any() else len(blanks))
        yield data[:cut]
        data = data[cut:]
    yield data


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word: of its UTF-8 bytes, with A-Z lower-cased.

    Words are runs of characters other than space and \\t to \\r, none of which is part of a longer
    UTF-8 character. A word's hash is a polynomial in its bytes, read off running sums.
    """
    found = []
    for data in _pieces(np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)):
        edge = np.ones(len(data) + 2, bool)
        edge[1:-1] = _BLANK[data]
        edges = np.flatnonzero(edge[1:] != edge[:-1])
        starts, ends = edges[::2], edges[1::2]
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_OF_BYTE[data] * up[: len(data)], out=sums[1:])
        found.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(found)


def distinct(sorted_values: np.ndarray) -> np.ndarray:
    return sorted_values[np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))] if len(sorted_values) else sorted_values


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `words` words; of a shorter text, of its
    whole sequence; nothing of a text without words."""
    codes = word_hashes(text)
    n = min(words, len(codes))
    if not n:
        return codes
    rolled = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        rolled = mix(rolled * _MIX[2] + codes[i : len(codes) - n + 1 + i])
    rolled.sort()
    return distinct(rolled)
