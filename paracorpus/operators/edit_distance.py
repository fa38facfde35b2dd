"""Exact edit distances of many pairs at once.

The bit-parallel column algorithm (Myers 1999, Hyyrö 2003) keeps one column of the distance
matrix in a bit vector as long as the longer side. Here a Python integer holds the vectors of
many pairs side by side, one lane of whole bytes each, so one addition advances all of them.
Every lane has a spare top bit that catches carries and shifts. Long texts are computed alone,
but only in a band around the diagonal that is widened until it is sure to be enough. Works for strings and for lists
of words, of any length.
"""

from __future__ import annotations

from collections import deque

# Lanes are joined up to about this many bytes, which a core's cache can hold.
LANES_BYTES = 16_384
# Texts of this length on go one by one, inside a band around the diagonal.
LONG = 3_000
# Columns between two moves of the band, and the first guess of the distance.
TILE = 256
FIRST_GUESS = 1 / 16


def _common_start(a, b) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _trimmed(a, b):
    """Both sides without their common start and end, which never cost anything."""
    start = _common_start(a, b)
    a, b = a[start:], b[start:]
    end = _common_start(a[::-1], b[::-1])
    return (a[: len(a) - end], b[: len(b) - end]) if end else (a, b)


def _places(pattern) -> dict:
    """Symbol -> bits of its positions in `pattern`, with at least one bit to spare."""
    width = len(pattern) // 8 + 1
    where: dict = {}
    for i, symbol in enumerate(pattern):
        bits = where.get(symbol)
        if bits is None:
            bits = where[symbol] = bytearray(width)
        bits[i >> 3] |= 1 << (i & 7)
    return where


def _advance(group: list, found: list) -> None:
    """Distances of the (index, pattern, text) in `group`, which is sorted by text length.

    The lowest lanes hold the shortest texts. A finished lane is read and shifted away, so the
    integers shrink and no lane waits for a longer one.
    """
    full, ones, offset, lanes = 0, 0, 0, deque()
    for index, pattern, text in group:
        width, where = len(pattern) // 8 + 1, _places(pattern)
        nowhere = bytes(width)
        matches = [where.get(symbol, nowhere) for symbol in text]
        mask = (1 << len(pattern)) - 1
        full |= mask << offset
        ones |= 1 << offset
        offset += 8 * width
        lanes.append((index, 8 * width, mask, matches))
    every = (1 << offset) - 1
    up, down, done = full, 0, 0
    while lanes:
        stop = len(lanes[0][3])
        for parts in zip(*(matches[done:stop] for *_, matches in lanes)):
            match = int.from_bytes(b"".join(parts), "little")
            cross = (((match & up) + up) ^ up) | match
            right = ((down | (every ^ (cross | up))) << 1) | ones
            left = (up & cross) << 1
            keep = match | down
            up = (left | (every ^ (keep | right))) & full
            down = right & keep
        done = stop
        while lanes and len(lanes[0][3]) == stop:
            # The lane holds the last column: its differences add up to the distance.
            index, width, mask, _ = lanes.popleft()
            found[index] = stop + (up & mask).bit_count() - (down & mask).bit_count()
            up, down, full, ones, every = (x >> width for x in (up, down, full, ones, every))


def _within(where: dict, rows: int, text, limit: int) -> int:
    """An upper bound of the distance, exact if it is at most `limit`.

    A path of `limit` edits leaves the diagonal by few rows to either side, so a column needs
    only the rows of that band. Rows that enter the band, and the edge above it, count one more
    than their neighbour, which is never too little.
    """
    extra = rows - len(text)
    above, below = (limit - extra) // 2 + 1, (limit + extra) // 2 + 1
    low = high = top = up = down = 0
    for start in range(0, len(text), TILE):
        part = text[start : start + TILE]
        new_low = max(low, (start - above) & ~7)
        new_high = min(rows, start + len(part) + below)
        gone = new_low - low
        passed = (1 << gone) - 1
        top += (up & passed).bit_count() - (down & passed).bit_count()
        up, down = up >> gone, down >> gone
        up |= ((1 << (new_high - high)) - 1) << (high - new_low)
        low, high = new_low, new_high
        every = (1 << (high - low)) - 1
        first, last = low >> 3, (high >> 3) + 1
        match_of = {
            symbol: int.from_bytes(where[symbol][first:last], "little") & every
            for symbol in set(part)
            if symbol in where
        }
        for symbol in part:
            match = match_of.get(symbol, 0)
            cross = ((((match & up) + up) ^ up) | match) & every
            right = ((down | (every ^ (cross | up))) << 1) | 1
            left = (up & cross) << 1
            keep = match | down
            up = (left | (every ^ ((keep | right) & every))) & every
            down = right & keep
        top += len(part)
    return top + up.bit_count() - down.bit_count()


def _long_distance(pattern, text) -> int:
    """Widen the band until the distance found inside it must be the distance."""
    where = _places(pattern)
    limit = len(pattern) - len(text) + int(len(text) * FIRST_GUESS)
    while (found := _within(where, len(pattern), text, limit)) > limit:
        limit = min(found, 2 * limit + 1)
    return found


def edit_distances(left: list, right: list) -> list[int]:
    """Levenshtein distance of each pair of strings, or of lists of hashable symbols."""
    found, open_pairs = [0] * len(left), []
    for index, (a, b) in enumerate(zip(left, right)):
        if a == b:
            continue
        a, b = _trimmed(a, b)
        if len(a) < len(b):
            a, b = b, a
        if len(b) >= LONG:
            found[index] = _long_distance(a, b)
        elif b:
            open_pairs.append((index, a, b))
        else:
            found[index] = len(a)
    open_pairs.sort(key=lambda pair: len(pair[2]))
    group, size = [], 0
    for pair in open_pairs:
        group.append(pair)
        size += len(pair[1]) // 8 + 1
        if size >= LANES_BYTES:
            _advance(group, found)
            group, size = [], 0
    if group:
        _advance(group, found)
    return found
