"""Byte-pair encoding by a deterministic automaton over tokens, compiled from the merges."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paracorpus.llm.chunks import REMEMBERED, SIGNS, ChunkMemory, chunk_codes, coded_chunks, signs_apart
from paracorpus.llm.common import giving_back

NEVER, ALWAYS = -1, 1 << 40
#: Texts that are encoded together, by their total length; one longer text is a group of its own.
GROUP_CHARS = 8_000_000
#: Arcs that the transition table holds; those that were not asked for longest make room.
ARCS = 1 << 18
#: Words inside longer chunks that a tokenizer remembers, twice as they make room by turns.
INNER_WORDS = 25_000
# White space as the tokenizer file's patterns mean it.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class MergeAutomaton:
    """The automaton that accepts exactly the token sequences that the merges, applied in order,
    give for some word.

    At first it has one state with an arc for each symbol. The gadget of merge r = (a, b) acts on
    every state p with an arc a to a state that has an arc b: it sends p's arc a to a new copy of
    that state without arc b, and gives p an arc ab to where b led. So the state that a sequence
    reaches depends on its last token alone, and `arc` says until which merge a state keeps an arc.
    A vocabulary of n tokens has up to n * n arcs; they are worked out from the gadgets' record
    (parent state, cut arc, time) when first asked for, and kept in the transition table.

    Each prefix of a word is accepted along one path only. `encode` therefore keeps one state per
    place of the word and follows table entries, long tokens first, until the word's end is reached; no merge is searched
    or applied to a word.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>") -> None:
        self.end = end
        self.labels = {i: s for s, i in vocab.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for time, (left, right) in enumerate(merges):
            self._add_gadget(time, vocab[left], vocab[right], vocab[left + right])
        self.arc = functools.lru_cache(maxsize=ARCS)(self._arc)
        # Tokens that the merges ever give; a merge may always come too late for one.
        self.ids = {s: i for s, i in vocab.items() if self._stands(i)}
        #: The tokens that end a word, without the mark of the end.
        self.last = {s.removesuffix(end): i for s, i in self.ids.items() if s.endswith(end)}
        #: What some token begins with, so a walk ends where no token can follow, and the token that it is, or -1.
        self.inner = {s[:n]: -1 for s in (x.removesuffix(end) for x in self.ids) for n in range(1, len(s) + 1)}
        self.inner |= {s: i for s, i in self.ids.items() if s in self.inner}

    def _add_gadget(self, time: int, left: int, right: int, merged: int) -> None:
        self.parts[merged] = (left, right)
        self.born[merged] = time
        self.cut.setdefault((left, right), time)

    def _arc(self, state: int, token: int) -> int:
        """The time at which the state of `state` loses its arc `token`: NEVER if it never has one."""
        made, born = self.born.get(state, NEVER), self.born.get(token, NEVER)
        if born < made:
            # The state was copied from that of its right part, with the arcs this one had then.
            there = self.arc(self.parts[state][1], token) >= made
        elif born == NEVER:
            there = True
        else:
            left, right = self.parts[token]
            there = self.arc(state, left) > born and self.arc(left, right) >= born
        return self.cut.get((state, token), ALWAYS) if there else NEVER

    def encode(self, symbols: str) -> list[int]:
        """Token ids of one word, given as symbols; the last symbol carries the mark of the end."""
        n, inner, last, arc = len(symbols), self.inner, self.last, self.arc
        if not n:
            return []
        if symbols in last:
            return [last[symbols]]
        # Places reached so far (token, where it begins) and arcs still to be followed, the longest next.
        found: dict[int, tuple[int, int]] = {}
        ahead: list[tuple[int, int, int, int]] = []
        start, state = 0, -1
        while True:
            for stop in range(start + 1, n):
                token = inner.get(symbols[start:stop])
                if token is None:
                    break
                if token >= 0:
                    ahead.append((stop, token, start, state))
            else:
                token = last.get(symbols[start:])
                if token is not None and (not start or arc(state, token) == ALWAYS):
                    break
            while True:
                stop, token, begun, state = ahead.pop()
                if stop not in found and (not begun or arc(state, token) == ALWAYS):
                    break
            found[stop] = token, begun
            start, state = stop, token
        path = [token]
        while start:
            token, start = found[start]
            path.append(token)
        return path[::-1]

    def _stands(self, token: int) -> bool:
        """Whether both parts may still meet when their merge is applied."""
        made = self.born.get(token, NEVER)
        return made == NEVER or self.arc(*self.parts[token]) >= made

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, with spaces between them."""
        return " ".join(self.labels[i] for i in ids if i in self.labels)


@functools.lru_cache(maxsize=2)
def file_parts(path: str) -> tuple:
    """The file's normaliser and splitter, without its vocabulary."""
    tokenizer = Tokenizer.from_file(path)
    return tokenizer.normalizer, tokenizer.pre_tokenizer


@functools.lru_cache(maxsize=2)
def plain(path: str) -> Callable[[str], str]:
    """Composed characters in lower case, by the tables of the file's own normaliser: they may be of
    another version than those here."""
    normalizer, _ = file_parts(path)
    return lambda text: text.lower() if text.isascii() else normalizer.normalize_str(text)


# Blocks of ideographs and syllables that are letters in every version of the tables.
ALWAYS_LETTERS = [(0x3400, 0x4DB5), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x20000, 0x2A6D6)]


def _ranges(points: list[int]) -> str:
    """A regular expression's class of these ascending code points, without its brackets."""
    out, start = [], None
    for i, c in enumerate(points):
        start = c if start is None else start
        if i + 1 == len(points) or points[i + 1] != c + 1:
            out.append(regex.escape(chr(start)) + (f"-{regex.escape(chr(c))}" if c > start else ""))
            start = None
    return "".join(out)


@functools.lru_cache(maxsize=2)
def library_classes(path: str) -> tuple[str, str]:
    """Letters and numbers as the library's tables have them, which may be of another version than those here:
    its splitter is asked about each code point that any table calls a letter or a number."""
    _, splitter = file_parts(path)
    letters = [c for lo, hi in ALWAYS_LETTERS for c in range(lo, hi + 1)]
    sure, points = set(letters), "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    asked = [c for c in map(ord, regex.findall(r"[\p{L}\p{N}]", points)) if c not in sure]
    # A letter goes on with the one before it, a number stands alone, other signs go on with the one behind.
    begins = {start: stop for _, (start, stop) in splitter.pre_tokenize_str("".join(f"a{chr(c)}! " for c in asked))}
    letters += [c for i, c in enumerate(asked) if 4 * i + 1 not in begins]
    numbers = [c for i, c in enumerate(asked) if begins.get(4 * i + 1) == 4 * i + 2]
    return _ranges(sorted(letters)), _ranges(numbers)


@functools.lru_cache(maxsize=2)
def only_letters(path: str) -> Callable[[str], bool]:
    """Whether a string, as it is after `plain`, is letters alone for the library."""
    word = regex.compile(f"[{library_classes(path)[0]}]+").fullmatch
    return lambda text: bool(word(text))


@functools.lru_cache(maxsize=2)
def all_letters(path: str) -> Callable[[list[str]], list[bool]]:
    """`only_letters` of the plain forms of strings, which are made by few calls: no sign joins a bar or goes over one."""
    is_word, one, (normalizer, _) = only_letters(path), plain(path), file_parts(path)

    def ask(texts: list[str]) -> list[bool]:
        out: list[bool] = []
        for lo in range(0, len(texts), 500):
            some = texts[lo : lo + 500]
            normal = normalizer.normalize_str("|".join(some)).split("|")
            out += map(is_word, normal if len(normal) == len(some) else map(one, some))
        return out

    return ask


class WordTokenizer:
    """A tokenizer file with word ends: special tokens, normal form, lower case, words, automaton."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.labels |= {i: s for s, i in self.special.items()}
        names = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.apart = regex.compile(f"({names})") if names else None
        words = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        letters, numbers = library_classes(path)
        self.words = regex.compile(words.replace(r"\s", BLANK).replace(r"\p{L}", letters).replace(r"\p{N}", numbers))
        self.is_word, self.plain, self.all_letters = only_letters(path), plain(path), all_letters(path)
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.known: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def encode_chunk(self, chunk: str) -> list[int]:
        core, sign = (chunk[:-1], chunk[-1]) if chunk and chunk[-1] in ".,;:!?" else (chunk, "")
        word = self.plain(core)
        if word and self.is_word(word):  # letters alone are one word, and so is the sign after them
            return self._word(word) + self._word(sign) if sign else self._word(word)
        if self.apart is None:
            return self._ordinary(chunk)
        ids: list[int] = []
        for piece in self.apart.split(chunk):
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                ids += self._ordinary(piece)
        return ids

    def _ordinary(self, text: str) -> list[int]:
        return [i for word in self.words.findall(self.plain(text)) for i in self._word(word)]

    def _word(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > INNER_WORDS:
                self.known, self.old = {}, self.known
            found = self.old.get(word)
            if found is None:
                symbols = word.encode("utf-8").decode("latin-1").translate(self.symbols)
                found = self.automaton.encode(symbols)
            self.known[word] = found
        return found

    def letters(self, text: str) -> bool:
        """Whether a string is letters alone once it is plain."""
        return self.is_word(self.plain(text))

    def describe(self, part: str) -> tuple[int, str, str]:
        """(number of ids, the ids, the labels of their arcs), both with spaces between them. ASCII letters come in lower case
        and are symbols as they are."""
        ids = self.automaton.encode(part) if part.isascii() and part.isalpha() else self.encode_chunk(part)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids)


class Descriptions:
    """What `describe` says of distinct parts, as columns: no object for each. When more than `most` are held, only those
    of the last call stay."""

    def __init__(self, describe: Callable[[str], tuple[int, str, str]], most: int = 2 * REMEMBERED) -> None:
        self.describe, self.most = describe, most
        self.held = self._columns([])

    def _columns(self, parts: list[str]) -> pa.Table:
        sizes, ids, labels = zip(*map(self.describe, parts)) if parts else ((), (), ())
        text = pa.large_string()
        return pa.table({"part": pa.array(parts, text), "size": pa.array(sizes, pa.int64()), "ids": pa.array(ids, text), "labels": pa.array(labels, text)})

    def of(self, parts: pa.Array) -> pa.Table:
        """part, size, ids, labels of distinct parts, in their order."""
        at = np.array(pc.index_in(parts, value_set=self.held["part"]).fill_null(-1), np.int64)
        fresh = np.flatnonzero(at < 0)
        at[fresh] = len(self.held) + np.arange(len(fresh))
        self.held = pa.concat_tables([self.held, self._columns(parts.take(pa.array(fresh)).to_pylist())]).combine_chunks()
        found = self.held.take(pa.array(at))
        if len(self.held) > self.most:
            self.held = found
        return found


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker and file; the file must be at this path on every executor."""
    return WordTokenizer(path)


def groups_by_length(texts: pa.Array, size: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts that together have about `size` bytes."""
    start = held = 0
    for i, text in enumerate(texts):
        held += text.as_buffer().size if text.is_valid else 0
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int): the token ids of every whole text.

    A null text counts as empty and has no ids. Ids are returned as they come, null or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        memory = ChunkMemory(lambda fresh: [tokenizer.encode_chunk(c) for c in fresh])
        for batch in batches:
            for start, stop in groups_by_length(batch.column(1)):
                codes, offsets, chunks = coded_chunks(batch.column(1).slice(start, stop - start))
                known = memory.of(chunks)
                ids = [[i for c in codes[a:b] for i in known[c]] for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"]
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    return chosen.mapInArrow(giving_back(run), "id long, ids array<int>").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: digests of each text's ids and of the decoded ids.

    What `encode_documents` gives, reduced inside the tasks: each distinct word's ids and arc labels
    are written out once and joined for every text that has it. Nulls, empty texts and repeated
    rows as there; an empty text has 0 tokens and the digests of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        memory = Descriptions(tokenizer.describe)
        signs = [*map(tokenizer.describe, SIGNS), (0, "", "")]
        more = np.array([n for n, _, _ in signs], np.int64)
        none = pa.scalar("", pa.large_string())
        ends = [pa.array([f" {x[i]}" if x[i] else "" for x in signs], pa.large_string()) for i in (1, 2)]
        for batch in batches:
            for start, stop in groups_by_length(batch.column(1)):
                codes, offsets, chunks = chunk_codes(batch.column(1).slice(start, stop - start))
                parts, part, sign = signs_apart(chunks, tokenizer.all_letters)
                known = memory.of(parts).take(pa.array(part))
                sizes, sign = known["size"].to_numpy() + more[sign], pa.array(sign % len(signs))
                names, labels = (
                    pc.binary_join_element_wise(known[c].combine_chunks(), end.take(sign), none).to_pylist() for c, end in zip(("ids", "labels"), ends)
                )
                counts, ids, decoded = [], [], []
                for a, b in zip(offsets, offsets[1:]):
                    parts = codes[a:b]
                    each = sizes[parts]
                    parts = parts[each > 0].tolist()
                    counts.append(int(each.sum()))
                    ids.append(hashlib.sha256(" ".join([names[c] for c in parts]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(" ".join([labels[c] for c in parts]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    out = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return chosen.mapInArrow(giving_back(run), out).withColumnRenamed("id", id_col)
