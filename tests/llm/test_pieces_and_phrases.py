import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from helpers import documents, table
from paracorpus.llm import bounded, marked_words, phrase_mining, token_alignment
from paracorpus.llm.oracles import COLLOCATIONS

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    " a", "a ", "  ", " ", "▁a ▁▁b", "a▁", "tab\tand\nline \r\n end", "<s> </s> <unk> <0x41>", "<|endoftext|> x <|endoftext|>", "\x00a \x00", "日本語 テスト",
    "🙂🙃 👩‍👩‍👧", "a  b 　 c d   e", "x  y   z", "n" * 5000, "word " * 4000, "é" * 300 + " é", "1 22 333 4444", "it's they'll I'M", "a \n b", "\n", "  \n a",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return documents() + list(enumerate(ODD, 5000))


@pytest.fixture(scope="module")
def pieces():
    return SentencePieceProcessor(model_file=PIECES)


def test_frequent_rows(spark):
    counts = [1] * 50 + [2] * 20 + [10**6] * 3 + [10**9, 10**12]
    df = spark.createDataFrame(list(enumerate(counts)), "id long, n long")
    for most, want in ((0, 0), (1, 1), (2, 2), (4, 2), (5, 5), (30, 25), (1000, 75)):
        assert df.where(bounded.is_frequent(df, most)).count() == want
    empty = df.limit(0)
    assert empty.where(bounded.is_frequent(empty, 5)).count() == 0


def test_key_filter(spark):
    keys = [random.Random(7).getrandbits(63) - (1 << 62) for _ in range(3000)]
    found = bounded.key_filter(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert found.has(np.array(keys, np.int64).view(np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert found.has(others).mean() < 0.02
    full = bounded.key_filter(spark.createDataFrame([(k,) for k in keys], "key long"), most_bits=64)
    assert full.has(np.array(keys, np.int64).view(np.uint64)).all() and len(full.words) == 1
    assert not bounded.key_filter(spark.createDataFrame([], "key long")).has(others).any()


@pytest.mark.parametrize("most_words", [0, 40, 300_000])
def test_marked_words(spark, rows, pieces, most_words, monkeypatch):
    monkeypatch.setattr(marked_words, "GROUP_BYTES", 3000)
    want, digests = Counter(), Counter()
    for i, text in rows:
        ids = pieces.encode(text or "")
        want[i, tuple(ids), pieces.decode(ids)] += 1
        digests[i, len(ids), sha(",".join(map(str, ids))), sha(pieces.decode(ids))] += 1
    docs = table(spark, rows).repartition(3)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in marked_words.encode_documents(docs, PIECES, most_words=most_words).collect()) == want
    assert Counter(map(tuple, marked_words.encode_digests(docs, PIECES, most_words=most_words).collect())) == digests


def test_word_table_has_each_word_of_several_groups_once(spark, rows):
    docs = table(spark, rows).repartition(3)
    found = [r.word for r in marked_words.word_table(docs, PIECES).collect()]
    assert len(found) == len(set(found)) > 100
    assert all(w.startswith(" ") and len(w.encode()) <= marked_words.WORD_BYTES for w in found)


def test_no_documents(spark):
    none = table(spark, [])
    assert marked_words.encode_digests(none, PIECES).count() == 0
    assert token_alignment.align_tokens(none, BYTES, PIECES).count() == 0
    assert phrase_mining.collocations(none.withColumn("lang", F.lit("x"))).count() == 0
    blank = table(spark, [(1, None), (2, "")])
    assert [r.n_tokens for r in marked_words.encode_digests(blank, PIECES).collect()] == [0, 0]
    assert [tuple(r)[1:] for r in token_alignment.align_tokens(blank, BYTES, PIECES).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_every_code_point_of_two_planes(pieces):
    tokenizer = marked_words.piece_tokenizer(PIECES)
    texts = [f"{chr(c)}a {chr(c)} {chr(c)}b{chr(c)}  {chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    codes, offsets, words = marked_words.marked_words(pa.array(texts))
    ids = tokenizer.encode(words.to_pylist())
    decoded = marked_words.texts_of(pa.array(tokenizer.decode(ids)), codes, offsets)
    want = pieces.encode(texts, num_threads=1)
    assert [[i for c in codes[a:b] for i in ids[c]] for a, b in zip(offsets, offsets[1:])] == want
    assert decoded.to_pylist() == pieces.decode(want, num_threads=1)


def plain_alignment(ends_a, ends_b):
    """Groups and links by looking at all pairs."""
    spans = [list(zip([0, *ends], ends)) for ends in (ends_a, ends_b)]
    links = [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if max(x[0], y[0]) < min(x[1], y[1])]
    common = sorted(set(ends_a) & set(ends_b))
    return [(0, 0)] * bool(common) + [(ends_a.index(c) + 1, ends_b.index(c) + 1) for c in common[:-1]], links


def test_diagonal_alignment():
    rng = random.Random(3)
    for _ in range(600):
        n = rng.randint(1, 60)
        keep = rng.random()
        ends_a = sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})
        ends_b = sorted({*(e for e in ends_a if rng.random() < keep), *rng.sample(range(1, n + 1), rng.randint(0, n // 3)), n})
        found = token_alignment.align(np.array(ends_a), np.array(ends_b), window=rng.choice([1, 2, 3, 8, 100]))
        groups, links = plain_alignment(ends_a, ends_b)
        assert list(zip(found.first_a.tolist(), found.first_b.tolist())) == groups
        assert list(zip(found.a.tolist(), found.b.tolist())) == links


@pytest.mark.parametrize("most_pairs", [0, 30, 1_000_000])
def test_token_alignment(spark, rows, pieces, most_pairs, monkeypatch):
    monkeypatch.setattr(token_alignment, "GROUP_BYTES", 3000)
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    pair = token_alignment.token_pair(BYTES, PIECES)
    every = []
    for i, text in rows:
        text = text or ""
        a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        sides = [b"".join(t[x] for x in ids) for ids, t in ((a, pair.a_bytes), (b, pair.b_bytes))]
        if not text or sides != [(" " + text).encode()] * 2:
            a, b = [], []
        ends = [np.cumsum([len(t[x]) for x in ids]).tolist() if ids else [] for ids, t in ((a, pair.a_bytes), (b, pair.b_bytes))]
        if len(text) > 2000:  # all pairs would be too many here; the merge is checked above
            found = token_alignment.align(*(np.array(e, np.int64) for e in ends))
            groups, links = list(zip(found.first_a.tolist(), found.first_b.tolist())), list(zip(found.a.tolist(), found.b.tolist()))
        else:
            groups, links = plain_alignment(*ends)
        every.append((i, a, b, groups, [(a[x], b[y]) for x, y in links]))
    counts = Counter(x for *_, links in every for x in links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = Counter()
    for i, a, b, groups, links in every:
        stops = [*groups[1:], (len(a), len(b))]
        text = ";".join(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:v])) for (x, y), (u, v) in zip(groups, stops))
        want[i, len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha(text) if a else ""] += 1
    assert sum(not x[1] for x in want) >= 4
    got = token_alignment.align_tokens(table(spark, rows).repartition(3), BYTES, PIECES, most_pairs=most_pairs)
    assert Counter(map(tuple, got.collect())) == want


def phrases(seed):
    rng = random.Random(seed)
    words = ["ab", "Ab", "c", "dé", "ñ x", "E", "f", "g%"]
    weights = [8, 3, 5, 4, 2, 2, 1, 1]
    out = []
    for i in range(400):
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", "  ", ". ", ",", "\n"]) for w in rng.choices(words, weights, k=rng.choice([0, 1, 2, 3, 30])))
        out.append((i // 2, text, rng.choice(["x", "x", "y", None, "und"])))
    return out + [(None, None, "x"), (500, "ab ab ab ab ab ab ab ab ab ab ab ab", "z"), (501, "once only here", "w"), (502, "one two three. " * 12, "three"), (503, "one two. " * 5, "three")]


def test_words_of_a_part_of_a_column():
    """Groups of texts are parts of a column; nulls and empty texts stand in all of them."""
    column = pa.array(["Ab c", None, "", "é. x", "LAST one", None])
    for lo in range(6):
        for n in range(7 - lo):
            found = phrase_mining.Words(column.slice(lo, n))
            want = [(i, w) for i, t in enumerate(column.slice(lo, n).to_pylist()) for w in (t or "").lower().replace(".", " ").split()]
            assert list(zip(found.text.tolist(), found.names.take(pa.array(found.code)).to_pylist())) == want
            codes, offsets, words = marked_words.marked_words(column.slice(lo, n))
            texts = ["".join(words.take(pa.array(codes[a:b])).to_pylist())[1:] for a, b in zip(offsets, offsets[1:])]
            assert texts == [t or "" for t in column.slice(lo, n).to_pylist()]


@pytest.mark.parametrize("shards", [1, 4])
def test_collocations(spark, shards, monkeypatch):
    monkeypatch.setattr(phrase_mining, "GROUP_BYTES", 500)
    rows = phrases(shards)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]))
    want = sorted(con.execute(COLLOCATIONS).fetchall())
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for name in ("n", "a", "shard", "part", "phrase", "word"):
        docs = docs.withColumn(name, F.lit("x"))
    got = phrase_mining.collocations(docs, shards=shards)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == want
    assert len(want) > 30 and any(len(r[2].split(" ")) == 3 for r in want) and "und" in {r[0] for r in want}


def test_every_frequent_phrase_is_a_candidate_whatever_the_shards(spark):
    rows = phrases(9)
    counts = Counter()
    for _, text, lang in rows:
        for piece in "".join("\n" if c in ".,;:!?\n" else c for c in (text or "").translate(str.maketrans("ABE", "abe"))).split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            counts.update((lang or "und", " ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for shards in (2, 7):
        _, found = phrase_mining.frequent_phrases(docs, shards=shards)
        assert {(r.lang, r.phrase): r.a for r in found.collect()} == {k: n for k, n in counts.items() if n >= 10}


def test_word_hashes_take_all_words_at_once(monkeypatch):
    monkeypatch.setattr(phrase_mining.xxhash, "xxh3_64_intdigest", None)  # no word up to LONG_WORD bytes goes one by one
    names = ["a", "b", "aa", "a\0", "abcdefgh", "abcdefghi", "abcdefgh\0", "é", "x" * 64, "x" * 63, ""]
    hashes = phrase_mining.word_hashes(pa.array(names))
    assert len(set(hashes.tolist())) == len(names)
    assert (phrase_mining.word_hashes(pa.array(names[::-1]))[::-1] == hashes).all()
    monkeypatch.undo()
    both = phrase_mining.word_hashes(pa.array(["y" * 65, "y" * 66, "y" * 65]))
    assert both[0] == both[2] != both[1]
