import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from helpers import components, documents, shingles, table
from paracorpus.llm import bottom_k as B
from paracorpus.llm import jaccard_join as J
from paracorpus.llm import token_records as R
from paracorpus.llm.components import connected_components
from paracorpus.llm.merge_automaton import encode_digests, encode_documents, word_tokenizer
from paracorpus.llm.shingles import shingle_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Hello,  World's end", "don't we'll I'M", "ÀÉÎ ñandú Straße ΣΊΣΥΦΟΣ ΟΔΟΣ.", "a\u00a0b\u2003c\u3000d\x85e\x1cf", "x<|endoftext|>y <|startoftext|>",
    "<|endoftext|", "e\u0301te\u0301 \u0301x", "日本語 テスト 123 ４５６ ½", "🙂🙃 👩‍👩‍👧", "...!!! ?!. a.b,c", "ǅ İstanbul ﬁ Å", "a" * 300, "ab" * 200, "\r\n\v\f x \t", "", " ",
]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_padding()
    found.no_truncation()
    return found


def test_automaton_equals_the_library(library):
    rng = random.Random(1)
    texts = list(ODD)
    for _ in range(1500):
        letters = rng.choice(["abcdefghijklmnopqrstuvwxyz", "etaoinshr", "ABab'. ,s", "éñßøč", "0123456789.", "aaab", "日本語中文"])
        texts.append("".join(rng.choices(letters + " ", k=rng.randint(1, 40))))
    ours = word_tokenizer(PATH)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ours.encode_chunk(text) == want, repr(text)
        assert ours.decode(want) == library.decode(want, skip_special_tokens=False)


def test_ids_of_every_code_point_beside_signs(library):
    """Both encoders give the library's ids where its tables, or what normalisation does, decide what a letter is."""
    ours, records = word_tokenizer(PATH), R.chunk_encoder(PATH)
    points = [c for c in range(0x3400) if not chr(c).isspace()] + [*range(0xA640, 0xAC00), *range(0xFA00, 0xFC00), *range(0x10400, 0x10600), *range(0x1E900, 0x1EA00)]
    for pattern in ("{}.", "?{}a"):
        chunks = [pattern.format(chr(c)) for c in points]
        want = [e.ids for e in library.encode_batch(chunks, add_special_tokens=False)]
        split = [c for c in zip(chunks, want) if len(c[0].split()) == 1]
        assert [(c, ours.encode_chunk(c)) for c, _ in split] == split
        assert [(c, np.frombuffer(x, "<u2").tolist()) for (c, _), x in zip(split, records([c for c, _ in split]))] == split
    for text in ("ABC\u0130.", "\u0958!", "\ufb2a?", "\u0558.", "x\u208f;"):
        assert ours.encode_chunk(text) == library.encode(text, add_special_tokens=False).ids == np.frombuffer(records([text])[0], "<u2").tolist()


def test_encode_documents(spark, library):
    rows = documents() + list(enumerate(ODD, 5000))
    want = Counter()
    digests = Counter()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, tuple(ids)] += 1
        decoded = library.decode(ids, skip_special_tokens=False)
        digests[i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))] += 1
    docs = table(spark, rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encode_documents(docs, PATH).collect()) == want
    assert Counter(map(tuple, encode_digests(docs, PATH).collect())) == digests
    assert encode_digests(table(spark, []), PATH).count() == 0


@pytest.mark.parametrize("rows", [documents() + list(enumerate(ODD, 5000)), [], [(None, None)]])
def test_token_records_round_trip(spark, library, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(R, "SHARD_CHARS", 9000)
    path = f"file://{tmp_path}/records"
    R.write_token_records(table(spark, rows), path, PATH, 1)
    found = R.describe_token_records(spark, path).collect()
    want, at = Counter(), 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want[i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
        at += len(ids)
    assert Counter(map(tuple, found)) == want
    index = spark.read.parquet(f"{path}/index").collect()
    assert len(index) == len(rows)
    for r in index[:20]:
        content = (tmp_path / "records/records" / r.file).read_bytes()
        _, payload = next(R.frames(content, r.offset))
        assert len(payload) == r.length and R.deserialize(payload)[0] == r.doc_id
    orders = [[(r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in R.read_shuffled(spark, path, seed).collect()] for seed in (0, 0, 1)]
    assert orders[0] == orders[1] and (len(rows) < 9 or orders[0] != orders[2])
    assert Counter(orders[0]) == Counter(orders[2]) == Counter((i, n, crc) for i, _, n, crc in want.elements())


def test_broken_frames_are_found():
    good = R.frame(b"payload") + R.END
    assert [p for _, p in R.frames(good * 2)] == [b"payload"] * 2
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            list(R.frames(bytes(bad)))


def test_sketches_merge_and_estimate():
    words = [f"w{i}" for i in range(4000)]
    whole = shingle_hashes(" ".join(words))
    a, b = whole[::2], whole[1::2]
    assert (B.merge(B.sketch(a), B.sketch(b)) == B.sketch(whole)).all()
    assert B.distinct(B.sketch(whole)) == pytest.approx(len(whole), rel=0.2)
    assert B.resemblance(B.sketch(a), B.sketch(whole)) == pytest.approx(0.5, abs=0.12)
    assert B.containment(B.sketch(a), B.sketch(whole)) == pytest.approx(1, abs=0.2)
    none = np.array([], np.uint64)
    assert B.resemblance(none, none) == 1 and B.resemblance(none, B.sketch(a)) == 0
    assert (B.from_text(B.to_text(B.sketch(a))) == B.sketch(a)).all()


@pytest.mark.parametrize("chars", [8_000_000, 3000])
def test_fingerprints_of_edited_texts(spark, monkeypatch, chars):
    monkeypatch.setattr(B, "RANGE_CHARS", chars)
    rows = documents()
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**9)), r[1] or ""))
    want = Counter()
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[i, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    found = B.fingerprint_edits(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == want
    text_of = {i: t or "" for i, t in rows}
    for r in found:
        if r.doc_id is not None:
            mine = shingle_hashes(text_of[r.doc_id])
            assert r.fingerprint == B.to_text(B.sketch(mine))


def test_fingerprints_of_one_and_none(spark):
    assert B.fingerprint_edits(table(spark, [])).count() == 0
    (r,) = B.fingerprint_edits(table(spark, [(7, "abcd")])).collect()
    assert (r.n_chars, r.near_next) == (4, 1.0) and r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def plain_components(rows, percent=80):
    found = [(n, shingles(t)) for n, (_, t) in enumerate(rows)]
    pairs = [(a, b) for a, x in found for b, y in found if a < b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    root = components(pairs, range(len(rows)))
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root[n]] = min(least.get(root[n], i), i)
    return Counter((i, len(found[n][1]), least.get(root[n]) if found[n][1] else i) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed,rest", [(0, 100_000), (1, 0), (2, 0)])
def test_jaccard_components(spark, monkeypatch, seed, rest):
    """With rest = 0 every rest is dealt again, so the recursion is followed to its end."""
    monkeypatch.setattr(J, "REST_ITEMS", rest)
    rows = documents(seed)
    found = J.jaccard_components(table(spark, rows))
    assert Counter(map(tuple, found.collect())) == plain_components(rows)


@pytest.mark.parametrize("rest", [100_000, 0])
def test_jaccard_of_a_drifting_family(spark, monkeypatch, rest):
    """Each text differs a little from the one before: links form chains, most pairs are no links."""
    monkeypatch.setattr(J, "REST_ITEMS", rest)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    text, rows = rng.choices(words, k=120), []
    for i in range(60):
        rows.append((i, " ".join(text)))
        for _ in range(rng.choice([1, 1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice(words)
    rng.shuffle(rows)
    assert Counter(map(tuple, J.jaccard_components(table(spark, rows)).collect())) == plain_components(rows)


def test_large_rest_is_cut_into_blocks(spark, monkeypatch):
    """Variants of a text are alike in most of it and hardly ever linked: no new neighbourhood would part them."""
    monkeypatch.setattr(J, "REST_ITEMS", 1500)

    def again(*_):
        raise AssertionError("a rest of a few blocks was dealt again")

    monkeypatch.setattr(J, "redeal", again)
    rng = random.Random(3)
    text = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        varied = list(text)
        for place in rng.sample(range(120), rng.choice([1, 4, 6, 8])):
            varied[place] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(varied)))
    assert Counter(map(tuple, J.jaccard_components(table(spark, rows)).collect())) == plain_components(rows)


def test_common_shingles_of_a_group():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90))) for _ in range(80)] + [np.arange(1000, 1100)]
    counts = J._Common(np.concatenate(sets), np.array([len(x) for x in sets])).counts(np.arange(len(sets)))
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    assert (counts == want)[~np.eye(len(sets), dtype=bool)].all()


def test_jaccard_of_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text + " x"), (None, text + " y"), (7, text), (None, "other words than these are here now")]
    assert Counter(map(tuple, J.jaccard_components(table(spark, rows)).collect())) == plain_components(rows)


def test_jaccard_of_nothing(spark):
    assert J.jaccard_components(table(spark, [])).count() == 0
    assert [tuple(r) for r in J.jaccard_components(table(spark, [(3, None)])).collect()] == [(3, 0, 3)]


def test_linked_sets_share_a_neighbourhood():
    rng = np.random.default_rng(0)
    for n in [*range(1, 70), 128, 200, 511, 512, 1000]:
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(4):
            drop = rng.integers(0, n // 5 + 1)
            add = rng.integers(0, n // 4 + 1)
            other = np.unique(np.concatenate((rng.permutation(base)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
            common = len(np.intersect1d(base, other))
            if 100 * common >= 80 * (len(base) + len(other) - common):
                assert set(J.part_keys(base, 0)) & set(J.part_keys(other, 0)), (n, drop, add)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 400 + i) for i in range(50)]
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == components([p for p in pairs if p[0] != p[1]], nodes)
