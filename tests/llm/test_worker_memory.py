"""What a worker holds between groups and between tasks."""

import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from paracorpus.llm import merge_automaton, token_alignment, token_records
from paracorpus.llm.chunks import SIGNS, split_signs

WORDS, PIECES, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))


class Taken:
    """A table that hands out the function of its tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def withColumnRenamed(self, old, new):
        return self


def batches():
    yield pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["one two", "three, four", "five six seven"])], ["id", "text"])


def test_a_group_is_gone_before_the_next_begins(spark, monkeypatch):
    held, before = [], []

    class Watched(token_alignment.AlignedTexts):
        def __init__(self, *args):
            before.append([x() for x in held if x() is not None])
            super().__init__(*args)
            held.append(weakref.ref(self))

    monkeypatch.setattr(token_alignment, "AlignedTexts", Watched)
    monkeypatch.setattr(token_alignment, "GROUP_BYTES", 1)
    docs = Taken()
    token_alignment.aligned_groups(docs, BYTES, PIECES)
    assert len(list(docs.run(batches()))) == 3
    assert before == [[], [], []]


def test_words_that_differ_in_case_or_sign_are_one_part():
    chunks = ["Word", "word,", "WORD.", "word..", "É.", "É", "a1.", ".", "", "<|endoftext|>", "it's", "é!", "x"]
    tokenizer = merge_automaton.word_tokenizer(WORDS)
    parts, part, sign = split_signs(pa.array(chunks), tokenizer.letters)
    assert len(set(part[:3].tolist())) == 1 and parts[part[0]] == "word"
    assert [SIGNS[s] if s >= 0 else "" for s in sign] == ["", ",", ".", "", ".", "", "", "", "", "", "", "!", ""]
    library, records = Tokenizer.from_file(WORDS), token_records.chunk_encoder(WORDS)
    want = [library.encode(c, add_special_tokens=False).ids for c in chunks]
    assert [np.frombuffer(x, "<u2").tolist() for x in records(chunks)] == want
    split = [tokenizer.describe(parts[p]) for p in part.tolist()]
    signs = [tokenizer.describe(SIGNS[s]) if s >= 0 else (0, "", "") for s in sign.tolist()]
    assert [" ".join(filter(None, (a[1], b[1]))) for a, b in zip(split, signs)] == [" ".join(map(str, x)) for x in want]


def test_words_are_encoded_many_by_a_call_without_marks(monkeypatch):
    encoder = token_records.ChunkEncoder(WORDS)
    monkeypatch.setattr(encoder, "mark", None)  # all that is not letters would go one by one
    asked = []

    class Watched:
        def __getattr__(self, name):
            return lambda texts, **more: asked.append(texts) or getattr(library, name)(texts, **more)

    library, encoder.tokenizer = encoder.tokenizer, Watched()
    words = ["alpha", "Beta", "gämma", "ДЕЛЬТА"]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.library(words)] == want
    assert asked[0] == ["alpha Beta gämma ДЕЛЬТА"] and not any(asked[1:])


def test_a_walk_follows_long_tokens_first(monkeypatch):
    tokenizer = merge_automaton.WordTokenizer(WORDS)
    automaton, asked = tokenizer.automaton, []
    arc = automaton.arc
    monkeypatch.setattr(automaton, "arc", lambda state, token: asked.append(token) or arc(state, token))
    library = Tokenizer.from_file(WORDS)
    for word in ("the", "unbelievablynormalisation", "xqzjvkwp", "aaaaaaaaaaaaaaaa"):
        assert automaton.encode(word) == library.encode(word, add_special_tokens=False).ids
    assert len(asked) <= 80  # 163 when every place of these words was gone on from


def test_groups_of_aligned_texts_are_written_compressed():
    text = "the same few words again and again, " * 2000
    docs = Taken()
    token_alignment.aligned_groups(docs, BYTES, PIECES)
    (row,) = docs.run(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])]))
    back = token_alignment._stretched(row, 0)
    assert len(back.codes) == 14_000 and back.offsets.tolist() == [0, 14_000]
    assert row.column("codes").nbytes < 4 * 14_000 / 10  # four bytes a stretch before
