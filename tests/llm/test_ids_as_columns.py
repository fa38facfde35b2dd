"""What a worker of the token records remembers, and how it asks about words beyond ASCII."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from paracorpus.llm import common, jaccard_join, merge_automaton, token_records, toxicity
from paracorpus.llm.chunks import IdMemory, signs_apart
from paracorpus.llm.merge_automaton import all_letters, only_letters, plain

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_remembered_parts_are_columns_and_make_room():
    asked = []

    def encode(parts):
        asked.append(parts.to_pylist())
        # Backwards, so that places are not those of the parts.
        sizes = np.array([len(p) for p in asked[-1]], np.int64)
        stops = np.cumsum(sizes[::-1])[::-1]
        return stops - sizes, sizes, np.array([ord(c) for p in asked[-1][::-1] for c in p], np.uint16)

    memory = IdMemory(encode, most=4)

    def of(*parts):
        starts, sizes, ids = memory.of(pa.array(parts, pa.large_string()))
        return ["".join(map(chr, ids[a : a + n])) for a, n in zip(starts, sizes)]

    for parts in (["ab", "c"], ["c", "", "def"], [], ["g", "c", "hi"], ["ab", "hi", "c"], ["c"]):
        assert of(*parts) == parts
    # The fourth call makes room: what it had not itself is asked about again.
    assert asked == [["ab", "c"], ["", "def"], ["g", "hi"], ["ab"]]
    assert isinstance(token_records.chunk_encoder(WORDS).cores, IdMemory)


def test_words_beyond_ascii_are_normalised_by_few_calls():
    texts = ["É", "é", "́", "a|é", "\xa0é", "é\xa0", "ДЕЛЬТА", "é1", ";", "日本", "İ", "|é", "é"] * 300
    is_word, one = only_letters(WORDS), plain(WORDS)
    assert all_letters(WORDS)(texts) == [is_word(one(t)) for t in texts]


def test_parts_are_distinct_whatever_the_sign_behind_wide_words():
    chunks = pa.array(["ción", "ción.", "ción,", "ción!!", "ción"])
    parts, part, sign = signs_apart(chunks, all_letters(WORDS))
    assert parts.to_pylist() == ["ción", "ción!!"] and part.tolist() == [0, 0, 0, 1, 0] and sign.tolist() == [-1, 0, 1, -1, -1]


def test_ids_are_the_librarys_whatever_way_they_are_asked_for():
    texts = ["Word, word. <b> <|endoftext|>, x<|startoftext|> ción. CIÓN; 'tis İ. á! \xa0é. 日本語? !? ... 1,2", "", None, " \n", "ción word"]
    library, encoder = Tokenizer.from_file(WORDS), token_records.ChunkEncoder(WORDS)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        found = token_records.encode_texts(pa.array(texts), encoder)
        assert [np.frombuffer(x, "<u2").tolist() for x in found] == want


def test_descriptions_are_columns_and_make_room():
    asked = []
    memory = merge_automaton.Descriptions(lambda p: asked.append(p) or (len(p), p.upper(), f"<{p}>"), most=4)
    for parts in (["ab", "c"], ["c", "", "def"], [], ["g", "c", "hi"], ["ab", "hi", "c"], ["c"]):
        found = memory.of(pa.array(parts, pa.large_string()))
        assert found.to_pydict() == {"part": parts, "size": [*map(len, parts)], "ids": [p.upper() for p in parts], "labels": [f"<{p}>" for p in parts]}
    assert asked == ["ab", "c", "", "def", "g", "hi", "ab"]


def test_a_tokenizer_remembers_few_inner_words(monkeypatch):
    monkeypatch.setattr(merge_automaton, "INNER_WORDS", 10)
    tokenizer, library = merge_automaton.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    words = [f"{a}é{b}" for a in "abcdefgh" for b in "stuvwxyz"] * 2
    assert [tokenizer.encode_chunk(w) for w in words] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert len(tokenizer.known) + len(tokenizer.old) <= 22


def test_a_task_gives_back_what_it_took(monkeypatch):
    done = []

    class Pool:
        def release_unused(self):
            done.append("given back")

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    out = common.giving_back(lambda batches: (2 * x for x in batches))(iter([1, 2]))
    assert [next(out), next(out), *done] == [2, 4]
    assert list(out) == [] and done == ["given back"]


def test_tasks_of_the_pipeline_give_back(spark):
    given = []

    class Taken:
        def __getattr__(self, name):
            return lambda *args, **more: (given.append(args[0].__qualname__) if name == "mapInArrow" else None) or self

    merge_automaton.encode_digests(Taken(), WORDS)
    toxicity.count_pairs(Taken())
    jaccard_join.deal(Taken(), 80, 5)
    assert given == ["giving_back.<locals>.task"] * 3
