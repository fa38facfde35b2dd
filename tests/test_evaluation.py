import random
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import plain
from paracorpus.operators import evaluation as E
from paracorpus.operators import edit_distance as ED
from paracorpus.operators import pair_statistics as PS
from paracorpus.operators.edit_distance import edit_distances

WORDS = "the a sun moon river über naïve speaks — don't 3,000 x".split()


def noisy_pairs(n=60, seed=3, length=25):
    rnd = random.Random(seed)
    pairs = []
    for _ in range(n):
        ref = [rnd.choice(WORDS) for _ in range(rnd.randint(1, length))]
        hyp = [rnd.choice(WORDS) if rnd.random() < 0.2 else w for w in ref if rnd.random() > 0.1]
        pairs.append((" ".join(hyp), " ".join(ref)))
    return pairs + [("", "only a reference"), ("words without", "…!"), ("extra", "EXTRA!")]


def frame(spark, pairs):
    return spark.createDataFrame(
        [(str(i), r, h) for i, (h, r) in enumerate(pairs)], "id string, reference string, hypothesis string"
    )


@given(st.lists(st.tuples(st.text("abc", max_size=40), st.text("abc", max_size=40)), max_size=30))
@settings(max_examples=150, deadline=None)
def test_edit_distances_equal_dynamic_programming(pairs):
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    assert edit_distances(left, right) == [plain.edits(a, b) for a, b in pairs]
    lists = [p.split("a") for p in left], [p.split("a") for p in right]
    assert edit_distances(*lists) == [plain.edits(a, b) for a, b in zip(*lists)]


@given(
    st.lists(st.tuples(st.text("ab", max_size=60), st.text("ab", max_size=60)), max_size=10),
    st.sampled_from([8, 16, 256]),
)
@settings(max_examples=100, deadline=None)
def test_band_equals_dynamic_programming(pairs, tile):
    was = ED.LONG, ED.TILE
    try:
        ED.LONG, ED.TILE = 1, tile
        got = edit_distances([p[0] for p in pairs], [p[1] for p in pairs])
    finally:
        ED.LONG, ED.TILE = was
    assert got == [plain.edits(a, b) for a, b in pairs]


def test_edit_distances_of_long_texts():
    rnd = random.Random(5)
    long = ["".join(rnd.choice("abcdefg h") for _ in range(n)) for n in (1500, 900, 3300)]
    cut = ["".join(c if rnd.random() > 0.05 else "z" for c in t if rnd.random() > 0.05) for t in long]
    odd = list(reversed(long))
    assert edit_distances(long, cut) == [plain.edits(a, b) for a, b in zip(long, cut)]
    assert edit_distances(long, odd) == [plain.edits(a, b) for a, b in zip(long, odd)]


@pytest.mark.parametrize("mode", ["normalized", "raw"])
def test_corpus_metrics_equal_plain_python(spark, mode):
    pairs = noisy_pairs()
    df = frame(spark, pairs)
    shape = plain.normalize if mode == "normalized" else lambda t: " ".join(t.split())
    shaped = [(shape(h), shape(r)) for h, r in pairs]
    assert E.corpus_wer(df, mode).first()["wer"] == pytest.approx(plain.wer(shaped))
    assert E.corpus_cer(df, mode).first()["cer"] == pytest.approx(plain.cer(shaped))
    assert E.corpus_chrf(df, mode).first()["chrf"] == pytest.approx(plain.chrf(shaped))
    assert E.word_overlap(df, mode).first()["word_overlap"] == pytest.approx(plain.overlap(shaped))
    if mode == "normalized":
        assert E.corpus_bleu(df).first()["bleu"] == pytest.approx(plain.bleu(shaped))


def test_raw_bleu_uses_the_tokeniser(spark):
    df = frame(spark, [("Hello , world !", "Hello, world!")])
    assert E.corpus_bleu(df, "raw").first()["bleu"] == pytest.approx(100.0)


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        E.corpus_wer(frame(spark, []), "shouted")


def test_small_slices_give_the_same_sums(spark, monkeypatch):
    df = frame(spark, noisy_pairs())
    whole = E.evaluate(df).first()
    monkeypatch.setattr(PS, "SLICE_CHARS", 50)
    assert E.evaluate(df.repartition(3)).first() == whole


def test_native_ngram_twin(spark):
    """The same clipped counts by exploding positions, entirely in the JVM."""
    df = frame(spark, noisy_pairs())
    df.createOrReplaceTempView("raw_pairs")
    E.prepared(df).createOrReplaceTempView("twin")
    native = spark.sql("""
      with g as (
        select id, n, side, array_join(slice(w, i, n), ' ') as gram from (
          select id, n, side, w, explode(sequence(1, size(w) - n + 1)) as i from (
            select id, n, side, split(t, ' ') as w from (
              select id, 'h' as side, hyp as t from twin union all select id, 'r', ref from twin)
            lateral view explode(array(1, 2, 3, 4)) o as n where t <> '')
          where size(w) >= n)),
      c as (select id, n, gram, count_if(side = 'h') as h, count_if(side = 'r') as r from g group by id, n, gram)
      select n, sum(least(h, r)) as hits, sum(h) as hyp, sum(r) as ref from c group by n""")
    arrow = PS.pair_statistics(df, parts=("ngrams",)).where("kind = 'bleu'").groupBy("n").sum("hits", "hyp", "ref")
    assert {tuple(r) for r in native.collect()} == {tuple(r) for r in arrow.collect()}


def test_perfect_predictions(spark):
    row = E.evaluate(frame(spark, [(f"sentence number {i} is here", f"Sentence number {i} is here.") for i in range(9)])).first()
    assert (row.bleu, row.chrf, row.wer_pct, row.cer_pct, row.word_overlap_pct) == (100.0, 100.0, 0.0, 0.0, 100.0)
    assert row.quality == "Excellent" and row.word_accuracy_pct == 100.0 and row.total_samples == 9


def test_empty_and_unrelated(spark):
    row = E.evaluate(frame(spark, [("", "some words")])).first()
    assert (row.bleu, row.chrf, row.wer_pct, row.word_overlap_pct, row.quality) == (0.0, 0.0, 100.0, 0.0, "Poor")
    nothing = E.evaluate(frame(spark, []).limit(0)).first()
    assert nothing.total_samples == 0 and nothing.bleu == 0.0 and nothing.wer_pct is None
    assert E.word_accuracy(frame(spark, [("a b c d", "x")])).first()[0] == -3.0


def test_sample_scores(spark):
    df = frame(spark, [("", "two words"), ("anything", "…!"), ("The cat", "the cat sat")])
    rows = {r.id: r for r in E.sample_scores(df).collect()}
    assert rows["0"].wer_pct == 100.0 and rows["0"].cer_pct == 100.0
    # an ellipsis is no ASCII punctuation and stays; a reference of ASCII signs only is empty
    assert rows["1"].reference_normalized == "…"
    assert rows["2"].wer_pct == 33.33
    empty = E.sample_scores(frame(spark, [("x", "!?")])).first()
    assert empty.wer_pct is None and empty.cer_pct is None


def test_routing_and_counts(spark):
    df = spark.createDataFrame(
        [("1", "ref", "hyp", None), ("2", "ref", None, "ValueError"), ("3", "", "hyp", None), ("4", None, None, "x")],
        "id string, reference string, hypothesis string, error string",
    )
    ok, failed = E.split_failed(df)
    assert [r.id for r in ok.collect()] == ["1"] and [r.id for r in failed.collect()] == ["2"]
    assert tuple(E.run_counts(df).first()) == (1, 1, 2)
    assert [r.id for r in E.valid_pairs(df).collect()] == ["1"]


def test_length_stats(spark):
    row = E.length_stats(frame(spark, [("a b", "a b c d"), ("a", "a b")])).first()
    assert tuple(row) == (1.5, 3.0, 0.5)
    assert E.length_stats(frame(spark, []).limit(0)).first().length_ratio is None


@pytest.mark.parametrize("parts", [("ngrams",), ("chars",), ("word_edit", "char_edit")])
def test_memory_of_a_batch_is_that_of_a_piece(parts):
    """All words of an Arrow batch were Python strings at once, whatever was asked."""
    texts = [" ".join(f"{(i * j) % 997}" for j in range(400)) for i in range(2000)]
    column = pa.array(texts)
    batch = pa.RecordBatch.from_arrays([column] * 4, ["hyp", "ref", "hyp_tokens", "ref_tokens"])
    del texts
    tracemalloc.start()
    rows = list(PS._rows(batch, parts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r[2] for r in rows if r[0] == "rows") == 2000
    assert peak < 60_000_000


def test_a_worker_gives_back_what_a_batch_took(monkeypatch):
    given, pool = [], PS.pa.default_memory_pool()
    monkeypatch.setattr(PS.pa, "default_memory_pool", lambda: given.append(pool.bytes_allocated()) or pool)
    batch = lambda: PS.pa.RecordBatch.from_pydict({"hyp": ["a b", "c"], "ref": ["a b", "d"]})
    assert [b.num_rows for b in PS._counter(("chars", "char_edit"))(batch() for _ in range(3))] == [10, 10, 10]
    assert len(given) == 3
