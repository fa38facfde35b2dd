import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from paracorpus import sinks
from paracorpus.functions import sequences as S
from paracorpus.operators import batching, codebook, embeddings, positions, prediction, splitting
from paracorpus.operators import evaluation as E
from paracorpus.operators import unit_streams as U
from paracorpus.operators import vocabulary as V


def test_positions(spark):
    values = random.Random(1).sample(range(10_000), 3000)
    df = spark.createDataFrame([(v, v % 3) for v in values], "id int, g int").repartition(7)
    rows = positions.with_position(df, "g", F.desc("id")).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(3000))
    assert [(r.g, r.id) for r in rows] == sorted([(v % 3, v) for v in values], key=lambda x: (x[0], -x[1]))
    assert positions.nth_item(df, "id", 2).first().id == sorted(values)[2]
    assert positions.nth_item(df, "id", 3000).count() == 0
    with pytest.raises(ValueError):
        positions.nth_item(df, "id", -1)
    first = positions.first_n(df, "g", "id", 2)
    assert {(r.g, r.place) for r in first.collect()} == {(g, p) for g in range(3) for p in (1, 2)}
    assert [r.id for r in positions.head_n(df, "id", 3).collect()] == sorted(values)[:3]


@pytest.mark.parametrize("n, fraction", [(0, 0.1), (1, 0.1), (9, 0.1), (10, 0.1), (997, 0.1), (997, 0.8), (50, 1.0), (50, 0.0)])
def test_split_sizes(spark, n, fraction):
    df = spark.range(n).select(F.col("id").cast("string"))
    split = {r.id: r.split for r in splitting.split_exact(df, fraction).collect()}
    assert len(split) == n
    assert sum(s == "validation" for s in split.values()) == int(np.floor(fraction * n))


def test_split_is_reproducible(spark):
    df = spark.range(500).select(F.col("id").cast("string"))
    one, other, seeded = (
        {r.id for r in splitting.split_exact(d, 0.1, seed).where("split = 'validation'").collect()}
        for d, seed in ((df, 42), (df.repartition(9), 42), (df, 7))
    )
    assert one == other and one != seeded


@pytest.mark.parametrize("count", [1, 16, 37])
def test_batches(spark, count):
    rnd = random.Random(count)
    data = {}
    for i in range(count):
        labels = [rnd.randint(2, 9) for _ in range(rnd.randint(0, 12))]
        data[i] = [1] + labels if i // 5 % 2 == 0 else labels
    df = spark.createDataFrame(list(data.items()), "id int, labels array<int>").repartition(3)
    rows = {r.id: (r.batch, r.labels) for r in batching.pad_labels(df, 5, 1).collect()}
    for start in range(0, count, 5):
        ids = range(start, min(start + 5, count))
        widest = max(len(data[i]) for i in ids)
        drop = all(data[i][:1] == [1] for i in ids)
        for i in ids:
            want = (data[i] + [-100] * (widest - len(data[i])))[1 if drop else 0 :]
            assert rows[i] == (start // 5, want)


def test_labels(spark):
    texts = ["the sun the moon", "", "a the sun", "unseen words only here"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    vocab = V.fit_vocab(df.where("id < 3"))
    ids = {r.word: (r["count"], r.word_id) for r in vocab.collect()}
    assert ids == {"the": (3, 1), "sun": (2, 2), "a": (1, 3), "moon": (1, 4)}
    want = {0: [1, 2, 1, 4], 1: [], 2: [3, 1, 2], 3: [0, 0, 0, 0]}
    want[0] = [1, 2, 1, 4]
    for frequent in (V.FREQUENT, 2, 0):
        got = {r.id: r.labels for r in V.encode_labels(df, vocab, frequent=frequent).collect()}
        assert got == want, frequent


@pytest.mark.parametrize("frequent", [V.FREQUENT, 1, 0])
def test_labels_of_rows_that_share_an_id(spark, frequent):
    df = spark.createDataFrame([(1, "a b"), (1, "b a b"), (1, "a b"), (None, "c"), (None, None)], "id int, text string")
    vocab = spark.createDataFrame([("b", 1), ("a", 2), ("c" * 100, 3), ("c", 4)], "word string, word_id int")
    got = sorted((r.id or 0, r.labels) for r in V.encode_labels(df, vocab, frequent=frequent).collect())
    assert got == [(0, []), (0, [4]), (1, [1, 2, 1]), (1, [2, 1]), (1, [2, 1])]


def test_labels_of_a_long_row_take_time_in_proportion(spark):
    """Every place of a row was looked up in a list as long as the row: 200,000 words took minutes."""
    n = 200_000
    df = spark.range(1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i)), " ").alias("text"))
    vocab = spark.range(1, n + 1).where("id % 7 > 0").select(F.concat(F.lit("w"), "id").alias("word"), F.col("id").cast("int").alias("word_id"))
    started = time.perf_counter()
    (row,) = V.encode_labels(df, vocab, frequent=100).collect()
    assert time.perf_counter() - started < 40
    assert row.labels == [i if i % 7 else 0 for i in range(1, n + 1)]


def streams():
    rnd = random.Random(4)
    data = {k: [rnd.randrange(3) for _ in range(n)] for k, n in enumerate([1, 2, 50, 400])}
    data[9] = [5] * 120  # one run over many chunks
    data[10] = [1, 2] * 30
    return data


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_unit_runs(spark, chunk):
    data = streams()
    rows = [(k, at, u) for k, units in data.items() for at, u in enumerate(units)]
    df = spark.createDataFrame(rows, "utt int, at int, u int").repartition(5)
    found = {}
    for r in U.unit_runs(df, "utt", ["at"], "u", F.floor(F.col("at") / chunk)).orderBy("utt", "run").collect():
        found.setdefault(r.utt, []).append((r.run, r.unit, r.duration))
    assert found == {k: [(i, u, n) for i, (u, n) in enumerate(plain.runs(v), 1)] for k, v in data.items()}


def test_dedupe_units(spark):
    data = {**streams(), 20: []}
    df = spark.createDataFrame(list(data.items()), "id int, units array<int>")
    deduped = U.dedupe_units(df)
    for r in deduped.collect():
        assert list(zip(r.units, r.durations)) == plain.runs(data[r.id])
    back = deduped.select("id", S.expand_runs("units", "durations").alias("units"))
    assert {r.id: r.units for r in back.collect()} == data


def test_sequence_helpers(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([],)], "u array<int>")
    assert [r[0] for r in df.select(S.prefix("u", 2)).collect()] == [[3, 1], []]
    assert [r[0] for r in df.select(S.sorted_desc("u")).collect()] == [[3, 2, 1], []]
    assert tuple(U.unit_stats(df, "u").first()) == (2, 1.5)
    clips = spark.createDataFrame([(16000, 2), (48000, 4)], "n int, w int")
    assert tuple(U.corpus_stats(clips, "n", "w").first()) == (1.0, 3.0, 2.0, 2, 4, 3.0)


@pytest.mark.parametrize("piece", [8192, 3])
def test_assign_units(spark, piece, monkeypatch):
    rnd = np.random.default_rng(1)
    points, centres = rnd.normal(size=(300, 8)), rnd.normal(size=(10, 8))
    centres[7] = centres[2]  # a tie goes to the smaller unit
    frames = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, vec array<double>")
    book = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "unit int, vec array<double>")
    monkeypatch.setattr(codebook, "PIECE", piece)
    distance = ((points[:, None] - centres) ** 2).sum(2)
    for r in codebook.assign_units(frames, book).collect():
        assert r.unit == distance[r.id].argmin() and r.unit != 7
        assert r.distance == pytest.approx(distance[r.id].min())


def test_assign_units_of_odd_vectors(spark):
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0])], "unit int, vec array<double>")
    frames = spark.createDataFrame([(1, [1.0, 0.9]), (2, None), (3, [0.1, 0.0])], "id int, vec array<double>")
    rows = {r.id: (r.unit, r.distance) for r in codebook.assign_units(frames, book).collect()}
    assert rows[2] == (None, None) and rows[1][0] == 1 and rows[3] == (0, pytest.approx(0.01))
    for odd in ([], [0.0, 1.0, 3.0, 4.0]):
        ragged = spark.createDataFrame([(2, odd)], "id int, vec array<double>")
        with pytest.raises(Exception, match=f"a vector has {len(odd)} numbers"):
            codebook.assign_units(ragged, book).collect()
    with pytest.raises(ValueError, match="empty"):
        codebook.assign_units(frames, book.where("false"))


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_large_codebooks_stay_in_the_cluster(spark, monkeypatch, spread):
    """Cells, parts of cells and groups of frames give what one piece gives: clusters and noise, ties, copies, nulls."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(12, 3))
    vectors = np.round(np.concatenate([c + rnd.normal(0, spread, size=(25, 3)) for c in centres]), 2)
    vectors[50:80] = vectors[50]  # copies: a cell larger than a part, the smallest unit wins
    book = spark.createDataFrame([(int(u), v.tolist()) for u, v in zip(rnd.permutation(300) - 20, vectors)], "unit int, vec array<double>")
    points = [np.round(centres[i % 12] + rnd.normal(0, spread, size=3), 2) for i in range(400)] + [vectors[60]] * 30
    frames = spark.createDataFrame([(i // 2, p.tolist()) for i, p in enumerate(points)] + [(1000, None)], "id int, vec array<double>")
    want = sorted(map(tuple, codebook.assign_units(frames, book).select("id", "unit", F.round("distance", 9)).collect()), key=str)
    monkeypatch.setattr(codebook, "MOST_BYTES", 3 * 8 * 17)
    monkeypatch.setattr(codebook, "PIECE", 10)
    monkeypatch.setattr(codebook, "FRAMES_AT_ONCE", 13)
    found = codebook.assign_units(frames, book)
    assert found.columns == ["id", "vec", "unit", "distance"]
    assert sorted(map(tuple, found.select("id", "unit", F.round("distance", 9)).collect()), key=str) == want
    with pytest.raises(Exception, match="a vector has 2 numbers"):
        codebook.assign_units(spark.createDataFrame([(1, [1.0, 2.0])], "id int, vec array<double>"), book).collect()


def test_fit_codebook(spark):
    rnd = np.random.default_rng(2)
    points = np.concatenate([rnd.normal(c, 0.05, size=(50, 2)) for c in (0, 5, 10)])
    frames = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, vec array<double>")
    book = codebook.fit_codebook(frames, k=3)
    assert sorted(round(r.vec[0]) for r in book.collect()) == [0, 5, 10]
    sizes = codebook.assign_units(frames, book).groupBy("unit").count().collect()
    assert sorted(r["count"] for r in sizes) == [50, 50, 50]


def test_embedding_score(spark):
    def unit(*v):
        return [float(x) for x in v]

    rows = [
        ("same", [unit(1, 0), unit(0, 1)], [unit(0, 2), unit(3, 0)]),
        ("half", [unit(1, 0), unit(0, 1)], [unit(1, 0)]),
        ("none", [], [unit(1, 0)]),
        ("both", [], []),
    ]
    df = spark.createDataFrame(rows, "id string, hyp_vecs array<array<double>>, ref_vecs array<array<double>>")
    got = {r.id: (r.precision, r.recall, r.f1) for r in embeddings.embedding_score(df).collect()}
    assert got["same"] == pytest.approx((1, 1, 1)) and got["half"] == pytest.approx((0.5, 1, 2 / 3))
    assert got["none"] == got["both"] == (0.0, 0.0, 0.0)
    scores = embeddings.embedding_score(df)
    assert embeddings.mean_embedding_f1(scores).first()[0] == pytest.approx((1 + 2 / 3) / 4)
    assert embeddings.mean_embedding_f1(scores.limit(0)).first()[0] == 0.0


def test_batch_predict(spark):
    def make():
        def predict(value):
            if value == "bad":
                raise KeyError("no model for this")
            return f"  {value}!  "

        return predict

    df = spark.createDataFrame([(1, "a", "r"), (2, "bad", "r"), (3, "c", ""), (4, "d", None)], "id int, audio string, reference string")
    rows = {r.id: r for r in prediction.batch_predict(df, make, reference="reference").collect()}
    assert set(rows) == {1, 2} and rows[1].hypothesis == "a!" and rows[1].error is None
    assert rows[2].hypothesis is None and "no model" in rows[2].error
    large = spark.createDataFrame([(9007199254740993, "a"), (None, "c")], "id long, audio string")
    kept = prediction.batch_predict(large, make).collect()
    assert {r.id for r in kept} == {9007199254740993, None} and [r.hypothesis for r in kept] == ["a!", "c!"]


@pytest.mark.parametrize("kind", ["long", "double", "date", "timestamp", "decimal(20,2)", "string"])
def test_deep_places_by_histograms(spark, monkeypatch, kind):
    monkeypatch.setattr(positions, "FEW", 3)
    monkeypatch.setattr(positions, "CELLS", 5)
    rnd = random.Random(6)
    values = [rnd.choice([0, 7, 7, 7, rnd.randrange(1000), rnd.randrange(10**9)]) for _ in range(300)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "n long").repartition(3)
    if kind == "date":
        df = df.select(F.date_from_unix_date((F.col("n") % 40_000).cast("int")).alias("n"))
    elif kind == "timestamp":
        df = df.select(F.timestamp_seconds("n").alias("n"))
    else:
        df = df.select(F.col("n").cast(kind).alias("n"))
    if kind == "double":
        df = df.unionAll(spark.sql("select explode(array(double('NaN'), double('-inf'), double('inf'), 1e300, -1e-300, 0.5)) as n"))
    want = [r.n for r in df.orderBy("n").collect()]
    for i in (0, 3, 4, 6, 100, 170, 250, len(want) - 1, len(want), len(want) + 50):
        got = [r.n for r in positions.nth_item(df, "n", i).collect()]
        assert repr(got) == repr(want[i : i + 1])


def noting(notes, killers=()):
    """A model that writes down each value it sees, and dies of some."""

    def make():
        def predict(value):
            with open(notes, "a") as file:
                file.write(f"{value}\n")
            if value in killers:
                os._exit(9)
            if value.startswith("bad"):
                raise KeyError("no model for this")
            return f" {value}! "

        return predict

    return make


def test_metrics_and_counts_see_each_row_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}" if i % 5 else "bad", "text" if i % 7 else "") for i in range(20)], "id long, audio string, reference string")
    predicted = prediction.predictions(prediction.batch_predict(df, noting(f"{tmp_path}/seen")))
    row = E.evaluate_predictions(predicted).first()
    assert (row.processed, row.failed, row.skipped, row.total_samples) == (14, 3, 3, 14)
    assert len((tmp_path / "seen").read_text().split("\n")) - 1 == 20


def test_slices_outlive_rows_that_kill_the_worker(spark, tmp_path):
    values = [f"v{i}" for i in range(40)] + ["bad", "v3", "kill a", "kill b", "kill a"]
    df = spark.createDataFrame([(i, v, "" if v == "v7" else "r") for i, v in enumerate(values)], "id long, audio string, reference string")
    make = noting(f"{tmp_path}/seen", ("kill a", "kill b"))
    found = prediction.predict_in_slices(df, make, f"{tmp_path}/run", reference="reference", slices=3)
    rows = {r.id: r for r in found.collect()}
    assert found.count() == len(rows) == len(values) - 1 and found.columns == ["id", "audio", "reference", "hypothesis", "error"]
    for i, v in enumerate(values):
        if v.startswith("v") and v != "v7":
            assert rows[i].hypothesis == f"{v}!" and rows[i].error is None
        elif v != "v7":
            assert rows[i].hypothesis is None and rows[i].error
    seen = (tmp_path / "seen").read_text()
    again = prediction.predict_in_slices(df, make, f"{tmp_path}/run", reference="reference", slices=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))
    assert (tmp_path / "seen").read_text() == seen, "what is written is not done again"


def test_slices_are_done_once_and_go_on_where_they_stopped(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(30)], "id long, audio string")
    make = noting(f"{tmp_path}/seen")
    found = prediction.predict_in_slices(df, make, f"{tmp_path}/run", slices=4)
    assert found.count() == 30 and len((tmp_path / "seen").read_text().split()) == 30
    half = sorted((tmp_path / "run" / "slices").glob("*-*"))[1]
    lost = spark.read.parquet(str(half)).count()
    (half / "_SUCCESS").unlink()
    assert prediction.predict_in_slices(df, make, f"{tmp_path}/run", slices=4).count() == 30
    assert len((tmp_path / "seen").read_text().split()) == 30 + lost
    assert prediction.predict_in_slices(df.limit(0), make, f"{tmp_path}/none", slices=1).count() == 0

    def broken():
        raise OSError("no such model")

    with pytest.raises(Exception, match="no such model"):
        prediction.predict_in_slices(df, broken, f"{tmp_path}/broken")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", 'The "cat", sat\non', " the cat"), ("2", "é ünï", "e")], "id string, reference string, hypothesis string"
    )
    scores, summary = E.sample_scores(df), E.evaluate(df)
    sinks.write_samples(scores, f"{tmp_path}/samples")
    back = spark.read.csv(f"{tmp_path}/samples", header=True, multiLine=True, escape='"',
                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    assert back.columns == list(sinks.SAMPLE_HEADER.values())
    rows = {r.filename: r for r in back.collect()}
    assert rows["1"].reference == 'The "cat", sat\non' and rows["1"].hypothesis == " the cat"
    sinks.write_summary(summary, f"{tmp_path}/summary")
    lone = spark.read.csv(f"{tmp_path}/summary", header=True).collect()
    assert len(lone) == 1 and lone[0]["Total_Samples"] == "2" and lone[0]["chrF++"] is not None
    sinks.write_summary(summary, f"{tmp_path}/wide", extra=sinks.EXTRA_SUMMARY)
    wide = spark.read.csv(f"{tmp_path}/wide", header=True).first()
    assert float(wide["Word_Accuracy_%"]) == summary.first().word_accuracy_pct
    sinks.write_results_json(df, f"{tmp_path}/json")
    assert {r.reference for r in spark.read.json(f"{tmp_path}/json").collect()} == {'The "cat", sat\non', "é ünï"}
    assert any("é ünï" in p.read_text("utf-8") for p in (tmp_path / "json").glob("*.json"))
    sinks.write_bundle(summary, scores, f"{tmp_path}/bundle")
    metrics, samples = sinks.read_bundle(spark, f"{tmp_path}/bundle")
    assert metrics.first() == summary.first() and samples.count() == 2
    train = spark.createDataFrame([(1, [1, 2], "t")], "id int, units array<int>, text string")
    sinks.export_index(train, U.unit_stats(train), f"{tmp_path}/index")
    rows, stats = sinks.read_index(spark, f"{tmp_path}/index")
    assert rows.first() == train.first() and stats.first().examples == 1
