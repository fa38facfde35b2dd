from collections import Counter, defaultdict

import hashlib
import pytest
from pyspark.sql import functions as F

from helpers import WORD, documents, table
from paracorpus.llm.exact_dedup import exact_dedup, keep_rows
from paracorpus.llm import jaccard_join, source_mixing
from paracorpus.llm.source_mixing import mix_sources, source_targets


@pytest.mark.parametrize("weak", [None, lambda t: F.length(t) % 3])
def test_exact_dedup_compares_contents(spark, weak):
    """Also with a digest that nearly always clashes."""
    rows = documents()
    found = exact_dedup(table(spark, rows), salts=4, **({"digest": weak} if weak else {})).collect()
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    want = []
    for i, text in rows:
        same = groups[text or ""]
        keep = max((x for x in same if x is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    assert Counter(map(tuple, found)) == Counter(want)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(table(spark, [])).count() == 0


def test_keep_rows(spark):
    docs = table(spark, [(1, "a"), (2, "a"), (3, "b")])
    assert sorted(r.doc_id for r in keep_rows(docs, exact_dedup(docs)).collect()) == [2, 3]


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water filling as the words say it: share by weight, stop, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while free and rest > 1e-9:
        unit = rest / sum(weight[s] for s in free)
        for s in free:
            target[s] += unit * weight[s]
        rest = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 0, "b": 0}, {"é": 3, "z": 3, "a": 3, "b": 300}, {"a": 40, "b": 16, "c": 8}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in source_targets(rows).collect()}
    assert found == pytest.approx(plain_targets(sizes), rel=1e-9)


@pytest.mark.parametrize("bits", [12, 5, 2])
def test_mix_is_near_the_targets_and_repeats(spark, monkeypatch, bits):
    """With fewer bits a level the boundary bucket is refined several times."""
    monkeypatch.setattr(source_mixing, "LEVEL_BITS", bits)
    rows = [(i, text, f"s{i % 4}" if i and i % 7 else None) for i, text in documents() if i is not None] * 1
    rows += [(None, "a b", "s1"), (5000, "x", "empty words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    found = mix_sources(docs).collect()
    assert len(found) == len(rows)
    sizes = {(i, s): len(WORD.findall(t or "")) for i, t, s in rows}
    by_source, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r["size"] == sizes[r.doc_id, r.source] and r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        by_source[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for r in found:
        assert abs(by_source[r.source] - r.target) <= largest[r.source]
    taken = Counter((r.doc_id, r.source, r.text) for r in source_mixing.take_mix(docs).collect())
    assert sum(taken.values()) == sum(r.copies for r in found)
    assert Counter((i, s) for i, s, _ in taken.elements()) == Counter({k: n for k, n in sum((Counter({(r.doc_id, r.source): r.copies}) for r in found), Counter()).items() if n})
    again = mix_sources(docs.repartition(7)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_mix_of_nothing(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rows = [(1, "a"), (2, "a"), (1, "b"), (None, "a"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_sha": F.lit("x"), "kept": F.lit("x")})
    kept = keep_rows(docs, exact_dedup(docs))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "a"), (1, "b"), (None, "a"), (4, "")], key=str)
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(f"v{i}" for i in range(30))
    rows = [(3, near), (5, near + " more"), (5, other), (None, near + " yet"), (7, other + " x"), (8, ""), (8, None), (2, "alone here"), (7, other + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "_row": F.lit("x")})
    kept = jaccard_join.keep_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, near), (5, other), (8, ""), (8, None), (2, "alone here")], key=str)
    assert jaccard_join.keep_rows(docs.where("false")).count() == 0


def test_texts_stay_where_they_are_if_few_near_copies_go(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(3, " ".join(words)), (5, " ".join(words) + " more"), (7, "alone here")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard_join.keep_rows(spark.createDataFrame(rows, "doc_id long, text string"))
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == [3, 7]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mix_beside_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}") for i in range(50)], "doc_id long, text string, source string")
    named = docs.withColumns({c: F.lit("x") for c in ("rounds", "bound", "_copy", "hash", "size", "target")})
    got = source_mixing.take_mix(named)
    assert got.columns == named.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in source_mixing.take_mix(docs).collect())
