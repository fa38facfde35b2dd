import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import components, shingles
from paracorpus.llm import source_mixing
from paracorpus.llm import toxicity as X
from paracorpus.llm.common import pin
from paracorpus.llm.queries import FOLD, REGISTRY, tokenizer_path
from tokenizers import Tokenizer


def corpus(n=1500, seed=0):
    """Texts of common and rare words; a tenth have words of a family that no ordinary text has."""
    rng = random.Random(seed)
    common = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    endings = ["".join(rng.choices("mnopqrs", k=3)) for _ in range(40)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 10 == 0
        words = rng.choices(common, k=60) + ["".join(rng.choices("abcdefgh", k=7)) for _ in range(20)]
        if toxic:
            words += ["vile" + rng.choice(endings) for _ in range(6)]
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs + [(90001, None), (90002, ""), (None, "vile")], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    marks = spark.createDataFrame(labels + [(90001, 0), (None, 1), (90002, None)], "doc_id long, toxic int")
    models, scale = X.fit_toxicity(frame.select("doc_id", "text"), marks, FOLD)
    found = {r.doc_id: r for r in X.score_toxicity(frame, models, scale).collect()}
    assert len(found) == len(docs) + 3
    held = {r.doc_id for r in spark.createDataFrame(docs, "doc_id long, text string").where(f"{FOLD} = 0").collect()}
    right = [found[i].predicted == t for i, t in labels if i in held]
    caught = [found[i].predicted for i, t in labels if i in held and t]
    assert sum(right) / len(right) > 0.97 and sum(caught) / len(caught) > 0.9
    assert all(0 <= r.score <= 1 for r in found.values()) and found[90001].predicted == 0


def test_pairs_are_counted_once_per_text(spark):
    rows = spark.createDataFrame([("a b a b", 1), ("a b", 1), ("A, b.", 0), (None, 0), ("", 1)], "text string, toxic int")
    found = {r.key: (r.toxic, r.ordinary) for r in X.count_pairs(rows).collect()}
    assert found == {" a": (2, 1), "a b": (2, 1), "b a": (1, 0)}


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_too_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    models, scale = X.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), FOLD)
    assert all(0 <= r.score <= 1 for r in X.score_toxicity(docs, models, scale).collect())
    assert X.score_toxicity(docs.where("false"), models, scale).count() == 0


def test_rare_pairs_and_words_are_looked_up_exactly(spark):
    """Whatever is sent to the tasks, the rest comes from the join: scores are the same, of repeated rows too."""
    docs, labels = corpus(400, seed=3)
    docs = [(i, t + (" calm storm" if dict(labels)[i] else " calm sea")) for i, t in docs] + docs[:3]
    frame = spark.createDataFrame([(i, t, dict(labels).get(i, 0)) for i, t in docs], "doc_id long, text string, toxic int")
    frame = frame.unionByName(spark.createDataFrame([(900, "unseenword viletail calm", 0)], frame.schema))
    pairs = pin(X.count_pairs(frame.where("doc_id <> 900")), "test-pairs")
    assert pairs.where("key = 'calm sea'").select("ordinary").first()[0] > 0
    found = []
    for sent in ((10**6, 10**6, 10**6), (20, 30, 5), (0, 0, 0), (10**6, 10**6, 0)):
        models = X.ClassModels(pairs, *sent)
        found.append(sorted(map(tuple, X.score_texts(frame, models, ["doc_id"]).collect())))
        assert [i for i, _ in found[-1]] == sorted([*(i for i, _ in docs), 900])
    for other in found[1:]:
        assert [x for _, x in other] == pytest.approx([x for _, x in found[0]], abs=1e-9)
    plain = plain_models([(t, dict(labels)[i]) for i, t in docs])
    want = sorted((i, plain(t)) for i, t in [*docs, (900, "unseenword viletail calm")])
    assert [x for _, x in found[0]] == pytest.approx([x for _, x in want], abs=1e-6)


def words_in(text):
    return [w for w in (c.lower().strip(X.SIGNS) for c in (text or "").split()) if w]


def plain_models(rows):
    """The class models with dictionaries: a function from a text to its mean difference."""
    counts = Counter()
    for text, toxic in rows:
        words = words_in(text)
        counts.update((pair, toxic) for pair in set(zip(["", *words], words)))
    pairs = {p: (counts[p, 1], counts[p, 0]) for p, _ in counts}
    totals, words, stems = {}, {}, {}
    for (first, word), c in pairs.items():
        totals[first] = [a + b for a, b in zip(totals.get(first, (0, 0)), c)]
        words[word] = [a + b for a, b in zip(words.get(word, (0, 0, 0)), (c[0] > 0, c[1] > 0, 1))]
    for word, c in words.items():
        stems[word[: X.STEM]] = [a + b for a, b in zip(stems.get(word[: X.STEM], (0, 0, 0)), c)]

    def order(table):
        """(a count's share, what is left over) for both classes."""
        columns = [[c[k] for c in table.values() if c[k] > 0] for k in (0, 1)]
        sums = [sum(c) for c in columns]
        small, large = sorted((0, 1), key=lambda k: sums[k])

        def left(k, factor):
            return sum(min(n, factor * math.sqrt(n)) for n in columns[k]) / sums[k]

        factors = {small: X.DISCOUNT}
        low, high = 0.0, X.DISCOUNT * (math.sqrt(max(columns[large])) + 1)
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if left(large, middle) < left(small, X.DISCOUNT) else (low, middle)
        factors[large] = high
        return (lambda k, n: max(n - factors[k] * math.sqrt(n), 0) / sums[k]), left(small, X.DISCOUNT)

    (of_word, word_left), (of_stem, stem_left) = order(words), order(stems)
    n = sum(c[2] for c in stems.values())
    stem_p = {s: [of_stem(k, c[k]) + stem_left * (c[2] / n + 1 / X.STEMS) / 2 for k in (0, 1)] for s, c in stems.items()}
    word_p = {}
    for word, c in words.items():
        stem = word[: X.STEM]
        word_p[word] = [of_word(k, c[k]) + word_left * stem_p[stem][k] * min((c[2] + 1) / (stems[stem][2] + 1), 1) for k in (0, 1)]
    shares, rests = {}, {}
    for (first, word), c in pairs.items():
        least = min(totals[first])
        if least >= X.LEAST_CONTEXT and max(c) > X.DISCOUNT**2:
            share = [max(c[k] - X.DISCOUNT * math.sqrt(c[k] * totals[first][k] / least), 0) / totals[first][k] for k in (0, 1)]
            if max(share) > 0:
                shares[first, word] = share
                rests[first] = [r - s for r, s in zip(rests.get(first, (1, 1)), share)]

    def beyond(t, o):
        ratio = math.log(t / o)
        return math.copysign(max(abs(ratio) - X.MARGIN, 0), ratio)

    def score(text):
        found, total = words_in(text), 0.0
        for first, word in zip(["", *found], found):
            rest = rests.get(first, (1, 1))
            p = word_p.get(word) or stem_p.get(word[: X.STEM]) or (1, 1)
            share = shares.get((first, word), (0, 0))
            total += beyond(*(s + r * x for s, r, x in zip(share, rest, p)))
        return total / len(found) if found else 0.0

    return score


def test_the_scale_is_a_logistic_fit(spark):
    rows = [(x / 100, int(x > 20)) for x in range(-100, 140)]
    slope, shift = X.fit_scale(spark.createDataFrame(rows, "difference double, toxic int"))
    assert slope > 10 and -shift / slope == pytest.approx(0.2, abs=0.03)


FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    """Each stage keeps rows of its own input, and the whole is run() of the entry."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, counts = docs.count(), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"file://{tmp_path}/{name}")
        after = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name not in ("mix", "encode"):
            assert after.columns == docs.columns and after.exceptAll(docs).isEmpty()
        if name == "mix":
            assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
            assert after.distinct().exceptAll(docs).isEmpty()
        docs = after
        counts.append(after.count())
    assert counts[0] <= before and counts[1] <= counts[0] and counts[2] <= counts[1] and counts[4] == counts[3]
    again = REGISTRY["pipeline"](spark, FOLDER)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_equal_plain_python(spark, tmp_path):
    """Every stage's rows, worked out with dictionaries, sets and the library: toxic texts, copies, near copies, nulls."""
    rng = random.Random(4)
    docs, labels = corpus(500, seed=8)
    docs += [(1000 + i, docs[rng.randrange(500)][1]) for i in range(60)]
    docs += [(2000 + i, docs[rng.randrange(500)][1] + " more") for i in range(40)] + [(3000, None), (3001, ""), (3002, "One"), (1000, "shared id")]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    marks.withColumn("quality", F.lit(1)).write.parquet(f"file://{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def texts(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in labels}
    plain = plain_models([(t, dict(labels)[i]) for i, t in docs if i in fold and fold[i] in X.COUNTED])
    scale = X.fit_toxicity(frame, marks, FOLD)[1]
    kept = [(i, t) for i, t in docs if 1 / (1 + math.exp(-(scale[0] * plain(t) + scale[1]))) < 0.5]
    got = pin(stages["toxicity"](spark, frame, str(tmp_path)), "stage")
    assert 20 < len(docs) - len(kept) < 100 and texts(got) == sorted(kept, key=str)

    largest = {}
    for i, t in kept:
        largest[t or ""] = max(largest.get(t or "", -1), i)
    kept = [(i, t) for i, t in kept if largest[t or ""] == i]
    got = pin(stages["exact_dedup"](spark, got, str(tmp_path)), "stage")
    assert texts(got) == sorted(kept, key=str)

    sets = [shingles(t) for _, t in kept]
    pairs = [(a, b) for a in range(len(kept)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    group = components(pairs, range(len(kept)))
    least = {}
    for k, (i, _) in enumerate(kept):
        least[group[k]] = min(least.get(group[k], (i, k)), (i, k))
    kept = [kept[k] for _, k in least.values()]
    got = pin(stages["near_dedup"](spark, got, str(tmp_path)), "stage")
    assert texts(got) == sorted(kept, key=str) and pairs

    copies = {r.doc_id: r.copies for r in source_mixing.mix_sources(got).collect()}
    kept = [x for x in kept for _ in range(copies[x[0]])]
    got = pin(stages["mix"](spark, got, str(tmp_path)), "stage")
    assert texts(got) == sorted(kept, key=str)

    library = Tokenizer.from_file(tokenizer_path())
    library.no_padding()
    library.no_truncation()
    want = []
    for i, t in kept:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), said))))
    assert sorted(map(tuple, stages["encode"](spark, got, str(tmp_path)).collect())) == sorted(want)


def test_stages_of_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0, name
