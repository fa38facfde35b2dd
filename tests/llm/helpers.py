"""Small tables with the awkward cases that every operator must define, and plain-Python twins."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(seed=0, n=60):
    """(doc_id, text) with copies, near copies, nulls, empty, blank, short and long texts, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéñß", k=rng.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 6, 20, 60, 200])))
        rows.append((i * 3, text))
    for i in range(n, n + 40):
        _, text = rng.choice(rows[:n])
        parts = text.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append((i * 3 + 1, " ".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "  \n\t "), (1003, "One"), (1003, "One"), (1004, "one"), (1005, "A. B, c! D? e; F"), (None, "null id"), (None, "null id")]
    rows.append((1006, " ".join(rng.choices(words, k=6000))))
    return rows


def table(spark, rows, extra=True):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for name in ("key", "size", "hash", "n", "place", "digest", "_id", "score"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def shingles(text, words=5):
    found = WORD.findall((text or "").translate(LOWER))
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def components(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}
