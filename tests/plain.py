"""Plain-Python twins of the metrics, written from their published definitions."""

import math
import string
from collections import Counter


def normalize(text):
    kept = "".join(c for c in text.lower() if c not in string.punctuation)
    return " ".join(kept.split())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def grams(seq, n):
    return Counter(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))


def wer(pairs):
    split = [(h.split(), r.split()) for h, r in pairs]
    return sum(edits(h, r) for h, r in split) / sum(len(r) for _, r in split)


def cer(pairs):
    return sum(edits(h, r) for h, r in pairs) / sum(len(r) for _, r in pairs)


def bleu(pairs):
    match, total = [0] * 4, [0] * 4
    hyp_len = ref_len = 0
    for h, r in ((h.split(), r.split()) for h, r in pairs):
        hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
        for n in range(1, 5):
            gh, gr = grams(h, n), grams(r, n)
            match[n - 1] += sum((gh & gr).values())
            total[n - 1] += sum(gh.values())
    if not any(match) or not all(total):
        return 0.0
    smooth, logs = 1, 0.0
    for m, t in zip(match, total):
        if m == 0:
            smooth *= 2
        logs += math.log(100 * m / t if m else 100 / (smooth * t))
    penalty = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    return penalty * math.exp(logs / 4)


def _apart(word):
    if len(word) > 1 and word[-1] in string.punctuation:
        return [word[:-1], word[-1]]
    if len(word) > 1 and word[0] in string.punctuation:
        return [word[0], word[1:]]
    return [word]


def chrf(pairs):
    orders = [("c", n) for n in range(1, 7)] + [("w", n) for n in range(1, 3)]
    sums = {o: [0, 0, 0] for o in orders}
    for h, r in pairs:
        forms = {
            "c": ("".join(h.split()), "".join(r.split())),
            "w": ([p for w in h.split() for p in _apart(w)], [p for w in r.split() for p in _apart(w)]),
        }
        for kind, n in orders:
            gh, gr = (grams(x, n) for x in forms[kind])
            s = sums[kind, n]
            s[0] += sum((gh & gr).values())
            s[1] += sum(gh.values()) if gr else 0
            s[2] += sum(gr.values())
    used = [s for s in sums.values() if s[1] and s[2]]
    if not used:
        return 0.0
    p = sum(s[0] / s[1] for s in used) / len(used)
    q = sum(s[0] / s[2] for s in used) / len(used)
    return 100 * 5 * p * q / (4 * p + q) if p + q else 0.0


def overlap(pairs):
    shares = [len(set(h.split()) & set(r.split())) / len(set(r.split())) for h, r in pairs if r.split()]
    return 100 * sum(shares) / len(shares) if shares else 0.0


def similarity(a, b):
    n = min(len(a), len(b))
    return sum(x == y for x, y in zip(a, b)) / n if n else 0.0


def knn(queries, train, k):
    """{query id: [(train id, similarity), ...]} with ties to the larger id."""
    return {
        q: sorted(((t, similarity(u, v)) for t, v in train.items()), key=lambda m: (m[1], m[0]), reverse=True)[:k]
        for q, u in queries.items()
    }


def runs(units):
    out = []
    for u in units:
        if out and out[-1][0] == u:
            out[-1][1] += 1
        else:
            out.append([u, 1])
    return [tuple(r) for r in out]
