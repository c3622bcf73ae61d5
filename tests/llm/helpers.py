"""Brute-force versions on small tables."""

import re

WS = r"[^\x20\x09-\x0D]+"


def words(text, lower=False):
    t = text or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return re.findall(WS, t)


def docs(spark, rows, extra=False):
    schema = "doc_id long, text string" + (", bucket long, score double, rows string" if extra else "")
    return spark.createDataFrame([(*r, 1, 2.0, "x") if extra else r for r in rows], schema)


def prose(n, seed=0, vocabulary=500):
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def substring(rows, window=13):
    first = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        if i is not None:
            for j in range(len(w) - window + 1):
                k = tuple(w[j : j + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        if i is not None:
            for j in range(len(w) - window + 1):
                if first[tuple(w[j : j + window])] < i:
                    gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text, k=5):
    w = words(text, True)
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def lines(rows):
    seen, out = [], []
    for i, t in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in t.split("\n"):
            w = set(words(line, True))
            if not (w and any(4 * len(w & v) >= 3 * len(w | v) for v in seen)):
                kept.append(line)
            if w:
                seen.append(w)
        out.append((i, "\n".join(kept)))
    return out
