"""Importance resampling, ranked search and language-model scores against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import helpers as H
from tracewell.llm import importance, language_model, ranked_search
from tracewell.llm import queries as Q

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: null, empty, blank and symbol-only texts, repeated rows and doc_ids, ties, non-ASCII, one long word, a null doc_id
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "-- !!"), (5, "Ab abé x9 ab"), (5, "Ab abé x9 ab"), (6, "Ab abé x9 ab"), (7, "ÉA z" + "q" * 3000), (None, "ab ab zz " * 30), (8, "ab " * 4000)]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def corpus(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(["ab", "cd", "x9", f"w{int(r.expovariate(0.02))}"]) for _ in range(r.randrange(0, 90)))) for i in range(100, 100 + n)]


def importance_by_hand(rows, target, percent=5):
    def features(text):
        w = terms(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    raw, aim = Counter(), Counter()
    found = [(i, *features(t)) for i, t in rows]
    for _, _, b in found:
        raw.update(b)
    for t in target:
        aim.update(features(t)[1])
    s, t = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for i, n, b in found:
        weight, score = sum(gain[x] for x in b), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(b), weight, score, n >= 20 and i is not None))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0], r[1]))
    drawn = fit[: percent * len(fit) // 100]
    return sorted([(*r[:4], drawn.index(r) + 1 if r in drawn else None) for r in out], key=str)


def test_importance_against_brute_force(spark):
    rows, target = ODD + corpus(150, 1), ["ab cd w1", None, "", "cd " * 50]
    docs = H.docs(spark, rows, extra=True).repartition(5)
    aim = H.docs(spark, list(enumerate(target)), extra=True)
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in importance.importance_sample(docs, aim).collect()]
    assert sorted(got, key=str) == importance_by_hand(rows, target)
    assert sum(r[4] is not None for r in got) == 5 * sum(len(terms(t)) >= 20 and i is not None for i, t in rows) // 100 > 0


def test_importance_of_empty_tables(spark):
    docs = H.docs(spark, corpus(30, 2))
    assert importance.importance_sample(docs.limit(0), docs).count() == 0
    got = importance.importance_sample(docs, docs.limit(0), percent=50)
    assert got.count() == 30 and got.where("rank is not null").count() == sum(len(terms(t)) >= 20 for _, t in corpus(30, 2)) // 2


def test_bit_planes():
    rng = np.random.default_rng(5)
    counts = [rng.integers(0, 10000, n) for n in (0, 1, 50, 40000)] + [np.full(70000, 17), np.full(3, 9999)]
    planes = [importance.count_planes(b) for b in counts]
    assert [len(p) for p in planes[:2]] == [0, 1] and len(planes[4]) == 17
    flat, depth = np.concatenate(planes), np.array([len(p) for p in planes])
    dense = np.array([np.bincount(b, minlength=10000) for b in counts])
    assert (importance.plane_sums(flat, depth) == dense.sum(axis=0)).all()
    gains = rng.integers(-12000, 9000, 10000)
    gains[:3] = -(2**15), 2**15 - 1, 0
    assert (importance.plane_weights(flat, depth, importance.gain_planes(gains)) == dense @ gains).all()
    assert (importance.plane_weights(flat, depth, importance.gain_planes(np.zeros(10000, int))) == 0).all()
    assert (importance.plane_sums(flat[:0], depth[:0]) == 0).all()


def search_by_hand(rows, items, k=20):
    split = [(i, Counter(terms(t))) for i, t in rows]
    split = [(i, c) for i, c in split if c]
    n_docs, total, df = len(split), sum(sum(c.values()) for _, c in split), Counter(w for _, c in split for w in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        scored = []
        for i, c in split:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, at + 1, i, -s) for at, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("query_bytes", [ranked_search.QUERY_BYTES, 40])
def test_search_against_brute_force(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(ranked_search, "SEGMENT_BYTES", 1500)
    rows = ODD + corpus(150, 3)
    items = [(1, "ab cd ab"), (2, None), (3, ""), (4, "w1 w2 zz éA"), (5, "nowhere"), (6, "x9 w3 w5 w8 w13"), (6, "x9 w3 w5 w8 w13"), (7, "ABé")]
    docs, asked = H.docs(spark, rows, extra=True).repartition(4), H.docs(spark, items, extra=True).withColumnRenamed("doc_id", "item_id")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.ranked_search(docs, asked, 9, query_bytes).collect()]
    assert sorted(got, key=str) == search_by_hand(rows, items, 9)


def test_search_of_empty_tables(spark):
    docs = H.docs(spark, corpus(5, 4))
    items = docs.withColumnRenamed("doc_id", "item_id")
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("false"), items.where("false"))):
        got = ranked_search.ranked_search(a, b)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("seed", range(12))
def test_nra_resolves_membership_ties_and_scores(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
    lists, dense = [], np.zeros(n, np.int64)
    for _ in range(int(rng.integers(1, 7))):
        docs = rng.permutation(n)[: rng.integers(0, n + 1)]
        gain = -np.sort(-rng.integers(1, 5 if seed % 3 == 0 else 10**9, len(docs)))
        dense[docs] += gain
        lists.append((docs, gain))
    got, score, read = ranked_search.nra(lists, n, k)
    assert (score == dense[got]).all() and read <= sum(len(d) for d, _ in lists)
    best = sorted(range(n), key=lambda i: (-dense[i], i))[:k]
    mine = sorted(((int(i), int(s)) for i, s in zip(got, score)), key=lambda x: (-x[1], x[0]))[:k]
    assert [x for x in mine if x[1]] == [(i, dense[i]) for i in best if dense[i]]
    floor = int(np.median(dense)) + 1
    got, score, _ = ranked_search.nra(lists, n, k, floor)
    assert {int(i) for i in best if dense[i] >= floor} <= set(got.tolist()) and (score >= floor).all()


def test_nra_stops_early():
    """Two lists of 100,000 entries whose best documents stand at the top of both."""
    gain = np.r_[np.full(50, 10**6), np.arange(99_950, 0, -1)]
    docs = np.arange(100_000)
    other = np.r_[docs[:50][::-1], docs[50:][::-1]]
    got, score, read = ranked_search.nra([(docs, gain), (other, gain)], 100_000, 20)
    assert set(got.tolist()) == set(range(50)) and (score == 2 * 10**6).all() and read == 100


def base_by_hand(rows):
    split = [(i, H.words(t, True) + [None]) for i, t in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in split if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted([(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in split], key=str)


def test_language_model_counts(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SLICE_BYTES", 2000)
    monkeypatch.setattr(language_model, "PART_BYTES", 700)
    rows = ODD + [(i, f"{t} tail{i} Tail{i}") for i, t in corpus(120, 6)]
    got = language_model.score_texts(H.docs(spark, rows, extra=True).repartition(4)).collect()
    assert sorted([(*r[:5], round(r.base_score, 6)) for r in got], key=str) == base_by_hand(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    same = {r.score for r in got if r.doc_id in (5, 6)}
    assert max(same) - min(same) < 1e-6


def test_language_model_without_training_rows(spark):
    rows = [(i, "ab cd") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = language_model.score_texts(H.docs(spark, rows)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 3, 0, 0, 0.0)] * 3
    assert language_model.score_texts(H.docs(spark, rows).limit(0)).count() == 0


def test_language_model_beats_base_on_held_out_rows(spark):
    """On 1,000 documents; the 200 of the smallest table (27 held out) train too little for a share of documents."""
    got = Q.QUERIES["op13_language_model"](spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert len(got) > 100 and got.score.sum() > 0.9 * got.base_score.sum()
    assert (got.score > got.base_score).mean() > 0.9


def test_classes_share_out_one():
    """Words of a tail class, known or not, add up to 1; so do the classes of a token."""
    heads = [(b"the", 50), (b"of", 20)]
    words = {b"the": 50, b"of": 20, b"axe": 3, b"bxe": 1, b"qqq": 7}
    tails = np.zeros((2, language_model.TAILS), np.int64)
    for w, n in words.items():
        tails[0, language_model.tail_class(w) - language_model.HEADS - 1] += n
        tails[1, language_model.tail_class(w) - language_model.HEADS - 1] += 1
    known = language_model.ClassTable(heads, tails, 4)
    assert (known.n, known.v) == (85, 6)
    for kind in {language_model.tail_class(w) for w in (b"axe", b"bxe", b"qqq", b"never")}:
        own = [n for w, n in words.items() if w not in known.heads and language_model.tail_class(w) == kind]
        assert math.isclose(sum(10 ** known.within(np.full(len(own) + 1, kind), np.array([*own, 0]))), 1)
    model = language_model.LogBilinear.start(known.tokens)
    line = np.array([language_model.START] * language_model.CONTEXT + [0, 1, 5, 0])
    at = len(line) - 1
    lines = [np.r_[line[:at], c] for c in range(language_model.CLASSES)]
    assert math.isclose(sum(math.exp(model.log_probs(x, np.array([at]))[0]) for x in lines), 1, rel_tol=1e-4)


def test_noise_contrastive_steps_learn_a_sequence():
    """Each class of a cycle is followed by the next; a unigram model knows only that there are six."""
    cycle, n = np.tile(np.arange(6), 4000), np.full(240, 100)
    line, at = language_model.stream(cycle, n)
    tokens = np.bincount(cycle, minlength=language_model.CLASSES)
    noise = (tokens + 1) / (tokens.sum() + len(tokens))
    model = language_model.LogBilinear.start(tokens)
    before = model.log_probs(line, at).mean()
    grown = {k: np.full(s, 1e-6, np.float32) for k, s in model.SHAPES.items()}
    for turn in range(4):
        model.train(line, at, noise, np.random.default_rng(turn), grown)
    assert before < math.log(1 / 5) and model.log_probs(line, at).mean() > math.log(0.8)
    flat = language_model.LogBilinear.of(model.flat())
    assert all((getattr(flat, k) == getattr(model, k)).all() for k in model.SHAPES)


def test_stream_places():
    line, at = language_model.stream(np.array([3, 4, 5, 9]), np.array([3, 1]))
    start = [language_model.START] * language_model.CONTEXT
    assert line.tolist() == [*start, 3, 4, 5, *start, 9] and line[at].tolist() == [3, 4, 5, 9]
