import random

import pytest

from tests.llm import helpers as H
from tracewell.llm.components import connected_components
from tracewell.llm.line_dedup import remove_similar_lines
from tracewell.llm.near_dedup import chunk_keys, near_duplicate_groups
from tracewell.llm.substring_dedup import difference_cover, remove_repeated_windows


@pytest.mark.parametrize("period", [1, 2, 3, 7, 13, 16])
def test_cover_reaches_every_shift(period):
    d = difference_cover(period)
    assert all(any((i + s) % period in d and (j + s) % period in d for s in range(period)) for i in range(period) for j in range(period))


def mutated(seed):
    r = random.Random(seed)
    base = H.prose(120, seed)
    shared = H.prose(20, 99)
    rows = []
    for i in range(40):
        w = base.split() if i % 3 else H.prose(60, 1000 + i).split()
        for _ in range(r.randrange(12)):
            w[r.randrange(len(w))] = f"m{r.randrange(10**6)}"
        if i % 4 == 0:
            w[10:10] = shared.split()
        rows.append((i * 3, "\n".join(" ".join(w[j : j + 15]) for j in range(0, len(w), 15))))
    rows += [(500, rows[1][1]), (501, rows[1][1].upper()), (502, None), (503, ""), (504, " \n\t"), (505, "one two"), (506, "One  two"), (507, "one")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return mutated(5)


def test_substring(spark, rows):
    got = remove_repeated_windows(H.docs(spark, rows, extra=True)).collect()
    assert sorted(map(tuple, got)) == sorted(H.substring(rows))


def test_substring_edges(spark):
    long = H.prose(3000, 1, 10**6)
    rows = [(1, long), (2, "x " + long[: len(long) // 2]), (None, long), (2, "other words only"), (2, long)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in remove_repeated_windows(H.docs(spark, rows)).collect()), key=str)
    half = len(("x " + long[: len(long) // 2]).split())
    # The last word of the half may be cut, so it can stay.
    assert [x for x in got if x[1] == 3000] == [(1, 3000, 0), (2, 3000, 3000), (None, 3000, 0)]
    assert [x for x in got if x[1] == half][0][2] >= half - 2 and (2, 3, 0) in got
    assert remove_repeated_windows(H.docs(spark, [])).count() == 0


def test_near(spark, rows):
    want = H.near(rows)
    got = near_duplicate_groups(H.docs(spark, rows, extra=True)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_blocks_give_the_same(spark):
    r = random.Random(3)
    base = H.prose(80, 7).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"m{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_duplicate_groups(H.docs(spark, rows), block=8).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == H.near(rows)


def test_near_edges(spark):
    assert near_duplicate_groups(H.docs(spark, [])).count() == 0
    text = H.prose(50, 4)
    got = near_duplicate_groups(H.docs(spark, [(1, text), (1, text), (2, text), (None, text)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 1)]


def test_keys_guarantee_pairs_within_the_distance():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**16, (200, 64), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(64, 31, replace=False)] ^= 1
    x, y = chunk_keys(a), chunk_keys(b)
    assert (x == y).any(axis=1).all()


def test_lines(spark, rows):
    given = [(i, t) for i, t in rows if t is not None]
    got = remove_similar_lines(H.docs(spark, rows, extra=True)).collect()
    assert sorted((r.doc_id, r.kept_text) for r in got if r.kept_text is not None) == sorted(H.lines(given))


def test_lines_with_many_partners(spark):
    r = random.Random(2)
    rows = []
    for i in range(80):
        w = [f"a{j}" for j in range(20)]
        for _ in range(r.randrange(6)):
            w[r.randrange(20)] = f"z{r.randrange(50)}"
        rows.append((i, " ".join(w) + "\nend"))
    got = remove_similar_lines(H.docs(spark, rows)).collect()
    assert sorted((x.doc_id, x.kept_text) for x in got) == H.lines(rows)


@pytest.mark.parametrize("hot", [0, 3, 30])
def test_lines_under_hot_words(spark, rows, hot):
    given = [(i, t) for i, t in rows if t is not None] + [(1000 + i, f"the {i % 7} of\nthe\nof the") for i in range(30)]
    got = remove_similar_lines(H.docs(spark, given, extra=True), hot=hot).collect()
    assert sorted((r.doc_id, r.kept_text) for r in got) == sorted(H.lines(given))


def test_lines_that_share_one_word(spark):
    """Thousands of short lines meet under one word, some of them alike."""
    r = random.Random(4)
    rows = [(i, " ".join(["common", *(f"q{r.randrange(60)}" for _ in range(r.randrange(1, 6)))])) for i in range(3000)]
    sets, want = [], {}
    for i, t in rows:
        s = frozenset(t.split())
        want[i] = "" if any(4 * len(s & v) >= 3 * len(s | v) for v in set(sets)) else t
        sets.append(s)
    for hot in (100, 10**6):
        got = {x.doc_id: x.kept_text for x in remove_similar_lines(H.docs(spark, rows), hot=hot).collect()}
        assert got == want


def test_lines_carry_columns(spark):
    df = H.docs(spark, [(1, "a b"), (2, "b a"), (None, None)]).selectExpr("*", "'x' as bucket", "doc_id as `odd name`", "7 as n_lines", "array(1) as carried")
    got = remove_similar_lines(df, carry=True)
    assert got.columns == ["doc_id", "n_lines", "n_removed", "kept_text", "bucket", "odd name", "carried"]
    assert {(r["doc_id"], r["n_removed"], r["bucket"], r["odd name"], tuple(r["carried"])) for r in got.collect()} == {(1, 0, "x", 1, (1,)), (2, 1, "x", 2, (1,)), (None, 0, "x", None, (1,))}


def test_lines_edges(spark):
    rows = [(1, "a b c\n\n a  b c"), (2, "C B A"), (None, "a b c"), (3, None), (4, ""), (2, "a b c")]
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in remove_similar_lines(H.docs(spark, rows, extra=True), carry=True).collect()), key=str)
    assert got == sorted([(1, 3, 1, "a b c\n"), (2, 1, 1, ""), (2, 1, 1, ""), (3, 0, 0, None), (4, 1, 0, ""), (None, 1, 0, "a b c")], key=str)
    assert remove_similar_lines(H.docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 200), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
