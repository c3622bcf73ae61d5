"""Pairs of a record's channels in squares."""

import itertools

from tracewell.operators import anatomy


def test_pairs_in_squares(spark, monkeypatch):
    """Records larger than a square, one of a NULL name, and repeated rows: each pair as often as a plain join gives it; no task takes a record whole."""
    rows = [(rec, f"c{i:03d}", float(i), i % 3 == 0, i % 2 == 0) for rec, n in (("r", 90), (None, 50), ("s", 1)) for i in range(n)] + [("r", "c000", 0.0, True, True)]
    channels = spark.createDataFrame(rows, "rec string, channel string, x double, M_in boolean, N_in boolean")
    monkeypatch.setattr(anatomy._squares, "__defaults__", (16,))
    for make, which in ((anatomy.ordered_pairs, lambda a, b: a != b), (anatomy.unordered_pairs, lambda a, b: a < b)):
        out = make(channels, ["rec"], [("M", "N")])
        got = sorted((str(r.rec), r.a, r.b, r.x_a, r.x_b) for r in out.collect())
        assert got == sorted((str(p[0]), p[1], q[1], p[2], q[2]) for p, q in itertools.product(rows, rows) if p[0] == q[0] and which(p[1], q[1]))
        sizes = out.rdd.glom().map(len).collect()
        assert max(sizes) < len(got) / 4


def test_grouped_pairs_in_squares(spark, monkeypatch):
    rows = [(rec, i, f"c{i}", i % 2) for rec, n in ((1, 60), (None, 5)) for i in range(n)]
    channels = spark.createDataFrame(rows, "rec int, pos int, channel string, grp int")
    monkeypatch.setattr(anatomy._squares, "__defaults__", (16,))
    got = sorted((r.rec, r.grp, r.a, r.b) for r in anatomy.self_pairs(channels, ["rec"], ordered=True, group="grp").collect())
    assert got == sorted((1, p[3], p[2], q[2]) for p, q in itertools.product(rows, rows) if p[0] == q[0] == 1 and p[3] == q[3] and p[1] != q[1])
