from pyspark.sql import functions as F

from tracewell.operators import align as E
from tracewell.operators import cohort as H
from tracewell.operators import intervals as I
from tracewell.operators import packets as P
from tracewell.operators import statistics as S


def iv(spark, *pairs):
    return spark.createDataFrame([("r", float(a), float(b)) for a, b in pairs], "rec string, start double, end double")


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_union_touching_and_gap(spark):
    assert spans(I.union_intervals(iv(spark, (0, 1), (1, 2), (3, 4)), ["rec"])) == [(0, 2), (3, 4)]
    assert spans(I.union_intervals(iv(spark, (0, 1), (2, 3)), ["rec"], gap=1)) == [(0, 3)]
    assert spans(I.union_intervals(iv(spark, (5, 3)), ["rec"])) == [(3, 5)]


def test_subtract_and_keep(spark):
    u = I.union_intervals(iv(spark, (2, 4)), ["rec"])
    assert spans(I.subtract(iv(spark, (0, 10), (3, 3), (4, 5)), u, ["rec"])) == [(0, 2), (4, 5), (4, 10)]
    assert spans(I.keep_within(iv(spark, (0, 10), (3, 3), (5, 6)), u, ["rec"])) == [(2, 4), (3, 3)]
    assert spans(I.keep_within(iv(spark, (0, 10), (2, 3)), u, ["rec"], split=False)) == [(2, 3)]


def test_touching_counts_as_overlap(spark):
    assert I.drop_overlapping(iv(spark, (0, 2)), iv(spark, (2, 3)), ["rec"]).count() == 0


def test_bucketed_range_join_equals_plain(spark):
    p = spark.range(200).select(F.lit("r").alias("rec"), (F.col("id") * 0.37).alias("t"))
    q = iv(spark, (1, 3), (10, 40.5), (39, 41))
    plain = I.range_join(p, q, ["rec"], p["t"].between(q["start"], q["end"])).count()
    assert plain == I.range_join(p, q, ["rec"], p["t"].between(q["start"], q["end"]), bucket=5.0).count() > 0


def test_duplicate_packets_are_dropped_then_filled(spark):
    df = spark.createDataFrame([("d", 1, 1.0), ("d", 2, 2.0), ("d", 2, 2.5), ("d", 4, 4.0)], "dev string, i int, v double")
    got = P.fill_missing(P.drop_duplicated(df, ["dev"], "i"), ["dev"], "i", "v").orderBy("i").collect()
    assert [(r.i, r.v, r.filled) for r in got] == [(1, 1.0, False), (2, 0.0, True), (3, 0.0, True), (4, 4.0, False)]


def test_mode_tie_takes_the_longer_and_first_packet_may_be_missing(spark):
    df = spark.createDataFrame([("d", 1, 4), ("d", 3, 8)], "dev string, i int, n int")
    assert P.mode_length(df, ["dev"], "n").first().mode_length == 8
    got = P.sample_cursor(df, ["dev"], "i", "n").orderBy("i").collect()
    assert [(r.lost, r.start_sample) for r in got] == [(1, 8), (1, 20)]


def test_rate_fit_and_tags(spark):
    df = spark.createDataFrame([("r", 10.0 + 250 * t, float(t)) for t in range(5)], "rec string, sample_idx double, ext_s double")
    r = P.rate_fit(df, ["rec"]).first()
    assert abs(r.rate - 250) < 1e-9 and abs(r.lag - 0.04) < 1e-9
    t = spark.createDataFrame([("0x1F",), ("7",), ("zz",)], "c string").select(P.tag_code(F.col("c")).alias("c")).collect()
    assert [r.c for r in t] == [31, 7, None]


def ev(spark, *rows):
    return spark.createDataFrame([("r", l, float(t)) for l, t in rows], "rec string, label string, t double")


def test_linear_takes_first_sequence_and_distinct_ends(spark):
    e = ev(spark, ("a", 0), ("b", 4), ("b", 5), ("a", 10), ("a", 11))
    got = E.linear_epochs(e, ["rec"], [(0, "a"), (50, "b"), (100, "a")], 5, 20, 20).orderBy("start").collect()
    assert [(r.start, r.times) for r in got] == [(0.0, [0.0, 4.0, 10.0])]
    twice = ev(spark, ("a", 0), ("a", 0), ("b", 4), ("c", 10), ("c", 11))
    got = E.linear_epochs(twice, ["rec"], [(0, "a"), (40, "b"), (100, "c")], 5, 20, 30).orderBy("end").collect()
    assert [r.end for r in got] == [10.0, 11.0]


def test_segment_samples_and_half_even(spark):
    assert E.segment_samples([0, 18, 50, 100], 101) == [18, 32, 51]
    assert spark.range(1).select(E.to_sample(F.lit(2.5), 1.0)).first()[0] == 2


def test_circular_fill(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 4.0)], "k int, t_pos int, value double")
    assert [r.value for r in H.circular_fill(df, ["k"]).orderBy("t_pos").collect()] == [3.0, 2.0, 3.0, 4.0]
    one = spark.createDataFrame([(1, 0, None), (1, 1, 2.0)], "k int, t_pos int, value double")
    assert [r.value for r in H.circular_fill(one, ["k"]).collect()] == [2.0, 2.0]


def search(spark, active, n=10, least=2):
    df = spark.createDataFrame([(1, i) for i in active], "k int, pos int")
    return sorted((r.first, r.last, r.span) for r in (x.asDict() for x in S.interval_search(df, ["k"], "pos", F.lit(True), F.lit("up"), n, least).collect()) for r in [type("R", (), r)])


def test_interval_search_wraps_only_with_two_segments(spark):
    assert search(spark, [0, 1, 8, 9]) == [(8, 1, 4)]
    assert search(spark, range(10)) == [(0, 9, 10)]
    assert search(spark, [0, 1, 4, 5]) == [(0, 1, 2), (4, 5, 2)]


def test_names_and_regions(spark):
    df = spark.createDataFrame([("ZERO_AND_THREE_LEFT",)], "c string")
    assert df.select(H.normalise_channel(F.col("c"))).first()[0] == "0_3_L"
    r = spark.range(1).select(H.pair_key(F.lit("b"), F.lit("A"), False).alias("k"), H.parse_pair(F.lit("('x', 'y')")).alias("p")).first()
    assert r.k == '["A","b"]' and (r.p.a, r.p.b) == ("x", "y")


def test_adjustments(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    got = {r.p: r.p_adj for r in S.adjust(df, method="holm").collect()}
    assert got[0.01] == 0.03 and got[0.03] == 0.06 and got[0.04] == 0.06 and got[None] is None
    assert S.with_p(spark.createDataFrame([(1.959964,)], "z double")).first().p - 0.05 < 1e-6
