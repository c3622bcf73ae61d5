"""Hand-computed cases of the semantic traps."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import cells as C
from tracewell.operators import transforms as T


def cell(spark, values, row_id=1):
    return spark.createDataFrame([(row_id, i, float(i), v) for i, v in enumerate(values)], "row_id long, t_pos int, t_coord double, value double")


def one(df):
    return df.first().value


def wells(spark, *spec, closed=False):
    return C.wells(spark, spec, closed)


def test_one_sample_run_weighs_one_but_lasts_zero(spark):
    sel = C.select_wells(cell(spark, [None, 4.0, None, 2.0, 6.0]), wells(spark, ("w", 0, 5)))
    # Runs: {4} as (4, 1) and {2, 6} as (4, 1).
    assert one(C.reduce_1d(sel, ["row_id"], "mean")) == pytest.approx(4.0)
    assert one(C.reduce_1d(sel, ["row_id"], "count")) == 2
    assert one(C.reduce_1d(sel, ["row_id"], "occupation")) == pytest.approx(1 / 5)
    assert one(C.reduce_1d(sel, ["row_id"], "duration")) == pytest.approx(0.5)


def test_all_missing(spark):
    sel = C.select_wells(cell(spark, [None, None]), wells(spark, ("w", 0, 2)))
    assert one(C.reduce_1d(sel, ["row_id"], "mean")) is None
    assert one(C.reduce_1d(sel, ["row_id"], "count")) == 0
    assert one(C.reduce_1d(sel, ["row_id"], "rate")) is None


def test_runs_go_by_position_not_distance(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 50.0, 3.0)], "row_id long, t_pos int, t_coord double, value double")
    sel = C.select_wells(df, wells(spark, ("w", 0, 100)))
    assert one(C.reduce_1d(sel, ["row_id"], "count")) == 1
    assert one(C.reduce_1d(sel, ["row_id"], "mean")) == pytest.approx(2.0)


def test_half_open_and_closed_wells(spark):
    c = cell(spark, [1.0, 2.0, 3.0])
    assert C.select_wells(c, wells(spark, ("w", 0, 2))).count() == 2
    assert C.select_wells(c, wells(spark, ("w", 0, 2), closed=True)).count() == 3


def test_right_end_past_the_axis_is_closed(spark):
    axis = spark.createDataFrame([(1, 0.0, 10.0)], "row_id long, lo double, hi double")
    got = {r.well: r for r in C.resolve_wells(wells(spark, ("a", 8, 12), ("b", 1, 3), ("b", 2, 5)), axis).collect()}
    assert got["a"].w_hi == 10.0 and got["a"].right_closed
    assert (got["b"].w_lo, got["b"].w_hi, got["b"].w_len) == (1.0, 5.0, 4.0)


def test_percent_of_at_most_one_is_a_fraction(spark):
    r = spark.range(1).select(C.percent_to_coord(F.lit(1.0), F.lit(0.0), F.lit(50.0)).alias("a"), C.percent_to_coord(F.lit(10.0), F.lit(0.0), F.lit(50.0)).alias("b")).first()
    assert (r.a, r.b) == (50.0, 5.0)


def test_prepare_axis_numeric_or_categorical(spark):
    df = spark.createDataFrame([(1, 0, "10", 1.0), (1, 1, "2", 2.0), (2, 0, "b", 1.0), (2, 1, "2", 2.0)], "row_id long, ordinal int, t_label string, value double")
    got = {(r.row_id, r.t_label): (r.t_pos, r.t_coord) for r in C.prepare_axis(df).collect()}
    assert got == {(1, "2"): (0, 2.0), (1, "10"): (1, 10.0), (2, "b"): (0, 0.0), (2, "2"): (1, 1.0)}


def test_well_names_number_repeats(spark):
    df = spark.createDataFrame([(["a", "b"], 0), (["a", "b"], 1)], "labels array<string>, ordinal int")
    assert sorted(r.name for r in C.well_names(df).collect()) == ["a+b", "a+b_2"]


def test_pack_round_trip(spark):
    c = cell(spark, [1.0, None, 3.0])
    back = C.unpack_traces(C.pack_traces(c), "values")
    assert sorted((r.t_pos, r.value) for r in back.collect() if r.value is not None) == [(0, 1.0), (2, 3.0)]


def test_zero_baseline_gives_null_and_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, True, 0.0), (None, False, 5.0), ("a", True, 2.0), ("a", False, 4.0)], "k string, base boolean, value double")
    got = {(r.k, r.base): r.value for r in T.normalize_by_group(df, ["k"], F.col("base"), "ratio").collect()}
    assert got[(None, False)] is None and got[("a", False)] == 2.0


def test_sum_of_missing_is_zero(spark):
    df = spark.createDataFrame([("a", None)], "k string, value double")
    assert T.summarize(df, ["k"], "sum").first().value == 0.0


def test_first_of_other_columns_skips_null(spark):
    df = spark.createDataFrame([("a", 0, None, 1.0), ("a", 1, "x", 3.0)], "k string, ordinal int, side string, value double")
    r = T.summarize(df, ["k"], "mean", others=["side"]).first()
    assert (r.value, r.side) == (2.0, "x")


def test_strict_nested_summary_fails_on_unequal_labels(spark):
    df = spark.createDataFrame([("g", 1, 0, 1.0), ("g", 1, 1, 1.0), ("g", 2, 0, 1.0)], "g string, row_id long, t_pos int, value double")
    assert T.summarize_nested(df, ["g"], "mean").count() == 2
    with pytest.raises(Exception, match="labels differ"):
        T.summarize_nested(df, ["g"], "mean", strict=True).collect()


@pytest.mark.parametrize("mode", ["db", "log", "log10", "fisherz", "fisherz_sqrt", "logit", "asinh"])
def test_inverse(spark, mode):
    df = spark.createDataFrame([(0.2,), (0.7,)], "x double")
    for r in df.select("x", T.inverse(T.transform(F.col("x"), mode), mode).alias("y")).collect():
        assert r.y == pytest.approx(r.x)


def test_transform_outside_domain_is_null(spark):
    df = spark.createDataFrame([(-1.0,)], "x double")
    assert df.select(T.transform(F.col("x"), "db")).first()[0] is None


def test_span_baseline_is_positional(spark):
    got = T.normalize_by_span(cell(spark, [1.0, 3.0, 10.0]), ["row_id"], [(0, 50)], "mean").orderBy("t_pos").collect()
    assert [r.value for r in got] == [-1.0, 1.0, 8.0]
