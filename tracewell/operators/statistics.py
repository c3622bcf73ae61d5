"""Group statistics restated as Spark jobs: two-stage tests, contrasts, interval search."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracewell.operators.intervals import meet, reduce_and
from tracewell.operators.ordering import Ordered


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Two-sided normal tail of |z|."""
    return z.map(lambda x: None if x is None or pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: added up to 200 terms, beyond that by the series of its difference from ln n, which has reached a double's precision there."""
    few = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(200)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
    d = n.cast("double")
    return F.when(n <= 200, few).otherwise(F.log(d) + 0.5772156649015329 + 1 / (2 * d) - 1 / (12 * d * d) + 1 / (120 * d * d * d * d))


def adjust(df: DataFrame, p: str = "p", by: Sequence[str] = (), method: str = "bh") -> DataFrame:
    """Adjusted p-values (column p_adj) overall or by group: bonferroni, holm, bh (fdr), by. NULL p stay NULL.

    Ranks and running extremes come from an order by ranges, so neither the whole table nor a large group is one task.
    """
    if method not in ("bonferroni", "holm", "bh", "fdr", "by"):
        raise ValueError(f"unknown method {method}")
    keys = [f"_g{i}" for i in range(len(by))]
    n = df.groupBy(*(F.col(f"`{b}`").alias(k) for b, k in zip(by, keys))).agg(F.count(p).alias("_n")).withColumn("_h", harmonic(F.col("_n")))

    def with_n(rows: DataFrame) -> DataFrame:
        on = reduce_and([rows[b].eqNullSafe(n[k]) for b, k in zip(by, keys)])
        return rows.join(n, on).drop(*keys) if by else rows.crossJoin(F.broadcast(n))

    whole = F.least(F.lit(1.0), F.col(p) * F.col("_n"))
    if method == "bonferroni":
        return with_n(df).withColumn("p_adj", F.when(F.col(p).isNotNull(), whole)).drop("_n", "_h")
    order = Ordered(with_n(df), [F.asc_nulls_last(p)], by).numbered("_r")
    if method == "holm":
        step = F.col(p) * (F.col("_n") - F.col("_r") + 1)
    else:
        step = F.col(p) * F.col("_n") / F.col("_r")
        if method == "by":
            step = step * F.col("_h")
    order.rows, order.columns = order.rows.withColumn("_s", step), [*order.columns, "_s"]
    out = order.running("_s", "p_adj", "max" if method == "holm" else "min", after=method != "holm").frame()
    return out.withColumn("p_adj", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), "p_adj"))).drop("_n", "_h", "_r", "_s")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def direction(estimate: Column) -> Column:
    return F.when(estimate > 0, "positive").when(estimate < 0, "negative").when(estimate == 0, "zero")


def two_stage_deviation(df: DataFrame, keys: Sequence[str], subject: str = "subject", value: str = "value") -> DataFrame:
    """Deviation from zero, subject means first: n, estimate, se, z and the robust pair (median, MAD).

    Robust: median / (1.4826 MAD / sqrt(n)). p-values are two-sided normal tails. Fewer than two subjects: status
    ``too few`` and NULL tests.
    """
    means = df.groupBy(*keys, subject).agg(F.avg(value).alias("m"))
    med = F.percentile("m", 0.5).over(Window.partitionBy(*keys))
    means = means.withColumn("_med", med)
    out = means.groupBy(*keys).agg(F.count("m").alias("n"), F.avg("m").alias("estimate"), F.stddev_samp("m").alias("_sd"), F.first("_med").alias("robust"), F.median(F.abs(F.col("m") - F.col("_med"))).alias("_mad"))
    z = F.try_divide(F.col("estimate") * F.sqrt("n"), F.nullif(F.col("_sd"), F.lit(0.0)))
    rz = F.try_divide(F.col("robust") * F.sqrt("n"), F.nullif(1.4826 * F.col("_mad"), F.lit(0.0)))
    few = F.col("n") < 2
    return out.select(*keys, "n", "estimate", F.when(~few, z).alias("z"), "robust", F.when(~few, rz).alias("robust_z"), F.when(few, "too few").otherwise("ok").alias("status"))


def with_p(df: DataFrame, z: str = "z", p: str = "p") -> DataFrame:
    return df.withColumn(p, normal_tail(F.col(z).cast("double")))


def region_contrast(df: DataFrame, keys: Sequence[str], region: str = "region", subject: str = "subject", value: str = "value") -> DataFrame:
    """Differences of regions at each key, subject means first: region1 < region2, diff, z (unequal variances)."""
    means = df.groupBy(*keys, region, subject).agg(F.avg(value).alias("m"))
    s = means.groupBy(*keys, region).agg(F.count("m").alias("n"), F.avg("m").alias("mean"), F.var_samp("m").alias("var"))
    return _pairs(s, keys, region)


def _pairs(s: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    a = s.select(*keys, F.col(level).alias("group1"), F.col("mean").alias("_m1"), F.col("n").alias("n1"), F.col("var").alias("_v1"))
    b = s.select(*keys, F.col(level).alias("group2"), F.col("mean").alias("_m2"), F.col("n").alias("n2"), F.col("var").alias("_v2"))
    met = (meet(a, b, keys) if keys else a.join(b, F.lit(True))).where("group1 < group2")
    se = F.sqrt(F.col("_v1") / F.col("n1") + F.col("_v2") / F.col("n2"))
    return met.select(*keys, "group1", "group2", "n1", "n2", (F.col("_m1") - F.col("_m2")).alias("diff"), F.try_divide(F.col("_m1") - F.col("_m2"), F.nullif(se, F.lit(0.0))).alias("z"))


def anova(df: DataFrame, keys: Sequence[str], group: str, value: str = "value") -> DataFrame:
    """One-way analysis of variance per key: k, n, ss_between, ss_within, f. One pass of group sums, then one over groups."""
    g = df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    # Around the grand mean, so that large means do not cancel.
    w = Window.partitionBy(*keys)
    g = g.withColumn("_d", F.col("m") - F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    total = g.groupBy(*keys) if keys else g.groupBy()
    out = total.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("ss_within"), F.sum(F.col("n") * F.col("_d") * F.col("_d")).alias("ss_between"))
    return out.withColumn("f", F.try_divide(F.col("ss_between") / (F.col("k") - 1), F.nullif(F.col("ss_within") / (F.col("n") - F.col("k")), F.lit(0.0))))


def pairwise_means(df: DataFrame, keys: Sequence[str], group: str, value: str = "value") -> DataFrame:
    """Differences of group means with pooled variance: group1 < group2, diff, z."""
    s = df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    total = s.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg((F.sum((F.col("n") - 1) * F.col("var")) / F.sum(F.col("n") - 1)).alias("_pooled"))
    met = s.join(total, reduce_and([s[k].eqNullSafe(total[f"_k{i}"]) for i, k in enumerate(keys)])) if keys else s.crossJoin(F.broadcast(total))
    return _pairs(met.select(*keys, group, "n", "mean", F.col("_pooled").alias("var")), keys, group)


def marginal_means(df: DataFrame, factor: str, over: Sequence[str], value: str = "value", weights: str = "equal") -> DataFrame:
    """Means of a factor's levels over the cells of other factors: equal weights, or proportional to cell size."""
    cells = df.groupBy(factor, *over).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    mean = F.avg("m") if weights == "equal" else F.sum(F.col("m") * F.col("n")) / F.sum("n")
    return cells.groupBy(factor).agg(mean.alias("emmean"), F.sum("n").alias("n"), F.count("*").alias("n_cells"))


def slope_effect(df: DataFrame, keys: Sequence[str], x: str, y: str, grid: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Slope of y on x per stratum, the change between the outer quantiles, and the curve on a quantile grid."""
    out = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.percentile(x, F.array(*map(F.lit, grid))).alias("at"), F.count("*").alias("n"))
    curve = F.transform("at", lambda q: F.col("intercept") + F.col("slope") * q)
    return out.withColumns({"curve": curve, "delta": F.col("slope") * (F.element_at("at", -1) - F.element_at("at", 1))})


def models_by_band(df: DataFrame, band: str, x: str, y: str, least: int = 4) -> DataFrame:
    """One regression per band, bands of fewer than ``least`` rows skipped."""
    out = df.groupBy(band).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    return out.where(F.col("n") >= least)


#: What a point must be on each basis of the interval search: significant by the plain test, by the robust one, or by both in one direction.
BASES = ("plain", "robust", "joint")


def significance(df: DataFrame, alpha: float = 0.05, estimate: str = "estimate", p: str = "p", robust: str = "robust", robust_p: str = "robust_p") -> DataFrame:
    """Adds direction, robust_direction (above_0, below_0, none) and plain_sig, robust_sig, joint_sig: a missing p is not significant, and a direction of none is not joint."""
    way = lambda x: F.when(F.col(x) > 0, "above_0").when(F.col(x) < 0, "below_0").otherwise("none")
    sig = lambda x: F.coalesce(F.col(x) < alpha, F.lit(False))
    out = df.withColumns({"direction": way(estimate), "robust_direction": way(robust), "plain_sig": sig(p), "robust_sig": sig(robust_p)})
    same = (F.col("direction") == F.col("robust_direction")) & (F.col("direction") != "none")
    return out.withColumn("joint_sig", F.col("plain_sig") & F.col("robust_sig") & same)


def basis_intervals(df: DataFrame, keys: Sequence[str], pos: str, n: int, least: int = 5) -> DataFrame:
    """``interval_search`` on every basis at once, from rows of ``significance``: keys, basis, first, last, span, way.

    The robust basis goes by the robust direction, the others by the plain one.
    """
    rows = [F.struct(F.lit(b).alias("basis"), F.col(f"{b}_sig").alias("_on"), F.col("robust_direction" if b == "robust" else "direction").alias("_dir")) for b in BASES]
    each = df.select(*keys, pos, F.explode(F.array(*rows)).alias("_e")).select(*keys, pos, "_e.*")
    return interval_search(each, [*keys, "basis"], pos, F.col("_on") & (F.col("_dir") != "none"), F.col("_dir"), n, least)


def interval_search(df: DataFrame, keys: Sequence[str], pos: str, active: Column, way: Column, n: int, least: int = 5) -> DataFrame:
    """Segments of adjacent active points of one direction on a cycle of n points: keys, first, last, span, way.

    The first and the last segment are one across the end if both touch it and agree; a single segment never wraps.
    Segments of fewer than ``least`` points go. ``span`` is the number of points.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    act = df.withColumn("_way", way).where(active)
    new = F.when((F.lag(pos).over(w) == F.col(pos) - 1) & (F.lag("_way").over(w) == F.col("_way")), 0).otherwise(1)
    seg = act.withColumn("_new", new).withColumn("_seg", F.sum("_new").over(w)).groupBy(*keys, "_seg", F.col("_way").alias("way")).agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("span"))
    own = Window.partitionBy(*keys)
    by = own.orderBy("_seg")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seg = seg.withColumns({"_k": F.count("*").over(own), "_f": F.first("first").over(whole), "_fl": F.first("last").over(whole), "_fw": F.first("way").over(whole), "_fs": F.first("span").over(whole), "_l": F.last("last").over(whole), "_lw": F.last("way").over(whole), "_r": F.row_number().over(by)})
    wraps = (F.col("_k") > 1) & (F.col("_f") == 0) & (F.col("_l") == n - 1) & (F.col("_fw") == F.col("_lw"))
    out = seg.withColumns({"last": F.when(wraps & (F.col("_r") == F.col("_k")), F.col("_fl")).otherwise(F.col("last")), "span": F.when(wraps & (F.col("_r") == F.col("_k")), F.col("span") + F.col("_fs")).otherwise(F.col("span"))})
    out = out.where(~(wraps & (F.col("_r") == 1)))
    return out.where(F.col("span") >= least).select(*keys, "first", "last", "span", "way")


def rank_candidates(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rank (from 1) within keys over all the order's terms."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def split_contrast(text: Column) -> tuple[Column, Column]:
    """Both sides of ``A - B``."""
    parts = F.split(text, r"\s+-\s+", 2)
    return F.trim(parts[0]), F.trim(parts[1])


def last_number(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(-?\d*\.?\d+)"), F.lit(1)), F.lit(-1)).try_cast("double")
