"""Scalar transforms, normalisation and summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.intervals import meet, reduce_and
from tracewell.operators.ordering import Ordered
from tracewell.storage import keep

TRANSFORMS = ("none", "db", "log", "log10", "fisherz", "fisherz_sqrt", "logit", "asinh")


def transform(x: Column, mode: str) -> Column:
    """x by mode; NULL outside the mode's domain."""
    inside = lambda lo, hi, c: F.when((x > lo) & (x < hi), c)
    table = {
        "none": x,
        "db": F.when(x > 0, 10 * F.log10(x)),
        "log": F.when(x > 0, F.ln(x)),
        "log10": F.when(x > 0, F.log10(x)),
        "fisherz": inside(-1, 1, F.atanh(x)),
        "fisherz_sqrt": F.when((x >= 0) & (x < 1), F.atanh(F.sqrt(x))),
        "logit": inside(0, 1, F.ln(x / (1 - x))),
        "asinh": F.asinh(x),
    }
    if mode not in table:
        raise ValueError(f"unknown transform {mode}")
    return table[mode]


def inverse(y: Column, mode: str) -> Column:
    """The inverse of ``transform``."""
    table = {"none": y, "db": F.pow(F.lit(10.0), y / 10), "log": F.exp(y), "log10": F.pow(F.lit(10.0), y), "fisherz": F.tanh(y), "fisherz_sqrt": F.tanh(y) * F.tanh(y), "logit": 1 / (1 + F.exp(-y)), "asinh": F.sinh(y)}
    if mode not in table:
        raise ValueError(f"unknown transform {mode}")
    return table[mode]


def transform_by(df: DataFrame, modes: dict[tuple[str, str], str], default: str = "none", value: str = "value") -> DataFrame:
    """The mode of each (metric, reducer), else the default; columns metric and reducer are read."""
    out = transform(F.col(value), default)
    for (metric, reducer), mode in modes.items():
        out = F.when((F.col("metric") == metric) & (F.col("reducer") == reducer), transform(F.col(value), mode)).otherwise(out)
    return df.withColumn(value, out)


#: Denominators up to this, or up to the share of their context's 95th percentile, count as zero.
TINY, NEAR_ZERO = 2.2250738585072014e-308, 1e-8


def safe_divide(num: Column, den: Column, scale: Column | None = None, rel: float = NEAR_ZERO) -> Column:
    """num / den; NULL where the denominator is near zero, |den| <= max(tiny, rel * scale), or either is not finite. scale: 95th percentile of |den| in its context."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    least = F.lit(TINY) if scale is None else F.greatest(F.lit(TINY), rel * scale)
    return F.when(finite(num) & finite(den) & (F.abs(den) > least), num / den)


def _normal(v: Column, base: Column, sd: Column, mode: str, scale: Column | None) -> Column:
    if mode == "mean":
        return v - base
    if mode == "zscore":
        den, num = sd, v - base
    elif mode in ("ratio", "percent"):
        den, num = base, (v if mode == "ratio" else 100 * (v - base))
    else:
        raise ValueError(f"unknown mode {mode}")
    return safe_divide(num.cast("double"), den.cast("double"), scale)


def normalize_by_group(df: DataFrame, keys: Sequence[str], baseline: Column, mode: str, value: str = "value", stat: str = "mean", missing: str = "null", within: Sequence[str] = ()) -> DataFrame:
    """Values against their group's baseline rows: mean (difference), ratio, percent or zscore (sd with ddof 0).

    NULL keys are a group. Groups without baseline values: NULL, dropped (``missing="drop"``), or an error. The
    statistics are an aggregate joined back, so a large group is never sorted or held in one task.

    within: those of the keys that are positions of a nested cell. A denominator is then near zero if it is small beside the 95th percentile of
    those of all positions of its group, and the value there is NULL.
    """
    own = F.when(baseline, F.col(value))
    stats = {"mean": F.avg(own), "median": F.percentile(own, 0.5), "max": F.max(own), "min": F.min(own)}
    base = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(stats[stat].alias("_base"), F.stddev_pop(own).alias("_sd"))
    scaled = bool(within) and mode != "mean"
    if scaled:
        den = F.abs("_sd" if mode == "zscore" else "_base").cast("double")
        group = [f"_k{i}" for i, k in enumerate(keys) if k not in within]
        scales = base.groupBy(*group).agg(F.percentile(F.when(~F.isnan(den) & (den != float("inf")), den), 0.95).alias("_scale"))
        base = meet(base, scales, group) if group else base.crossJoin(F.broadcast(scales))
    on = reduce_and([df[k].eqNullSafe(base[f"_k{i}"]) for i, k in enumerate(keys)])
    df = df.join(base, on, "left").drop(*(f"_k{i}" for i in range(len(keys))))
    out = _against(df, value, mode, missing, F.coalesce("_scale", F.lit(0.0)) if scaled else None)
    return out.drop("_scale") if scaled else out


def _against(df: DataFrame, value: str, mode: str, missing: str, scale: Column | None = None) -> DataFrame:
    if missing == "error":
        df = df.withColumn("_base", F.when(F.col("_base").isNull(), F.raise_error(F.lit("a group has no baseline"))).otherwise(F.col("_base")))
    out = df.withColumn(value, _normal(F.col(value), F.col("_base"), F.col("_sd"), mode, scale))
    out = out.where("_base is not null") if missing == "drop" else out
    return out.drop("_base", "_sd")


def normalize_by_span(cells: DataFrame, keys: Sequence[str], ranges: Sequence[tuple[float, float]], mode: str, unit: str = "percent", stat: str = "mean", pos: str = "t_pos", value: str = "value") -> DataFrame:
    """Traces against their own baseline span: positions [start, stop) or percent ranges (floor start, ceil stop)."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(pos)) - 1
    df = cells.withColumns({"_n": n, "_r": rank})
    hit = F.lit(False)
    for lo, hi in ranges:
        if unit == "percent":
            if not 0 <= lo < hi <= 100:
                raise ValueError("percent ranges lie within 0 and 100")
            hit = hit | (F.col("_r") >= F.floor(F.lit(lo) / 100 * F.col("_n"))) & (F.col("_r") < F.ceil(F.lit(hi) / 100 * F.col("_n")))
        else:
            hit = hit | (F.col("_r") >= lo) & (F.col("_r") < hi)
    own = F.when(hit, F.col(value))
    stats = {"mean": F.avg(own), "median": F.percentile(own, 0.5), "max": F.max(own), "min": F.min(own)}
    df = df.withColumns({"_base": stats[stat].over(w), "_sd": F.stddev_pop(own).over(w)})
    return _against(df, value, mode, "null").drop("_n", "_r")


def zscore(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Values by their key's mean and population sd; NULL where the sd is 0."""
    w = Window.partitionBy(*keys)
    return df.withColumn(value, F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))))


def quantile_scale(df: DataFrame, keys: Sequence[str], low: float = 0.05, high: float = 0.95, value: str = "value") -> DataFrame:
    """The low quantile to 0, the high one to 1."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"))
    return meet(df, q, keys).withColumn(value, F.try_divide(F.col(value) - F.col("_q")[0], F.col("_q")[1] - F.col("_q")[0])).drop("_q")


SUMMARIES = {
    "mean": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "std": F.stddev_samp,
    "var": F.var_samp,
}


def summarize(df: DataFrame, keys: Sequence[str], how: str, value: str = "value", others: Sequence[str] = ()) -> DataFrame:
    """Scalars by group (ddof 1; the sum of only missing values is 0); other columns: their first value that is not NULL.

    With others, the column ``ordinal`` orders the rows.
    """
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in others]
    return df.groupBy(*keys).agg(SUMMARIES[how](value).alias(value), *firsts)


def summarize_nested(cells: DataFrame, keys: Sequence[str], how: str, label: str = "t_pos", strict: bool = False) -> DataFrame:
    """Element-wise summary of cells by group and label (or position): NULLs skipped, ddof 0.

    strict: an error where the cells of a group do not have equal label sets.
    """
    kinds = SUMMARIES | {"std": F.stddev_pop, "var": F.var_pop}
    out = cells.groupBy(*keys, label).agg(kinds[how]("value").alias("value"), F.count("*").alias("_n"))
    if strict:
        n = cells.groupBy(*keys).agg(F.countDistinct("row_id").alias("_rows"))
        out = meet(out, n, keys).withColumn("value", F.when(F.col("_n") != F.col("_rows"), F.raise_error(F.lit("labels differ")).cast("double")).otherwise(F.col("value"))).drop("_rows")
    return out.drop("_n")


def bundle(cells: DataFrame, keys: Sequence[str], at: str = "t_pos") -> DataFrame:
    """Mean with sd (ddof 1), sem and 95 % band of series on a shared grid: keys, at, n, mean, sd, sem, lo, hi."""
    out = cells.groupBy(*keys, at).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    out = out.withColumn("sem", F.try_divide("sd", F.sqrt("n")))
    return out.withColumns({"lo": F.col("mean") - 1.96 * F.col("sem"), "hi": F.col("mean") + 1.96 * F.col("sem")})


def value_range(cells: DataFrame, symmetric: bool = False) -> DataFrame:
    """Global range of values, or one symmetric about 0."""
    out = cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    top = F.greatest(F.abs("lo"), F.abs("hi"))
    return out.select((-top).alias("lo"), top.alias("hi")) if symmetric else out


def surface(cells: DataFrame, keys: Sequence[str], x: str = "t_pos", y: str = "f_pos", how: str = "mean", symmetric: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    """Mean or median surface of several maps for each keys: keys, x, y, n (maps with a value), value, lo, hi.

    The grid is every x label of the keys with every y label; where no map has a value it is NULL. ``lo`` and ``hi`` are the range of all surfaces
    together, or one symmetric about 0; given bounds go first, and 0 to 1 stands for surfaces without a value. One aggregation of the maps makes both.
    """
    if how not in ("mean", "median"):
        raise ValueError(f"unknown aggregate {how}")
    cells = cells.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value")))
    z = cells.groupBy(*keys, x, y).agg(F.count("value").alias("n"), (F.avg("value") if how == "mean" else F.median("value")).alias("value"))
    labels = z.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.collect_set(x).alias("_x"), F.collect_set(y).alias("_y"))
    grid = labels.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), F.explode("_x").alias(x), "_y").withColumn(y, F.explode("_y")).drop("_y")
    full = meet(grid, z, [*keys, x, y], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if low is not None and high is not None:
        return full.withColumns({"lo": F.lit(float(low)), "hi": F.lit(float(high))})
    limits = value_range(z).select(F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))
    top = F.greatest(F.abs("lo"), F.abs("hi"))
    return full.crossJoin(F.broadcast(limits.select((-top).alias("lo"), top.alias("hi")) if symmetric else limits))


def percentiles(df: DataFrame, keys: Sequence[str], shares: Sequence[float], value: str = "value", rows: int = 1 << 20) -> DataFrame:
    """Exact percentiles, interpolated as ``F.percentile`` does: keys, _min, _max, _q (an array in order of ``shares``).

    Values are ordered by ranges of about ``rows`` rows and the few at the percentiles' places are taken, so no task holds the values of a key.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("_v"))
    n = keep(v.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")), "counts")
    parts = math.ceil((n.agg(F.sum("_n")).first()[0] or 0) / rows)
    ranks = Ordered(v.where("_v is not null"), ["_v"], keys, max(1, parts)).rows
    place = [(F.col("_n") - 1) * F.lit(float(p)) for p in shares]
    lower, upper = [F.floor(p) for p in place], [F.ceil(p) for p in place]
    # A key's rows of a part stand together, so the place of a rank follows from the part's first row and the rows of the parts before.
    each = ranks.groupBy("_part", *keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = meet(each.withColumn("_before", before), n.select(*keys, "_n"), keys).withColumn("_i", F.explode(F.array_distinct(F.array(*lower, *upper))))
    asked = each.where((F.col("_i") >= F.col("_before")) & (F.col("_i") < F.col("_before") + F.col("_c"))).withColumn("_place", F.col("_first") + F.col("_i") - F.col("_before"))
    near = ranks.select("_place", "_v").join(asked.select(*keys, "_n", "_i", "_place"), "_place")
    at = [F.max(F.when(F.col("_i") == x, F.col("_v"))) for x in (*lower, *upper)]
    taken = near.groupBy(*keys).agg(F.array(*at).alias("_at"))
    k = len(shares)
    between = [F.when((lower[i] == upper[i]) | (F.col("_at")[i] == F.col("_at")[k + i]), F.col("_at")[i]).otherwise((upper[i] - place[i]) * F.col("_at")[i] + (place[i] - lower[i]) * F.col("_at")[k + i]) for i in range(k)]
    return meet(n, taken, keys, "left").select(*keys, "_min", "_max", F.array(*between).alias("_q"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str = "value", whiskers: str | tuple[float, float] = "tukey") -> DataFrame:
    """Quartiles and whiskers (tukey, minmax, or two percentiles): keys, n, q1, median, q3, lo, hi, n_out."""
    shares = [0.25, 0.5, 0.75, *(whiskers if not isinstance(whiskers, str) else ())]
    q = percentiles(df, keys, shares, value)
    q = q.withColumns({"q1": F.col("_q")[0], "median": F.col("_q")[1], "q3": F.col("_q")[2]})
    iqr = F.col("q3") - F.col("q1")
    fence = {"tukey": lambda: (F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr), "minmax": lambda: (F.col("_min"), F.col("_max"))}[whiskers]() if isinstance(whiskers, str) else (F.col("_q")[3], F.col("_q")[4])
    q = q.withColumns({"_lo": fence[0], "_hi": fence[1]}).select(*keys, "q1", "median", "q3", "_lo", "_hi")
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    # Fences of few keys go to every task, so that a key with most rows is not sorted in one.
    q = keep(q, "fences")
    met = meet(df.select(*keys, value), F.broadcast(q) if q.count() <= 100_000 else q, keys)
    return met.groupBy(*keys).agg(F.count(value).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"), F.min(F.when(inside, F.col(value))).alias("lo"), F.max(F.when(inside, F.col(value))).alias("hi"), F.sum((~inside).cast("long")).alias("n_out"))


def level_means(df: DataFrame, level: str, order: DataFrame, value: str = "value") -> DataFrame:
    """Means of requested levels (level, rank) in their order, absent ones NULL."""
    return F.broadcast(order).join(df.groupBy(level).agg(F.avg(value).alias("mean")), level, "left").orderBy("rank")
