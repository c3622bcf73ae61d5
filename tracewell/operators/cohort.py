"""Cohort tables: names, regions, merging, preprocessing of traces."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import transforms as T


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def region_single(a: Column, b: Column, names: tuple[str, str] = ("SNr", "STN")) -> Column:
    """The region that holds the channel if exactly one does."""
    return F.when(_flag(a) & ~_flag(b), names[0]).when(~_flag(a) & _flag(b), names[1])


def region_pair(mixed: Column, aa: Column, bb: Column, reverse: Column | None = None, name: str = "SNr-STN") -> Column:
    """The mixed region of a pair: mixed and neither end pair alike (and, for ordered pairs, not reverse)."""
    ok = _flag(mixed) & ~_flag(aa) & ~_flag(bb)
    return F.when(ok if reverse is None else ok & ~_flag(reverse), name)


def region_label(a: Column, b: Column) -> Column:
    """Mid (both), SNr, STN or EXT."""
    return F.when(_flag(a) & _flag(b), "Mid").when(_flag(a), "SNr").when(_flag(b), "STN").otherwise("EXT")


def side_of(channel: Column, left: Sequence[str], right: Sequence[str], pair: bool = False) -> Column:
    """L or R by the first contact of the channel's name; unknown pairs are R, unknown singles NULL."""
    first = F.split(channel, "[-_]")[0]
    out = F.when(first.isin(*left), "L").when(first.isin(*right), "R")
    return out.otherwise("R") if pair else out


def capitalise(c: Column) -> Column:
    """The first letter upper-cased, the rest untouched."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def parse_phase(phase: Column, side: Column) -> tuple[Column, Column]:
    """(phase, laterality) of ``strike_L`` and the channel's side; without a suffix the laterality is NULL."""
    parts = F.split(phase, "_")
    mark = F.upper(F.element_at(parts, -1))
    has = (F.size(parts) > 1) & mark.isin("L", "R")
    name = F.when(has, capitalise(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "_"))).otherwise(capitalise(phase))
    return name, F.when(has, F.when(mark == side, "Ipsi").otherwise("Contra"))


def override_phase(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Phases replaced by (analysis, trial)."""
    o = F.broadcast(overrides.withColumnRenamed("phase", "_phase"))
    return df.join(o, ["analysis", "trial"], "left").withColumn("phase", F.coalesce("_phase", "phase")).drop("_phase")


def token(c: Column) -> Column:
    """Names compared without case, outer blanks, and difference of _ and -."""
    return F.translate(F.lower(F.trim(c)), "_", "-")


def match_names(wanted: DataFrame, inventory: DataFrame, keys: Sequence[str] = ("record", "trial"), missing: str = "report") -> tuple[DataFrame, DataFrame]:
    """(matched inventory rows with the wanted name, wanted rows without a match)."""
    a = wanted.select("*", *(token(F.col(k)).alias(f"_{k}") for k in keys))
    b = inventory.select("*", *(token(F.col(k)).alias(f"_{k}") for k in keys))
    on = [f"_{k}" for k in keys]
    met = b.join(F.broadcast(a.drop(*keys)), on).drop(*on)
    lost = a.join(b.select(*on).distinct(), on, "left_anti").drop(*on)
    if missing == "error" and not lost.isEmpty():
        raise ValueError("some names match nothing")
    return met, lost


def merge_cohort(wanted: DataFrame, inventory: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Named tables of all subjects as one, missing values dropped (columns ``keep`` and name)."""
    met, _ = match_names(wanted, inventory)
    return met.select("name", *keep).where("value is not null")


def inventory_review(inventory: DataFrame) -> DataFrame:
    """File and subject counts per (record, trial)."""
    return inventory.groupBy("record", "trial").agg(F.countDistinct("subject").alias("n_subjects"), F.count("*").alias("n_files"))


def half_cycle_shift(cells: DataFrame, keys: Sequence[str], lat: str = "lat", n: int | None = None) -> DataFrame:
    """Ipsi traces moved by half a cycle and relabelled Contra; others unchanged."""
    size = F.lit(n) if n else F.count("*").over(Window.partitionBy(*keys))
    moved = cells.withColumn("_n", size)
    half = (F.col("_n") / 2).cast("long")
    out = moved.withColumn("t_pos", F.when(F.col(lat) == "Ipsi", F.pmod(F.col("t_pos") - half, F.col("_n")).cast("int")).otherwise(F.col("t_pos")))
    return out.withColumn(lat, F.when(F.col(lat) == "Ipsi", "Contra").otherwise(F.col(lat))).drop("_n")


def block_downsample(cells: DataFrame, keys: Sequence[str], by: int = 5) -> DataFrame:
    """Block means; coordinates are block centres in percent of the axis."""
    n = F.max("t_pos").over(Window.partitionBy(*keys)) + 1
    out = cells.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") % by != 0, F.raise_error(F.lit("length is no multiple")).cast("int")).otherwise(F.col("_n")))
    out = out.groupBy(*keys, F.floor(F.col("t_pos") / by).cast("int").alias("t_pos"), "_n").agg(F.avg("value").alias("value"))
    return out.withColumn("t_pct", (F.col("t_pos") + 0.5) * 100 * by / F.col("_n")).drop("_n")


def circular_fill(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing positions of a cyclic trace by linear interpolation around the circle; one value fills all, none is an error."""
    n = F.count("*").over(Window.partitionBy(*keys))
    df = cells.withColumn("_n", n)
    copies = df.withColumn("_c", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_p", F.col("t_pos") + F.col("_c") * F.col("_n"))
    known = F.when(F.col("value").isNotNull(), F.struct("_p", "value"))
    near = lambda order: F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = copies.withColumns({"_lo": near("_p"), "_hi": near(F.desc("_p"))}).where("_c = 0")
    blend = F.when(F.col("_hi._p") == F.col("_lo._p"), F.col("_lo.value")).otherwise(F.col("_lo.value") + (F.col("_hi.value") - F.col("_lo.value")) * (F.col("_p") - F.col("_lo._p")) / (F.col("_hi._p") - F.col("_lo._p")))
    value = F.when(F.col("_lo").isNull() & F.col("_hi").isNull(), F.raise_error(F.lit("a trace holds no value")).cast("double")).otherwise(blend)
    return out.withColumn("value", value).drop("_n", "_c", "_p", "_lo", "_hi")


def lowess_circle(y: np.ndarray, k: int, rounds: int = 2) -> np.ndarray:
    """Local linear regression around a circle: each point's ``k`` nearest positions (itself, then one to the left, one to the right and so on).

    Tricube weights by distance, times bisquare weights of the residuals of the round before; missing values (NaN) have no weight, and a point
    without weight around it keeps what it had.
    """
    n = len(y)
    k = max(2, min(k, 2 * n + 1))
    x = np.array([(i + 1) // 2 * (-1 if i % 2 else 1) for i in range(k)])
    h = np.abs(x).max() or 1
    near = (np.arange(n)[:, None] + x) % n
    known = ~np.isnan(y)
    base = (1 - (np.abs(x) / (h * 1.0001)) ** 3) ** 3 * known[near]
    values, fit, robust = np.where(known, y, 0.0)[near], y.copy(), np.ones(n)
    for _ in range(rounds + 1):
        w = base * robust[near]
        total = w.sum(axis=1)
        some = total > 0
        share = np.where(some, total, 1.0)
        mx, my = (w * x).sum(axis=1) / share, (w * values).sum(axis=1) / share
        var = (w * (x - mx[:, None]) ** 2).sum(axis=1)
        slope = np.where(var > 0, (w * (x - mx[:, None]) * (values - my[:, None])).sum(axis=1) / np.where(var > 0, var, 1.0), 0.0)
        fit = np.where(some, my - slope * mx, fit)
        left = np.abs(y - fit)[known]
        scale = 6 * np.median(left) if len(left) else 0.0
        robust = np.ones(n)
        if scale > 0:
            robust[known] = np.clip(1 - (left / scale) ** 2, 0, None) ** 2
    return fit


def circular_lowess(cells: DataFrame, keys: Sequence[str], frac: float = 0.05, rounds: int = 2) -> DataFrame:
    """Local linear regression of each cyclic trace, tricube weights, ``rounds`` robust passes (column smooth).

    The window holds frac of three copies of the trace, as many neighbours to both sides, and at most two rounds of the circle. A trace is one group.
    """

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_pos")
        return pdf.assign(smooth=lowess_circle(pdf["value"].to_numpy(float), int(np.ceil(frac * 3 * len(pdf))), rounds))

    return cells.groupBy(*keys).applyInPandas(smooth, ", ".join(f"`{c}` {t}" for c, t in [*cells.dtypes, ("smooth", "double")]))


def trace_inventory(traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct subjects, channels and timepoints, rows, and rows per trace, by parameter set."""
    out = traces.groupBy(*keys).agg(F.countDistinct("subject").alias("n_subjects"), F.countDistinct("subject", "channel").alias("n_channels"), F.countDistinct("t_pos").alias("n_times"), F.count("*").alias("n_rows"))
    return out.withColumn("rows_per_trace", F.try_divide("n_rows", "n_channels"))


def preprocess(df: DataFrame, keys: Sequence[str], how: str, mode: str, baseline: Column, norm: str) -> DataFrame:
    """Summary, transform and group normalisation as one plan (H3): keys, value."""
    out = T.summarize(df, keys, how)
    out = out.withColumn("value", T.transform(F.col("value"), mode))
    return T.normalize_by_group(out, [k for k in keys if k != "phase"], baseline, norm)


def channel_order(c: Column) -> list[Column]:
    """Sort by the numbers of ``a_b`` names, other names last."""
    a, b = (F.regexp_extract(c, r"^(\d+)_(\d+)", i).try_cast("int") for i in (1, 2))
    return [a.asc_nulls_last(), b.asc_nulls_last(), c.asc()]


def pair_key(a: Column, b: Column, ordered: bool = True) -> Column:
    """A pair as JSON text; unordered ones sorted by (lower case, text)."""
    if ordered:
        return F.to_json(F.array(a, b))
    first = (F.lower(a) < F.lower(b)) | (F.lower(a) == F.lower(b)) & (a <= b)
    return F.to_json(F.when(first, F.array(a, b)).otherwise(F.array(b, a)))


def parse_pair(text: Column) -> Column:
    """Struct a, b from ``("a", "b")``, ``['a','b']`` or JSON text."""
    parts = F.split(F.regexp_replace(text, r"""[\[\]()'"\s]""", ""), ",")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("a"), parts[1].alias("b")))


def normalise_channel(name: Column) -> Column:
    """Vendor names like ``ZERO_AND_THREE_LEFT`` as ``0_3_L``: number words, AND dropped, side as a letter."""
    out = F.upper(name)
    for i, w in enumerate(("ZERO", "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE")):
        out = F.regexp_replace(out, rf"(?<![A-Z]){w}(?![A-Z])", str(i))
    out = F.regexp_replace(out, r"_?AND_?", "_")
    return F.regexp_replace(F.regexp_replace(out, r"_?LEFT$", "_L"), r"_?RIGHT$", "_R")


def rename_record(df: DataFrame, old: str, new: str, columns: Sequence[str] = ("record", "Record")) -> DataFrame:
    """A record's new name in whichever record columns exist."""
    return df.withColumns({c: F.when(F.col(c) == old, new).otherwise(F.col(c)) for c in columns if c in df.columns})
