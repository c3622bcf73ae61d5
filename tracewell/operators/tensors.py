"""Frequency and time helpers of tensors: grids, notches, smoothing, interpolation, masks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators import transforms as T
from tracewell.operators.intervals import meet
from tracewell.operators.smoothing import moving_median, smooth_gaussian, smooth_mean, smooth_median, with_edges  # noqa: F401


def frequency_grid(spark: SparkSession, low: float, high: float, step: float | None = None, n_log: int | None = None) -> DataFrame:
    """Linear (floor((high - low) / step) + 1 points, six digits) or logarithmic grid: f_pos, freq."""
    if not 0 < low <= high:
        raise ValueError("0 < low <= high")
    if n_log:
        ratio = math.log(high / low) / max(1, n_log - 1)
        return spark.range(n_log).select(F.col("id").cast("int").alias("f_pos"), F.round(low * F.exp(F.col("id") * ratio), 6).alias("freq"))
    n = math.floor((high - low) / step + 1e-9) + 1
    return spark.range(n).select(F.col("id").cast("int").alias("f_pos"), F.round(low + F.col("id") * step, 6).alias("freq"))


def outside_notches(grid: DataFrame, notches: DataFrame, freq: str = "freq") -> DataFrame:
    """Grid points outside all notch intervals (freq_c, width), both ends closed."""
    n = F.broadcast(notches.select((F.col("center") - F.col("width") / 2).alias("_lo"), (F.col("center") + F.col("width") / 2).alias("_hi")))
    return grid.join(n, F.col(freq).between(F.col("_lo"), F.col("_hi")), "left_anti")


def merge_notches(notches: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Notches within ``tol`` Hz as one, the wider width."""
    w = Window.partitionBy(F.lit(0)).orderBy("center")
    new = F.when(F.col("center") - F.lag("center").over(w) <= tol, 0).otherwise(1)
    return notches.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w)).groupBy("_g").agg(F.min("center").alias("center"), F.max("width").alias("width")).drop("_g")


def clip_bands(bands: DataFrame, low: float, high: float) -> DataFrame:
    """Bands cut to an allowed range, empty ones dropped."""
    return bands.withColumns({"start": F.greatest("start", F.lit(low)), "end": F.least("end", F.lit(high))}).where("start < end")


def cycles(freq: Column, base: float, method: str = "morlet", low: float = 2.0, high: float | None = None) -> Column:
    """Cycles per frequency: freq / base, between a floor and a ceiling; multitaper halves the floor."""
    out = F.greatest(F.lit(low if method == "morlet" else low / 2), freq / base)
    return F.least(out, F.lit(high)) if high is not None else out


def mask_radius(freq: Column, n_cycles: Column, method: str = "morlet") -> Column:
    """Seconds that an edge reaches: five sigmas of the wavelet, or half the taper window."""
    return 5 * n_cycles / (2 * math.pi * freq) if method == "morlet" else n_cycles / freq / 2


def window_samples(freq: Column, n_cycles: Column, rate: float, guard: int = 2) -> Column:
    """Samples of the support of ten sigmas with a guard."""
    return (F.ceil(10 * n_cycles / (2 * math.pi * freq) * rate) + guard).cast("int")


def pad_range(lo: Column, hi: Column, n: Column, want: int) -> tuple[Column, Column]:
    """Widen an index range to ``want`` neighbours: to both sides, then right, then left, within 0 and n - 1."""
    short = F.greatest(F.lit(0), F.lit(want) - (hi - lo + 1))
    left = F.least(lo, F.floor(short / 2))
    right = F.least(n - 1 - hi, short - left)
    left = F.least(lo, short - right)
    return (lo - left).cast("int"), (hi + right).cast("int")


def decimate(df: DataFrame, idx: str, step: int) -> DataFrame:
    return df.where(F.pmod(F.col(idx), F.lit(step)) == 0)


def decimate_to(df: DataFrame, keys: Sequence[str], idx: str, most: int = 4000) -> DataFrame:
    """Every k-th sample, so that no trace has more than ``most``."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_k", F.ceil(n / most)).where(F.pmod(F.col(idx), F.col("_k")) == 0).drop("_k")


def segments(df: DataFrame, keys: Sequence[str], idx: str, length: int) -> DataFrame:
    """Fixed-length segments (column segment, seg_pos); a short last one goes."""
    out = df.withColumns({"segment": F.floor(F.col(idx) / length), "seg_pos": F.pmod(F.col(idx), F.lit(length))})
    n = F.count("*").over(Window.partitionBy(*keys, "segment"))
    return out.withColumn("_n", n).where(F.col("_n") == length).drop("_n")


def interpolate(cells: DataFrame, keys: Sequence[str], pos: str = "f_coord") -> DataFrame:
    """Missing values linearly between their finite neighbours, edges held; rows with under two finite values stay NULL."""
    own = Window.partitionBy(*keys)
    known = F.when(F.col("value").isNotNull(), F.struct(F.col(pos).alias("p"), F.col("value").alias("v")))
    near = lambda order: F.last(known, ignorenulls=True).over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    df = cells.withColumns({"_at": F.row_number().over(own.orderBy(pos)), "_n": F.count("value").over(own)})
    df = df.withColumns({"_lo": near("_at"), "_hi": near(F.desc("_at"))}).drop("_at")
    blend = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * (F.col(pos) - F.col("_lo.p")) / (F.col("_hi.p") - F.col("_lo.p"))
    value = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("_n") < 2, F.lit(None)).when(F.col("_lo").isNull(), F.col("_hi.v")).when(F.col("_hi").isNull(), F.col("_lo.v")).otherwise(blend)
    return df.withColumn("value", value).drop("_lo", "_hi", "_n")


def interpolate_in(cells: DataFrame, keys: Sequence[str], mode: str = "db", pos: str = "f_coord") -> DataFrame:
    """Transform, interpolate, transform back."""
    there = cells.withColumn("value", T.transform(F.col("value"), mode))
    return interpolate(there, keys, pos).withColumn("value", T.inverse(F.col("value"), mode))


def savgol_fill(cells: DataFrame, keys: Sequence[str], window: int = 7, order: int = 2, pos: str = "f_pos", interp: str = "value") -> DataFrame:
    """Missing positions by a local polynomial through the finite values around them (column filled)."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        y, x = pdf["value"].to_numpy(float), pdf[pos].to_numpy(float)
        out, ok = y.copy(), ~np.isnan(y)
        for i in np.flatnonzero(~ok):
            near = np.flatnonzero(ok & (np.abs(x - x[i]) <= window))
            if len(near) > order:
                out[i] = np.polyval(np.polyfit(x[near] - x[i], y[near], order), 0.0)
        return pdf.assign(filled=out)

    return cells.groupBy(*keys).applyInPandas(fill, ", ".join(f"`{c}` {t}" for c, t in [*cells.dtypes, ("filled", "double")]))


def match_grid(source: DataFrame, target: DataFrame, tol: float, freq: str = "freq") -> DataFrame:
    """Pairs of target and source points within ``tol`` that are each other's nearest (ties to the smaller): target, source.

    So no point stands in two pairs, and the pairs keep the order of both grids. A bucketed equi join.
    """
    width = max(tol, 1e-9) * 2
    s = source.select(F.col(freq).alias("source"), F.floor(F.col(freq) / width).alias("_b"))
    t = target.select(F.col(freq).alias("target"), F.explode(F.array(*(F.floor(F.col(freq) / width) + i for i in (-1, 0, 1)))).alias("_b"))
    far = F.abs(F.col("source") - F.col("target"))
    met = t.distinct().join(s.distinct(), "_b").where(far <= tol)
    met = met.withColumn("_t", F.row_number().over(Window.partitionBy("target").orderBy(far, "source")))
    met = met.withColumn("_s", F.row_number().over(Window.partitionBy("source").orderBy(far, "target")))
    return met.where("_t = 1 and _s = 1").select("target", "source")


def grid_difference(target: DataFrame, source: DataFrame, tol: float, freq: str = "freq") -> DataFrame:
    """Target points without a source point."""
    return target.join(match_grid(source, target, tol, freq).select(F.col("target").alias(freq)), freq, "left_anti")


def quality_mask(cells: DataFrame, fits: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Values nulled at times whose fit has an R2 below ``least`` or none."""
    out = meet(cells, fits.select(*keys, "r2"), keys, "left")
    return out.withColumn("value", F.when(F.col("r2") >= least, F.col("value"))).drop("r2")


def require_radii(freqs: DataFrame, radii: DataFrame, freq: str = "freq") -> DataFrame:
    """freqs, if every one has a radius; else an error."""
    if not freqs.join(radii, freq, "left_anti").isEmpty():
        raise ValueError("some frequencies have no radius")
    return freqs
