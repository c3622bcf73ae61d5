"""Beat artefacts: slow baseline, peaks, templates and their removal."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.intervals import meet
from tracewell.operators.prominence import prominences
from tracewell.operators.smoothing import moving_median


def slow_baseline(signal: DataFrame, keys: Sequence[str], half: int, idx: str = "sample_idx", block: int = 65536) -> DataFrame:
    """Moving-median baseline and what it leaves (columns baseline, residual), in blocks of a trace."""
    out = moving_median(signal, keys, half, idx, block=block).withColumnRenamed("smooth", "baseline")
    return out.withColumn("residual", F.col("value") - F.col("baseline"))


def find_peaks(signal: DataFrame, keys: Sequence[str], height: float | None = None, distance: int = 1, absolute: bool = False, best: int | None = None, idx: str = "sample_idx", prominence: float | None = None) -> DataFrame:
    """Local maxima: at least ``height`` and ``prominence``, at least ``distance`` apart (higher ones first), the ``best`` in order of time.

    Maxima come from window functions; only they reach the greedy spacing, per key.
    """
    w = Window.partitionBy(*keys).orderBy(idx)
    v = F.abs("value") if absolute else F.col("value")
    df = signal.select(*keys, idx, v.alias("score"), "value")
    top = df.withColumns({"_p": F.lag("score").over(w), "_n": F.lead("score").over(w)}).where("score > _p and score >= _n").drop("_p", "_n")
    if height is not None:
        top = top.where(F.col("score") >= height)
    if prominence is not None:
        far = prominences(signal.withColumn("value", v), keys, idx).where(F.col("prominence") >= prominence)
        top = meet(top, far.select(*keys, idx), [*keys, idx], "left_semi")
    if distance > 1:
        kinds = dict(signal.dtypes)

        def space(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(idx).reset_index(drop=True)
            at, alive = pdf[idx].to_numpy(), np.ones(len(pdf), bool)
            for i in np.argsort(-pdf["score"].to_numpy(), kind="stable"):
                if alive[i]:
                    lo, hi = np.searchsorted(at, [at[i] - distance + 1, at[i] + distance])
                    alive[lo:hi] = False
                    alive[i] = True
            return pdf[alive]

        top = top.groupBy(*keys).applyInPandas(space, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"{idx} {kinds[idx]}, score double, value double"]))
    if best is not None:
        top = top.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), idx))).where(F.col("_r") <= best).drop("_r")
    return top


def beat_template(signal: DataFrame, beats: DataFrame, keys: Sequence[str], before: int, after: int, idx: str = "sample_idx") -> DataFrame:
    """Average beat by offset: keys, offset, template."""
    near = beats.select(*keys, F.col(idx).alias("_c"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn(idx, F.col("_c") + F.col("offset"))
    return meet(near, signal, [*keys, idx]).groupBy(*keys, "offset").agg(F.avg("value").alias("template"))


def crop_template(template: DataFrame, keys: Sequence[str], slack: int) -> DataFrame:
    """The cut of up to ``slack`` offsets at both ends whose end values differ least."""
    w = Window.partitionBy(*keys)
    t = template.withColumns({"_lo": F.min("offset").over(w), "_hi": F.max("offset").over(w)})
    left = t.where(F.col("offset") <= F.col("_lo") + slack).select(*keys, F.col("offset").alias("lo"), F.col("template").alias("_a"))
    right = t.where(F.col("offset") >= F.col("_hi") - slack).select(*keys, F.col("offset").alias("hi"), F.col("template").alias("_b"))
    best = meet(left, right, keys).groupBy(*keys).agg(F.min_by(F.struct("lo", "hi"), F.struct(F.abs(F.col("_a") - F.col("_b")), F.col("lo") - F.col("hi"))).alias("_c"))
    return meet(template, best, keys).where(F.col("offset").between(F.col("_c.lo"), F.col("_c.hi"))).drop("_c")


def subtract_template(signal: DataFrame, beats: DataFrame, template: DataFrame, keys: Sequence[str], idx: str = "sample_idx") -> DataFrame:
    """Template scaled and shifted to each beat by least squares, subtracted; a sample of two beats takes the later one's."""
    at = meet(beats.select(*keys, F.col(idx).alias("beat")), template, keys).withColumn(idx, F.col("beat") + F.col("offset"))
    met = meet(at, signal, [*keys, idx])
    fit = met.groupBy(*keys, "beat").agg(F.regr_slope("value", "template").alias("_s"), F.regr_intercept("value", "template").alias("_i"))
    made = meet(met, fit, [*keys, "beat"]).withColumn("_a", F.coalesce(F.col("_s") * F.col("template") + F.col("_i"), F.lit(0.0)))
    last = made.groupBy(*keys, idx).agg(F.max_by("_a", "beat").alias("_a"))
    return meet(signal, last, [*keys, idx], "left").withColumn("value", F.col("value") - F.coalesce("_a", F.lit(0.0))).drop("_a")


def _epochs(x: np.ndarray, at: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    ok = at[(at >= before) & (at + after < len(x))]
    return ok, x[ok[:, None] + np.arange(-before, after + 1)] if len(ok) else np.empty((0, before + after + 1))


def remove_beats(signal: DataFrame, beats: DataFrame, keys: Sequence[str], method: str, before: int, after: int, rank: int = 1, idx: str = "sample_idx") -> DataFrame:
    """Beats removed per channel by ``svd`` (leading components of the beat epochs) or ``correlation`` (template where
    the correlation passes an adaptive threshold, mirrored neighbours in its place): keys, idx, value.
    """
    if method not in ("svd", "correlation"):
        raise ValueError(f"unknown method {method}")
    kinds = dict(signal.dtypes)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[[*keys, idx, "value"]] if len(left) else left.reindex(columns=[*keys, idx, "value"])
        left = left.sort_values(idx)
        x, base = left["value"].to_numpy(float).copy(), int(left[idx].iloc[0])
        at, e = _epochs(x, np.sort(right["_beat"].to_numpy()) - base, before, after)
        if len(at) > rank:
            if method == "svd":
                level = e[:, [0, -1]].mean(axis=1, keepdims=True)
                u, s, v = np.linalg.svd(e - level, full_matrices=False)
                e = e - (u[:, :rank] * s[:rank]) @ v[:rank]
                for c, row in zip(at, e):
                    x[c - before : c + after + 1] = row
            else:
                t = np.median(e, axis=0)
                r = np.array([np.corrcoef(t, row)[0, 1] if row.std() > 0 and t.std() > 0 else 0.0 for row in e])
                cut = max(0.5, np.median(r) - 2 * r.std())
                n = before + after + 1
                for c, hit in zip(at, r >= cut):
                    lo = c - before
                    if hit and lo >= n:
                        x[lo : lo + n] = x[lo - n : lo][::-1]
        return left[[*keys, idx]].assign(value=x)

    # New names, since both sides may come from one table.
    marks = beats.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(idx).alias("_beat"))
    return signal.select(*keys, idx, "value").groupBy(*keys).cogroup(marks.groupBy(*(f"_k{i}" for i in range(len(keys))))).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"{idx} {kinds[idx]}, value double"]))


def choose_polarity(signal: DataFrame, keys: Sequence[str], height: float, distance: int, idx: str = "sample_idx") -> DataFrame:
    """Peaks of the z-scored signal in the polarity with more of them, then the higher mean height."""
    from tracewell.operators.transforms import zscore

    z = zscore(signal.select(*keys, idx, "value"), keys)
    up = find_peaks(z, keys, height, distance, idx=idx).withColumn("polarity", F.lit(1))
    down = find_peaks(z.withColumn("value", -F.col("value")), keys, height, distance, idx=idx).withColumn("polarity", F.lit(-1))
    both = up.unionByName(down)
    best = both.groupBy(*keys, "polarity").agg(F.count("*").alias("_n"), F.avg("score").alias("_m")).groupBy(*keys).agg(F.max_by("polarity", F.struct("_n", "_m", "polarity")).alias("polarity"))
    return meet(both, best, [*keys, "polarity"], "left_semi")
