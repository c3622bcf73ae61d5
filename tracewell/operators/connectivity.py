"""Pair measures from complex coefficients: coherence, phase locking, slope index, directed scores.

Input is ``spectral.morlet`` output. Pairs are formed by equi joins on frequency and time; windowed means
are window functions over time. Every measure of a pair set comes out of one plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.crossspectra import slices
from tracewell.operators.intervals import meet

MEASURES = ("coh", "plv", "ciplv", "pli", "wpli")


def pair_products(coef: DataFrame, pairs: DataFrame, keys: Sequence[str], channel: str = "channel", idx: str = "sample_idx") -> DataFrame:
    """Cross spectra of channel pairs (a, b): keys, a, b, f_pos, freq, idx, re, im, pa, pb."""
    cols = [*keys, "f_pos", "freq", idx]
    p = pairs.select("a", "b")
    x = coef.join(p, coef[channel] == p["a"]).select(*cols, "a", "b", F.col("re").alias("_ra"), F.col("im").alias("_ia"), F.col("power").alias("pa"))
    y = coef.select(*keys, "f_pos", idx, F.col(channel).alias("b"), F.col("re").alias("_rb"), F.col("im").alias("_ib"), F.col("power").alias("pb"))
    met = meet(x, y, [*keys, "f_pos", idx, "b"])
    return met.select(*cols, "a", "b", (F.col("_ra") * F.col("_rb") + F.col("_ia") * F.col("_ib")).alias("re"), (F.col("_ia") * F.col("_rb") - F.col("_ra") * F.col("_ib")).alias("im"), "pa", "pb")


def _measures(mean) -> dict[str, Column]:
    r = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    # Parts below rounding of the product count as no phase difference.
    im = F.when(F.abs("im") > 1e-12 * r, F.col("im")).otherwise(0.0)
    c, s = mean(F.try_divide("re", r)), mean(F.try_divide(im, r))
    return {
        "coh": F.try_divide(F.sqrt(mean(F.col("re")) ** 2 + mean(F.col("im")) ** 2), F.sqrt(mean(F.col("pa")) * mean(F.col("pb")))),
        "plv": F.sqrt(c**2 + s**2),
        "ciplv": F.try_divide(F.abs(s), F.nullif(F.sqrt(F.greatest(F.lit(0.0), 1 - c**2)), F.lit(0.0))),
        "pli": F.abs(mean(F.signum(im))),
        "wpli": F.try_divide(F.abs(mean(im)), F.nullif(mean(F.abs(im)), F.lit(0.0))),
    }


def pair_measures(products: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Measures over all times: keys, a, b, f_pos, freq and one column each. NULL where undefined (wpli of a zero-lag copy)."""
    return products.groupBy(*keys, "a", "b", "f_pos", "freq").agg(*(_measures(F.avg)[m].alias(m) for m in measures))


def windowed_measures(products: DataFrame, keys: Sequence[str], half: dict[int, int], measures: Sequence[str] = MEASURES, idx: str = "sample_idx", hop: int = 1) -> DataFrame:
    """Measures in centred windows of half[f_pos] samples, ``hop`` indexes apart, to both sides; NULL where the window leaves the record or lacks a sample.

    Frequencies of equal window length share one plan branch.
    """
    out = None
    for h in sorted(set(half.values())):
        own = products.where(F.col("f_pos").isin([f for f, v in half.items() if v == h]))
        w = Window.partitionBy(*keys, "a", "b", "f_pos").orderBy(idx).rangeBetween(-h * hop, h * hop)
        whole = F.count("re").over(w) == 2 * h + 1
        got = _measures(lambda c, w=w: F.avg(c).over(w))
        part = own.select(*keys, "a", "b", "f_pos", "freq", idx, *(F.when(whole, got[m]).alias(m) for m in measures))
        out = part if out is None else out.unionByName(part)
    return out


def phase_slope(products: DataFrame, keys: Sequence[str], bands: DataFrame) -> DataFrame:
    """Phase slope index per band: the imaginary part of neighbouring coherencies' products, summed over a band.

    bands: band, start, end; segments of one band are merged by their numbers of bins. keys, a, b, band, psi.
    """
    c = products.groupBy(*keys, "a", "b", "f_pos", "freq").agg(F.avg("re").alias("_re"), F.avg("im").alias("_im"), F.sqrt(F.avg("pa") * F.avg("pb")).alias("_n"))
    c = c.withColumns({"_re": F.try_divide("_re", "_n"), "_im": F.try_divide("_im", "_n")})
    seg = F.broadcast(bands.withColumn("_seg", F.monotonically_increasing_id()))
    c = c.join(seg, (F.col("freq") >= F.col("start")) & (F.col("freq") <= F.col("end")))
    w = Window.partitionBy(*keys, "a", "b", "_seg").orderBy("f_pos")
    step = F.col("_re") * F.lead("_im").over(w) - F.col("_im") * F.lead("_re").over(w)
    parts = c.withColumn("_s", step).groupBy(*keys, "a", "b", "band", "_seg").agg(F.sum("_s").alias("_s"), F.count("*").alias("_k"))
    return parts.groupBy(*keys, "a", "b", "band").agg((F.sum(F.col("_s") * F.col("_k")) / F.sum("_k")).alias("psi"))


def _dense(signal: DataFrame, cols: Sequence[str], back: int, size: int, idx: str) -> DataFrame:
    """cols, block, first, values: each block's samples, with ``back`` samples before it, as packed doubles from index ``first`` on; NaN for what is missing."""
    kinds = dict(signal.dtypes)
    i = F.col(idx).cast("long")
    rows = signal.where(F.col(idx).isNotNull()).select(*cols, i.alias("_i"), F.col("value").cast("double").alias("_v"), F.explode(F.sequence(F.floor(i / size), F.floor((i + back) / size))).alias("block"))
    packed = rows.groupBy(*cols, "block").agg(F.collect_list(F.struct("_i", "_v")).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            edges, flat = np.cumsum(np.r_[0, batch.column("_x").value_lengths().to_numpy()]), batch.column("_x").flatten()
            at, value = flat.field("_i").to_numpy(), flat.field("_v").to_numpy(zero_copy_only=False)
            first, out = [], []
            for s, e in zip(edges[:-1], edges[1:]):
                place = at[s:e] - at[s:e].min()
                x = np.full(place.max() + 1, np.nan)
                x[place] = value[s:e]
                first.append(int(at[s:e].min()))
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*cols, "block")), pa.array(first, pa.int64()), pa.array(out, pa.binary())], names=[*cols, "block", "first", "values"])

    return packed.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "block long, first long, values binary"]))


def granger_scores(signal: DataFrame, pairs: DataFrame, keys: Sequence[str], lags: int = 5, channel: str = "channel", idx: str = "sample_idx", size: int = 65536) -> DataFrame:
    """Directed scores log(var restricted / var full) of b given its own past and a's, with time forward (value) and backward (reversed): keys, a, b, value, reversed.

    Lags are steps of the sample index: a stretch of lags + 1 samples counts only if all of them are there, in both channels. Its last sample is explained forward,
    its first backward, so one Gram matrix of all of them holds both. Channels are exchanged as packed blocks; tasks exchange Gram sums alone, and a small least squares
    per pair follows.
    """
    kinds, name = dict(signal.dtypes), dict(pairs.dtypes)
    dense = _dense(signal, [*keys, channel], lags, size, idx)
    p = pairs.select("a", "b").distinct()
    left = dense.join(p, dense[channel] == p["b"]).select(*keys, "block", "a", "b", F.col("first").alias("_fb"), F.col("values").alias("_vb"))
    right = dense.select(*keys, "block", F.col(channel).alias("a"), F.col("first").alias("_fa"), F.col("values").alias("_va"))
    met = meet(left, right, [*keys, "block", "a"])
    n = 2 * lags + 3  # one, b's samples from the last backward, a's
    upper = np.triu_indices(n)
    cells = [f"g{i}_{j}" for i, j in zip(*upper)]

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = np.zeros((batch.num_rows, len(cells)))
            for row, (fb, vb, fa, va) in enumerate(zip(*(batch.column(c) for c in ("_fb", "_vb", "_fa", "_va")))):
                b, a = (np.frombuffer(v.as_buffer()) for v in (vb, va))
                start = max(fb.as_py(), fa.as_py())
                b, a = b[start - fb.as_py() :], a[start - fa.as_py() :]
                m = min(len(a), len(b))
                if m <= lags:
                    continue
                x = np.hstack([np.ones((m - lags, 1)), *(np.lib.stride_tricks.sliding_window_view(v[:m], lags + 1)[:, ::-1] for v in (b, a))])
                x = x[~np.isnan(x).any(axis=1)]
                out[row] = (x.T @ x)[upper]
            some = np.flatnonzero(out[:, 0])
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (*keys, "a", "b")), *(pa.array(out[some, i]) for i in range(len(cells)))], names=[*keys, "a", "b", *cells])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"a {name['a']}, b {name['b']}", *(f"{c} double" for c in cells)])
    total = met.mapInArrow(gram, schema).groupBy(*keys, "a", "b").agg(*(F.sum(c).alias(c) for c in cells))

    @F.pandas_udf("value double, reversed double")
    def score(*parts: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(*parts):
            g = np.zeros((n, n))
            g[upper] = row
            g = g + g.T - np.diag(np.diag(g))

            def of(target, past):
                def residual(k):
                    coef = np.linalg.lstsq(g[np.ix_(k, k)], g[k, target], rcond=None)[0]
                    return max(g[target, target] - coef @ g[k, target], 1e-300)

                own = [0, *past]
                return float(np.log(residual(own) / residual([*own, *(i + lags + 1 for i in past)])))

            out.append((of(1, range(2, lags + 2)), of(lags + 1, range(lags, 0, -1))))
        return pd.DataFrame(out, columns=["value", "reversed"], dtype=float)

    return total.select(*keys, "a", "b", score(*cells).alias("_s")).select(*keys, "a", "b", "_s.value", "_s.reversed")


def granger(signal: DataFrame, pairs: DataFrame, keys: Sequence[str], lags: int = 5, reverse: bool = False, channel: str = "channel", idx: str = "sample_idx") -> DataFrame:
    """``granger_scores`` of one direction of time (``reverse``: backward): keys, a, b, value."""
    return granger_scores(signal, pairs, keys, lags, channel, idx).select(*keys, "a", "b", F.col("reversed" if reverse else "value").alias("value"))
