"""Moving means, medians and Gaussian weights with edge modes, over short axes in the JVM and over long traces in blocks.

Positions are whole numbers from 0. Edge modes put copies of a trace's own samples beyond its ends: ``nearest`` (the end sample),
``reflect`` (the end sample twice), ``mirror`` (the end sample once), ``wrap`` (the other end), or ``constant`` (``cval``); without a mode the frame is cut at the ends.
NULL samples are left out of a frame, and a frame without samples gives NULL.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.intervals import dealt, reduce_and

MODES = ("nearest", "reflect", "mirror", "constant", "wrap")
#: Samples of a block of a long trace.
BLOCK = 65536


def _copies(p: Column, n: Column, half: int, mode: str) -> Column:
    """Positions beyond the ends (-half to -1, n to n + half - 1) at which the sample at p stands."""
    if mode in ("nearest", "constant"):
        low, high = F.sequence(F.lit(-half), F.lit(-1)), F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: n + i)
        none = F.array().cast("array<int>")
        return F.concat(F.when(p == 0, low).otherwise(none), F.when(p == n - 1, high).otherwise(none))
    period = n if mode == "wrap" else 2 * n if mode == "reflect" else F.greatest(F.lit(1), 2 * n - 2)
    turns = F.sequence(-F.ceil(F.lit(half) / period).cast("int") - 1, F.ceil((n + half) / period).cast("int") + 1)
    at = F.transform(turns, lambda k: p + k * period)
    if mode != "wrap":
        at = F.array_distinct(F.concat(at, F.transform(turns, lambda k: k * period - p - (1 if mode == "reflect" else 0))))
    return F.filter(at, lambda t: t.between(-half, -1) | t.between(n, n + half - 1))


def with_edges(cells: DataFrame, keys: Sequence[str], half: int, mode: str, pos: str = "t_pos", cval: float = 0.0, whole: bool = False) -> DataFrame:
    """cells and copies of their rows up to ``half`` positions beyond both ends of each trace (column edge: whether a row is one).

    Only rows within reach of an end are copied, however long a trace is; traces shorter than ``half`` are repeated as often as it takes. ``whole``: the traces
    stand in one partition each (``intervals.dealt``), and their ends are found there.
    """
    if mode not in MODES:
        raise ValueError(f"unknown edge mode {mode}")
    if whole:
        met = cells.withColumn("_n", (F.max(pos).over(Window.partitionBy(*keys)) + 1).cast("int"))
    else:
        ends = cells.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg((F.max(pos) + 1).cast("int").alias("_n"))
        met = cells.join(ends, reduce_and([cells[k].eqNullSafe(ends[f"_k{i}"]) for i, k in enumerate(keys)])).select(*(cells[c] for c in cells.columns), "_n")
    near = (F.col(pos) <= half) | (F.col(pos) >= F.col("_n") - 1 - half)
    none = F.array().cast("array<int>")
    copies = F.when(near, _copies(F.col(pos).cast("int"), F.col("_n"), half, mode)).otherwise(none)
    # A row's own place is the NULL before its copies' places.
    met = met.withColumn("_to", F.explode(F.concat(F.array(F.lit(None).cast("int")), copies)))
    kinds, edge = dict(cells.dtypes), F.col("_to").isNotNull()
    value = F.when(edge, F.lit(float(cval))).otherwise(F.col("value")) if mode == "constant" else F.col("value")
    return met.select(*(F.coalesce("_to", pos).cast(kinds[c]).alias(c) if c == pos else value.cast(kinds[c]).alias(c) if c == "value" else F.col(f"`{c}`") for c in cells.columns), edge.alias("edge"))


def _padded(cells: DataFrame, keys: Sequence[str], half: int, mode: str | None, pos: str, cval: float, whole: bool = False) -> DataFrame:
    """Cells with their edges and the weight that a row has in a frame's total: 1, or for constant edges their value, as for a signal of ones."""
    rows = with_edges(cells, keys, half, mode, pos, cval, whole) if mode and half else cells.withColumn("edge", F.lit(False))
    weight = F.when(F.col("edge"), F.lit(float(cval))).otherwise(1.0) if mode == "constant" else F.lit(1.0)
    return rows.withColumn("_w", F.when(F.col("value").isNotNull(), weight))


def _in_blocks(rows: DataFrame, columns: list[tuple[str, str]], keys: Sequence[str], half: int, pos: str, block: int, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """fn(values, weights), NaN where a position holds nothing, on each block of a trace and ``half`` positions on both sides."""
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col(pos) - half) / block)), F.floor((F.col(pos) + half) / block))
    dealt = rows.withColumn("_block", F.explode(F.when(F.col(pos) + half >= 0, reach)))
    names = [c for c, _ in columns]
    inner = [c for c in names if c not in keys]
    schema = ", ".join([*(f"`{c}` {k}" for c, k in columns), "smooth double"])
    packed = dealt.groupBy(*keys, "_block").agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in inner), "edge", "_w")).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, flat = batch.column("_x").value_lengths().to_numpy(), batch.column("_x").flatten()
            of, edges = np.repeat(np.arange(len(size)), size), np.cumsum(np.r_[0, size])
            at, x, w, edge = (flat.field(c).to_numpy(zero_copy_only=False) for c in (pos, "value", "_w", "edge"))
            at, x, smooth = at.astype(np.int64), x.astype(float), np.empty(len(at))
            for s, e in zip(edges[:-1], edges[1:]):
                place = at[s:e] - at[s:e].min()
                whole = np.full((2, place.max() + 1), np.nan)
                whole[:, place] = x[s:e], w[s:e]
                smooth[s:e] = fn(*whole)[place]
            own = np.flatnonzero(~edge.astype(bool) & (at // block == batch.column("_block").to_numpy()[of]))
            near = pa.array(own)
            cells = [batch.column(c).take(pa.array(of[own])) if c in keys else flat.field(c).take(near) for c in names]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(smooth[own])], names=[*names, "smooth"])

    return packed.mapInArrow(run, schema).withColumn("smooth", F.nanvl("smooth", F.lit(None).cast("double")))


def sliding_median(values: Sequence[float], half: int) -> np.ndarray:
    """Median of values[i - half : i + half + 1] for each i, NaN left out and for a frame without others.

    The frame is a sorted list: each sample enters and leaves it once, by bisection.
    """
    n, frame, out = len(values), [], np.full(len(values), np.nan)
    for i in range(n + half):
        if i < n and values[i] == values[i]:
            insort(frame, values[i])
        gone = i - 2 * half - 1
        if gone >= 0 and values[gone] == values[gone]:
            del frame[bisect_left(frame, values[gone])]
        if i >= half and frame:
            m = len(frame) // 2
            out[i - half] = frame[m] if len(frame) % 2 else (frame[m - 1] + frame[m]) / 2
    return out


def moving_median(cells: DataFrame, keys: Sequence[str], half: int, pos: str = "t_pos", mode: str | None = None, cval: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Moving median over ``half`` positions on both sides (column smooth)."""
    return _in_blocks(_padded(cells, keys, half, mode, pos, cval), cells.dtypes, keys, half, pos, block, lambda x, w: sliding_median(x.tolist(), half))


def smooth_median(cells: DataFrame, keys: Sequence[str], size: int, pos: str = "t_pos", mode: str | None = "nearest", cval: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Moving median of an odd kernel (even sizes grow by one)."""
    return moving_median(cells, keys, size // 2, pos, mode, cval, block)


def _weighted(cells: DataFrame, keys: Sequence[str], weights: np.ndarray, pos: str, mode: str | None, cval: float, block: int | None) -> DataFrame:
    """Weighted mean of a frame of odd length; in blocks, or without ``block`` by a window over each trace."""
    half = len(weights) // 2
    rows = _padded(cells if block is not None else dealt(cells, keys), keys, half, mode, pos, cval, block is None)
    if block is not None:

        def mean(x: np.ndarray, w: np.ndarray) -> np.ndarray:
            total = np.convolve(np.nan_to_num(x), weights)[half : half + len(x)]
            share = np.convolve(np.nan_to_num(w), weights)[half : half + len(x)]
            return np.divide(total, share, out=np.full(len(x), np.nan), where=share > 0)

        return _in_blocks(rows, cells.dtypes, keys, half, pos, block, mean)
    w = Window.partitionBy(*keys).orderBy(pos).rangeBetween(-half, half)
    if (weights == weights[0]).all():
        total, share = F.sum("value").over(w), F.sum("_w").over(w)
        rows = rows.withColumns({"_total": total, "_share": share})
    else:
        table = F.array(*(F.lit(float(x)) for x in weights))
        near = F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.col(pos).alias("p"), F.col("value").alias("v"), F.col("_w").alias("w")))).over(w)
        weight = lambda x: F.element_at(table, (x.p - F.col(pos) + half + 1).cast("int"))
        rows = rows.withColumn("_near", near)
        rows = rows.withColumns({"_total": F.aggregate("_near", F.lit(0.0), lambda a, x: a + weight(x) * x.v), "_share": F.aggregate("_near", F.lit(0.0), lambda a, x: a + weight(x) * x.w)})
    return rows.where(~F.col("edge")).withColumn("smooth", F.when(F.col("_share") > 0, F.col("_total") / F.col("_share"))).select(*(F.col(f"`{c}`") for c in cells.columns), "smooth")


def smooth_mean(cells: DataFrame, keys: Sequence[str], half: int, pos: str = "t_pos", mode: str | None = "nearest", cval: float = 0.0, block: int | None = None) -> DataFrame:
    """Moving mean over 2 half + 1 positions (column smooth)."""
    return _weighted(cells, keys, np.ones(2 * half + 1), pos, mode, cval, block)


def smooth_gaussian(cells: DataFrame, keys: Sequence[str], sigma: float, truncate: float = 4.0, pos: str = "t_pos", mode: str | None = "nearest", cval: float = 0.0, block: int | None = None) -> DataFrame:
    """Gaussian weights out to ``truncate`` sigmas (column smooth)."""
    if sigma <= 0 or truncate <= 0:
        raise ValueError("sigma and truncate are above 0")
    r = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return _weighted(cells, keys, weights / weights.sum(), pos, mode, cval, block)
