"""Prominence of peaks by the nearest higher sample on both sides, in blocks of a trace.

Within a block a stack finds for each sample the nearest higher one and the least value on the way. Few peaks see no higher sample in their own
block; for them the blocks' extremes tell which other block holds it, and that block is asked once. So no task holds more than a block or
a trace's extremes by block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.buckets import Scan, by_size, scan
from tracewell.operators.intervals import meet
from tracewell.storage import keep

#: Blocks whose open peaks are searched together.
_SLICE = 4096


def nearest_higher(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample: the least value from behind the nearest higher sample before it up to itself, and whether there is such a sample."""
    low, found, stack = np.empty(len(x)), np.zeros(len(x), bool), []
    for i, v in enumerate(x.tolist()):
        least = v
        while stack and stack[-1][0] <= v:
            least = min(least, stack.pop()[1])
        low[i], found[i] = least, bool(stack)
        stack.append((v, least))
    return low, found


def nearest_block(least: np.ndarray, most: np.ndarray, first: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (first, v): the last block before ``first`` whose most is over v (-1: none), and the least value of those passed (infinity: none).

    Extremes of 1, 2, 4 ... blocks up to each one; a search skips the longest stretches first.
    """
    lows, highs = [least], [most]
    while 1 << len(lows) <= len(least):
        step = 1 << len(lows) - 1
        for t, join in ((lows, np.minimum), (highs, np.maximum)):
            last = t[-1].copy()
            last[step:] = join(t[-1][step:], t[-1][:-step])
            t.append(last)
    end, passed = np.asarray(first, np.int64).copy(), np.full(len(v), np.inf)
    for level in range(len(lows) - 1, -1, -1):
        skip = (end >= 1 << level) & (highs[level][end - 1] <= v)
        passed = np.where(skip, np.minimum(passed, lows[level][end - 1]), passed)
        end[skip] -= 1 << level
    return end - 1, passed


def _fields(cell: pa.ListScalar, *names: str) -> list[np.ndarray]:
    """Fields of an array of structs as arrays."""
    return [cell.values.field(c).to_numpy(zero_copy_only=False) for c in names]


def _taken(batch: pa.RecordBatch, keys: Sequence[str], n: int, times: int) -> list[pa.Array]:
    return [batch.column(k).take(pa.array([n] * times, pa.int32())) for k in keys]


def prominences(signal: DataFrame, keys: Sequence[str], idx: str = "sample_idx", size: int = 65536) -> DataFrame:
    """Local maxima with their prominence: keys, idx, value, prominence.

    A maximum is higher than the sample before it and not lower than the one after; end samples are none. Its prominence is its height over the
    higher of the two least values between it and the nearest strictly higher sample, or the end of the trace, on each side. NULL samples
    are passed over; NULL keys are a key.
    """
    kinds = dict(signal.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    own = signal.where(F.col("value").isNotNull()).select(*keys, F.col(idx).cast("long").alias("_i"), F.col("value").cast("double").alias("_v"))
    near = {"_p": Scan(F.col("_v"), "near", own=False), "_n": Scan(F.col("_v"), "near", after=True, own=False)}
    flagged = scan(own, keys, ["_i"], by_size("_i", size), near)
    flagged = flagged.withColumn("_top", F.coalesce((F.col("_v") > F.col("_p")) & (F.col("_v") >= F.col("_n")), F.lit(False)))
    blocks = keep(flagged.groupBy(*keys, by_size("_i", size).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_i", "_v", "_top"))).alias("_x"), F.min("_v").alias("_min"), F.max("_v").alias("_max")), "blocks")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, block in enumerate(batch.column("_block").to_pylist()):
                at, v, top = _fields(batch.column("_x")[n], "_i", "_v", "_top")
                own = np.flatnonzero(top)
                for side, turn in ((-1, slice(None)), (1, slice(None, None, -1))):
                    low, found = (a[turn][own] for a in nearest_higher(v[turn]))
                    yield pa.RecordBatch.from_arrays(
                        [*_taken(batch, keys, n, len(own)), pa.array([block] * len(own), pa.int64()), pa.array(at[own], pa.int64()), pa.array(v[own], pa.float64()), pa.array([side] * len(own), pa.int32()), pa.array(low, pa.float64()), pa.array(found)],
                        names=[*keys, "_block", "_i", "_v", "side", "low", "found"],
                    )

    sides = keep(blocks.mapInArrow(local, f"{head}, _block long, _i long, _v double, side int, low double, found boolean"), "sides")
    extremes = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_min", "_max"))).alias("_all"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block that holds the nearest higher sample, and the least value of the blocks on the way."""
        for batch in batches:
            for n in range(batch.num_rows):
                number, least, most = _fields(batch.column("_all")[n], "_block", "_min", "_max")
                block, at, v, side, low = _fields(batch.column("_open")[n], "_block", "_i", "_v", "side", "low")
                here, low, there = np.searchsorted(number, block), low.copy(), np.full(len(at), -1)
                for way, turn in ((-1, slice(None)), (1, slice(None, None, -1))):
                    own = np.flatnonzero(side == way)
                    first = here[own] if way < 0 else len(number) - 1 - here[own]
                    place, passed = nearest_block(least[turn], most[turn], first, v[own])
                    low[own] = np.minimum(low[own], passed)
                    there[own] = place if way < 0 else np.where(place < 0, -1, len(number) - 1 - place)
                target = pa.array(number[there], pa.int64(), mask=there < 0)
                yield pa.RecordBatch.from_arrays([*_taken(batch, keys, n, len(at)), pa.array(at, pa.int64()), pa.array(v), pa.array(side, pa.int32()), pa.array(low), target], names=[*keys, "_i", "_v", "side", "low", "_block"])

    # Peaks ask by slices of blocks: a record's extremes are read once a slice.
    still = sides.where("not found").groupBy(*keys, by_size("_block", _SLICE).alias("_slice")).agg(F.collect_list(F.struct("_block", "_i", "_v", "side", "low")).alias("_open"))
    asked = keep(meet(still, extremes, keys).mapInArrow(across, f"{head}, _i long, _v double, side int, low double, _block long"), "asked")
    questions = asked.where("_block is not null").groupBy(*keys, "_block").agg(F.collect_list(F.struct("_i", "_v", "side", "low")).alias("_asked"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least value between a block's end and its sample that is higher than the peak that asks."""
        for batch in batches:
            for n, rows in enumerate(batch.column("_asked").to_pylist()):
                (v,) = _fields(batch.column("_x")[n], "_v")
                tables = {side: (np.maximum.accumulate(y), np.minimum.accumulate(y)) for side, y in ((-1, v[::-1]), (1, v))}
                lows = []
                for r in rows:
                    high, low = tables[r["side"]]
                    passed = int(np.searchsorted(high, r["_v"], "right"))  # samples that are not higher
                    lows.append(min(r["low"], low[passed - 1]) if passed else r["low"])
                cols = [pa.array([r[c] for r in rows], k) for c, k in (("_i", pa.int64()), ("_v", pa.float64()), ("side", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*_taken(batch, keys, n, len(rows)), *cols, pa.array(lows, pa.float64())], names=[*keys, "_i", "_v", "side", "low"])

    answered = meet(questions, blocks.select(*keys, "_block", "_x"), [*keys, "_block"]).mapInArrow(answer, f"{head}, _i long, _v double, side int, low double")
    done = sides.where("found").drop("found", "_block").unionByName(asked.where("_block is null").drop("_block")).unionByName(answered)
    return done.groupBy(*keys, F.col("_i").cast(kinds[idx]).alias(idx), F.col("_v").alias("value")).agg((F.col("value") - F.max("low")).alias("prominence"))
