"""Beats found by sliding correlation with a template and replaced by their mirrored neighbours.

The normalised cross-correlation is computed in blocks with a halo: window means and variances by prefix sums, products by FFT. Only its local maxima leave a
block. Their threshold is the lowest of evenly spaced levels at which nearly all neighbours are a plausible distance apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.artifacts import beat_template
from tracewell.operators.buckets import Scan, by_size, scan
from tracewell.operators.intervals import meet
from tracewell.operators.spectral import blocks


def sliding_correlation(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Pearson correlation of the template with x[i : i + n] for each i; NaN where the stretch holds a NaN or is flat."""
    n = len(template)
    if len(x) < n:
        return np.empty(0)
    gaps = np.isnan(x)
    y = np.where(gaps, 0.0, x - (np.median(x[~gaps]) if not gaps.all() else 0.0))
    t = template - template.mean()
    width = 1 << int(np.ceil(np.log2(len(y) + n)))
    dot = np.fft.irfft(np.fft.rfft(y, width) * np.conj(np.fft.rfft(t, width)), width)[: len(y) - n + 1]
    # In extended precision, so that a jump elsewhere in the block does not cost the digits of a quiet stretch.
    sums = [np.cumsum(np.r_[0, v.astype(np.longdouble)]) for v in (y, y.astype(np.longdouble) ** 2, gaps)]
    s1, s2, lost = (c[n:] - c[:-n] for c in sums)
    spread = np.sqrt(np.maximum(s2 - s1 * s1 / n, 0) * (t @ t)).astype(float)
    # A stretch whose spread is rounding alone is flat.
    flat = (spread <= 1e-7 * np.sqrt(np.maximum(s2, 0) * (t @ t)).astype(float)) | (lost > 0)
    return np.where(flat, np.nan, dot / np.where(flat, 1.0, spread))


def correlation_peaks(signal: DataFrame, templates: DataFrame, keys: Sequence[str], idx: str = "sample_idx", size: int = 65536, longest: int = 4096) -> DataFrame:
    """Local maxima of the correlation of each trace with its template: keys, idx, r.

    templates: keys, template (array of at most ``longest`` numbers, one row for each key). ``idx`` is where the template's largest
    absolute value lies. Stretches with NULL or absent samples have no correlation; traces without a template have no peaks.
    """
    if longest < 2:
        raise ValueError("a template has two numbers or more")
    kinds = dict(signal.dtypes)
    samples = blocks(signal.select(*keys, idx, "value"), keys, size, longest + 1, idx)
    arrays = samples.groupBy(*keys, "block").agg(F.collect_list(F.struct(F.col(idx).cast("long").alias("i"), "value")).alias("_x"))
    met = meet(arrays, templates.select(*keys, "template"), keys)

    def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                block, x, t = (batch.column(c)[n] for c in ("block", "x", "template"))
                t = t.values.to_numpy(zero_copy_only=False).astype(float)
                if not 2 <= len(t) <= longest:
                    raise ValueError(f"a template has {len(t)} numbers")
                at, values = x.values.field("i").to_numpy(), x.values.field("value").to_numpy(zero_copy_only=False).astype(float)
                x = np.full(at.max() - at.min() + 1, np.nan)
                x[at - at.min()] = values
                r = np.nan_to_num(sliding_correlation(x, t), nan=-2.0)
                top = np.flatnonzero((r > np.r_[-2.0, r[:-1]]) & (r >= np.r_[r[1:], -2.0])) if len(r) else np.empty(0, int)
                place = top + at.min() + int(np.argmax(np.abs(t)))
                core = place // size == block.as_py()
                own = [batch.column(k).take(pa.array([n] * int(core.sum()), pa.int32())) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(place[core], pa.int64()), pa.array(r[top[core]])], names=[*keys, idx, "r"])

    # A maximum needs its neighbours, which the halo holds.
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{idx}` long, r double"])
    return met.select(*keys, "block", F.col("_x").alias("x"), "template").mapInArrow(peaks, schema)


def adaptive_threshold(peaks: DataFrame, keys: Sequence[str], least: int, most: int, pass_rate: float = 0.95, tries: int = 100, idx: str = "sample_idx", size: int = 65536) -> DataFrame:
    """keys, threshold: the lowest of ``tries`` levels, from the 60th percentile of the peaks' heights up to the highest, at which more than ``pass_rate`` of
    the distances between neighbouring peaks lie between ``least`` and ``most`` samples. Keys without such a level are left out.
    """
    span = peaks.groupBy(*keys).agg(F.percentile("r", 0.6).alias("_from"), F.max("r").alias("_to"))
    p = meet(peaks.select(*keys, idx, "r"), span, keys).withColumn("_step", (F.col("_to") - F.col("_from")) / tries).where("r >= _from")
    reached = F.least(F.lit(tries - 1), F.coalesce(F.floor(F.try_divide(F.col("r") - F.col("_from"), F.nullif("_step", F.lit(0.0)))), F.lit(0))).cast("int")
    p = p.withColumn("level", F.explode(F.sequence(F.lit(0), reached)))
    p = scan(p, [*keys, "level"], [idx], by_size(idx, size), {"_before": Scan(F.col(idx), "near", own=False)})
    far = F.col(idx) - F.col("_before")
    tested = p.groupBy(*keys, "level").agg(F.count(far).alias("_n"), F.sum(far.between(least, most).cast("int")).alias("_ok"), F.min(F.col("_from") + F.col("level") * F.col("_step")).alias("_at"))
    return tested.where(F.col("_ok") > F.col("_n") * pass_rate).groupBy(*keys).agg(F.min("_at").alias("threshold"))


def found_beats(peaks: DataFrame, keys: Sequence[str], least: int, most: int, pass_rate: float = 0.95, tries: int = 100, idx: str = "sample_idx", size: int = 65536) -> DataFrame:
    """Peaks that reach their key's threshold: keys, idx, r, threshold."""
    return meet(peaks, adaptive_threshold(peaks, keys, least, most, pass_rate, tries, idx, size), keys).where(F.col("r") >= F.col("threshold"))


def mirror_replace(signal: DataFrame, beats: DataFrame, keys: Sequence[str], before: DataFrame, idx: str = "sample_idx") -> DataFrame:
    """Samples around each beat replaced by those beside them in reverse: up to the beat by what lies before it, after the beat by what follows.

    before: keys, before, after (samples on both sides). A sample of two beats takes the later one's; beyond the ends of a trace its end samples stand.
    """
    near = meet(beats.select(*keys, F.col(idx).alias("_b")), before, keys)
    near = near.withColumn("_p", F.explode(F.sequence(F.col("_b") - F.col("before"), F.col("_b") + F.col("after"))))
    start, end = F.col("_b") - F.col("before"), F.col("_b") + F.col("after") + 1
    near = near.withColumn("_from", F.when(F.col("_p") <= F.col("_b"), 2 * start - 1 - F.col("_p")).otherwise(2 * end - 1 - F.col("_p")))
    near = near.groupBy(*keys, "_p").agg(F.max_by("_from", "_b").alias("_from"))
    ends = signal.groupBy(*keys).agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi"))
    near = meet(near, ends, keys).withColumn("_from", F.least(F.greatest("_from", "_lo"), "_hi"))
    taken = meet(near, signal.select(*keys, F.col(idx).alias("_from"), F.col("value").alias("_v")), [*keys, "_from"]).select(*keys, F.col("_p").alias(idx), "_v", F.lit(True).alias("_hit"))
    return meet(signal, taken, [*keys, idx], "left").withColumn("value", F.when(F.col("_hit"), F.col("_v")).otherwise(F.col("value"))).drop("_v", "_hit")


def remove_by_correlation(signal: DataFrame, templates: DataFrame, keys: Sequence[str], least: int, most: int, pass_rate: float = 0.95, idx: str = "sample_idx", size: int = 65536, longest: int = 4096, tries: int = 100) -> DataFrame:
    """Signal with its beats replaced: beats found with a first template give their average as the second, and what correlates with that goes.

    templates: keys, template. Traces without a template, or whose peaks keep no plausible distance, stay as they are. NULL keys are a key.
    """

    def found(t: DataFrame) -> DataFrame:
        return found_beats(correlation_peaks(signal, t, keys, idx, size, longest), keys, least, most, pass_rate, tries, idx, size)

    def reach(t: DataFrame) -> DataFrame:
        top = F.array_position(F.transform("template", F.abs), F.array_max(F.transform("template", F.abs))).cast("int")
        return t.select(*keys, (top - 1).alias("before"), (F.size("template") - top).alias("after"))

    first = found(templates)
    sides = reach(templates).agg(F.max("before"), F.max("after")).first()
    if sides[0] is None:
        return signal
    mean = beat_template(signal, first, keys, int(sides[0]), int(sides[1]), idx)
    second = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "template"))), lambda s: s.template).alias("template"))
    return mirror_replace(signal, found(second), keys, reach(second), idx)
