"""Spectral operators on blocked signals: filters, Welch, Morlet, multitaper, envelopes, bursts.

A signal is cut into blocks with a halo on both sides; blocks are the groups that Arrow
functions work on, so one long recording spreads over many tasks and the result does not depend on
the block size (up to rounding) as long as the halo holds the kernel's support.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewell.operators.intervals import clip, meet, points_in, union_intervals

#: Rows of results after which a block's task hands them on.
_ROWS = 1 << 17


def blocks(signal: DataFrame, keys: Sequence[str], size: int, halo: int, idx: str = "sample_idx") -> DataFrame:
    """Samples with the number of their block; those within ``halo`` of another block are repeated there (core = false)."""
    b = F.floor(F.col(idx) / size)
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col(idx) - halo) / size)), F.floor((F.col(idx) + halo) / size))
    out = signal.withColumn("_b", b).withColumn("block", F.explode(reach))
    return out.withColumn("core", F.col("block") == F.col("_b")).drop("_b")


def _per_block(signal: DataFrame, keys: Sequence[str], size: int, halo: int, fn, out: str, idx: str = "sample_idx") -> DataFrame:
    """fn(values, core mask, indexes) -> tables of new columns (arrays, or one value for all rows), for each key and block.

    fn sees a whole stretch of indexes: values that are NULL, and those of indexes that are absent, are NaN; NaN comes out as NULL.
    Many short traces go through one call of the task's function.
    """
    kept = blocks(signal.select(*keys, idx, "value"), keys, size, halo, idx)
    kinds = dict(signal.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), out])
    form = to_arrow_schema(StructType.fromDDL(out))
    packed = kept.groupBy(*keys, "block").agg(F.collect_list(F.struct(F.col(idx).alias("_i"), F.col("value").cast("double").alias("_v"), "core")).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, flat = np.cumsum(np.r_[0, batch.column("_x").value_lengths().to_numpy()]), batch.column("_x").flatten()
            at, values, inside = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("_i", "_v", "core"))
            tables, of, held = [], [], 0
            for n, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
                first = at[s:e].min()
                place = at[s:e] - first
                x, core = np.full(place.max() + 1, np.nan), np.zeros(place.max() + 1, bool)
                x[place], core[place] = values[s:e], inside[s:e].astype(bool)
                for got in fn(x, core, first + np.arange(len(x))):
                    rows = len(got[idx])
                    tables.append({c: v if isinstance(v, np.ndarray) else np.full(rows, v) for c, v in got.items()})
                    of.append((n, rows))
                    held += rows
                if held >= _ROWS or n == batch.num_rows - 1:
                    cells = [pa.array(np.concatenate([t[f.name] for t in tables]), f.type, from_pandas=True) for f in form] if tables else []
                    own = pa.array(np.repeat(*np.array(of, np.int64).reshape(-1, 2).T))
                    if tables:
                        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in keys), *cells], names=[*keys, *form.names])
                    tables, of, held = [], [], 0

    return packed.mapInArrow(run, schema)


def sinc_taps(rate: float, low: float | None, high: float | None, width: float = 2.0, stop: Sequence[float] = ()) -> np.ndarray:
    """Hamming-windowed band-pass taps of odd length with notches of ``width`` Hz at ``stop``."""
    n = int(3.3 * rate / width) | 1
    t = np.arange(n) - n // 2
    ham = np.hamming(n)

    def lowpass(f):
        h = 2 * f / rate * np.sinc(2 * f / rate * t) * ham
        return h / h.sum()

    delta = (t == 0).astype(float)
    taps = delta if high is None else lowpass(high)
    if low:
        taps = taps - (lowpass(low) if high is None else np.convolve(taps, lowpass(low), "same"))
    for f in stop:
        band = lowpass(f + width / 2) - lowpass(f - width / 2)
        taps = taps - np.convolve(taps, band, "same")
    return taps


def fir_filter(signal: DataFrame, keys: Sequence[str], taps: np.ndarray, size: int = 65536, idx: str = "sample_idx") -> DataFrame:
    """Zero-phase filtering by symmetric taps: keys, idx, value.

    Each stretch without missing samples is filtered by itself, its ends held; a NULL sample stays NULL.
    """
    half = len(taps) // 2

    def run(x, core, at):
        y = np.full(len(x), np.nan)
        edge = np.flatnonzero(np.diff(np.r_[False, ~np.isnan(x), False].astype(np.int8)))
        for s, e in zip(edge[::2], edge[1::2]):
            y[s:e] = np.convolve(np.pad(x[s:e], half, "edge"), taps, "valid")
        return [{idx: at[core], "value": y[core]}]

    return _per_block(signal, keys, size, half, run, f"{idx} long, value double", idx)


def welch(signal: DataFrame, keys: Sequence[str], rate: float, n_fft: int, low: float = 0.0, high: float | None = None, idx: str = "sample_idx") -> DataFrame:
    """Power density by averaged Hann segments (half overlapping): keys, freq, psd.

    Segments are groups of their own; their spectra are averaged by Spark. A recording shorter than one segment has none.
    """
    hop = n_fft // 2
    seg = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(idx) - n_fft + 1) / hop)), F.floor(F.col(idx) / hop)))
    parts = signal.select(*keys, idx, "value", seg.alias("seg"))
    kinds = dict(signal.dtypes)
    win = np.hanning(n_fft + 1)[:-1]
    freq = np.fft.rfftfreq(n_fft, 1 / rate)
    keep = (freq >= low) & (freq <= (high if high is not None else freq[-1]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(idx)["value"].to_numpy(float)
        if len(x) < n_fft:
            return pd.DataFrame({**{k: pdf[k].iloc[:0] for k in keys}, "freq": np.empty(0), "psd": np.empty(0)})
        p = np.abs(np.fft.rfft((x - x.mean()) * win)) ** 2 / (rate * (win**2).sum())
        p[1 : len(p) - (n_fft % 2 == 0)] *= 2
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "freq": freq[keep], "psd": p[keep]})

    spectra = parts.groupBy(*keys, "seg").applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "freq double, psd double"]))
    return spectra.groupBy(*keys, "freq").agg(F.avg("psd").alias("psd"))


def morlet_kernel(f: float, cycles: float, rate: float) -> np.ndarray:
    """Complex Morlet wavelet out to five sigmas, unit energy."""
    sigma = cycles / (2 * math.pi * f)
    n = int(math.ceil(5 * sigma * rate))
    t = np.arange(-n, n + 1) / rate
    w = np.exp(2j * math.pi * f * t) * np.exp(-(t**2) / (2 * sigma**2))
    return w / np.sqrt((np.abs(w) ** 2).sum())


def _convolve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Missing samples add nothing, and their own results are missing; mask_by_radius takes out what lies near them."""
    n = 1 << (len(x) + len(w) - 1).bit_length()
    y = np.fft.ifft(np.fft.fft(np.nan_to_num(x), n) * np.fft.fft(w, n))[len(w) // 2 : len(w) // 2 + len(x)]
    y[np.isnan(x)] = np.nan
    return y


def morlet(signal: DataFrame, keys: Sequence[str], rate: float, freqs: Sequence[float], cycles: Sequence[float], hop: int = 1, size: int = 65536, idx: str = "sample_idx") -> DataFrame:
    """Complex coefficients on a frequency grid every ``hop`` samples: keys, f_pos, freq, idx, re, im, power."""
    kernels = [morlet_kernel(f, c, rate) for f, c in zip(freqs, cycles)]
    halo = max(len(k) for k in kernels) // 2

    def run(x, core, at):
        take = core & (at % hop == 0)
        out = []
        for i, (f, k) in enumerate(zip(freqs, kernels)):
            y = _convolve(x, k)[take]
            out.append({"f_pos": np.int32(i), "freq": float(f), idx: at[take], "re": y.real, "im": y.imag, "power": np.abs(y) ** 2})
        return out

    return _per_block(signal, keys, size, halo, run, f"f_pos int, freq double, {idx} long, re double, im double, power double", idx)


def dpss(n: int, nw: float, k: int) -> np.ndarray:
    """The first k Slepian tapers of length n (eigenvectors of the tridiagonal form)."""
    i = np.arange(n)
    diag = ((n - 1 - 2 * i) / 2) ** 2 * math.cos(2 * math.pi * nw / n)
    off = i[1:] * (n - i[1:]) / 2
    _, v = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    return v[:, ::-1][:, :k].T


def multitaper(signal: DataFrame, keys: Sequence[str], rate: float, freqs: Sequence[float], cycles: Sequence[float], bandwidth: float = 4.0, hop: int = 1, size: int = 65536, idx: str = "sample_idx") -> DataFrame:
    """Power by Slepian tapers of length cycles / freq, averaged over tapers: keys, f_pos, freq, idx, power."""
    kernels = []
    for f, c in zip(freqs, cycles):
        n = max(3, int(round(c / f * rate)) | 1)
        t = (np.arange(n) - n // 2) / rate
        kernels.append([h * np.exp(2j * math.pi * f * t) for h in dpss(n, bandwidth / 2, max(1, int(bandwidth - 1)))])
    halo = max(len(k[0]) for k in kernels) // 2

    def run(x, core, at):
        take = core & (at % hop == 0)
        return [{"f_pos": np.int32(i), "freq": float(f), idx: at[take], "power": np.mean([np.abs(_convolve(x, h)) ** 2 for h in k], axis=0)[take]} for i, (f, k) in enumerate(zip(freqs, kernels))]

    return _per_block(signal, keys, size, halo, run, f"f_pos int, freq double, {idx} long, power double", idx)


def average_epochs(tensor: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean power over epochs and inter-trial coherence (modulus of the mean unit phasor)."""
    r = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    return tensor.groupBy(*keys).agg(F.avg("power").alias("power"), F.sqrt(F.avg(F.try_divide("re", r)) ** 2 + F.avg(F.try_divide("im", r)) ** 2).alias("itc"))


def envelope(signal: DataFrame, keys: Sequence[str], rate: float, bands: Sequence[tuple[str, float, float]], size: int = 65536, halo_s: float = 2.0, idx: str = "sample_idx") -> DataFrame:
    """Analytic amplitude per band: keys, band, idx, value. Segments of one band join as the root of summed squares.

    A band is cut out by complex taps, a Hamming-windowed low-pass of half its width shifted to its centre, which pass
    positive frequencies alone and reach ``halo_s`` to both sides. So blocks of any size give the same result.
    """
    names = list(dict.fromkeys(b[0] for b in bands))
    halo = int(halo_s * rate)
    t = np.arange(-halo, halo + 1) / rate

    def taps(lo: float, hi: float) -> np.ndarray:
        low = (hi - lo) / rate * np.sinc((hi - lo) * t) * np.hamming(len(t))
        return 2 * low * np.exp(1j * math.pi * (lo + hi) * t)

    kernels = {name: [taps(lo, hi) for b, lo, hi in bands if b == name] for name in names}

    def run(x, core, at):
        out = []
        for name in names:
            total = sum(np.abs(_convolve(x, k)) ** 2 for k in kernels[name])
            out.append({"band": name, idx: at[core], "value": np.sqrt(total)[core]})
        return out

    return _per_block(signal, keys, size, halo, run, f"band string, {idx} long, value double", idx)


def thresholds(env: DataFrame, keys: Sequence[str], percentile: float, baseline: DataFrame | None = None, idx: str = "sample_idx", fallback: str = "full") -> DataFrame:
    """Percentile per key (channel, band) over baseline samples: keys, threshold.

    baseline: (record keys in common with env, start, end) in samples; without any overlap for a key, all its samples
    (``fallback="full"``) or an error (``"raise"``).
    """
    if fallback not in ("full", "raise"):
        raise ValueError(f"unknown fallback {fallback}")
    p = percentile / 100
    if baseline is None:
        return env.groupBy(*keys).agg(F.percentile("value", p).alias("threshold"))
    on = [c for c in baseline.columns if c in env.columns and c not in ("start", "end")]
    marks = meet(env, baseline.select(*on, "start", "end"), on, "left")
    flagged = marks.groupBy(*keys, idx, "value").agg(F.max(F.coalesce(F.col(idx).between(F.col("start"), F.col("end")), F.lit(False))).alias("_in"))
    own, every = F.percentile(F.when(F.col("_in"), F.col("value")), p), F.percentile("value", p)
    if fallback == "full":
        return flagged.groupBy(*keys).agg(F.coalesce(own, every).alias("threshold"))
    out = flagged.groupBy(*keys).agg(own.alias("threshold"), F.max("_in").alias("_some"))
    return out.withColumn("threshold", F.when(F.col("_some"), F.col("threshold")).otherwise(F.raise_error(F.lit("no sample of a baseline label")).cast("double"))).drop("_some")


def label_samples(annotations: DataFrame, keys: Sequence[str], labels: Sequence[str], rate: float, mode: str = "substring") -> DataFrame:
    """Sample ranges (start, end, both within) of annotations (label, start, end in seconds) that a label matches; points stand for one sample's length."""
    if mode not in ("substring", "exact"):
        raise ValueError(f"unknown mode {mode}")
    text = F.trim(F.lower("label"))
    hit = F.lit(False)
    for name in labels:
        hit = hit | (text == name.lower() if mode == "exact" else F.contains(text, F.lit(name.lower())))
    end = F.when(F.col("end") <= F.col("start"), F.col("start") + 1 / rate).otherwise(F.col("end"))
    at = lambda t: F.greatest(F.lit(0), F.bround(t * rate)).cast("long")
    return annotations.where(hit).select(*keys, at(F.col("start")).alias("start"), at(end).alias("end"))


def guarded(edges: DataFrame, keys: Sequence[str], guard_s: float, low: Column, high: Column) -> DataFrame:
    """Edge spans in seconds widened by a guard on both sides, such as a filter's length ``len(taps) / rate``, cut to the record and merged."""
    return union_intervals(clip(edges, low, high, max(0.0, guard_s)), keys)

def burst_mask(env: DataFrame, limits: DataFrame, keys: Sequence[str], centres: dict[str, float], rate: float, min_cycles: float, guard: int = 0, idx: str = "sample_idx", edges: DataFrame | None = None) -> DataFrame:
    """Samples over their threshold in runs of at least ceil(cycles * rate / centre): keys, idx, burst.

    Samples within ``guard`` of the record's ends are no bursts, nor are those within ``edges`` (record keys, start, end in samples, both within).
    """
    need = F.create_map(*(F.lit(x) for b, f in centres.items() for x in (b, int(math.ceil(min_cycles * rate / f)))))
    ends = Window.partitionBy(*keys)
    df = meet(env, limits, keys).withColumns({"_lo": F.min(idx).over(ends), "_hi": F.max(idx).over(ends)})
    on = (F.col("value") > F.col("threshold")) & F.col(idx).between(F.col("_lo") + guard, F.col("_hi") - guard)
    if edges is not None:
        own = [c for c in edges.columns if c in keys]
        bad = points_in(df.select(*own, idx).distinct(), edges, own, idx).withColumn("_bad", F.lit(True))
        df, on = meet(df, bad, [*own, idx], "left"), on & F.col("_bad").isNull()
    run = F.col(idx) - F.row_number().over(Window.partitionBy(*keys, "_on").orderBy(idx))
    df = df.withColumn("_on", on).withColumn("_run", run)
    n = F.count("*").over(Window.partitionBy(*keys, "_on", "_run"))
    return df.withColumn("_n", n).select(*keys, idx, (F.col("_on") & (F.col("_n") >= need[F.col("band")])).alias("burst"))


def aperiodic_fit(spectra: DataFrame, keys: Sequence[str], freq: str = "freq", power: str = "power") -> DataFrame:
    """Log-log line per key, refitted on the points below its first residuals: offset, exponent, r2, n.

    Two rounds of regression aggregates, no iterative solver.
    """
    x, y = F.log10(freq), F.log10(power)
    df = spectra.where((F.col(freq) > 0) & (F.col(power) > 0)).select(*keys, freq, power, x.alias("_x"), y.alias("_y"))
    w = Window.partitionBy(*keys)
    first = df.withColumns({"_s": F.regr_slope("_y", "_x").over(w), "_i": F.regr_intercept("_y", "_x").over(w)})
    first = first.withColumn("_r", F.col("_y") - F.col("_i") - F.col("_s") * F.col("_x"))
    low = first.withColumn("_cut", F.percentile("_r", 0.75).over(w)).where("_r <= _cut")
    return low.groupBy(*keys).agg(F.regr_intercept("_y", "_x").alias("offset"), (-F.regr_slope("_y", "_x")).alias("exponent"), F.regr_r2("_y", "_x").alias("r2"), F.count("*").alias("n"))


def periodic_part(spectra: DataFrame, fits: DataFrame, keys: Sequence[str], freq: str = "freq", power: str = "power") -> DataFrame:
    """log10 power over the aperiodic line, and whether the bin is a local peak of it."""
    out = meet(spectra, fits.select(*keys, "offset", "exponent"), keys)
    out = out.withColumn("periodic", F.when(F.col(power) > 0, F.log10(power)) - (F.col("offset") - F.col("exponent") * F.log10(freq)))
    w = Window.partitionBy(*keys).orderBy(freq)
    return out.withColumn("is_peak", F.coalesce((F.col("periodic") > F.lag("periodic").over(w)) & (F.col("periodic") > F.lead("periodic").over(w)), F.lit(False)))
