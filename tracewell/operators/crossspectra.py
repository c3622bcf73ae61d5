"""Cross spectra of channel pairs as sums: coherence, phase locking and slope measures without a row for each sample.

Each channel's complex coefficients (one for each frequency, taper and sample) stay packed, a row for each block of samples. A pair
meets by record and block, its products are summed there, and only the sums, a handful of numbers for each frequency, are exchanged and added up. Tapers
of a frequency count like samples. Pairs come from a list, or are all pairs of a record, which meet in squares of channels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.intervals import meet
from tracewell.operators.spectral import blocks, dpss, morlet_kernel

#: Sums of a pair and frequency: products, powers, unit phasors, sign, sum and size of the imaginary part, samples, and samples with a phase.
SUMS = ("re", "im", "pa", "pb", "cos", "sin", "sign", "lag", "size", "n", "n_phase")
MEASURES = ("coh", "plv", "ciplv", "pli", "wpli")
#: Samples of pairs that go through one call.
_ROWS = 1 << 17
#: Channels on a side of a square, if all pairs of a record meet.
SIDE = 256
Kernels = Sequence[Sequence[np.ndarray]]


def check_nyquist(rate: float, freqs: Sequence[float]) -> None:
    if not len(freqs) or min(freqs) <= 0 or max(freqs) > rate / 2:
        raise ValueError(f"frequencies lie above 0 and at most at half the rate ({rate / 2:g} Hz)")


def morlet_kernels(rate: float, freqs: Sequence[float], cycles: Sequence[float]) -> list[list[np.ndarray]]:
    check_nyquist(rate, freqs)
    return [[morlet_kernel(f, c, rate)] for f, c in zip(freqs, cycles)]


def multitaper_kernels(rate: float, freqs: Sequence[float], cycles: Sequence[float], bandwidth: float = 4.0) -> list[list[np.ndarray]]:
    """Slepian tapers of cycles / freq seconds (odd samples), time-bandwidth product ``bandwidth``, modulated to each frequency."""
    check_nyquist(rate, freqs)
    if bandwidth <= 0:
        raise ValueError("the bandwidth is above 0")
    out = []
    for f, c in zip(freqs, cycles):
        n = max(3, int(round(c / f * rate)) | 1)
        t = (np.arange(n) - n // 2) / rate
        out.append([h * np.exp(2j * math.pi * f * t) for h in dpss(n, bandwidth / 2, max(1, int(bandwidth - 1)))])
    return out


def coefficients(x: np.ndarray, kernels: Kernels, spectra: dict[int, list[np.ndarray]] | None = None) -> np.ndarray:
    """Convolution of x with every kernel, centred, in order of frequency and taper; missing samples add nothing and have no coefficient.

    spectra: keeps the kernels' own spectra by length from one call to the next.
    """
    flat = [k for own in kernels for k in own]
    longest = max(map(len, flat))
    n = 1 << (len(x) + longest - 1).bit_length()
    spectrum = np.fft.fft(np.nan_to_num(x), n)
    out = np.empty((len(flat), len(x)), complex)
    spectra = {} if spectra is None else spectra
    if n not in spectra:
        spectra.clear()
        spectra[n] = [np.fft.fft(k, n) for k in flat]
    for row, k, own in zip(out, flat, spectra[n]):
        row[:] = np.fft.ifft(spectrum * own)[len(k) // 2 : len(k) // 2 + len(x)]
    out[:, np.isnan(x)] = np.nan
    return out


def products_summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SUMS over all coefficients of two equal arrays; those missing in either count nowhere."""
    ok = ~(np.isnan(a) | np.isnan(b))
    a, b = a[ok], b[ok]
    c = a * np.conj(b)
    r = np.abs(c)
    # Parts below the rounding of the product count as no phase difference.
    im = np.where(np.abs(c.imag) > 1e-12 * r, c.imag, 0.0)
    some = r > 0
    return np.array([c.real.sum(), c.imag.sum(), (np.abs(a) ** 2).sum(), (np.abs(b) ** 2).sum(), (c.real[some] / r[some]).sum(), (im[some] / r[some]).sum(), np.sign(im).sum(), im.sum(), np.abs(im).sum(), len(c), some.sum()])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, so that what a task makes of them stays small however many blocks a batch holds."""
    for batch in batches:
        for n in range(0, batch.num_rows, rows):
            yield batch.slice(n, rows)


def coefficient_blocks(signal: DataFrame, keys: Sequence[str], kernels: Kernels, hop: int = 1, size: int = 65536, channel: str = "channel", idx: str = "sample_idx", reach: int = 0) -> DataFrame:
    """keys, channel, block, first, coef, own: complex coefficients of each block's samples whose index is a multiple of ``hop``, from index ``first`` on.

    ``reach``: with the coefficients of so many indexes before and after; ``own`` (a byte for each) tells which are the block's samples.
    """
    cols, halo, rows = [*keys, channel], max(len(k) for own in kernels for k in own) // 2 + reach, sum(map(len, kernels))
    kinds = dict(signal.dtypes)
    samples = blocks(signal.select(*cols, F.col(idx).cast("long").alias("_i"), F.col("value").cast("double").alias("_v")), cols, size, halo, "_i")
    arrays = samples.groupBy(*cols, "block").agg(F.collect_list(F.struct("_i", "_v", "core")).alias("_x")).where(F.exists("_x", lambda s: s.core))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectra: dict[int, list[np.ndarray]] = {}
        for batch in slices(batches):
            edges, flat = np.cumsum(np.r_[0, batch.column("_x").value_lengths().to_numpy()]), batch.column("_x").flatten()
            place_of, value_of, core_of = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("_i", "_v", "core"))
            first, coef, cores = [], [], []
            for s, e in zip(edges[:-1], edges[1:]):
                at, own = place_of[s:e], place_of[s:e][core_of[s:e].astype(bool)]
                values = np.full(at.max() - at.min() + 1, np.nan)
                values[at - at.min()] = value_of[s:e]
                low = max(own.min() - reach, at.min())
                start = low + -low % hop
                place = np.arange(start, min(own.max() + reach, at.max()) + 1, hop) - at.min()
                core = np.zeros(len(values), bool)
                core[own - at.min()] = True
                first.append(int(start))
                cores.append(core[place].tobytes())
                coef.append(np.ascontiguousarray(coefficients(values, kernels, spectra)[:, place]).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*cols, "block")), pa.array(first, pa.int64()), pa.array(coef, pa.binary()), pa.array(cores, pa.binary())], names=[*cols, "block", "first", "coef", "own"])

    return arrays.mapInArrow(transform, ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "block long, first long, coef binary, own binary"])) if rows else arrays


def cross_sums(signal: DataFrame, pairs: DataFrame, keys: Sequence[str], freqs: Sequence[float], kernels: Kernels, hop: int = 1, size: int = 65536, channel: str = "channel", idx: str = "sample_idx") -> DataFrame:
    """keys, a, b, f_pos, freq and SUMS over all samples that both channels of a pair have.

    pairs: a, b (names of channels). A pair is met in every record that has both channels; NULL keys are a key, NULL channels are in no pair. Results do not
    depend on the block size as long as the halo holds the kernels, which it does.
    """
    coef = coefficient_blocks(signal, keys, kernels, hop, size, channel, idx)
    kinds = dict(signal.dtypes)
    p = pairs.select("a", "b").distinct()
    left = coef.join(p, coef[channel] == p["a"]).select(*keys, "block", "a", "b", F.col("first").alias("_fa"), F.col("coef").alias("_ca"))
    right = coef.select(*keys, "block", F.col(channel).alias("b"), F.col("first").alias("_fb"), F.col("coef").alias("_cb"))
    met = meet(left, right, [*keys, "block", "b"])
    tapers = [len(own) for own in kernels]
    edge = np.cumsum([0, *tapers])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for fa, ca, fb, cb in zip(*(batch.column(c) for c in ("_fa", "_ca", "_fb", "_cb"))):
                a, b = (np.frombuffer(c.as_buffer(), complex).reshape(edge[-1], -1) for c in (ca, cb))
                start = max(fa.as_py(), fb.as_py())
                sa, sb = (start - fa.as_py()) // hop, (start - fb.as_py()) // hop
                n = max(0, min(a.shape[1] - sa, b.shape[1] - sb))
                a, b = a[:, sa : sa + n], b[:, sb : sb + n]
                out += [products_summed(a[s:e].ravel(), b[s:e].ravel()) for s, e in zip(edge[:-1], edge[1:])]
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(tapers)), pa.int64())
            table = np.array(out).reshape(-1, len(SUMS))
            f = pa.array(np.tile(np.arange(len(tapers)), batch.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (*keys, "a", "b")), f, *(pa.array(table[:, i]) for i in range(len(SUMS)))], names=[*keys, "a", "b", "f_pos", *SUMS])

    name = dict(pairs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"a {name['a']}, b {name['b']}, f_pos int", *(f"`{s}` double" for s in SUMS)])
    total = met.mapInArrow(add, schema).groupBy(*keys, "a", "b", "f_pos").agg(*(F.sum(s).alias(s) for s in SUMS))
    freq = F.element_at(F.array(*(F.lit(float(f)) for f in freqs)), F.col("f_pos") + 1)
    return total.select(*keys, "a", "b", "f_pos", freq.alias("freq"), *SUMS)


def square_sums(a: np.ndarray, b: np.ndarray, edge: np.ndarray, later: bool = False) -> np.ndarray:
    """SUMS of every channel of ``a`` with every channel of ``b``: (channels, channels, frequencies, SUMS); see ``products_summed``.

    a, b: coefficients by channel, row and sample, NaN where missing; frequency f owns rows edge[f]:edge[f + 1]. later: a and b are the same, and only pairs
    with a later channel are filled.
    """
    out = np.zeros((len(a), len(b), len(edge) - 1, len(SUMS)))
    for f, (s, e) in enumerate(zip(edge[:-1], edge[1:])):
        (x, rx, ux, mx), (y, ry, uy, my) = (_parts(c[:, s:e].reshape(len(c), -1)) for c in (a, b))
        own = dict(zip(SUMS, np.moveaxis(out[:, :, f], -1, 0)))
        product = x @ np.conj(y).T
        own["re"][:], own["im"][:] = product.real, product.imag
        own["pa"][:], own["pb"][:], own["n"][:] = rx**2 @ my.T, mx @ (ry**2).T, mx @ my.T
        own["cos"][:], own["n_phase"][:] = ux.real @ uy.real.T + ux.imag @ uy.imag.T, (rx > 0).astype(float) @ (ry > 0).astype(float).T
        u, v = (np.ascontiguousarray(c) for c in (uy.real, uy.imag))
        few = max(1, _ROWS // max(1, y.size))
        for i in range(0, len(x), few):
            j = i + 1 if later else 0
            sine = ux.imag[i : i + few, None] * u[None, j:] - ux.real[i : i + few, None] * v[None, j:]
            # Parts below the rounding of the product count as no phase difference.
            sine[np.abs(sine) <= 1e-12] = 0.0
            part = {"sin": sine.sum(-1), "sign": np.sign(sine).sum(-1)}
            sine *= rx[i : i + few, None] * ry[None, j:]
            part |= {"lag": sine.sum(-1), "size": np.abs(sine).sum(-1)}
            for c, values in part.items():
                own[c][i : i + few, j:] = values
        # Without any phase difference the cosines are 1 or -1.
        own["cos"][:] = np.where(own["size"] == 0, np.rint(own["cos"]), own["cos"])
    return out


def _parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients with 0 for missing ones, their sizes, unit phasors (0 without a phase), and 1 for each that is there."""
    there = ~np.isnan(x)
    x = np.where(there, x, 0)
    r = np.abs(x)
    return x, r, x / np.where(r > 0, r, 1.0), there.astype(float)


def all_cross_sums(signal: DataFrame, channels: DataFrame, keys: Sequence[str], freqs: Sequence[float], kernels: Kernels, hop: int = 1, size: int = 1024, channel: str = "channel", idx: str = "sample_idx", pos: str = "pos", side: int = SIDE) -> DataFrame:
    """``cross_sums`` of every two channels of a record, each pair once: a comes before b in order of ``pos``.

    channels: keys, channel, pos. The pairs grow with the square of a record's channels, so these are dealt into parts of ``side``, and every two parts meet as a
    square of their own, block by block; what a task holds follows ``side`` and ``size`` alone, and what is exchanged is a block for each ``side`` pairs.
    """
    named = channels.where(F.col(channel).isNotNull()).groupBy(*keys, channel).agg(F.min(pos).alias("_pos"))
    record = Window.partitionBy(*keys)
    named = named.select(*keys, channel, (F.row_number().over(record.orderBy("_pos", channel)) - 1).alias("_at"), F.ceil(F.count("*").over(record) / side).alias("_parts"))
    squares = named.where("_at = 0").agg(F.sum(F.col("_parts") * (F.col("_parts") + 1) / 2)).first()[0] or 1
    low, high = signal.agg(F.min(idx), F.max(idx)).first()
    blocks_each = 1 if low is None else high // size - low // size + 1
    coef = coefficient_blocks(signal, keys, kernels, hop, size, channel, idx)
    kinds, part = dict(signal.dtypes), F.floor(F.col("_at") / side)
    dealt = meet(coef, named, [*keys, channel]).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    dealt = dealt.withColumn("_square", F.struct(*keys, "block", F.least(part, "_other").alias("_l"), F.greatest(part, "_other").alias("_r")))
    dealt = dealt.select(*keys, F.col(channel).alias("_c"), "first", "coef", "_at", "_square").repartition(min(math.ceil(squares * blocks_each), 20000), "_square")
    edge = np.cumsum([0, *map(len, kernels)])

    def add(met: pa.Table) -> pa.Table:
        met = met.sort_by("_at")
        here = met.column("_at").to_numpy() // side
        first = met.column("first").to_numpy()
        start = (first - first.min()) // hop
        own = [np.frombuffer(c.as_buffer(), complex).reshape(edge[-1], -1) for c in met.column("coef")]
        x = np.full((len(own), edge[-1], max(s + c.shape[1] for s, c in zip(start, own))), np.nan, complex)
        for row, s, c in zip(x, start, own):
            row[:, s : s + c.shape[1]] = c
        square = met.column("_square")[0].as_py()
        later = square["_l"] == square["_r"]
        i, j = np.flatnonzero(here == square["_l"]), np.flatnonzero(here == square["_r"])
        table = square_sums(x[i], x[j], edge, later)
        p, q = np.triu_indices(len(i), 1) if later else (c.ravel() for c in np.indices((len(i), len(j))))
        f = len(edge) - 1
        table, a, b = table[p, q].reshape(-1, len(SUMS)), pa.array(np.repeat(i[p], f)), pa.array(np.repeat(j[q], f))
        cells = [*(met.column(k).take(a) for k in keys), met.column("_c").take(a), met.column("_c").take(b), pa.array(np.tile(np.arange(f), len(p)), pa.int32())]
        return pa.Table.from_arrays([*cells, *(pa.array(c) for c in table.T)], names=[*keys, "a", "b", "f_pos", *SUMS])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"a {kinds[channel]}, b {kinds[channel]}, f_pos int", *(f"`{s}` double" for s in SUMS)])
    total = dealt.groupBy("_square").applyInArrow(add, schema)
    if blocks_each > 1:
        total = total.groupBy(*keys, "a", "b", "f_pos").agg(*(F.sum(s).alias(s) for s in SUMS))
    freq = F.element_at(F.array(*(F.lit(float(f)) for f in freqs)), F.col("f_pos") + 1)
    return total.select(*keys, "a", "b", "f_pos", freq.alias("freq"), *SUMS)


def windowed(signal: DataFrame, pairs: DataFrame, keys: Sequence[str], freqs: Sequence[float], kernels: Kernels, half: dict[int, int], measures: Sequence[str] = MEASURES, hop: int = 1, size: int = 65536, channel: str = "channel", idx: str = "sample_idx") -> DataFrame:
    """Measures in centred windows of half[f_pos] samples, ``hop`` indexes apart, to both sides: keys, a, b, f_pos, freq, idx and a column each.

    Kernels: one for each frequency. A row for each sample (index a multiple of ``hop``) that both channels have; NULL where the window leaves the record or lacks a sample.
    Channels are exchanged as packed blocks that hold the windows of their samples, so results do not depend on the block size.
    """
    if any(len(own) != 1 for own in kernels):
        raise ValueError("windows take one kernel a frequency")
    coef = coefficient_blocks(signal, keys, kernels, hop, size, channel, idx, max(half.values(), default=0) * hop)
    kinds, name = dict(signal.dtypes), dict(pairs.dtypes)
    p = pairs.select("a", "b").distinct()
    left = coef.join(p, coef[channel] == p["a"]).select(*keys, "block", "a", "b", F.col("first").alias("_fa"), F.col("coef").alias("_ca"), F.col("own").alias("_oa"))
    right = coef.select(*keys, "block", F.col(channel).alias("b"), F.col("first").alias("_fb"), F.col("coef").alias("_cb"), F.col("own").alias("_ob"))
    met = meet(left, right, [*keys, "block", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[int, list] = {}
            for n, (fa, ca, oa, fb, cb, ob) in enumerate(zip(*(batch.column(c) for c in ("_fa", "_ca", "_oa", "_fb", "_cb", "_ob")))):
                a, b = (np.frombuffer(c.as_buffer(), complex).reshape(len(kernels), -1) for c in (ca, cb))
                start = max(fa.as_py(), fb.as_py())
                sa, sb = (start - fa.as_py()) // hop, (start - fb.as_py()) // hop
                m = max(0, min(a.shape[1] - sa, b.shape[1] - sb))
                here = np.frombuffer(oa.as_buffer(), bool)[sa : sa + m] & np.frombuffer(ob.as_buffer(), bool)[sb : sb + m]
                found.setdefault(m, []).append((n, start, here, a[:, sa : sa + m], b[:, sb : sb + m]))
            # Pairs of one length go through one call, as far as they are short.
            for m, every in found.items():
                few = max(1, _ROWS // max(1, m))
                for part in (every[i : i + few] for i in range(0, len(every), few)):
                    no, start, here, a, b = (np.array(x) for x in zip(*part))
                    row, place = np.nonzero(here)
                    at, when = pa.array(no[row], pa.int64()), pa.array(start[row] + place * hop, pa.int64())
                    for f in sorted(half):
                        table = window_measures(a[:, f], b[:, f], half[f], measures)[:, row, place]
                        cells = [pa.array(np.full(len(row), f), pa.int32()), when, *(pa.array(v, from_pandas=True) for v in table)]
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (*keys, "a", "b")), *cells], names=[*keys, "a", "b", "f_pos", idx, *measures])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"a {name['a']}, b {name['b']}, f_pos int, `{idx}` long", *(f"`{m}` double" for m in measures)])
    freq = F.element_at(F.array(*(F.lit(float(f)) for f in freqs)), F.col("f_pos") + 1)
    return met.mapInArrow(run, schema).select(*keys, "a", "b", "f_pos", freq.alias("freq"), idx, *measures)


def window_measures(a: np.ndarray, b: np.ndarray, half: int, measures: Sequence[str] = MEASURES) -> np.ndarray:
    """An array like ``a`` for each measure of series of coefficients (along the last axis) in windows of ``half`` to both sides; NaN where a window is not whole or a measure undefined."""
    width, n, out = 2 * half + 1, a.shape[-1], np.full((len(measures), *a.shape), np.nan)
    if n < width:
        return out
    c = a * np.conj(b)
    r = np.abs(c)
    # Parts below the rounding of the product count as no phase difference.
    im = np.where(np.abs(c.imag) > 1e-12 * r, c.imag, np.where(np.isnan(r), np.nan, 0.0))
    some = np.where(r > 0, 1.0, r)  # 0 without a phase, NaN where a sample is missing
    mean = lambda v: np.lib.stride_tricks.sliding_window_view(v, width, axis=-1).mean(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        over = lambda x, y: np.where(y == 0, np.nan, x / y)
        unit = lambda v: over(mean(np.where(r > 0, v / r, some)), mean(some))
        table = {
            "coh": lambda: over(np.hypot(mean(c.real), mean(c.imag)), np.sqrt(mean(np.abs(a) ** 2 + 0 * r) * mean(np.abs(b) ** 2 + 0 * r))),
            "plv": lambda: np.hypot(unit(c.real), unit(im)),
            "ciplv": lambda: over(np.abs(unit(im)), np.sqrt(np.maximum(0.0, 1 - unit(c.real) ** 2))),
            "pli": lambda: np.abs(mean(np.sign(im))),
            "wpli": lambda: over(np.abs(mean(im)), mean(np.abs(im))),
        }
        out[..., half : n - half] = [table[m]() for m in measures]
    return out


def measures_of(sums: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Coherence, phase locking, its corrected imaginary part, phase lag index and its weighted form from ``cross_sums``; NULL where undefined."""
    c, s = (F.try_divide(F.col(x), F.col("n_phase")) for x in ("cos", "sin"))
    some = lambda x: F.nullif(x, F.lit(0.0))
    table: dict[str, Column] = {
        "coh": F.try_divide(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), some(F.sqrt(F.col("pa") * F.col("pb")))),
        "plv": F.sqrt(c**2 + s**2),
        "ciplv": F.try_divide(F.abs(s), some(F.sqrt(F.greatest(F.lit(0.0), 1 - c**2)))),
        "pli": F.abs(F.try_divide("sign", some(F.col("n")))),
        "wpli": F.try_divide(F.abs("lag"), some(F.col("size"))),
    }
    return sums.select(*keys, "a", "b", "f_pos", "freq", *(table[m].alias(m) for m in measures))


def phase_slope_of(sums: DataFrame, keys: Sequence[str], bands: DataFrame, rate: float) -> DataFrame:
    """Phase slope index of each band from ``cross_sums``: keys, a, b, band, psi.

    The imaginary part of conj(c(f)) c(f + df), c the coherency, summed over neighbouring bins of a band's segment. bands: band, start, end; segments
    of one band are averaged by their numbers of bins. An upper end over half the rate is an error.
    """
    top = bands.agg(F.max("end")).first()[0]
    if top is not None and top > rate / 2:
        raise ValueError(f"a band ends at {top:g} Hz, over half the rate ({rate / 2:g} Hz)")
    level = F.nullif(F.sqrt(F.col("pa") * F.col("pb")), F.lit(0.0))
    c = sums.select(*keys, "a", "b", "f_pos", "freq", F.try_divide("re", level).alias("_re"), F.try_divide("im", level).alias("_im"))
    segments = F.broadcast(bands.select("band", "start", "end").withColumn("_seg", F.monotonically_increasing_id()))
    c = c.join(segments, F.col("freq").between(F.col("start"), F.col("end")))
    own = F.array_sort(F.collect_list(F.struct("f_pos", "_re", "_im")))
    c = c.groupBy(*keys, "a", "b", "band", "_seg").agg(own.alias("_c"))
    steps = F.zip_with(F.slice("_c", 1, F.size("_c") - 1), F.slice("_c", 2, F.size("_c") - 1), lambda x, y: x["_re"] * y["_im"] - x["_im"] * y["_re"])
    slope = F.when(F.size("_c") > 1, F.aggregate(steps, F.lit(0.0), lambda t, x: t + x)).otherwise(0.0)
    c = c.select(*keys, "a", "b", "band", slope.alias("_s"), F.size("_c").alias("_k"))
    return c.groupBy(*keys, "a", "b", "band").agg((F.sum(F.col("_s") * F.col("_k")) / F.sum("_k")).alias("psi"))
