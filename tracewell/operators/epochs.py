"""Epochs as data: windows of annotations become spans of samples, stitched, resampled or edge-padded.

An alignment is a small table of parts (keys, epoch, label, part, start, end in seconds). ``sample_spans`` states
it in samples of every metric of a record, each with its own rate and length, and ``stitched`` meets all metrics' cells in one
join by record, metric and block of samples. What follows needs no second join: a stitched sample knows its place in its epoch, so
it is repeated to the longest length, or gives its share to the output positions next to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.intervals import drop_overlapping, reduce_and, union_intervals

Bounds = tuple[Column, Column]


def _matches(text: Column, label: Column, mode: str) -> Column:
    if mode not in ("exact", "substring"):
        raise ValueError(f"unknown mode {mode}")
    d, k = F.lower(text), F.lower(label)
    return d == k if mode == "exact" else F.contains(d, k)


def _epoch_order(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return df.withColumn("epoch", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def pad_parts(annotations: DataFrame, windows: DataFrame, keys: Sequence[str], mode: str = "exact", low: float = 0.0, high: float | None = None, drops: DataFrame | None = None, bounds: Bounds | None = None) -> DataFrame:
    """Two parts an annotation and matching label: around its start and around its end.

    annotations: keys, label, start, end; windows: label, pad_left, anno_left, anno_right, pad_right (a parameter table, broadcast). Part 0
    is [start - pad_left, start + anno_left], part 1 is [end - anno_right, end + pad_right], cut to ``bounds``; an epoch one of whose parts is
    reversed goes, as does one of whose parts touches a drop interval, and annotations shorter than ``low`` or longer than ``high``. Epochs are numbered
    by start, label and end within their keys.
    """
    length = F.col("end") - F.col("start")
    own = annotations.where((length >= low) & (length <= high) if high is not None else length >= low).select(*keys, F.col("label").alias("_text"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = own.join(F.broadcast(windows), _matches(F.col("_text"), F.col("label"), mode))
    ends = {"_a": F.col("_s") - F.col("pad_left"), "_b": F.col("_s") + F.col("anno_left"), "_c": F.col("_e") - F.col("anno_right"), "_d": F.col("_e") + F.col("pad_right")}
    if bounds is not None:
        ends = {k: F.greatest(v, bounds[0]) if k in ("_a", "_c") else F.least(v, bounds[1]) for k, v in ends.items()}
    met = met.withColumns(ends).where("_a <= _b and _c <= _d")
    if drops is not None:
        d = drops.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("start").alias("_ds"), F.col("end").alias("_de"))
        touch = (F.col("_a") <= F.col("_de")) & (F.col("_b") >= F.col("_ds")) | (F.col("_c") <= F.col("_de")) & (F.col("_d") >= F.col("_ds"))
        met = met.join(d, reduce_and([met[k].eqNullSafe(d[f"_k{i}"]) for i, k in enumerate(keys)]) & touch, "left_anti")
    out = _epoch_order(met, keys, "_s", "label", "_e")
    sides = F.array(*(F.struct(F.lit(i).alias("part"), F.col(a).alias("start"), F.col(b).alias("end")) for i, (a, b) in enumerate((("_a", "_b"), ("_c", "_d")))))
    return out.select(*keys, "epoch", "label", F.explode(sides).alias("p")).select(*keys, "epoch", "label", "p.part", "p.start", "p.end")


def concat_parts(annotations: DataFrame, keys: Sequence[str], labels: Sequence[str], mode: str = "exact", pad: float = 0.0, drops: DataFrame | None = None, bounds: Bounds | None = None) -> DataFrame:
    """One epoch for each keys: the union of all matching annotations, padded and cut to ``bounds``, without those that touch a drop interval."""
    hit = _matches(F.col("label"), F.lit(labels[0]), mode)
    for label in labels[1:]:
        hit = hit | _matches(F.col("label"), F.lit(label), mode)
    out = annotations.where(hit).select(*keys, (F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))
    if bounds is not None:
        out = out.withColumns({"start": F.greatest("start", bounds[0]), "end": F.least("end", bounds[1])})
    out = out.withColumns({"start": F.least("start", "end"), "end": F.greatest("start", "end")})
    if drops is not None:
        out = drop_overlapping(out, drops, keys)
    merged = union_intervals(out, keys)
    part = F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1
    return merged.select(*keys, F.lit(0).alias("epoch"), F.lit("+".join(labels)).alias("label"), part.alias("part"), "start", "end")


def whole_parts(epochs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stacked epochs (keys, epoch, label, start, end) as parts: one each."""
    return epochs.select(*keys, "epoch", "label", F.lit(0).alias("part"), "start", "end")


def sample_spans(parts: DataFrame, axes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts in samples of every metric of their record: keys, metric, epoch, label, part, first, size, offset, length.

    axes: keys, metric, rate, n (samples). Times round to samples, halves to even; a part has one sample at least and lies within 0 and n. ``offset``
    is the place of the part's first sample in its epoch, ``length`` the samples of the epoch.
    """
    a = axes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "metric", "rate", F.col("n").cast("long").alias("_n")).where("rate > 0 and _n > 0")
    met = parts.join(a, reduce_and([parts[k].eqNullSafe(a[f"_k{i}"]) for i, k in enumerate(keys)]))
    at = lambda t: F.bround(F.col(t) * F.col("rate")).cast("long")
    first = F.greatest(at("start"), F.lit(0))
    last = F.least(F.greatest(at("end"), first + 1), F.col("_n"))
    met = met.withColumns({"first": F.least(first, F.col("_n") - 1), "_last": last})
    own = Window.partitionBy(*keys, "metric", "epoch")
    size = F.col("_last") - F.col("first")
    before = F.coalesce(F.sum(size).over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return met.select(*keys, "metric", "epoch", "label", "part", "first", size.alias("size"), before.alias("offset"), F.sum(size).over(own).alias("length"))


def stitched(cells: DataFrame, spans: DataFrame, keys: Sequence[str], idx: str = "sample_idx", block: int = 4096) -> DataFrame:
    """Every cell in each epoch that holds it: cells' columns but ``idx``, epoch, label, at (place in the epoch), length, longest.

    cells: keys, metric, idx, any other columns. The join is by keys, metric and block of samples, so one long record spreads
    over many tasks. ``longest`` is the greatest length of an epoch of the same keys and metric. A sample that two parts of an epoch hold comes twice.
    """
    names = [*keys, "metric"]
    s = spans.withColumn("longest", F.max("length").over(Window.partitionBy(*names)))
    s = s.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))))
    s = s.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), "_block", *(F.col(c).alias(f"_{c}") for c in ("epoch", "label", "first", "size", "offset", "length", "longest")))
    c = cells.withColumn("_at", F.floor(F.col(idx) / block))
    on = reduce_and([c[k].eqNullSafe(s[f"_k{i}"]) for i, k in enumerate(names)]) & (c["_at"] == s["_block"]) & (c[idx] >= s["_first"]) & (c[idx] < s["_first"] + s["_size"])
    place = (F.col("_offset") + F.col(idx) - F.col("_first")).cast("long")
    return c.join(s, on).select(*(F.col(f"`{x}`") for x in cells.columns if x != idx), F.col("_epoch").alias("epoch"), F.col("_label").alias("label"), place.alias("at"), F.col("_length").alias("length"), F.col("_longest").alias("longest"))


def edge_padded(samples: DataFrame) -> DataFrame:
    """Stitched samples at their own rate, all epochs of a record and metric as long as the longest: the last sample is repeated (column pos)."""
    end = F.when(F.col("at") == F.col("length") - 1, F.col("longest") - 1).otherwise(F.col("at"))
    return samples.withColumn("pos", F.explode(F.sequence(F.col("at"), end))).drop("at", "length", "longest")


def resampled(samples: DataFrame, n: int, value: str = "value") -> DataFrame:
    """Stitched samples brought to ``n`` positions an epoch by linear interpolation over the whole of it (column pos).

    Positions run evenly from the first to the last sample. Each sample gives its weighted share to the positions within one sample of it, and one
    aggregation adds them up; a NULL sample makes the positions NULL that it has a share in. An epoch of one sample repeats it.
    """
    if n < 2:
        raise ValueError("n must be 2 or more")
    carried = [c for c in samples.columns if c not in (value, "at", "length", "longest")]
    step = (F.col("length") - 1) / F.lit(n - 1)
    wide = F.when(F.col("length") == 1, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(
        F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - 1) / step).cast("int")), F.least(F.lit(n - 1), F.ceil((F.col("at") + 1) / step).cast("int")))
    )
    x = F.when(F.col("pos") == n - 1, (F.col("length") - 1).cast("double")).otherwise(F.col("pos") * step)
    near = F.col("at") - F.floor(x)
    share = F.when(F.col("length") == 1, 1.0).when(near == 0, 1 - (x - F.floor(x))).when(near == 1, x - F.floor(x)).otherwise(0.0)
    dealt = samples.withColumn("pos", F.explode(wide)).withColumn("_w", share).where("_w > 0")
    total = F.when(F.count(value) == F.count("*"), F.sum(F.col("_w") * F.col(value)))
    return dealt.groupBy(*(F.col(f"`{c}`") for c in carried), "pos").agg(total.alias(value))


def align_metrics(cells: DataFrame, parts: DataFrame, axes: DataFrame, keys: Sequence[str], n: int | None = None, idx: str = "sample_idx") -> DataFrame:
    """One alignment applied to all metrics of a record: cells' columns with pos for ``idx``, epoch, label, percent (0 to 100).

    ``n`` positions an epoch, or without it each metric's own samples, edge-padded to the longest epoch. Cells without an epoch and epochs without a metric go.
    """
    samples = stitched(cells, sample_spans(parts, axes, keys), keys, idx)
    if n is not None:
        return resampled(samples, n).withColumn("percent", F.col("pos") * 100 / F.lit(n - 1))
    last = F.greatest(F.col("longest") - 1, F.lit(1))
    return edge_padded(samples.withColumn("_last", last)).withColumn("percent", F.col("pos") * 100 / F.col("_last")).drop("_last")
