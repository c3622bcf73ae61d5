"""Event alignment: epochs from annotations, and resampling onto a normalised axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.intervals import drop_overlapping, meet, union_intervals


def match_labels(annotations: DataFrame, labels: DataFrame, mode: str = "exact") -> DataFrame:
    """Annotations by the first label (column label, rank) they match: exact or contained text, case ignored."""
    d, k = F.lower("description"), F.lower("label")
    hit = d == k if mode == "exact" else F.contains(d, k)
    met = annotations.join(F.broadcast(labels.select("label", "rank")), hit)
    keys = annotations.columns
    return met.groupBy(*keys).agg(F.min_by("label", "rank").alias("label"))


def check_anchors(anchors: Sequence[tuple[float, str]]) -> list[tuple[float, str]]:
    """Anchors by percent: first 0, last 100, strictly increasing."""
    out = sorted(anchors, key=lambda a: a[0])
    at = [a[0] for a in out]
    if len(at) < 2 or at[0] != 0 or at[-1] != 100 or len(set(at)) != len(at):
        raise ValueError("anchors run from 0 to 100 percent without repeats")
    return out


def check_method(method: str, params: dict) -> dict:
    """Parameters of an alignment method, checked."""
    need = {"linear": ("anchors",), "pad": ("pad_left", "pad_right"), "stack": ("labels",), "concat": ("labels",)}
    if method not in need:
        raise ValueError(f"unknown method {method}")
    lost = [k for k in need[method] if params.get(k) is None]
    if lost:
        raise ValueError(f"{method} needs {', '.join(lost)}")
    if method == "linear":
        check_anchors(params["anchors"])
    low, high = params.get("min_duration"), params.get("max_duration")
    if low is not None and high is not None and low > high:
        raise ValueError("min_duration exceeds max_duration")
    return params


def linear_epochs(events: DataFrame, keys: Sequence[str], anchors: Sequence[tuple[float, str]], low: float, high: float, tolerance: float | None = None, t: str = "t", label: str = "label") -> DataFrame:
    """Epochs whose events follow the anchors: for each start the first increasing sequence of times that fits.

    An event of percent p lies within (p -+ tolerance) percent of the epoch's duration, which lies in [low, high].
    Partial sequences are joined step by step and pruned by the duration bounds. A start time that occurs n times
    takes its first n distinct ends. Result: keys, epoch (from 0), start, end, times (array).
    """
    steps = check_anchors(anchors)
    starts = events.where(F.col(label) == steps[0][1]).groupBy(*keys, F.col(t).alias("t0")).agg(F.count("*").alias("_copies"))
    seq = starts.withColumn("times", F.array("t0"))
    for percent, name in steps[1:]:
        nxt = events.where(F.col(label) == name).select(*keys, F.col(t).alias("_t")).distinct()
        tol = 100.0 if tolerance is None else tolerance
        lo, hi = max(0.0, percent - tol) / 100 * low, min(100.0, percent + tol) / 100 * high
        since = F.col("_t") - F.col("t0")
        seq = meet(seq, nxt, keys).where((F.col("_t") > F.element_at("times", -1)) & (since >= lo) & (since <= hi))
        seq = seq.withColumn("times", F.concat("times", F.array("_t"))).drop("_t")
    length = F.element_at("times", -1) - F.col("t0")
    seq = seq.where(length.between(low, high))
    if tolerance is not None:
        for i, (percent, _) in enumerate(steps[1:-1], start=2):
            seq = seq.where(F.abs((F.element_at("times", i) - F.col("t0")) / length * 100 - percent) <= tolerance)
    # The lexicographically first sequence of each end, then ends in that order.
    first = seq.withColumn("end", F.element_at("times", -1)).groupBy(*keys, "t0", "_copies", "end").agg(F.min("times").alias("times"))
    order = Window.partitionBy(*keys, "t0").orderBy("times")
    out = first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_copies"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("t0", "end")) - 1
    return out.select(*keys, number.alias("epoch"), F.col("t0").alias("start"), "end", "times")


def _number(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return df.withColumn("epoch", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def stack_epochs(annotations: DataFrame, keys: Sequence[str], labels: Sequence[str], low: float | None = None, high: float | None = None, pad: float = 0, drops: DataFrame | None = None, bounds: tuple | None = None) -> DataFrame:
    """One epoch per matching annotation: duration filter on raw bounds, pad, clip, drop what touches a drop interval."""
    out = annotations.where(F.col("label").isin(*labels))
    raw = F.col("end") - F.col("start")
    if low is not None:
        out = out.where(raw >= low)
    if high is not None:
        out = out.where(raw <= high)
    out = out.withColumns({"start": F.col("start") - pad, "end": F.col("end") + pad})
    if bounds is not None:
        out = out.withColumns({"start": F.greatest("start", F.lit(bounds[0])), "end": F.least("end", F.lit(bounds[1]))}).where("start < end")
    if drops is not None:
        out = drop_overlapping(out, drops, keys)
    return _number(out.select(*keys, "label", "start", "end"), keys, "start", "end", "label")


def pad_epochs(annotations: DataFrame, keys: Sequence[str], labels: Sequence[str], left: float, right: float, bounds: tuple | None = None) -> DataFrame:
    """Two windows per matching annotation, around its start and its end: rows with part 0 and 1.

    An annotation is one epoch per label that it matches; empty windows after clipping go, the epoch keeps its number.
    """
    own = annotations.where(F.col("label").isin(*labels)).select(*keys, "label", "start", "end")
    own = _number(own, keys, "start", "end", "label")
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("start").alias("c")), F.struct(F.lit(1).alias("part"), F.col("end").alias("c")))
    out = own.select(*keys, "epoch", "label", F.explode(parts).alias("p")).select(*keys, "epoch", "label", "p.part", (F.col("p.c") - left).alias("start"), (F.col("p.c") + right).alias("end"))
    if bounds is not None:
        out = out.withColumns({"start": F.greatest("start", F.lit(bounds[0])), "end": F.least("end", F.lit(bounds[1]))}).where("start < end")
    return out


def concat_epochs(annotations: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """The union of matching annotations stitched to one epoch: parts with their running offset."""
    merged = union_intervals(annotations.where(F.col("label").isin(*labels)), keys, empty="drop")
    w = Window.partitionBy(*keys).orderBy("start")
    before = F.coalesce(F.sum(F.col("end") - F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return merged.withColumns({"part": F.row_number().over(w) - 1, "offset": before})


def segment_samples(percents: Sequence[float], n: int) -> list[int]:
    """Samples of each segment between anchors, the last taking what rounding leaves."""
    out = [round((b - a) / 100 * n) for a, b in zip(percents[:-1], percents[1:])]
    out[-1] = n - sum(out[:-1])
    return out


def to_sample(t: Column, rate: float) -> Column:
    """Seconds to sample, halves to even."""
    return F.bround(t * rate).cast("long")


def output_length(method: str, rate: float, points_per_percent: float = 5, seconds: float = 0) -> int:
    return int(points_per_percent * 100) if method in ("linear", "stack") else int(round(seconds * rate))


def epoch_grid(epochs: DataFrame, keys: Sequence[str], percents: Sequence[float], n: int, rate: float) -> DataFrame:
    """n fractional sample positions per epoch, piecewise linear between its anchor times: keys, epoch, pos, at."""
    sizes = segment_samples(percents, n)
    rows, base = [], 0
    for s, size in enumerate(sizes):
        rows += [F.struct(F.lit(base + i).alias("pos"), F.lit(s + 1).alias("seg"), F.lit(i / size if s < len(sizes) - 1 or size == 1 else i / (size - 1)).alias("w")) for i in range(size)]
        base += size
    out = epochs.select(*keys, "epoch", "times", F.explode(F.array(*rows)).alias("g"))
    a, b = F.element_at("times", F.col("g.seg")), F.element_at("times", F.col("g.seg") + 1)
    return out.select(*keys, "epoch", F.col("g.pos").alias("pos"), ((a + (b - a) * F.col("g.w")) * rate).alias("at"))


def resample(grid: DataFrame, cells: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), pos: str = "t_pos") -> DataFrame:
    """Linear interpolation of cells at the grid's fractional positions, clipped to each trace.

    One equi join on the two neighbouring positions and one aggregation, for all metrics at once: keys, epoch, pos,
    carry, value. A NULL neighbour gives NULL.
    """
    size = cells.groupBy(*keys).agg(F.max(pos).alias("_last"))
    g = meet(grid, size, keys).withColumn("at", F.greatest(F.lit(0.0), F.least(F.col("at"), F.col("_last").cast("double"))))
    lo = F.floor("at")
    part = F.col("at") - lo
    sides = F.array(F.struct(lo.alias("p"), (1 - part).alias("w")), F.struct((lo + 1).alias("p"), part.alias("w")))
    g = g.select(*keys, "epoch", "pos", F.explode(sides).alias("s")).select(*keys, "epoch", "pos", F.col("s.p").cast("int").alias(pos), F.col("s.w").alias("w")).where("w > 0")
    met = meet(g, cells, [*keys, pos])
    return met.groupBy(*keys, *carry, "epoch", "pos").agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))


def representative_duration(epochs: DataFrame, keys: Sequence[str], gait: Column) -> DataFrame:
    """Duration that stands for a set of epochs: the mean for a majority of gait labels, else the median."""
    d = F.col("end") - F.col("start")
    return epochs.groupBy(*keys).agg(F.when(F.avg(gait.cast("double")) > 0.5, F.avg(d)).otherwise(F.median(d)).alias("duration"))


def time_axes(cells: DataFrame, durations: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Seconds (0 to the duration) and percent (0 to 100) of aligned positions."""
    share = F.col("pos") / F.lit(max(1, n - 1))
    return meet(cells, durations, keys).withColumns({"time_s": share * F.col("duration"), "percent": share * 100}).drop("duration")


def axis_of(method: Column) -> Column:
    """The time column of a finished table: percent for linear and stack, seconds otherwise."""
    return F.when(method.isin("linear", "stack"), F.col("percent")).otherwise(F.col("time_s"))


def pick_epochs(epochs: DataFrame, picks: Sequence[int]) -> DataFrame:
    """Epochs with a pick flag; negative indexes are ignored."""
    return epochs.withColumn("pick", F.col("epoch").isin([p for p in picks if p >= 0]))
