"""Cells in long form: axes, wells (named selections of an axis), and the reducers over them.

A cell is a trace or a frequency-by-time value. Long form has one row per position with the
columns of ``schemas.CELL``; runs go by adjacency of positions (f_pos, t_pos), not by distance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.intervals import meet

REDUCERS = ("mean", "median", "count", "occupation", "rate", "duration")


def unpack_traces(df: DataFrame, array: str = "values", row_id: str = "row_id", meta: Sequence[str] = ()) -> DataFrame:
    """One row per element of a trace column: row_id, meta, t_pos, t_coord, value (NaN becomes NULL)."""
    out = df.select(F.col(row_id).alias("row_id"), *meta, F.posexplode(array).alias("t_pos", "v"))
    v = F.col("v").cast("double")
    return out.select("row_id", *meta, "t_pos", F.col("t_pos").cast("double").alias("t_coord"), F.when(~F.isnan(v), v).alias("value"))


def pack_traces(cells: DataFrame, meta: Sequence[str] = ()) -> DataFrame:
    """Traces back to arrays in order of position (``values``, ``coords``)."""
    packed = cells.groupBy("row_id", *meta).agg(F.array_sort(F.collect_list(F.struct("t_pos", "t_coord", "value"))).alias("_c"))
    return packed.select("row_id", *meta, F.col("_c.value").alias("values"), F.col("_c.t_coord").alias("coords"))


def prepare_axis(cells: DataFrame, label: str = "t_label", by: Sequence[str] = ("row_id",)) -> DataFrame:
    """Coordinates and positions from labels: numeric if every label of the cell parses, sorted then; else in order.

    Categorical axes keep the order of the column ``ordinal`` and get coordinates 0 to n - 1.
    """
    number = lambda c: F.col(c).try_cast("double")
    w = Window.partitionBy(*by)
    numeric = F.min(number(label).isNotNull() & ~F.isnan(number(label))).over(w)
    df = cells.withColumn("is_numeric", numeric)
    rank = F.row_number().over(w.orderBy(F.when(F.col("is_numeric"), number(label)), "ordinal")) - 1
    df = df.withColumn("t_pos", rank)
    return df.withColumn("t_coord", F.when(F.col("is_numeric"), number(label)).otherwise(F.col("t_pos").cast("double")))


def wells(spark: SparkSession, spec: Sequence[tuple[str, float, float]], right_closed: bool = False) -> DataFrame:
    """A small table of named intervals from parameters: well, w_lo, w_hi, right_closed; ends are put in order.

    A repeated name marks further segments of the same well.
    """
    rows = [(n, float(min(a, b)), float(max(a, b)), right_closed) for n, a, b in spec]
    return spark.createDataFrame(rows, "well string, w_lo double, w_hi double, right_closed boolean")


def percent_to_coord(p: Column, lo: Column, hi: Column) -> Column:
    """Percent of an axis as a coordinate; values of at most 1 in size are fractions (so [0, 1] is the whole axis)."""
    return lo + (hi - lo) * F.when(F.abs(p) <= 1, p).otherwise(p / 100)


def resolve_wells(wells_: DataFrame, axis: DataFrame) -> DataFrame:
    """Wells cut to each axis (columns lo, hi): a right end that is cut becomes closed, segments of a well are merged.

    Adds w_len, the requested length of the well on that axis.
    """
    met = axis.join(F.broadcast(wells_))
    cut = met.withColumns({"right_closed": F.col("right_closed") | (F.col("w_hi") > F.col("hi")), "w_lo": F.greatest("w_lo", "lo"), "w_hi": F.least("w_hi", "hi")}).where("w_lo <= w_hi")
    keys = [c for c in axis.columns if c not in ("lo", "hi")]
    order = Window.partitionBy(*keys, "well").orderBy("w_lo", "w_hi")
    before = F.max("w_hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = cut.withColumn("_n", F.when(before.isNull() | (F.col("w_lo") > before), 1).otherwise(0)).withColumn("_part", F.sum("_n").over(order))
    merged = marked.groupBy(*keys, "well", "_part").agg(F.min("w_lo").alias("w_lo"), F.max("w_hi").alias("w_hi"), F.max_by("right_closed", "w_hi").alias("right_closed"))
    return merged.withColumn("w_len", F.sum(F.col("w_hi") - F.col("w_lo")).over(Window.partitionBy(*keys, "well"))).drop("_part")


def select_wells(cells: DataFrame, wells_: DataFrame, coord: str = "t_coord") -> DataFrame:
    """Cells by the wells they lie in; half-open unless a well is right_closed. Adds well and w_len (sum of lengths)."""
    total = wells_.groupBy("well").agg(F.sum(F.col("w_hi") - F.col("w_lo")).alias("w_len"))
    w = F.broadcast(wells_.join(total, "well"))
    inside = (F.col(coord) >= F.col("w_lo")) & ((F.col(coord) < F.col("w_hi")) | F.col("right_closed") & (F.col(coord) == F.col("w_hi")))
    return cells.join(w, inside).drop("w_lo", "w_hi", "right_closed")


def select_labels(cells: DataFrame, groups: DataFrame, label: str = "f_label", coord: str | None = None, tol: float = 1e-9) -> DataFrame:
    """Cells by label groups (well, label): equal text, or close numbers on a numeric axis."""
    hit = F.col(label) == F.col("label")
    if coord:
        hit = hit | (F.abs(F.col(coord) - F.col("label").try_cast("double")) <= tol)
    return cells.join(F.broadcast(groups), hit).drop("label")


def well_names(groups: DataFrame) -> DataFrame:
    """Names of label groups (labels array, ordinal): labels joined by +, repeats numbered _2, _3 ..."""
    named = groups.withColumn("name", F.array_join("labels", "+"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("ordinal"))
    return named.withColumn("name", F.when(n == 1, F.col("name")).otherwise(F.concat_ws("_", "name", n.cast("string"))))


def _with_islands(sel: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    return sel.where("value is not null").withColumn("_isl", F.col(pos) - F.row_number().over(Window.partitionBy(*keys).orderBy(pos)))


def trapezoids(sel: DataFrame, keys: Sequence[str], pos: str = "t_pos", coord: str = "t_coord", value: str = "value") -> DataFrame:
    """Integral and length over each key's contiguous runs: keys, num, den. A run of one sample adds (y, 1)."""
    marked = _with_islands(sel.withColumn("value", F.col(value)), keys, pos)
    w = Window.partitionBy(*keys, "_isl").orderBy(pos)
    step = F.lead(coord).over(w) - F.col(coord)
    area = (F.col("value") + F.lead("value").over(w)) / 2 * step
    alone = F.count("*").over(Window.partitionBy(*keys, "_isl")) == 1
    parts = marked.select(*keys, F.when(alone, F.col("value")).otherwise(area).alias("_num"), F.when(alone, F.lit(1.0)).otherwise(step).alias("_den"))
    return parts.groupBy(*keys).agg(F.sum("_num").alias("num"), F.sum("_den").alias("den"))


def reduce_1d(sel: DataFrame, keys: Sequence[str], reducer: str, pos: str = "t_pos", coord: str = "t_coord", numeric: bool = True) -> DataFrame:
    """One value per key of a selection (rows with value, positions, and w_len for the run reducers).

    mean: trapezoid integral over contiguous finite runs by their length (plain mean on a categorical axis);
    median: of finite values; count: finite runs; occupation: their duration by the requested length (a
    proportion); rate: runs by that length; duration: their mean duration. NULL where undefined; a key whose
    selection holds no value gives NULL (count and occupation 0).
    """
    every = sel.select(*keys).distinct()
    if reducer == "median":
        return sel.groupBy(*keys).agg(F.median("value").alias("value"))
    if reducer == "mean" and not numeric:
        return sel.groupBy(*keys).agg(F.avg("value").alias("value"))
    if reducer == "mean":
        got = trapezoids(sel, keys, pos, coord).select(*keys, F.try_divide("num", "den").alias("value"))
        return meet(every, got, keys, "left")
    if reducer not in REDUCERS:
        raise ValueError(f"unknown reducer {reducer}")
    spans = _with_islands(sel, keys, pos).groupBy(*keys, "_isl").agg((F.max(coord) - F.min(coord)).alias("_d"), F.first("w_len").alias("w_len"))
    stats = spans.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_d").alias("_sum"), F.first("w_len").alias("w_len"))
    value = {"count": F.col("_n").cast("double"), "occupation": F.try_divide("_sum", "w_len"), "rate": F.try_divide("_n", "w_len"), "duration": F.try_divide("_sum", "_n")}[reducer]
    out = meet(every, stats.select(*keys, value.alias("value")), keys, "left")
    return out.withColumn("value", F.coalesce("value", F.lit(0.0))) if reducer in ("count", "occupation") else out


def reduce_2d(sel: DataFrame, keys: Sequence[str], reducer: str) -> DataFrame:
    """As reduce_1d for frequency-by-time selections.

    mean: integral over frequency per time, then numerator and denominator integrated over time, and their ratio;
    median: of all; the run reducers: over times at which any selected frequency is finite.
    """
    if reducer == "median":
        return sel.groupBy(*keys).agg(F.median("value").alias("value"))
    per_time = [*keys, "t_pos", "t_coord"]
    if reducer == "mean":
        inner = trapezoids(sel, per_time, "f_pos", "f_coord")
        num = trapezoids(inner, keys, "t_pos", "t_coord", "num").select(*keys, F.col("num").alias("_a"))
        den = trapezoids(inner, keys, "t_pos", "t_coord", "den").select(*keys, F.col("num").alias("_b"))
        return meet(sel.select(*keys).distinct(), meet(num, den, keys).select(*keys, F.try_divide("_a", "_b").alias("value")), keys, "left")
    any_finite = sel.groupBy(*per_time, "w_len").agg(F.max("value").alias("value"))
    return reduce_1d(any_finite, keys, reducer)


def grid(cells: DataFrame, phases: DataFrame, reducer: str, meta: Sequence[str] = (), bands: DataFrame | None = None, numeric: bool = True) -> DataFrame:
    """Every cell by phase (and band) to one scalar; meta columns are carried."""
    sel = select_wells(cells, phases).withColumnRenamed("well", "phase")
    keys = ["row_id", *meta, "phase"]
    if bands is None:
        return reduce_1d(sel, keys, reducer, numeric=numeric)
    sel = select_wells(sel.withColumnRenamed("w_len", "_pl"), bands, "f_coord").withColumnRenamed("well", "band").drop("w_len").withColumnRenamed("_pl", "w_len")
    return reduce_2d(sel, [*keys, "band"], reducer)


def split_by_time(cells: DataFrame, phases: DataFrame, reducer: str, meta: Sequence[str] = ()) -> DataFrame:
    """Time wells reduced, the spectrum over frequency kept."""
    sel = select_wells(cells, phases).withColumnRenamed("well", "phase")
    return reduce_1d(sel, ["row_id", *meta, "phase", "f_pos", "f_coord"], reducer)


def split_by_freq(cells: DataFrame, bands: DataFrame, reducer: str, meta: Sequence[str] = ()) -> DataFrame:
    """Bands reduced, the trace over time kept."""
    sel = select_wells(cells, bands, "f_coord").withColumnRenamed("well", "band")
    return reduce_1d(sel, ["row_id", *meta, "band", "t_pos", "t_coord"], reducer, "f_pos", "f_coord")


def extract_features(cells: DataFrame, phases: DataFrame, bands: DataFrame, plan: DataFrame | None = None, reducers: Sequence[str] = REDUCERS, meta: Sequence[str] = ()) -> DataFrame:
    """All reducers of all metrics in one plan: row_id, meta, reducer, band, phase, value.

    plan: (metric, reducer) pairs wanted per metric; meta must then hold metric.
    """
    out = None
    for r in reducers:
        part = grid(cells, phases, r, meta, bands).withColumn("reducer", F.lit(r))
        out = part if out is None else out.unionByName(part)
    return out if plan is None else out.join(F.broadcast(plan), ["metric", "reducer"], "left_semi")


def any_missing(cells: DataFrame) -> DataFrame:
    """row_id, any_missing, all_missing, n: empty cells (no rows) are absent and count as missing."""
    return cells.groupBy("row_id").agg(F.max(F.col("value").isNull()).alias("any_missing"), F.min(F.col("value").isNull()).alias("all_missing"), F.count("*").alias("n"))


def crop(cells: DataFrame, lo: float, hi: float, coord: str = "t_coord") -> DataFrame:
    """Positions of a closed window."""
    return cells.where(F.col(coord).between(lo, hi))


def shift_axis(cells: DataFrame, by: float, labels: dict[str, str] | None = None) -> DataFrame:
    """Time moved by ``by`` and row labels renamed, for display."""
    out = cells.withColumn("t_coord", F.col("t_coord") - by)
    if labels:
        table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
        out = out.withColumn("f_label", F.coalesce(table[F.col("f_label")], F.col("f_label")))
    return out


def auto_bands(cells: DataFrame) -> DataFrame:
    """Row labels of the data, as bands of their own."""
    return cells.select(F.col("f_label").alias("band")).where("band is not null").distinct()
