"""Interval algebra and runs by position: unions, gaps, masks, islands.

Intervals are rows (keys..., start, end). Joins always carry the keys, so that Spark plans an
equi join with the range as a residual; ``range_join`` also deals long records into time
buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def union_intervals(df: DataFrame, keys: Keys, start: str = "start", end: str = "end", gap: float = 0.0, empty: str = "keep") -> DataFrame:
    """Merge intervals of a key that touch, overlap, or lie at most ``gap`` apart: keys, start, end.

    Reversed ends are swapped. ``empty="drop"`` leaves out zero-length ones. Null ends are ignored.
    """
    df = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.least(start, end).alias("s"), F.greatest(start, end).alias("e"))
    if empty == "drop":
        df = df.where("e > s")
    order = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("new", F.when(before.isNull() | (F.col("s") > before + F.lit(gap)), 1).otherwise(0))
    return marked.withColumn("part", F.sum("new").over(order)).groupBy(*keys, "part").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("part")


def total_length(df: DataFrame, keys: Keys) -> DataFrame:
    """Covered length per key, intervals taken as they are."""
    return df.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start"))).alias("length"))


def gaps(df: DataFrame, keys: Keys) -> DataFrame:
    """Spaces between successive merged intervals of a key."""
    after = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    return df.select(*keys, F.col("end").alias("start"), after.alias("end")).where("end > start")


def short_gaps(df: DataFrame, keys: Keys, least: float) -> DataFrame:
    """Bad intervals together with the good stretches between them that are shorter than ``least``, merged."""
    merged = union_intervals(df, keys)
    return union_intervals(merged.unionByName(gaps(merged, keys).where(F.col("end") - F.col("start") < least)), keys)


def clip(df: DataFrame, low: Column, high: Column, pad: float = 0.0) -> DataFrame:
    """Widen by ``pad`` on both sides and cut at the record's bounds; what lies outside goes."""
    out = df.withColumns({"start": F.greatest(F.col("start") - pad, low), "end": F.least(F.col("end") + pad, high)})
    return out.where("start <= end")


def range_join(left: DataFrame, right: DataFrame, keys: Keys, condition: Column, how: str = "inner", bucket: float | None = None, at: str = "t", start: str = "start", end: str = "end") -> DataFrame:
    """Join points or intervals on keys and a range condition.

    With ``bucket`` (seconds), points of the left side meet only the intervals of their time bucket, so one long
    record spreads over many tasks; intervals are repeated once per bucket they cover.
    """
    if bucket is None:
        return left.join(right, (reduce_and([left[k].eqNullSafe(right[k]) for k in keys])) & condition, how)
    left = left.withColumn("_bucket", F.floor(F.col(at) / bucket))
    right = right.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    on = reduce_and([left[k].eqNullSafe(right[k]) for k in (*keys, "_bucket")])
    out = left.join(right, on & condition, how)
    return out.drop(left["_bucket"]).drop(right["_bucket"]) if how not in ("left_semi", "left_anti") else out.drop("_bucket")


def meet(left: DataFrame, right: DataFrame, keys: Keys, how: str = "inner") -> DataFrame:
    """Join on keys for which NULL equals NULL: left's columns, then right's without the keys."""
    r = right.select(*(F.col(f"`{k}`").alias(f"_j{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`") for c in right.columns if c not in keys))
    out = left.join(r, reduce_and([left[f"`{k}`"].eqNullSafe(r[f"_j{i}"]) for i, k in enumerate(keys)]), how)
    return out.drop(*(f"_j{i}" for i in range(len(keys))))


def reduce_and(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def reduce_or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def drop_overlapping(df: DataFrame, drops: DataFrame, keys: Keys) -> DataFrame:
    """Intervals that touch no drop interval; both ends are closed, and points count."""
    a, b = df.alias("a"), drops.alias("b")
    on = reduce_and([F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(b, on & (F.col("a.start") <= F.col("b.end")) & (F.col("a.end") >= F.col("b.start")), "left_anti")


def keep_within(df: DataFrame, union: DataFrame, keys: Keys, split: bool = True) -> DataFrame:
    """Intervals against a merged union: covered ones stay whole, outside ones go, partly covered are cut to the
    common parts (``split``) or dropped. Points inside the union stay. Adds nothing; columns of df are kept.
    """
    extra = [c for c in df.columns if c not in (*keys, "start", "end")]
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    u = union.select(*keys, F.col("start").alias("_us"), F.col("end").alias("_ue"))
    on = reduce_and([numbered[k].eqNullSafe(u[k]) for k in keys])
    met = numbered.join(u, on & (numbered["start"] <= u["_ue"]) & (numbered["end"] >= u["_us"])).select(*(numbered[c] for c in numbered.columns), "_us", "_ue")
    cut = met.withColumns({"_s": F.greatest("start", "_us"), "_e": F.least("end", "_ue")})
    cut = cut.where((F.col("_e") > F.col("_s")) | (F.col("start") == F.col("end")))
    covered = (F.col("_s") == F.col("start")) & (F.col("_e") == F.col("end"))
    if not split:
        cut = cut.where(covered)
    cut = cut.dropDuplicates(["_id", "_s", "_e"])
    return cut.select(*keys, F.col("_s").alias("start"), F.col("_e").alias("end"), *extra)


def subtract(df: DataFrame, union: DataFrame, keys: Keys, split: bool = True) -> DataFrame:
    """Intervals minus a merged union: the remaining parts (``split``), or only untouched intervals; points inside go.

    An interval that only touches the union at an end stays whole.
    """
    extra = [c for c in df.columns if c not in (*keys, "start", "end")]
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    u = union.select(*keys, F.col("start").alias("_us"), F.col("end").alias("_ue"))
    on = reduce_and([numbered[k].eqNullSafe(u[k]) for k in keys])
    hit = (u["_us"] < numbered["end"]) & (u["_ue"] > numbered["start"]) | (numbered["start"] == numbered["end"]) & (u["_us"] <= numbered["start"]) & (u["_ue"] >= numbered["end"])
    met = numbered.join(u, on & hit, "left")
    met = met.select(*(numbered[c] for c in numbered.columns), "_us", "_ue")
    own = Window.partitionBy("_id")
    whole = met.where("_us is null").select(*keys, "start", "end", *extra)
    if not split:
        return whole
    order = own.orderBy("_us")
    parts = met.where("_us is not null and end > start").withColumns({"_from": F.coalesce(F.lag("_ue").over(order), F.col("start")), "_last": F.lead("_us").over(order).isNull()})
    before = parts.select(*keys, F.col("_from").alias("start"), F.col("_us").alias("end"), *extra)
    after = parts.where("_last").select(*keys, F.col("_ue").alias("start"), "end", *extra)
    return whole.unionByName(before.unionByName(after).where("end > start"))


def points_in(points: DataFrame, intervals: DataFrame, keys: Keys, t: str = "t", inside: bool = True) -> DataFrame:
    """Points that lie in a closed interval of their key (or in none)."""
    a, b = points.alias("a"), intervals.alias("b")
    on = reduce_and([F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(b, on & F.col(f"a.{t}").between(F.col("b.start"), F.col("b.end")), "left_semi" if inside else "left_anti")


def mask_by_radius(points: DataFrame, intervals: DataFrame, radii: DataFrame, keys: Keys, t: str = "t", freq: str = "freq", value: str = "value") -> DataFrame:
    """Null the values within an interval widened by its frequency's radius (both ends closed)."""
    wide = intervals.select(*keys, "start", "end").join(F.broadcast(radii.select(F.col(freq).alias("_f"), "radius")))
    wide = wide.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_f", (F.col("start") - F.col("radius")).alias("_s"), (F.col("end") + F.col("radius")).alias("_e"))
    wide = union_intervals(wide, [*(f"_k{i}" for i in range(len(keys))), "_f"], "_s", "_e")
    on = reduce_and([points[k].eqNullSafe(wide[f"_k{i}"]) for i, k in enumerate(keys)]) & (points[freq] == wide["_f"]) & points[t].between(wide["start"], wide["end"])
    joined = points.join(wide, on, "left")
    return joined.select(*(points[c] if c != value else F.when(wide["start"].isNull(), points[value]).alias(value) for c in points.columns))


def islands(df: DataFrame, keys: Keys, pos: str, valid: Column) -> DataFrame:
    """Rows where ``valid`` holds, with the number of their run of adjacent positions (column island)."""
    return df.where(valid).withColumn("island", F.col(pos) - F.row_number().over(Window.partitionBy(*keys).orderBy(pos)))


def runs(df: DataFrame, keys: Keys, pos: str, valid: Column, least: int = 1) -> DataFrame:
    """Runs of adjacent valid positions of at least ``least`` rows: keys, first, last, n."""
    out = islands(df, keys, pos, valid).groupBy(*keys, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("island")


def prune_runs(df: DataFrame, keys: Keys, pos: str, valid: Column, least: int) -> DataFrame:
    """Rows of runs that are long enough."""
    marked = islands(df, keys, pos, valid)
    return marked.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "island"))).where(F.col("_n") >= least).drop("_n", "island")


def key_groups(df: DataFrame, order: str, key: str, keys: Keys = ()) -> DataFrame:
    """Number (column group) of each run of equal ``key`` values in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("group", F.sum("_c").over(w)).drop("_c")


def split_bands(bands: DataFrame, holes: DataFrame) -> DataFrame:
    """Bands (band, start, end) without the holes (start, end): their segments, in order of frequency."""
    merged = union_intervals(holes.select(F.lit(0).alias("_k"), "start", "end"), ["_k"])
    return subtract(bands.withColumn("_k", F.lit(0)), merged, ["_k"]).drop("_k")


def dealt(df: DataFrame, keys: Keys) -> DataFrame:
    """df by keys in exactly ``spark.sql.shuffle.partitions`` parts.

    Adaptive execution joins the parts of its own exchanges by their compressed size, and gives a branch of a union one part alone; sorts and hash tables
    hold many times that. These parts it leaves as they are, so what a task holds is its share of the rows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(F.col(f"`{k}`") for k in keys))


def remove_and_close(samples: DataFrame, bad: DataFrame, keys: Keys, idx: str = "sample_idx") -> DataFrame:
    """Samples outside bad index ranges [start, end), renumbered without gaps (column new_idx).

    One pass over samples and ends of ranges in order: how many ranges are open tells whether a sample goes, and the stretches passed with one open are what the
    later samples move by. Reversed ends are swapped, ranges with a null end ignored; a sample without an index stays, without a new one.
    """
    own = samples.columns
    ends = bad.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select(*keys, F.explode(F.array(*(F.struct(at.alias("_at"), F.lit(d).alias("_d")) for at, d in ((F.least("start", "end"), 1), (F.greatest("start", "end"), -1))))).alias("_e"))
    ends = ends.select(*keys, F.col("_e._at").alias("_at"), F.col("_e._d").alias("_d"))
    rows = dealt(samples.withColumn("_at", F.col(idx)).unionByName(ends, allowMissingColumns=True), keys)
    sample = F.col("_d").isNull()
    order = Window.partitionBy(*keys).orderBy("_at", sample)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_open": F.coalesce(F.sum("_d").over(order), F.lit(0)), "_gap": F.when(F.sum("_d").over(before) > 0, F.col("_at") - F.lag("_at").over(order))})
    removed = F.coalesce(F.sum("_gap").over(order), F.lit(0)).cast("long")
    return rows.withColumn("_removed", removed).where(sample & (F.col("_open") == 0)).select(*(F.col(f"`{c}`") for c in own), (F.col(idx) - F.col("_removed")).alias("new_idx"))


def compress_annotations(annotations: DataFrame, bad: DataFrame, keys: Keys) -> DataFrame:
    """Annotations on the closed timeline: the time of bad intervals before and inside them is taken out."""
    merged = union_intervals(bad, keys).select(*keys, F.col("start").alias("_bs"), F.col("end").alias("_be"))
    numbered = annotations.withColumn("_id", F.monotonically_increasing_id())
    on = reduce_and([numbered[k].eqNullSafe(merged[k]) for k in keys])
    met = numbered.join(merged, on & (merged["_bs"] < numbered["end"]), "left")
    taken = lambda at: F.coalesce(F.sum(F.greatest(F.lit(0), F.least(numbered[at], F.col("_be")) - F.col("_bs"))), F.lit(0))
    own = [F.first(numbered[c]).alias(c) for c in annotations.columns]
    out = met.groupBy(numbered["_id"]).agg(*own, taken("start").alias("_ls"), taken("end").alias("_le"))
    return out.withColumns({"start": F.col("start") - F.col("_ls"), "end": F.col("end") - F.col("_le")}).drop("_id", "_ls", "_le")


def edges(df: DataFrame, keys: Keys, t: str, width: float) -> DataFrame:
    """EDGE intervals of ``width`` at the head and tail of each record (points when width is 0)."""
    ends = df.groupBy(*keys).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    head = ends.select(*keys, F.col("lo").alias("start"), F.least(F.col("lo") + width, F.col("hi")).alias("end"), F.lit("EDGE").alias("description"))
    tail = ends.select(*keys, F.greatest(F.col("hi") - width, F.col("lo")).alias("start"), F.col("hi").alias("end"), F.lit("EDGE").alias("description"))
    return head.unionByName(tail)
