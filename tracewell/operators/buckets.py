"""Running values and runs of long records, dealt into buckets of positions.

A record is cut into buckets; each is worked on by itself, and what one bucket needs of the others (a sum, an extreme, the nearest
value, whether a run goes on) is a row per bucket. A window over a record then sees its buckets, not its samples, so one record spreads over as many
tasks as it has buckets. Results do not depend on the bucket size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.intervals import reduce_and


@dataclass
class Scan:
    """A running value: ``sum``, ``min`` or ``max`` of the rows so far, or the ``near``-est value that is not NULL.

    ``after``: of the rows from here on; ``own``: with the row itself.
    """

    value: Column
    kind: str
    after: bool = False
    own: bool = True

    def over(self, value: Column, keys: Sequence[str], place: str) -> Column:
        """Along ``place``, which tells all rows of the keys apart; backwards by an order from the end, as a frame up to the end would be read anew for each row."""
        w = Window.partitionBy(*keys).orderBy(F.desc(place) if self.after else F.asc(place))
        return self._of(value).over(w.rowsBetween(Window.unboundedPreceding, 0 if self.own else -1))

    def _of(self, value: Column) -> Column:
        if self.kind == "near":
            return F.last(value, ignorenulls=True)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](value)

    def total(self, value: Column, order: Sequence[str]) -> Column:
        """Of a whole bucket."""
        if self.kind == "near":
            at = F.when(value.isNotNull(), F.struct(*order))
            return F.min_by(value, at) if self.after else F.max_by(value, at)
        return self._of(value)

    def both(self, here: Column, carried: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(here + carried, here, carried)
        return {"near": F.coalesce, "min": F.least, "max": F.greatest}[self.kind](here, carried)


def by_size(pos: str, size: float) -> Column:
    """Buckets of ``size`` positions."""
    return F.floor(F.col(pos) / size)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: dict[str, Scan]) -> DataFrame:
    """df with a column for each running value in ascending ``order`` within its keys; ``bucket`` must not fall in that order. NULL keys are a key."""
    names = {name: f"_v{i}" for i, name in enumerate(values)}
    d = df.withColumns({"_b": bucket} | {names[n]: s.value for n, s in values.items()})
    bucketed = [*keys, "_b"]
    totals = d.groupBy(*keys, "_b").agg(*(s.total(F.col(names[n]), order).alias(names[n]) for n, s in values.items()))
    others = [Scan(F.col(names[n]), s.kind, s.after, own=False).over(F.col(names[n]), keys, "_b").alias(f"_c{i}") for i, (n, s) in enumerate(values.items())]
    carried = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_kb"), *others)
    here = d.withColumn("_at", F.row_number().over(Window.partitionBy(*bucketed).orderBy(*order)))
    here = here.withColumns({f"_h{i}": s.over(F.col(names[n]), bucketed, "_at") for i, (n, s) in enumerate(values.items())})
    on = reduce_and([here[k].eqNullSafe(carried[f"_k{i}"]) for i, k in enumerate(keys)]) & here["_b"].eqNullSafe(carried["_kb"])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in values]
    return here.join(carried, on).select(*kept, *(s.both(F.col(f"_h{i}"), F.col(f"_c{i}")).alias(n) for i, (n, s) in enumerate(values.items())))


def _partial_runs(df: DataFrame, keys: Sequence[str], pos: str, valid: Column, size: int) -> DataFrame:
    """Valid rows with their bucket (_b) and the number of their run within it (_i)."""
    rows = df.where(valid).withColumn("_b", by_size(pos, size))
    return rows.withColumn("_i", F.col(pos) - F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(pos)))


def _stitched(rows: DataFrame, keys: Sequence[str], pos: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(inner, edge): partial runs that touch no end of their bucket, and those that do with the ends and length of the whole run they are part of."""
    parts = rows.groupBy(*keys, "_b", "_i").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"))
    at_edge = (F.col("first") == F.col("_b") * size) | (F.col("last") == (F.col("_b") + 1) * size - 1)
    w = Window.partitionBy(*keys).orderBy("first")
    edge = parts.where(at_edge)
    edge = edge.withColumn("_new", F.when(F.lag("last").over(w) == F.col("first") - 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    whole = Window.partitionBy(*keys, "_run")
    edge = edge.withColumns({"_first": F.min("first").over(whole), "_last": F.max("last").over(whole), "_n": F.sum("n").over(whole)})
    return parts.where(~at_edge), edge


def runs(df: DataFrame, keys: Sequence[str], pos: str, valid: Column, least: int = 1, size: int = 65536) -> DataFrame:
    """Runs of adjacent valid positions (integers, each once) of at least ``least`` rows: keys, first, last, n.

    Runs inside a bucket are whole; of each bucket at most two others go on and are joined to their neighbours.
    """
    inner, edge = _stitched(_partial_runs(df, keys, pos, valid, size), keys, pos, size)
    joined = edge.where("first = _first").select(*keys, "first", F.col("_last").alias("last"), F.col("_n").alias("n"))
    return inner.select(*keys, "first", "last", "n").unionByName(joined).where(F.col("n") >= least)


def prune_runs(df: DataFrame, keys: Sequence[str], pos: str, valid: Column, least: int, size: int = 65536) -> DataFrame:
    """Rows of runs that are long enough."""
    rows = _partial_runs(df, keys, pos, valid, size)
    _, edge = _stitched(rows, keys, pos, size)
    e = edge.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_eb"), F.col("_i").alias("_ei"), "_n")
    own = F.count("*").over(Window.partitionBy(*keys, "_b", "_i"))
    on = reduce_and([rows[k].eqNullSafe(e[f"_k{i}"]) for i, k in enumerate(keys)]) & (F.col("_b") == F.col("_eb")) & (F.col("_i") == F.col("_ei"))
    return rows.withColumn("_own", own).join(e, on, "left").where(F.coalesce("_n", "_own") >= least).select(*(F.col(f"`{c}`") for c in df.columns))


def union_intervals(df: DataFrame, keys: Sequence[str], size: float, start: str = "start", end: str = "end", gap: float = 0.0, empty: str = "keep") -> DataFrame:
    """``intervals.union_intervals`` with each record dealt by start time into buckets of ``size``."""
    df = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.least(start, end).alias("s"), F.greatest(start, end).alias("e"))
    if empty == "drop":
        df = df.where("e > s")
    # Intervals of one start can stand in any order: the last of them decides how far the union reaches.
    reach = scan(df.groupBy(*keys, "s").agg(F.max("e").alias("e")), keys, ["s"], by_size("s", size), {"_before": Scan(F.col("e"), "max", own=False)})
    new = F.when(F.col("_before").isNull() | (F.col("s") > F.col("_before") + F.lit(gap)), 1).otherwise(0)
    marked = scan(reach, keys, ["s"], by_size("s", size), {"part": Scan(new, "sum")})
    return marked.groupBy(*keys, "part").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("part")


def gaps(df: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Spaces between successive merged intervals of a key."""
    out = scan(df, keys, ["start"], by_size("start", size), {"_next": Scan(F.col("start"), "near", after=True, own=False)})
    return out.select(*keys, F.col("end").alias("start"), F.col("_next").alias("end")).where("end > start")


def missing_ranges(df: DataFrame, keys: Sequence[str], index: str, size: int = 65536) -> DataFrame:
    """Missing index ranges between a key's first and last packet: keys, first, last, n."""
    out = scan(df.select(*keys, index), keys, [index], by_size(index, size), {"_next": Scan(F.col(index), "near", after=True, own=False)})
    out = out.select(*keys, (F.col(index) + 1).alias("first"), (F.col("_next") - 1).alias("last")).where("last >= first")
    return out.withColumn("n", F.col("last") - F.col("first") + 1)


def sample_cursor(packets: DataFrame, keys: Sequence[str], index: str, length: str, first: int = 0, size: int = 65536) -> DataFrame:
    """``packets.sample_cursor``: lost packets before each, and its start sample if they are filled with the mode length."""
    from tracewell.operators.packets import mode_length

    modes = mode_length(packets, keys, length)
    modes = modes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "mode_length")
    out = packets.join(modes, reduce_and([packets[k].eqNullSafe(modes[f"_k{i}"]) for i, k in enumerate(keys)])).select(*(packets[c] for c in packets.columns), "mode_length")
    out = scan(out, keys, [index], by_size(index, size), {"_prev": Scan(F.col(index), "near", own=False)})
    out = out.withColumn("lost", F.col(index) - F.coalesce(F.col("_prev") + 1, F.lit(first)))
    sums = {"_full": Scan(F.col(length), "sum", own=False), "_empty": Scan(F.col("lost") * F.col("mode_length"), "sum")}
    out = scan(out, keys, [index], by_size(index, size), sums)
    return out.withColumn("start_sample", F.coalesce("_full", F.lit(0)) + F.col("_empty")).drop("mode_length", "_prev", "_full", "_empty")


def interpolate(cells: DataFrame, keys: Sequence[str], size: float, pos: str = "f_coord") -> DataFrame:
    """``tensors.interpolate``: missing values linearly between their known neighbours, edges held; rows of keys with under two known values stay NULL."""
    known = F.when(F.col("value").isNotNull(), F.struct(F.col(pos).alias("p"), F.col("value").alias("v")))
    df = scan(cells, keys, [pos], by_size(pos, size), {"_lo": Scan(known, "near"), "_hi": Scan(known, "near", after=True)})
    lo, hi = F.col("_lo"), F.col("_hi")
    blend = lo.v + (hi.v - lo.v) * (F.col(pos) - lo.p) / (hi.p - lo.p)
    # A key's only known value is both neighbours where it stands, and the only one elsewhere.
    counted = cells.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count("value").alias("_n"))
    df = df.join(counted, reduce_and([df[k].eqNullSafe(counted[f"_k{i}"]) for i, k in enumerate(keys)]))
    value = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("_n") < 2, F.lit(None)).when(lo.isNull(), hi.v).when(hi.isNull(), lo.v).otherwise(blend)
    return df.withColumn("value", value).select(*(F.col(f"`{c}`") for c in cells.columns))


def circular_fill(cells: DataFrame, keys: Sequence[str], size: int = 65536) -> DataFrame:
    """``cohort.circular_fill``: missing positions (t_pos from 0) of a cyclic trace between their neighbours around the circle; a trace without values is an error."""
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("t_pos").cast("long").alias("p"), F.col("value").alias("v")))
    df = scan(cells, keys, ["t_pos"], by_size("t_pos", size), {"_lo": Scan(known, "near"), "_hi": Scan(known, "near", after=True)})
    ends = cells.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_n"), F.min(known).alias("_first"), F.max(known).alias("_last"))
    df = df.join(ends, reduce_and([df[k].eqNullSafe(ends[f"_k{i}"]) for i, k in enumerate(keys)]))
    # Before the first value stands the last one of the round before, after the last the first of the next.
    around = lambda end, turns: F.struct((F.col(end).p + turns * F.col("_n")).alias("p"), F.col(end).v.alias("v"))
    df = df.withColumns({"_lo": F.coalesce("_lo", around("_last", -1)), "_hi": F.coalesce("_hi", around("_first", 1))})
    lo, hi = F.col("_lo"), F.col("_hi")
    blend = F.when(hi.p == lo.p, lo.v).otherwise(lo.v + (hi.v - lo.v) * (F.col("t_pos") - lo.p) / (hi.p - lo.p))
    value = F.when(F.col("_first").isNull(), F.raise_error(F.lit("a trace holds no value")).cast("double")).otherwise(blend)
    return df.withColumn("value", value).select(*(F.col(f"`{c}`") for c in cells.columns))
