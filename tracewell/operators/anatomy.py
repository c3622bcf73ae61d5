"""Locations: coordinates of channels and pairs, atlas lookup, joins of features to them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.cohort import pair_key
from tracewell.operators.intervals import meet

#: Channels on a side of a square of pairs.
SIDE = 2048


def join_coordinates(features: DataFrame, dim: DataFrame, on: Sequence[str], order: str, small: bool = True) -> DataFrame:
    """Left join to a dimension, its first row per key (by ``order``) kept; clashing columns get ``_repcoord``.

    ``small`` says that the dimension is known to be small (one row per channel) and may be broadcast.
    """
    w = Window.partitionBy(*on).orderBy(order)
    first = dim.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", *([order] if order not in on else []))
    taken = set(features.columns)
    for c in first.columns:
        if c not in on and c in taken:
            name, i = f"{c}_repcoord", 1
            while name in taken or name in first.columns:
                name, i = f"{c}_repcoord_{i}", i + 1
            first = first.withColumnRenamed(c, name)
    return features.join(F.broadcast(first) if small else first, list(on), "left")


def join_pairs(features: DataFrame, dim: DataFrame, a: str, b: str, order: str, ordered: bool = True) -> DataFrame:
    """As join_coordinates on a pair; unordered pairs match either way round."""
    f = features.withColumn("_pair", pair_key(F.col(a), F.col(b), ordered))
    d = dim.withColumn("_pair", pair_key(F.col(a), F.col(b), ordered)).drop(a, b)
    return join_coordinates(f, d, ["_pair"], order).drop("_pair")


def ordered_pairs(channels: DataFrame, keys: Sequence[str], regions: Sequence[tuple[str, str]], name: str = "channel") -> DataFrame:
    """All ordered pairs of a record's channels with both coordinates and ``A-B_in`` (a in A and b in B)."""
    return _pairs(channels, keys, regions, name, F.col("a") != F.col("b"), False)


def unordered_pairs(channels: DataFrame, keys: Sequence[str], regions: Sequence[tuple[str, str]], name: str = "channel") -> DataFrame:
    """Each pair once, ``A-B_in`` either way round."""
    return _pairs(channels, keys, regions, name, F.col("a") < F.col("b"), True)


def _pairs(channels: DataFrame, keys: Sequence[str], regions: Sequence[tuple[str, str]], name: str, which: Column, both: bool) -> DataFrame:
    own = [c for c in channels.columns if c not in keys and c != name]
    left = channels.select(*keys, F.col(name).alias("a"), *(F.col(c).alias(f"{c}_a") for c in own))
    right = channels.select(*keys, F.col(name).alias("b"), *(F.col(c).alias(f"{c}_b") for c in own))
    out = _squares(left, right, keys).where(which)
    flag = lambda r, s: F.coalesce(F.col(f"{r}_in_{s}"), F.lit(False))
    marks = {f"{p}-{q}_in": (flag(p, "a") & flag(q, "b")) | (flag(q, "a") & flag(p, "b") if both else F.lit(False)) for p, q in regions}
    xyz = [c for c in own if not c.endswith("_in")]
    return out.withColumns(marks).select(*keys, "a", "b", *(f"{c}_{s}" for c in xyz for s in ("a", "b")), *marks)


def _squares(left: DataFrame, right: DataFrame, keys: Sequence[str], side: int = SIDE) -> DataFrame:
    """Inner join of two sides of the same rows by keys (NULL is a key), as ``meet``.

    A record of n rows has n * n pairs however few bytes it holds, so its rows are dealt into parts of about ``side``, and every two parts are a square
    that is met on its own; there are as many tasks as squares of full size. What is exchanged is a row for each ``side / 2`` pairs.
    """
    n = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    pairs = n.agg(F.sum(F.col("_n").cast("double") ** 2)).first()[0] or 0
    if pairs <= side * side:
        return meet(left, right, keys)
    tasks = min(math.ceil(pairs / side / side), 20000)
    n = n.withColumn("_n", F.ceil(F.col("_n") / side))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*rows.columns), F.col("_n"))
        out = meet(rows, n, keys).withColumns({own: part, other: F.explode(F.sequence(F.lit(0), F.col("_n") - 1))})
        # One column of one type on both sides: its NULLs are equal, and its partitions are those of the join.
        square = F.struct(*keys, *(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("_l", "_r")))
        return out.withColumn("_square", square).drop("_n", "_l", "_r").repartition(tasks, "_square")

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l").drop(*keys), "_square").drop("_square")


def contact_coordinates(channels: DataFrame, contacts: DataFrame, keys: Sequence[str], rep: str = "midpoint") -> DataFrame:
    """Coordinates of channels (anode, cathode) at the anode, the cathode or between; a case or ground cathode allows the anode only."""
    c = F.broadcast(contacts)
    a = c.select(*keys, F.col("contact").alias("anode"), *(F.col(x).alias(f"_a{x}") for x in "xyz"))
    k = c.select(*keys, F.col("contact").alias("cathode"), *(F.col(x).alias(f"_c{x}") for x in "xyz"))
    out = channels.join(a, [*keys, "anode"], "left").join(k, [*keys, "cathode"], "left")
    alone = F.lower("cathode").isin("case", "ground")
    pick = {"anode": lambda x: F.col(f"_a{x}"), "cathode": lambda x: F.when(~alone, F.col(f"_c{x}")), "midpoint": lambda x: F.when(~alone, (F.col(f"_a{x}") + F.col(f"_c{x}")) / 2)}[rep]
    return out.withColumns({x: pick(x) for x in "xyz"}).drop(*(f"_{s}{x}" for s in "ac" for x in "xyz"))


def voxel_of(x: Column, y: Column, z: Column, inverse: Sequence[Sequence[float]]) -> list[Column]:
    """Voxel indexes by an inverse affine (3 rows of 4), halves to even."""
    return [F.bround(x * r[0] + y * r[1] + z * r[2] + r[3]).cast("int") for r in inverse]


def region_membership(points: DataFrame, voxels: DataFrame, inverse: Sequence[Sequence[float]], shape: Sequence[int], threshold: float = 0.0, key: str = "channel") -> DataFrame:
    """key, region, inside: the voxel's weight is over the threshold in any file of the region.

    Points without coordinates or outside the volume are in no region.
    """
    i, j, k = voxel_of(F.col("x"), F.col("y"), F.col("z"), inverse)
    p = points.select(key, i.alias("i"), j.alias("j"), k.alias("k"))
    p = p.withColumn("_ok", F.coalesce(F.col("i").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1) & F.col("k").between(0, shape[2] - 1), F.lit(False)))
    regions = F.broadcast(voxels.select("region").distinct())
    hits = p.where("_ok").join(voxels.where(F.col("weight") > threshold), ["i", "j", "k"]).select(key, "region").distinct().withColumn("inside", F.lit(True))
    return p.select(key).distinct().join(regions).join(hits, [key, "region"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def centre_of_gravity(voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value-weighted centre per region; without weight the origin."""
    total = F.sum("weight")
    return voxels.groupBy(*keys).agg(*(F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("weight")), F.nullif(total, F.lit(0.0))), F.lit(0.0)).alias(c) for c in ("x", "y", "z")))


def contact_midpoints(contacts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Midpoints of successive contacts, the last having none."""
    w = Window.partitionBy(*keys).orderBy(order)
    return contacts.withColumns({f"{c}_mid": (F.col(c) + F.lead(c).over(w)) / 2 for c in "xyz"}).where("x_mid is not null")


def self_pairs(channels: DataFrame, keys: Sequence[str], ordered: bool = False, group: str | None = None, pos: str = "pos", name: str = "channel") -> DataFrame:
    """Channel pairs of a record (within a group, if given), each once or in both orders: keys, a, b."""
    on = [*keys, *([group] if group else [])]
    a = channels.select(*on, F.col(pos).alias("_pa"), F.col(name).alias("a"))
    b = channels.select(*on, F.col(pos).alias("_pb"), F.col(name).alias("b"))
    a, b = (x.dropna(subset=on) for x in (a, b))
    return _squares(a, b, on).where(F.col("_pa") != F.col("_pb") if ordered else F.col("_pa") < F.col("_pb")).select(*on, "a", "b")


def resolve_pairs(channels: DataFrame, keys: Sequence[str], pairs: DataFrame | None = None, group: str | None = None, ordered: bool = False) -> DataFrame:
    """All pairs, pairs within groups, or listed ones; lists and groups together are an error."""
    if pairs is not None and group:
        raise ValueError("give pairs or groups, not both")
    return clean_pairs(pairs, channels, ordered) if pairs is not None else self_pairs(channels, keys, ordered, group)


def clean_pairs(pairs: DataFrame, channels: DataFrame, ordered: bool = False, name: str = "channel") -> DataFrame:
    """Listed pairs trimmed, self and unknown ones dropped, unordered ones sorted, repeats once."""
    p = pairs.select(F.trim("a").alias("a"), F.trim("b").alias("b")).where("a <> b")
    known = channels.select(F.col(name).alias("_n")).distinct()
    p = p.join(known, p["a"] == known["_n"], "left_semi").join(known, p["b"] == known["_n"], "left_semi")
    if not ordered:
        p = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return p.distinct()


def reciprocal(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Values of (a, b) beside those of (b, a): keys, a, b, value, value_back (NULL where missing)."""
    back = df.select(*keys, F.col("a").alias("b"), F.col("b").alias("a"), F.col(value).alias(f"{value}_back"))
    return meet(df, back, [*keys, "a", "b"], "left")


def net_difference(forward: DataFrame, reverse: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(a to b minus b to a), less the same of the time-reversed score."""
    f = reciprocal(forward, keys).select(*keys, "a", "b", (F.col("value") - F.col("value_back")).alias("_f"))
    r = reciprocal(reverse, keys).select(*keys, "a", "b", (F.col("value") - F.col("value_back")).alias("_r"))
    return meet(f, r, [*keys, "a", "b"]).select(*keys, "a", "b", (F.col("_f") - F.col("_r")).alias("value"))


def reciprocal_closure(pairs: DataFrame, order: str = "ord") -> DataFrame:
    """Listed pairs and their reverses once each, by first request."""
    both = pairs.select("a", "b", F.lit(0).alias("_k"), order).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("_k"), order))
    first = both.groupBy("a", "b").agg(F.min(F.struct("_k", order)).alias("_m"))
    return first.select("a", "b", F.col(f"_m.{order}").alias(order), (F.col("_m._k") == 0).alias("requested"))
