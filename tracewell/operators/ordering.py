"""Global order, numbers and running values without a task that sees all rows.

Rows are dealt by ranges of the order, so partitions follow each other. What a partition needs of those before it
(how many rows, the least value) is one number, for the group that goes on from the partition before; only these numbers,
at most two a partition, meet on the driver. A group of any size, or the whole table, spreads over as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.storage import keep

_PART_BITS = 33  # monotonically_increasing_id: partition number above, row number below
_KINDS = {"min": (F.min, F.least, min), "max": (F.max, F.greatest, max), "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b), lambda a, b: a + b)}


class Ordered:
    """A table in a global order, written once; numbers and running values are added to it.

    ``order`` takes names and sort columns such as ``F.desc("score")``; with ``by`` each group is numbered and accumulated on its own. Rows with equal
    keys keep df's order where df has one (file and row), and are told apart in any case. The input is read twice, once to find the ranges.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), partitions: int | None = None):
        self.by, self.columns = list(by), list(df.columns)
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = [*(F.col(f"`{b}`") for b in by), *order, F.col("_tie")]
        placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        placed = keep(placed.drop("_tie").withColumn("_place", F.monotonically_increasing_id()), "ordered")
        self.rows = placed.withColumn("_part", F.shiftright("_place", _PART_BITS))

    def _carried(self, value: Column, join, after: bool) -> DataFrame:
        """(_part, _by..., _carried): what the group that goes on in a partition has had before it (after it); at most one row a partition."""
        key = F.struct(*(F.col(f"`{b}`") for b in self.by)) if self.by else F.lit(0)
        parts = self.rows.groupBy("_part", key.alias("_key")).agg(value.alias("_v"))
        if self.by:
            edge = Window.partitionBy("_part")
            parts = parts.withColumns({"_first": F.min("_key").over(edge), "_last": F.max("_key").over(edge)}).where("_key = _first or _key = _last")
        found = sorted(parts.select("_part", (F.col("_key") != F.col("_first") if self.by else F.lit(False)).alias("_late"), "_key", "_v").collect(), key=lambda r: (r[0], r[1]), reverse=after)
        out, last, so_far = [], (), None
        for part, _, own, v in found:
            if last == (own,):
                out.append((part, *(own if self.by else ()), so_far))
                so_far = v if so_far is None else so_far if v is None else join(so_far, v)
            else:
                last, so_far = (own,), v
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        schema = ", ".join(["_part long", *(f"_by{i} {kinds[b]}" for i, b in enumerate(self.by)), f"_carried {parts.schema['_v'].dataType.simpleString()}"])
        return self.rows.sparkSession.createDataFrame(out, schema)

    def _with(self, carried: DataFrame, within: Column, name: str, join) -> Ordered:
        on = F.col("p._part") == F.col("c._part")
        for i, b in enumerate(self.by):
            on = on & F.col(f"p.`{b}`").eqNullSafe(F.col(f"c._by{i}"))
        rows = self.rows.drop(name).withColumn("_within", within) if name in self.rows.columns else self.rows.withColumn("_within", within)
        met = rows.alias("p").join(F.broadcast(carried).alias("c"), on, "left")
        self.rows = met.select(*(F.col(f"p.`{c}`") for c in rows.columns if c != "_within"), join(F.col("p._within"), F.col("c._carried")).alias(name))
        self.columns = [*(c for c in self.columns if c != name), name]
        return self

    def numbered(self, name: str = "position") -> Ordered:
        """The row number (1, 2, 3 ...) within the order, as a long."""
        carried = self._carried(F.count("*"), lambda a, b: a + b, False)
        if self.by:
            within = F.row_number().over(Window.partitionBy("_part", *self.by).orderBy("_place")).cast("long")
        else:
            within = F.col("_place").bitwiseAND((1 << _PART_BITS) - 1) + 1
        return self._with(carried, within, name, lambda a, b: a + F.coalesce(b, F.lit(0)))

    def running(self, value: str, name: str, kind: str = "min", after: bool = False) -> Ordered:
        """The least, greatest or sum (``kind``) of ``value`` over the rows up to and with each row (``after``: from each row on); NULL values count for nothing."""
        of, with_carried, join = _KINDS[kind]
        carried = self._carried(of(F.col(f"`{value}`")), join, after)
        # Backwards by an order from the end: a frame up to the partition's end would be added up anew for each row.
        w = Window.partitionBy("_part", *self.by).orderBy(F.desc("_place") if after else F.asc("_place"))
        return self._with(carried, of(F.col(f"`{value}`")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), name, with_carried)

    def frame(self) -> DataFrame:
        return self.rows.select(*(F.col(f"`{c}`") for c in self.columns))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "position", by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """df with its row number (1, 2, 3 ...) in the given order, within each group of ``by``; a column called ``name`` is replaced."""
    return Ordered(df, order, by, partitions).numbered(name).frame()
