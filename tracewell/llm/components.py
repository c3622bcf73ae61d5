"""Connected components of an edge table, distributed.

Each round first contracts the edges inside every partition with union-find, then
points each node at its smallest neighbour (large star, small star). Every round's
edges are written to the shared folder; nothing is gathered on the driver but a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import keep


class Forest(dict):
    """Union-find whose roots are the smallest members."""

    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    found = [(x, r) for x in list(forest) if (r := forest.root(x)) != x]
    if found:
        u, v = (np.array(c, dtype=np.int64) for c in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _to_smallest(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Large star (both_ways) or small star: a node's neighbours are linked to its smallest one."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    told = seen.join(least, "u")
    if both_ways:
        return told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    out = told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns, in any order); component is the smallest node.

    Null ends and self-links are ignored. Isolated nodes are not in the result.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v and u is not null and v is not null")
    edges = keep(edges.mapInArrow(_contract, "u long, v long").distinct(), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        # Settled: every node has one target, and no target points on.
        state = edges.groupBy("u").agg(F.count("*").alias("n")).agg(F.sum((F.col("n") > 1).cast("int")).alias("many")).first()
        if not state.many and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
        star = _to_smallest(_to_smallest(edges, True), False)
        edges = keep(star.repartition("v").mapInArrow(_contract, "u long, v long").distinct(), f"{name}-{turn}")
