"""Exact top-k inner-product search by a three-phase uniform threshold (operator 5).

The components are split into m lists; a row's partial score in a list is its inner
product over that list's components, and its score is the sum of the m partials.

Phase 1: every block of rows gathers, per query and list, the k best partials; the
exact scores of the rows so named give k rows per query and block.
Cutoff: the k-th best of them over all blocks is a score that the true k-th best
cannot be below. It goes back to the blocks with the queries.
Phase 2: a row that reaches the cutoff has a partial of at least cutoff / m in some
list, so only those entries are collected. A row whose collected partials, with less than
that share for each list it is missing from, cannot reach the cutoff goes.
Phase 3: the missing partials of the rows left are looked up, one pair at a time, and
added up exactly; those below the cutoff go, and the rest are ranked.

Queries and rows travel in packed blocks of bounded size, dealt over a grid of row groups
and query groups whose number follows the volume: a task meets at most about
``GROUP_ROWS`` blocks of rows and ``GROUP_QUERIES`` blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import keep

QUERY_BLOCK, ROW_BLOCK = 1024, 2048
GROUP_ROWS, GROUP_QUERIES = 64, 16
#: Tasks that even a small search is dealt over.
LEAST = 48
_I = np.int64


def _quantised(vectors: DataFrame, scale: float, vec: str) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null or hold null or non-finite parts go."""
    parts = F.transform(F.col(f"`{vec}`"), lambda x: x.cast("double"))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    whole = whole.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return whole.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length: dim, ids, data (int64)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = np.array(batch.column(0)), batch.column(1)
            offsets, flat = np.array(column.offsets), np.array(column.values)
            dims = np.diff(offsets)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                for s in range(0, len(own), size):
                    part = own[s : s + size]
                    data = flat[offsets[part][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([ids[part].tobytes()], pa.binary()), pa.array([data.astype(_I).tobytes()], pa.binary())], names=["dim", "ids", "data"])

    return rows.mapInArrow(blocks, "dim long, ids binary, data binary")


def _matrix(data: bytes, dim: int) -> np.ndarray:
    """Products of parts below 2^20 are exact in doubles; larger ones stay integers."""
    x = np.frombuffer(data, _I).reshape(-1, dim)
    return x.astype(np.float64) if not x.size or np.abs(x).max() < 2**20 else x


def _lists(dim: int, lists: int) -> list[slice]:
    edge = np.linspace(0, dim, min(lists, dim) + 1).astype(int)
    return [slice(s, e) for s, e in zip(edge[:-1], edge[1:])]


def collect_and_resolve(q: np.ndarray, x: np.ndarray, parts: list[slice], cutoff: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3 for a block of queries and one of rows: (query, row, score) of the rows at or over the cutoff.

    cutoff: of each query, the least int64 for none. allowed: pairs that count. The last number is that of the pairs
    of which missing partials were looked up.
    """
    everything = cutoff == np.iinfo(_I).min
    share = np.where(everything, 0, -(-cutoff // len(parts)))
    lists = np.zeros((len(q), len(x)), np.int8)
    known = np.zeros((len(q), len(x)), q.dtype)
    seen = []
    for part in parts:
        partial = q[:, part] @ x[:, part].T
        listed = allowed & ((partial >= share[:, None]) | everything[:, None])
        known += np.where(listed, partial, 0)
        lists += listed
        seen.append(listed)
    # A list that a row is missing from gives less than the share.
    reach = (lists > 0) & ((known + (len(parts) - lists) * (share[:, None] - 1) >= cutoff[:, None]) | everything[:, None])
    at, col = np.nonzero(reach)
    score = known[at, col].astype(_I)
    some = lists[at, col] < len(parts)
    for part, listed in zip(parts, seen):
        lacking = np.flatnonzero(~listed[at, col])
        for s in range(0, len(lacking), 1 << 16):
            own = lacking[s : s + (1 << 16)]
            score[own] += np.einsum("nd,nd->n", q[at[own], part], x[col[own], part]).astype(_I)
    good = (score >= cutoff[at]) | everything[at]
    return at[good], col[good], score[good], int(some.sum())


def top_k(vectors: DataFrame, query_ids: DataFrame, k: int = 5, lists: int = 4, scale: float = 256.0, vec: str = "embedding") -> DataFrame:
    """The k best rows of each query by integer inner product of quantised vectors, ties to smaller vec_id.

    vectors: vec_id, a vector column (``vec``); query_ids: vec_id; other columns, of any name, are not looked at.
    Returns query_id, rank (from 1), vec_id, score.
    A row is compared with queries of its own length; rows with the query's vec_id are no candidates.
    Null vec_id, null vector, empty vector, and null, NaN or infinite parts: no part, neither as query nor row.
    Repeated rows each count as rows; as a query the smallest vector of the id counts. Integer sums must fit 63 bits.
    """
    rows = _quantised(vectors, scale, vec)
    asked = rows.join(query_ids.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.repartition(n_blocks, "vec_id").sortWithinPartitions("vec_id")
    queries = keep(_packed(asked, QUERY_BLOCK).withColumn("block", F.xxhash64("ids")), "queries")
    row_blocks = keep(_packed(rows, ROW_BLOCK), "rows")
    query_groups = -(-queries.count() // GROUP_QUERIES) or 1
    row_groups = max(-(-LEAST // query_groups), -(-row_blocks.count() // GROUP_ROWS))

    def met(queries: DataFrame) -> DataFrame:
        """Every block of queries beside every block of rows of its length."""
        left = row_blocks.withColumn("row_group", F.pmod(F.xxhash64("ids"), F.lit(row_groups)).cast("int")).withColumn("query_group", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
        right = queries.withColumn("query_group", F.pmod("block", F.lit(query_groups)).cast("int")).withColumn("row_group", F.explode(F.sequence(F.lit(0), F.lit(row_groups - 1))))
        return left.join(right, ["dim", "row_group", "query_group"])

    q_side = queries.select("dim", "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids, q_ids = np.frombuffer(row["ids"], _I), np.frombuffer(row["q_ids"], _I)
                x, q = _matrix(row["data"], dim), _matrix(row["q_data"], dim)
                if x.dtype != q.dtype:
                    x, q = x.astype(_I), q.astype(_I)
                same = q_ids[:, None] == ids[None, :]
                named = []
                for part in _lists(dim, lists):
                    partial = q[:, part] @ x[:, part].T
                    partial[same] = partial.min() - 1
                    n = min(k, len(ids))
                    named.append(np.argpartition(partial, len(ids) - n, axis=1)[:, len(ids) - n :])
                named = np.sort(np.concatenate(named, axis=1), axis=1)
                fresh = np.c_[np.ones(len(q_ids), bool), named[:, 1:] != named[:, :-1]]
                fresh &= ~np.take_along_axis(same, named, axis=1)
                score = np.einsum("qnd,qd->qn", x[named], q).astype(_I)
                score[~fresh] = np.iinfo(_I).min
                best = -np.sort(-score, axis=1)[:, :k]
                at, col = np.nonzero(best > np.iinfo(_I).min)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(best[at, col])], names=["query_id", "score"])

    lower = met(q_side).mapInArrow(local_lists, "query_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoffs = lower.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n"))
    # Fewer than k rows in all: every row is wanted.
    cutoffs = keep(cutoffs.select("query_id", F.when(F.col("n") >= k, F.col("cutoff")).alias("cutoff")), "cutoffs")

    def with_cutoffs(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("query_id").to_pylist(), right.column("cutoff").to_pylist()))
        out = []
        for ids in left.column("q_ids").to_pylist():
            own = [known.get(i) for i in np.frombuffer(ids, _I).tolist()]
            out.append(np.array([np.iinfo(_I).min if c is None else c for c in own], _I).tobytes())
        return pa.table({"dim": left.column("dim"), "block": left.column("block"), "q_ids": left.column("q_ids"), "q_data": left.column("q_data"), "q_cut": pa.array(out, pa.binary())})

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(ids, _I)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), block))], names=["query_id", "block"])

    told = queries.select("block", "ids").mapInArrow(ids_of, "query_id long, block long").join(cutoffs, "query_id")
    cut = keep(q_side.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(with_cutoffs, "dim long, block long, q_ids binary, q_data binary, q_cut binary"), "cut")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids, q_ids, cutoff = (np.frombuffer(row[c], _I) for c in ("ids", "q_ids", "q_cut"))
                x, q = _matrix(row["data"], dim), _matrix(row["q_data"], dim)
                if x.dtype != q.dtype:
                    x, q = x.astype(_I), q.astype(_I)
                at, col, score, _ = collect_and_resolve(q, x, _lists(dim, lists), cutoff, q_ids[:, None] != ids[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[col]), pa.array(score)], names=["query_id", "vec_id", "score"])

    final = met(cut).mapInArrow(resolve, "query_id long, vec_id long, score long")
    ranked = final.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0").select("vec_id"))
