"""MinHash near-dedup by a multi-index Hamming join (operator 7).

A signature is K symbols of b bits. It is split into m chunks; two signatures that
differ in at most r symbols have, by pigeonhole, a chunk with at most
e = floor(r / m) differing symbols. Every choice of e symbols of a chunk is left out
in turn and the rest hashed to a key, so each pair within distance r shares a key.

1. Documents with equal shingle sets become one class (its smallest doc_id).
2. Classes that share a key meet in a packed exchange. Keys with one class go.
3. Inside a key's bucket the pairs within distance r are united; only a spanning
   forest leaves the task. Buckets over ``block`` classes are cut into pairs of blocks.
4. The forest's components are clusters of possible duplicates. A cluster's texts meet
   in cells (pairs of blocks again, for large ones), where every pair within
   distance r is confirmed on full shingle sets, unless both ends are already linked.
5. Components of the confirmed links are the groups.

No pair list is ever built: a group of n copies costs O(n) rows plus vectorised
comparisons in its cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import Forest, connected_components
from tracewell.llm.shared import batches_of, bucket_count, keep, pack, packed_schema, runs, unpack
from tracewell.llm.textops import minhash, minhash_family, mix, shingle_sets, text_slices, overlap

_U, _I = np.uint64, np.int64
SYMBOLS, CHUNK, DISTANCE = 64, 4, 31
BLOCK = 1024


def _parts(chunk: int, errors: int) -> list[tuple[int, ...]]:
    return [tuple(i for i in range(chunk) if i not in out) for out in combinations(range(chunk), errors)]


def chunk_keys(signatures: np.ndarray, chunk: int = CHUNK, distance: int = DISTANCE) -> np.ndarray:
    """Keys of each signature (rows x keys): one per chunk and allowed choice of differing symbols."""
    symbols = signatures.shape[1]
    parts = _parts(chunk, distance // (symbols // chunk))
    keys = []
    for c in range(0, symbols, chunk):
        for p, part in enumerate(parts):
            key = np.full(len(signatures), c * 64 + p, _U)
            for j in part:
                key = mix(key * _U(0x9E3779B97F4A7C15) + signatures[:, c + j].astype(_U) + _U(1))
            keys.append(key)
    return np.stack(keys, axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing symbols of each row of a against each row of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for j in range(a.shape[1]):
        out += a[:, j, None] != b[None, :, j]
    return out


def _forest_within(ids: np.ndarray, sig: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs (left x right) within the distance."""
    forest, links = Forest(), []
    for s in range(0, len(left), 256):
        near = _distances(sig[left[s : s + 256]], sig[right]) <= distance
        for i, row in enumerate(near):
            a = int(ids[left[s + i]])
            for j in np.flatnonzero(row).tolist():
                b = int(ids[right[j]])
                if a != b and forest.join(a, b):
                    links.append((a, b))
    return links


def near_duplicate_groups(docs: DataFrame, k: int = 5, similarity: float = 0.75, block: int = BLOCK) -> DataFrame:
    """Groups of documents whose k-word shingle sets have at least the given Jaccard similarity.

    docs: doc_id, text. Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links),
    kept (doc_id = component_id), one row per input row. A-Z are lower-cased. A text of fewer than k
    words has one shingle, its whole sequence; without words (or null) it has none and no links.
    Rows with a null doc_id get a null component and take no part; rows that repeat a doc_id share a component.
    Missed: only pairs whose signatures differ in over DISTANCE of SYMBOLS places (at the threshold, about 1 in 10^5).
    """
    num, den = round(similarity * 100), 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fam_a, fam_b = minhash_family(SYMBOLS)

    def signature(sets: np.ndarray) -> np.ndarray:
        return minhash(sets, fam_a, fam_b).astype(np.uint16)

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if den * min(len(x), len(y)) < num * max(len(x), len(y)):
            return False
        both = overlap(x, y)
        return den * both >= num * (len(x) + len(y) - both)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e in text_slices(texts):
                n, f1, f2, sig = [], [], [], []
                for x in shingle_sets(texts[s:e], k):
                    n.append(len(x))
                    y = mix(x + _U(11))
                    f1.append(int(y.sum(dtype=_U).astype(_I)))
                    f2.append(int(np.bitwise_xor.reduce(mix(y + _U(5)), initial=0).astype(_I)) if len(x) else 0)
                    sig.append(signature(x).tobytes() if len(x) else None)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e], pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "f1", "f2", "sig"])

    signed = keep(docs.mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, sig binary"), "signed")
    classes = keep(signed.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    n_keys = chunk_keys(np.zeros((1, SYMBOLS), np.uint16)).shape[1]
    buckets = bucket_count(classes.count() * n_keys)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4000):
                part = batch.slice(s, 4000)
                rep = np.array(part.column(0).to_pylist(), _I)
                keys = chunk_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)).ravel()
                rep = np.repeat(rep, n_keys)
                yield from batches_of([pack((keys % _U(buckets)).astype(_I), {"key": keys, "rep": rep})])

    def meeting(table: pa.Table) -> pa.Table:
        """Classes of keys that two or more share, as (cell, rep); large keys are cut into pairs of blocks."""
        key, rep = unpack(table, "key", _U), unpack(table, "rep", _I)
        order = np.lexsort((rep, key))
        key, rep = key[order], rep[order]
        start, run = runs(key)
        size = np.diff(np.r_[start, len(key)])
        cells, members = [], []
        seen = set()
        for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist()):
            same = rep[s : s + n]
            if (what := same.tobytes()) in seen:  # another key with the same classes
                continue
            seen.add(what)
            if n <= 2 * block:
                cells.append(np.full(n, key[s], _U))
                members.append(same)
                continue
            part = np.arange(n) // block
            for i in range(part[-1] + 1):
                for j in range(i + 1, part[-1] + 1):
                    own = same[(part == i) | (part == j)]
                    cells.append(np.full(len(own), mix(np.array([int(key[s]) ^ (i << 32 | j)], _U))[0]))
                    members.append(own)
        cell = np.concatenate(cells).astype(_I) if cells else np.empty(0, _I)
        member = np.concatenate(members) if members else np.empty(0, _I)
        return pa.table({"cell": cell, "rep": member})

    met = classes.select("rep", "sig").mapInArrow(keyed, packed_schema("key", "rep")).groupBy("bucket").applyInArrow(meeting, "cell long, rep long")
    met = keep(met, "met")
    cell_buckets = bucket_count(met.count() * 8)

    def close(table: pa.Table) -> pa.Table:
        cell, rep = np.array(table.column("cell")), np.array(table.column("rep"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        order = np.argsort(cell, kind="stable")
        start, _ = runs(cell[order])
        forest, out = Forest(), []
        for s, e in zip(start.tolist(), np.r_[start[1:], len(cell)].tolist()):
            at = order[s:e]
            if e - s == 2:
                if (sig[at[0]] != sig[at[1]]).sum() <= DISTANCE and forest.join(int(rep[at[0]]), int(rep[at[1]])):
                    out.append((int(rep[at[0]]), int(rep[at[1]])))
                continue
            if len({forest.root(x) for x in rep[at].tolist()}) == 1:
                continue
            out += [(a, b) for a, b in _forest_within(rep, sig, at, at, DISTANCE) if forest.join(a, b)]
        a, b = (np.array(c, _I) for c in zip(*out)) if out else (np.empty(0, _I), np.empty(0, _I))
        return pa.table({"a": a, "b": b})

    near = met.withColumn("bucket", F.pmod(F.col("cell"), F.lit(cell_buckets))).join(classes.select("rep", "sig"), "rep").groupBy("bucket").applyInArrow(close, "a long, b long")
    clusters = keep(connected_components(near, "clusters"), "clusters")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    # A cluster of more than `block` classes is cut into blocks; each pair of blocks is a cell.
    placed = (
        clusters.join(sizes, "component")
        .withColumn("blocks", F.ceil(F.col("size") / F.lit(block)))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("own")))))
        .withColumn("cell", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")))
        .select(F.col("node").alias("doc_id"), "cell")
    )
    # A cell's texts come to one task; cells are dealt over as many groups as keep a group at about 1,500 texts.
    groups = max(12, int(np.ceil(clusters.count() / 1500)))

    def confirm(table: pa.Table) -> pa.Table:
        cell, ids, texts = np.array(table.column("cell")), np.array(table.column("doc_id")), table.column("text").to_pylist()
        sets: list = []
        for s, e in text_slices(texts, 16_000_000):
            sets += shingle_sets(texts[s:e], k)
        order = np.lexsort((ids, cell))
        start, _ = runs(cell[order])
        out = []
        for s, e in zip(start.tolist(), np.r_[start[1:], len(cell)].tolist()):
            at = order[s:e]
            forest = Forest()
            for other in at[1:].tolist():  # most of a group is near its first text
                if linked(sets[at[0]], sets[other]):
                    forest.join(int(ids[at[0]]), int(ids[other]))
                    out.append((int(ids[at[0]]), int(ids[other])))
            if e - s == 2:
                continue
            sig = np.stack([signature(sets[i]) for i in at])
            roots = np.array([forest.root(int(i)) for i in ids[at]])
            for i in range(1, e - s):
                todo = np.flatnonzero((roots[i + 1 :] != roots[i])) + i + 1
                if not len(todo):
                    continue
                todo = todo[(sig[todo] != sig[i]).sum(axis=1) <= DISTANCE]
                for j in todo.tolist():
                    if roots[i] != roots[j] and linked(sets[at[i]], sets[at[j]]):
                        out.append((int(ids[at[i]]), int(ids[at[j]])))
                        low, high = sorted((roots[i], roots[j]))
                        roots[roots == high] = low
        a, b = (np.array(c, _I) for c in zip(*out)) if out else (np.empty(0, _I), np.empty(0, _I))
        return pa.table({"a": a, "b": b})

    # One row of a repeated doc_id whose class it represents is enough; which, its own set tells below.
    # A merge join whatever the sizes, so that the plan does not change with them.
    texts = placed.hint("merge").join(docs.where("doc_id is not null"), "doc_id").withColumn("bucket", F.pmod(F.col("cell"), F.lit(groups)))
    links = texts.groupBy("bucket").applyInArrow(confirm, "a long, b long")
    found = connected_components(links, "groups")
    rep_of = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    out = signed.join(rep_of, ["f1", "f2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
