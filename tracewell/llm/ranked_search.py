"""Ranked lexical search by NRA, impact-sorted lists without random access (operator 12).

One pass over the documents gathers *segments*: for a bounded volume of text, the postings (term, document,
occurrences) of the terms that a block of queries asks for, with the documents' lengths. Corpus figures (documents,
terms, document frequencies) are sums over segments. Then each segment is searched on its own: its lists are sorted
by impact and read in impact order, level by level. Every document has an interval of scores: what was read of it, and
that plus the next impacts of the lists it was not met in. Reading goes on until the interval of each document that
could still be among the best is a single number, so membership, ties and scores are settled together.

A task keeps the best of its segments, whose worst is a floor for the next ones, and gives k rows a query at most.
Queries are taken in blocks of about ``QUERY_BYTES`` of text, each block with its own pass, so neither the driver nor a
task holds more of them than that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import code, decode, keep, tree_sum
from tracewell.llm.textops import slices, terms

#: Bytes of query texts that one pass searches, and bytes of document text of one segment.
QUERY_BYTES, SEGMENT_BYTES = 4_000_000, 32_000_000
#: Groups in which the tasks' best rows of a query meet first.
MERGES = 32
_I = np.int64
_NO_ID = np.iinfo(_I).min


def _segments(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """Packed segments: ids and lengths of documents with a term, and postings sorted by term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = n_docs = 0

        def segment() -> pa.RecordBatch:
            ids, n, term, doc, tf = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(term, kind="stable")
            columns = {"ids": ids, "n": n, "term": term[order], "doc": doc[order], "tf": tf[order]}
            return pa.RecordBatch.from_arrays([pa.array([code(x)], pa.binary()) for x in columns.values()], names=list(columns))

        for batch in batches:
            ids = np.array(batch.column(0).fill_null(_NO_ID))
            texts = batch.column(1)
            length = np.array(texts.binary_length().fill_null(0)) if hasattr(texts, "binary_length") else np.array([len(t or b"") for t in texts.to_pylist()])
            for s, e in slices(length):
                words = [terms(t) for t in texts.slice(s, e - s).to_pylist()]
                n = np.array([len(w) for w in words], _I)
                found = np.fromiter((i for w in words for i in map(known.get, w, repeat(-1))), np.int32, int(n.sum()))
                owner = np.repeat(np.arange(e - s), n)[found >= 0]
                key, tf = np.unique(owner * len(known) + found[found >= 0], return_counts=True)
                some = np.flatnonzero(n)
                at = np.cumsum(n > 0) - 1  # documents without a term have no place
                held.append((ids[s:e][some], n[some], (key % len(known)).astype(np.int32), (at[key // len(known)] + n_docs).astype(np.int32), tf.astype(np.int32)))
                n_docs += len(some)
                size += int(length[s:e].sum())
                if size >= SEGMENT_BYTES:
                    yield segment()
                    held, size, n_docs = [], 0, 0
        if n_docs:
            yield segment()

    return docs.mapInArrow(rows, "ids binary, n binary, term binary, doc binary, tf binary")


def _figures(segments: DataFrame, vocabulary: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the document frequency of each known term."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary + 2, _I)
        for batch in batches:
            for row in batch.to_pylist():
                n = decode(row["n"], _I)
                total[:2] += len(n), n.sum()
                total[2:] += np.bincount(decode(row["term"], np.int32), minlength=vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array([code(total)], pa.binary())], names=["s"])

    parts = segments.select("n", "term").mapInArrow(sums, "s binary")
    total = tree_sum(parts, lambda raw, kind: decode(raw, kind), code, np.zeros(vocabulary + 2, _I))
    return int(total[0]), int(total[1]), total[2:]


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(_I)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence of a term of weight 1 in a query adds to a document of n terms that holds it tf times."""
    m = 75 + 25 * n.astype(_I) * n_docs // n_terms
    return 1_000_000_000 * tf.astype(_I) // (1000 * tf.astype(_I) + 12 * m)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that can be among the k best with a score of at least ``floor`` (1 or more), their exact scores, and the number of entries read.

    lists: of each term its documents (0 to n_docs - 1, each once) and impacts (above 0), greatest impact first. All documents that tie with the
    k-th best are returned.
    """
    lower = np.zeros(n_docs, _I)
    unseen = np.ones((len(lists), n_docs), bool)
    at = [0] * len(lists)
    top = np.array([x[0] if len(x) else 0 for _, x in lists], _I)  # of each list, the impact at which reading goes on
    alive = np.arange(n_docs)
    while len(alive):
        level = int(top.max(initial=0)) // 2
        for i, (docs, gain) in enumerate(lists):
            if top[i] > level:
                end = at[i] + int(np.searchsorted(-gain[at[i] :], -level, "left"))
                lower[docs[at[i] : end]] += gain[at[i] : end]
                unseen[i, docs[at[i] : end]] = False
                top[i] = gain[end] if end < len(gain) else 0
                at[i] = end
        low = lower[alive]
        high = low + top @ unseen[:, alive]
        worst = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else 0)
        alive, low, high = (x[high >= worst] for x in (alive, low, high))
        if (low == high).all():
            return alive, low, sum(at)
    return alive, lower[alive], sum(at)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(segments: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): each task's k best documents of each query."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, _I), np.empty(0, _I))] * len(queries)
        for batch in batches:
            for row in batch.to_pylist():
                ids, n = decode(row["ids"], _I), decode(row["n"], _I)
                term, doc, tf = (decode(row[c], np.int32) for c in ("term", "doc", "tf"))
                gain = weight[term] * impacts(tf, n[doc], n_docs, n_terms)
                wanted = (gain > 0) & (ids[doc] != _NO_ID)
                term, doc, gain = term[wanted], doc[wanted], gain[wanted]
                order = np.lexsort((-gain, term))
                term, doc, gain = term[order], doc[order], gain[order]
                edge = np.searchsorted(term, np.arange(len(weight) + 1))
                for i, (own, times) in enumerate(queries):
                    lists = [(doc[s:e], gain[s:e] * t) for s, e, t in zip(edge[own].tolist(), edge[own + 1].tolist(), times.tolist()) if e > s]
                    if not lists:
                        continue
                    before = best[i]
                    found, score, _ = nra(lists, len(ids), k, int(before[1][-1]) if len(before[1]) == k else 1)
                    best[i] = _best(np.r_[before[0], ids[found]], np.r_[before[1], score], k)
        query = np.repeat(np.arange(len(queries)), [len(b[0]) for b in best])
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=["query", "doc_id", "score"])

    return segments.mapInArrow(rows, "query long, doc_id long, score long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    by_score = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k documents of highest score for each item: item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id.

    docs: doc_id, text; items: item_id, text; other columns, of any name, are not looked at. Terms are runs of digits, letters and
    non-ASCII characters, A-Z in lower case; null and empty texts have none. A document without any term counts nowhere; one
    with a null doc_id counts in the corpus figures and is never returned. Rows that repeat a doc_id are documents of their own. Equal rows of items
    count once; rows of one item_id and different texts are ranked each on its own. Only scores above 0 are returned, so items without terms and
    empty tables give no row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes))
    out = []
    for block in range(blocks):
        asked = [(r.item_id, Counter(terms(r.text))) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        known: dict[bytes, int] = {}
        for _, words in asked:
            for w in words:
                known.setdefault(w, len(known))
        if not known:
            continue
        segments = keep(_segments(docs, known), "segments")
        n_docs, n_terms, df = _figures(segments, len(known))
        if not n_docs:
            continue
        queries = [(np.array([known[w] for w in words], _I), np.array(list(words.values()), _I)) for _, words in asked]
        found = _search(segments, queries, term_weights(n_docs, df), n_docs, n_terms, k)
        found = _ranked(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES))), ["query", "part"], k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], f"query long, item_id {items.schema['item_id'].dataType.simpleString()}")
        out.append(keep(_ranked(found.drop("rank"), ["query"], k).join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
    if not out:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
