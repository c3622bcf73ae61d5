"""Target-distribution importance resampling with bit-sliced weights (operator 11).

A document's features (runs of 1 to 3 words) fall into 10,000 buckets. Its bucket counts become bit planes: plane j
has bit b set where bit j of the count of bucket b is set. The gains of the buckets become bit planes in two's complement, the top
one with a negative weight. A document's weight is then the sum of 2^j * (+-2^k) * popcount(count plane j AND gain plane k).
The corpus's own counts are added up on planes too: three planes of one power give their sum at that power and their
carry at the next.

Texts are read once: the planes of each document are written to the shared folder, and counts and weights come from them. Only sums
of 10,000 numbers reach the driver. Documents are drawn by weight plus Gumbel noise that the doc_id fixes, in an order made by ranges.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import code, decode, keep, tree_sum
from tracewell.llm.textops import slices, terms
from tracewell.operators.ordering import numbered

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
_WORDS = -(-BUCKETS // 64)
#: Documents whose planes are ANDed at once.
ROWS = 1024
_I = np.int64


def feature_buckets(words: list[bytes]) -> np.ndarray:
    """Bucket of each run of 1 to 3 words joined by a space, repeats included."""
    one = list(map(crc32, words))
    spaced = [b" " + w for w in words[1:]]
    two = list(map(crc32, spaced, one))
    return np.array(one + two + list(map(crc32, spaced[1:], two)), np.uint32) % np.uint32(BUCKETS)


def count_planes(buckets: np.ndarray) -> np.ndarray:
    """Bit planes of the bucket counts, lowest first: (planes, 157) words of 64 bits; none without features."""
    count = np.bincount(buckets, minlength=64 * _WORDS)
    depth = int(count.max(initial=0)).bit_length()
    bits = (count[None, :] >> np.arange(depth)[:, None]).astype(np.uint8) & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of signed gains in two's complement, and the weight of each plane (the last one's is negative)."""
    depth = int(np.abs(gains).max(initial=0)).bit_length() + 1
    bits = (np.pad(gains, (0, 64 * _WORDS - len(gains)))[None, :] >> np.arange(depth)[:, None]) & 1
    worth = np.array([1 << k for k in range(depth)], _I)
    worth[-1] = -worth[-1]
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64), worth


def plane_weights(planes: np.ndarray, depth: np.ndarray, gains: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weight of each document; planes: those of all documents one below the other, of which document i owns depth[i]."""
    level = np.arange(len(planes)) - np.repeat(np.cumsum(depth) - depth, depth)
    total = np.zeros(len(planes), _I)
    for plane, worth in zip(*gains):
        total += worth * np.bitwise_count(planes & plane).sum(axis=1, dtype=_I)
    ends = np.cumsum(np.r_[0, total << level])
    edge = np.cumsum(np.r_[0, depth])
    return ends[edge[1:]] - ends[edge[:-1]]


def plane_sums(planes: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Sum of the counts that the planes stand for, for each bucket."""
    level = np.arange(len(planes)) - np.repeat(np.cumsum(depth) - depth, depth)
    waiting: dict[int, list[np.ndarray]] = defaultdict(list)
    for j in np.unique(level).tolist():
        waiting[j].append(planes[level == j])
    total, j = np.zeros(BUCKETS, _I), 0
    while waiting:
        rows = np.concatenate(waiting.pop(j, [planes[:0]]))
        while len(rows) > 2:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            waiting[j + 1].append((a & b) | (c & (a ^ b)))
            rows = np.concatenate([a ^ b ^ c, rows[3 * third :]])
        total += np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")[:, :BUCKETS].sum(axis=0, dtype=_I) << j
        j += 1
    return total


def planes_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, planes) of every row of docs; planes: the bit planes of its bucket counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(t or b"") + 4 * _WORDS * 8 for t in batch.column(1).to_pylist()])
            for s, e in slices(size):
                n_words, planes = [], []
                for text in batch.column(1).slice(s, e - s).to_pylist():
                    words = terms(text)
                    n_words.append(len(words))
                    planes.append(count_planes(feature_buckets(words)).tobytes())
                n = np.array(n_words, _I)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), pa.array(n), pa.array(np.maximum(n, 0) + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)), pa.array(planes, pa.binary())],
                    names=["doc_id", "n_words", "n_features", "planes"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(rows, "doc_id long, n_words long, n_features long, planes binary")


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64).reshape(-1, _WORDS), np.array([len(r) // (8 * _WORDS) for r in raw], _I)


def bucket_sums(planes: DataFrame) -> np.ndarray:
    """Occurrences of features in each bucket over all rows of ``planes_table``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, _I)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                total += plane_sums(*_read(batch.column(0).slice(s, ROWS)))
        yield pa.RecordBatch.from_arrays([pa.array([code(total)], pa.binary())], names=["s"])

    return tree_sum(planes.select("planes").mapInArrow(sums, "s binary"), lambda raw, kind: decode(raw, kind), code, np.zeros(BUCKETS, _I))


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 * log ratio of the smoothed shares of each bucket in the target and in the raw counts, rounded down."""
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(_I)


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row's importance and, if drawn, its rank: doc_id, n_features, weight, score, rank.

    docs: doc_id, text; target: text; other columns, of any name, are not looked at. Of the N rows with at least
    ``least_words`` words, floor(percent * N / 100) are drawn, by score, ties to the smaller doc_id; the others' rank is null. Null and
    empty texts have no features and weight 0. Rows that repeat a doc_id are rows of their own. A row without doc_id counts in
    the corpus and has a weight, but no score, and is never drawn nor counted in N. Empty tables: an empty result; an empty target: the flat one.
    """
    planes = keep(planes_table(docs), "planes")
    aim = planes_table(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    gains = gain_planes(bucket_gains(bucket_sums(planes), bucket_sums(aim)))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(plane_weights(*_read(part.column(3)), gains))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = planes.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    fit = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    rows = keep(rows.withColumn("score", F.col("weight") + noise).withColumn("fit", fit), "scores")
    drawn = percent * rows.where("fit").count() // 100
    placed = numbered(rows, [F.desc("fit"), F.desc("score"), "doc_id", "n_features"])
    rank = F.when(F.col("fit") & (F.col("position") <= drawn), F.col("position"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op11_importance(spark, sf_dir: str) -> DataFrame:
    return importance_sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
