"""Quality classifier by positive-unlabelled learning (operator 8).

Trusted positives are labelled rows of quality 1; the web text itself is the unlabelled
sample; the class prior is estimated from the training labels. With a loss l, prior p and
z = w . x, the non-negative unbiased risk is

    p * E_pos[l(z)] + max(0, E_unl[l(-z)] - p * E_pos[l(-z)])

A few Newton steps on its convex form (logistic loss) give a start. Then the risk with the
sigmoid loss, which bounds what one row can add, is minimised by preconditioned gradient
steps; where the second part is negative, the step raises that part instead. Each step is
one pass over all unlabelled rows of the training fold; only sums of the size of the
Hessian reach the driver. The model is a few dozen numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import keep
from tracewell.llm.textops import text_slices, tokenize

FOLDS, THRESHOLD = 5, 0.3
#: Rows of partial sums that the driver adds up.
SUMS = 32
_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_SPACE = b" \t\n\r\v\f"
_STOP = b".,;:'\"-()?"
_HIGH = bytes(range(128, 256))
_OTHER = bytes(b for b in range(256) if b not in _LOWER + _UPPER + _DIGIT + _SPACE + _STOP + _HIGH)
RATES = 12


def features(texts: list[str | None]) -> np.ndarray:
    """One row of numbers per text; null and blank texts give a row of zeros but for their marker."""
    found = tokenize(texts)
    out = np.zeros((len(texts), RATES + 3))
    same = np.r_[found.hashes[1:] == found.hashes[:-1], False] if len(found.hashes) else np.empty(0, bool)
    size = found.ends - found.starts
    first = np.frombuffer(found.raw, np.uint8)[found.starts] if len(found.starts) else np.empty(0, np.uint8)
    capital = (first >= 65) & (first <= 90)
    for i, (s, e) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist())):
        n = e - s
        if not n:
            out[i, RATES + 2] = 1
            continue
        raw = found.raw[found.starts[s] : found.ends[e - 1]]
        m = len(raw)
        lower, upper, digit, stop, other, high = (m - len(raw.translate(None, c)) for c in (_LOWER, _UPPER, _DIGIT, _STOP, _OTHER, _HIGH))
        count = np.unique(found.hashes[s:e], return_counts=True)[1]
        out[i, : RATES + 2] = (
            upper / (lower + upper + high / 2 + 1),
            other / m,
            min(1.0, other / n / 3),
            digit / m,
            stop / m,
            same[s : e - 1].sum() / n,
            (count.max() - 1) / n,
            1 - len(count) / n,
            raw.count(b"\n") / n,
            capital[s:e].sum() / n,
            (size[s:e] == 1).sum() / n,
            1 - (lower + upper + high + digit + stop) / m,
            np.log1p(n),
            np.log(size[s:e].mean()),
        )
    # Roots spread small rates apart.
    return np.hstack([out, np.sqrt(out[:, :RATES])])


@dataclass
class QualityModel:
    """Weights on standardised features; scores are calibrated to the prior."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        parts = [self.score(features(texts[s:e])) for s, e in text_slices(texts)]
        return np.concatenate(parts) if parts else np.empty(0)


def _held_out(column) -> F.Column:
    return F.coalesce(F.crc32(column.cast("string")) % FOLDS == 0, F.lit(True))


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, f) of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in text_slices(texts):
                x = features(texts[s:e])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), flat], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, f array<double>")


def _sums(rows: DataFrame, of, tasks: int) -> np.ndarray:
    """Sum over rows (in so many tasks) of of(x, positive, unlabelled), first in each task, then (beyond SUMS tasks) over SUMS tasks, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                part = of(x, np.array(batch.column(1)), np.array(batch.column(2)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(b) for batch in batches for b in batch.column(0).to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(found, axis=0).tobytes()], pa.binary())], names=["s"])

    parts = rows.mapInArrow(partial, "s binary")
    if tasks > SUMS:
        parts = parts.repartition(SUMS).mapInArrow(add, "s binary")
    found = parts.collect()
    return np.sum([np.frombuffer(r.s) for r in found], axis=0) if found else np.empty(0)


def fit_quality(table: DataFrame, labels: DataFrame, ridge: float = 2e-3, start: int = 4, steps: int = 15) -> QualityModel:
    """Fit on the training fold: crc32(doc_id as text) mod 5 is not 0.

    table: doc_id, f; labels: doc_id, quality. Conflicting labels of one doc_id count as 0; null labels are
    ignored. Without a positive label the score is the prior everywhere (0.5 without any label).
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).where("q is not null and doc_id is not null")
    own = own.where(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("q").alias("q"))
    seen = own.agg(F.count("*").alias("n"), F.sum(F.col("q").cast("double")).alias("good")).first()
    prior = min(0.99, max(0.01, (seen.good or 0) / seen.n)) if seen.n else 0.5
    rows = keep(
        table.where(~_held_out(F.col("doc_id"))).join(own, "doc_id", "left").select("f", F.coalesce(F.col("q") == 1, F.lit(False)).alias("pos"), F.lit(True).alias("unl")),
        "training",
    )

    def moments(x, pos, unl):
        return np.r_[len(x), pos.sum(), x.sum(0), (x * x).sum(0)]

    tasks = rows.rdd.getNumPartitions()  # asked once: each call plans the table anew
    got = _sums(rows, moments, tasks)
    width = RATES * 2 + 3
    if not len(got) or not got[1]:
        return QualityModel(np.zeros(width), np.ones(width), np.r_[np.log(prior / (1 - prior)), np.zeros(width)], prior)
    n, n_pos = got[0], got[1]
    mean = got[2 : 2 + width] / n
    scale = np.sqrt(np.maximum(got[2 + width :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0

    def passed(w: np.ndarray, sigmoid: bool):
        """(second part of the risk, gradients of both parts, curvature) at w."""

        def of(x, pos, unl):
            x = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            slope = p * (1 - p)
            bend = np.maximum(slope, 0.02) if sigmoid else slope
            pull = slope if sigmoid else p
            return np.r_[p.sum(), p[pos].sum(), slope[pos] @ x[pos], x[pos].sum(0), pull @ x, ((x * bend[:, None]).T @ x).ravel()]

        s = _sums(rows, of, tasks)
        d = width + 1
        pos_slope, pos_x, unl_x = s[2 : 2 + d] / n_pos, s[2 + d : 2 + 2 * d] / n_pos, s[2 + 2 * d : 2 + 3 * d] / n
        curve = s[2 + 3 * d :].reshape(d, d) / n
        if sigmoid:
            return s[0] / n - prior * s[1] / n_pos, -prior * pos_slope, unl_x - prior * pos_slope, curve
        return 1.0, -prior * pos_x, unl_x, curve

    w = np.r_[np.log(prior / (1 - prior)), np.zeros(width)]
    own = np.r_[0.0, np.ones(width)]
    for turn in range(start + steps):
        sigmoid = turn >= start
        second, grad_first, grad_second, curve = passed(w, sigmoid)
        grad = (grad_first + grad_second if second >= 0 else -grad_second) + (ridge if sigmoid else 1e-2) * own * w
        w = w - np.linalg.solve(curve + 1e-2 * np.diag(own if not sigmoid else np.ones(width + 1)) + 1e-8 * np.eye(width + 1), grad)
    return QualityModel(mean, scale, w, prior)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document's quality score: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    One row per input row. Null and empty texts are scored too; a null doc_id counts as held out.
    Only the text is looked at.
    """
    table = keep(feature_table(docs), "features")
    model = fit_quality(table, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, RATES * 2 + 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    out = table.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    model = fit_quality(keep(feature_table(docs), "features"), labels)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score_texts(text.to_pylist()))

    return docs.where(score(F.col("text").cast("string")) >= threshold)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
