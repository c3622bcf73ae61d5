"""Queries over epochs as data: traces of two rates cut, stitched, resampled and padded by annotations.

Vectors are channels of the record whose number is theirs modulo the number of users; the 64 positions of a vector span the 30 days of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import epochs as E
from tracewell.plans.registry import register
from tracewell.plans.tables import annotations, rounded, table, traces

_HOUR = 3_600_000_000
_SPAN = 720 * _HOUR
_RATES = {"raw": (64 / _SPAN, 64), "pairs": (32 / _SPAN, 32)}
_WINDOWS = [("click", 24 * _HOUR, 6 * _HOUR, 6 * _HOUR, 24 * _HOUR), ("view", 48 * _HOUR, 0, 12 * _HOUR, 2 * _HOUR)]
_N = 8

_CELLS = """a AS (SELECT user_id AS rec, event_type AS label, epoch_us(ts) - 1704067200000000 AS s, epoch_us(ts) - 1704067200000000 + CAST(json_extract(props, '$.k') AS BIGINT) * 1800000000 AS e FROM events),
one AS (SELECT vec_id % (SELECT max(user_id) + 1 FROM events) AS rec, vec_id AS channel, CAST(unnest(range(len(embedding))) AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
cell AS (SELECT rec, channel, 'raw' AS metric, idx, value FROM one UNION ALL SELECT rec, channel, 'pairs', idx // 2, avg(value) FROM one GROUP BY rec, channel, idx // 2)"""
_AXES = "axes(metric, rate, n) AS (VALUES " + ", ".join(f"('{m}', {r!r}::DOUBLE, {n})" for m, (r, n) in _RATES.items()) + ")"
_PAD = f"""w(label, pl, al, ar, pr) AS (VALUES {", ".join(f"('{x[0]}', {x[1]}, {x[2]}, {x[3]}, {x[4]})" for x in _WINDOWS)}),
x AS (SELECT rec, label, s, e, greatest(s - pl, 0) AS a0, least(s + al, {_SPAN}) AS b0, greatest(e - ar, 0) AS a1, least(e + pr, {_SPAN}) AS b1 FROM a JOIN w USING (label) WHERE e - s >= {_HOUR}),
y AS (SELECT * FROM x WHERE a0 <= b0 AND a1 <= b1 AND NOT EXISTS (SELECT 1 FROM a d WHERE d.label = 'signup' AND d.rec = x.rec AND (a0 <= d.e AND b0 >= d.s OR a1 <= d.e AND b1 >= d.s))),
z AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s, label, e) - 1 AS epoch FROM y),
part AS (SELECT rec, epoch, label, 0 AS part, a0 AS s, b0 AS e FROM z UNION ALL SELECT rec, epoch, label, 1, a1, b1 FROM z)"""
_CONCAT = f"""x AS (SELECT rec, greatest(s - {_HOUR}, 0) AS s0, least(e + {_HOUR}, {_SPAN}) AS e0 FROM a WHERE contains(label, 'ick') OR contains(label, 'VIEW') OR label = 'view'),
y AS (SELECT rec, least(s0, e0) AS s, greatest(s0, e0) AS e FROM x),
k AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM y),
u AS (SELECT rec, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS p FROM k) GROUP BY rec, p),
part AS (SELECT rec, 0 AS epoch, 'ick+VIEW' AS label, row_number() OVER (PARTITION BY rec ORDER BY s) - 1 AS part, s, e FROM u)"""
_STITCHED = """i AS (SELECT rec, metric, epoch, label, part, n, greatest(CAST(round_even(s * rate, 0) AS BIGINT), 0) AS f, CAST(round_even(e * rate, 0) AS BIGINT) AS t FROM part, axes),
span AS (SELECT rec, metric, epoch, label, part, least(f, n - 1) AS f, least(greatest(t, f + 1), n) AS t FROM i),
sized AS (SELECT *, CAST(coalesce(sum(t - f) OVER (PARTITION BY rec, metric, epoch ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, CAST(sum(t - f) OVER (PARTITION BY rec, metric, epoch) AS BIGINT) AS len FROM span),
longest AS (SELECT rec, metric, max(len) AS longest FROM sized GROUP BY ALL),
st AS (SELECT c.rec, channel, metric, epoch, label, off + idx - f AS place, len, longest, value FROM cell c JOIN sized USING (rec, metric) JOIN longest USING (rec, metric) WHERE idx >= f AND idx < t)"""
_PADDED = "SELECT rec, channel, metric, CAST(epoch AS INTEGER) AS epoch, label, pos, round(value, 6) + 0.0 AS value, pos * 100 / greatest(longest - 1, 1) AS percent FROM (SELECT *, unnest(range(place, CASE WHEN place = len - 1 THEN longest ELSE place + 1 END)) AS pos FROM st)"
_RESAMPLED = f"""SELECT g.rec, g.channel, g.metric, CAST(g.epoch AS INTEGER) AS epoch, g.label, CAST(g.pos AS INTEGER) AS pos, round(l.value * (1 - (x - floor(x))) + coalesce(r.value, 0) * (x - floor(x)), 6) + 0.0 AS value, g.pos * 100 / {_N - 1} AS percent
FROM (SELECT *, CASE WHEN pos = {_N - 1} THEN (len - 1)::DOUBLE ELSE pos * ((len - 1) / {_N - 1}) END AS x FROM (SELECT DISTINCT rec, channel, metric, epoch, label, len FROM st), range({_N}) AS p(pos)) g
JOIN st l ON l.rec = g.rec AND l.channel = g.channel AND l.metric = g.metric AND l.epoch = g.epoch AND l.place = floor(x)
LEFT JOIN st r ON r.rec = g.rec AND r.channel = g.channel AND r.metric = g.metric AND r.epoch = g.epoch AND r.place = floor(x) + 1"""


def _cells(spark, sf_dir) -> DataFrame:
    """rec, channel, metric, sample_idx, value: each trace at its own rate and as means of pairs of samples."""
    users = table(spark, sf_dir, "events").agg((F.max("user_id") + 1).alias("users"))
    one = traces(spark, sf_dir).crossJoin(F.broadcast(users)).select((F.col("row_id") % F.col("users")).alias("rec"), F.col("row_id").alias("channel"), F.col("t_pos").alias("sample_idx"), "value")
    pairs = one.groupBy("rec", "channel", F.floor(F.col("sample_idx") / 2).cast("int").alias("sample_idx")).agg(F.avg("value").alias("value"))
    return one.withColumn("metric", F.lit("raw")).unionByName(pairs.withColumn("metric", F.lit("pairs")))


def _aligned(spark, sf_dir, parts: DataFrame, n: int | None) -> DataFrame:
    axes = spark.createDataFrame([(m, r, k) for m, (r, k) in _RATES.items()], "metric string, rate double, n long")
    axes = parts.select("rec").distinct().crossJoin(F.broadcast(axes))
    return rounded(E.align_metrics(_cells(spark, sf_dir), parts, axes, ["rec"], n), "value")


def _padded(spark, sf_dir) -> DataFrame:
    a = annotations(spark, sf_dir)
    windows = spark.createDataFrame(_WINDOWS, "label string, pad_left long, anno_left long, anno_right long, pad_right long")
    return E.pad_parts(a, windows, ["rec"], low=_HOUR, drops=a.where("label = 'signup'"), bounds=(F.lit(0), F.lit(_SPAN)))


def _stitched(spark, sf_dir) -> DataFrame:
    return E.concat_parts(annotations(spark, sf_dir), ["rec"], ["ick", "VIEW"], "substring", _HOUR, bounds=(F.lit(0), F.lit(_SPAN)))


@register("epochs_pad_data", f"WITH {_CELLS}, {_AXES}, {_PAD}, {_STITCHED} {_PADDED}")
def epochs_pad_data(spark, sf_dir):
    """Two windows around clicks and views, joined, edge-padded to the longest, for both metrics."""
    return _aligned(spark, sf_dir, _padded(spark, sf_dir), None)


@register("epochs_pad_resampled", f"WITH {_CELLS}, {_AXES}, {_PAD}, {_STITCHED} {_RESAMPLED}")
def epochs_pad_resampled(spark, sf_dir):
    """The same windows resampled to eight positions."""
    return _aligned(spark, sf_dir, _padded(spark, sf_dir), _N)


@register("epochs_concat_data", f"WITH {_CELLS}, {_AXES}, {_CONCAT}, {_STITCHED} {_PADDED}")
def epochs_concat_data(spark, sf_dir):
    """All clicks and views of a record stitched to one epoch of samples, for both metrics."""
    return _aligned(spark, sf_dir, _stitched(spark, sf_dir), None)


@register("epochs_concat_resampled", f"WITH {_CELLS}, {_AXES}, {_CONCAT}, {_STITCHED} {_RESAMPLED}")
def epochs_concat_resampled(spark, sf_dir):
    """The stitched epoch resampled to eight positions."""
    return _aligned(spark, sf_dir, _stitched(spark, sf_dir), _N)
