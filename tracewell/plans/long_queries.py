"""Queries over few records that hold all rows, dealt into buckets of positions.

The traces of a label, one after the other, are one record of samples; all events of a type are one record of annotations; the orders of a
priority are one device's packets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import beats as T
from tracewell.operators import buckets as B
from tracewell.operators import tensors as X
from tracewell.operators.prominence import prominences
from tracewell.plans.interval_queries import _A, _HOUR, _union
from tracewell.plans.registry import register
from tracewell.plans.tables import annotations, rounded, table, traces

_SAMPLES = 1024
_DAY = 24 * 3_600_000_000
_LONG = "cell AS (SELECT label AS rec, vec_id * 64 + unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


def _long(spark, sf_dir) -> DataFrame:
    return traces(spark, sf_dir).select(F.col("grp").alias("rec"), (F.col("row_id") * 64 + F.col("t_pos")).alias("pos"), "value")


_RUN = f"WITH {_LONG}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY rec ORDER BY pos) AS isl FROM cell WHERE value > -0.1)"


@register("long_runs", f"{_RUN} SELECT rec, min(pos) AS first, max(pos) AS last, count(*) AS n FROM i GROUP BY rec, isl HAVING count(*) >= 5")
def long_runs(spark, sf_dir):
    """Runs of samples over a threshold within long records."""
    return B.runs(_long(spark, sf_dir), ["rec"], "pos", F.col("value") > -0.1, 5, _SAMPLES)


@register("long_runs_pruned", f"{_RUN} SELECT rec, pos, round(value, 6) + 0.0 AS value FROM i QUALIFY count(*) OVER (PARTITION BY rec, isl) >= 5")
def long_runs_pruned(spark, sf_dir):
    """Samples of the runs that are long enough."""
    return rounded(B.prune_runs(_long(spark, sf_dir), ["rec"], "pos", F.col("value") > -0.1, 5, _SAMPLES), "value")


@register("long_interpolate", f"""WITH {_LONG}, k AS (SELECT rec, pos, CASE WHEN value > 0.05 THEN value END AS v FROM cell),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p0, last_value(v IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p1, first_value(v IGNORE NULLS) OVER b AS v1, count(v) OVER (PARTITION BY rec) AS m
FROM k WINDOW a AS (PARTITION BY rec ORDER BY pos ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY rec ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT rec, pos, round(CASE WHEN v IS NOT NULL THEN v WHEN m < 2 THEN NULL WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END, 6) + 0.0 AS value FROM n""")
def long_interpolate(spark, sf_dir):
    """Missing samples of long records between their neighbours."""
    c = _long(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0.05, F.col("value")))
    return rounded(B.interpolate(c, ["rec"], _SAMPLES, "pos"), "value")


@register("long_union", f"WITH {_A} SELECT label, s AS start, e AS \"end\" FROM {_union('a', _HOUR, 'label')}")
def long_union(spark, sf_dir):
    """Unions of all events of a type, gaps of an hour bridged."""
    return B.union_intervals(annotations(spark, sf_dir), ["label"], _DAY, gap=_HOUR)


@register("long_gaps", f"""WITH {_A}, b AS (SELECT label, id, s, s + 60000000 * (id % 7) AS e FROM a) SELECT label, e AS start, nxt AS "end" FROM (SELECT *, lead(s) OVER (PARTITION BY label ORDER BY s) AS nxt FROM {_union('b', 0, 'label')}) WHERE nxt > e""")
def long_gaps(spark, sf_dir):
    """Stretches in which no event of a type of up to six minutes runs."""
    a = annotations(spark, sf_dir).withColumn("end", F.col("start") + 60_000_000 * (F.col("id") % 7))
    return B.gaps(B.union_intervals(a, ["label"], _DAY), ["label"], _DAY)


@register("long_missing_packets", "SELECT o_orderpriority, o_orderkey + 1 AS first, nxt - 1 AS last, nxt - 1 - o_orderkey AS n FROM (SELECT o_orderpriority, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nxt FROM orders) WHERE nxt > o_orderkey + 1")
def long_missing_packets(spark, sf_dir):
    """Missing packet numbers of long recordings."""
    return B.missing_ranges(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", 4096)


@register("long_sample_cursor", """WITH p AS (SELECT o_orderpriority AS dev, o_orderkey AS i, 10 + o_custkey % 3 AS n FROM orders), m AS (SELECT dev, arg_max(n, c * 100 + n) AS mode FROM (SELECT dev, n, count(*) AS c FROM p GROUP BY ALL) GROUP BY dev),
l AS (SELECT dev, i, n, i - coalesce(lag(i) OVER (PARTITION BY dev ORDER BY i) + 1, 0) AS lost FROM p)
SELECT dev, i, lost, CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(lost * mode) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start_sample FROM l JOIN m USING (dev) WINDOW w AS (PARTITION BY dev ORDER BY i)""")
def long_sample_cursor(spark, sf_dir):
    """First sample of each packet of long recordings, lost ones filled."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dev"), F.col("o_orderkey").alias("i"), (10 + F.col("o_custkey") % 3).alias("n"))
    return B.sample_cursor(p, ["dev"], "i", "n", 0, 4096).select("dev", "i", "lost", "start_sample")


@register("long_median", f"WITH {_LONG} SELECT rec, pos, round(value - median(value) OVER (PARTITION BY rec ORDER BY pos RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING), 6) + 0.0 AS residual FROM cell")
def long_median(spark, sf_dir):
    """What a moving median of 51 samples leaves of long records."""
    return rounded(X.moving_median(_long(spark, sf_dir), ["rec"], 25, "pos", block=4096).select("rec", "pos", (F.col("value") - F.col("smooth")).alias("residual")), "residual")


_BEAT = (0.2, -0.5, 1.0, 2.0, 0.7, -0.4, -0.2)
_SIDES = (3, 3)
_NEAR, _FAR, _TRIES = 6, 100_000, 20


def _peaks_sql(name: str, template: str) -> str:
    """Correlation at the template's largest value, its local maxima, and those over the threshold; template: rec, o, v."""
    return f"""{name}_r AS (SELECT a.rec, a.pos + {_SIDES[0]} AS pos, corr(b.value, t.v) AS r FROM cell a JOIN cell b ON b.rec = a.rec AND b.pos BETWEEN a.pos AND a.pos + {len(_BEAT) - 1} JOIN {template} t ON t.rec = a.rec AND t.o = b.pos - a.pos GROUP BY ALL HAVING count(*) = {len(_BEAT)}),
{name}_p AS (SELECT rec, pos, r FROM (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 THEN lag(r) OVER w ELSE -2 END AS before, CASE WHEN lead(pos) OVER w = pos + 1 THEN lead(r) OVER w ELSE -2 END AS after FROM {name}_r WINDOW w AS (PARTITION BY rec ORDER BY pos)) WHERE r > before AND r >= after),
{name}_s AS (SELECT rec, quantile_cont(r, 0.6) AS low, (max(r) - quantile_cont(r, 0.6)) / {_TRIES} AS step FROM {name}_p GROUP BY rec),
{name}_l AS (SELECT rec, pos, low, step, unnest(range(1 + least({_TRIES - 1}, CAST(floor((r - low) / step) AS INTEGER)))) AS level FROM {name}_p JOIN {name}_s USING (rec) WHERE r >= low),
{name}_d AS (SELECT *, pos - lag(pos) OVER (PARTITION BY rec, level ORDER BY pos) AS far FROM {name}_l),
{name}_t AS (SELECT rec, min(at_) AS threshold FROM (SELECT rec, level, any_value(low + level * step) AS at_ FROM {name}_d GROUP BY rec, level HAVING count(*) FILTER (far BETWEEN {_NEAR} AND {_FAR}) > 0.9 * count(far)) GROUP BY rec),
{name} AS (SELECT rec, pos, r FROM {name}_p JOIN {name}_t USING (rec) WHERE r >= threshold)"""


_FIRST = f"""WITH {_LONG}, t1 AS (SELECT rec, o, v FROM (SELECT DISTINCT rec FROM cell), (VALUES {", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(_BEAT))}) b(o, v)), {_peaks_sql("b1", "t1")}"""


def _beats(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    signal = _long(spark, sf_dir)
    return signal, signal.select("rec").distinct().withColumn("template", F.array(*map(F.lit, _BEAT)))


@register("beat_peaks", f"{_FIRST} SELECT rec, pos, round(r, 6) + 0.0 AS r FROM b1")
def beat_peaks(spark, sf_dir):
    """Where a beat's shape correlates with long records, over the level that leaves plausible distances."""
    signal, shapes = _beats(spark, sf_dir)
    p = T.correlation_peaks(signal, shapes, ["rec"], "pos", 4096, 16)
    return rounded(T.found_beats(p, ["rec"], _NEAR, _FAR, 0.9, _TRIES, "pos", 4096), "r").select("rec", "pos", "r")


@register("beats_removed", f"""{_FIRST}, t2_all AS (SELECT b1.rec, cell.pos - b1.pos + {_SIDES[0]} AS o, avg(value) AS v FROM b1 JOIN cell ON cell.rec = b1.rec AND cell.pos BETWEEN b1.pos - {_SIDES[0]} AND b1.pos + {_SIDES[1]} GROUP BY ALL), {_peaks_sql("b2", "t2_all")},
top AS (SELECT rec, arg_min(o, (-abs(v), o)) AS k FROM t2_all GROUP BY rec),
m AS (SELECT rec, b, p, CASE WHEN p <= b THEN 2 * (b - k) - 1 - p ELSE 2 * (b + {len(_BEAT) - 1} - k + 1) - 1 - p END AS src FROM (SELECT b2.rec, b2.pos - {_SIDES[0]} + k AS b, k, unnest(range(b2.pos - {_SIDES[0]}, b2.pos - {_SIDES[0]} + {len(_BEAT)})) AS p FROM b2 JOIN top USING (rec))),
one AS (SELECT m.rec, p, least(greatest(arg_max(src, b), any_value(lo)), any_value(hi)) AS src FROM m JOIN (SELECT rec, min(pos) AS lo, max(pos) AS hi FROM cell GROUP BY rec) e USING (rec) GROUP BY m.rec, p),
new AS (SELECT one.rec, p, c.value FROM one JOIN cell c ON c.rec = one.rec AND c.pos = one.src)
SELECT cell.rec, cell.pos, round(CASE WHEN new.p IS NULL THEN cell.value ELSE new.value END, 6) + 0.0 AS value FROM cell LEFT JOIN new ON new.rec = cell.rec AND new.p = cell.pos""")
def beats_removed(spark, sf_dir):
    """Beats of long records replaced by their mirrored neighbours."""
    signal, shapes = _beats(spark, sf_dir)
    return rounded(T.remove_by_correlation(signal, shapes, ["rec"], _NEAR, _FAR, 0.9, "pos", 4096, 16, _TRIES), "value")


@register("peak_prominence", f"""WITH {_LONG}, w AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY pos) AS i, lag(value) OVER (PARTITION BY rec ORDER BY pos) AS p, lead(value) OVER (PARTITION BY rec ORDER BY pos) AS n FROM cell),
top AS (SELECT rec, pos, i, value FROM w WHERE value > p AND value >= n AND value > 0.15),
e AS (SELECT t.rec, t.pos, t.i, any_value(t.value) AS v, coalesce(max(w.i) FILTER (w.i < t.i AND w.value > t.value), 0) AS l, coalesce(min(w.i) FILTER (w.i > t.i AND w.value > t.value), 9000000000) AS r FROM top t JOIN w ON w.rec = t.rec GROUP BY t.rec, t.pos, t.i)
SELECT e.rec, e.pos, any_value(round(v, 6)) + 0.0 AS value, round(any_value(v) - greatest(min(w.value) FILTER (w.i <= e.i), min(w.value) FILTER (w.i >= e.i)), 6) + 0.0 AS prominence FROM e JOIN w ON w.rec = e.rec AND w.i > l AND w.i < r GROUP BY e.rec, e.pos, e.i""")
def peak_prominence(spark, sf_dir):
    """Prominence of the peaks of long records over a height."""
    return rounded(prominences(_long(spark, sf_dir), ["rec"], "pos", 2048).where(F.col("value") > 0.15), "value", "prominence")
