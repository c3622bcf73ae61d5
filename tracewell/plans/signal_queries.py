"""Queries of alignment, anatomy, masks, spectra and pair measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import align as E
from tracewell.operators import anatomy as A
from tracewell.operators import artifacts as R
from tracewell.operators import connectivity as K
from tracewell.operators import crossspectra as Y
from tracewell.operators import spectral as G
from tracewell.operators import tensors as X
from tracewell.operators.smoothing import MODES
from tracewell.plans.registry import register
from tracewell.plans.tables import annotations, rounded, table, traces

_CELL = """cell AS (SELECT vec_id AS row_id, label AS grp, CAST(unnest(range(len(embedding))) AS INTEGER) AS t_pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
_A = """a AS (SELECT user_id AS rec, event_id AS id, event_type AS label, epoch_us(ts) - 1704067200000000 AS s, epoch_us(ts) - 1704067200000000 + CAST(json_extract(props, '$.k') AS BIGINT) * 1800000000 AS e, value FROM events)"""
_DAY = 86400000000


@register("epochs_stack", f"WITH {_A}, d AS (SELECT * FROM a WHERE label = 'purchase'), x AS (SELECT rec, label, s - 3600000000 AS s, e + 3600000000 AS e FROM a WHERE label IN ('click', 'view') AND e - s BETWEEN 18000000000 AND 86400000000) SELECT rec, label, s AS start, e AS \"end\", CAST(row_number() OVER (PARTITION BY rec ORDER BY s, e, label) - 1 AS INTEGER) AS epoch FROM x WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.rec = x.rec AND x.s <= d.e AND x.e >= d.s)")
def epochs_stack(spark, sf_dir):
    """Stacked epochs: label, duration, pad, drop-overlap."""
    a = annotations(spark, sf_dir)
    return E.stack_epochs(a, ["rec"], ["click", "view"], 18000000000, 86400000000, 3600000000, a.where("label = 'purchase'"))


@register("epochs_pad", f"WITH {_A}, x AS (SELECT rec, label, s, e, row_number() OVER (PARTITION BY rec ORDER BY s, e, label) - 1 AS epoch FROM a WHERE label = 'click') SELECT rec, CAST(epoch AS INTEGER) AS epoch, label, CAST(part AS INTEGER) AS part, greatest(CASE WHEN part = 0 THEN s ELSE e END - 1000000, 0) AS start, CASE WHEN part = 0 THEN s ELSE e END + 2000000 AS \"end\" FROM x, (VALUES (0), (1)) p(part)")
def epochs_pad(spark, sf_dir):
    """Windows around both ends of an annotation."""
    return E.pad_epochs(annotations(spark, sf_dir), ["rec"], ["click"], 1000000, 2000000, (0, 2**62))


@register("epochs_concat", f"""WITH {_A}, v AS (SELECT * FROM a WHERE label = 'view' AND e > s), m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY rec ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM v),
u AS (SELECT rec, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY rec ORDER BY s, e, id) AS p FROM m) GROUP BY rec, p)
SELECT rec, s AS start, e AS "end", CAST(row_number() OVER w - 1 AS INTEGER) AS part, CAST(coalesce(sum(e - s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM u WINDOW w AS (PARTITION BY rec ORDER BY s)""")
def epochs_concat(spark, sf_dir):
    """The union of views stitched to one epoch per record."""
    return E.concat_epochs(annotations(spark, sf_dir), ["rec"], ["view"])


@register("epochs_linear", f"""WITH {_A}, v AS (SELECT rec, s AS t0, count(*) AS copies FROM a WHERE label = 'view' GROUP BY ALL), c AS (SELECT DISTINCT rec, s AS t FROM a WHERE label = 'click'), p AS (SELECT DISTINCT rec, s AS t FROM a WHERE label = 'purchase'),
q AS (SELECT v.rec, t0, copies, c.t AS t1, p.t AS t2 FROM v JOIN c ON c.rec = v.rec AND c.t > t0 JOIN p ON p.rec = v.rec AND p.t > c.t WHERE p.t - t0 BETWEEN {_DAY} AND {20 * _DAY} AND abs((c.t - t0) / (p.t - t0) * 100 - 40) <= 35),
f AS (SELECT rec, t0, copies, t2, min(t1) AS t1 FROM q GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY rec, t0 ORDER BY t1, t2) AS r FROM f)
SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY t0, t2) - 1 AS INTEGER) AS epoch, t0 AS start, t1 AS mid, t2 AS "end" FROM r WHERE r <= copies""")
def epochs_linear(spark, sf_dir):
    """View, click, purchase as anchors at 0, 40 and 100 %."""
    ev = annotations(spark, sf_dir).select("rec", "label", F.col("start").alias("t"))
    out = E.linear_epochs(ev, ["rec"], [(0, "view"), (40, "click"), (100, "purchase")], _DAY, 20 * _DAY, 35)
    return out.select("rec", "epoch", "start", F.col("times")[1].alias("mid"), "end")


@register("resample_linear", f"""WITH {_CELL}, g AS (SELECT row_id, unnest(range(10)) AS pos FROM (SELECT DISTINCT row_id FROM cell)), h AS (SELECT row_id, pos, CASE WHEN pos < 4 THEN 5 + 20 * (pos / 4) ELSE 25 + 30 * ((pos - 4) / 5) END AS x FROM g)
SELECT h.row_id, CAST(0 AS INTEGER) AS epoch, CAST(pos AS INTEGER) AS pos, round(a.value * (1 - (x - floor(x))) + coalesce(b.value, 0) * (x - floor(x)), 6) + 0.0 AS value FROM h JOIN cell a ON a.row_id = h.row_id AND a.t_pos = floor(x) LEFT JOIN cell b ON b.row_id = h.row_id AND b.t_pos = floor(x) + 1""")
def resample_linear(spark, sf_dir):
    """Traces resampled piecewise between anchors at positions 5, 25 and 55."""
    c = traces(spark, sf_dir).select("row_id", "t_pos", "value")
    ep = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.lit(0).alias("epoch"), F.array(F.lit(5.0), F.lit(25.0), F.lit(55.0)).alias("times"))
    return rounded(E.resample(E.epoch_grid(ep, ["row_id"], [0, 40, 100], 10, 1.0), c, ["row_id"]), "value")


@register("representative_duration", f"WITH {_A} SELECT rec, CASE WHEN avg(CAST(label IN ('click', 'view') AS INTEGER)) > 0.5 THEN avg(e - s) ELSE median(e - s) END AS duration FROM a GROUP BY rec")
def representative_duration(spark, sf_dir):
    """Duration that stands for a record's epochs."""
    return E.representative_duration(annotations(spark, sf_dir), ["rec"], F.col("label").isin("click", "view"))


@register("label_match", f"WITH {_A} SELECT rec, id, CASE WHEN contains(label, 'click') THEN 'CLICK' WHEN contains(label, 'c') THEN 'C' END AS label FROM a WHERE contains(label, 'c')")
def label_match(spark, sf_dir):
    """First matching label in order, substrings without case."""
    ev = annotations(spark, sf_dir).select("rec", "id", F.col("label").alias("description"))
    labels = spark.createDataFrame([("CLICK", 0), ("C", 1)], "label string, rank int")
    return E.match_labels(ev, labels, "contains").select("rec", "id", "label")


@register("dim_left_join_keep_first", "SELECT o_orderkey, o_custkey, c.c_acctbal FROM orders LEFT JOIN (SELECT c_nationkey, arg_min(c_acctbal, c_custkey) AS c_acctbal FROM customer GROUP BY c_nationkey) c ON o_custkey % 30 = c_nationkey")
def dim_left_join_keep_first(spark, sf_dir):
    """Left join to a dimension's first row per key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 30).cast("int").alias("c_nationkey"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_custkey", "c_acctbal")
    return A.join_coordinates(o, c, ["c_nationkey"], "c_custkey").select("o_orderkey", "o_custkey", "c_acctbal")


@register("pair_left_join", "WITH d AS (SELECT a.p_partkey AS x, b.p_partkey AS y, b.p_size AS s FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 3 = 0) SELECT l_orderkey, l_linenumber, l_quantity, d.s FROM lineitem LEFT JOIN d ON (l_partkey = x AND l_partkey + 1 = y)")
def pair_left_join(spark, sf_dir):
    """Left join on an unordered pair key."""
    p = table(spark, sf_dir, "part")
    d = p.alias("p").join(p.alias("q"), F.col("q.p_partkey") == F.col("p.p_partkey") + 1).where("p.p_partkey % 3 = 0").select(F.col("p.p_partkey").cast("string").alias("a"), F.col("q.p_partkey").cast("string").alias("b"), F.col("q.p_size").alias("s"), F.lit(0).alias("ord"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_partkey") + 1).cast("string").alias("a"), F.col("l_partkey").cast("string").alias("b"))
    return A.join_pairs(li, d, "a", "b", "ord", ordered=False).select("l_orderkey", "l_linenumber", "l_quantity", "s")


@register("pair_left_join_all", "WITH d AS (SELECT a.p_partkey AS x, b.p_partkey AS y, b.p_size AS s FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT l_orderkey, l_linenumber, l_quantity, d.s FROM lineitem LEFT JOIN d ON (l_partkey = x AND l_partkey + 1 = y)")
def pair_left_join_all(spark, sf_dir):
    """Left join on an unordered pair key, all neighbouring parts."""
    p = table(spark, sf_dir, "part")
    d = p.alias("p").join(p.alias("q"), F.col("q.p_partkey") == F.col("p.p_partkey") + 1).select(F.col("p.p_partkey").cast("string").alias("a"), F.col("q.p_partkey").cast("string").alias("b"), F.col("q.p_size").alias("s"), F.lit(0).alias("ord"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_partkey") + 1).cast("string").alias("a"), F.col("l_partkey").cast("string").alias("b"))
    return A.join_pairs(li, d, "a", "b", "ord", ordered=False).select("l_orderkey", "l_linenumber", "l_quantity", "s")


@register("channel_pairs_all", "SELECT a.n_regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def channel_pairs_all(spark, sf_dir):
    """Unordered pairs within groups."""
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "pos").withColumnRenamed("n_name", "channel")
    return A.self_pairs(n, ["n_regionkey"])


@register("channel_pairs_ordered", "SELECT a.n_regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def channel_pairs_ordered(spark, sf_dir):
    """Ordered pairs within groups."""
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "pos").withColumnRenamed("n_name", "channel")
    return A.self_pairs(n, ["n_regionkey"], ordered=True)


_REC = "r AS (SELECT l_suppkey % 7 AS a, l_partkey % 7 AS b, sum(l_quantity) AS f, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"


def _scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 7).alias("a"), (F.col("l_partkey") % 7).alias("b")).agg(F.sum("l_quantity").alias("f"), F.sum("l_extendedprice").alias("v")).withColumn("rec", F.lit(1))


@register("reciprocal_net", f"WITH {_REC} SELECT x.a, x.b, round((x.f - y.f) - (x.v - y.v), 4) + 0.0 AS value FROM r x JOIN r y ON x.a = y.b AND x.b = y.a")
def reciprocal_net(spark, sf_dir):
    """Net of two directions less the reversed one."""
    s = _scores(spark, sf_dir)
    f, r = s.select("rec", "a", "b", F.col("f").cast("double").alias("value")), s.select("rec", "a", "b", F.col("v").cast("double").alias("value"))
    return rounded(A.net_difference(f, r, ["rec"]).drop("rec"), "value", digits=4)


@register("reciprocal_closure", "WITH p AS (SELECT DISTINCT l_suppkey % 9 AS a, l_partkey % 9 AS b FROM lineitem WHERE l_suppkey % 9 < l_partkey % 9) SELECT a, b, true AS requested FROM p UNION ALL SELECT b, a, false FROM p")
def reciprocal_closure(spark, sf_dir):
    """Pairs closed under reversal."""
    p = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 9).alias("a"), (F.col("l_partkey") % 9).alias("b")).distinct().where("a < b").withColumn("ord", F.col("a") * 9 + F.col("b"))
    return A.reciprocal_closure(p).select("a", "b", "requested")


_VOX = "v AS (SELECT CAST(p_partkey % 5 AS INTEGER) AS i, CAST(p_size % 5 AS INTEGER) AS j, CAST(p_partkey // 5 % 5 AS INTEGER) AS k, p_brand AS region, p_retailprice / 2000 AS weight FROM part)"


def _voxels(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).cast("int").alias("i"), (F.col("p_size") % 5).cast("int").alias("j"), (F.floor(F.col("p_partkey") / 5) % 5).cast("int").alias("k"), F.col("p_brand").alias("region"), (F.col("p_retailprice") / 2000).alias("weight"))


@register("region_lookup", f"WITH {_VOX}, p AS (SELECT s_suppkey AS channel, CAST(round_even((s_suppkey % 13) * 0.5 - 0.5, 0) AS INTEGER) AS i, CAST(round_even((s_suppkey % 11) * 0.5, 0) AS INTEGER) AS j, CAST(round_even((s_suppkey % 7) * 1.0, 0) AS INTEGER) AS k FROM supplier), r AS (SELECT DISTINCT region FROM v), h AS (SELECT DISTINCT channel, region FROM p JOIN v USING (i, j, k) WHERE weight > 0.6 AND i BETWEEN 0 AND 4 AND j BETWEEN 0 AND 4 AND k BETWEEN 0 AND 4) SELECT p.channel, r.region, h.channel IS NOT NULL AS inside FROM p CROSS JOIN r LEFT JOIN h ON p.channel = h.channel AND r.region = h.region")
def region_lookup(spark, sf_dir):
    """World to voxel by inverse affine, any file of a region over the threshold."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("channel"), (F.col("s_suppkey") % 13).cast("double").alias("x"), (F.col("s_suppkey") % 11).cast("double").alias("y"), (F.col("s_suppkey") % 7).cast("double").alias("z"))
    return A.region_membership(s, _voxels(spark, sf_dir), [(0.5, 0, 0, -0.5), (0, 0.5, 0, 0), (0, 0, 1.0, 0)], (5, 5, 5), 0.6)


@register("centre_of_gravity", f"WITH {_VOX} SELECT region, round(sum(i * weight) / sum(weight), 6) AS x, round(sum(j * weight) / sum(weight), 6) AS y, round(sum(k * weight) / sum(weight), 6) AS z FROM v GROUP BY region")
def centre_of_gravity(spark, sf_dir):
    """Value-weighted centres."""
    v = _voxels(spark, sf_dir).withColumnsRenamed({"i": "x", "j": "y", "k": "z"})
    return rounded(A.centre_of_gravity(v, ["region"]), "x", "y", "z")


@register("notch_grid", "SELECT p_partkey, CAST(f AS DOUBLE) AS freq FROM (SELECT p_partkey, p_size * 1.5 AS f FROM part) WHERE NOT (f BETWEEN 29 AND 31) AND NOT (f BETWEEN 58.5 AND 61.5)")
def notch_grid(spark, sf_dir):
    """Grid points outside notches."""
    g = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.5).alias("freq"))
    n = spark.createDataFrame([(30.0, 2.0), (60.0, 3.0)], "center double, width double")
    return X.outside_notches(g, n)


@register("freq_interpolate", f"""WITH {_CELL}, g AS (SELECT row_id, t_pos, CASE WHEN value > 0.02 THEN value END AS v FROM cell), k AS (SELECT * FROM g WHERE v IS NOT NULL), n AS (SELECT row_id, count(v) AS n FROM g GROUP BY row_id)
SELECT g.row_id, g.t_pos, round(CASE WHEN g.v IS NOT NULL THEN g.v WHEN n < 2 THEN NULL WHEN lo.v IS NULL THEN hi.v WHEN hi.v IS NULL THEN lo.v ELSE lo.v + (hi.v - lo.v) * (g.t_pos - lo.t_pos) / (hi.t_pos - lo.t_pos) END, 6) + 0.0 AS value
FROM g JOIN n USING (row_id) ASOF LEFT JOIN k lo ON g.row_id = lo.row_id AND g.t_pos >= lo.t_pos ASOF LEFT JOIN k hi ON g.row_id = hi.row_id AND g.t_pos <= hi.t_pos""")
def freq_interpolate(spark, sf_dir):
    """Missing bins by linear interpolation, edges held."""
    t = traces(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0.02, F.col("value"))).select("row_id", "t_pos", "value")
    return rounded(X.interpolate(t, ["row_id"], "t_pos"), "value")


@register("freq_interpolate_db")
def freq_interpolate_db(spark, sf_dir):
    """Missing bins interpolated in decibels (G22); tested on its own."""
    t = traces(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0.02, F.col("value"))).select("row_id", "t_pos", "value")
    return rounded(X.interpolate_in(t, ["row_id"], "db", "t_pos"), "value")


@register("smooth_mean", f"WITH {_CELL} SELECT row_id, t_pos, round(avg(value) OVER (PARTITION BY row_id ORDER BY t_pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS smooth FROM cell")
def smooth_mean(spark, sf_dir):
    """Moving means."""
    return rounded(X.smooth_mean(traces(spark, sf_dir), ["row_id"], 2, mode=None).select("row_id", "t_pos", "smooth"), "smooth")


@register("smooth_median", f"WITH {_CELL} SELECT row_id, t_pos, round(median(value) OVER (PARTITION BY row_id ORDER BY t_pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS smooth FROM cell")
def smooth_median(spark, sf_dir):
    """Moving medians."""
    return rounded(X.smooth_median(traces(spark, sf_dir), ["row_id"], 5, mode=None).select("row_id", "t_pos", "smooth"), "smooth")


@register("smooth_gaussian", f"WITH {_CELL} SELECT a.row_id, a.t_pos, round(sum(exp(-0.5 * ((b.t_pos - a.t_pos) / 1.5) ** 2) * b.value) / sum(exp(-0.5 * ((b.t_pos - a.t_pos) / 1.5) ** 2)), 6) + 0.0 AS smooth FROM cell a JOIN cell b ON a.row_id = b.row_id AND abs(a.t_pos - b.t_pos) <= 6 GROUP BY ALL")
def smooth_gaussian(spark, sf_dir):
    """Gaussian smoothing."""
    return rounded(X.smooth_gaussian(traces(spark, sf_dir), ["row_id"], 1.5, mode=None).select("row_id", "t_pos", "smooth"), "smooth")


def _edge_sql(half: int, value: str) -> str:
    """Every mode's frame of each position: the position in the trace that stands at each place of the frame (n = 64), or none for a constant."""
    period = "CASE mode WHEN 'wrap' THEN 64 WHEN 'reflect' THEN 128 ELSE 126 END"
    fold = f"(((q % ({period})) + ({period})) % ({period}))"
    at = f"CASE WHEN q BETWEEN 0 AND 63 THEN q WHEN mode = 'nearest' THEN least(63, greatest(0, q)) WHEN mode = 'wrap' THEN {fold} WHEN mode = 'reflect' THEN least({fold}, 127 - {fold}) WHEN mode = 'mirror' THEN least({fold}, 126 - {fold}) END"
    return f"""WITH {_CELL}, part AS (SELECT row_id, t_pos, CASE WHEN value > -0.15 THEN value END AS v FROM cell), f AS (SELECT mode, t_pos, o, t_pos + o AS q FROM (VALUES ('nearest'), ('reflect'), ('mirror'), ('constant'), ('wrap')) m(mode), range(64) p(t_pos), range({-half}, {half + 1}) d(o)),
g AS (SELECT *, {at} AS src FROM f), x AS (SELECT mode, p.row_id, g.t_pos, o, CASE WHEN src IS NULL THEN 0.5 ELSE p.v END AS v, CASE WHEN src IS NULL THEN 0.5 ELSE 1 END AS w FROM g JOIN part p ON p.t_pos = coalesce(src, 0))
SELECT mode, row_id, CAST(t_pos AS INTEGER) AS t_pos, round({value}, 6) + 0.0 AS smooth FROM x GROUP BY mode, row_id, t_pos"""


def _all_modes(spark, sf_dir, smoother) -> DataFrame:
    t = traces(spark, sf_dir).select("row_id", "t_pos", F.when(F.col("value") > -0.15, F.col("value")).alias("value"))
    parts = [smoother(t, mode).select(F.lit(mode).alias("mode"), "row_id", "t_pos", "smooth") for mode in MODES]
    return rounded(reduce(DataFrame.unionByName, parts), "smooth")


@register("smooth_mean_edges", _edge_sql(4, "sum(v) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0)"))
def smooth_mean_edges(spark, sf_dir):
    """Moving means with every edge mode, missing samples left out."""
    return _all_modes(spark, sf_dir, lambda t, mode: X.smooth_mean(t, ["row_id"], 4, mode=mode, cval=0.5))


@register("smooth_median_edges", _edge_sql(4, "median(v)"))
def smooth_median_edges(spark, sf_dir):
    """Moving medians with every edge mode."""
    return _all_modes(spark, sf_dir, lambda t, mode: X.smooth_median(t, ["row_id"], 8, mode=mode, cval=0.5))


@register("smooth_gaussian_edges", _edge_sql(6, "sum(exp(-0.5 * (o / 1.5) ** 2) * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN exp(-0.5 * (o / 1.5) ** 2) * w END), 0)"))
def smooth_gaussian_edges(spark, sf_dir):
    """Gaussian smoothing with every edge mode."""
    return _all_modes(spark, sf_dir, lambda t, mode: X.smooth_gaussian(t, ["row_id"], 1.5, mode=mode, cval=0.5))


@register("grid_match", "WITH s AS (SELECT DISTINCT p_size * 0.999 AS f FROM part), t AS (SELECT DISTINCT p_size * 1.0 AS f FROM part) SELECT CAST(t.f AS DOUBLE) AS target, CAST(arg_min(s.f, abs(s.f - t.f)) AS DOUBLE) AS source FROM t JOIN s ON abs(s.f - t.f) <= 0.02 GROUP BY t.f")
def grid_match(spark, sf_dir):
    """Grid points matched within a tolerance."""
    p = table(spark, sf_dir, "part")
    return X.match_grid(p.select((F.col("p_size") * 0.999).alias("freq")).distinct(), p.select((F.col("p_size") * 1.0).alias("freq")).distinct(), 0.02)


@register("segment_signal", f"WITH {_CELL} SELECT row_id, t_pos, CAST(t_pos // 10 AS BIGINT) AS segment, CAST(t_pos % 10 AS INTEGER) AS seg_pos FROM cell WHERE t_pos < 60")
def segment_signal(spark, sf_dir):
    """Whole segments of ten samples."""
    return X.segments(traces(spark, sf_dir), ["row_id"], "t_pos", 10).select("row_id", "t_pos", "segment", "seg_pos")


@register("decimate_display", f"WITH {_CELL} SELECT row_id, t_pos FROM cell WHERE t_pos % 7 = 0")
def decimate_display(spark, sf_dir):
    """Traces thinned to at most ten points."""
    return X.decimate_to(traces(spark, sf_dir), ["row_id"], "t_pos", 10).select("row_id", "t_pos")


@register("local_peaks", f"WITH {_CELL}, w AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS n FROM cell WINDOW w AS (PARTITION BY row_id ORDER BY t_pos)), t AS (SELECT row_id, t_pos, value, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, t_pos) AS r FROM w WHERE value > p AND value >= n AND value >= 0.1) SELECT row_id, t_pos, round(value, 6) AS score FROM t WHERE r <= 3")
def local_peaks(spark, sf_dir):
    """The three highest local maxima of each trace."""
    return rounded(R.find_peaks(traces(spark, sf_dir), ["row_id"], 0.1, best=3, idx="t_pos").select("row_id", "t_pos", "score"), "score")


@register("beat_template", f"WITH {_CELL}, b AS (SELECT DISTINCT row_id, 16 + 16 * u AS c FROM cell, (VALUES (0), (1), (2)) x(u)), o AS (SELECT unnest(range(-4, 6)) AS o) SELECT b.row_id, CAST(o AS INTEGER) AS \"offset\", round(avg(value), 6) + 0.0 AS template FROM b, o JOIN cell ON cell.row_id = b.row_id AND t_pos = c + o GROUP BY ALL")
def beat_template(spark, sf_dir):
    """Average beat by offset."""
    t = traces(spark, sf_dir)
    return rounded(R.beat_template(t, _beats(t), ["row_id"], 4, 5, "t_pos"), "template")


def _beats(t):
    return t.where("t_pos in (16, 32, 48)").select("row_id", "t_pos")


@register("beat_subtract", f"""WITH {_CELL}, b AS (SELECT DISTINCT row_id, 16 + 16 * u AS c FROM cell, (VALUES (0), (1), (2)) x(u)), o AS (SELECT unnest(range(-4, 6)) AS o), m AS (SELECT b.row_id, c, o, t_pos, value FROM b, o JOIN cell ON cell.row_id = b.row_id AND t_pos = c + o),
t AS (SELECT *, avg(value) OVER (PARTITION BY row_id, o) AS tp FROM m), f AS (SELECT row_id, c, regr_slope(value, tp) AS s, regr_intercept(value, tp) AS i FROM t GROUP BY ALL)
SELECT cell.row_id, cell.t_pos, round(cell.value - coalesce(s * tp + i, 0), 6) + 0.0 AS value FROM cell LEFT JOIN (SELECT t.row_id, t_pos, tp, s, i FROM t JOIN f ON t.row_id = f.row_id AND t.c = f.c) z ON cell.row_id = z.row_id AND cell.t_pos = z.t_pos""")
def beat_subtract(spark, sf_dir):
    """Beat templates subtracted by least squares."""
    t = traces(spark, sf_dir).select("row_id", "t_pos", "value")
    tp = R.beat_template(t, _beats(t), ["row_id"], 4, 5, "t_pos")
    return rounded(R.subtract_template(t, _beats(t), tp, ["row_id"], "t_pos").select("row_id", "t_pos", "value"), "value")


@register("aperiodic_fit", f"""WITH {_CELL}, p AS (SELECT row_id, log10(t_pos + 1) AS x, log10(value * value) AS y FROM cell WHERE value <> 0), r AS (SELECT *, y - regr_intercept(y, x) OVER (PARTITION BY row_id) - regr_slope(y, x) OVER (PARTITION BY row_id) * x AS r FROM p), c AS (SELECT *, quantile_cont(r, 0.75) OVER (PARTITION BY row_id) AS cut FROM r)
SELECT row_id, round(regr_intercept(y, x), 4) + 0.0 AS "offset", round(-regr_slope(y, x), 4) + 0.0 AS exponent, round(regr_r2(y, x), 4) + 0.0 AS r2, count(*) AS n FROM c WHERE r <= cut GROUP BY row_id""")
def aperiodic_fit(spark, sf_dir):
    """Log-log line with one robust refit."""
    t = traces(spark, sf_dir).select("row_id", (F.col("t_pos") + 1.0).alias("freq"), (F.col("value") * F.col("value")).alias("power"))
    return rounded(G.aperiodic_fit(t, ["row_id"]), "offset", "exponent", "r2", digits=4)


def _signal(spark, sf_dir):
    return traces(spark, sf_dir).select("row_id", F.col("t_pos").cast("long").alias("sample_idx"), "value")


FREQS, CYCLES, RATE = (8.0, 12.0, 16.0, 24.0), (2.0, 3.0, 4.0, 6.0), 64.0


def _coefficients(spark, sf_dir):
    s = traces(spark, sf_dir).select(F.col("grp").alias("rec"), F.col("row_id").cast("string").alias("channel"), F.col("t_pos").cast("long").alias("sample_idx"), "value")
    return G.morlet(s, ["rec", "channel"], RATE, FREQS, CYCLES, hop=2)


def _neighbours(spark, sf_dir):
    """Each channel with the next one of its label."""
    after = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("a"), after.cast("string").alias("b"))
    return e.where("a is not null and b is not null")


@register("fir_bandpass")
def fir_bandpass(spark, sf_dir):
    """Zero-phase band-pass of every trace (G1)."""
    return rounded(G.fir_filter(_signal(spark, sf_dir), ["row_id"], G.sinc_taps(RATE, 4, 20, 8), 32), "value")


@register("welch_psd")
def welch_psd(spark, sf_dir):
    """Averaged Hann periodograms."""
    return rounded(G.welch(_signal(spark, sf_dir), ["row_id"], RATE, 32), "psd", digits=8)


@register("morlet_power")
def morlet_power(spark, sf_dir):
    """Morlet power every second sample."""
    return rounded(_coefficients(spark, sf_dir).select("rec", "channel", "freq", "sample_idx", "power"), "power", digits=8)


@register("multitaper_power")
def multitaper_power(spark, sf_dir):
    """Slepian-taper power."""
    return rounded(G.multitaper(_signal(spark, sf_dir), ["row_id"], RATE, FREQS, CYCLES, hop=4), "power", digits=8)


def _cross_sums(spark, sf_dir, kernels):
    s = traces(spark, sf_dir).select(F.col("grp").alias("rec"), F.col("row_id").cast("string").alias("channel"), F.col("t_pos").cast("long").alias("sample_idx"), "value")
    return Y.cross_sums(s, _neighbours(spark, sf_dir), ["rec"], FREQS, kernels, hop=2)


@register("pair_measures")
def pair_measures(spark, sf_dir):
    """Coherence, PLV, ciPLV, PLI and wPLI of neighbouring channels."""
    return rounded(Y.measures_of(_cross_sums(spark, sf_dir, Y.morlet_kernels(RATE, FREQS, CYCLES)), ["rec"]), *K.MEASURES)


@register("pair_measures_multitaper")
def pair_measures_multitaper(spark, sf_dir):
    """The same over Slepian tapers, for every two channels of a label."""
    s = traces(spark, sf_dir).select(F.col("grp").alias("rec"), F.col("row_id").cast("string").alias("channel"), F.col("t_pos").cast("long").alias("sample_idx"), "value")
    channels = table(spark, sf_dir, "embeddings").select(F.col("label").alias("rec"), F.col("vec_id").cast("string").alias("channel"), F.col("vec_id").alias("pos"))
    sums = Y.all_cross_sums(s, channels, ["rec"], FREQS, Y.multitaper_kernels(RATE, FREQS, CYCLES), hop=2)
    return rounded(Y.measures_of(sums, ["rec"]), *K.MEASURES)


@register("pair_measures_windowed")
def pair_measures_windowed(spark, sf_dir):
    """The same in centred windows that depend on frequency."""
    s = traces(spark, sf_dir).select(F.col("grp").alias("rec"), F.col("row_id").cast("string").alias("channel"), F.col("t_pos").cast("long").alias("sample_idx"), "value")
    kernels = Y.morlet_kernels(RATE, FREQS, CYCLES)
    return rounded(Y.windowed(s, _neighbours(spark, sf_dir), ["rec"], FREQS, kernels, {0: 8, 1: 8, 2: 4, 3: 4}, ("coh", "plv"), hop=2), "coh", "plv")


_BANDS = [("low", 8.0, 16.0), ("all", 8.0, 24.0)]


@register("phase_slope_index")
def phase_slope_index(spark, sf_dir):
    """Phase slope per band."""
    sums = _cross_sums(spark, sf_dir, Y.morlet_kernels(RATE, FREQS, CYCLES))
    return rounded(Y.phase_slope_of(sums, ["rec"], spark.createDataFrame(_BANDS, "band string, start double, end double"), RATE), "psi", digits=8)


@register("phase_slope_multitaper")
def phase_slope_multitaper(spark, sf_dir):
    """Phase slope per band over Slepian tapers."""
    sums = _cross_sums(spark, sf_dir, Y.multitaper_kernels(RATE, FREQS, CYCLES))
    return rounded(Y.phase_slope_of(sums, ["rec"], spark.createDataFrame(_BANDS, "band string, start double, end double"), RATE), "psi", digits=8)


@register("granger_net")
def granger_net(spark, sf_dir):
    """Directed scores, forward less reversed, net of both directions."""
    s = traces(spark, sf_dir).select(F.col("grp").alias("rec"), F.col("row_id").cast("string").alias("channel"), F.col("t_pos").cast("long").alias("sample_idx"), "value")
    pairs = _neighbours(spark, sf_dir)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    scores = K.granger_scores(s, both, ["rec"], 3)
    net = A.reciprocal(scores.select("rec", "a", "b", (F.col("value") - F.col("reversed")).alias("value")), ["rec"])
    return rounded(net.select("rec", "a", "b", (F.col("value") - F.col("value_back")).alias("value")), "value")


@register("burst_mask")
def burst_mask(spark, sf_dir):
    """Envelope, percentile threshold and run length."""
    env = G.envelope(_signal(spark, sf_dir), ["row_id"], RATE, [("alpha", 8, 13), ("beta", 13, 20), ("beta", 22, 30)])
    lim = G.thresholds(env, ["row_id", "band"], 75)
    return G.burst_mask(env, lim, ["row_id", "band"], {"alpha": 10.0, "beta": 21.0}, RATE, 0.5)


@register("beat_svd")
def beat_svd(spark, sf_dir):
    """Leading component of beat epochs removed."""
    t = traces(spark, sf_dir).select("row_id", "t_pos", "value")
    return rounded(R.remove_beats(t, _beats(t), ["row_id"], "svd", 4, 5, 1, "t_pos"), "value")


@register("savgol_fill")
def savgol_fill(spark, sf_dir):
    """Missing bins by local polynomials."""
    t = traces(spark, sf_dir).withColumn("value", F.when(F.abs("value") > 0.02, F.col("value"))).select("row_id", "t_pos", "value")
    return rounded(X.savgol_fill(t, ["row_id"], 5, 2, "t_pos"), "value", "filled")


