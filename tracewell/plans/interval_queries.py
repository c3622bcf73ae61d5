"""Queries over annotations: unions, masks, gaps, runs. Times are integer microseconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import intervals as I
from tracewell.plans.registry import register
from tracewell.plans.tables import annotations, table

_A = """a AS (SELECT user_id AS rec, event_id AS id, event_type AS label, epoch_us(ts) - 1704067200000000 AS s, epoch_us(ts) - 1704067200000000 + CAST(json_extract(props, '$.k') AS BIGINT) * 1800000000 AS e, value FROM events)"""


def _union(src: str, gap: int = 0, keys: str = "rec") -> str:
    return f"""(SELECT {keys}, min(s) AS s, max(e) AS e FROM (
        SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY s, e, id) AS part FROM (
            SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {keys} ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS n FROM {src}))
        GROUP BY {keys}, part)"""


_HOUR = 3600000000


@register("interval_union", f"WITH {_A} SELECT rec, s AS start, e AS \"end\" FROM {_union('a')}")
def interval_union(spark, sf_dir):
    """Unions per record."""
    return I.union_intervals(annotations(spark, sf_dir), ["rec"])


@register("interval_union_gap", f"WITH {_A} SELECT rec, s AS start, e AS \"end\" FROM {_union('a', _HOUR)}")
def interval_union_gap(spark, sf_dir):
    """Unions that bridge gaps of up to an hour."""
    return I.union_intervals(annotations(spark, sf_dir), ["rec"], gap=_HOUR)


@register("interval_length", f"WITH {_A} SELECT rec, CAST(sum(e - s) AS BIGINT) AS length FROM {_union('a')} GROUP BY rec")
def interval_length(spark, sf_dir):
    """Covered length per record."""
    return I.total_length(I.union_intervals(annotations(spark, sf_dir), ["rec"]), ["rec"])


@register("annotation_duration", f"WITH {_A} SELECT label, CAST(sum(e - s) AS BIGINT) AS length FROM a GROUP BY label")
def annotation_duration(spark, sf_dir):
    """Total duration by label, overlaps twice."""
    return I.total_length(annotations(spark, sf_dir), ["label"])


def _sides(spark, sf_dir):
    a = annotations(spark, sf_dir)
    return a.where("label = 'click'").select("rec", "start", "end", "id"), I.union_intervals(a.where("label = 'view'"), ["rec"])


_SIDES = f"{_A}, c AS (SELECT * FROM a WHERE label = 'click'), v AS (SELECT * FROM a WHERE label = 'view'), u AS {_union('v')}"


@register(
    "interval_minus",
    f"""WITH {_SIDES}, met AS (
    SELECT c.rec, c.id, c.s, c.e, u.s AS us, u.e AS ue FROM c LEFT JOIN u ON c.rec = u.rec AND (u.s < c.e AND u.e > c.s OR c.s = c.e AND u.s <= c.s AND u.e >= c.e)
), p AS (SELECT *, coalesce(lag(ue) OVER w, s) AS f, lead(us) OVER w IS NULL AS last FROM met WHERE us IS NOT NULL AND e > s WINDOW w AS (PARTITION BY id ORDER BY us))
SELECT rec, s AS start, e AS "end", id FROM met WHERE us IS NULL
UNION ALL SELECT rec, f, us, id FROM p WHERE us > f UNION ALL SELECT rec, ue, e, id FROM p WHERE last AND e > ue""",
)
def interval_minus(spark, sf_dir):
    """Clicks minus the union of views, remainders split."""
    clicks, views = _sides(spark, sf_dir)
    return I.subtract(clicks, views, ["rec"])


@register("interval_minus_drop", f"WITH {_SIDES} SELECT rec, s AS start, e AS \"end\", id FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.rec = c.rec AND (u.s < c.e AND u.e > c.s OR c.s = c.e AND u.s <= c.s AND u.e >= c.e))")
def interval_minus_drop(spark, sf_dir):
    """Clicks that the union of views leaves untouched (J13, drop)."""
    clicks, views = _sides(spark, sf_dir)
    return I.subtract(clicks, views, ["rec"], split=False)


@register("interval_keep_split", f"WITH {_SIDES} SELECT c.rec, greatest(c.s, u.s) AS start, least(c.e, u.e) AS \"end\", id FROM c JOIN u ON c.rec = u.rec AND c.s <= u.e AND c.e >= u.s WHERE least(c.e, u.e) > greatest(c.s, u.s) OR c.s = c.e")
def interval_keep_split(spark, sf_dir):
    """Clicks cut to the union of views (J12, split)."""
    clicks, views = _sides(spark, sf_dir)
    return I.keep_within(clicks, views, ["rec"])


@register("interval_keep_whole", f"WITH {_SIDES} SELECT c.rec, c.s AS start, c.e AS \"end\", id FROM c JOIN u ON c.rec = u.rec AND c.s >= u.s AND c.e <= u.e")
def interval_keep_whole(spark, sf_dir):
    """Clicks that the union of views covers (J12, drop)."""
    clicks, views = _sides(spark, sf_dir)
    return I.keep_within(clicks, views, ["rec"], split=False)


@register("drop_overlap_anti", f"WITH {_SIDES} SELECT rec, s AS start, e AS \"end\", id FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.rec = c.rec AND c.s <= v.e AND c.e >= v.s)")
def drop_overlap_anti(spark, sf_dir):
    """Clicks that touch no view, ends closed."""
    a = annotations(spark, sf_dir)
    clicks = a.where("label = 'click'").select("rec", "start", "end", "id")
    return I.drop_overlapping(clicks, a.where("label = 'view'"), ["rec"])


def _points(spark, sf_dir):
    return annotations(spark, sf_dir).where("label <> 'view'").select("rec", "id", F.col("start").alias("t"), "value")


@register("mask_points_keep", f"WITH {_SIDES} SELECT rec, id, s AS t FROM a WHERE label <> 'view' AND EXISTS (SELECT 1 FROM u WHERE u.rec = a.rec AND a.s BETWEEN u.s AND u.e)")
def mask_points_keep(spark, sf_dir):
    """Points inside the union."""
    return I.points_in(_points(spark, sf_dir), _sides(spark, sf_dir)[1], ["rec"]).select("rec", "id", "t")


@register("mask_points_drop", f"WITH {_SIDES} SELECT rec, id, s AS t FROM a WHERE label <> 'view' AND NOT EXISTS (SELECT 1 FROM u WHERE u.rec = a.rec AND a.s BETWEEN u.s AND u.e)")
def mask_points_drop(spark, sf_dir):
    """Points outside the union."""
    return I.points_in(_points(spark, sf_dir), _sides(spark, sf_dir)[1], ["rec"], inside=False).select("rec", "id", "t")


@register("range_join_bucketed", f"WITH {_SIDES} SELECT p.rec, p.id, CAST(count(*) AS BIGINT) AS n FROM a p JOIN v ON p.rec = v.rec AND p.s BETWEEN v.s AND v.e WHERE p.label <> 'view' GROUP BY ALL")
def range_join_bucketed(spark, sf_dir):
    """Views around each point, records dealt into day buckets."""
    views = annotations(spark, sf_dir).where("label = 'view'").select("rec", "start", "end")
    p = _points(spark, sf_dir)
    met = I.range_join(p, views, ["rec"], p["t"].between(views["start"], views["end"]), bucket=86400000000.0)
    return met.groupBy(p["rec"], p["id"]).agg(F.count("*").alias("n"))


@register("mask_by_radius", f"""WITH {_SIDES}, f(freq, radius) AS (VALUES (0, 0), (1, 600000000), (2, 7200000000)), p AS (SELECT rec, id, id % 3 AS freq, s AS t, value FROM a WHERE label <> 'view')
SELECT p.rec, p.id, p.freq, CASE WHEN NOT EXISTS (SELECT 1 FROM v WHERE v.rec = p.rec AND p.t BETWEEN v.s - f.radius AND v.e + f.radius) THEN p.value END AS value FROM p JOIN f USING (freq)""")
def mask_by_radius(spark, sf_dir):
    """Values nulled within a frequency's radius of an interval."""
    p = _points(spark, sf_dir).withColumn("freq", F.col("id") % 3)
    radii = spark.createDataFrame([(0, 0), (1, 600000000), (2, 7200000000)], "freq long, radius long")
    views = annotations(spark, sf_dir).where("label = 'view'")
    return I.mask_by_radius(p, views, radii, ["rec"]).select("rec", "id", "freq", "value")


@register("short_gaps_bad", f"WITH {_A}, u AS {_union('a')} SELECT rec, s AS start, e AS \"end\" FROM {_union('a', 7199999999)}")
def short_gaps_bad(spark, sf_dir):
    """Good stretches of under two hours between intervals become bad."""
    return I.short_gaps(annotations(spark, sf_dir), ["rec"], 2 * _HOUR)


_RUN = """r AS (SELECT l_orderkey AS k, l_linenumber AS p, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS isl FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"""


@register("index_runs", f"WITH {_RUN} SELECT k AS l_orderkey, min(p) AS first, max(p) AS last, count(*) AS n FROM r GROUP BY k, isl")
def index_runs(spark, sf_dir):
    """Consecutive line numbers as ranges."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return I.runs(li, ["l_orderkey"], "l_linenumber", F.lit(True))


@register("prune_runs", f"WITH {_RUN} SELECT k AS l_orderkey, p AS l_linenumber FROM r QUALIFY count(*) OVER (PARTITION BY k, isl) >= 3")
def prune_runs(spark, sf_dir):
    """Rows of runs of three or more."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return I.prune_runs(li, ["l_orderkey"], "l_linenumber", F.lit(True), 3)


@register("key_groups", f"""WITH {_A}, c AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS n FROM a WINDOW w AS (PARTITION BY rec ORDER BY s, id))
SELECT rec, id, CAST(sum(n) OVER (PARTITION BY rec ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM c""")
def key_groups(spark, sf_dir):
    """Runs of equal labels in order of time."""
    a = annotations(spark, sf_dir).withColumn("ord", F.struct("start", "id"))
    return I.key_groups(a, "ord", "label", ["rec"]).select("rec", "id", "group")


@register("edge_spans", f"WITH {_A}, b AS (SELECT rec, min(s) AS lo, max(s) AS hi FROM a GROUP BY rec) SELECT rec, lo AS start, least(lo + 60000000, hi) AS \"end\", 'EDGE' AS description FROM b UNION ALL SELECT rec, greatest(hi - 60000000, lo), hi, 'EDGE' FROM b")
def edge_spans(spark, sf_dir):
    """Head and tail spans of each record."""
    return I.edges(annotations(spark, sf_dir), ["rec"], "start", 60000000)


@register("remove_and_close", f"""WITH bad AS (SELECT l_orderkey AS k, l_linenumber AS s, l_linenumber + 1 AS e FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), x AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem)
SELECT x.k AS l_orderkey, x.i AS l_linenumber, CAST(x.i - (SELECT count(*) FROM bad b WHERE b.k = x.k AND b.s < x.i) AS BIGINT) AS new_idx FROM x WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.k = x.k AND b.s = x.i)""")
def remove_and_close(spark, sf_dir):
    """Bad samples removed and the rest renumbered."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_returnflag")
    bad = li.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"))
    return I.remove_and_close(I.dealt(li.select("l_orderkey", "l_linenumber"), ["l_orderkey"]).distinct(), bad, ["l_orderkey"], "l_linenumber")


@register("compress_annotations", f"""WITH {_SIDES} SELECT c.rec, c.id, CAST(c.s - coalesce((SELECT sum(greatest(0, least(c.s, u.e) - u.s)) FROM u WHERE u.rec = c.rec AND u.s < c.e), 0) AS BIGINT) AS start,
CAST(c.e - coalesce((SELECT sum(greatest(0, least(c.e, u.e) - u.s)) FROM u WHERE u.rec = c.rec AND u.s < c.e), 0) AS BIGINT) AS "end" FROM c""")
def compress_annotations(spark, sf_dir):
    """Annotations on the timeline that removal closes (W8, compress)."""
    clicks, views = _sides(spark, sf_dir)
    return I.compress_annotations(clicks, views, ["rec"]).select("rec", "id", "start", "end")


@register("split_bands", """WITH b AS (SELECT p_partkey AS band, CAST(p_size AS DOUBLE) AS s, p_size + 10.0 AS e FROM part), h(a, z) AS (VALUES (12.0, 13.0), (20.0, 22.5), (22.0, 24.0), (50.0, 51.0)), u(a, z) AS (VALUES (12.0, 13.0), (20.0, 24.0), (50.0, 51.0)),
met AS (SELECT b.*, u.a, u.z FROM b LEFT JOIN u ON u.a < b.e AND u.z > b.s), p AS (SELECT *, coalesce(lag(z) OVER w, s) AS f, lead(a) OVER w IS NULL AS last FROM met WHERE a IS NOT NULL WINDOW w AS (PARTITION BY band ORDER BY a))
SELECT band, CAST(s AS DOUBLE) AS start, CAST(e AS DOUBLE) AS "end" FROM met WHERE a IS NULL UNION ALL SELECT band, f, a FROM p WHERE a > f UNION ALL SELECT band, z, e FROM p WHERE last AND e > z""")
def split_bands(spark, sf_dir):
    """Bands without notch holes."""
    bands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("band"), F.col("p_size").cast("double").alias("start"), (F.col("p_size") + 10.0).alias("end"))
    holes = spark.createDataFrame([(12.0, 13.0), (20.0, 22.5), (22.0, 24.0), (50.0, 51.0)], "start double, end double")
    return I.split_bands(bands, holes).select("band", "start", "end")
