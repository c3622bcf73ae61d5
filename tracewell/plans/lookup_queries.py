"""Queries over names, pairs, axes and parameter rules."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import params
from tracewell.operators import align as E
from tracewell.operators import anatomy as A
from tracewell.operators import cells as C
from tracewell.operators import cohort as H
from tracewell.operators import packets as P
from tracewell.operators import spectral as G
from tracewell.operators import tensors as X
from tracewell.operators import transforms as T
from tracewell.plans.registry import register
from tracewell.plans.tables import annotations, rounded, table, traces

_CELL = "cell AS (SELECT vec_id AS row_id, label AS grp, CAST(unnest(range(len(embedding))) AS INTEGER) AS t_pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
_A = "a AS (SELECT user_id AS rec, event_id AS id, event_type AS label, epoch_us(ts) - 1704067200000000 AS s, epoch_us(ts) - 1704067200000000 + CAST(json_extract(props, '$.k') AS BIGINT) * 1800000000 AS e, value FROM events)"
_CHANNELS = "c AS (SELECT s_nationkey AS rec, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS channel, CAST(s_acctbal AS DOUBLE) AS x, s_suppkey % 3 = 0 AS m_in, s_suppkey % 2 = 0 AS n_in, s_suppkey AS pos, s_suppkey % 2 AS grp FROM supplier)"


def _channels(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("rec"), F.lpad(k.cast("string"), 6, "0").alias("channel"), F.col("s_acctbal").cast("double").alias("x"), (k % 3 == 0).alias("m_in"), (k % 2 == 0).alias("n_in"), k.alias("pos"), (k % 2).alias("grp"))


@register("pairs_ordered", f"""WITH {_CHANNELS} SELECT a.rec, a.channel AS a, b.channel AS b, a.x AS x_a, b.x AS x_b, a.m_in AND b.n_in AS "M-N_in" FROM c a JOIN c b ON a.rec = b.rec AND a.channel <> b.channel""")
def pairs_ordered(spark, sf_dir):
    """Ordered channel pairs of a record with coordinates and membership."""
    return A.ordered_pairs(_channels(spark, sf_dir).select("rec", "channel", "x", F.col("m_in").alias("M_in"), F.col("n_in").alias("N_in")), ["rec"], [("M", "N")])


@register("pairs_unordered", f"""WITH {_CHANNELS} SELECT a.rec, a.channel AS a, b.channel AS b, a.x AS x_a, b.x AS x_b, a.m_in AND b.n_in OR a.n_in AND b.m_in AS "M-N_in" FROM c a JOIN c b ON a.rec = b.rec AND a.channel < b.channel""")
def pairs_unordered(spark, sf_dir):
    """Unordered channel pairs, membership either way round."""
    return A.unordered_pairs(_channels(spark, sf_dir).select("rec", "channel", "x", F.col("m_in").alias("M_in"), F.col("n_in").alias("N_in")), ["rec"], [("M", "N")])


@register("pairs_in_groups", f"WITH {_CHANNELS} SELECT a.rec, a.grp, a.channel AS a, b.channel AS b FROM c a JOIN c b ON a.rec = b.rec AND a.grp = b.grp AND a.pos <> b.pos")
def pairs_in_groups(spark, sf_dir):
    """Ordered pairs within the groups of a record."""
    return A.resolve_pairs(_channels(spark, sf_dir).select("rec", "channel", "pos", "grp"), ["rec"], group="grp", ordered=True)


@register("pairs_cleaned", f"""WITH {_CHANNELS}, p AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS a, lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS b FROM lineitem)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM p WHERE a <> b AND a IN (SELECT channel FROM c) AND b IN (SELECT channel FROM c)""")
def pairs_cleaned(spark, sf_dir):
    """Listed pairs, trimmed, known and once each."""
    pad = lambda c, side: F.concat(F.lit(" " if side else ""), F.lpad(F.col(c).cast("string"), 6, "0"), F.lit(" "))
    p = table(spark, sf_dir, "lineitem").select(pad("l_suppkey", True).alias("a"), pad("l_partkey", False).alias("b"))
    return A.resolve_pairs(_channels(spark, sf_dir), ["rec"], pairs=p)


@register("contact_points", f"""WITH {_CHANNELS}, n AS (SELECT *, lead(channel) OVER (PARTITION BY rec ORDER BY pos) AS nxt, lead(x) OVER (PARTITION BY rec ORDER BY pos) AS nx, pos % 5 = 0 AS alone FROM c)
SELECT rec, channel AS anode, CASE WHEN alone THEN 'Case' ELSE nxt END AS cathode, CASE WHEN NOT alone THEN (x + nx) / 2 END AS x, CASE WHEN NOT alone THEN (-x - nx) / 2 END AS y, CASE WHEN NOT alone AND nxt IS NOT NULL THEN 1.0 END AS z FROM n""")
def contact_points(spark, sf_dir):
    """Coordinates halfway between both contacts of a channel, none beside a case."""
    c = _channels(spark, sf_dir)
    after = F.lead("channel").over(Window.partitionBy("rec").orderBy("pos"))
    wanted = c.select("rec", F.col("channel").alias("anode"), F.when(F.col("pos") % 5 == 0, "Case").otherwise(after).alias("cathode"))
    return A.contact_coordinates(wanted, c.select("rec", F.col("channel").alias("contact"), "x", (-F.col("x")).alias("y"), F.lit(1.0).alias("z")), ["rec"])


@register("contact_steps", f"WITH {_CHANNELS} SELECT rec, channel, (x + nx) / 2 AS x_mid, (y + ny) / 2 AS y_mid FROM (SELECT rec, channel, x, x * 2 AS y, lead(x) OVER w AS nx, lead(x * 2) OVER w AS ny FROM c WINDOW w AS (PARTITION BY rec ORDER BY pos)) WHERE nx IS NOT NULL")
def contact_steps(spark, sf_dir):
    """Midpoints of successive contacts."""
    c = _channels(spark, sf_dir).select("rec", "channel", "pos", "x", (F.col("x") * 2).alias("y"), F.lit(0.0).alias("z"))
    return A.contact_midpoints(c, ["rec"], "pos").select("rec", "channel", "x_mid", "y_mid")


@register("net_values", """WITH f AS (SELECT l_returnflag AS rec, l_suppkey % 7 AS a, l_partkey % 7 AS b, avg(l_quantity) AS v, avg(l_discount) AS r FROM lineitem GROUP BY ALL)
SELECT x.rec, x.a, x.b, round((x.v - y.v) - (x.r - y.r), 6) + 0.0 AS value FROM f x LEFT JOIN f y ON x.rec = y.rec AND x.a = y.b AND x.b = y.a""")
def net_values(spark, sf_dir):
    """Net of both directions less that of the reversed scores."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("rec"), (F.col("l_suppkey") % 7).alias("a"), (F.col("l_partkey") % 7).alias("b")).agg(F.avg("l_quantity").cast("double").alias("v"), F.avg("l_discount").cast("double").alias("r"))
    return rounded(A.net_difference(f.select("rec", "a", "b", F.col("v").alias("value")), f.select("rec", "a", "b", F.col("r").alias("value")), ["rec"]), "value")


@register("run_timeline", f"WITH {_A}, t AS (SELECT rec, id, s, CAST(round_even((s - min(s) OVER (PARTITION BY rec)) * (1 / 3600.0::DOUBLE) / 1e6, 0) AS BIGINT) AS start_sample FROM a) SELECT rec, id, start_sample, start_sample - coalesce(lag(start_sample) OVER (PARTITION BY rec ORDER BY s), 0) AS gap FROM t")
def run_timeline(spark, sf_dir):
    """Start samples of runs from their clocks, and the gaps before them."""
    runs = annotations(spark, sf_dir).select("rec", "id", F.col("start").alias("us"), F.lit(0).alias("n"))
    return P.run_timeline(runs, ["rec"], "us", "n", 1 / 3600.0).select("rec", "id", "start_sample", "gap")


@register("tag_places", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, least(19, CAST(ceil(l_partkey % 100 * 250.0::DOUBLE / 1000) AS BIGINT) - 1)) AS place, CASE l_linenumber % 3 WHEN 0 THEN l_suppkey WHEN 1 THEN l_suppkey END AS code FROM lineitem")
def tag_places(spark, sf_dir):
    """Places of tags within a packet's block; codes in hex or decimal."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("0x"), F.hex(k))).when(F.col("l_linenumber") % 3 == 1, k.cast("string")).otherwise("none")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", P.tag_position(F.col("l_partkey") % 100, F.col("l_partkey") % 100, 250.0, 20).cast("long").alias("place"), P.tag_code(text).alias("code"))


@register("utc_times", "SELECT event_id, epoch_us(ts) - 28800000000 AS us FROM events")
def utc_times(spark, sf_dir):
    """Local clocks of one zone in UTC (F32)."""
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(P.local_to_utc(F.col("ts").cast("timestamp"))).alias("us"))


@register("synced_events", f"WITH {_A} SELECT rec, id, (s / 1e6 + 3.5) * 1.25 AS t FROM a WHERE (s / 1e6 + 3.5) * 1.25 BETWEEN 0 AND 2000000")
def synced_events(spark, sf_dir):
    """Times shifted and rescaled to another clock, inside the record."""
    ev = annotations(spark, sf_dir).select("rec", "id", (F.col("start") / 1e6).alias("t"))
    return P.apply_sync(ev, 3.5, 1.25, 2000000)


@register("transform_modes", """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 10 * log10(l_extendedprice) WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN ln(l_extendedprice) ELSE asinh(l_extendedprice) END, 6) + 0.0 AS value FROM lineitem""")
def transform_modes(spark, sf_dir):
    """Each metric's and reducer's own transform."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("reducer"), F.col("l_extendedprice").cast("double").alias("value"))
    return rounded(T.transform_by(li, {("A", "F"): "db", ("N", "O"): "log"}, "asinh"), "value").drop("metric", "reducer")


@register("label_groups", f"WITH {_CELL} SELECT row_id, well, count(*) AS n, round(avg(value), 6) + 0.0 AS value FROM cell JOIN (VALUES ('a', 3), ('a', 4), ('b', 4), ('b', 60)) g(well, p) ON t_pos = p GROUP BY row_id, well")
def label_groups(spark, sf_dir):
    """Means over groups of labels, by text or by close numbers."""
    c = traces(spark, sf_dir).withColumn("f_label", F.when(F.col("t_pos") % 2 == 0, F.format_number(F.col("t_pos").cast("double"), 1)).otherwise(F.col("t_pos").cast("string")))
    groups = spark.createDataFrame([("a", "3"), ("a", "4"), ("b", "4.0"), ("b", "60")], "well string, label string")
    met = C.select_labels(c, groups, "f_label", "t_coord")
    return rounded(met.groupBy("row_id", "well").agg(F.count("*").alias("n"), F.avg("value").alias("value")), "value")


@register("bands_of_data", f"WITH {_CELL} SELECT DISTINCT 'f' || (t_pos // 4) AS band FROM cell")
def bands_of_data(spark, sf_dir):
    """Row labels of the data as bands."""
    return C.auto_bands(traces(spark, sf_dir).withColumn("f_label", F.concat(F.lit("f"), F.floor(F.col("t_pos") / 4).cast("string"))))


@register("shifted_axis", f"WITH {_CELL} SELECT row_id, t_pos - 10.5::DOUBLE AS t_coord, CASE t_pos % 3 WHEN 0 THEN 'low' ELSE 'f' || (t_pos % 3) END AS f_label FROM cell")
def shifted_axis(spark, sf_dir):
    """Axis moved and labels renamed for display."""
    c = traces(spark, sf_dir).withColumn("f_label", F.concat(F.lit("f"), (F.col("t_pos") % 3).cast("string")))
    return C.shift_axis(c, 10.5, {"f0": "low"}).select("row_id", "t_coord", "f_label")


@register("grid_rules", f"""WITH g AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS freq FROM part), c AS (SELECT freq, least(8, greatest(2, freq / 4)) AS c, greatest(1, freq / 4) AS m FROM g)
SELECT freq, c AS cycles, m AS cycles_mt, round(5 * c / (2 * {math.pi!r} * freq), 9) AS radius, round(m / freq / 2, 9) AS radius_mt, CAST(ceil(10 * c / (2 * {math.pi!r} * freq) * 250) + 2 AS INTEGER) AS samples FROM c""")
def grid_rules(spark, sf_dir):
    """Cycles, edge radii and window lengths of a frequency grid."""
    f = F.col("freq")
    g = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("freq")).distinct()
    g = g.withColumns({"cycles": X.cycles(f, 4.0, high=8.0), "cycles_mt": X.cycles(f, 4.0, "multitaper")})
    return g.select("freq", "cycles", "cycles_mt", F.round(X.mask_radius(f, F.col("cycles")), 9).alias("radius"), F.round(X.mask_radius(f, F.col("cycles_mt"), "multitaper"), 9).alias("radius_mt"), X.window_samples(f, F.col("cycles"), 250.0).alias("samples"))


@register("facet_choices", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL")
def facet_choices(spark, sf_dir):
    """Values of a facet that occur with another's choice."""
    return params.facet_values(table(spark, sf_dir, "orders"), "o_orderpriority", o_orderstatus="F")


@register("best_steps", "SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS step FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def best_steps(spark, sf_dir):
    """The completed step of highest priority of each record."""
    steps = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("priority"), (F.col("o_orderstatus") != "F").alias("done"))
    return params.best_step(steps, ["o_custkey"])


@register("requests_missing", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def requests_missing(spark, sf_dir):
    """Requested rows that were not found."""
    found = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).distinct()
    return params.missing_requests(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), found)


@register("baseline_choices", f"WITH {_A} SELECT DISTINCT label || (id % 4) AS description FROM a WHERE e > s")
def baseline_choices(spark, sf_dir):
    """Labels of positive duration."""
    a = annotations(spark, sf_dir)
    return params.baseline_labels(a.select(F.concat("label", (F.col("id") % 4).cast("string")).alias("description"), (F.col("end") - F.col("start")).alias("duration_s")))


@register("phase_overrides", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'Rest' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'Turn' ELSE 'Walk' END AS phase FROM orders")
def phase_overrides(spark, sf_dir):
    """Phases replaced by analysis and trial."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("analysis"), F.col("o_orderpriority").alias("trial"), F.lit("Walk").alias("phase"))
    rules = spark.createDataFrame([("F", "5-LOW", "Rest"), ("O", "1-URGENT", "Turn")], "analysis string, trial string, phase string")
    return H.override_phase(df, rules).select("o_orderkey", "phase")


@register("epoch_axes", f"""WITH {_CELL}, d AS (SELECT row_id, sum(abs(value)) AS dur FROM cell GROUP BY row_id)
SELECT row_id, t_pos AS pos, round(CASE WHEN grp % 3 = 0 THEN t_pos / 63 * 100 WHEN grp % 3 = 1 THEN t_pos / 63 * dur ELSE t_pos / 63 * 100 END, 6) + 0.0 AS t, t_pos IN (2, 5) AS pick FROM cell JOIN d USING (row_id)""")
def epoch_axes(spark, sf_dir):
    """Time axes of aligned positions: percent, or seconds of a representative duration; picked epochs."""
    c = traces(spark, sf_dir).select("row_id", "grp", F.col("t_pos").alias("pos"), "value")
    d = c.groupBy("row_id").agg(F.sum(F.abs("value")).alias("duration"))
    out = E.time_axes(c, d, ["row_id"], 64)
    method = F.when(F.col("grp") % 3 == 0, "linear").when(F.col("grp") % 3 == 1, "pad").otherwise("stack")
    out = rounded(out.withColumn("t", E.axis_of(method)), "t").withColumn("epoch", F.col("pos"))
    return E.pick_epochs(out, [2, 5, -1]).select("row_id", "pos", "t", "pick")


@register("level_order", "SELECT l.level, CAST(l.rank AS INTEGER) AS rank, round(avg(o_totalprice), 6) + 0.0 AS mean FROM (VALUES ('F', 2), ('X', 0), ('O', 1)) l(level, rank) LEFT JOIN orders ON o_orderstatus = level GROUP BY ALL")
def level_order(spark, sf_dir):
    """Means of the levels asked for, in their order, absent ones without."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("level"), F.col("o_totalprice").cast("double").alias("value"))
    return rounded(T.level_means(df, "level", spark.createDataFrame([("F", 2), ("X", 0), ("O", 1)], "level string, rank int")), "mean")


@register("epoch_coherence", f"""WITH {_CELL}, z AS (SELECT grp, t_pos // 2 AS f, row_id, max(value) FILTER (t_pos % 2 = 0) AS re, max(value) FILTER (t_pos % 2 = 1) AS im FROM cell GROUP BY ALL)
SELECT grp, CAST(f AS INTEGER) AS f, round(avg(re * re + im * im), 6) + 0.0 AS power, round(sqrt(avg(re / sqrt(re * re + im * im)) ** 2 + avg(im / sqrt(re * re + im * im)) ** 2), 6) + 0.0 AS itc FROM z GROUP BY grp, f""")
def epoch_coherence(spark, sf_dir):
    """Mean power over epochs and inter-trial coherence."""
    part = lambda k: F.max(F.when(F.col("t_pos") % 2 == k, F.col("value")))
    z = traces(spark, sf_dir).groupBy("grp", F.floor(F.col("t_pos") / 2).cast("int").alias("f"), "row_id").agg(part(0).alias("re"), part(1).alias("im"))
    z = z.withColumn("power", F.col("re") ** 2 + F.col("im") ** 2)
    return rounded(G.average_epochs(z, ["grp", "f"]), "power", "itc")


@register("cohort_merge", """WITH w(name, record, trial) AS (VALUES ('first', 'R_F', '1-urgent'), ('second', 'r-o', '5-LOW '), ('lost', 'zz', '5-LOW'))
SELECT name, o_custkey AS subject, CAST(o_totalprice AS DOUBLE) AS value FROM w JOIN orders ON replace(lower(record), '_', '-') = 'r-' || lower(o_orderstatus) AND lower(trim(trial)) = lower(o_orderpriority) WHERE o_orderkey % 5 <> 0""")
def cohort_merge(spark, sf_dir):
    """Named tables of all subjects as one, names matched without case, blanks and signs, missing values dropped."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("R_"), "o_orderstatus").alias("record"), F.col("o_orderpriority").alias("trial"), F.col("o_custkey").alias("subject"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("double")).alias("value"))
    wanted = spark.createDataFrame([("first", "R_F", "1-urgent"), ("second", "r-o", "5-LOW "), ("lost", "zz", "5-LOW")], "name string, record string, trial string")
    return H.merge_cohort(wanted, o, ["subject", "value"])


@register("annotation_sets", f"WITH {_A} SELECT label, s AS start, e AS \"end\", CASE WHEN id % 2 = 0 THEN 'file' ELSE 'gap' END AS origin, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'EDGE', min(s), min(s), 'edge', 1 FROM a GROUP BY rec")
def annotation_sets(spark, sf_dir):
    """Annotations of several origins as one multiset."""
    a = annotations(spark, sf_dir)
    parts = [a.where("id % 2 = 0").select("label", "start", "end", F.lit("file").alias("origin")), a.where("id % 2 <> 0").select("end", "start", "label", F.lit("gap").alias("origin"))]
    counted = reduce(DataFrame.unionByName, parts).groupBy("label", "start", "end", "origin").agg(F.count("*").alias("n"))
    edge = a.groupBy("rec").agg(F.min("start").alias("start")).select(F.lit("EDGE").alias("label"), "start", F.col("start").alias("end"), F.lit("edge").alias("origin"), F.lit(1).cast("long").alias("n"))
    return counted.unionByName(edge)
