"""Queries of packet repair, synchronisation, cohort tables and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import cohort as H
from tracewell.operators import packets as P
from tracewell.operators import statistics as S
from tracewell.operators import transforms as T
from tracewell.operators.ordering import Ordered, numbered
from tracewell.plans.registry import register
from tracewell.plans.tables import annotations, rounded, table, traces

_CELL = """cell AS (SELECT vec_id AS row_id, label AS grp, CAST(unnest(range(len(embedding))) AS INTEGER) AS t_pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
_E = """e AS (SELECT user_id AS rec, event_id AS id, event_type AS label, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value FROM events)"""


def _events(spark, sf_dir):
    return annotations(spark, sf_dir).select("rec", "id", "label", (F.col("start") / 1e6).alias("t"), "value")


@register("packet_dup_drop", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def packet_dup_drop(spark, sf_dir):
    """Packets whose index occurs once."""
    return P.drop_duplicated(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_linenumber")


_GAPS = "g AS (SELECT k, p + 1 AS a, n - 1 AS z FROM (SELECT l_orderkey AS k, l_linenumber AS p, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE n - 1 >= p + 1)"


@register("packet_gaps", f"WITH {_GAPS} SELECT k AS l_orderkey, a AS first, z AS last, z - a + 1 AS n FROM g")
def packet_gaps(spark, sf_dir):
    """Missing index ranges."""
    return P.missing_ranges(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey"], "l_linenumber")


@register("packet_fill", f"WITH {_GAPS}, d AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1), h AS (SELECT k, unnest(range(p + 1, n)) AS i FROM (SELECT l_orderkey AS k, l_linenumber AS p, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM d)) SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, false AS filled FROM d UNION ALL SELECT k, CAST(i AS INTEGER), 0.0, true FROM h")
def packet_fill(spark, sf_dir):
    """Duplicated packets dropped, then all missing ones zero-filled."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    return P.fill_missing(P.drop_duplicated(li, ["l_orderkey"], "l_linenumber"), ["l_orderkey"], "l_linenumber", "l_quantity")


@register("packet_gap_spans", f"WITH {_GAPS} SELECT k AS l_orderkey, a * 0.5 AS start, (z + 1) * 0.5 AS \"end\", 'BAD_gap' AS description FROM g")
def packet_gap_spans(spark, sf_dir):
    """Gap annotations in seconds."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return P.gap_annotations(P.missing_ranges(li, ["l_orderkey"], "l_linenumber"), ["l_orderkey"], 0.5)


@register("packet_mode_length", "SELECT l_orderkey, arg_max(q, n * 1000 + q) AS mode_length FROM (SELECT l_orderkey, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def packet_mode_length(spark, sf_dir):
    """Most frequent length, ties to the longer."""
    return P.mode_length(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity")


@register("packet_cursor", """WITH d AS (SELECT l_orderkey AS k, l_linenumber AS p, l_quantity AS len FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1),
m AS (SELECT k, arg_max(len, n * 1000 + len) AS mode FROM (SELECT k, len, count(*) AS n FROM d GROUP BY ALL) GROUP BY k), x AS (SELECT d.*, mode, p - coalesce(lag(p) OVER w + 1, 1) AS lost FROM d JOIN m USING (k) WINDOW w AS (PARTITION BY k ORDER BY p))
SELECT k AS l_orderkey, p AS l_linenumber, lost, CAST(coalesce(sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(lost * mode) OVER w AS DOUBLE) AS start_sample FROM x WINDOW w AS (PARTITION BY k ORDER BY p)""")
def packet_cursor(spark, sf_dir):
    """Start samples when missing packets take the mode length."""
    li = P.drop_duplicated(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")
    return P.sample_cursor(li, ["l_orderkey"], "l_linenumber", "l_quantity", 1).select("l_orderkey", "l_linenumber", "lost", F.col("start_sample").cast("double").alias("start_sample"))


@register("packet_check", """WITH c AS (SELECT o_custkey AS k, month(o_orderdate) AS p, count(*) AS n, min(o_orderdate) AS lo FROM orders GROUP BY ALL) SELECT k, p AS packet, 'row count' AS fault FROM c WHERE n <> 2""")
def packet_check(spark, sf_dir):
    """Packets whose rows are not as many as declared."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.month("o_orderdate").alias("packet"), F.lit(2).alias("declared"))
    return P.check_packets(o.withColumn("ord", F.col("packet")), ["k"], "packet", "ord", "declared")


@register("sync_median_lag", f"WITH {_E}, p AS (SELECT rec, t + 12.5 + (id % 7) * 0.25 AS a, t AS b FROM e), l AS (SELECT *, median(a - b) OVER (PARTITION BY rec) AS lag FROM p) SELECT rec, round(any_value(lag), 6) AS lag, round(sqrt(avg((a - b - lag) ** 2)), 6) AS rmse, count(*) AS n FROM l GROUP BY rec")
def sync_median_lag(spark, sf_dir):
    """Median lag of marker pairs."""
    pairs = _events(spark, sf_dir).select("rec", (F.col("t") + 12.5 + (F.col("id") % 7) * 0.25).alias("ref_s"), F.col("t").alias("ext_s"))
    return rounded(P.median_lag(pairs, ["rec"]), "lag", "rmse")


@register("sync_rate_fit", f"WITH {_E}, p AS (SELECT rec, (t + 3) * 250 + (id % 5) AS s, t FROM e WHERE rec IN (SELECT rec FROM e GROUP BY rec HAVING count(DISTINCT t) > 1)) SELECT rec, round(regr_slope(s, t), 4) AS rate, round(regr_intercept(s, t) / regr_slope(s, t), 4) AS lag, round(greatest(0, regr_r2(s, t)), 6) AS r2, count(*) AS n FROM p GROUP BY rec")
def sync_rate_fit(spark, sf_dir):
    """Rate and lag by least squares."""
    e = _events(spark, sf_dir)
    many = e.groupBy("rec").agg(F.countDistinct("t").alias("k")).where("k > 1")
    pairs = e.join(many, "rec", "left_semi").select("rec", ((F.col("t") + 3) * 250 + F.col("id") % 5).alias("sample_idx"), F.col("t").alias("ext_s"))
    return P.rate_fit(pairs, ["rec"]).withColumns({"rate": F.round("rate", 4), "lag": F.round("lag", 4), "r2": F.round("r2", 6)})


@register("sampling_rate", f"WITH {_E}, d AS (SELECT rec, t - lag(t) OVER (PARTITION BY rec ORDER BY t) AS s FROM e) SELECT rec, round(1 / median(s), 8) AS rate FROM d WHERE s > 0 GROUP BY rec")
def sampling_rate(spark, sf_dir):
    """1 / median positive step."""
    return P.sampling_rate(_events(spark, sf_dir), ["rec"], "t").withColumn("rate", F.round("rate", 8))


@register("window_p2p_bad", f"WITH {_E}, p AS (SELECT rec, label, CAST(floor(t / 86400) AS BIGINT) AS win, max(value) - min(value) AS p2p FROM e GROUP BY ALL) SELECT rec, win, bool_or(p2p < 1 OR p2p > 80) AS bad, round(max(p2p), 6) AS p2p FROM p GROUP BY ALL")
def window_p2p_bad(spark, sf_dir):
    """Peak-to-peak test by window, any channel."""
    return rounded(P.window_range(_events(spark, sf_dir), ["rec"], "t", 86400, 1, 80, channel="label"), "p2p")


@register("robust_p2p", f"WITH {_E}, p AS (SELECT rec, label, CAST(floor(t / 86400) AS BIGINT) AS win, max(value) - min(value) AS p2p FROM e GROUP BY ALL), m AS (SELECT *, median(p2p) OVER (PARTITION BY label) AS m FROM p), d AS (SELECT *, median(abs(p2p - m)) OVER (PARTITION BY label) AS mad FROM m) SELECT rec, label, win, round(p2p, 6) AS p2p, p2p > m + 3.0 * 1.4826 * mad AS bad FROM d")
def robust_p2p(spark, sf_dir):
    """Windows far above their channel's median range."""
    p = _events(spark, sf_dir).groupBy("rec", "label", F.floor(F.col("t") / 86400).alias("win")).agg((F.max("value") - F.min("value")).alias("p2p"))
    return rounded(P.robust_cut(p, ["label"]), "p2p")


@register("reref_difference", f"WITH {_CELL} SELECT concat_ws('-', a.row_id, b.row_id) AS channel, a.t_pos, round(a.value - b.value, 6) + 0.0 AS value FROM cell a JOIN cell b ON b.row_id = a.row_id + 1 AND a.t_pos = b.t_pos WHERE a.row_id % 4 = 0")
def reref_difference(spark, sf_dir):
    """Bipolar differences of neighbouring channels."""
    x = traces(spark, sf_dir).select(F.lit(1).alias("rec"), F.col("row_id").cast("string").alias("channel"), "t_pos", "value")
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    pairs = ids.where("vec_id % 4 = 0").select(P.bipolar_name(F.col("vec_id").cast("string"), (F.col("vec_id") + 1).cast("string")).alias("name"), F.col("vec_id").cast("string").alias("anode"), (F.col("vec_id") + 1).cast("string").alias("cathode"))
    return rounded(P.rereference(x, pairs, ["rec"], "t_pos").select("channel", "t_pos", "value"), "value")


@register("reref_difference_all", f"WITH {_CELL} SELECT concat_ws('-', a.row_id, b.row_id) AS channel, a.t_pos, round(a.value - b.value, 6) + 0.0 AS value FROM cell a JOIN cell b ON b.row_id = a.row_id + 1 AND a.t_pos = b.t_pos")
def reref_difference_all(spark, sf_dir):
    """Bipolar differences of all neighbouring channels."""
    x = traces(spark, sf_dir).select(F.lit(1).alias("rec"), F.col("row_id").cast("string").alias("channel"), "t_pos", "value")
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    pairs = ids.select(P.bipolar_name(F.col("vec_id").cast("string"), (F.col("vec_id") + 1).cast("string")).alias("name"), F.col("vec_id").cast("string").alias("anode"), (F.col("vec_id") + 1).cast("string").alias("cathode"))
    return rounded(P.rereference(x, pairs, ["rec"], "t_pos").select("channel", "t_pos", "value"), "value")


@register("seed_markers", f"WITH {_E} SELECT rec, id, label, row_number() OVER (PARTITION BY rec ORDER BY t, label, id) - 1 AS number FROM e WHERE NOT starts_with(label, 'BAD_')")
def seed_markers(spark, sf_dir):
    """Numbered markers."""
    out = P.seed_markers(_events(spark, sf_dir).withColumn("ord", F.struct("t", "label", "id")), ["rec"], "ord", "label")
    return out.select("rec", "id", "label", F.col("number").cast("long").alias("number"))


@register("region_membership_flags", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'SNr' WHEN quality = 0 AND toxic = 1 THEN 'STN' END AS single, CASE WHEN quality = 1 AND toxic = 1 THEN 'Mid' WHEN quality = 1 THEN 'SNr' WHEN toxic = 1 THEN 'STN' ELSE 'EXT' END AS label FROM labels")
def region_membership_flags(spark, sf_dir):
    """Regions from two flags."""
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf_dir, "labels").select("doc_id", H.region_single(a, b).alias("single"), H.region_label(a, b).alias("label"))


@register("phase_parse", "SELECT o_orderkey, upper(substr(lower(o_orderpriority), 1, 1)) || substr(lower(o_orderpriority), 2) AS phase, CASE WHEN s = o_orderstatus THEN 'Ipsi' ELSE 'Contra' END AS lat FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'L' ELSE 'R' END AS s, 'L' AS x FROM orders) t(o_orderkey, o_custkey, o_orderstatus0, o_totalprice, o_orderdate, o_orderpriority, s, x), (SELECT 'L' AS o_orderstatus) z")
def phase_parse(spark, sf_dir):
    """Phase names and laterality from suffixed labels."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("_", F.lower("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "L").otherwise("R")).alias("p"))
    phase, lat = H.parse_phase(F.col("p"), F.lit("L"))
    return o.select("o_orderkey", phase.alias("phase"), lat.alias("lat"))


@register("name_token_match", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_name <> 'FRANCE'")
def name_token_match(spark, sf_dir):
    """Rows matched by case-folded names."""
    n = table(spark, sf_dir, "nation")
    inv = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lower("n_name"), F.lit("_x")).alias("record"), F.lit("T").alias("trial"))
    wanted = n.where("n_name <> 'FRANCE'").select("n_name", F.concat(F.lit(" "), "n_name", F.lit("-X")).alias("record"), F.lit("t").alias("trial"))
    return H.match_names(wanted, inv)[0].select("c_custkey", "n_name")


@register("inventory_review", "SELECT l_shipmode AS record, l_linestatus AS trial, count(DISTINCT l_suppkey) AS n_subjects, count(*) AS n_files FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) GROUP BY ALL")
def inventory_review(spark, sf_dir):
    """Subjects and files by record and trial."""
    return H.inventory_review(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("record"), F.col("l_linestatus").alias("trial"), F.col("l_suppkey").alias("subject")))


@register("trace_inventory", f"WITH {_CELL} SELECT grp, count(DISTINCT row_id % 50) AS n_subjects, count(DISTINCT row_id) AS n_channels, count(DISTINCT t_pos) AS n_times, count(*) AS n_rows, count(*) / count(DISTINCT row_id) AS rows_per_trace FROM cell GROUP BY ALL")
def trace_inventory(spark, sf_dir):
    """Inventory per parameter set."""
    t = traces(spark, sf_dir).withColumns({"subject": F.col("row_id") % 50, "channel": F.col("row_id")})
    return H.trace_inventory(t, ["grp"])


@register("halfcycle_shift", f"WITH {_CELL} SELECT row_id, CAST(CASE WHEN grp % 2 = 0 THEN (t_pos + 32) % 64 ELSE t_pos END AS INTEGER) AS t_pos, 'Contra' AS lat, round(value, 6) + 0.0 AS value FROM cell")
def halfcycle_shift(spark, sf_dir):
    """Ipsi traces shifted by half a cycle."""
    t = traces(spark, sf_dir).withColumn("lat", F.when(F.col("grp") % 2 == 0, "Ipsi").otherwise("Contra"))
    return rounded(H.half_cycle_shift(t, ["row_id"]).select("row_id", "t_pos", "lat", "value"), "value")


@register("block_downsample", f"WITH {_CELL} SELECT row_id, CAST(t_pos // 4 AS INTEGER) AS t_pos, round(avg(value), 6) + 0.0 AS value, (t_pos // 4 + 0.5) * 400 / 64 AS t_pct FROM cell GROUP BY ALL")
def block_downsample(spark, sf_dir):
    """Block means with percent centres."""
    return rounded(H.block_downsample(traces(spark, sf_dir).select("row_id", "t_pos", "value"), ["row_id"], 4), "value")


@register("circular_fill", f"""WITH {_CELL}, g AS (SELECT row_id, t_pos, CASE WHEN value > 0.02 THEN value END AS v FROM cell WHERE row_id IN (SELECT row_id FROM cell GROUP BY row_id HAVING max(value) > 0.02)),
k AS (SELECT row_id, t_pos + c * 64 AS p, v FROM g, (VALUES (-1), (0), (1)) x(c) WHERE v IS NOT NULL)
SELECT g.row_id, g.t_pos, round(CASE WHEN g.v IS NOT NULL THEN g.v ELSE lo.v + (hi.v - lo.v) * (g.t_pos - lo.p) / (hi.p - lo.p) END, 6) + 0.0 AS value FROM g ASOF JOIN k lo ON g.row_id = lo.row_id AND g.t_pos >= lo.p ASOF JOIN k hi ON g.row_id = hi.row_id AND g.t_pos <= hi.p""")
def circular_fill(spark, sf_dir):
    """Gaps of cyclic traces filled around the circle."""
    t = traces(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0.02, F.col("value"))).select("row_id", "t_pos", "value")
    some = t.groupBy("row_id").agg(F.count("value").alias("n")).where("n > 0")
    return rounded(H.circular_fill(t.join(some, "row_id", "left_semi"), ["row_id"]), "value")


@register("circular_lowess")
def circular_lowess(spark, sf_dir):
    """Cyclic local regression (W11); tested against a plain loop."""
    t = traces(spark, sf_dir).select("row_id", "t_pos", "value")
    return rounded(H.circular_lowess(t, ["row_id"], 0.05), "value", "smooth")


@register("p_adjust_bh", """WITH p AS (SELECT o_orderkey, o_orderpriority, ((o_orderkey * 7919) % 10007) / 10007.0 AS p FROM orders), r AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p) AS r FROM p)
SELECT o_orderkey, round(least(1.0, min(p * n / r) OVER (PARTITION BY o_orderpriority ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS p_adj FROM r""")
def p_adjust_bh(spark, sf_dir):
    """Benjamini-Hochberg by group."""
    return S.adjust(_pvalues(spark, sf_dir), by=["o_orderpriority"]).select("o_orderkey", F.round("p_adj", 9).alias("p_adj"))


def _pvalues(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (((F.col("o_orderkey") * 7919) % 10007) / 10007.0).alias("p"))


@register("p_adjust_holm", """WITH p AS (SELECT o_orderkey, o_orderpriority, ((o_orderkey * 7919) % 10007) / 10007.0 AS p FROM orders), r AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p) AS r FROM p)
SELECT o_orderkey, round(least(1.0, max(p * (n - r + 1)) OVER (PARTITION BY o_orderpriority ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS p_adj FROM r""")
def p_adjust_holm(spark, sf_dir):
    """Holm by group."""
    return S.adjust(_pvalues(spark, sf_dir), by=["o_orderpriority"], method="holm").select("o_orderkey", F.round("p_adj", 9).alias("p_adj"))


@register("p_stars", "SELECT o_orderkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT o_orderkey, ((o_orderkey * 7919) % 10007) / 10007.0 AS p FROM orders)")
def p_stars(spark, sf_dir):
    """Stars of p-values."""
    return _pvalues(spark, sf_dir).select("o_orderkey", S.stars(F.col("p")).alias("stars"))


@register("anova_oneway", """WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY ALL), t AS (SELECT o_orderstatus, count(*) AS k, sum(n) AS n, sum(n * v) AS w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b FROM g GROUP BY ALL)
SELECT o_orderstatus, k, CAST(n AS BIGINT) AS n, round((b / (k - 1)) / (w / (n - k)), 4) AS f FROM t""")
def anova_oneway(spark, sf_dir):
    """One-way analysis of variance per status."""
    out = S.anova(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority", "o_totalprice")
    return out.select("o_orderstatus", "k", "n", F.round("f", 4).alias("f"))


@register("pairwise_means", """WITH s AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY ALL), p AS (SELECT *, (SELECT sum((n - 1) * v) / sum(n - 1) FROM s) AS pv FROM s)
SELECT a.g AS group1, b.g AS group2, a.n AS n1, b.n AS n2, round(a.m - b.m, 4) AS diff, round((a.m - b.m) / sqrt(a.pv / a.n + b.pv / b.n), 6) AS z FROM p a JOIN p b ON a.g < b.g""")
def pairwise_means(spark, sf_dir):
    """Pairwise differences with pooled variance."""
    out = S.pairwise_means(table(spark, sf_dir, "orders"), [], "o_orderpriority", "o_totalprice")
    return out.withColumns({"diff": F.round("diff", 4), "z": F.round("z", 6)})


@register("marginal_means", "SELECT f AS o_orderpriority, round(avg(m), 4) AS emmean, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_cells FROM (SELECT o_orderpriority AS f, o_orderstatus, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY ALL) GROUP BY f")
def marginal_means(spark, sf_dir):
    """Equal-weight marginal means (H8)."""
    return S.marginal_means(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderstatus"], "o_totalprice").withColumn("emmean", F.round("emmean", 4))


@register("two_stage_deviation", f"""WITH {_CELL}, m AS (SELECT grp, t_pos, row_id % 25 AS s, avg(value) AS m FROM cell GROUP BY ALL), d AS (SELECT *, median(m) OVER (PARTITION BY grp, t_pos) AS md FROM m)
SELECT grp, t_pos, count(*) AS n, round(avg(m), 6) + 0.0 AS estimate, round(avg(m) * sqrt(count(*)) / stddev_samp(m), 4) + 0.0 AS z, round(any_value(md), 6) + 0.0 AS robust, round(any_value(md) * sqrt(count(*)) / (1.4826 * median(abs(m - md))), 4) + 0.0 AS robust_z, 'ok' AS status FROM d GROUP BY ALL""")
def two_stage_deviation(spark, sf_dir):
    """Deviation from zero at each time, subject means first, plain and robust (H5)."""
    t = traces(spark, sf_dir).withColumn("subject", F.col("row_id") % 25)
    out = rounded(S.two_stage_deviation(t, ["grp", "t_pos"]), "estimate", "robust")
    return rounded(out, "z", "robust_z", digits=4)


@register("region_contrast", f"""WITH {_CELL}, m AS (SELECT t_pos, grp % 3 AS r, row_id % 25 AS s, avg(value) AS m FROM cell GROUP BY ALL), g AS (SELECT t_pos, r, count(*) AS n, avg(m) AS mean, var_samp(m) AS v FROM m GROUP BY ALL)
SELECT a.t_pos, a.r AS group1, b.r AS group2, a.n AS n1, b.n AS n2, round(a.mean - b.mean, 6) + 0.0 AS diff, round((a.mean - b.mean) / sqrt(a.v / a.n + b.v / b.n), 4) + 0.0 AS z FROM g a JOIN g b ON a.t_pos = b.t_pos AND a.r < b.r""")
def region_contrast(spark, sf_dir):
    """Region differences at each time (H6)."""
    t = traces(spark, sf_dir).withColumns({"subject": F.col("row_id") % 25, "region": F.col("grp") % 3})
    return rounded(rounded(S.region_contrast(t, ["t_pos"]), "diff"), "z", digits=4)


@register("slope_effect", "SELECT o_orderpriority, round(regr_slope(o_totalprice, o_custkey), 6) + 0.0 AS slope, round(regr_slope(o_totalprice, o_custkey) * (quantile_cont(o_custkey, 0.9) - quantile_cont(o_custkey, 0.1)), 4) + 0.0 AS delta, count(*) AS n FROM orders GROUP BY ALL")
def slope_effect(spark, sf_dir):
    """Slope and endpoint change per stratum."""
    out = S.slope_effect(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_custkey", "o_totalprice").select("o_orderpriority", "slope", "delta", "n")
    return rounded(rounded(out, "slope"), "delta", digits=4)


@register("models_by_band", "SELECT p_brand, count(*) AS n, round(regr_slope(p_retailprice, p_size), 6) + 0.0 AS slope, round(regr_intercept(p_retailprice, p_size), 4) + 0.0 AS intercept, round(regr_r2(p_retailprice, p_size), 6) + 0.0 AS r2 FROM part GROUP BY ALL HAVING count(*) > 3")
def models_by_band(spark, sf_dir):
    """One model per band in one plan."""
    return rounded(rounded(S.models_by_band(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_retailprice"), "slope", "r2"), "intercept", digits=4)


def _level(c):
    """A level without the noise of summation, so that one on a threshold is judged alike whatever order its rows come in."""
    return F.round(c, 9)


@register("interval_search_circular", """WITH b AS (SELECT user_id AS rec, CAST(hour(ts) AS INTEGER) AS h, avg(value) AS v FROM events GROUP BY ALL), m AS (SELECT *, v - avg(v) OVER (PARTITION BY rec) AS d FROM b), a AS (SELECT rec, h, CASE WHEN d > 0 THEN 'positive' ELSE 'negative' END AS way FROM m WHERE abs(d) > 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY rec ORDER BY h) AS seg FROM (SELECT *, CASE WHEN lag(h) OVER w = h - 1 AND lag(way) OVER w = way THEN 0 ELSE 1 END AS n FROM a WINDOW w AS (PARTITION BY rec ORDER BY h))),
g AS (SELECT rec, seg, way, min(h) AS f, max(h) AS l, count(*) AS span FROM s GROUP BY ALL), x AS (SELECT *, count(*) OVER p AS k, first_value(f) OVER w AS ff, first_value(l) OVER w AS fl, first_value(way) OVER w AS fw, first_value(span) OVER w AS fs, last_value(l) OVER w AS ll, last_value(way) OVER w AS lw, row_number() OVER (PARTITION BY rec ORDER BY seg) AS r
FROM g WINDOW p AS (PARTITION BY rec), w AS (PARTITION BY rec ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), y AS (SELECT *, k > 1 AND ff = 0 AND ll = 23 AND fw = lw AS wrap FROM x)
SELECT rec, f AS first, CASE WHEN wrap AND r = k THEN fl ELSE l END AS last, CAST(CASE WHEN wrap AND r = k THEN span + fs ELSE span END AS BIGINT) AS span, way FROM y WHERE NOT (wrap AND r = 1) AND CASE WHEN wrap AND r = k THEN span + fs ELSE span END >= 3""")
def interval_search_circular(spark, sf_dir):
    """Runs of active hours of one direction on the daily circle."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("rec"), F.hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    from pyspark.sql import Window

    e = e.withColumn("d", _level(F.col("v") - F.avg("v").over(Window.partitionBy("rec"))))
    return S.interval_search(e, ["rec"], "h", F.abs("d") > 2, F.when(F.col("d") > 0, "positive").otherwise("negative"), 24, 3)


_CIRCLE = """u AS (SELECT user_id AS rec, CAST(hour(ts) AS INTEGER) AS h, avg(value) AS v, median(value) AS r FROM events GROUP BY ALL), m AS (SELECT rec, h, v - avg(v) OVER (PARTITION BY rec) AS e, r - avg(r) OVER (PARTITION BY rec) AS r FROM u),
d AS (SELECT *, CASE WHEN e > 0 THEN 'above_0' WHEN e < 0 THEN 'below_0' ELSE 'none' END AS de, CASE WHEN r > 0 THEN 'above_0' WHEN r < 0 THEN 'below_0' ELSE 'none' END AS dr, coalesce(1 / (1 + abs(e)) < 0.3, false) AS se, coalesce(0.75 / (1 + abs(r)) < 0.3, false) AS sr FROM m)"""


@register("interval_bases", f"""WITH {_CIRCLE}, a AS (SELECT rec, 'plain' AS basis, h, de AS way FROM d WHERE se AND de <> 'none' UNION ALL SELECT rec, 'robust', h, dr FROM d WHERE sr AND dr <> 'none' UNION ALL SELECT rec, 'joint', h, de FROM d WHERE se AND sr AND de = dr AND de <> 'none'),
s AS (SELECT *, sum(n) OVER (PARTITION BY rec, basis ORDER BY h) AS seg FROM (SELECT *, CASE WHEN lag(h) OVER w = h - 1 AND lag(way) OVER w = way THEN 0 ELSE 1 END AS n FROM a WINDOW w AS (PARTITION BY rec, basis ORDER BY h))),
g AS (SELECT rec, basis, seg, way, min(h) AS f, max(h) AS l, count(*) AS span FROM s GROUP BY ALL), x AS (SELECT *, count(*) OVER p AS k, first_value(f) OVER w AS ff, first_value(l) OVER w AS fl, first_value(way) OVER w AS fw, first_value(span) OVER w AS fs, last_value(l) OVER w AS ll, last_value(way) OVER w AS lw, row_number() OVER (PARTITION BY rec, basis ORDER BY seg) AS r
FROM g WINDOW p AS (PARTITION BY rec, basis), w AS (PARTITION BY rec, basis ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), y AS (SELECT *, k > 1 AND ff = 0 AND ll = 23 AND fw = lw AS wrap FROM x)
SELECT rec, basis, f AS first, CASE WHEN wrap AND r = k THEN fl ELSE l END AS last, CAST(CASE WHEN wrap AND r = k THEN span + fs ELSE span END AS BIGINT) AS span, way FROM y WHERE NOT (wrap AND r = 1) AND CASE WHEN wrap AND r = k THEN span + fs ELSE span END >= 2""")
def interval_bases(spark, sf_dir):
    """Active stretches of the daily circle on the plain, the robust and the joint basis."""
    from pyspark.sql import Window

    own = Window.partitionBy("rec")
    u = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("rec"), F.hour("ts").alias("h")).agg(F.avg("value").alias("v"), F.median("value").alias("r"))
    u = u.withColumns({"estimate": _level(F.col("v") - F.avg("v").over(own)), "robust": _level(F.col("r") - F.avg("r").over(own))})
    u = u.withColumns({"p": 1 / (1 + F.abs("estimate")), "robust_p": 0.75 / (1 + F.abs("robust"))})
    return S.basis_intervals(S.significance(u, 0.3), ["rec"], "h", 24, 2)


@register("candidate_rank", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def candidate_rank(spark, sf_dir):
    """Candidates ranked over several keys."""
    return S.rank_candidates(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.col("o_orderstatus"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "rank")


@register("preprocess_chain", """WITH s AS (SELECT l_suppkey, l_returnflag AS phase, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), t AS (SELECT l_suppkey, phase, 10 * log10(v) AS v FROM s) SELECT l_suppkey, phase, round(v - avg(CASE WHEN phase = 'N' THEN v END) OVER (PARTITION BY l_suppkey), 6) + 0.0 AS value FROM t""")
def preprocess_chain(spark, sf_dir):
    """Summary, transform and normalisation in one plan (H3)."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("phase"), F.col("l_extendedprice").alias("value"))
    return rounded(H.preprocess(li, ["l_suppkey", "phase"], "mean", "db", F.col("phase") == "N", "mean"), "value")


@register("contrast_text", "SELECT p_partkey, trim(split_part(c, ' - ', 1)) AS a, trim(split_part(c, ' - ', 2)) AS b, CAST(p_size AS DOUBLE) AS last FROM (SELECT *, p_type || ' - ' || p_brand || ' ' || p_size AS c FROM part)")
def contrast_text(spark, sf_dir):
    """Contrast labels split, last number read."""
    p = table(spark, sf_dir, "part").withColumn("c", F.concat_ws(" ", F.concat_ws(" - ", "p_type", "p_brand"), "p_size"))
    a, b = S.split_contrast(F.col("c"))
    return p.select("p_partkey", a.alias("a"), b.alias("b"), S.last_number(F.col("c")).alias("last"))


@register("channel_sort", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size, p_partkey % 10, p_partkey) AS INTEGER) AS rank FROM part")
def channel_sort(spark, sf_dir):
    """Order by the numbers of a_b names (O2)."""
    p = table(spark, sf_dir, "part").withColumn("c", F.concat_ws("_", "p_size", F.col("p_partkey") % 10))
    return numbered(p, [*H.channel_order(F.col("c"))[:2], "p_partkey"], "rank").select("p_partkey", F.col("rank").cast("int").alias("rank"))


@register("sorted_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderpriority, o_totalprice DESC, o_orderkey) AS position FROM orders")
def sorted_rows(spark, sf_dir):
    """Place of every row in a sort by several keys of both directions (O1)."""
    return numbered(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "position")


@register("sorted_running", "SELECT o_orderkey, row_number() OVER w AS n, min(o_totalprice) OVER w AS low, max(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS high, CAST(sum(o_orderkey) OVER w AS BIGINT) AS total FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def sorted_running(spark, sf_dir):
    """Numbers and running values of a few groups that hold all rows (O1)."""
    o = Ordered(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).numbered("n")
    return o.running("o_totalprice", "low").running("o_totalprice", "high", "max", after=True).running("o_orderkey", "total", "sum").frame().select("o_orderkey", "n", "low", "high", "total")


@register("p_adjust_all_by", """WITH p AS (SELECT o_orderkey, ((o_orderkey * 7919) % 10007) / 10007.0 AS p FROM orders), r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p) AS r FROM p), h AS (SELECT sum(1 / i) AS h FROM (SELECT unnest(range(1, (SELECT count(*) FROM orders) + 1)) AS i))
SELECT o_orderkey, round(least(1.0, min(p * n / r * h) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS p_adj FROM r, h""")
def p_adjust_all_by(spark, sf_dir):
    """Benjamini-Yekutieli over all rows at once."""
    return S.adjust(_pvalues(spark, sf_dir), method="by").select("o_orderkey", F.round("p_adj", 9).alias("p_adj"))


@register("p_adjust_all_holm", """WITH p AS (SELECT o_orderkey, ((o_orderkey * 7919) % 10007) / 10007.0 AS p FROM orders), r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p) AS r FROM p)
SELECT o_orderkey, round(least(1.0, max(p * (n - r + 1)) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS p_adj FROM r""")
def p_adjust_all_holm(spark, sf_dir):
    """Holm over all rows at once."""
    return S.adjust(_pvalues(spark, sf_dir), method="holm").select("o_orderkey", F.round("p_adj", 9).alias("p_adj"))
