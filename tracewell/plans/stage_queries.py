"""Queries of whole stages: selections, cohort tables, bad spans, power tensors and their decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import stages as P
from tracewell.operators import tensors as X
from tracewell.plans.registry import register
from tracewell.plans.tables import annotations, rounded, table, traces

_CELL = "cell AS (SELECT vec_id AS row_id, label AS grp, CAST(unnest(range(len(embedding))) AS INTEGER) AS t_pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
RATE = 64.0


@register("label_prefixes", "SELECT event_id AS id, event_type AS label FROM events WHERE upper(event_type) LIKE 'P%' OR upper(event_type) LIKE 'C%'")
def label_prefixes(spark, sf_dir):
    """Annotations whose label starts with a removal prefix."""
    return annotations(spark, sf_dir).where(P.is_bad(F.col("label"), ("P", "C"))).select("id", "label")


@register("facet_subset", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 25")
def facet_subset(spark, sf_dir):
    """Rows of given facets within a region."""
    df = table(spark, sf_dir, "lineitem").withColumn("big_in", F.col("l_quantity") > 25)
    return P.subset(df, {"l_returnflag": "R", "l_linestatus": "F"}, ["big"]).select("l_orderkey", "l_linenumber")


@register("side_names", "SELECT l_orderkey, l_linenumber, CASE lower(l_returnflag) WHEN 'l' THEN 'Left' WHEN 'r' THEN 'Right' ELSE 'Bilat' END AS side, l_returnflag || '-' || l_linestatus AS name, l_returnflag || '|' || l_linestatus AS channel FROM lineitem")
def side_names(spark, sf_dir):
    """Normalised sides and joined names."""
    parts = F.array("l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.side_name(F.col("l_returnflag")).alias("side"), P.joined_name(parts).alias("name"), P.joined_name(parts, "|").alias("channel"))


@register("picks_in_order", "SELECT l_orderkey, l_linenumber AS ord, l_shipmode AS channel, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS pick FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1) WHERE l_shipmode IN ('A', 'R')")
def picks_in_order(spark, sf_dir):
    """Wanted channels of each record in data order."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("channel"))
    once = df.groupBy("l_orderkey", "ord").agg(F.count("*").alias("n"), F.first("channel").alias("channel")).where("n = 1").drop("n")
    return P.picks(once, spark.createDataFrame([("A",), ("R",)], "channel string"), ["l_orderkey"])


@register("listed_order", "SELECT o_orderkey, coalesce(nullif(list_position(['1-URGENT', '3-MEDIUM'], o_orderpriority), 0) - 1, 2) AS rank FROM orders")
def listed_order(spark, sf_dir):
    """Places in a list of levels, others last."""
    return table(spark, sf_dir, "orders").select("o_orderkey", P.listed_rank(F.col("o_orderpriority"), ("1-URGENT", "3-MEDIUM")).alias("rank"))


@register("rounded_join", "WITH a AS (SELECT DISTINCT p_size * 0.25 + 1e-10 AS k FROM part), b AS (SELECT p_size * 0.25 AS k, count(*) AS n FROM part WHERE p_size <= 40 GROUP BY p_size) SELECT a.k, b.n FROM a LEFT JOIN b ON round(a.k, 8) = round(b.k, 8)")
def rounded_join(spark, sf_dir):
    """Join on a rounded numeric key."""
    p = table(spark, sf_dir, "part")
    a = p.select((F.col("p_size") * 0.25 + 1e-10).alias("k")).distinct()
    b = p.where("p_size <= 40").groupBy("p_size").agg(F.count("*").alias("n")).select((F.col("p_size") * 0.25).alias("k"), "n")
    return P.join_rounded(a, b, "k")


@register("level_map", "SELECT p_brand, round(median(p_retailprice), 6) + 0.0 AS p_retailprice FROM part GROUP BY p_brand")
def level_map(spark, sf_dir):
    """Median covariate of each display level."""
    return rounded(P.level_map(table(spark, sf_dir, "part"), "p_brand", "p_retailprice"), "p_retailprice")


_FEATURES = """f AS (SELECT l_suppkey AS subject, CASE l_returnflag WHEN 'A' THEN 'psi' WHEN 'N' THEN 'Coherence' ELSE 'burst' END AS metric, CAST(l_linenumber AS VARCHAR) || '_8' AS channel, l_quantity % 3 = 0 AS snr, l_quantity % 2 = 0 AS stn, l_linenumber % 2 = 0 AS rev, CASE WHEN l_linestatus = 'F' THEN 'strike_L' ELSE 'walk' END AS phase, CAST(l_extendedprice AS DOUBLE) AS value, l_orderkey FROM lineitem)"""


@register("merged_table", f"""WITH {_FEATURES}, g AS (SELECT *, CASE WHEN metric = 'burst' THEN CASE WHEN snr AND NOT stn THEN 'SNr' WHEN stn AND NOT snr THEN 'STN' END WHEN snr AND NOT stn AND (metric = 'Coherence' OR NOT rev) THEN 'SNr-STN' END AS region,
CASE WHEN channel[1] IN ('1', '2', '3') THEN 'L' WHEN channel[1] IN ('4', '5') THEN 'R' WHEN metric <> 'burst' THEN 'R' END AS side FROM f)
SELECT subject AS Subject, channel AS Channel, side AS Side, 1.0::DOUBLE AS MNI_x, 2.0::DOUBLE AS MNI_y, 3.0::DOUBLE AS MNI_z, region AS Region, 'beta' AS Band, CASE WHEN phase = 'walk' THEN 'Walk' ELSE 'Strike' END AS Phase, CASE WHEN phase <> 'walk' THEN CASE WHEN side = 'L' THEN 'Ipsi' ELSE 'Contra' END END AS Lat, value AS Value FROM g WHERE region IS NOT NULL""")
def merged_table(spark, sf_dir):
    """Merged cohort schema with its keep rules."""
    q, name = F.col("l_quantity"), F.concat(F.col("l_linenumber").cast("string"), F.lit("_8"))
    f = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"), F.when(F.col("l_returnflag") == "A", "psi").when(F.col("l_returnflag") == "N", "Coherence").otherwise("burst").alias("metric"), name.alias("channel"),
        (q % 3 == 0).alias("snr_in"), (q % 2 == 0).alias("stn_in"), (q % 3 == 0).alias("mixed_in"), (q % 2 == 0).alias("snr_pair_in"), F.lit(None).cast("boolean").alias("stn_pair_in"), (F.col("l_linenumber") % 2 == 0).alias("reverse_in"),
        F.lit(1.0).alias("mni_x"), F.lit(2.0).alias("mni_y"), F.lit(3.0).alias("mni_z"), F.when(F.col("l_linestatus") == "F", "strike_L").otherwise("walk").alias("phase"), F.lit("beta").alias("band"), F.col("l_extendedprice").cast("double").alias("value"),
    )
    return P.merged_table(f, ("1", "2", "3"), ("4", "5"))


@register("long_traces", f"WITH {_CELL} SELECT CAST(row_id AS VARCHAR) AS channel, (t_pos // 5 + 0.5) * 500 / 60 AS t_pct, round(avg(value), 6) + 0.0 AS value FROM cell WHERE t_pos < 60 GROUP BY row_id, t_pos // 5")
def long_traces(spark, sf_dir):
    """Checked long rows of cycle traces in blocks of five (H4)."""
    t = traces(spark, sf_dir).where("t_pos < 60").select(F.col("row_id").alias("channel"), "t_pos", "value", F.lit("Contra").alias("lat"))
    return rounded(P.long_traces(t, ["channel"], smooth=False), "value")


@register("plot_values", f"WITH {_CELL}, a AS (SELECT row_id, t_pos, asinh(value) AS v FROM cell), b AS (SELECT row_id, avg(v) AS m, stddev_pop(v) AS s FROM a WHERE t_pos < 16 GROUP BY row_id) SELECT row_id, t_pos, round((v - m) / s, 6) + 0.0 AS value FROM a JOIN b USING (row_id)")
def plot_values(spark, sf_dir):
    """Transform, then baseline span, of nested values."""
    return rounded(P.plot_values(traces(spark, sf_dir).select("row_id", "t_pos", "value"), ["row_id"], "asinh", [(0, 25)], "zscore"), "value")


@register("bad_spans_removed", f"WITH {_CELL}, k AS (SELECT row_id, t_pos FROM cell WHERE NOT (t_pos >= 10 AND t_pos < 20) AND NOT (t_pos >= row_id % 40 AND t_pos < row_id % 40 + 5)) SELECT row_id, CAST(t_pos AS BIGINT) AS sample_idx, CAST(row_number() OVER (PARTITION BY row_id ORDER BY t_pos) - 1 AS BIGINT) AS new_idx FROM k")
def bad_spans_removed(spark, sf_dir):
    """Samples after removal of marked spans, on the closed timeline."""
    s = traces(spark, sf_dir).select("row_id", F.col("t_pos").cast("long").alias("sample_idx"), "value")
    ids = s.select("row_id").distinct()
    spans = F.array(F.struct(F.lit(10).cast("long").alias("start"), F.lit(20).cast("long").alias("end"), F.lit("BAD_a").alias("description")), F.struct((F.col("row_id") % 40).alias("start"), (F.col("row_id") % 40 + 5).alias("end"), F.lit("edge").alias("description")), F.struct(F.lit(30).cast("long").alias("start"), F.lit(60).cast("long").alias("end"), F.lit("walk").alias("description")))
    marks = ids.select("row_id", F.explode(spans).alias("m")).select("row_id", "m.*")
    return P.remove_bad_spans(s, marks, ["row_id"])[0].select("row_id", "sample_idx", "new_idx")


def _power(spark, sf_dir):
    s = traces(spark, sf_dir).select("row_id", F.col("t_pos").cast("long").alias("sample_idx"), "value")
    freqs = [4.0 + 2 * i for i in range(12)]
    return P.raw_power(s, ["row_id"], RATE, freqs, [max(2.0, f / 6) for f in freqs], [(16.0, 3.0)], hop=8)


@register("raw_power")
def raw_power(spark, sf_dir):
    """Power with notch bins interpolated in dB."""
    return rounded(_power(spark, sf_dir), "value", digits=8)


@register("periodic_aperiodic")
def periodic_aperiodic(spark, sf_dir):
    """Periodic part over smoothed log-log lines."""
    return rounded(P.decompose(_power(spark, sf_dir), ["row_id"], kernel=3, hop=8)[0], "value", digits=6)


@register("spectrogram")
def spectrogram(spark, sf_dir):
    """Mean power over the channels of each record on a logarithmic grid."""
    s = traces(spark, sf_dir).select(F.col("grp").alias("rec"), F.col("row_id").cast("string").alias("channel"), F.col("t_pos").cast("long").alias("sample_idx"), "value")
    return rounded(P.spectrogram(s, ["rec", "channel"], RATE, 4.0, 24.0, 6, 16), "power", digits=8)


@register("grid_left_over", "SELECT DISTINCT CAST(p_size AS DOUBLE) AS freq FROM part WHERE p_size * 0.001 > 0.02")
def grid_left_over(spark, sf_dir):
    """Grid points without a partner."""
    p = table(spark, sf_dir, "part")
    return X.grid_difference(p.select(F.col("p_size").cast("double").alias("freq")).distinct(), p.select((F.col("p_size") * 0.999).alias("freq")).distinct(), 0.02)
