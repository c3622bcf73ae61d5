"""Queries over traces, groups and scalar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import cells as C
from tracewell.operators import transforms as T
from tracewell.plans.registry import register
from tracewell.plans.tables import rounded, table, traces
from tracewell.sources.configs import axis_rows

WELLS = (("low", 0, 16), ("mid", 16, 40), ("high", 40, 64))
_CELL = """cell AS (SELECT vec_id AS row_id, label AS grp, CAST(unnest(range(len(embedding))) AS INTEGER) AS t_pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
_WELL = """well(well, w_lo, w_hi) AS (VALUES ('low', 0, 16), ('mid', 16, 40), ('high', 40, 64))"""
_R = "round({}, 6) + 0.0"
# Gating on size leaves gaps, so that traces fall into runs.
_GATE = 0.05
_RUNS = f"""WITH {_CELL}, {_WELL}, sel AS (
    SELECT row_id, well, w_hi - w_lo AS w_len, t_pos, CASE WHEN abs(value) > {_GATE} THEN value END AS value FROM cell JOIN well ON t_pos >= w_lo AND t_pos < w_hi
), isl AS (
    SELECT *, t_pos - row_number() OVER (PARTITION BY row_id, well ORDER BY t_pos) AS isl FROM sel WHERE value IS NOT NULL
)"""


def _selection(spark, sf_dir, gate=False):
    cells = traces(spark, sf_dir)
    if gate:
        cells = cells.withColumn("value", F.when(F.abs("value") > _GATE, F.col("value")))
    return C.select_wells(cells, C.wells(spark, WELLS))


@register(
    "trace_band_norm",
    f"""WITH {_CELL}, {_WELL}, sel AS (SELECT * FROM cell JOIN well ON t_pos >= w_lo AND t_pos < w_hi), steps AS (
    SELECT row_id, grp, well, value, lead(value) OVER w AS nxt FROM sel WINDOW w AS (PARTITION BY row_id, well ORDER BY t_pos)
), m AS (
    SELECT row_id, grp, well, sum((value + nxt) / 2) / count(nxt) AS value FROM steps GROUP BY ALL
), b AS (
    SELECT *, avg(CASE WHEN row_id % 5 = 0 THEN value END) OVER (PARTITION BY grp, well) AS base, stddev_pop(CASE WHEN row_id % 5 = 0 THEN value END) OVER (PARTITION BY grp, well) AS sd FROM m
) SELECT row_id, grp, well, {_R.format('CASE WHEN sd > 0 THEN (value - base) / sd END')} AS value FROM b""",
)
def trace_band_norm(spark, sf_dir):
    """Band means of traces, z-scored against each group's baseline traces (A3, A4, W16): the flagship."""
    means = C.grid(traces(spark, sf_dir), C.wells(spark, WELLS), "mean", ["grp"]).withColumnRenamed("phase", "well")
    out = T.normalize_by_group(means, ["grp", "well"], F.col("row_id") % 5 == 0, "zscore")
    return rounded(out.select("row_id", "grp", "well", "value"), "value")


@register(
    "trace_band_mean",
    f"""{_RUNS}, st AS (
    SELECT row_id, well, isl, value, lead(value) OVER (PARTITION BY row_id, well, isl ORDER BY t_pos) AS nxt, count(*) OVER (PARTITION BY row_id, well, isl) AS n FROM isl
), m AS (
    SELECT row_id, well, sum(CASE WHEN n = 1 THEN value ELSE (value + nxt) / 2 END) AS num, sum(CASE WHEN n = 1 OR nxt IS NOT NULL THEN 1.0 END) AS den FROM st GROUP BY ALL
) SELECT s.row_id, s.well, {_R.format('num / den')} AS value FROM (SELECT DISTINCT row_id, well FROM sel) s LEFT JOIN m USING (row_id, well)""",
)
def trace_band_mean(spark, sf_dir):
    """Trapezoid means over contiguous finite runs (A4)."""
    return rounded(C.reduce_1d(_selection(spark, sf_dir, True), ["row_id", "well"], "mean"), "value")


@register("trace_band_median", f"""{_RUNS} SELECT row_id, well, {_R.format('median(value)')} AS value FROM sel GROUP BY ALL""")
def trace_band_median(spark, sf_dir):
    """Medians of finite values."""
    return rounded(C.reduce_1d(_selection(spark, sf_dir, True), ["row_id", "well"], "median"), "value")


@register(
    "trace_band_runs",
    f"""{_RUNS}, sp AS (
    SELECT row_id, well, isl, max(t_pos) - min(t_pos) AS d, any_value(w_len) AS w_len FROM isl GROUP BY ALL
), st AS (SELECT row_id, well, count(*) AS n, sum(d) AS s, any_value(w_len) AS w_len FROM sp GROUP BY ALL)
SELECT a.row_id, a.well, CAST(coalesce(n, 0) AS DOUBLE) AS n_runs, {_R.format('coalesce(s / w_len, 0)')} AS occupation, {_R.format('n / w_len')} AS rate, {_R.format('s / n')} AS duration
FROM (SELECT DISTINCT row_id, well FROM sel) a LEFT JOIN st USING (row_id, well)""",
)
def trace_band_runs(spark, sf_dir):
    """Run count, occupation, rate and duration."""
    sel = _selection(spark, sf_dir, True)
    keys = ["row_id", "well"]
    out = C.reduce_1d(sel, keys, "count").withColumnRenamed("value", "n_runs")
    for r in ("occupation", "rate", "duration"):
        out = out.join(C.reduce_1d(sel, keys, r).withColumnRenamed("value", r), keys)
    return rounded(out, "occupation", "rate", "duration")


@register("trace_categorical_mean", f"""WITH {_CELL}, {_WELL} SELECT row_id, well, {_R.format('avg(value)')} AS value FROM cell JOIN well ON t_pos >= w_lo AND t_pos < w_hi GROUP BY ALL""")
def trace_categorical_mean(spark, sf_dir):
    """Plain means on a categorical axis (A5)."""
    return rounded(C.reduce_1d(_selection(spark, sf_dir), ["row_id", "well"], "mean", numeric=False), "value")


_MAP = """m2 AS (SELECT grp AS row_id, row_id % 20 AS f_pos, t_pos, avg(value) AS value FROM cell GROUP BY ALL)"""


def _maps(spark, sf_dir):
    """Groups as frequency-by-time cells: the trace number modulo 20 is the frequency."""
    c = traces(spark, sf_dir)
    out = c.groupBy(F.col("grp").alias("row_id"), (F.col("row_id") % 20).cast("int").alias("f_pos"), "t_pos", "t_coord").agg(F.avg("value").alias("value"))
    return out.withColumn("f_coord", F.col("f_pos").cast("double"))


@register(
    "map_grid_mean",
    f"""WITH {_CELL}, {_WELL}, {_MAP}, sel AS (SELECT row_id, well AS phase, f_pos, t_pos, value FROM m2 JOIN well ON t_pos >= w_lo AND t_pos < w_hi WHERE f_pos < 8),
i1 AS (SELECT *, f_pos - row_number() OVER (PARTITION BY row_id, phase, t_pos ORDER BY f_pos) AS isl FROM sel WHERE value IS NOT NULL),
i2 AS (SELECT *, lead(value) OVER w AS nv, lead(f_pos) OVER w AS nf, count(*) OVER (PARTITION BY row_id, phase, t_pos, isl) AS n FROM i1 WINDOW w AS (PARTITION BY row_id, phase, t_pos, isl ORDER BY f_pos)),
i3 AS (SELECT row_id, phase, t_pos, sum(CASE WHEN n = 1 THEN value ELSE (value + nv) / 2 * (nf - f_pos) END) AS num, sum(CASE WHEN n = 1 THEN 1.0 ELSE nf - f_pos END) AS den FROM i2 GROUP BY ALL),
i4 AS (SELECT *, t_pos - row_number() OVER (PARTITION BY row_id, phase ORDER BY t_pos) AS isl FROM i3),
i5 AS (SELECT *, lead(num) OVER w AS nn, lead(den) OVER w AS nd, lead(t_pos) OVER w - t_pos AS st, count(*) OVER (PARTITION BY row_id, phase, isl) AS n FROM i4 WINDOW w AS (PARTITION BY row_id, phase, isl ORDER BY t_pos))
SELECT row_id, phase, 'all' AS band, {_R.format('sum(CASE WHEN n = 1 THEN num ELSE (num + nn) / 2 * st END) / sum(CASE WHEN n = 1 THEN den ELSE (den + nd) / 2 * st END)')} AS value FROM i5 GROUP BY row_id, phase""",
)
def map_grid_mean(spark, sf_dir):
    """Two-dimensional integral means over band and phase."""
    out = C.grid(_maps(spark, sf_dir), C.wells(spark, WELLS), "mean", (), C.wells(spark, [("all", 0, 8)]))
    return rounded(out.select("row_id", "phase", "band", "value"), "value")


@register("map_grid_count", f"""WITH {_CELL}, {_WELL}, {_MAP}, sel AS (SELECT DISTINCT row_id, well AS phase, t_pos FROM m2 JOIN well ON t_pos >= w_lo AND t_pos < w_hi WHERE f_pos < 8 AND value > 0.05),
i AS (SELECT row_id, phase, t_pos - row_number() OVER (PARTITION BY row_id, phase ORDER BY t_pos) AS isl FROM sel)
SELECT a.row_id, a.phase, CAST(coalesce(count(DISTINCT isl), 0) AS DOUBLE) AS value FROM (SELECT DISTINCT row_id, well AS phase FROM m2, well WHERE f_pos < 8) a LEFT JOIN i ON a.row_id = i.row_id AND a.phase = i.phase GROUP BY a.row_id, a.phase""")
def map_grid_count(spark, sf_dir):
    """Runs of times at which any selected frequency is finite (A8 in two dimensions)."""
    cells = _maps(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0.05, F.col("value")))
    return C.grid(cells, C.wells(spark, WELLS), "count", (), C.wells(spark, [("all", 0, 8)])).select("row_id", "phase", "value")


@register("phase_split_spectrum", f"""WITH {_CELL}, {_WELL}, {_MAP} SELECT row_id, well AS phase, CAST(f_pos AS INTEGER) AS f_pos, {_R.format('median(value)')} AS value FROM m2 JOIN well ON t_pos >= w_lo AND t_pos < w_hi GROUP BY ALL""")
def phase_split_spectrum(spark, sf_dir):
    """Spectra kept, time wells reduced (A2)."""
    return rounded(C.split_by_time(_maps(spark, sf_dir), C.wells(spark, WELLS), "median").select("row_id", "phase", "f_pos", "value"), "value")


@register("band_split_trace", f"""WITH {_CELL}, {_MAP}, w(band, lo, hi) AS (VALUES ('a', 0, 6), ('b', 6, 20)) SELECT row_id, band, t_pos, {_R.format('median(value)')} AS value FROM m2 JOIN w ON f_pos >= lo AND f_pos < hi GROUP BY ALL""")
def band_split_trace(spark, sf_dir):
    """Traces kept, bands reduced (A3)."""
    return rounded(C.split_by_freq(_maps(spark, sf_dir), C.wells(spark, [("a", 0, 6), ("b", 6, 20)]), "median").select("row_id", "band", "t_pos", "value"), "value")


def _group_baseline(mode: str, expr: str) -> None:
    sql = f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice AS v, l_returnflag, avg(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) OVER w AS base, stddev_pop(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) OVER w AS sd
    FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus))
    SELECT l_orderkey, l_linenumber, l_quantity, round({expr}, 4) + 0.0 AS value FROM b"""

    @register(f"group_baseline_norm_{mode}", sql)
    def query(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("value"))
        out = T.normalize_by_group(df, ["l_returnflag", "l_linestatus"], F.col("l_linenumber") == 1, mode)
        return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity", "value"), "value", digits=4)


for _mode, _expr in {"mean": "v - base", "ratio": "v / base", "percent": "100 * (v - base) / base", "zscore": "(v - base) / sd"}.items():
    _group_baseline(_mode, _expr)


@register("span_baseline_norm", f"""WITH {_CELL}, b AS (SELECT *, avg(CASE WHEN t_pos >= 6 AND t_pos < 16 THEN value END) OVER (PARTITION BY row_id) AS base FROM cell) SELECT row_id, t_pos, {_R.format('value - base')} AS value FROM b""")
def span_baseline_norm(spark, sf_dir):
    """Traces against their 10 to 25 % span (W17): floor(6.4) = 6 to ceil(16) = 16."""
    out = T.normalize_by_span(traces(spark, sf_dir), ["row_id"], [(10, 25)], "mean")
    return rounded(out.select("row_id", "t_pos", "value"), "value")


_X = {"db": ("l_extendedprice", "10 * log10(x)"), "log10": ("l_extendedprice", "log10(x)"), "log": ("l_extendedprice", "ln(x)"), "logit": ("l_discount", "CASE WHEN x > 0 AND x < 1 THEN ln(x / (1 - x)) END"), "fisherz": ("l_discount", "CASE WHEN x > -1 AND x < 1 THEN atanh(x) END"), "fisherz_sqrt": ("l_discount", "CASE WHEN x >= 0 AND x < 1 THEN atanh(sqrt(x)) END"), "asinh": ("l_extendedprice", "asinh(x)")}


def _transform(mode: str, column: str, expr: str) -> None:
    @register(f"transform_{mode}", f"SELECT l_orderkey, l_linenumber, l_quantity, {_R.format(expr)} AS value, {_R.format('x')} AS back FROM (SELECT *, {column} AS x FROM lineitem)" if mode not in ("logit", "fisherz") else f"SELECT l_orderkey, l_linenumber, l_quantity, {_R.format(expr)} AS value, CASE WHEN {expr} IS NOT NULL THEN {_R.format('x')} END AS back FROM (SELECT *, {column} AS x FROM lineitem)")
    def query(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem")
        y = T.transform(F.col(column), mode)
        out = df.select("l_orderkey", "l_linenumber", "l_quantity", y.alias("value"), T.inverse(y, mode).alias("back"))
        return rounded(out, "value", "back")


for _mode, (_column, _expr) in _X.items():
    _transform(_mode, _column, _expr)


@register("zscore_trace", f"""WITH {_CELL} SELECT row_id, t_pos, {_R.format('(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0)')} AS value FROM cell WINDOW w AS (PARTITION BY row_id)""")
def zscore_trace(spark, sf_dir):
    """z-scores with population sd."""
    return rounded(T.zscore(traces(spark, sf_dir), ["row_id"]).select("row_id", "t_pos", "value"), "value")


@register("summarize_scalar", """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS mean, round(sum(l_quantity), 2) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(median(l_quantity), 4) AS median, round(stddev_samp(l_quantity), 4) AS std, round(var_samp(l_quantity), 4) AS var FROM lineitem GROUP BY ALL""")
def summarize_scalar(spark, sf_dir):
    """Seven summaries by group, ddof 1."""
    df = table(spark, sf_dir, "lineitem").withColumnRenamed("l_quantity", "value")
    keys = ["l_returnflag", "l_linestatus"]
    out = df.groupBy(*keys).agg(*(T.SUMMARIES[h]("value").alias(n) for h, n in (("mean", "mean"), ("sum", "total"), ("min", "low"), ("max", "high"), ("median", "median"), ("std", "std"), ("var", "var"))))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "median", "std", "var")} | {"total": F.round("total", 2)})


@register("summarize_nested", f"""WITH {_CELL} SELECT grp, t_pos, {_R.format('stddev_pop(value)')} AS value FROM cell GROUP BY ALL""")
def summarize_nested(spark, sf_dir):
    """Element-wise sd of traces by group, ddof 0."""
    return rounded(T.summarize_nested(traces(spark, sf_dir), ["grp"], "std"), "value")


@register("bundle_sem", f"""WITH {_CELL}, b AS (SELECT grp, t_pos, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM cell GROUP BY ALL) SELECT grp, t_pos, n, {_R.format('mean')} AS mean, {_R.format('sd')} AS sd, {_R.format('sd / sqrt(n)')} AS sem, {_R.format('mean - 1.96 * sd / sqrt(n)')} AS lo, {_R.format('mean + 1.96 * sd / sqrt(n)')} AS hi FROM b""")
def bundle_sem(spark, sf_dir):
    """Mean, sd, sem and 95 % band of a bundle of series."""
    return rounded(T.bundle(traces(spark, sf_dir), ["grp"]), "mean", "sd", "sem", "lo", "hi")


@register("box_stats", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3, min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lo,
max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS hi, count(*) FILTER (NOT (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_out FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag""")
def box_stats(spark, sf_dir):
    """Quartiles with Tukey whiskers."""
    out = T.box_stats(table(spark, sf_dir, "lineitem").withColumnRenamed("l_extendedprice", "value"), ["l_returnflag"])
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@register("quantile_scale", f"""WITH {_CELL}, q AS (SELECT grp, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM cell GROUP BY ALL) SELECT row_id, t_pos, {_R.format('(value - a) / (b - a)')} AS value FROM cell JOIN q USING (grp)""")
def quantile_scale(spark, sf_dir):
    """Quantile scaling."""
    return rounded(T.quantile_scale(traces(spark, sf_dir), ["grp"]).select("row_id", "t_pos", "value"), "value")


@register("cell_missing", f"""WITH {_CELL}, g AS (SELECT row_id, CASE WHEN abs(value) > {_GATE} THEN value END AS v FROM cell) SELECT row_id, bool_or(v IS NULL) AS any_missing, bool_and(v IS NULL) AS all_missing, count(*) AS n FROM g GROUP BY ALL""")
def cell_missing(spark, sf_dir):
    """Missing tests per cell."""
    return C.any_missing(traces(spark, sf_dir).withColumn("value", F.when(F.abs("value") > _GATE, F.col("value"))))


@register("pack_round_trip", f"""WITH {_CELL} SELECT row_id, CAST(len(list(value)) AS INTEGER) AS n, {_R.format('sum(value)')} AS total FROM cell GROUP BY ALL""")
def pack_round_trip(spark, sf_dir):
    """Cells packed to arrays and measured."""
    packed = C.pack_traces(traces(spark, sf_dir))
    return rounded(packed.select("row_id", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("total")), "total")


@register("feature_extract", f"""WITH {_CELL}, {_WELL}, {_MAP}, sel AS (SELECT row_id, well AS phase, t_pos, f_pos, value FROM m2 JOIN well ON t_pos >= w_lo AND t_pos < w_hi WHERE f_pos < 8)
SELECT row_id, phase, 'all' AS band, 'median' AS reducer, {_R.format('median(value)')} AS value FROM sel GROUP BY ALL
UNION ALL SELECT row_id, phase, 'all', 'count', CAST(1 AS DOUBLE) FROM sel GROUP BY row_id, phase""")
def feature_extract(spark, sf_dir):
    """Several reducers over one set of cells in one plan (H1)."""
    out = C.extract_features(_maps(spark, sf_dir), C.wells(spark, WELLS), C.wells(spark, [("all", 0, 8)]), reducers=("median", "count"))
    return rounded(out.select("row_id", "phase", "band", "reducer", "value"), "value")


def _surface_sql(how: str, limits: str) -> str:
    return f"""WITH {_CELL}, p AS (SELECT grp, t_pos % 8 + grp % 3 AS x, t_pos // 8 AS y, value FROM cell), z AS (SELECT grp, x, y, count(*) AS n, {how}(value) AS value FROM p GROUP BY ALL),
g AS (SELECT a.grp, x, y FROM (SELECT DISTINCT grp, x FROM z) a JOIN (SELECT DISTINCT grp, y FROM z) b USING (grp))
SELECT grp, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, coalesce(n, 0) AS n, {_R.format('value')} AS value, {limits} FROM g LEFT JOIN z USING (grp, x, y)"""


def _surfaces(spark, sf_dir, **options):
    c = traces(spark, sf_dir).select("grp", (F.col("t_pos") % 8 + F.col("grp") % 3).alias("x"), F.floor(F.col("t_pos") / 8).cast("int").alias("y"), "value")
    return rounded(T.surface(c, ["grp"], "x", "y", **options), "value", "lo", "hi")


@register("surface_mean", _surface_sql("avg", f"{_R.format('(SELECT min(value) FROM z)')} AS lo, {_R.format('(SELECT max(value) FROM z)')} AS hi"))
def surface_mean(spark, sf_dir):
    """Mean surface of each label's maps with the range of all surfaces."""
    return _surfaces(spark, sf_dir)


@register("surface_median", _surface_sql("median", f"{_R.format('(SELECT -max(abs(value)) FROM z)')} AS lo, {_R.format('(SELECT max(abs(value)) FROM z)')} AS hi"))
def surface_median(spark, sf_dir):
    """Median surfaces with a range about 0."""
    return _surfaces(spark, sf_dir, how="median", symmetric=True)


#: Bands and times of two metrics as a document: unordered, with a repeated name, an empty interval and an entry without numbers.
_DOCUMENT = '{"raw": {"bands": [{"name": "high", "start": 40, "end": 64}, {"name": "low", "start": 0, "end": "16"}, {"name": "low", "start": 50, "end": 60}, {"name": "none", "start": 9, "end": 9}, {"name": "odd", "start": "x", "end": 3}, {"name": "mid", "start": 16, "end": 40}], "times": [{"name": "strike", "start": 30, "end": 36}, {"name": "strike", "start": 2, "end": 10}]}, "other": {"bands": [{"name": "low", "start": 1, "end": 2}]}}'


@register("config_axes", f"""WITH {_CELL}, d(axis, rank, name, s, e) AS (VALUES ('bands', 0, 'low', 0, 16), ('bands', 1, 'mid', 16, 40), ('bands', 2, 'high', 40, 64), ('times', 0, 'strike', 2, 10), ('times', 1, 'strike', 30, 36))
SELECT row_id, axis, CAST(rank AS INTEGER) AS rank, name, count(*) AS n, {_R.format('avg(value)')} AS value FROM cell JOIN d ON t_pos >= s AND t_pos < e GROUP BY ALL""")
def config_axes(spark, sf_dir):
    """Bands and times of a configuration document applied to traces."""
    documents = spark.createDataFrame([("memory", _DOCUMENT)], "source string, text string")
    axes = axis_rows(documents).where("metric = 'raw'").select("axis", "rank", "name", F.col("start").alias("lo"), F.col("end").alias("hi"))
    c = traces(spark, sf_dir)
    met = c.join(F.broadcast(axes), (F.col("t_pos") >= F.col("lo")) & (F.col("t_pos") < F.col("hi")))
    return rounded(met.groupBy("row_id", "axis", "rank", "name").agg(F.count("*").alias("n"), F.avg("value").alias("value")), "value")


@register("group_baseline_nested", f"""WITH {_CELL}, c AS (SELECT grp, row_id, t_pos // 4 AS p, CASE WHEN t_pos // 4 = 5 THEN value * 1e-12 ELSE value END AS v FROM cell), b AS (SELECT grp, p, avg(v) FILTER (row_id % 2 = 0) AS base FROM c GROUP BY ALL), t AS (SELECT grp, quantile_cont(abs(base), 0.95) AS top FROM b GROUP BY grp)
SELECT row_id, CAST(p AS INTEGER) AS p, round(CASE WHEN abs(base) > 1e-8 * top THEN v / base END, 3) + 0.0 AS value FROM c JOIN b USING (grp, p) JOIN t USING (grp)""")
def group_baseline_nested(spark, sf_dir):
    """Ratio to the baseline of each position of a label's cells; a denominator that is tiny beside the others gives none."""
    p = F.floor(F.col("t_pos") / 4).cast("int")
    c = traces(spark, sf_dir).select("grp", "row_id", p.alias("p"), F.when(p == 5, F.col("value") * 1e-12).otherwise(F.col("value")).alias("value"))
    out = T.normalize_by_group(c, ["grp", "p"], F.col("row_id") % 2 == 0, "ratio", within=["p"])
    return rounded(out.select("row_id", "p", "value"), "value", digits=3)
