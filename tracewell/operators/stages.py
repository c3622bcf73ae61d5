"""Whole stages: bad spans out, power tensors, spectral decomposition, cohort tables and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import cells as C
from tracewell.operators import cohort as H
from tracewell.operators import intervals as I
from tracewell.operators import spectral as G
from tracewell.operators import statistics as S
from tracewell.operators import tensors as X
from tracewell.operators import transforms as T
from tracewell.operators.ordering import numbered
from tracewell.storage import keep

# Prefixes of removed spans, and metrics by kind of channel.
REMOVED = ("BAD", "EDGE")
ORDERED, UNORDERED = ("psi", "trgc"), ("coherence", "plv", "ciplv", "pli", "wpli")


# Predicates, names and orders


def is_bad(label: Column, prefixes: Sequence[str] = REMOVED) -> Column:
    """Labels that mark spans to remove; a NULL label marks none."""
    return F.coalesce(I.reduce_or([F.startswith(F.upper(label), F.lit(p)) for p in prefixes]), F.lit(False))


def subset(features: DataFrame, equal: Mapping[str, object] | None = None, regions: Sequence[str] = ()) -> DataFrame:
    """Rows that equal every given facet and lie in every given region (column ``<region>_in``, boolean or 0/1)."""
    wanted = [F.col(c) == F.lit(v) for c, v in (equal or {}).items()]
    return features.where(I.reduce_and([*wanted, *(F.coalesce(F.col(f"{r}_in").cast("boolean"), F.lit(False)) for r in regions)]))


def picks(channels: DataFrame, wanted: DataFrame, keys: Sequence[str], name: str = "channel", order: str = "ord") -> DataFrame:
    """Each record's wanted channels in the order of the data, numbered anew from 0."""
    kept = channels.join(wanted.select(name).distinct(), name, "left_semi")
    return kept.withColumn("pick", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def side_name(side: Column) -> Column:
    """Left, Right or Bilat of any spelling; unknown and NULL sides are Bilat."""
    s = F.lower(F.trim(side))
    return F.when(s.isin("lh", "l", "left"), "Left").when(s.isin("rh", "r", "right"), "Right").otherwise("Bilat")


def joined_name(parts: Column, by: str = "-") -> Column:
    """The texts of an array as one; ``by="|"`` for channel tuples. An array with a NULL gives NULL."""
    return F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, by))


def listed_rank(c: Column, levels: Sequence[str]) -> Column:
    """Place of a value in a list of bands or phases, from 0; values outside come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, levels)), c), F.lit(0)) - 1, F.lit(len(levels)))


def example_order(df: DataFrame, phases: Sequence[str], order: str = "ord") -> DataFrame:
    """Rows numbered (column ``place``) by first-seen channel, then listed phase, then phase text, then input order."""
    first = df.groupBy(F.col("channel").alias("_ch")).agg(F.min(order).alias("_c"))
    met = df.join(first, df["channel"].eqNullSafe(first["_ch"])).withColumn("_p", listed_rank(F.col("phase"), phases))
    return numbered(met, ["_c", "_p", "phase", order], "place").withColumn("place", F.col("place") - 1).drop("_ch", "_c", "_p")


# Joins and maps


def join_rounded(left: DataFrame, right: DataFrame, key: str, digits: int = 8) -> DataFrame:
    """Left join on a numeric key rounded to ``digits``; NULL keys meet nothing.

    Of right rows whose keys round alike the one with the least key is taken, so no left row is repeated; a right column
    whose name left has too comes out as ``<name>_right``.
    """
    others = [c for c in right.columns if c != key]
    if not others:
        return left
    right = right.where(F.col(key).isNotNull()).groupBy(F.round(F.col(key), digits).alias("_r")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in others)), key).alias("_of"))
    right = right.select("_r", *(F.col(f"_of.`{c}`").alias(f"{c}_right" if c in left.columns else c) for c in others))
    return left.withColumn("_r", F.round(F.col(key), digits)).join(right, "_r", "left").drop("_r")


def join_by_metric(features: DataFrame, single: DataFrame, pairs: DataFrame, flat_pairs: DataFrame) -> DataFrame:
    """Coordinates by the metric's class: channels, ordered pairs, or unordered pairs, all keyed by column ``key``.

    One join: the three tables, marked by class, are one dimension.
    """
    metric = F.lower("metric")
    kind = F.when(metric.isin(*ORDERED), "ordered").when(metric.isin(*UNORDERED), "unordered").otherwise("single")
    tables = (("single", single), ("ordered", pairs), ("unordered", flat_pairs))
    dim = None
    for name, t in tables:
        t = t.withColumn("_kind", F.lit(name))
        dim = t if dim is None else dim.unionByName(t, allowMissingColumns=True)
    return features.withColumn("_kind", kind).join(dim, ["_kind", "key"], "left").drop("_kind")


def level_map(df: DataFrame, display: str, covariate: str, levels: Sequence[str] = (), how: str = "median") -> DataFrame:
    """Median or mean of a covariate for each level (all, or those listed: NULL for one without values)."""
    stat = F.median if how == "median" else F.avg
    out = df.groupBy(display).agg(stat(covariate).alias(covariate))
    if not levels:
        return out
    wanted = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(levels)], f"`{display}` string, place int")
    return wanted.join(out, display, "left")


# Result tables


def summary_columns(df: DataFrame) -> DataFrame:
    """One spelling of interval and mean columns of model summaries: lower.CL, upper.CL, emmean."""
    for low, high in (("asymp.LCL", "asymp.UCL"), ("lower", "upper")):
        if low in df.columns:
            df = df.withColumnsRenamed({low: "lower.CL", high: "upper.CL"})
            break
    return df.withColumnRenamed("response", "emmean") if "response" in df.columns and "emmean" not in df.columns else df


def post_hoc_rows(df: DataFrame, p: str, context: Mapping[str, object] | None = None) -> DataFrame:
    """group1, group2, p.value, stars and context columns of a pairwise test, other columns behind them."""
    df = df.withColumnsRenamed({a: b for a, b in (("A", "group1"), ("B", "group2")) if a in df.columns and b not in df.columns})
    if not {"group1", "group2"} <= set(df.columns):
        raise ValueError("the table has no group1 and group2")
    number = F.col(f"`{p}`").try_cast("double")
    out = df.withColumns({"p.value": number, "stars": S.stars(number), **{k: F.lit(v) for k, v in (context or {}).items()}})
    first = ["group1", "group2", "p.value", "stars", *(context or {})]
    return out.select(*(f"`{c}`" for c in [*first, *(c for c in out.columns if c not in first)]))


def plot_values(cells: DataFrame, keys: Sequence[str], mode: str, ranges: Sequence[tuple[float, float]], norm: str) -> DataFrame:
    """Values transformed, then against each row's own baseline span."""
    return T.normalize_by_span(cells.withColumn("value", T.transform(F.col("value"), mode)), keys, ranges, norm)


def normalise_filled(cells: DataFrame, keys: Sequence[str], ranges: Sequence[tuple[float, float]], mode: str) -> DataFrame:
    """Span baselines of trace-like cells; cells without any value keep one row of their keys, with NULL elsewhere."""
    empty = F.count("value").over(Window.partitionBy(*keys)) == 0
    marked = cells.withColumn("_empty", empty)
    gone = marked.where("_empty").select(*keys).distinct()
    return T.normalize_by_span(marked.where(~F.col("_empty")).drop("_empty"), keys, ranges, mode).unionByName(gone, allowMissingColumns=True)


# Cohort tables


def merged_table(features: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """The eleven merged columns of feature rows that have a region and a value.

    features: subject, metric, channel, mni_x, mni_y, mni_z, phase, band, value and the flags snr_in, stn_in (single
    channels) and mixed_in, snr_pair_in, stn_pair_in, reverse_in (pairs; reverse counts for ordered metrics).
    """
    metric = F.lower("metric")
    pair = metric.isin(*ORDERED, *UNORDERED)
    mixed = [F.col(c) for c in ("mixed_in", "snr_pair_in", "stn_pair_in")]
    region = F.when(metric.isin(*ORDERED), H.region_pair(*mixed, F.col("reverse_in"))).when(pair, H.region_pair(*mixed)).otherwise(H.region_single(F.col("snr_in"), F.col("stn_in")))
    side = F.when(pair, H.side_of(F.col("channel"), left, right, True)).otherwise(H.side_of(F.col("channel"), left, right))
    df = features.withColumns({"_region": region, "_side": side})
    phase, lat = H.parse_phase(F.col("phase"), F.col("_side"))
    out = df.where(F.col("_region").isNotNull() & F.col("value").isNotNull())
    return out.select(F.col("subject").alias("Subject"), F.col("channel").alias("Channel"), F.col("_side").alias("Side"), F.col("mni_x").alias("MNI_x"), F.col("mni_y").alias("MNI_y"), F.col("mni_z").alias("MNI_z"), F.col("_region").alias("Region"), F.col("band").alias("Band"), phase.alias("Phase"), lat.alias("Lat"), F.col("value").alias("Value"))


def long_traces(cells: DataFrame, keys: Sequence[str], lat: str = "lat", smooth: bool = True) -> DataFrame:
    """Shifted cycle traces as long rows: keys, t_pct, value; filled around the circle, smoothed, in blocks of five.

    A laterality other than Contra (NULL passes) and an empty required key are errors.
    """
    wrong = F.col(lat).isNotNull() & (F.col(lat) != "Contra")
    checked = cells.withColumn("value", F.when(wrong, F.raise_error(F.lit("a trace is not Contra")).cast("double")).otherwise(F.col("value")))
    for k in keys:
        text = F.when(F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == ""), F.raise_error(F.lit(f"{k} is empty")).cast("string")).otherwise(F.col(k).cast("string"))
        checked = checked.withColumn(k, text)
    filled = H.circular_fill(checked.select(*keys, "t_pos", "value"), keys)
    if smooth:
        filled = H.circular_lowess(filled, keys).withColumn("value", F.col("smooth")).drop("smooth")
    return H.block_downsample(filled, keys).select(*keys, "t_pct", "value")


def cohort_coordinates(channels: DataFrame) -> DataFrame:
    """Channel coordinates of all subjects with their region label, numbered by subject and channel numbers."""
    out = channels.withColumn("region", H.region_label(F.col("snr_in"), F.col("stn_in")))
    order = Window.partitionBy("subject").orderBy(*H.channel_order(F.col("channel")))
    return out.withColumn("place", F.row_number().over(order) - 1).select("subject", "channel", "mni_x", "mni_y", "mni_z", "region", "place")


def subject_example(cells: DataFrame, subject: str, start: float, end: float, phases: Sequence[str]) -> DataFrame:
    """One subject's cells in log10, cut to a closed time window, rows ordered by channel and phase."""
    own = cells.where(F.col("subject") == subject)
    cut = C.crop(own.withColumn("value", T.transform(F.col("value"), "log10")), start, end)
    rows = example_order(cut.select("channel", "phase", "row_id", "ord").distinct(), phases)
    return cut.join(rows.select("row_id", "place"), "row_id")


# Signals


def remove_bad_spans(samples: DataFrame, marks: DataFrame, keys: Sequence[str], width: int = 0, prefixes: Sequence[str] = REMOVED) -> tuple[DataFrame, DataFrame]:
    """(samples on the closed timeline, annotations there): spans with a removal label go, with edges at both ends.

    marks: keys, start, end (samples, end exclusive), description. Overlapping annotations lose the removed part; the
    removal marks themselves go. new_idx numbers the samples that stay.
    """
    bad = marks.where(is_bad(F.col("description"), prefixes)).select(*keys, "start", "end")
    kept = I.remove_and_close(samples, bad, keys)
    left = I.compress_annotations(marks.where(~is_bad(F.col("description"), prefixes)).select(*keys, "start", "end", "description"), bad, keys)
    ends = I.edges(kept, keys, "new_idx", width).select(*keys, "start", "end", "description")
    return kept, left.unionByName(ends)


def split_annotations(marks: DataFrame, bad: DataFrame, keys: Sequence[str], how: str = "split") -> DataFrame:
    """Annotations on the closed timeline: cut at removed spans ("split"), dropped where they meet one ("drop") or "compress"ed."""
    if how == "compress":
        return I.compress_annotations(marks, bad, keys)
    return I.compress_annotations(I.subtract(marks, I.union_intervals(bad, keys), keys, how == "split"), bad, keys)


def raw_power(signal: DataFrame, keys: Sequence[str], rate: float, freqs: Sequence[float], n_cycles: Sequence[float], notches: Sequence[tuple[float, float]] = (), marks: DataFrame | None = None, hop: int = 1, method: str = "morlet") -> DataFrame:
    """Power tensor: keys, freq, sample_idx, value. Bins within a notch (centre, width) are not computed but interpolated in dB.

    marks: keys, start, end in samples; values closer to one than their frequency's kernel reaches are NULL.
    """
    inside = [any(abs(f - c) <= w / 2 for c, w in notches) for f in freqs]
    kept = [(f, c) for f, c, out in zip(freqs, n_cycles, inside) if not out]
    cut = [f for f, out in zip(freqs, inside) if out]
    if not kept:
        raise ValueError("every frequency lies within a notch")
    build = G.morlet if method == "morlet" else G.multitaper
    power = build(signal, keys, rate, [f for f, _ in kept], [c for _, c in kept], hop=hop).select(*keys, "freq", "sample_idx", F.col("power").alias("value"))
    if cut:
        # The first bin's rows carry those of the bins left out, so power is computed once.
        own = F.struct(F.col("freq").alias("f"), F.col("value").alias("v"))
        holes = [F.struct(F.lit(float(f)).alias("f"), F.lit(None).cast("double").alias("v")) for f in cut]
        bins = F.when(F.col("freq") == float(kept[0][0]), F.array(own, *holes)).otherwise(F.array(own))
        power = power.select(*keys, "sample_idx", F.explode(bins).alias("_o")).select(*keys, F.col("_o.f").alias("freq"), "sample_idx", F.col("_o.v").alias("value"))
        power = X.interpolate_in(power, [*keys, "sample_idx"], "db", "freq")
    if marks is None:
        return power
    spark = signal.sparkSession
    radii = spark.createDataFrame([(float(f), float(c)) for f, c in zip(freqs, n_cycles)], "freq double, cycles double")
    radii = radii.select("freq", (X.mask_radius(F.col("freq"), F.col("cycles"), method) * rate).alias("radius"))
    return I.mask_by_radius(power, marks, radii, keys, "sample_idx", "freq", "value")


def decompose(power: DataFrame, keys: Sequence[str], sub_grid: Sequence[float] = (), sigma: float = 1.5, kernel: int = 1, least: float = 0.0, hop: int = 1) -> tuple[DataFrame, DataFrame]:
    """(periodic: keys, sample_idx, freq, value; aperiodic: keys, sample_idx, offset, exponent, r2, n) of a power tensor.

    Power is clipped at its key's least positive value, smoothed in dB over frequency (Gaussian) and time (median, over
    frames ``hop`` samples apart), the end values repeated beyond the ends, and split by a log-log line per time. Times whose fit has an R2 below ``least`` are NULL; ``sub_grid`` keeps some bins.
    """
    power = keep(power, "power")  # written, as are the smoothed power and its fits: each is read two times or more
    floor = power.where("value > 0").groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min("value").alias("_floor"))
    on = I.reduce_and([power[k].eqNullSafe(floor[f"_k{i}"]) for i, k in enumerate(keys)])
    clipped = power.join(floor, on, "left").select(*keys, "freq", "sample_idx", F.when(F.col("value").isNotNull(), F.greatest("value", "_floor")).alias("value"))
    db = clipped.withColumn("value", T.transform(F.col("value"), "db"))
    at = [*keys, "sample_idx"]
    db = db.withColumn("f_pos", F.row_number().over(Window.partitionBy(*at).orderBy("freq")) - 1)
    db = X.smooth_gaussian(db, at, sigma, pos="f_pos").withColumn("value", F.col("smooth")).drop("smooth")
    if kernel > 1:
        db = db.withColumn("t_pos", F.floor(F.col("sample_idx") / hop).cast("int"))
        db = X.smooth_median(db, [*keys, "freq"], kernel).withColumn("value", F.col("smooth")).drop("smooth", "t_pos")
    smooth = keep(db.withColumn("power", T.inverse(F.col("value"), "db")).select(*at, "freq", "power"), "smooth")
    fits = keep(G.aperiodic_fit(smooth, at), "fits")
    periodic = G.periodic_part(smooth, fits, at).select(*at, "freq", F.col("periodic").alias("value"))
    periodic = X.quality_mask(periodic, fits, at, least)
    if sub_grid:
        periodic = periodic.where(F.col("freq").isin(*map(float, sub_grid)))
    return periodic, fits


def spectrogram(signal: DataFrame, keys: Sequence[str], rate: float, low: float, high: float, n: int, hop: int = 1, size: int = 65536) -> DataFrame:
    """Mean power over channels on a logarithmic grid, max(2, f / 4) cycles: keys without channel, freq, sample_idx, power."""
    freqs = [low * (high / low) ** (i / max(1, n - 1)) for i in range(n)]
    out = G.morlet(signal, keys, rate, freqs, [max(2.0, f / 4) for f in freqs], hop, size)
    return out.groupBy(*(k for k in keys if k != "channel"), "freq", "sample_idx").agg(F.avg("power").alias("power"))
