"""Packet repair, clocks and synchronisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.intervals import meet


def drop_duplicated(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Packets whose index occurs once; of a duplicated index no copy is kept."""
    n = F.count("*").over(Window.partitionBy(*keys, index))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def missing_ranges(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Missing index ranges between a key's first and last packet: keys, first, last, n."""
    nxt = F.lead(index).over(Window.partitionBy(*keys).orderBy(index))
    out = df.select(*keys, (F.col(index) + 1).alias("first"), (nxt - 1).alias("last")).where("last >= first")
    return out.withColumn("n", F.col("last") - F.col("first") + 1)


def fill_missing(df: DataFrame, keys: Sequence[str], index: str, value: str, fill: float = 0.0) -> DataFrame:
    """Rows of all indexes from first to last, missing ones with ``fill`` and filled = true."""
    holes = missing_ranges(df.select(*keys, index).distinct(), keys, index)
    new = holes.select(*keys, F.explode(F.sequence("first", "last")).alias(index), F.lit(fill).alias(value), F.lit(True).alias("filled"))
    return df.select(*keys, index, value, F.lit(False).alias("filled")).unionByName(new)


def gap_annotations(holes: DataFrame, keys: Sequence[str], packet_s: float) -> DataFrame:
    """BAD_gap spans in seconds of missing ranges, packet 0 starting at 0."""
    return holes.select(*keys, (F.col("first") * packet_s).alias("start"), ((F.col("last") + 1) * packet_s).alias("end"), F.lit("BAD_gap").alias("description"))


def mode_length(df: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    """Most frequent length per key, ties to the longer."""
    n = df.groupBy(*keys, length).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max_by(length, F.struct("_n", length)).alias("mode_length")) if keys else n.agg(F.max_by(length, F.struct("_n", length)).alias("mode_length"))


def sample_cursor(packets: DataFrame, keys: Sequence[str], index: str, length: str, first: int = 0) -> DataFrame:
    """Start sample of each packet when missing packets (from ``first`` on) are filled with the mode length."""
    modes = mode_length(packets, keys, length)
    w = Window.partitionBy(*keys).orderBy(index)
    lost = F.col(index) - F.coalesce(F.lag(index).over(w) + 1, F.lit(first))
    out = meet(packets, modes, keys) if keys else packets.crossJoin(F.broadcast(modes))
    out = out.withColumn("lost", lost)
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum(F.col("lost") * F.col("mode_length")).over(w)
    return out.withColumn("start_sample", before).drop("mode_length")


def check_packets(df: DataFrame, keys: Sequence[str], packet: str, order: str, declared: str) -> DataFrame:
    """Faults of packets: row count unlike the declared length, declared length not constant, number going back."""
    counts = df.groupBy(*keys, packet).agg(F.count("*").alias("n"), F.min(declared).alias("lo"), F.max(declared).alias("hi"))
    bad = counts.select(*keys, packet, F.when(F.col("lo") != F.col("hi"), "length varies").when(F.col("n") != F.col("lo"), "row count").alias("fault")).where("fault is not null")
    back = df.withColumn("_p", F.lag(packet).over(Window.partitionBy(*keys).orderBy(order))).where(F.col(packet) < F.col("_p")).select(*keys, packet, F.lit("number goes back").alias("fault")).distinct()
    return bad.unionByName(back)


def run_timeline(runs: DataFrame, keys: Sequence[str], start_us: str, n: str, rate: float) -> DataFrame:
    """Start sample of each run from its clock, and the gap before it; an overlap is an error."""
    w = Window.partitionBy(*keys).orderBy(start_us)
    first = F.min(start_us).over(Window.partitionBy(*keys))
    at = F.bround((F.col(start_us) - first) * rate / 1e6).cast("long")
    out = runs.withColumn("start_sample", at)
    before = F.lag(F.col("start_sample") + F.col(n)).over(w)
    out = out.withColumn("gap", F.col("start_sample") - F.coalesce(before, F.lit(0)))
    return out.withColumn("gap", F.when(F.col("gap") < 0, F.raise_error(F.lit("runs overlap")).cast("long")).otherwise(F.col("gap")))


def tag_position(code: Column, ms: Column, rate: float, block: int) -> Column:
    """Position in a packet's block of a tag given in milliseconds, within the block."""
    return F.greatest(F.lit(0), F.least(F.lit(block - 1), F.ceil(ms * rate / 1000) - 1))


def tag_code(text: Column) -> Column:
    """A tag code written in hex (0x..) or decimal."""
    return F.when(text.rlike("^0[xX][0-9A-Fa-f]+$"), F.conv(F.substring(text, 3, 18), 16, 10).try_cast("long")).otherwise(text.try_cast("double").try_cast("long"))


def local_to_utc(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_utc_timestamp(ts, zone)


def median_lag(pairs: DataFrame, keys: Sequence[str], a: str = "ref_s", b: str = "ext_s") -> DataFrame:
    """Lag as the median of differences, with the root mean square of what remains."""
    lag = F.median(F.col(a) - F.col(b)).over(Window.partitionBy(*keys))
    return pairs.withColumn("_l", lag).groupBy(*keys).agg(F.first("_l").alias("lag"), F.sqrt(F.avg(F.pow(F.col(a) - F.col(b) - F.col("_l"), 2))).alias("rmse"), F.count("*").alias("n"))


def rate_fit(pairs: DataFrame, keys: Sequence[str], sample: str = "sample_idx", t: str = "ext_s") -> DataFrame:
    """Least squares of sample index on external time: rate (slope), lag (intercept / slope), r2 (at least 0).

    Keys with fewer than two pairs are an error.
    """
    out = pairs.groupBy(*keys).agg(F.regr_slope(sample, t).alias("rate"), F.regr_intercept(sample, t).alias("_i"), F.greatest(F.lit(0.0), F.regr_r2(sample, t)).alias("r2"), F.count("*").alias("n"))
    out = out.withColumn("n", F.when(F.col("n") < 2, F.raise_error(F.lit("at least two marker pairs are needed")).cast("long")).otherwise(F.col("n")))
    return out.select(*keys, "rate", F.try_divide("_i", "rate").alias("lag"), "r2", "n")


def apply_sync(events: DataFrame, lag: float, ratio: float, length: float, t: str = "t") -> DataFrame:
    """Times shifted and rescaled; those outside the record go."""
    return events.withColumn(t, (F.col(t) + lag) * ratio).where(F.col(t).between(0, length))


def sync_samples(signal: DataFrame, keys: Sequence[str], lag: float, rate: float, idx: str = "sample_idx", value: str = "value") -> DataFrame:
    """Samples on the clock of a synchronised record: the first lag * rate (halves to even) are cut off, or with a negative lag as many zeros stand before them.

    A record that would be cut off whole is an error. Columns but keys, idx and value are dropped.
    """
    if rate <= 0:
        raise ValueError("the rate is above 0")
    shift = round(lag * rate)
    moved = signal.select(*keys, F.col(idx).cast("long").alias(idx), value)
    if shift >= 0:
        if not moved.groupBy(*keys).agg(F.max(idx).alias("_m")).where(F.col("_m") < shift).isEmpty():
            raise ValueError("the lag cuts off a whole record")
        return moved.where(F.col(idx) >= shift).withColumn(idx, F.col(idx) - shift)
    zeros = moved.select(*keys).distinct().withColumn(idx, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-shift - 1).cast("long"))))
    return moved.withColumn(idx, F.col(idx) - shift).unionByName(zeros.withColumn(value, F.lit(0.0).cast(dict(signal.dtypes)[value])))


def sync_annotations(annotations: DataFrame, lag: float, before: float, after: float, length: float) -> DataFrame:
    """Annotations (start, end in seconds) of a record whose rate turned out to be ``after`` instead of ``before``, moved by the lag; those that start outside 0 and ``length`` go."""
    scale = before / after
    out = annotations.withColumns({"start": F.col("start") * scale - lag, "end": F.col("end") * scale - lag})
    return out.where(F.col("start").between(0, length))


def pair_markers(pairs: DataFrame, ref: DataFrame, ext: DataFrame) -> DataFrame:
    """Explicit pairs (ref_id, ext_id) with the times of both markers; a missing marker is an error."""
    out = pairs.join(ref.select(F.col("id").alias("ref_id"), F.col("t").alias("ref_s")), "ref_id", "left").join(ext.select(F.col("id").alias("ext_id"), F.col("t").alias("ext_s")), "ext_id", "left")
    fail = F.raise_error(F.lit("a pair names a missing marker")).cast("double")
    return out.withColumns({c: F.when(F.col(c).isNull(), fail).otherwise(F.col(c)) for c in ("ref_s", "ext_s")})


def seed_markers(annotations: DataFrame, keys: Sequence[str], t: str, label: str) -> DataFrame:
    """Markers from annotations that are not BAD_: numbered by (time, label) from 0, empty labels named."""
    w = Window.partitionBy(*keys).orderBy(t, label)
    out = annotations.where(~F.coalesce(F.col(label).startswith("BAD_"), F.lit(False))).withColumn("number", F.row_number().over(w) - 1)
    return out.withColumn(label, F.coalesce(F.nullif(F.trim(F.col(label)), F.lit("")), F.concat(F.lit("marker_"), F.col("number"))))


def sampling_rate(times: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """1 / the median positive step."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    return times.withColumn("_s", step).where("_s > 0").groupBy(*keys).agg((1 / F.median("_s")).alias("rate"))


def window_range(df: DataFrame, keys: Sequence[str], t: str, width: float, low: float, high: float, value: str = "value", channel: str = "channel") -> DataFrame:
    """Peak-to-peak by fixed window: bad if any channel's range leaves [low, high]."""
    p2p = df.groupBy(*keys, channel, F.floor(F.col(t) / width).alias("win")).agg((F.max(value) - F.min(value)).alias("p2p"))
    return p2p.groupBy(*keys, "win").agg(F.max((F.col("p2p") < low) | (F.col("p2p") > high)).alias("bad"), F.max("p2p").alias("p2p"))


def robust_cut(p2p: DataFrame, keys: Sequence[str], factor: float = 3.0) -> DataFrame:
    """Windows whose range exceeds median + factor * 1.4826 * MAD of their channel."""
    w = Window.partitionBy(*keys)
    med = F.percentile("p2p", 0.5).over(w)
    out = p2p.withColumn("_m", med).withColumn("_mad", F.percentile(F.abs(F.col("p2p") - F.col("_m")), 0.5).over(w))
    return out.withColumn("bad", F.col("p2p") > F.col("_m") + factor * 1.4826 * F.col("_mad")).drop("_m", "_mad")


def rereference(signal: DataFrame, pairs: DataFrame, keys: Sequence[str], at: str, channel: str = "channel", value: str = "value") -> DataFrame:
    """Channels of pairs (name, anode, cathode): anode - cathode; a NULL side gives anode alone or -cathode.

    One pass: samples meet the roles they play (broadcast), then each output sample is a sum of at most two terms.
    A pair whose channel does not exist yields no samples with fewer terms than it names.
    """
    roles = pairs.select("name", F.explode(F.array(F.struct(F.col("anode").alias("ch"), F.lit(1.0).alias("sign")), F.struct(F.col("cathode").alias("ch"), F.lit(-1.0).alias("sign")))).alias("r"), (F.col("anode").isNotNull().cast("int") + F.col("cathode").isNotNull().cast("int")).alias("_need")).select("name", "_need", "r.ch", "r.sign").where("ch is not null")
    met = signal.join(F.broadcast(roles), signal[channel] == roles["ch"])
    out = met.groupBy(*keys, at, "name", "_need").agg(F.sum(F.col(value) * F.col("sign")).alias(value), F.count(value).alias("_n"))
    return out.where("_n = _need").select(*keys, F.col("name").alias(channel), at, value)


def bipolar_name(anode: Column, cathode: Column) -> Column:
    return F.concat_ws("-", anode, cathode)


def unit_scale(value: Column, unit: Column) -> Column:
    """Volts from V, mV and the three spellings of microvolt."""
    table = F.create_map(*(F.lit(x) for kv in (("V", 1.0), ("mV", 1e-3), ("uV", 1e-6), ("µV", 1e-6), ("μV", 1e-6)) for x in kv))
    return value * table[unit]
