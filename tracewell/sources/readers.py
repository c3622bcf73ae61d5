"""Readers of recordings, markers and annotations. Every reader returns long tables and reads with Spark alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.cohort import normalise_channel
from tracewell.operators.ordering import numbered
from tracewell.operators.packets import tag_code, unit_scale



def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number in the file: file, n (from 0), line. One file is one row of input until it is cut."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("v"))
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("v", "\n$", ""), "\n")).alias("n", "line"))


def read_channel_csv(spark: SparkSession, path: str, rate: float, unit: str = "uV", numeric_only: bool = True) -> DataFrame:
    """One numeric column per channel, no time column: file, channel, sample_idx, t_s, value (volts).

    A column named Time and repeated names are errors; a column with a cell that is no number is left out.
    """
    lines = numbered_lines(spark, path)
    cells = lines.select("file", "n", F.split("line", ",").alias("c"))
    head = cells.where("n = 0").select("file", F.transform("c", lambda x: F.trim(F.regexp_replace(x, '"', ""))).alias("names"))
    bad = head.where(F.exists("names", lambda x: F.lower(x) == "time") | (F.size(F.array_distinct("names")) != F.size("names")))
    if not bad.isEmpty():
        raise ValueError("a channel table has no Time column and no repeated names")
    long = cells.where("n > 0").join(F.broadcast(head), "file").select("file", (F.col("n") - 1).cast("long").alias("sample_idx"), F.explode(F.arrays_zip("names", "c")).alias("z"))
    long = long.select("file", F.col("z.names").alias("channel"), "sample_idx", F.nullif(F.trim("z.c"), F.lit("")).alias("text"))
    long = long.withColumn("value", F.col("text").try_cast("double"))
    if numeric_only:
        wrong = long.groupBy("file", "channel").agg(F.max((F.col("text").isNotNull() & F.col("value").isNull()).cast("int")).alias("w")).where("w = 1")
        long = long.join(F.broadcast(wrong), ["file", "channel"], "left_anti")
    return long.select("file", "channel", "sample_idx", (F.col("sample_idx") / rate).alias("t_s"), unit_scale(F.col("value"), F.lit(unit)).alias("value"))


def read_packet_csv(spark: SparkSession, path: str, rate: float, index: str = "Packet Index") -> tuple[DataFrame, DataFrame]:
    """Wide packet table: (samples, tags).

    The header is the first line that names the index column. Columns CHn, CHn.k and CHn_k are channel n's block in
    order of k; samples: file, packet, channel, pos, value. tags: file, packet, code, pos from Tag Code and Tag Index
    (milliseconds), zero codes left out.
    """
    cells = numbered_lines(spark, path).select("file", "n", F.transform(F.split("line", ","), lambda x: F.trim(F.regexp_replace(x, '"', ""))).alias("c"))
    head = cells.where(F.array_contains("c", index)).groupBy("file").agg(F.min_by("c", "n").alias("names"), F.min("n").alias("h"))
    rows = cells.join(F.broadcast(head), "file").where("n > h").select("file", "n", F.map_from_entries(F.filter(F.arrays_zip(F.col("names").alias("k"), F.col("c").alias("v")), lambda z: z.k.isNotNull() & (z.k != ""))).alias("m"))
    rows = rows.withColumn("packet", F.col("m")[index].try_cast("long")).where("packet is not null")
    field = rows.select("file", "packet", F.explode(F.map_entries("m")).alias("z"))
    name = r"^CH(\d+)(?:[._](\d+))?$"
    blocks = field.where(F.col("z.key").rlike(name)).select("file", "packet", F.concat(F.lit("CH"), F.regexp_extract("z.key", name, 1)).alias("channel"), F.coalesce(F.regexp_extract("z.key", name, 2).try_cast("int"), F.lit(0)).alias("k"), F.col("z.value").try_cast("double").alias("value"))
    w = Window.partitionBy("file", "packet", "channel").orderBy("k")
    samples = blocks.select("file", "packet", "channel", (F.row_number().over(w) - 1).alias("pos"), "value")
    size = blocks.groupBy("file").agg(F.countDistinct("k").alias("size"))
    tags = rows.where(F.col("m")["Tag Code"].isNotNull()).select("file", "packet", tag_code(F.col("m")["Tag Code"]).alias("code"), F.col("m")["Tag Index"].try_cast("double").alias("ms"))
    tags = tags.where("code is not null and code <> 0").join(F.broadcast(size), "file")
    pos = F.greatest(F.lit(0), F.least(F.col("size") - 1, F.ceil(F.col("ms") * rate / 1000) - 1))
    return samples, tags.select("file", "packet", "code", pos.cast("int").alias("pos"))


def read_session_json(spark: SparkSession, path: str, entry: str = "TimeDomain") -> DataFrame:
    """Session documents with a list of time-domain entries: file, entry, channel, start (UTC), rate, sample_idx, value (volts).

    One sampling rate per file, else an error. Samples are in microvolts.
    """
    item = "struct<FirstPacketDateTime: string, SampleRateInHz: double, Channel: string, TimeDomainData: array<double>>"
    docs = spark.read.schema(f"`{entry}` array<{item}>").json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode(entry).alias("entry", "e"))
    rates = docs.groupBy("file").agg(F.countDistinct("e.SampleRateInHz").alias("k")).where("k > 1")
    if not rates.isEmpty():
        raise ValueError("a session has several sampling rates")
    out = docs.select("file", "entry", normalise_channel(F.col("e.Channel")).alias("channel"), F.to_timestamp("e.FirstPacketDateTime").alias("start"), F.col("e.SampleRateInHz").alias("rate"), F.posexplode("e.TimeDomainData").alias("sample_idx", "v"))
    return out.select("file", "entry", "channel", "start", "rate", F.col("sample_idx").cast("long").alias("sample_idx"), (F.col("v") * 1e-6).alias("value"))


def channels_in_order(session: DataFrame) -> DataFrame:
    """Channels by their first entry."""
    return session.groupBy("file", "channel").agg(F.min("entry").alias("first")).orderBy("file", "first")


def read_numbered_csv(spark: SparkSession, path: str, packet: str = "Packet num", length: str = "Packet length") -> DataFrame:
    """Rows of a packet-numbered table: file, row, packet, declared, channel, value. ``packets.check_packets`` finds its faults."""
    df = spark.read.csv(path, header=True)
    cols = {c.strip(): c for c in df.columns}
    channels = [c for c in cols if c.upper().startswith("CH")]
    df = df.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"), F.col(f"`{cols[packet]}`").try_cast("long").alias("packet"), F.col(f"`{cols[length]}`").try_cast("long").alias("declared"), *(F.col(f"`{cols[c]}`").try_cast("double").alias(c) for c in channels))
    return df.unpivot(["file", "row", "packet", "declared"], channels, "channel", "value")


def read_sidecar(spark: SparkSession, path: str, sep: str = ":") -> DataFrame:
    """Key and value lines of a sidecar: file, key, value."""
    parts = F.split("line", sep, 2)
    return numbered_lines(spark, path).where(F.size(parts) == 2).select("file", F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a sidecar in [Section] blocks: file, section, n, line."""
    lines = numbered_lines(spark, path)
    name = F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1)
    w = Window.partitionBy("file").orderBy("n")
    out = lines.withColumn("section", F.last(F.nullif(name, F.lit("")), ignorenulls=True).over(w))
    return out.where((name == "") & (F.trim("line") != "") & F.col("section").isNotNull()).select("file", "section", "n", "line")


def clock_seconds(text) -> F.Column:
    """HH:MM:SS.f as seconds."""
    p = F.split(text, ":")
    return F.when(F.size(p) == 3, p[0].try_cast("double") * 3600 + p[1].try_cast("double") * 60 + p[2].try_cast("double"))


def read_clock_markers(spark: SparkSession, path: str, offset_s: float = 0.0) -> DataFrame:
    """Duration, source, SN rows as annotations: file, onset_s, duration_s (0), description ``tag_<source>_<sn>``."""
    df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    on = clock_seconds(F.col("Duration")) + offset_s
    label = F.concat_ws("_", F.lit("tag"), F.regexp_replace("source", r"\s+", "_"), "SN")
    return df.select(F.input_file_name().alias("file"), on.alias("onset_s"), F.lit(0.0).alias("duration_s"), label.alias("description")).where("onset_s is not null")


def clean_annotations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, row numbers of bad ones): labels are stripped and not empty, numbers not negative."""
    d = df.withColumns({"description": F.trim("description"), "onset_s": F.col("onset").try_cast("double"), "duration_s": F.col("duration").try_cast("double")})
    ok = (F.coalesce(F.col("description"), F.lit("")) != "") & (F.coalesce("onset_s", F.lit(-1.0)) >= 0) & (F.coalesce("duration_s", F.lit(-1.0)) >= 0)
    good = d.where(ok).select("row", "onset_s", "duration_s", (F.col("onset_s") + F.col("duration_s")).alias("end_s"), "description")
    return good, d.where(~ok).select("row")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """description, onset, duration rows by onset; one bad row fails the load."""
    df = spark.read.csv(path, header=True).withColumn("row", F.monotonically_increasing_id())
    good, bad = clean_annotations(df)
    if not bad.isEmpty():
        raise ValueError("an annotation row is not valid")
    return good.orderBy("onset_s")


def read_marker_times(spark: SparkSession, path: str) -> DataFrame:
    """One column of seconds: numbers only, unique, ascending: id, t. Negative times are an error."""
    t = spark.read.text(path).select(F.trim("value").try_cast("double").alias("t")).where("t is not null and not isnan(t)").distinct()
    if not t.where("t < 0").isEmpty():
        raise ValueError("marker times are not negative")
    return numbered(t, ["t"], "id").select((F.col("id") - 1).alias("id"), "t")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files of feature tables below ``root`` in subject=/record=/trial= folders: subject, record, trial, path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")
    part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]+)/", 1)
    return files.select(part("subject").alias("subject"), part("record").alias("record"), part("trial").alias("trial"), "path").where("record <> ''")


def tables_of(inv: DataFrame, exclude: Sequence[str] = ("_summary", "_trans", "_normalized", "_shift"), name: str | None = None) -> DataFrame:
    """Rows whose path holds no derived suffix, and the name if given."""
    out = inv
    for suffix in exclude:
        out = out.where(~F.regexp_replace("path", r"/[^/]*$", "").endswith(suffix))
    return out.where(F.contains("path", F.lit(name))) if name else out


def completed_metrics(metrics: DataFrame, composite: str = "periodic_aperiodic") -> DataFrame:
    """Metrics whose status is done, the composite replaced by its parts (aperiodic after periodic), in order."""
    done = metrics.where("status = 'done'").select("metric", F.col("ord").cast("double").alias("ord"))
    parts = F.when(F.col("metric") == composite, F.array(F.struct(F.lit("periodic").alias("m"), F.lit(0.0).alias("d")), F.struct(F.lit("aperiodic").alias("m"), F.lit(0.5).alias("d")))).otherwise(F.array(F.struct(F.col("metric").alias("m"), F.lit(0.0).alias("d"))))
    return done.select(F.explode(parts).alias("p"), "ord").select(F.col("p.m").alias("metric"), (F.col("ord") + F.col("p.d")).alias("ord")).orderBy("ord")


def read_cohort(spark: SparkSession, path: str, schema: str, required: Sequence[str], value: str = "value") -> DataFrame:
    """Cohort CSV by an explicit schema; required columns must exist, rows without a value go."""
    df = spark.read.schema(schema).csv(path, header=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.where(F.col(value).isNotNull() & ~F.isnan(value))


