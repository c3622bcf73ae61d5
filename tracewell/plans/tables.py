"""The driver's tables as signals, annotations and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import cells as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as traces: row_id, grp, t_pos, t_coord, value."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("grp"), "embedding")
    return C.unpack_traces(e, "embedding", "vec_id", ["grp"])


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as annotations in integer microseconds: rec, id, label, start, end (k half hours long), value."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("rec"), F.col("event_id").alias("id"), F.col("event_type").alias("label"), us.alias("start"), (us + k * 1800000000).alias("end"), "value")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, with -0 as 0, so that engines agree on their text."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})
