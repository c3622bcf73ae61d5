"""Streams against the batch result on a finite source."""

import pytest
from pyspark.sql import functions as F

from tracewell.streaming import live


@pytest.fixture
def packets(spark, tmp_path):
    rows = [("d", n, f"2024-01-01 00:00:{n:02d}", float(n % 3)) for n in (0, 1, 1, 4, 5, 9)] + [("e", n, f"2024-01-01 00:00:{n:02d}", 5.0) for n in (3, 4)]
    df = spark.createDataFrame(rows, "device string, packet long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def drain(spark, df, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql("select * from out").collect()


def test_gaps(spark, packets, tmp_path):
    assert sorted((r.device, r["first"], r["last"]) for r in drain(spark, live.packet_gaps(packets), tmp_path)) == [("d", 2, 3), ("d", 6, 8)]


def test_repeats(spark, packets, tmp_path):
    assert len(drain(spark, live.drop_repeats(packets), tmp_path)) == 7


def test_quality(spark, packets, tmp_path):
    got = live.window_quality(packets, "10 seconds", 0, 1, key="device")
    rows = drain(spark, got, tmp_path, "update")
    assert {(r.device, r.bad) for r in rows} == {("d", True), ("e", False)}


def test_sessions(spark, packets, tmp_path):
    got = drain(spark, live.activity_sessions(packets, 4.0, "3 seconds", key="device"), tmp_path, "append")
    assert isinstance(got, list)
