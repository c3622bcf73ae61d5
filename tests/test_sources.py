import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import params as Q
from tracewell.operators import packets as P
from tracewell.sources import readers as S
from tracewell.sources import sinks as K


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_channel_csv(spark, tmp_path):
    p = write(tmp_path, "a.csv", "C1,C2,note\n1,2,x\n3,,y\n")
    got = S.read_channel_csv(spark, p, 2.0).orderBy("channel", "sample_idx").collect()
    assert [(r.channel, r.sample_idx, r.t_s, None if r.value is None else round(r.value * 1e6, 6)) for r in got] == [("C1", 0, 0.0, 1.0), ("C1", 1, 0.5, 3.0), ("C2", 0, 0.0, 2.0), ("C2", 1, 0.5, None)]
    for head in ("Time,C1", "C1,C1"):
        with pytest.raises(ValueError):
            S.read_channel_csv(spark, write(tmp_path, f"{len(head)}.csv", f"{head}\n1,2\n"), 1.0)


def test_packet_csv(spark, tmp_path):
    p = write(tmp_path, "p.csv", "vendor line\nPacket Index,CH1,CH1.1,CH2,CH2.1,Tag Code,Tag Index\n0,1,2,5,6,0,0\n2,3,4,7,8,0x10,6\n")
    samples, tags = S.read_packet_csv(spark, p, 250.0)
    assert sorted((r.packet, r.channel, r.pos, r.value) for r in samples.collect())[:3] == [(0, "CH1", 0, 1.0), (0, "CH1", 1, 2.0), (0, "CH2", 0, 5.0)]
    assert [(r.packet, r.code, r.pos) for r in tags.collect()] == [(2, 16, 1)]


def test_session_json(spark, tmp_path):
    e = lambda ch, rate: {"FirstPacketDateTime": "2020-01-01T00:00:00.000Z", "SampleRateInHz": rate, "Channel": ch, "TimeDomainData": [1.0, 2.0]}
    p = write(tmp_path, "s.json", json.dumps({"TimeDomain": [e("ZERO_THREE_LEFT", 250), e("ONE_THREE_RIGHT", 250)]}))
    df = S.read_session_json(spark, p)
    assert df.count() == 4 and {r.channel for r in df.collect()} == {"0_3_L", "1_3_R"}
    assert [r.channel for r in S.channels_in_order(df).collect()] == ["0_3_L", "1_3_R"]
    bad = write(tmp_path, "b.json", json.dumps({"TimeDomain": [e("A", 250), e("B", 500)]}))
    with pytest.raises(ValueError):
        S.read_session_json(spark, bad)


def test_sidecars_and_markers(spark, tmp_path):
    p = write(tmp_path, "m.txt", "Version: 1.2\nRate: 500 Hz\n")
    assert {r.key: r.value for r in S.read_sidecar(spark, p).collect()} == {"Version": "1.2", "Rate": "500 Hz"}
    q = write(tmp_path, "x.txt", "[FFT]\na\n\n[Start Time]\nb\n")
    assert sorted((r.section, r.line) for r in S.read_sections(spark, q).collect()) == [("FFT", "a"), ("Start Time", "b")]
    m = write(tmp_path, "k.csv", "Duration,source,SN\n00:00:01.5,app one,7\n")
    r = S.read_clock_markers(spark, m, 2.0).first()
    assert (r.onset_s, r.description) == (3.5, "tag_app_one_7")
    t = write(tmp_path, "t.csv", "time_s\n3\n1\nx\n1\n")
    assert [(r.id, r.t) for r in S.read_marker_times(spark, t).orderBy("t").collect()] == [(0, 1.0), (1, 3.0)]


def test_annotations(spark, tmp_path):
    p = write(tmp_path, "ann.csv", "description,onset,duration\n b ,2,1\na,1,0\n")
    assert [(r.description, r.onset_s, r.end_s) for r in S.read_annotations(spark, p).collect()] == [("a", 1.0, 1.0), ("b", 2.0, 3.0)]
    with pytest.raises(ValueError):
        S.read_annotations(spark, write(tmp_path, "bad.csv", "description,onset,duration\na,-1,0\n"))


def test_numbered_packets(spark, tmp_path):
    p = write(tmp_path, "n.csv", "Packet num,Packet length,CH1_a\n0,2,1\n0,2,2\n1,2,3\n")
    df = S.read_numbered_csv(spark, p)
    faults = P.check_packets(df, ["file", "channel"], "packet", "row", "declared").collect()
    assert [(r.packet, r.fault) for r in faults] == [(1, "row count")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", "s1", [1.0], 1.0), ("n", "s2", [2.0], 2.0)], "metric string, subject string, v array<double>, value double")
    K.write_features(df, str(tmp_path / "f"))
    K.write_features(df.where("metric = 'm'").withColumn("value", F.lit(9.0)), str(tmp_path / "f"))
    assert {(r.metric, r.value) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {("m", 9.0), ("n", 2.0)}
    K.write_scalars_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).where("v = '[1.0]'").count() == 1
    K.replace_all(spark, {"a": df}, str(tmp_path / "r"))
    K.replace_all(spark, {"a": df.limit(1)}, str(tmp_path / "r"))
    assert K.current(spark, "a", str(tmp_path / "r")).count() == 1
    marks = spark.createDataFrame([(0, 1.0), (1, 2.0)], "id int, t double")
    pairs = spark.createDataFrame([(1, 0)], "ref_id int, ext_id int")
    assert {r.id: r.paired for r in K.sync_artifacts(marks, pairs, "ref").collect()} == {0: False, 1: True}
    with pytest.raises(Exception, match="missing marker"):
        P.pair_markers(spark.createDataFrame([(5, 0)], "ref_id int, ext_id int"), marks, marks).collect()


def test_inventory_and_params(spark, tmp_path):
    df = spark.createDataFrame([("s", "r", "t", 1.0)], "subject string, record string, trial string, value double")
    df.write.partitionBy("subject", "record", "trial").parquet(str(tmp_path / "i"))
    inv = S.inventory(spark, str(tmp_path / "i"))
    assert [(r.subject, r.record, r.trial) for r in inv.collect()] == [("s", "r", "t")]
    m = spark.createDataFrame([("periodic_aperiodic", "done", 1), ("psi", "failed", 2), ("raw", "done", 3)], "metric string, status string, ord int")
    assert [r.metric for r in S.completed_metrics(m).collect()] == ["periodic", "aperiodic", "raw"]
    assert Q.reducers_for("burst", "linear") == ["count", "occupation", "rate", "duration"]
    with pytest.raises(ValueError):
        Q.reducers_for("raw_power", "linear", ["rate"])
    with pytest.raises(ValueError):
        Q.check_frequencies(1, 200, 250)
