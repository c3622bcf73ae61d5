"""Configuration documents, stored versions, surfaces and small parameter rules."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import params
from tracewell.operators import artifacts, statistics, transforms
from tracewell.sources import configs, sinks


def axis_by_hand(value, repeated):
    out, seen = [], set()
    for item in value if isinstance(value, list) else []:
        if not isinstance(item, dict) or not str(item.get("name") or "").strip():
            continue
        name = str(item["name"]).strip()
        try:
            start, end = float(item.get("start")), float(item.get("end"))
        except (TypeError, ValueError):
            continue
        if end <= start or (name in seen and not repeated):
            continue
        seen.add(name)
        out.append((name, start, end))
    return sorted(out, key=lambda r: r[1])


def test_axis_rows(spark, tmp_path):
    bands = [{"name": "beta", "start": 13, "end": 30}, {"name": " alpha ", "start": "8", "end": 13.5}, {"name": "beta", "start": 1, "end": 2}, {"name": "", "start": 1, "end": 2}, {"name": "x", "start": "low", "end": 2}, {"name": "y", "start": 5, "end": 5}, {"name": 7, "start": -1, "end": 0}, "text", 3, None, {"start": 1, "end": 2}, {"name": "z", "start": 9, "end": 8}, {"name": "z", "start": 8, "end": 9}]
    docs = {"a": {"psi": {"bands": bands, "times": bands, "other": bands}, "burst": {"bands": {"name": "beta"}, "times": "none"}, "plv": [1, 2]}, "b": [bands], "c": {"psi": {"bands": []}}}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "d.json").write_text("{ no json")
    rows = configs.axis_rows(configs.read_documents(spark, str(tmp_path))).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault((r.source.rsplit("/", 1)[1], r.metric, r.axis), []).append((r["rank"], r.name, r.start, r.end))
    want = {("a.json", "psi", axis): [(i, *r) for i, r in enumerate(axis_by_hand(bands, axis == "times"))] for axis in ("bands", "times")}
    assert got == want and len(want[("a.json", "psi", "times")]) == len(want[("a.json", "psi", "bands")]) + 1


def test_versions_are_whole_at_every_moment(spark, tmp_path):
    root, table = str(tmp_path / "store"), lambda *rows: spark.createDataFrame(rows, "record string, x int")
    with pytest.raises(ValueError):
        sinks.current(spark, "a", root)
    sinks.replace_all(spark, {"a": table(("r", 1)), "b": table(("q", 2))}, root)
    held = sinks.current(spark, "a", root)
    staged = sinks.stage_version(spark, {"a": table(("r", 10)), "c": table(("s", 3))}, root)
    # Between the two steps a reader finds the version before, whole.
    assert [r.x for r in sinks.current(spark, "a", root).collect()] == [1]
    with pytest.raises(ValueError):
        sinks.current(spark, "c", root)
    sinks.commit_version(spark, staged, root)
    assert [sinks.current(spark, n, root).first().x for n in "abc"] == [10, 2, 3]
    assert held.first().x == 1
    # A version that was staged before a later one was committed does not undo it silently: of one number the greater name wins, whole.
    late, early = (sinks.stage_version(spark, {"a": table(("r", v))}, root) for v in (20, 30))
    for rows in (late, early):
        sinks.commit_version(spark, rows, root)
    assert sinks.current(spark, "a", root).first().x == (20 if late[0][1] > early[0][1] else 30)


def test_renaming_rewrites_the_tables_that_hold_a_record(spark, tmp_path):
    root = str(tmp_path / "store")
    tables = {"a": spark.createDataFrame([("r", 1), ("s", 2), (None, 3)], "record string, x int"), "b": spark.createDataFrame([("q",)], "Record string"), "c": spark.createDataFrame([(5,)], "x int")}
    sinks.replace_all(spark, tables, root)
    before = {n: sinks.current(spark, n, root).inputFiles() for n in "abc"}
    assert sinks.rename_stored(spark, root, "r", "new") == ["a"]
    assert sorted(((r.record, r.x) for r in sinks.current(spark, "a", root).collect()), key=str) == [("new", 1), ("s", 2), (None, 3)]
    assert all(sinks.current(spark, n, root).inputFiles() == before[n] for n in "bc") and sinks.current(spark, "a", root).inputFiles() != before["a"]
    assert sinks.rename_stored(spark, root, "nobody", "x") == []


def test_a_failed_writer_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "store")
    sinks.replace_all(spark, {"a": spark.range(2), "b": spark.range(3)}, root)

    def broken(df, path):
        if path.endswith("/b"):
            raise OSError("disk")
        df.write.parquet(path)

    with pytest.raises(OSError):
        sinks.stage_version(spark, {"a": spark.range(20), "b": spark.range(30)}, root, broken)
    assert sinks.current(spark, "a", root).count() == 2 and sinks.current(spark, "b", root).count() == 3


@pytest.mark.parametrize("how", ["mean", "median"])
def test_surfaces(spark, how):
    rng = np.random.default_rng(6)
    maps = {("g", 0): (range(3), range(4)), ("g", 1): (range(2, 5), range(4)), (None, 2): (range(2), [7])}
    rows = [(k, m, x, y, None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else float(rng.normal())) for (k, m), (xs, ys) in maps.items() for x, y in itertools.product(xs, ys)]
    df = spark.createDataFrame(rows, "k string, map int, t_pos int, f_pos int, value double")
    got = {(r.k, r.t_pos, r.f_pos): r for r in transforms.surface(df, ["k"], how=how, symmetric=True).collect()}
    values = {}
    for k, _, x, y, v in rows:
        values.setdefault((k, x, y), []).extend([] if v is None or np.isnan(v) else [v])
    grid = [("g", x, y) for x in range(5) for y in range(4)] + [(None, x, 7) for x in range(2)]
    assert set(got) == set(grid)
    want = {p: float(getattr(np, how)(values[p])) if values.get(p) else None for p in grid}
    top = max(abs(v) for v in want.values() if v is not None)
    for p in grid:
        assert got[p].n == len(values.get(p, [])) and (got[p].lo, got[p].hi) == (pytest.approx(-top), pytest.approx(top))
        assert got[p].value is None if want[p] is None else got[p].value == pytest.approx(want[p])
    assert transforms.surface(df, ["k"], low=-3, high=4).select("lo", "hi").distinct().first() == (-3.0, 4.0)
    nothing = transforms.surface(df.withColumn("value", F.lit(None).cast("double")), ["k"])
    assert nothing.select("lo", "hi").distinct().first() == (0.0, 1.0) and nothing.count() == 22
    with pytest.raises(ValueError):
        transforms.surface(df, ["k"], how="mode")


def test_bins_of_the_lag_model():
    assert [params.lag_bins(n, 100) for n in (0, 1, 2, 7, 20)] == [2, 2, 3, 5, 12]
    assert params.lag_bins(20, 100, 1.5) == 18 and params.lag_bins(20, 15, 1.5) == 15
    for bad in ((20, 11), (-1, 5), (2, 0), (2, 10, 0.5), (2, 10, float("nan"))):
        with pytest.raises(ValueError):
            params.lag_bins(*bad)


def test_last_number(spark):
    texts = {"beta .5": 0.5, "a - b 3": 3.0, "x 1.25 y -7": -7.0, "-.75": -0.75, "none": None, "7.": 7.0}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", statistics.last_number(F.col("t")).alias("n")).collect()} == texts


def test_peaks_by_prominence(spark):
    x = [0, 5, 4, 5.5, 0, 1, 0, -6, 0]
    df = spark.createDataFrame([(None, i, float(v)) for i, v in enumerate(x)], "k string, sample_idx int, value double")
    at = lambda **o: sorted(r.sample_idx for r in artifacts.find_peaks(df, ["k"], **o).collect())
    assert at() == [1, 3, 5] and at(prominence=1.0) == [1, 3, 5] and at(prominence=1.5) == [3]
    assert at(prominence=5.0, absolute=True) == [3, 7]


@pytest.mark.parametrize("mode", ["ratio", "percent", "zscore", "mean"])
def test_near_zero_denominators_of_nested_cells(spark, mode):
    """Cells of positions, two groups (one of a NULL name): a baseline that is tiny beside the others of its cell gives no value."""
    rng, rows = np.random.default_rng(2), []
    for g in ("a", None):
        for phase in ("base", "base", "walk"):
            for p in range(20):
                v = rng.normal(5, 1) if p not in (3, 4) else 1e-12 if p == 3 else 0.0
                rows.append((g, phase, p, None if rng.random() < 0.05 else float(v)))
    df = spark.createDataFrame(rows, "g string, phase string, t_pos int, value double")
    got = transforms.normalize_by_group(df, ["g", "t_pos"], F.col("phase") == "base", mode, within=["t_pos"])
    read = lambda d: [(r.g, r.phase, r.t_pos, r.value) for r in d.collect()]
    stats = {(g, p): [v for h, phase, q, v in rows if (h, q) == (g, p) and phase == "base" and v is not None] for g in ("a", None) for p in range(20)}
    den = {k: (np.std(v) if mode == "zscore" else np.mean(v)) if v else None for k, v in stats.items()}
    want = []
    for g, phase, p, v in rows:
        top = np.percentile([abs(d) for (h, _), d in den.items() if h == g and d is not None], 95)
        d, base = den[(g, p)], np.mean(stats[(g, p)]) if stats[(g, p)] else None
        if mode == "mean":
            want.append((g, phase, p, None if v is None or base is None else v - base))
        else:
            good = v is not None and d is not None and abs(d) > max(2.3e-308, 1e-8 * top)
            want.append((g, phase, p, {"ratio": lambda: v / d, "percent": lambda: 100 * (v - base) / d, "zscore": lambda: (v - base) / d}[mode]() if good else None))
    key = lambda r: (str(r[:3]), r[3] is None, r[3] or 0)
    for a, b in zip(sorted(read(got), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None) and (a[3] is None or a[3] == pytest.approx(b[3]))
    if mode != "mean":
        assert all(r[3] is None for r in read(got) if r[2] in (3, 4))
