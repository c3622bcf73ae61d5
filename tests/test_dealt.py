"""Removal in one pass: results by brute force, and no task that holds most of the rows."""

import random

from pyspark.sql import functions as F

from tracewell.operators import intervals


def spread_out(df, part):
    sizes = df.rdd.glom().map(len).collect()
    return max(sizes) < part * sum(sizes)


def test_removal_by_brute_force(spark):
    """Overlapping, touching, reversed, empty and open-ended ranges; samples that repeat; a record of a NULL name and one without ranges."""
    rng = random.Random(1)
    rows = [(k, i, f"{k}{i}{n}") for k in ("r", "s", None) for n, i in enumerate([*range(-3, 40), 7, None])]
    random_spans = [(x, x + rng.randrange(4)) for x in rng.sample(range(40), 4)]
    spans = [(k, a, b) for k in ("r", None) for a, b in [(5, 5), (9, 6), (12, 15), (15, 17), (14, 16), (30, None), *random_spans]]
    got = intervals.remove_and_close(spark.createDataFrame(rows, "rec string, sample_idx long, tag string"), spark.createDataFrame(spans, "rec string, start long, end long"), ["rec"])
    assert got.columns == ["rec", "sample_idx", "tag", "new_idx"]
    want = []
    for k, i, tag in rows:
        gone = {x for q, a, b in spans if q == k and b is not None for x in range(min(a, b), max(a, b))}
        if i not in gone:
            want.append((k, i, tag, None if i is None else i - sum(x < i for x in gone)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_removal_leaves_tasks_apart(spark):
    samples = spark.range(8000).select((F.col("id") % 400).alias("rec"), F.floor(F.col("id") / 400).alias("sample_idx"))
    bad = samples.where("sample_idx % 5 = 0").select("rec", F.col("sample_idx").alias("start"), (F.col("sample_idx") + 1).alias("end"))
    out = intervals.remove_and_close(samples, bad, ["rec"])
    assert spread_out(out, 0.5) and out.count() == 6400
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
