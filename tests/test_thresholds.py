"""Levels that lie exactly on a threshold."""

import datetime as dt

import pytest

from tracewell.plans import registry

#: In exact arithmetic the first value lies 1.5 over the mean of all; some orders of adding doubles put it a rounding over that.
ON_THE_LINE = [103.56, 55.94, 67.31, 58.37, 97.95, 141.76, 176.12, 51.73, 15.91, 81.03, 82.76, 21.1, 146.37, 140.95, 179.98, 81.99, 177.39, 143.98, 176.31, 148.54, 3.56, 129.66, 110.97, 56.2]


@pytest.mark.parametrize("shift", [0.0, 4.11])
def test_level_on_the_threshold(spark, tmp_path, shift):
    """The same day turned by an hour for each record gives the same stretches, turned: the level on the line counts in none."""
    v = sorted(ON_THE_LINE)
    rows = [(u, dt.datetime(2024, 1, 1, h), v[(h + u) % 24] + shift) for u in range(24) for h in range(24)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["interval_bases"](spark, str(tmp_path)).where("basis = 'robust'").collect()
    turned = {((r["first"] + r.rec) % 24, (r["last"] + r.rec) % 24, r.span, r.way) for r in got}
    at = v.index(ON_THE_LINE[0])
    assert turned == {(0, at - 1, at, "below_0"), (at + 1, 23, 23 - at, "above_0")}
