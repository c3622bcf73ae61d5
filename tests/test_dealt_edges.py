"""Edge smoothing by windows: no task holds a whole branch of a union."""

import pytest
from pyspark.sql import functions as F

from tests.test_dealt import spread_out
from tracewell.operators import smoothing


@pytest.mark.parametrize("mode", smoothing.MODES)
def test_edge_means_leave_tasks_apart(spark, mode):
    """A union of modes does not join a mode's traces into one task."""
    cells = spark.range(4000).select((F.col("id") % 200).alias("row_id"), F.floor(F.col("id") / 200).alias("t_pos"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("value"))
    out = smoothing.smooth_mean(cells, ["row_id"], 4, mode=mode, cval=0.5)
    assert spread_out(out, 0.5)
    other = smoothing.smooth_mean(cells, ["row_id"], 4, mode=mode, cval=0.5, block=8)
    value = {(r.row_id, r.t_pos): r.smooth for r in out.collect()}
    assert len(value) == 4000 and all(value[(r.row_id, r.t_pos)] == pytest.approx(r.smooth) for r in other.collect())
