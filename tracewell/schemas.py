"""Fixed schemas of the tables; NULL is the only missing value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNAL = "subject string, record string, channel string, sample_idx long, t_s double, value double"
SIGNAL_BLOCK = "subject string, record string, channel string, block long, t0_s double, sfreq_hz double, values array<double>"
ANNOTATION = "subject string, record string, ann_id long, onset_s double, duration_s double, end_s double, description string"
TENSOR = "subject string, record string, metric string, epoch int, channel string, pair struct<a: string, b: string>, freq_hz double, freq_label string, time_s double, percent double, value double"
EPOCH = "subject string, record string, trial string, epoch int, label string, start_s double, end_s double, duration_s double, events map<string, double>, intervals array<struct<start_s: double, end_s: double>>, pick boolean"
CELL = "row_id long, f_pos int, f_coord double, f_label string, t_pos int, t_coord double, t_label string, value double"
FEATURE = "subject string, record string, trial string, metric string, reducer string, derived_type string, channel string, band string, phase string, value double"


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has all the columns; extra ones pass."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinite values become NULL, once, at the edge."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in columns})
