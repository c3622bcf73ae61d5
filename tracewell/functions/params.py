"""Registries of parameters: reducers and transforms per metric, validation of frequencies."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.cells import REDUCERS
from tracewell.operators.transforms import TRANSFORMS, transform

#: Which reducers suit a metric on an aligned axis; others take the means.
RUN_METRICS = ("burst",)


def reducers_for(metric: str, method: str, chosen: Sequence[str] | None = None) -> list[str]:
    """Reducers of a metric: the chosen ones, else run reducers for burst-like metrics and means for others."""
    allowed = REDUCERS if metric in RUN_METRICS else ("mean", "median")
    if chosen is None:
        return list(("count", "occupation", "rate", "duration") if metric in RUN_METRICS else ("mean",))
    wrong = [r for r in chosen if r not in allowed]
    if wrong:
        raise ValueError(f"{metric} does not take {', '.join(wrong)}")
    return list(chosen)


def plan_table(spark, metrics: dict[str, str]) -> DataFrame:
    """(metric, reducer) rows of metrics and their alignment methods, for ``cells.extract_features``."""
    return spark.createDataFrame([(m, r) for m, how in metrics.items() for r in reducers_for(m, how)], "metric string, reducer string")


def check_frequencies(low: float, high: float, rate: float, highpass: float | None = None, lowpass: float | None = None) -> None:
    """Frequency bounds against the filter's range and half the sampling rate."""
    if not 0 < low < high:
        raise ValueError("0 < low < high")
    if high > rate / 2:
        raise ValueError("high exceeds half the sampling rate")
    if highpass is not None and low < highpass or lowpass is not None and high > lowpass:
        raise ValueError("the range leaves the filter's passband")


def registry() -> dict[str, Callable[[Column], Column]]:
    """Transforms by name, as functions of columns."""
    return {m: (lambda x, m=m: transform(x, m)) for m in TRANSFORMS}


def baseline_labels(annotations: DataFrame) -> DataFrame:
    """Labels of positive duration, sorted: choices for a baseline."""
    return annotations.where("duration_s > 0").select("description").distinct().orderBy("description")


def facet_values(features: DataFrame, facet: str, **others) -> DataFrame:
    """Values of a facet that occur with the other facets' choices, by name without case."""
    out = features
    for column, value in others.items():
        out = out.where(F.col(column) == value)
    return out.select(facet).where(F.col(facet).isNotNull()).distinct().orderBy(F.lower(facet))


def best_step(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The completed step of highest priority (smallest number) per record."""
    return steps.where("done").groupBy(*keys).agg(F.min_by("step", "priority").alias("step"))


def missing_requests(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Requested rows that were not found."""
    return requested.select(*found.columns).exceptAll(found)


def lag_bins(n_lags: int, n_total: int, scale: float = 1.0) -> int:
    """Frequency bins that a lag model of ``n_lags`` takes: its least number, half the lags and two more, times ``scale``, and no more than there are.

    Fewer bins than the least number are an error.
    """
    if n_lags < 0 or n_total <= 0 or not (math.isfinite(scale) and scale >= 1):
        raise ValueError("n_lags >= 0, n_total > 0 and scale >= 1")
    least = n_lags // 2 + 2
    if n_total < least:
        raise ValueError(f"{n_lags} lags need {least} bins, there are {n_total}")
    return min(n_total, math.ceil(least * scale))
