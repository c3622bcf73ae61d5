"""Live packets: gap detection, duplicates, windowed quality, sessions of activity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def packet_gaps(packets: DataFrame, key: str = "device", index: str = "packet") -> DataFrame:
    """device, first, last of each missing range, as soon as the next packet arrives.

    The state is the last packet number of each device. Packets at or below it (late or repeated) are passed over.
    """
    kind = dict(packets.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        numbers = sorted({int(n) for f in frames for n in f[index]})
        out = []
        for n in numbers:
            if last is not None and n > last + 1:
                out.append((k[0], last + 1, n - 1))
            last = n if last is None else max(last, n)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "first", "last"])

    return packets.select(key, F.col(index).cast("long").alias(index)).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, first long, last long", "last long", "append", GroupStateTimeout.NoTimeout)


def drop_repeats(packets: DataFrame, late: str = "10 minutes", time: str = "ts", keys: tuple[str, ...] = ("device", "packet")) -> DataFrame:
    """The first of repeated packets within the watermark."""
    return packets.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def window_quality(samples: DataFrame, width: str, low: float, high: float, slide: str | None = None, late: str = "10 minutes", time: str = "ts", key: str = "channel") -> DataFrame:
    """Peak-to-peak by tumbling or sliding window and channel, bad outside [low, high]."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = samples.withWatermark(time, late).groupBy(w.alias("w"), key).agg((F.max("value") - F.min("value")).alias("p2p"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "p2p", ((F.col("p2p") < low) | (F.col("p2p") > high)).alias("bad"))


def activity_sessions(samples: DataFrame, threshold: float, gap: str, late: str = "10 minutes", time: str = "ts", key: str = "channel") -> DataFrame:
    """Sessions of samples over the threshold that are less than ``gap`` apart."""
    on = samples.where(F.col("value") > threshold).withWatermark(time, late)
    out = on.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n", "peak")
