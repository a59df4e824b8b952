"""Logger streams: five-minute means with late data, and gap detection with a keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def five_minute_means(stream: DataFrame, ts: str, value: str, key: str, late: str = "1 hour") -> DataFrame:
    """key, ts, mean, n of each five-minute bin, final once the watermark has passed it. ``ts`` is a timestamp."""
    binned = stream.withWatermark(ts, late).groupBy(key, F.window(ts, "5 minutes").alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return binned.select(key, F.col("w.start").alias(ts), "mean", "n")


def gaps(stream: DataFrame, ts: str, key: str, longest_minutes: float = 60.5) -> DataFrame:
    """key, before, after, gap_min: intervals over a limit between consecutive rows of a key, across micro-batches.

    The state is the latest time of a key; rows older than it are late and give no interval."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for pdf in batches for t in pd.to_datetime(pdf[ts]).dropna())
        found = []
        for t in times:
            if last is not None and t <= last:
                continue
            if last is not None and (t - last).total_seconds() / 60 > longest_minutes:
                found.append((name[0], last, t, (t - last).total_seconds() / 60))
            last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(found, columns=[key, "before", "after", "gap_min"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, ts).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, before timestamp, after timestamp, gap_min double", "last timestamp", "append", GroupStateTimeout.NoTimeout)
