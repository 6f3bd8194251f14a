"""Unbounded input: classification that goes on as records arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphmill.functions.scalar import sigmoid
from glyphmill.ship import ship


def running_classification(scores: DataFrame) -> DataFrame:
    """The streaming form of ``linear.running``: each record (key, seq, value) of
    a stream yields the probability after it; a key's sum is its state. Within a
    micro-batch records count in the order of ``seq``."""
    ship(scores.sparkSession)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        rows = pd.concat(batches).sort_values("seq")
        before = state.get[0] if state.exists else 0.0
        total = before + rows["value"].cumsum()
        state.update((float(total.iloc[-1]),))
        yield pd.DataFrame({"key": rows["key"], "seq": rows["seq"], "probability": 1 / (1 + np.exp(-total))})

    kind = scores.schema["key"].dataType.simpleString()
    return scores.select("key", F.col("seq").cast("bigint").alias("seq"), F.col("value").cast("double").alias("value")).groupBy("key").applyInPandasWithState(fold, f"key {kind}, seq bigint, probability double", "total double", "append", GroupStateTimeout.NoTimeout)


def merged_state(messages: DataFrame) -> DataFrame:
    """``key, observations, probability`` of partial sums (key, n, value) that other
    jobs sent: the same plan on bounded and (in update mode) unbounded input."""
    return messages.groupBy("key").agg(F.sum("n").alias("observations"), sigmoid(F.sum("value")).alias("probability"))


def windowed_counts(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total`` by event time, late records up to ``late``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
