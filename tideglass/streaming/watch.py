"""Streams: changes of watched values, failure streaks and the seen state, with Structured Streaming.

State is advanced only with the batch that produced the output (at least once towards the outside,
exactly once in the state): Spark commits the checkpoint after the sink has succeeded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideglass.operators.state import merge_seen


def changed(stream: DataFrame) -> DataFrame:
    """(id, at, value) -> rows whose value exceeds the last one of the same id; the first sighting is the baseline.

    Rows of one id within a batch are taken in the order of ``at``; null values are skipped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).dropna(subset=["value"]).sort_values("at")
        out = []
        for r in rows.itertuples():
            if last is not None and r.value > last:
                out.append((key[0], r.at, last, r.value))
            last = r.value
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame(out, columns=["id", "at", "previous", "value"])

    return stream.select("id", "at", F.col("value").cast("double").alias("value")).groupBy("id").applyInPandasWithState(step, "id string, at timestamp, previous double, value double", "last double", "append", GroupStateTimeout.NoTimeout)


def streaks(stream: DataFrame) -> DataFrame:
    """(name, at, day, failed) -> one row for each run with the consecutive failure days so far.

    A failure on the day of the last one leaves the streak, on the next day adds one, later starts anew; a
    success sets it to 0.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, day = state.get if state.exists else (0, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("at").itertuples():
            today = r.day.toordinal() if r.day is not None else None
            if not r.failed:
                count = 0
            elif count and day == today:
                count = max(1, count)
            else:
                count = count + 1 if count and day is not None and today == day + 1 else 1
            day = today if r.failed else day
            out.append((key[0], r.at, int(count)))
        state.update((count, day))
        yield pd.DataFrame(out, columns=["name", "at", "streak"])

    return stream.select("name", "at", "day", "failed").groupBy("name").applyInPandasWithState(step, "name string, at timestamp, streak int", "count int, day int", "append", GroupStateTimeout.NoTimeout)


def seen_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into the seen state; a repeated batch changes nothing but last_seen."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.groupBy("key").agg(*[F.min_by(c, "at").alias(c) for c in ("title", "url", "source", "score")], F.min("at").alias("at"))
        at = rows.agg(F.max("at")).collect()[0][0]
        if at is not None:
            write(merge_seen(read(), rows, F.lit(at)).drop("is_new"), batch_id)

    return merge


def deduplicated(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """First sightings within a watermark; a row later than the delay is dropped."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
