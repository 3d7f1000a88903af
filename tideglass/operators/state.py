"""State over runs: first and last sightings, failure streaks, changes of values, desired against registered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEEN = ["key", "title", "url", "source", "first_seen", "last_seen", "score"]


def merge_seen(state: DataFrame, batch: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """The new state and what is new in it.

    ``state`` has the columns SEEN, ``batch`` has key, title, url, source and score, one row for each key.
    A batch row meets the state by its key, and only if that is unknown by its address (the least key
    wins). The first sighting is kept, everything else comes from the batch; ``is_new`` holds for first
    observations and for those first seen on today's date in ``zone``. State rows without a batch row stay.
    """
    b = batch.select("key", *[F.col(c).alias(f"b_{c}") for c in ("title", "url", "source", "score")])
    by_key = b.join(state.select("key", F.col("key").alias("old_key"), "first_seen"), "key", "left")
    misses = by_key.where("old_key is null").drop("old_key", "first_seen")
    taken = by_key.where("old_key is not null").select(F.col("old_key").alias("t"))
    free = state.join(taken, F.col("key") == F.col("t"), "left_anti").groupBy("url").agg(F.min_by(F.struct("key", "first_seen"), "key").alias("s"))
    by_url = misses.join(free.select(F.col("url").alias("b_url"), F.col("s.key").alias("old_key"), F.col("s.first_seen").alias("first_seen")), "b_url", "left")
    met = by_key.where("old_key is not null").unionByName(by_url.select(by_key.columns))
    today = F.to_date(F.from_utc_timestamp(now, zone))
    first_day = F.to_date(F.from_utc_timestamp(F.col("first_seen").try_cast("timestamp"), zone))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    merged = met.select(
        "key", F.col("b_title").alias("title"), F.col("b_url").alias("url"), F.col("b_source").alias("source"), F.coalesce("first_seen", stamp).alias("first_seen"), stamp.alias("last_seen"), F.col("b_score").alias("score"),
        F.coalesce(F.col("first_seen").isNull() | (first_day == today), F.lit(False)).alias("is_new"), "old_key",
    )
    rest = state.join(merged.select(F.col("old_key").alias("t")).where("t is not null"), F.col("key") == F.col("t"), "left_anti").select(*SEEN, F.lit(False).alias("is_new"))
    return merged.drop("old_key").unionByName(rest)


def failure_streaks(runs: DataFrame) -> DataFrame:
    """(name, day, failed) -> (name, day, streak): consecutive failure days up to each failure day.

    A day failed if its last run did; several failures on a day count once; a success in between, or a
    day without failure, starts anew. ``runs`` has a column ``at`` that orders the runs of a name.
    """
    by_name = Window.partitionBy("name").orderBy("at")
    marked = runs.withColumn("ok", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(by_name))
    days = marked.where("failed").groupBy("name", "ok", "day").agg(F.max("at").alias("at"))
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("name", "ok").orderBy("day")))
    grouped = days.withColumn("island", island)
    counted = grouped.withColumn("streak", F.row_number().over(Window.partitionBy("name", "ok", "island").orderBy("day")))
    return counted.select("name", "day", F.col("at").alias("last_failure_at"), "streak")


def health(runs: DataFrame) -> DataFrame:
    """(name, consecutive_failures, last_failure_at, last_success_at) after all runs."""
    streaks = failure_streaks(runs)
    last = runs.groupBy("name").agg(F.max_by("failed", "at").alias("failed"), F.max_by("day", "at").alias("day"), F.max(F.when(~F.col("failed"), F.col("at"))).alias("last_success_at"), F.max(F.when(F.col("failed"), F.col("at"))).alias("last_failure_at"))
    joined = last.join(streaks.groupBy("name", "day").agg(F.max_by("streak", "last_failure_at").alias("streak")), ["name", "day"], "left")
    return joined.select("name", F.when(F.col("failed"), F.coalesce("streak", F.lit(0))).otherwise(0).alias("consecutive_failures"), "last_failure_at", "last_success_at")


def run_streaks(runs: DataFrame) -> DataFrame:
    """(name, at, failed) -> consecutive failed runs up to each run; 0 after a success."""
    w = Window.partitionBy("name").orderBy("at")
    marked = runs.withColumn("ok", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    within = Window.partitionBy("name", "ok").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(within)).drop("ok")


def changes(values: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """Rows whose value is greater than the one before of the same key; a key's first row is only the baseline."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return values.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col(value) > F.col("previous")))


def difference(wanted: DataFrame, registered: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action, changed): create, update with the differing fields, or delete; equal rows are left out."""
    w = wanted.select(key, F.lit(True).alias("_w"), *[F.col(f).alias(f"w_{f}") for f in fields])
    r = registered.select(key, F.lit(True).alias("_r"), *[F.col(f).alias(f"r_{f}") for f in fields])
    changed = F.array_compact(F.array(*[F.when(~F.col(f"w_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields]))
    joined = w.join(r, key, "full_outer").withColumn("changed", F.when(F.col("_w") & F.col("_r"), changed).otherwise(F.array().cast("array<string>")))
    action = F.when(F.col("_r").isNull(), "create").when(F.col("_w").isNull(), "delete").when(F.size("changed") > 0, "update")
    return joined.select(key, action.alias("action"), "changed").where("action is not null")
