from pyspark.sql import functions as F

from tideglass.operators import state
from tideglass.streaming import watch


def run(stream, name, checkpoint):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_changes_across_batches(spark, tmp_path):
    rows = [("x", "2026-01-01 00:00:00", 0.0), ("x", "2026-01-01 01:00:00", 100.0), ("y", "2026-01-01 00:30:00", 5.0), ("x", "2026-01-01 02:00:00", 50.0), ("x", "2026-01-01 03:00:00", 60.0)]
    schema = "id string, at timestamp, value double"
    everything = spark.createDataFrame(rows, "id string, at string, value double").withColumn("at", F.to_timestamp("at"))
    for k in range(2):
        everything.where((F.hour("at") >= 2) if k else (F.hour("at") < 2)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run(watch.changed(stream), "changes", f"{tmp_path}/c1")
    got = {(r.id, r.previous, r.value) for r in spark.table("changes").collect()}
    batch = {(r.id, r.previous, r.value) for r in state.changes(everything, "id", [F.col("at")], "value").collect()}
    assert got == batch == {("x", 0.0, 100.0), ("x", 50.0, 60.0)}


def test_streaks(spark, tmp_path):
    rows = [("a", "2026-01-01 01:00:00", True), ("a", "2026-01-01 02:00:00", True), ("a", "2026-01-02 01:00:00", True), ("a", "2026-01-03 01:00:00", False), ("a", "2026-01-04 01:00:00", True)]
    spark.createDataFrame(rows, "name string, at string, failed boolean").withColumn("at", F.to_timestamp("at")).withColumn("day", F.to_date("at")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("name string, at timestamp, failed boolean, day date").parquet(f"{tmp_path}/in")
    run(watch.streaks(stream), "streaks", f"{tmp_path}/c2")
    assert [r.streak for r in spark.table("streaks").orderBy("at").collect()] == [1, 1, 2, 0, 1]


def test_seen_batches_are_idempotent(spark, tmp_path):
    store = {"df": spark.createDataFrame([], "key string, title string, url string, source string, first_seen string, last_seen string, score int")}

    def write(df, batch_id):
        path = f"{tmp_path}/state/{batch_id}-{len(store)}"
        df.write.mode("overwrite").parquet(path)
        store["df"] = spark.read.parquet(path)
        store[path] = True

    merge = watch.seen_batches(lambda: store["df"], write)
    batch = spark.createDataFrame([("k", "t", "u", "s", 1, "2026-01-01 00:00:00"), ("k", "t2", "u", "s", 2, "2026-01-01 01:00:00")], "key string, title string, url string, source string, score int, at string").withColumn("at", F.to_timestamp("at"))
    merge(batch, 0)
    once = [tuple(r) for r in store["df"].collect()]
    merge(batch, 1)
    assert [tuple(r) for r in store["df"].collect()] == once and len(once) == 1 and once[0][1] == "t"
    merge(batch.limit(0), 2)
    assert store["df"].count() == 1
