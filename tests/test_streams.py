from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from harrow.streaming import streams


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def events(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("at", F.col("ts").cast("timestamp"))


def run(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_first_within(spark, data, events):
    got = run(spark, streams.first_within(events, ["user_id"], "at", "400 days"), "firsts", "append")
    assert got.count() == spark.read.parquet(f"{data}/events.parquet").select("user_id").distinct().count()


def test_windows(spark, data, events):
    got = run(spark, streams.windowed(events, "at", "400 days", "1 day", None, ["event_type"], [F.count(F.lit(1)).alias("n")]), "days", "complete")
    batch = spark.read.parquet(f"{data}/events.parquet")
    assert got.agg(F.sum("n")).first()[0] == batch.count()
    assert streams.windowed(events, "at", "1 day", "1 day", "1 hour", [], [F.count(F.lit(1)).alias("n")]).isStreaming
    assert streams.sessions(events, "at", "1 day", "1 hour", ["user_id"]).columns == ["user_id", "session_start", "session_end", "n"]


def test_running_totals(spark, data, events):
    got = run(spark, streams.running_totals(events.withColumn("a", F.floor("value")), "event_type", "a", 100), "totals", "update")
    latest = {r.key: r.total for r in got.groupBy("key").agg(F.max("total").alias("total")).collect()}
    want = spark.read.parquet(f"{data}/events.parquet").groupBy("event_type").agg(F.sum(F.greatest(F.floor("value"), F.lit(0))).alias("s"))
    assert latest == {r.event_type: r.s for r in want.collect()}


def test_upserted(spark, data, events, tmp_path):
    streams.upserted(events.select("event_id"), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id").distinct().count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_progress(spark, events):
    told = []
    listener = streams.Progress(lambda name, rows: told.append((name, rows)), every=10)
    spark.streams.addListener(listener)
    run(spark, events.select("event_id"), "told", "append")
    for _ in range(100):
        if told:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert told and told[-1][0] == "told" and told[-1][1] > 10
