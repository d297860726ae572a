import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.streaming import timers as TM

START = dt.datetime(2026, 7, 1, tzinfo=dt.UTC)
SCHEMA = "k string, ts timestamp, ok boolean"


def at(hours):
    return START + dt.timedelta(hours=hours)


def append(spark, folder, rows):
    spark.createDataFrame([(k, at(h), ok) for k, h, ok in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, processor, ok=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    TM.run_changes(spark, TM.state_changes(stream, "k", "ts", "1 hour", processor, ok), str(tmp_path / "out"), str(tmp_path / "state"))


def changes(spark, tmp_path):
    rows = spark.read.schema(f"{TM.CHANGES}, batch long").parquet(str(tmp_path / "out")).collect()
    return sorted((r["key"], (r["at_ms"] / 1000 - START.timestamp()) / 3600, r["state"]) for r in rows)


def test_sources_turn_stale_while_others_send(spark, tmp_path):
    processor = TM.Freshness(12 * TM.HOUR, 36 * TM.HOUR)
    append(spark, str(tmp_path / "in"), [("a", 0, True), ("a", 2, True), ("b", 1, True), ("c", 0, True), ("c", 14, True), (None, 3, True)])
    run(spark, tmp_path, processor)
    first = changes(spark, tmp_path)
    assert first == [("a", 0, "CURRENT"), ("b", 1, "CURRENT"), ("b", 13, "DELAYED"), ("c", 0, "CURRENT"), ("c", 12, "DELAYED"), ("c", 14, "CURRENT")]
    run(spark, tmp_path, processor)  # a restart without new rows
    assert changes(spark, tmp_path) == first
    # Only c sends: a and b change by their timers. b's row of long ago changes nothing.
    append(spark, str(tmp_path / "in"), [("c", 20, True), ("c", 60, True), ("b", 0.5, True)])
    run(spark, tmp_path, processor)
    more = [("a", 14, "DELAYED"), ("a", 38, "STALE"), ("b", 37, "STALE"), ("c", 32, "DELAYED"), ("c", 56, "STALE"), ("c", 60, "CURRENT")]
    assert changes(spark, tmp_path) == sorted(first + more)
    assert {r["key"]: r["state"] for r in TM.last_changes(spark, str(tmp_path / "out")).collect()} == {"a": "STALE", "b": "STALE", "c": "CURRENT"}
    # A stale source that sends again is current.
    append(spark, str(tmp_path / "in"), [("a", 61, True)])
    run(spark, tmp_path, processor)
    assert ("a", 61, "CURRENT") in changes(spark, tmp_path)


def test_batches_equal_the_batch_states(spark, tmp_path):
    r = random.Random(4)
    rows = sorted(((r.choice("abcdefgh"), r.randint(0, 200), True) for _ in range(40)), key=lambda x: x[1])
    for i in range(0, 40, 10):
        append(spark, str(tmp_path / "in"), rows[i : i + 10])
        run(spark, tmp_path, TM.Freshness(2 * 24 * TM.HOUR, 4 * 24 * TM.HOUR))
    found = {x["key"]: x["state"] for x in TM.last_changes(spark, str(tmp_path / "out")).collect()}
    as_of = max(h for _, h, _ in rows) - 1
    last = spark.createDataFrame([(k, at(h), ok) for k, h, ok in rows], SCHEMA).groupBy("k").agg(F.max("ts").alias("ts"))
    # The batch rule counts whole days and the timers hours, so the batch gets times whose days start at the deadline.
    shifted = last.select("k", F.lit(at(as_of)).alias("now"), "ts").select("k", F.floor((F.unix_timestamp("now") - F.unix_timestamp("ts")) / 86400).alias("days"))
    day = F.lit("2026-07-31").cast("date")
    states = shifted.select("k", Q.freshness_state(F.date_sub(day, F.col("days").cast("int")), day, F.lit("1"), F.lit("3"), F.lit(""), F.lit(False)).alias("s"))
    assert found == {x["k"]: x["s"] for x in states.collect()} and len(set(found.values())) == 3


def test_watchdog_alarms_without_new_rows(spark, tmp_path):
    processor = TM.Watchdog(30 * TM.HOUR, 3)
    append(spark, str(tmp_path / "in"), [("a", 0, True), ("b", 0, True), ("b", 1, False), ("b", 2, False), ("b", 3, False), ("c", 0, True), ("c", 5, None), ("d", 1, False)])
    run(spark, tmp_path, processor, "ok")
    assert changes(spark, tmp_path) == [("b", 3, "failing")]
    append(spark, str(tmp_path / "in"), [("d", 40, False), ("e", 41, True)])
    run(spark, tmp_path, processor, "ok")
    assert changes(spark, tmp_path) == [("a", 30, "silent"), ("b", 3, "failing"), ("c", 30, "silent")]
    append(spark, str(tmp_path / "in"), [("a", 42, True), ("b", 42, True), ("c", 43, False), ("c", 44, False), ("e", 80, True)])
    run(spark, tmp_path, processor, "ok")
    assert changes(spark, tmp_path) == sorted([("a", 30, "silent"), ("a", 42, "cleared"), ("b", 3, "failing"), ("b", 42, "cleared"), ("c", 30, "silent"), ("c", 44, "failing"), ("a", 72, "silent"), ("b", 72, "silent"), ("e", 71, "silent"), ("e", 80, "cleared")])
