"""Cases of the review's third round."""

import datetime as dt
import math

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import text_index as TI
from tidemark.plans import registry
from tidemark.streaming import timers as TM


def test_labels_round_a_value_once(spark):
    rows = spark.createDataFrame([(1, -0.354996, "degC"), (2, 0.354996, "m_per_s"), (3, 0.00004, "degC"), (4, 0.0049, "degC"), (5, -0.0049, "1"), (6, 1.24999, "m"), (7, None, "m"), (8, math.nan, "1")], "i int, v double, u string")
    found = [r["l"] for r in rows.orderBy("i").select(S.value_label(F.col("v"), F.col("u")).alias("l")).collect()]
    assert found == ["-0.35 °C", "+0.35 m/s", "0.00 °C", "+0.00 °C", "0.00", "+1.2 m", "Sin datos", "Sin datos"]


def test_display_labels_round_a_value_once(spark, monkeypatch):
    from tidemark.plans import release_queries as Q

    points = spark.createDataFrame([("nino12", "1998-02", -0.354996), ("d20", "1998-03", 0.249996), ("soi", "1998-04", None)], "indicator_id string, month string, value double")
    monkeypatch.setattr(Q.P, "indicator_points", lambda spark, sf: points)
    found = sorted(tuple(r) for r in Q.QUERIES["display_labels"](spark, "").collect())
    assert found == [("d20", "1998-03", "mar 1998", "+0.2 m"), ("nino12", "1998-02", "feb 1998", "-0.35 °C"), ("soi", "1998-04", "abr 1998", "Sin datos")]


def test_sign_checks_of_values_marked_twice(spark, tmp_path):
    ids = [(10003, "view"), (25003, "view"), (1, "view"), (7, "click"), (11, "click"), (15, "click"), (2503, "error")]  # 10003 is a multiple of 7, 25003 of 11
    rows = spark.createDataFrame([(i, t, 1.0) for i, t in ids], "event_id long, event_type string, value double")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    found = {r["event_type"]: (r["finite"], r["known"]) for r in registry.queries()["sign_checks"](spark, str(tmp_path)).collect()}
    want = {t: (all(i % 2500 != 3 for i, u in ids if u == t), sum(i % 7 != 0 and i % 11 != 0 for i, u in ids if u == t)) for _, t in ids}
    assert found == want


START = dt.datetime(2026, 7, 1, tzinfo=dt.UTC)


def watchdog(spark, tmp_path, batches, limit=10, failures=2):
    """The changes, and the last of each key, of rows (key, hours, ok) that come in batches."""
    for rows in batches:
        spark.createDataFrame([(k, START + dt.timedelta(hours=h), ok) for k, h, ok in rows], "k string, ts timestamp, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, ts timestamp, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        TM.run_changes(spark, TM.state_changes(stream, "k", "ts", "1 hour", TM.Watchdog(limit * TM.HOUR, failures), "ok"), str(tmp_path / "out"), str(tmp_path / "state"))
    hours = lambda ms: round((ms / 1000 - START.timestamp()) / 3600, 3)
    every = sorted((r["key"], hours(r["at_ms"]), r["state"]) for r in spark.read.schema(f"{TM.CHANGES}, batch long").parquet(str(tmp_path / "out")).collect())
    return every, {r["key"]: r["state"] for r in TM.last_changes(spark, str(tmp_path / "out")).collect()}


def test_a_failure_ahead_of_the_watermark_is_no_silence(spark, tmp_path):
    """The watermark is at 9.8 hours, so the deadline at 10 has not passed, though a failure of 10.5 hours has come."""
    first = [("a", 0, True), ("a", 10.5, False), ("b", 0, True), ("b", 10.3, False), ("b", 10.6, False), ("c", 10.8, True)]
    every, last = watchdog(spark, tmp_path, [first])
    assert every == [("b", 10, "silent"), ("b", 10.6, "failing")] and last == {"b": "failing"}
    every, last = watchdog(spark, tmp_path, [[("c", 12, True)]])
    assert every == [("a", 10, "silent"), ("b", 10, "silent"), ("b", 10.6, "failing")] and last == {"a": "silent", "b": "failing"}


def test_a_success_clears_the_failures_of_its_time(spark, tmp_path):
    every, last = watchdog(spark, tmp_path, [[("a", 0, True), ("a", 1, False), ("a", 2, False), ("a", 2, True), ("c", 4, True)], [("a", 2, False), ("a", 2, False), ("c", 5, True)]])
    assert every == [("a", 2, "cleared"), ("a", 2, "failing")] and last == {"a": "cleared"}


def test_batches_without_keys_and_folding_by_task(spark, tmp_path):
    """A batch of null keys leaves no state; each key of many is folded once a batch, in as many calls as there are tasks."""
    none = [(None, 1, True)]
    every, last = watchdog(spark, tmp_path, [none, none, [("a", 0, True), ("b", 11, True)], [("b", 12, True)]])
    assert every == [("a", 10, "silent")] and last == {"a": "silent"}
    rows = [("a", 1, True, None, None, None, None), ("b", None, None, 5, 0, "", 5), ("b", 30, False, None, None, None, None)]
    run = TM._folding(TM.Watchdog(10, 2), 2, 14)
    names = ["key", "ms", "ok", "h_last", "h_failures", "h_alarm", "h_seen"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in some], schema=pa.schema([("key", pa.string()), ("ms", pa.int64()), ("ok", pa.bool_()), ("h_last", pa.int64()), ("h_failures", pa.int64()), ("h_alarm", pa.string()), ("h_seen", pa.int64())])) for some in (rows[:2], rows[2:])]
    found = [tuple(r.values()) for b in run(iter(batches)) for r in b.to_pylist()]
    assert found == [("held", "a", None, None, 1, 0, "silent", 1), ("change", "a", 11, "silent", None, None, None, None), ("held", "b", None, None, 5, 1, "", 30)]


def test_an_index_cuts_texts_into_words_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        calls.add(1)
        return text

    rows = [(1, "alpha beta beta"), (2, None), (3, ""), (None, "alpha gamma"), (5, "beta"), (5, "beta"), (4097, "alpha")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", seen.asNondeterministic()("text"))
    own = TI.build(docs, str(tmp_path / "i"))
    assert calls.value == len(rows)
    assert (own.n_docs, round(own.mean_size, 9)) == (7, round(8 / 6, 9))
    held = {(r["term"], r["block"]): (r["df"], [tuple(p) for p in r["postings"]]) for r in own.read(["alpha", "beta", "gamma"]).collect()}
    assert held == {("alpha", 0): (2, [(1, 1, 3)]), ("alpha", 1): (2, [(4097, 1, 1)]), ("beta", 0): (2, [(1, 2, 3), (5, 2, 1)])}
    assert not (tmp_path / "i" / "building").exists()
