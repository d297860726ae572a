"""Streams whose states change by the clock: freshness of sources, and a watchdog, by deadlines in event time.

A key's state is its last observation and what follows from it. Its deadline has passed when the watermark reaches it, so a
source turns DELAYED, STALE or silent while only others send rows. Each change is one row with the time at which it took
effect, so results don't depend on how rows are dealt to batches, as long as they come in the order of time; a row that
is older than the last of its key, or not after the watermark of the batches before, changes nothing.

The states are a table of one row a key. A batch's rows and the states before it are sorted by key and time, and folded in one
pass over the rows of all keys of a task, so that a key costs no more than its rows (transformWithState and
applyInPandasWithState take milliseconds for each key). A batch goes over all states, as deadlines do.

Defined cases: rows without a key or time are left out; a null outcome is a failure; a key without a success has no
deadline; times count in whole milliseconds; a success counts after all failures of its millisecond; a deadline that the
watermark has not passed is open, though a failure from beyond it has come.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sinks.publication import new_folder

HOUR = 3_600_000
CHANGES = "key string, at_ms long, state string"
#: Rows in a batch of results.
ROWS = 10_000


class Freshness:
    """CURRENT when a row comes, DELAYED `slo` and STALE `stale` milliseconds after the last one."""

    HELD, SEEN = "h_last long, h_state string", "h_last"
    EMPTY = (None, None)

    def __init__(self, slo: int, stale: int):
        self.slo, self.stale = slo, stale

    def fold(self, held: tuple, rows: Iterable[tuple]) -> tuple[tuple, list[tuple[int, str]]]:
        """The state after rows (ms,) in order of time, and its changes."""
        last, state = held
        found = []
        for (at,) in rows:
            if last is not None and at <= last:
                continue
            if last is not None:
                (_, state), told = self.expired((last, state), at - 1)
                found += told
            if state != "CURRENT":
                found.append((at, "CURRENT"))
            last, state = at, "CURRENT"
        return (last, state), found

    def deadline(self, held: tuple) -> int | None:
        last, state = held
        return None if last is None or state == "STALE" else last + (self.stale if state == "DELAYED" else self.slo)

    def expired(self, held: tuple, now: int) -> tuple[tuple, list[tuple[int, str]]]:
        """The state once the deadlines up to now have passed, and its changes."""
        last, state = held
        found = []
        while (at := self.deadline((last, state))) is not None and at <= now:
            state = "STALE" if state == "DELAYED" else "DELAYED"
            found.append((at, state))
        return (last, state), found


class Watchdog:
    """silent `limit` milliseconds after the last success, failing at the `failures`-th failure in a row, cleared by a success."""

    HELD, SEEN = "h_last long, h_failures long, h_alarm string, h_seen long", "h_seen"
    EMPTY = (None, 0, "", None)

    def __init__(self, limit: int, failures: int):
        self.limit, self.failures = limit, failures

    def fold(self, held: tuple, rows: Iterable[tuple]) -> tuple[tuple, list[tuple[int, str]]]:
        """The state after rows (ms, ok) in order of time, failures first, and its changes."""
        last, failures, alarm, seen = held
        found = []
        for at, ok in rows:
            if seen is not None and at < seen or not ok and last is not None and at <= last:
                continue
            seen = at
            # The watermark may be behind this row, so a deadline before it is told by a success or an alarm, or else by the watermark.
            if last is not None and not alarm and last + self.limit < at and (ok or failures + 1 == self.failures):
                alarm = "silent"
                found.append((last + self.limit, alarm))
            if ok:
                if alarm:
                    found.append((at, "cleared"))
                last, failures, alarm = at, 0, ""
            else:
                failures += 1
                if failures == self.failures:
                    alarm = "failing"
                    found.append((at, alarm))
        return (last, failures, alarm, seen), found

    def deadline(self, held: tuple) -> int | None:
        last, _, alarm, _ = held
        return None if alarm or last is None else last + self.limit

    def expired(self, held: tuple, now: int) -> tuple[tuple, list[tuple[int, str]]]:
        last, failures, alarm, seen = held
        at = self.deadline(held)
        return (held, []) if at is None or at > now else ((last, failures, "silent", seen), [(at, "silent")])


@dataclass
class StateChanges:
    """The changes of a processor over a stream of key, ms and, for a processor of outcomes, ok."""

    rows: DataFrame
    late_ms: int
    processor: Freshness | Watchdog


def state_changes(stream: DataFrame, key: str, time: str, late: str, processor: Freshness | Watchdog, ok: str | None = None) -> StateChanges:
    ms = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1000)
    own = [F.coalesce(F.col(ok), F.lit(False)).alias("ok")] if ok else []
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), ms.alias("ms"), *own)
    zero = F.timestamp_micros(F.lit(0))
    late_ms = stream.sparkSession.range(1).select((F.unix_micros(zero + F.expr(f"interval {late}")) / 1000).cast("long")).first()[0]
    return StateChanges(rows, late_ms, processor)


def _told(processor: Freshness | Watchdog) -> str:
    """The schema of what a batch tells: changes, and states for the next one."""
    return f"kind string, {CHANGES}, {processor.HELD}"


def _folding(processor: Freshness | Watchdog, n_names: int, passed: int):
    """Rows of key, names, state, sorted by key and time with the state first, to changes and new states."""
    columns = [c.split() for c in _told(processor).split(", ")]
    schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in columns])
    nothing, no_change = (None,) * len(processor.EMPTY), (None, None)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for key, own in itertools.groupby(rows, lambda r: r[0]):
            first = next(own)
            kept = first[1] is None  # a state has no time
            held = first[1 + n_names :] if kept else processor.EMPTY
            events = own if kept else itertools.chain((first,), own)
            held, found = processor.fold(held, (r[1 : 1 + n_names] for r in events))
            held, more = processor.expired(held, passed)
            yield "held", key, *no_change, *held
            for change in found + more:
                yield "change", key, *change, *nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in itertools.batched(told(batches), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)

    return run


def run_changes(spark: SparkSession, changes: StateChanges, out: str, checkpoint: str) -> None:
    """Runs what is there and stops. Each batch has folders of its own, so one that is handed over again changes nothing.

    The states after a batch lie beside the checkpoint, those of the last two batches only.
    """
    processor, names, every = changes.processor, changes.rows.columns[1:], _told(changes.processor)
    kept = [c.split()[0] for c in processor.HELD.split(", ")]
    folder = lambda n: f"{checkpoint}-held/batch={n}"

    def each(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        told = lambda i: own.read.schema(every).parquet(folder(i))
        held = (told(n - 1) if n else own.createDataFrame([], every)).where("kind = 'held'").select("key", *kept)
        before, newest = held.agg(F.max(processor.SEEN)).first()[0], batch.agg(F.max("ms")).first()[0]
        if before is not None:
            batch = batch.where(F.col("ms") > before - changes.late_ms)
        seen = [x for x in (before, newest) if x is not None]
        run = _folding(processor, len(names), max(seen) - changes.late_ms if seen else 0)
        rows = batch.unionByName(held, allowMissingColumns=True).select("key", *names, *kept)
        folded = rows.repartition("key").sortWithinPartitions("key", *names).mapInArrow(run, every)  # nulls, and so states, and failures come first
        folded.write.mode("overwrite").partitionBy("kind").parquet(folder(n))
        told(n).where("kind = 'change'").select("key", "at_ms", "state").write.mode("overwrite").parquet(f"{out}/batch={n}")
        if n > 1:
            path = own._jvm.org.apache.hadoop.fs.Path(folder(n - 2))
            path.getFileSystem(own._jsc.hadoopConfiguration()).delete(path, True)

    query = changes.rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def last_changes(spark: SparkSession, out: str) -> DataFrame:
    """The last change of each key: key, at_ms, state. Of changes at one time the later batch counts, and in it the stale or cleared state."""
    rows = spark.read.schema(f"{CHANGES}, batch long").parquet(out)
    last = F.max_by(F.struct("at_ms", "state"), F.struct("at_ms", "batch", F.col("state").isin("STALE", "cleared").alias("ends")))
    return rows.groupBy("key").agg(last.alias("r")).select("key", "r.*")


def states_of(spark: SparkSession, stream: DataFrame, key: str, time: str, late: str, processor: Freshness | Watchdog, ok: str | None = None) -> DataFrame:
    """last_changes of a stream after all that is there, by way of tables in the shared folder."""
    out, checkpoint = new_folder(spark, "changes"), new_folder(spark, "changes-state")
    run_changes(spark, state_changes(stream, key, time, late, processor, ok), out, checkpoint)
    return last_changes(spark, out)
