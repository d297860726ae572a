"""Queries of states that change by the clock, from events as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.series_queries import rounded
from tidemark.sources import points as P
from tidemark.streaming import incremental as I, timers as TM

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


@query("stream_freshness", """WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS ms FROM events), w AS (SELECT max(epoch_us(ts)) // 1000 - 3600000 AS w FROM events), l AS (SELECT key, max(ms) AS last FROM e GROUP BY key)
SELECT key, CASE WHEN w - last >= 36 * 3600000 THEN 'STALE' WHEN w - last >= 12 * 3600000 THEN 'DELAYED' ELSE 'CURRENT' END AS state, last FROM l CROSS JOIN w""")
def _(spark, sf):
    """Each user's freshness at the last watermark; times of changes are checked by the last row they tell of."""
    found = TM.states_of(spark, I.table_stream(spark, sf, "events"), "user_id", "ts", "1 hour", TM.Freshness(12 * TM.HOUR, 36 * TM.HOUR))
    last = P.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.floor(F.unix_micros(F.max("ts").cast("timestamp")) / 1000).alias("last"))
    due = F.when(F.col("state") == "STALE", F.col("at_ms") - 36 * TM.HOUR).when(F.col("state") == "DELAYED", F.col("at_ms") - 12 * TM.HOUR).otherwise(F.col("last"))
    return found.join(last, "key").select("key", "state", due.alias("last"))


@query("stream_watchdog", """WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS ms, event_type <> 'error' AS ok FROM events), w AS (SELECT max(epoch_us(ts)) // 1000 - 3600000 AS w FROM events),
l AS (SELECT key, max(ms) FILTER (WHERE ok) AS last FROM e GROUP BY key), f AS (SELECT key, ms, row_number() OVER (PARTITION BY key ORDER BY ms) AS n FROM e JOIN l USING (key) WHERE NOT ok AND (last IS NULL OR ms > last)),
c AS (SELECT l.key, last, coalesce(max(n), 0) AS n, max(ms) FILTER (WHERE n = 2) AS second FROM l LEFT JOIN f USING (key) GROUP BY 1, 2)
SELECT key, CASE WHEN n >= 2 THEN 'failing' ELSE 'silent' END AS alarm, CASE WHEN n >= 2 THEN second ELSE last + 10 * 3600000 END AS at_ms FROM c CROSS JOIN w WHERE n >= 2 OR w - last >= 10 * 3600000""")
def _(spark, sf):
    """Users with an alarm at the last watermark: two errors in a row, or no other event for ten hours."""
    stream = I.table_stream(spark, sf, "events").withColumn("ok", F.col("event_type") != "error")
    found = TM.states_of(spark, stream, "user_id", "ts", "1 hour", TM.Watchdog(10 * TM.HOUR, 2), "ok")
    return found.where("state <> 'cleared'").select("key", F.col("state").alias("alarm"), "at_ms")
