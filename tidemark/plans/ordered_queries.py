"""Ordered operators over events of which a third belong to one user, who is cut into segments of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality as Q, segments as SG
from tidemark.plans.series_queries import rd, rounded
from tidemark.sources import points as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Rows of a segment here, so that the hot user of the smallest tables is cut too.
MOST = 500


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


def hot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events; those whose number is divisible by 3 belong to user -1."""
    e = P.table(spark, sf_dir, "events")
    return e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id")))


_HOT = "WITH h AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, event_type, value FROM events)"


@query("hot_asof_join", f"{_HOT} SELECT e.event_id, l.event_id AS last_error FROM h e ASOF LEFT JOIN (SELECT * FROM h WHERE event_type = 'error') l ON e.user_id = l.user_id AND e.ts >= l.ts WHERE e.event_type = 'purchase'")
def _(spark, sf):
    e = hot_events(spark, sf).select("event_id", "user_id", "ts", "event_type")
    of = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    return SG.as_of(of("purchase"), of("error"), "user_id", "ts", "event_id", "last_error", MOST).select("event_id", "last_error")


@query("hot_timeline", f"{_HOT} SELECT user_id, event_id, event_type, (row_number() OVER w)::INT AS place, lag(event_type) OVER w AS before FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, sf):
    return SG.timeline(hot_events(spark, sf), "user_id", ["ts", "event_id"], "event_type", MOST).select("user_id", "event_id", "event_type", "place", "before")


@query("hot_failure_runs", f"""{_HOT}, r AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM h),
g AS (SELECT user_id, grp, count(*) FILTER (WHERE event_type = 'error') AS n FROM r GROUP BY 1, 2) SELECT user_id, max(n) AS longest, arg_max(n, grp) AS current, arg_max(n, grp) >= 2 AS alarm FROM g GROUP BY 1""")
def _(spark, sf):
    e = hot_events(spark, sf).select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return Q.failure_runs(e, "user_id", ["ts", "event_id"], 2, MOST)


@query("hot_sessions", f"""{_HOT}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, {rd('sum(value)')} AS total FROM s GROUP BY user_id, k""")
def _(spark, sf):
    """What session windows give, by numbers of sessions from the segments; sums are combined before they are shuffled."""
    rows = SG.sessions(hot_events(spark, sf), "user_id", ["ts", "event_id"], 1800, MOST)
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).drop("session")


@query("hot_not_monotonic", f"{_HOT}, b AS (SELECT *, lag(CASE WHEN event_type <> 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bf, CASE WHEN event_type <> 'view' THEN value END AS v FROM h) SELECT user_id, event_id, {rd('v')} AS v, {rd('bf')} AS before FROM b WHERE v < bf")
def _(spark, sf):
    rows = hot_events(spark, sf).select("user_id", "ts", "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("v"))
    return SG.not_monotonic(rows, "user_id", ["ts", "event_id"], "v", MOST).select("user_id", "event_id", "v", "before")


@query("hot_changes", f"{_HOT}, b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM h WHERE event_type <> 'signup') SELECT user_id, event_id, from_state, event_type AS state FROM b WHERE from_state <> event_type")
def _(spark, sf):
    rows = hot_events(spark, sf).select("user_id", "ts", "event_id", F.when(F.col("event_type") != "signup", F.col("event_type")).alias("state"))
    return SG.changes(rows, "user_id", ["ts", "event_id"], "state", MOST).select("user_id", "event_id", "from_state", "state")


@query("hot_current_runs", f"""{_HOT}, b AS (SELECT *, value >= 10 AS high, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM h), l AS (SELECT user_id, high AS side FROM b WHERE r = 1)
SELECT l.user_id, side, coalesce(min(r) FILTER (WHERE high <> side) - 1, max(r)) AS run FROM b JOIN l USING (user_id) GROUP BY 1, 2""")
def _(spark, sf):
    rows = hot_events(spark, sf).select("user_id", "ts", "event_id", (F.col("value") >= 10).alias("side"))
    return SG.current_runs(rows, "user_id", ["ts", "event_id"], "side", MOST)
