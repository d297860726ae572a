import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality as Q, segments as G

ORDER = ["ts", "id"]


def table(n=400, seed=2):
    """A third of the rows under one key; nulls among keys, times and values; times crowd in the middle."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = r.choice(["hot", "a", "b", None, "c", "d"]) if r.random() > 0.33 else "hot"
        ts = None if r.random() < 0.03 else 500_000 + int(r.gauss(0, 40_000)) // 100 * 100
        rows.append((key, ts, i, r.choice([None, 1, 2, 3]), r.choice(["x", "y", None])))
    return rows


def by_key(rows):
    found = {}
    for row in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        found.setdefault(row[0], []).append(row)
    return found


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table(), "k string, ts long, id long, v long, s string").repartition(3).cache()


@pytest.mark.parametrize("most", [20, 7, 1000])
def test_scans_equal_plain_loops(rows, most, monkeypatch):
    if most == 7:
        monkeypatch.setattr(G, "BROADCAST_ROWS", 0)
    cut = G.segmented(rows, "k", ORDER, most, 1000)
    assert (cut.n_segments > 0) == (most < 1000)
    sums, last, before, prev = {}, {}, {}, {}
    for own in by_key(table()).values():
        total, known, row_before = 0, None, None
        for row in own:
            before[row[2]], prev[row[2]] = known, row_before
            total += row[3] or 0
            known = row[4] if row[4] is not None else known
            sums[row[2]], last[row[2]], row_before = total, known, row[4]
    found = cut.running_sum(F.col("v"), "total").last_known(F.col("s"), "known").last_known(F.col("s"), "earlier", with_own=False).previous(F.col("s"), "prev").rows.collect()
    assert len(found) == 400
    for r in found:
        assert (r["total"], r["known"], r["earlier"], r["prev"]) == tuple(x[r["id"]] for x in (sums, last, before, prev))


def test_segments_are_ranges_of_time(rows):
    cut = G.segmented(rows, "k", ORDER, 20, 1000).rows
    sizes = {r["_seg"]: r for r in cut.where("k = 'hot'").groupBy("_seg").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()}
    assert min(sizes) == 1 and len(sizes) > 5 and max(r["n"] for r in sizes.values()) < 60
    ends = [sizes[s] for s in sorted(sizes)]
    assert all(x["b"] is None or x["b"] < y["a"] for x, y in zip(ends, ends[1:]))


def test_as_of_sessions_runs_and_changes(spark, rows):
    data = by_key(table())
    left, right = rows.where("v = 1").select("k", "ts", "id"), rows.where("v = 2").select("k", "ts", F.col("id").alias("other"))
    found = {r["id"]: r["got"] for r in G.as_of(left, right, "k", "ts", "other", "got", 20, 1000).collect()}
    for own in data.values():
        for row in own:
            if row[3] == 1:
                fits = [(x[1] is not None, x[1] or 0, x[2]) for x in own if x[3] == 2 and (x[1] is None or row[1] is not None and x[1] <= row[1])]
                assert found[row[2]] == (max(fits)[2] if fits else None)
    timed = rows.where("ts is not null and k is not null").withColumn("ts", F.timestamp_seconds("ts"))
    for most in (20, 1000):
        sessions = {r["id"]: r["session"] for r in G.sessions(timed, "k", ORDER, 300, most, 1000).collect()}
        runs = {r["k"]: (r["s"], r["run"]) for r in G.current_runs(timed, "k", ORDER, "s", most, 1000).collect()}
        changes = {r["id"]: r["from_state"] for r in G.changes(timed, "k", ORDER, "s", most, 1000).collect()}
        for key, own in data.items():
            own = [x for x in own if x[1] is not None and key is not None]
            n = 0
            for i, row in enumerate(own):
                n += i == 0 or row[1] - own[i - 1][1] >= 300
                assert sessions[row[2]] == n
            sides = [x for x in own if x[4] is not None]
            for a, b in zip(sides, sides[1:]):
                assert changes.get(b[2]) == (a[4] if a[4] != b[4] else None)
            if sides:
                run = next((i for i, x in enumerate(reversed(sides)) if x[4] != sides[-1][4]), len(sides))
                assert runs[key] == (sides[-1][4], run)


def test_nothing_in_nothing_out(rows):
    none = rows.limit(0)
    assert G.timeline(none, "k", ORDER, "s").count() == 0 and G.current_runs(none, "k", ORDER, "s").count() == 0
    assert Q.failure_runs(none.withColumn("ok", F.lit(True)), "k", ORDER).count() == 0


def test_a_hot_user_is_no_hot_task(spark):
    from tidemark.plans.ordered_queries import hot_events

    e = hot_events(spark, "/root/testdata/sf0.1").select("user_id", "ts", "event_id", "event_type")
    n = e.count()
    assert e.where("user_id = -1").count() > n / 4
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tasks = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("place"), F.max("before")).collect()]
        cut = tasks(G.timeline(e, "user_id", ["ts", "event_id"], "event_type", most=n // 400))
        whole = tasks(G.timeline(e, "user_id", ["ts", "event_id"], "event_type", most=n))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(cut) == sum(whole) == n
    assert max(cut) < 2 * median(cut) and max(whole) > 4 * median(whole)
