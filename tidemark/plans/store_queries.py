"""Queries of stored tables: snapshots with several writers, last valid rows, revisions, manifests and a text index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import revisions as R, text_index as TI
from tidemark.plans.series_queries import rd, rounded
from tidemark.sinks import manifests as M, publication as K, snapshots as N
from tidemark.sources import grid_files as GF, points as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def t(spark, sf_dir, name):
    return P.table(spark, sf_dir, name)


@query("snapshot_writers", f"""SELECT 'orders' AS name, o_orderkey % 8 AS bucket, count(*) AS n, {rd('sum(CASE WHEN o_orderkey % 8 = 3 THEN 2 * o_totalprice ELSE o_totalprice END) / 1000000')} AS total FROM orders GROUP BY 2
UNION ALL SELECT 'totals', o_orderkey % 8, count(*), {rd('sum(CASE WHEN o_orderkey % 8 = 3 THEN 2 * o_totalprice ELSE o_totalprice END) / 1000000')} FROM orders GROUP BY 2
UNION ALL SELECT 'first version', o_orderkey % 8, count(*), {rd('sum(o_totalprice) / 1000000')} FROM orders GROUP BY 2""")
def _(spark, sf):
    """Orders by buckets and their totals in one store. One writer doubles a bucket while another renews the totals.

    The second one has read what the first changed, so it runs again; the version before both stays readable.
    """
    store = N.Snapshots(spark, K.new_folder(spark, "snapshots"), keep=3)
    rows = t(spark, sf, "orders").select((F.col("o_orderkey") % 8).cast("int").alias("_bucket"), "o_orderkey", "o_totalprice")
    first = store.publish_buckets("orders", rows, "_bucket")
    summed = lambda df: df.groupBy((F.col("o_orderkey") % 8).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), (F.sum("o_totalprice") / 1000000).alias("total"))

    writer = store.begin()
    writer.replace_buckets("orders", writer.read("orders", [3]).select(F.lit(3).alias("_bucket"), "o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")), "_bucket")
    runs = []

    def renew(own):
        runs.append(own.base)
        own.replace("totals", summed(own.read("orders")))
        if len(runs) == 1:
            writer.commit()

    store.update(renew)
    if runs != [first, first + 1]:
        raise AssertionError("the totals were made of a version that had changed")
    parts = [("orders", summed(store.read("orders"))), ("totals", store.read("totals")), ("first version", summed(store.read("orders", first)))]
    every = [df.select(F.lit(name).alias("name"), "bucket", "n", "total") for name, df in parts]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("last_valid_rows", f"""WITH m AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, avg(o_totalprice) / 100000 AS v FROM orders GROUP BY ALL),
bad AS (SELECT k, max(v) > (SELECT quantile_cont(x, 0.5) FROM (SELECT max(v) AS x FROM m WHERE y >= 1996 GROUP BY k)) AS bad FROM m WHERE y >= 1996 GROUP BY k)
SELECT m.k, y, m, {rd('v')} AS v, CASE WHEN bad THEN 'last valid kept' ELSE 'refreshed' END AS state FROM m JOIN bad USING (k) WHERE CASE WHEN bad THEN y < 1996 ELSE y >= 1996 END""")
def _(spark, sf):
    """Monthly means by priority, saved up to 1995 and then refreshed from 1996 on: those with a value out of bounds keep what they had."""
    m = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg((F.avg("o_totalprice") / 100000).alias("v"))
    store = N.Snapshots(spark, K.new_folder(spark, "last-valid"))
    names = [k for k, *_ in P.INDICATORS]
    N.refresh_last_valid(store, {k: m.where((F.col("k") == k) & (F.col("y") < 1996)) for k in names}, F.col("v").isNotNull())
    late = m.where("y >= 1996")
    most = late.groupBy("k").agg(F.max("v").alias("x")).agg(F.percentile("x", F.lit(0.5)).alias("p")).first()["p"]
    done = N.refresh_last_valid(store, {k: late.where(F.col("k") == k) for k in names}, F.col("v") <= most)
    every = None
    for k in names:
        part = store.read(k).withColumn("state", F.lit(done[k]))
        every = part if every is None else every.unionByName(part)
    return every


# Monthly means become known three times: half of the orders ten days after the month, all of them after sixty days,
# and a correction of every seventh month in 1999.

_STATEMENTS = """m AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate)::DATE AS valid_from, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) / 100000 AS half, avg(o_totalprice) / 100000 AS whole FROM orders GROUP BY ALL),
st AS (SELECT k, valid_from, half AS value, 'preliminary' AS flag, (valid_from + INTERVAL 1 MONTH + INTERVAL 10 DAY)::DATE AS known_from FROM m WHERE half IS NOT NULL
UNION ALL SELECT k, valid_from, whole, 'final', (valid_from + INTERVAL 1 MONTH + INTERVAL 60 DAY)::DATE FROM m
UNION ALL SELECT k, valid_from, whole + 1, 'corrected', DATE '1999-03-01' FROM m WHERE month(valid_from) = 7)"""


def _revisions(spark, sf):
    """The three kinds of statements, merged in the wrong order and one of them twice."""
    m = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.date_trunc("month", "o_orderdate").cast("date").alias("valid_from"))
    m = m.agg((F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))) / 100000).alias("half"), (F.avg("o_totalprice") / 100000).alias("whole"))
    after = lambda days: F.date_add(F.add_months("valid_from", 1), days)
    said = lambda value, flag, known: m.select("k", "valid_from", F.add_months("valid_from", 1).alias("valid_to"), value.alias("value"), F.lit(flag).alias("flag"), known.alias("known_from"))
    early = said(F.col("half"), "preliminary", after(10)).where("value is not null")
    final = said(F.col("whole"), "final", after(60))
    late = said(F.col("whole") + 1, "corrected", F.lit("1999-03-01").cast("date")).where("month(valid_from) = 7")
    table = R.table(spark, K.new_folder(spark, "revisions"), "means", ["k", "valid_from", "valid_to"], ["value", "flag"], 8)
    for batch in (final, late, early, final):
        table.merge(batch)
    return table


@query("revisions_as_known", f"""WITH {_STATEMENTS}, d(known_at) AS (VALUES (DATE '1995-03-20'), (DATE '1998-12-31'), (DATE '1999-06-01'))
SELECT known_at, k, valid_from, flag, {rd('value')} AS value FROM st CROSS JOIN d WHERE known_from <= known_at QUALIFY row_number() OVER (PARTITION BY known_at, k, valid_from ORDER BY known_from DESC) = 1""")
def _(spark, sf):
    table, found = _revisions(spark, sf), None
    for day in ("1995-03-20", "1998-12-31", "1999-06-01"):
        at = F.lit(day).cast("date")
        part = table.as_known(at).select(at.alias("known_at"), "k", "valid_from", "flag", "value")
        found = part if found is None else found.unionByName(part)
    return found


@query("revisions_valid_at", f"WITH {_STATEMENTS} SELECT k, flag, {rd('value')} AS value FROM st WHERE known_from <= DATE '1999-06-01' AND valid_from = DATE '1996-07-01' QUALIFY row_number() OVER (PARTITION BY k ORDER BY known_from DESC) = 1")
def _(spark, sf):
    """What is known in 1999 of the day 1996-07-20."""
    return _revisions(spark, sf).as_known(F.lit("1999-06-01").cast("date"), F.lit("1996-07-20").cast("date")).select("k", "flag", "value")


@query("revision_sizes", f"""WITH {_STATEMENTS}, ch AS (SELECT *, value IS DISTINCT FROM lag(value) OVER (PARTITION BY k, valid_from ORDER BY known_from) AS new FROM st)
SELECT k, valid_from, count(*) FILTER (WHERE new) - 1 AS revisions, {rd('arg_min(value, known_from)')} AS first, {rd('arg_max(value, known_from)')} AS last, {rd('arg_max(value, known_from) - arg_min(value, known_from)')} AS moved FROM ch GROUP BY 1, 2""")
def _(spark, sf):
    return R.revision_sizes(_revisions(spark, sf).rows(), ["k", "valid_from"], "value")


# Files of up to 1000 customers of a nation, in blocks of 256 bytes.


def _customer_files(spark, sf, folder: str, changed: bool = False) -> None:
    part = F.floor(F.col("c_custkey") / 1000)
    key = F.when((F.col("c_custkey") % 1000 == 7) & F.lit(changed), -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    line = F.format_string("%08d,%d\n", key, "c_nationkey")
    files = t(spark, sf, "customer").groupBy("c_nationkey", part.alias("part")).agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("text"))
    GF.write_files(files.select(F.format_string("n%02d-%d.txt", "c_nationkey", "part").alias("name"), "text"), folder)


def _files_sql(name: str, key: str) -> str:
    return f"""{name}f AS (SELECT printf('n%02d-%d.txt', c_nationkey, c_custkey // 1000) AS file, string_agg(line, '' ORDER BY line) AS body FROM (SELECT *, printf('%08d,%d', {key}, c_nationkey) || chr(10) AS line FROM customer) GROUP BY c_nationkey, c_custkey // 1000),
{name} AS (SELECT file, length(body) AS size, i, sha256(substr(body, (i * 256 + 1)::INT, 256)) AS s FROM {name}f, LATERAL (SELECT unnest(range(0, (length(body) + 255) // 256)) AS i))"""


_FILES = _files_sql("b", "c_custkey")
_CHANGED = _files_sql("n", "CASE WHEN c_custkey % 1000 = 7 THEN -c_custkey ELSE c_custkey END")


@query("block_manifest", f"WITH {_FILES} SELECT file, any_value(size) AS length, count(*) AS n_blocks, sha256(unhex(string_agg(s, '' ORDER BY i))) AS root FROM b GROUP BY file")
def _(spark, sf):
    folder = K.new_folder(spark, "files")
    _customer_files(spark, sf, folder)
    return M.manifest(spark, folder, 256)


@query("changed_blocks", f"WITH {_FILES}, {_CHANGED} SELECT file, i, 'changed' AS what FROM b JOIN n USING (file, i) WHERE b.s <> n.s")
def _(spark, sf):
    """The blocks that differ after one customer of a thousand has changed; its line moves to the front of its file."""
    old, new = K.new_folder(spark, "files"), K.new_folder(spark, "files")
    _customer_files(spark, sf, old)
    _customer_files(spark, sf, new, changed=True)
    return M.differences(M.blocks(spark, old, 256), M.blocks(spark, new, 256))


_TERMS = "the der entre license public"


@query("indexed_search", f"""WITH tk AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3) AS t FROM documents),
tot AS (SELECT count(*) AS nd, avg(len(t)) AS ms FROM tk), hit AS (SELECT doc_id, len(t) AS size, unnest(list_filter(t, lambda w: w IN ('the', 'der', 'entre', 'license', 'public'))) AS w FROM tk), tf AS (SELECT doc_id, size, w, count(*) AS tf FROM hit GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT doc_id, sum(ln((nd - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / ms))) AS score FROM tf JOIN df USING (w) CROSS JOIN tot GROUP BY 1)
SELECT (row_number() OVER (ORDER BY round(score, 9) DESC, doc_id))::INT AS rank, doc_id, {rd('score')} AS score FROM s QUALIFY rank <= 25""")
def _(spark, sf):
    """The same scores as bm25_search, from a stored index, for the best 25."""
    folder = K.new_folder(spark, "text-index")
    TI.build(t(spark, sf, "documents"), folder)
    return TI.search(TI.load(spark, folder), _TERMS, 25)
