"""Queries of checked writes, of drifting JSON and of Spanish order and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import collated as CO
from tidemark.operators import observed as OB, variants as V
from tidemark.plans.series_queries import rd, rounded
from tidemark.sinks.publication import new_folder
from tidemark.sources import points as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


_RULES = """r AS (SELECT o_orderkey, o_totalprice, o_totalprice BETWEEN 1000 AND 400000 AS price, o_orderdate < TIMESTAMP '1998-07-01' AS not_future, o_orderpriority <> '4-NOT SPECIFIED' OR o_orderkey % 7 <> 0 AS priority FROM orders)"""


def _checked(spark, sf) -> OB.Checked:
    rules = {
        "price": F.col("o_totalprice").between(1000, 400000),
        "not_future": F.col("o_orderdate") < F.lit("1998-07-01").cast("date"),
        "priority": (F.col("o_orderpriority") != "4-NOT SPECIFIED") | (F.col("o_orderkey") % 7 != 0),
    }
    return OB.write_checked(P.table(spark, sf, "orders"), new_folder(spark, "checked"), rules, ["o_totalprice"])


@query("checked_metrics", f"""WITH {_RULES}, m AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT (price AND not_future AND priority)) AS bad FROM r)
SELECT 'rows' AS name, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'rejected', bad FROM m UNION ALL SELECT 'price', count(*) FILTER (WHERE NOT price) FROM r UNION ALL SELECT 'not_future', count(*) FILTER (WHERE NOT not_future) FROM r
UNION ALL SELECT 'priority', count(*) FILTER (WHERE NOT priority) FROM r UNION ALL SELECT 'least', {rd('min(o_totalprice)')} FROM r UNION ALL SELECT 'most', {rd('max(o_totalprice)')} FROM r UNION ALL SELECT 'share ' || CASE WHEN bad > 0.1 * n THEN 'FAILED' WHEN bad > 0 THEN 'DEGRADED' ELSE 'OK' END, {rd('bad / n')} FROM m""")
def _(spark, sf):
    """The metrics of a write, which read the orders once: counts, broken rules, bounds and the state that follows."""
    done = _checked(spark, sf)
    m, quality = done.metrics, done.quality().select(F.concat(F.lit("share "), "state").alias("name"), F.col("share").alias("value"))
    named = [("rows", m["rows"]), ("rejected", m["rejected"]), ("least", m["least_o_totalprice"]), ("most", m["most_o_totalprice"])]
    rows = spark.createDataFrame([(k, float(v)) for k, v in named], "name string, value double")
    return rows.unionByName(done.by_rule().select(F.col("rule").alias("name"), F.col("broken").cast("double").alias("value"))).unionByName(quality)


@query("rejected_rows", f"WITH {_RULES} SELECT o_orderkey, concat_ws(',', CASE WHEN NOT price THEN 'price' END, CASE WHEN NOT not_future THEN 'not_future' END, CASE WHEN NOT priority THEN 'priority' END) AS broken FROM r WHERE NOT (price AND not_future AND priority)")
def _(spark, sf):
    return _checked(spark, sf).rejected().select("o_orderkey", F.array_join("broken", ",").alias("broken"))


@query("accepted_rows", f"WITH {_RULES} SELECT count(*) AS n, {rd('sum(o_totalprice) / 1000000')} AS total, count(DISTINCT o_orderkey % 10) AS ends FROM r WHERE price AND not_future AND priority")
def _(spark, sf):
    return _checked(spark, sf).accepted().agg(F.count(F.lit(1)).alias("n"), (F.sum("o_totalprice") / 1000000).alias("total"), F.count_distinct(F.col("o_orderkey") % 10).alias("ends"))


# Properties of events whose field k was renamed, nested, put in a list and written as text over time.

_K = "(props::JSON->>'$.k')::BIGINT"


def _drifting(spark, sf):
    k, i = F.get_json_object("props", "$.k"), F.col("event_id") % 7
    shape = (
        F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit('{"key": "'), k, F.lit('"}'))).when(i == 2, F.concat(F.lit('{"data": {"k": '), k, F.lit(', "unit": "m"}}')))
        .when(i == 3, F.concat(F.lit('{"history": [{"k": '), k, F.lit("}, 1]}"))).when(i == 4, F.lit('{"k": "n/a"}')).when(i == 5, F.concat(F.lit('{"k": '), k, F.lit(".0}"))).otherwise("not json")
    )
    return P.table(spark, sf, "events").select("event_id", "user_id", "event_type", shape.alias("text"))


_PLACES = {"k": (["$.k", "$.key", "$.data.k", "$.history[0].k"], "bigint"), "unit": (["$.data.unit"], "string")}


@query("drifting_json", f"SELECT event_id, event_id % 7 <> 6 AS is_json, CASE WHEN event_id % 7 IN (4, 6) THEN NULL ELSE {_K} END AS k, CASE WHEN event_id % 7 = 2 THEN 'm' END AS unit FROM events")
def _(spark, sf):
    return V.normalised(_drifting(spark, sf), "text", _PLACES).select("event_id", "is_json", "k", "unit")


@query("score_history", f"SELECT user_id, event_type, count(*) AS n, min({_K}) AS least, max({_K}) AS most, {rd(f'avg({_K})')} AS mean FROM events WHERE event_id % 7 NOT IN (4, 6) GROUP BY 1, 2")
def _(spark, sf):
    return V.grouped_history(V.normalised(_drifting(spark, sf), "text", _PLACES), ["user_id", "event_type"], "k")


@query("drifting_fields", """WITH e AS (SELECT event_id % 7 AS i, count(*) AS n FROM events GROUP BY 1), f(i, name, kind) AS (VALUES (0, 'k', 'BIGINT'), (1, 'key', 'STRING'), (2, 'data', 'OBJECT<k: BIGINT, unit: STRING>'), (3, 'history', 'ARRAY<VARIANT>'), (4, 'k', 'STRING'), (5, 'k', 'DECIMAL(3,0)'))
SELECT name, CASE WHEN i = 5 THEN 'DECIMAL' ELSE kind END AS kind, sum(n)::BIGINT AS n FROM e JOIN f USING (i) GROUP BY 1, 2""")
def _(spark, sf):
    """Each name and type that the outermost objects have; decimals of all lengths are one type here."""
    found = V.paths(_drifting(spark, sf), "text")
    return found.groupBy("name", F.when(F.col("kind").startswith("DECIMAL"), "DECIMAL").otherwise(F.col("kind")).alias("kind")).agg(F.sum("n").alias("n"))


# A glossary of the words of Spanish documents: each word with the number of its documents.

_WORDS = """w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+')) AS term FROM documents WHERE lang = 'es'), g AS (SELECT term, count(*) AS n FROM w GROUP BY 1),
e AS (SELECT term, n, ['costero', 'cuenca', 'general', 'institucional', 'físico'][length(term) % 5 + 1] AS category, translate(lower(term), 'áéíóúü', 'aeiouu') AS folded FROM g)"""


def _entries(spark, sf):
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"), F.lit(0))))
    terms = P.table(spark, sf, "documents").where("lang = 'es'").select("doc_id", words.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    categories = F.array(*map(F.lit, ("costero", "cuenca", "general", "institucional", "físico")))
    return terms.select(F.col("term").alias("id"), "term", F.element_at(categories, F.length("term") % 5 + 1).alias("category"), F.lit("").alias("short"), F.lit(None).cast("string").alias("full"), "n")


@query("glossary_search", f"WITH {_WORDS} SELECT term, category, n FROM e WHERE contains(folded || '   ' || translate(category, 'í', 'i'), 'cion') AND category = 'físico'")
def _(spark, sf):
    """Words with cion, Ción or CIÓN in them, of one category named without its accent."""
    return CO.search_glossary(_entries(spark, sf), " Ción ", "FISICO").select("term", "category", "n")


@query("glossary_order", f"WITH {_WORDS} SELECT (row_number() OVER (ORDER BY replace(folded, 'ñ', 'n~'), term))::INT AS place, term FROM (SELECT replace(folded, 'ñ', 'n~') AS k, folded, min(term) AS term FROM e GROUP BY 1, 2) QUALIFY place <= 300")
def _(spark, sf):
    """The first 300 words in Spanish order, one of those that differ in accents or case only."""
    one = _entries(spark, sf).groupBy(F.collate("term", CO.SEARCH).alias("k")).agg(F.min("term").alias("term"))
    first = CO.in_order(one.select(F.col("term").alias("id"), "term"), 300)
    return first.agg(F.collect_list("term").alias("l")).select(F.posexplode("l").alias("i", "term")).select((F.col("i") + 1).alias("place"), "term")
