"""Queries of the status, its checks, and retrieval of topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import status as Z, synthesis as Y
from tidemark.plans.series_queries import rd, rounded
from tidemark.sources import points as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TOPICS = [("k1", "the of/and"), ("k2", "der die"), ("k3", "le la"), ("k4", "termoclina")]


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


_STATUS = f"""WITH {P.POINTS_SQL}, l AS (SELECT indicator_id, max(month) AS month, arg_max(value, month_idx) AS v, arg_max(flag, month_idx) AS flag FROM points WHERE value IS NOT NULL GROUP BY 1),
a AS (SELECT *, date_diff('day', last_day((month || '-01')::DATE), DATE '2001-10-25') AS age FROM l),
st AS (SELECT indicator_id, month, v, CASE WHEN age > 90 THEN 'STALE' WHEN age > 45 THEN 'DELAYED' WHEN flag = 'preliminary' THEN 'PRELIMINARY' ELSE 'CURRENT' END AS state FROM a),
s AS (SELECT indicator_id, month, state, CASE WHEN state <> 'STALE' THEN v END AS value, v AS last_known FROM st)"""


_CATEGORY = """CASE WHEN value IS NULL THEN 'Sin datos'
WHEN indicator_id = 'nino12' THEN CASE WHEN abs(value) < 0.4 THEN 'Normal' ELSE CASE WHEN value >= 0 THEN 'El Niño Costero' ELSE 'La Niña Costera' END || CASE WHEN abs(value) < 1.0 THEN ' débil' WHEN abs(value) < 1.5 THEN ' moderado' WHEN abs(value) < 2.0 THEN ' fuerte' ELSE ' muy fuerte' END END
WHEN indicator_id = 'nino34' THEN CASE WHEN value >= 0.5 THEN 'El Niño (cuenca)' WHEN value <= -0.5 THEN 'La Niña (cuenca)' ELSE 'ENSO Neutral (cuenca)' END
WHEN indicator_id = 'soi' THEN CASE WHEN value <= -0.5 THEN 'Componente atmosférica de El Niño' WHEN value >= 0.5 THEN 'Componente atmosférica de La Niña' ELSE 'Componente atmosférica neutral' END
WHEN indicator_id = 'u850' THEN CASE WHEN value > 0 THEN 'Viento hacia el este (westerly)' WHEN value < 0 THEN 'Viento hacia el oeste (easterly)' ELSE 'Calmo' END
WHEN indicator_id = 'd20' THEN CASE WHEN value > 10 THEN 'Termoclina más profunda de lo normal (El Niño)' WHEN value < -10 THEN 'Termoclina más somera de lo normal (La Niña)' ELSE 'Termoclina cerca de la profundidad normal' END END"""
_RAPID = """ro AS (SELECT CASE event_type WHEN 'view' THEN 'nino12_daily_observation' WHEN 'click' THEN 'nino34_daily_observation' ELSE 'old_daily_observation' END AS metric_id, 'src-' || user_id % 3 AS source_id, ts::DATE AS day,
avg(value) FILTER (WHERE value > 20) AS value, CASE WHEN user_id % 2 = 0 THEN 'final' ELSE 'preliminary' END AS flag, count(*) AS point_count
FROM events WHERE event_type IN ('view', 'click') OR event_type = 'error' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL),
rl AS (SELECT * FROM ro WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY day DESC, flag = 'final' DESC, source_id DESC) = 1),
rr AS (SELECT metric_id, source_id, day, flag, CASE WHEN date_diff('day', day, DATE '2024-01-31') > 7 THEN 'STALE' WHEN date_diff('day', day, DATE '2024-01-31') > 3 THEN 'DELAYED' WHEN flag = 'preliminary' THEN 'PRELIMINARY' ELSE 'CURRENT' END AS state, value AS v, point_count FROM rl)"""


def _rapid(spark, sf):
    e = P.table(spark, sf, "events").where("event_type in ('view', 'click') or event_type = 'error' and ts < timestamp '2024-01-20'")
    metric = F.when(F.col("event_type") == "view", "nino12_daily_observation").when(F.col("event_type") == "click", "nino34_daily_observation").otherwise("old_daily_observation")
    keys = [metric.alias("metric_id"), F.concat(F.lit("src-"), F.col("user_id") % 3).alias("source_id"), F.col("ts").cast("date").alias("day"), F.when(F.col("user_id") % 2 == 0, "final").otherwise("preliminary").alias("flag")]
    observed = e.groupBy(*keys).agg(F.avg(F.when(F.col("value") > 20, F.col("value"))).alias("value"), F.count(F.lit(1)).alias("point_count"))
    return Z.rapid_rows(observed, F.lit("2024-01-31").cast("date"))


def _status(spark, sf):
    return Z.status_rows(P.indicator_points(spark, sf), F.lit("2001-10-25").cast("date"))


@query("status_rows", f"{_STATUS} SELECT indicator_id, month, state, {rd('value')} AS value, {rd('last_known')} AS last_known, {_CATEGORY} AS category FROM s")
def _(spark, sf):
    return _status(spark, sf)


@query("rapid_observations", f"WITH {_RAPID} SELECT metric_id, source_id, day, flag, state, {rd("CASE WHEN state <> 'STALE' THEN v END")} AS value, {rd('v')} AS last_known, point_count FROM rr")
def _(spark, sf):
    return _rapid(spark, sf)


@query("status_document_with_rapid", f"{_STATUS}, {_RAPID} SELECT 'indicator' AS kind, indicator_id AS name, state, {rd('last_known')} AS last_known FROM s UNION ALL SELECT 'rapid', metric_id, state, {rd('v')} FROM rr")
def _(spark, sf):
    kind = "publicationId string, indicators array<struct<indicator_id:string,state:string,last_known:double>>, rapidObservations array<struct<metric_id:string,state:string,last_known:double>>"
    back = Z.status_document(_status(spark, sf), "p1", _rapid(spark, sf)).select(F.from_json("json", kind).alias("j"))
    part = lambda kind, at: back.select(F.lit(kind).alias("kind"), F.explode(at).alias("x")).select("kind", "x.*").toDF("kind", "name", "state", "last_known")
    return part("indicator", "j.indicators").unionByName(part("rapid", "j.rapidObservations"))


@query("status_document", f"{_STATUS} SELECT 'p1' AS publication_id, indicator_id, month, state, {rd('value')} AS value, {rd('last_known')} AS last_known FROM s")
def _(spark, sf):
    kind = "publicationId string, indicators array<struct<indicator_id:string,month:string,state:string,value:double,last_known:double>>"
    back = Z.status_document(_status(spark, sf), "p1").select(F.from_json("json", kind).alias("j"))
    return back.select(F.col("j.publicationId").alias("publication_id"), F.explode("j.indicators").alias("x")).select("publication_id", "x.*")


@query("status_disagreements", f"{_STATUS} SELECT indicator_id, {rd('round(value, 1)')} AS value, {rd('last_known')} AS series_value FROM s WHERE abs(round(value, 1) - last_known) > 0.01")
def _(spark, sf):
    return Z.disagreements(_status(spark, sf).withColumn("value", F.round("value", 1)), P.indicator_points(spark, sf))


@query("text_problems", r"""WITH c AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents), p AS (
SELECT doc_id, 'too few lines' AS problem FROM c WHERE len(l) < 3 UNION ALL SELECT doc_id, 'line too long' FROM c WHERE list_max(list_transform(l, lambda x: length(x))) > 2000
UNION ALL SELECT doc_id, 'no marker' FROM c WHERE NOT contains(text, 'the') UNION ALL SELECT doc_id, 'markup' FROM c WHERE regexp_matches(text, '(?i)<html|<!doctype') UNION ALL SELECT doc_id, 'not plain' FROM c WHERE regexp_matches(text, '[^\x00-\x7F]'))
SELECT doc_id::VARCHAR AS name, problem FROM p""")
def _(spark, sf):
    docs = P.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    return Z.text_problems(docs, 3, 2000, "the")


@query("question_topics", r"""WITH q AS (SELECT DISTINCT conv_id * 1000 + turn AS question_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM conversations),
t AS (SELECT topic_id, unnest(regexp_split_to_array(lower(words), '[\s/]+')) AS word FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in TOPICS) + """) v(topic_id, words))
SELECT DISTINCT question_id, topic_id FROM q JOIN t USING (word)""")
def _(spark, sf):
    q = P.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    return Z.topics_for(q, spark.createDataFrame(TOPICS, "topic_id string, words string"))


@query("merged_set_years", "SELECT year(o_orderdate)::INT AS year, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1")
def _(spark, sf):
    o = P.table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    merged = Z.merged_set([o.where("o_totalprice > 200000"), o.withColumn("o_totalprice", F.least("o_totalprice", F.lit(200000.0))), o.limit(0)], "o_orderkey")
    return merged.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query("peak_month", f"""WITH {P.POINTS_SQL} SELECT indicator_id, arg_max(month, (value, -month_idx)) AS month, {rd('max(value)')} AS value FROM points WHERE value IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    p = P.indicator_points(spark, sf).where("value is not null")
    return p.groupBy("indicator_id").agg(F.max_by("month", F.struct("value", -F.col("month_idx"))).alias("month"), F.max("value").alias("value"))


@query("forecast_total_probability", "SELECT 12::BIGINT AS seasons, true AS in_range")
def _(spark, sf):
    f = Y.forecast(P.indicator_points(spark, sf))
    total = F.col("prob_nino") + F.col("prob_neutral") + F.col("prob_nina")
    return f.agg(F.count(F.lit(1)).alias("seasons"), F.bool_and(total.between(95, 101)).alias("in_range"))
