"""Queries of release checks, contracts of sources, documents and small labels. Texts are made from base facts and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import policies, scalars as S
from tidemark.operators import events as E, quality as Q, release as R, windows as W
from tidemark.plans.series_queries import _HISTORY, rd, rounded
from tidemark.plans.table_queries import _GRID, _MONTHLY, _grid, _monthly
from tidemark.sinks import publication as K
from tidemark.sources import contracts as C, documents as D, grids as G, points as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
t = P.table


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


# Published files: one JSON text per customer.

_FILES = """f AS (SELECT c_custkey AS k, 'c' || c_custkey || '.json' AS name, c_custkey % 97 = 0 AS broken, CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 53 = 0 THEN 'p2' ELSE 'p1' END AS id,
c_custkey % 31 = 0 OR c_custkey % 31 = 2 AS made_up FROM customer)"""
_FILE_PROBLEMS = """pr AS (SELECT name, 'not JSON' AS problem FROM f WHERE broken UNION ALL SELECT name, 'no publication id' FROM f WHERE NOT broken AND id IS NULL
UNION ALL SELECT name, 'another publication id' FROM f WHERE NOT broken AND id = 'p2' UNION ALL SELECT name, 'made-up data' FROM f WHERE made_up AND NOT broken)"""


def _files(spark, sf):
    k = F.col("c_custkey")
    pub = F.when(k % 41 == 0, F.lit(None)).when(k % 53 == 0, "p2").otherwise("p1")
    note = F.when(k % 31 == 0, "Serie Synthetic").when(k % 31 == 1, "this is not synthetic").when(k % 31 == 2, "DEMOSTRACIÓN").otherwise(F.col("c_mktsegment"))
    body = F.when(k % 97 == 0, F.lit('{"publicationId": ')).otherwise(F.to_json(F.struct(pub.alias("publicationId"), note.alias("note"))))
    return t(spark, sf, "customer").select(F.concat(F.lit("c"), k.cast("string"), F.lit(".json")).alias("name"), body.alias("text"))


def _file_problems(spark, sf):
    files = _files(spark, sf)
    return R.id_problems(files).unionByName(R.label_problems(files))


@query("file_problems", f"WITH {_FILES}, {_FILE_PROBLEMS} SELECT name, problem FROM pr")
def _(spark, sf):
    return _file_problems(spark, sf)


@query("publication_report", f"WITH {_FILES}, {_FILE_PROBLEMS} SELECT count(*) = 0 AS passed, count(*) AS errors, count(DISTINCT name) AS names FROM pr")
def _(spark, sf):
    return R.report(_file_problems(spark, sf))


@query("health_problems", """WITH h AS (SELECT s_suppkey::VARCHAR AS name, s_suppkey AS k FROM supplier)
SELECT name, 'no evidence' AS problem FROM h WHERE k % 10 = 0 UNION ALL SELECT name, 'unknown status' FROM h WHERE k % 7 = 3 UNION ALL SELECT name, 'unknown freshness' FROM h WHERE k % 5 = 2 OR k % 5 = 4
UNION ALL SELECT name, 'no valid period' FROM h WHERE k % 7 NOT IN (1, 2, 3) AND k % 6 = 0""")
def _(spark, sf):
    k = F.col("s_suppkey")
    health = t(spark, sf, "supplier").select(
        k.alias("id"), F.when(k % 10 != 0, F.concat(F.lit("page of "), k.cast("string"))).otherwise("").alias("evidence"),
        F.when(k % 7 == 1, "FAILED").when(k % 7 == 2, "QUARANTINED").when(k % 7 == 3, "BROKEN").otherwise("HEALTHY").alias("status"),
        F.when(k % 5 == 0, "CURRENT").when(k % 5 == 1, "STALE").when(k % 5 == 2, "FRESH").when(k % 5 == 3, "NOT_DUE").alias("freshness"),
        F.when(k % 6 != 0, F.lit("2026-07")).alias("valid_end"),
    )
    return R.health_problems(health)


@query("manifest_problems", """SELECT 'c' || c_custkey AS name, 'listed, not there' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 11 <> 0)
UNION ALL SELECT DISTINCT 'c' || o_custkey, 'there, not listed' FROM orders WHERE o_custkey % 11 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def _(spark, sf):
    listed = t(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))
    there = t(spark, sf, "orders").where("o_custkey % 11 <> 0").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"))
    hidden = there.select(F.concat(F.lit("."), "name").alias("name"))
    return R.manifest_problems(listed, there.unionByName(hidden))


@query("release_problems", """SELECT 'manifest' AS name, 'another data version' AS problem FROM nation WHERE n_regionkey = 3
UNION ALL SELECT s_suppkey::VARCHAR, 'failed without a stale value' FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0
UNION ALL SELECT DISTINCT 's' || l_suppkey, 'source is absent' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 <> 0)""")
def _(spark, sf):
    s, named = t(spark, sf, "supplier"), lambda c: F.concat(F.lit("s"), F.col(c).cast("string")).alias("name")
    versions = t(spark, sf, "nation").select(F.when(F.col("n_regionkey") == 3, "2.9").otherwise("3.1").alias("data_version"))
    indicators = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4 != 0).alias("ok"), (F.col("s_suppkey") % 3 == 0).alias("stale"))
    return R.release_problems(versions, indicators, s.where("s_suppkey % 9 <> 0").select(named("s_suppkey")), t(spark, sf, "lineitem").select(named("l_suppkey")), "3.1")


# Contracts of source texts: each priority's monthly means as a text of each kind.

_CONTRACT_KINDS = ("seasonal", "dated", "monthly")
_PRIORITIES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


def _contract_texts(spark, sf):
    """Seasonal texts of the first priority lack a header, dated ones of the second end in a word, monthly ones of the third are cut."""
    m = _monthly(spark, sf)
    lines = m.select("k", F.format_string("%04d-%02d", "y", "m").alias("month"), F.element_at(F.array(*map(F.lit, S.SEASONS)), F.col("m")).alias("season"), "y", "m", F.format_string("%.2f", "v").alias("v"))
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("month", c.alias("l")))), lambda x: x["l"]), "\n")
    texts = lines.groupBy("k").agg(ordered(F.concat_ws(" ", "season", F.col("y").cast("string"), "v")).alias("seasonal"), ordered(F.concat(F.col("month"), F.lit("-01,"), F.col("v"))).alias("dated"))
    wide = m.groupBy("k", "y").pivot("m", list(range(1, 13))).agg(F.first("v"))
    cells = F.concat(F.col("y").cast("string"), *(F.when(F.col(str(i)).isNotNull(), F.format_string("%+.2f", F.col(str(i)))).otherwise("-999.9") for i in range(1, 13)))
    years = wide.select("k", "y", F.concat(F.substring(cells, 1, 4), F.lit(" "), F.substring(cells, 5, 10_000)).alias("l")).groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "l"))), lambda x: x["l"]), "\n").alias("monthly"))
    k = F.col("k")
    return (
        texts.join(years, "k")
        .select(
            "k",
            F.explode(F.array(
                F.struct(F.lit("seasonal").alias("kind"), F.concat(F.when(k == "1-URGENT", "# x\n").otherwise("SEAS YR ANOM\n"), F.when(k == "1-URGENT", F.replace("seasonal", F.lit("DJF"), F.lit("D_F"))).otherwise(F.col("seasonal"))).alias("text")),
                F.struct(F.lit("dated").alias("kind"), F.concat(F.lit("# c\nDate,Value\n"), F.col("dated"), F.when(k == "2-HIGH", "\n2001-01-01,x").otherwise("")).alias("text")),
                F.struct(F.lit("monthly").alias("kind"), F.when(k == "3-MEDIUM", F.regexp_replace("monthly", r"[-+]\S+$", "")).otherwise(F.col("monthly")).alias("text")),
            )).alias("x"),
        )
        .select(F.col("k").alias("source_id"), "x.*")
    )


_CONTRACTS = f"""WITH {_MONTHLY}, s AS (SELECT k, count(*) AS n, max(y * 12 + m - 1) AS hi, count(DISTINCT y) AS ny FROM m GROUP BY 1), x AS (
SELECT k AS source_id, 'seasonal' AS kind, CASE WHEN k = '1-URGENT' THEN 'no header' WHEN n + 1 < 60 THEN 'too few lines' END AS problem, hi FROM s
UNION ALL SELECT k, 'dated', CASE WHEN n + 1 + (k = '2-HIGH')::INT < 60 THEN 'too few lines' WHEN k = '2-HIGH' THEN 'last line is not numeric' END, hi FROM s
UNION ALL SELECT k, 'monthly', CASE WHEN ny < 5 THEN 'too few lines' WHEN k = '3-MEDIUM' THEN 'too few values' END, hi FROM s)"""


def _judged_texts(spark, sf):
    texts = _contract_texts(spark, sf)
    least = {"seasonal": 60, "dated": 60, "monthly": 5}
    found = F.lit(None).cast("struct<problem:string,period:string>")
    for kind, n in least.items():
        found = F.when(F.col("kind") == kind, C.CONTRACTS[kind](F.col("text"), n)).otherwise(found)
    return texts.select("source_id", "kind", found.alias("f")).select("source_id", "kind", "f.problem", "f.period")


@query("source_contracts", f"{_CONTRACTS} SELECT source_id, kind, problem, CASE WHEN problem IS NULL THEN printf('%04d-%02d', (hi // 12)::INT, (hi % 12 + 1)::INT) END AS period FROM x")
def _(spark, sf):
    return _judged_texts(spark, sf)


@query("contract_roll_up", f"{_CONTRACTS} SELECT count(*) FILTER (WHERE problem IS NULL) AS passed, count(*) FILTER (WHERE problem IS NOT NULL) AS failed, count(*) FILTER (WHERE problem IS NOT NULL AND kind <> 'monthly') = 0 AS may_release FROM x")
def _(spark, sf):
    return C.roll_up(_judged_texts(spark, sf), ("monthly",))


# CSV services: a text per month with one grid, texts of at most 1000 events with the stations of a day.


def _grid_texts(spark, sf):
    g = _grid(spark, sf).withColumn("at", F.concat(S.month_text(F.col("month_idx")), F.lit("-15T12:00:00Z")))
    k = F.col("month_idx")
    cell = F.when(F.col("value").isNull(), "NaN").when((k % 13 == 5) & (F.col("lat") == 0), "99.0").otherwise(F.format_string("%.6f", "value"))
    line = F.concat_ws(",", "at", F.when(k % 13 == 2, "5.0").otherwise("0.0"), F.col("lat").cast("string"), F.col("lon").cast("string"), cell)
    body = g.groupBy("month_idx").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("b"), F.min(line).alias("first"))
    names = F.when(k % 13 == 0, "time,depth,latitude,longitude,sst").otherwise("time,depth,latitude,longitude,anom")
    units = F.when(k % 13 == 1, "UTC,m,degrees_north,degrees_east,K").otherwise("UTC,m,degrees_north,degrees_east,degree_C")
    again = F.when(k % 13 == 3, F.concat(F.lit("\n"), F.col("first"))).otherwise("")
    return body.select(k.cast("long").alias("month_idx"), F.concat_ws("\n", names, units, "b").alias("t"), again.alias("a")).select("month_idx", F.concat("t", "a", F.lit("\nragged,line")).alias("text"))


@query("grid_contracts", f"""WITH {_GRID}, x AS (SELECT month_idx::BIGINT AS month_idx, count(value) AS n, sum(round(value, 6) * cos(radians(lat))) / sum(cos(radians(lat))) FILTER (WHERE value IS NOT NULL) AS mean,
count(*) FILTER (WHERE value IS NOT NULL AND lat = 0) AS mid FROM gg GROUP BY 1),
p AS (SELECT *, CASE month_idx % 13 WHEN 0 THEN 'column is absent' WHEN 1 THEN 'unit changed' WHEN 2 THEN 'coordinates' WHEN 3 THEN 'duplicate cell' END AS early FROM x),
q AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN month_idx % 13 = 5 AND mid > 0 THEN 'implausible value' WHEN n = 0 THEN 'no values' END AS problem FROM p)
SELECT month_idx, {rd('CASE WHEN problem IS NULL THEN round(mean, 4) END')} AS value, CASE WHEN problem IS NULL THEN n END AS point_count, problem,
'sha256:' || substr(sha256('time|depth|latitude|longitude|' || CASE WHEN month_idx % 13 = 0 THEN 'sst' ELSE 'anom' END || chr(10) || 'UTC|m|degrees_north|degrees_east|' || CASE WHEN month_idx % 13 = 1 THEN 'K' ELSE 'degree_C' END), 1, 16) AS fingerprint FROM q""")
def _(spark, sf):
    found = C.grid_contract(_grid_texts(spark, sf), "month_idx", "anom", "degree_C", F.lit("2030-01-01").cast("timestamp"))
    return found.select("month_idx", "value", "point_count", "problem", "fingerprint")


@query("station_contracts", f"""WITH e AS (SELECT ts::DATE AS day, event_id // 1000 AS part, user_id % 50 AS st, date_trunc('minute', ts) AS tm, event_id % 4 AS grade, round(value, 3) AS v FROM events),
u AS (SELECT day, part, st, tm, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT day, part, max(n) AS copies FROM u GROUP BY 1, 2),
g AS (SELECT day, part, avg(v) FILTER (WHERE grade IN (1, 2)) AS mean, count(DISTINCT st) FILTER (WHERE grade IN (1, 2)) AS n, bool_or(st = 7) AS has7 FROM e GROUP BY 1, 2),
p AS (SELECT g.day, g.part, mean, n, CASE WHEN day(g.day) % 9 = 4 THEN 'unit changed' WHEN day(g.day) % 9 = 5 AND has7 THEN 'no station' WHEN copies > 1 THEN 'duplicate observation' WHEN n = 0 THEN 'no accepted values' END AS problem FROM g JOIN w USING (day, part))
SELECT day, part::BIGINT AS part, {rd('CASE WHEN problem IS NULL THEN round(mean, 4) END')} AS value, CASE WHEN problem IS NULL THEN n::INT END AS station_count, problem FROM p""")
def _(spark, sf):
    e = t(spark, sf, "events").select(
        F.col("ts").cast("date").alias("day"), F.floor(F.col("event_id") / 1000).alias("part"), F.when((F.day("ts") % 9 == 5) & (F.col("user_id") % 50 == 7), "").otherwise(F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string"))).alias("station"),
        F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), (F.col("event_id") % 4).cast("string").alias("grade"), F.format_string("%.3f", "value").alias("v"),
    )
    body = e.groupBy("day", "part").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", "station", F.lit("220.0"), F.lit("0.0"), "at", "v", "grade"))), "\n").alias("b"))
    units = F.when(F.day("day") % 9 == 4, ",degrees_east,degrees_north,UTC,K,").otherwise(",degrees_east,degrees_north,UTC,m,")
    texts = body.select(F.struct("day", "part").alias("id"), F.concat_ws("\n", F.lit("station,longitude,latitude,time,ISO_6,QI_5006"), units, "b").alias("text"))
    found = C.station_contract(texts, "id", "ISO_6", "m", "QI_5006", F.lit("2030-01-01").cast("timestamp"))
    return found.select("id.day", "id.part", "value", "station_count", "problem")


# Documents: a page or bulletin per supplier.

_ALERTS = "['Alerta de El Niño Costero', 'Vigilancia de El Niño Costero', 'Alerta de La Niña Costera', 'Vigilancia de La Niña Costera', 'No activo']"


@query("communiques", f"""WITH s AS (SELECT s_suppkey AS k FROM supplier), p AS (SELECT k, CASE WHEN k % 13 = 1 THEN 'host' WHEN k % 13 = 2 THEN 'path' WHEN k % 13 = 3 THEN 'no number' WHEN k % 13 = 4 THEN 'ambiguous alert' WHEN k % 13 = 5 THEN 'no alert' WHEN k % 13 = 6 THEN 'no date' END AS problem FROM s)
SELECT k, problem, CASE WHEN problem IS NULL THEN k::INT END AS number, CASE WHEN problem IS NULL THEN 2024 END AS year, CASE WHEN problem IS NULL THEN {_ALERTS}[k % 5 + 1] END AS alert,
CASE WHEN problem IS NULL THEN CASE WHEN k % 13 = 7 THEN DATE '2024-03-09' ELSE make_date(2024, (k % 12 + 1)::INT, (k % 28 + 1)::INT) END END AS date, CASE WHEN problem IS NULL THEN 2 END AS documents FROM p""")
def _(spark, sf):
    k = F.col("s_suppkey")
    alert = F.element_at(F.array(*map(F.lit, D.COASTAL_LABELS)), (k % 5 + 1).cast("int"))
    said = F.when(k % 13 == 4, "ALERTA DE EL NINO COSTERO y no activo").when(k % 13 == 5, "nada").otherwise(F.regexp_replace(F.upper(alert), " ", "\n "))
    name = F.when(k % 13 == 3, "COMUNICADO").otherwise(F.format_string("COMUNICADO OFICIAL ENFEN N° %d - 2024", k))
    date = F.when(k % 13 == 6, "").when(k % 13 == 7, "<i>9 March</i>").otherwise(F.format_string("<time datetime='2024-%02d-%02d'>", k % 12 + 1, k % 28 + 1))
    hrefs = F.lit('<a href="https://enfen.imarpe.gob.pe/b.PDF">b</a><a href="https://other.pe/c.pdf">c</a><a href="https://enfen.imarpe.gob.pe/x?a=1&amp;wpdmdl=7">x</a><a href="https://enfen.imarpe.gob.pe/b.PDF">b</a>')
    url = F.when(k % 13 == 1, "https://enfen.example.pe/download/comunicado-oficial-enfen-n-1-2024").when(k % 13 == 2, "https://enfen.imarpe.gob.pe/other").otherwise(F.format_string("https://enfen.imarpe.gob.pe/download/comunicado-oficial-enfen-n-%d-2024/", k))
    pages = t(spark, sf, "supplier").select(k.alias("k"), F.concat(url, F.format_string("#%d", k)).alias("url"), F.concat(date, F.lit("<h1>"), name, F.lit("</h1><p>"), said, F.lit("</p>"), hrefs).alias("html"))
    found = D.communiques(pages).select(F.substring_index("url", "#", -1).cast("long").alias("k"), "problem", "number", "year", "alert", "date", F.size("documents").alias("documents"))
    return found.withColumn("documents", F.when(F.col("problem").isNull(), F.col("documents")))


@query("bulletin_index", """WITH n AS (SELECT s_suppkey // 1000 * 100 + s_nationkey AS page_id, s_suppkey AS k FROM supplier), b AS (SELECT DISTINCT page_id FROM n WHERE page_id % 9 = 0),
r AS (SELECT page_id, strftime(DATE '2020-01-01' + (k % 2000)::INT, '%Y-%m-%d') AS period FROM n WHERE page_id % 9 <> 0 AND k % 5 <> 0), d AS (SELECT DISTINCT page_id, period FROM r)
SELECT page_id, period, row_number() OVER (PARTITION BY page_id ORDER BY period DESC)::INT AS place, NULL::VARCHAR AS problem FROM d UNION ALL SELECT page_id, NULL, 1, 'no index' FROM b""")
def _(spark, sf):
    k = F.col("s_suppkey")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 2000).cast("int")), "yyyy-MM-dd")
    host = F.when(k % 5 == 0, "elsewhere.pe").otherwise("siofen-admin.imarpe.gob.pe")
    link = F.format_string("<a href='https://%s/img/productoArchivo/BDO/BOL_IMARPE_BDO_%s.pdf'>x</a>", host, day)
    page = (F.floor(k / 1000) * 100 + F.col("s_nationkey")).cast("long")
    pages = t(spark, sf, "supplier").groupBy(page.alias("page_id")).agg(F.array_join(F.collect_list(F.concat(link, link)), "").alias("h"))
    html = F.concat(F.when(F.col("page_id") % 9 == 0, "<title>Just a moment...</title>").otherwise("<html>"), F.col("h"))
    found = D.bulletin_index(pages.select("page_id", html.alias("html")), "BDO")
    return found.select(F.col("page_id").cast("long").alias("page_id"), "period", "place", "problem")


@query("bulletin_pages", f"""WITH s AS (SELECT s_suppkey AS doc, s_suppkey % 11 AS c FROM supplier), p AS (SELECT *, CASE c WHEN 1 THEN 'title' WHEN 2 THEN 'no date' WHEN 3 THEN 'implausible range' WHEN 4 THEN 'not one range' WHEN 5 THEN 'not one range' END AS problem FROM s)
SELECT doc::BIGINT AS doc, problem, CASE WHEN problem IS NULL THEN CASE WHEN c = 6 THEN DATE '2024-12-30' ELSE make_date(2024, 2, (doc % 28 + 1)::INT) END END AS day, {rd("CASE WHEN problem IS NULL THEN 15.5::DOUBLE + doc % 5 END")} AS low,
CASE WHEN problem IS NULL THEN 'Callao' END AS low_station, {rd("CASE WHEN problem IS NULL THEN 24.1::DOUBLE END")} AS high, CASE WHEN problem IS NULL THEN 'Paita' END AS high_station FROM p""")
def _(spark, sf):
    k, c = F.col("s_suppkey"), F.col("s_suppkey") % 11
    title = F.when(c == 1, "OTRO").when(c == 7, "BOLETÍN SEMANAL de la TEMPERATURA  SUPERFICIAL del MAR").otherwise("Boletin Diario Oceanográfico")
    dates = F.when(c == 2, "sin fecha").when(c == 6, "del 30 de diciembre de 2024 y 1 de enero 2020").otherwise(F.format_string("del 30 de setiembre de 2025; para el %d de febrero de 2024", k % 28 + 1))
    one = F.format_string("valores de TSM entre %s °C (Callao), y %s °C ( Paita )", F.when(c == 3, "39,5").otherwise(F.format_string("%d,5", 15 + k % 5)), F.lit("24.1"))
    ranges = F.when(c == 4, "sin TSM").when(c == 5, F.concat(one, F.lit(". "), one)).otherwise(one)
    kind = F.when(c == 7, "BS-TLP").otherwise("BDO")
    both = F.array(F.struct(F.lit(1).alias("page_no"), title.alias("text")), F.struct(F.lit(2).alias("page_no"), F.concat(dates, F.lit(". Se registraron "), ranges).alias("text")))
    pages = t(spark, sf, "supplier").select(k.cast("long").alias("doc"), kind.alias("kind"), F.explode(both).alias("p")).select("doc", "kind", "p.page_no", "p.text")
    return D.bulletin_pages(pages)


# Classes, signals, labels.


@query("threshold_classes", f"""WITH {P.POINTS_SQL} SELECT indicator_id, month, CASE WHEN value < -1 THEN 'frio' WHEN value < 0 THEN 'fresco' WHEN value >= 0.5 THEN 'calido' END AS class FROM points""")
def _(spark, sf):
    bands = [("frio", float("-inf"), -1.0), ("fresco", -1.0, 0.0), ("calido", 0.5, float("inf"))]
    return P.indicator_points(spark, sf).select("indicator_id", "month", policies.classified(F.col("value"), bands).alias("class"))


@query("operational_signals", f"""WITH {P.POINTS_SQL}, l AS (SELECT indicator_id, arg_max(value, month_idx) AS v FROM points WHERE value IS NOT NULL GROUP BY 1)
SELECT indicator_id, {rd('v')} AS value, CASE WHEN v >= -0.7 AND v <= 0.5 THEN 'Normal' WHEN v >= 1.3 AND v <= 2.0 THEN 'Amarillo' WHEN v >= 2.1 THEN 'Rojo' ELSE 'Sin clasificar' END AS label,
CASE WHEN v >= -0.7 AND v <= 0.5 THEN 'green' WHEN v >= 1.3 AND v <= 2.0 THEN 'yellow' WHEN v >= 2.1 THEN 'red' ELSE 'gray' END AS color, NOT (v >= -0.7 AND v <= 0.5 OR v >= 1.3 AND v <= 2.0 OR v >= 2.1) AS unclassified FROM l""")
def _(spark, sf):
    return R.signals(W.latest_known(P.indicator_points(spark, sf)), policies.evaluate(F.col("value"), "coastal"))


@query("unavailable_products", """SELECT n_name || '.json' AS file, n_name AS product, 'UNAVAILABLE' AS status, 'not now' AS message FROM nation""")
def _(spark, sf):
    made = R.unavailable(t(spark, sf, "nation").select(F.col("n_name").alias("name")), "not now", "no source")
    back = made.select("file", F.from_json("json", "status string, message string, product string").alias("j"))
    return back.select("file", "j.product", "j.status", "j.message")


@query("scope_table", f"""WITH {P.POINTS_SQL}, {_HISTORY}, m AS (SELECT scope, count(*) AS n, count(*) FILTER (WHERE phase = 'El Niño') AS w, count(*) FILTER (WHERE phase = 'La Niña') AS c, avg(duration) AS d, avg(abs(peak_value)) AS p, max(abs(peak_value)) AS x FROM cat GROUP BY 1),
l AS (SELECT CASE indicator_id WHEN 'nino34' THEN 'cuenca' ELSE 'costero' END AS scope, arg_max_null(value, month_idx) AS v FROM points WHERE indicator_id IN ('nino12', 'nino34') GROUP BY 1)
SELECT scope, unnest(['events', 'warm', 'cold', 'mean duration', 'mean peak', 'largest peak', 'threshold', 'persistence', 'current', 'state']) AS metric,
unnest([n::VARCHAR, w::VARCHAR, c::VARCHAR, printf('%.1f', round(d, 1)), printf('%.2f', round(p, 2)), printf('%.2f', x), CASE scope WHEN 'cuenca' THEN '±0.5' ELSE '±0.4' END, '3 months', coalesce(printf('%.2f', round(v, 2) + 0.0::DOUBLE), '-'),
CASE WHEN v >= CASE scope WHEN 'cuenca' THEN 0.5 ELSE 0.4 END THEN 'El Niño' WHEN v <= -CASE scope WHEN 'cuenca' THEN 0.5 ELSE 0.4 END THEN 'La Niña' WHEN v IS NOT NULL THEN 'Neutral' ELSE '-' END]) AS value FROM m JOIN l USING (scope)""")
def _(spark, sf):
    p = P.indicator_points(spark, sf)
    return E.scope_table(E.event_catalog(p), p)


@query("display_labels", f"""WITH {P.POINTS_SQL} SELECT indicator_id, month, ['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic'][month_idx % 12 + 1] || ' ' || (1990 + month_idx // 12) AS month_label,
CASE WHEN value IS NULL THEN 'Sin datos' ELSE CASE WHEN round(value, 4) > 0 AND indicator_id <> 'soi' THEN '+' ELSE '' END || CASE WHEN indicator_id = 'd20' THEN printf('%.1f', round(value, 1) + 0.0::DOUBLE) ELSE printf('%.2f', round(value, 2) + 0.0::DOUBLE) END || CASE indicator_id WHEN 'd20' THEN ' m' WHEN 'u850' THEN ' m/s' WHEN 'soi' THEN '' ELSE ' °C' END END AS value_label FROM points""")
def _(spark, sf):
    units = F.when(F.col("indicator_id") == "d20", "m").when(F.col("indicator_id") == "u850", "m_per_s").when(F.col("indicator_id") == "soi", "1").otherwise("degC")
    return P.indicator_points(spark, sf).select("indicator_id", "month", S.month_label(F.col("month")).alias("month_label"), S.value_label(F.col("value"), units).alias("value_label"))


@query("asset_urls", r"""SELECT page_id, '/site/' || page_id % 7 || '/' || regexp_replace(trim(url), '^/+', '') AS address FROM pages""")
def _(spark, sf):
    base = F.concat(F.lit(" /site/"), (F.col("page_id") % 7).cast("string"), F.lit("// "))
    return t(spark, sf, "pages").select("page_id", S.asset_url(base, F.concat(F.lit(" //"), "url")).alias("address"))


@query("payout_scores", """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 100)::DOUBLE END AS ratio, CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey % 17 - 4)::DOUBLE END AS growth, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 40 END AS years, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 12::DOUBLE END AS rate FROM customer),
s AS (SELECT k, ratio, greatest(0, least(100, 50 + CASE WHEN ratio IS NULL THEN 0 WHEN ratio < 40 THEN 20 WHEN ratio < 60 THEN 10 WHEN ratio < 80 THEN -10 ELSE -20 END + CASE WHEN growth IS NULL THEN 0 WHEN growth > 10 THEN 15 WHEN growth > 5 THEN 10 WHEN growth > 0 THEN 5 ELSE -15 END
+ CASE WHEN years IS NULL THEN 0 WHEN years >= 25 THEN 15 WHEN years >= 10 THEN 10 WHEN years >= 5 THEN 5 ELSE 0 END - CASE WHEN rate > 8 THEN 10 ELSE 0 END))::INT AS score FROM c)
SELECT k, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio < 40 THEN 'safe' WHEN ratio < 60 THEN 'moderate' WHEN ratio < 80 THEN 'high' ELSE 'unsustainable' END AS payout_status, score,
CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'moderate' ELSE 'poor' END AS rating FROM s""")
def _(spark, sf):
    k = F.col("c_custkey")
    rows = t(spark, sf, "customer").select(
        k.alias("k"), F.when(k % 9 != 0, (k % 100).cast("double")).alias("payout_ratio"), F.when(k % 8 != 0, (k % 17 - 4).cast("double")).alias("growth"), F.when(k % 7 != 0, k % 40).alias("years"), F.when(k % 6 != 0, (k % 12).cast("double")).alias("yield")
    )
    return R.payout_scores(rows).select("k", "payout_status", "score", "rating")


_SUBSTITUTES = ["nino34-rolling-mean", "oni", "nino12-rolling-mean", "nino12-weekly", "nino34", "coastal-soi", "surface-wind", "wind-anomaly", "wind-other-region", "d20-point", "d20-from-chart-colours", "operational-signal", "roni-above-limit", "rapid-observation", "icen", "nino12-high", "noaa-cpc-roni"]
_METRICS = ["roni", "icen", "nino12", "nino34", "soi", "u850", "d20", "basin_official_status", "coastal_official_status"]


@query("prohibited_substitutions", """WITH u AS (SELECT p_partkey AS k, ['roni', 'icen', 'nino12', 'nino34', 'soi', 'u850', 'd20', 'basin_official_status', 'coastal_official_status'][p_partkey % 9 + 1] AS metric_id,
['nino34-rolling-mean', 'oni', 'nino12-rolling-mean', 'nino12-weekly', 'nino34', 'coastal-soi', 'surface-wind', 'wind-anomaly', 'wind-other-region', 'd20-point', 'd20-from-chart-colours', 'operational-signal', 'roni-above-limit', 'rapid-observation', 'icen', 'nino12-high', 'noaa-cpc-roni'][p_partkey % 17 + 1] AS source_id FROM part)
SELECT k, metric_id, source_id FROM u WHERE metric_id = 'roni' AND source_id IN ('nino34-rolling-mean', 'oni') OR metric_id = 'icen' AND source_id IN ('nino12-rolling-mean', 'nino12-weekly', 'nino34') OR metric_id = 'soi' AND source_id = 'coastal-soi'
OR metric_id = 'u850' AND source_id IN ('surface-wind', 'wind-anomaly', 'wind-other-region') OR metric_id = 'd20' AND source_id IN ('d20-point', 'd20-from-chart-colours')
OR metric_id = 'basin_official_status' AND source_id IN ('operational-signal', 'roni-above-limit', 'rapid-observation') OR metric_id = 'coastal_official_status' AND source_id IN ('icen', 'nino12-high')""")
def _(spark, sf):
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    return Q.prohibited_uses(t(spark, sf, "part").select(k.alias("k"), pick(_METRICS).alias("metric_id"), pick(_SUBSTITUTES).alias("source_id")))


@query("failure_runs", """WITH e AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok FROM events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM e),
g AS (SELECT user_id, grp, count(*) FILTER (WHERE NOT ok) AS n FROM r GROUP BY 1, 2) SELECT user_id, max(n) AS longest, arg_max(n, grp) AS current, arg_max(n, grp) >= 2 AS alarm FROM g GROUP BY 1""")
def _(spark, sf):
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return Q.failure_runs(e, "user_id", ["ts", "event_id"], failures=2)


@query("watchdog_failures", """WITH e AS (SELECT event_type, ts, event_id % 6 <> 0 AS ok, event_id FROM events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM e),
g AS (SELECT event_type, grp, count(*) FILTER (WHERE NOT ok) AS n FROM r GROUP BY 1, 2), f AS (SELECT event_type, arg_max(n, grp) AS failures FROM g GROUP BY 1), l AS (SELECT event_type, max(ts) FILTER (WHERE ok) AS last FROM e GROUP BY 1)
SELECT event_type, last, failures, date_diff('second', last, TIMESTAMP '2024-02-01') / 3600 > 30 AND failures < 3 AS alarm FROM f JOIN l USING (event_type)""")
def _(spark, sf):
    e = t(spark, sf, "events").select("event_type", "ts", "event_id", (F.col("event_id") % 6 != 0).alias("ok"))
    return Q.watchdog(e, "event_type", ["ts", "event_id"], F.lit("2024-02-01").cast("timestamp"))


@query("alert_states_by_indicator", f"""WITH {P.POINTS_SQL}, th(indicator_id, th) AS (VALUES ('nino12', 0.4::DOUBLE), ('nino34', 0.5::DOUBLE)), k AS (SELECT p.*, CASE WHEN value >= th THEN 'warm' WHEN value <= -th THEN 'cool' ELSE 'neutral' END AS side FROM points p JOIN th USING (indicator_id) WHERE value IS NOT NULL),
n AS (SELECT *, lag(side) OVER w IS DISTINCT FROM side AS new FROM k WINDOW w AS (PARTITION BY indicator_id ORDER BY month_idx)), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY indicator_id ORDER BY month_idx) AS g FROM n),
l AS (SELECT indicator_id, arg_max(g, month_idx) AS g FROM s GROUP BY 1) SELECT s.indicator_id, any_value(side) AS direction, (CASE WHEN any_value(side) = 'neutral' THEN 0 ELSE count(*) END)::INT AS consecutive FROM s JOIN l USING (indicator_id, g) GROUP BY 1""")
def _(spark, sf):
    return W.alert_states_of(P.indicator_points(spark, sf), {"nino12": 0.4, "nino34": 0.5}).select("indicator_id", "direction", "consecutive")


@query("series_catalogue", f"""WITH {P.POINTS_SQL}, s AS (SELECT indicator_id, any_value(scope) AS scope, count(*) AS n, min(month) AS first, max(month) AS last FROM points GROUP BY 1) SELECT indicator_id || ',' || scope || ',' || n || ',' || first || ',' || last AS line FROM s""")
def _(spark, sf):
    s = P.indicator_points(spark, sf).groupBy("indicator_id").agg(F.first("scope").alias("scope"), F.count(F.lit(1)).alias("n"), F.min("month").alias("first"), F.max("month").alias("last"))
    return s.select(K.quoted_csv(s).alias("line"))


# Facts in documents and files.


@query("complete_years", """WITH c AS (SELECT o_orderpriority AS k, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS m, avg(o_totalprice) / 100000 AS v FROM orders WHERE month(o_orderdate) % 5 <> 0 GROUP BY ALL),
y AS (SELECT DISTINCT k, year FROM c), f AS (SELECT k, year, unnest(range(1, 13))::INT AS m FROM y) SELECT f.k, f.year, f.m AS cal_month, """ + rd("c.v") + """ AS value FROM f LEFT JOIN c USING (k, year, m)""")
def _(spark, sf):
    o = t(spark, sf, "orders").where(F.month("o_orderdate") % 5 != 0)
    cells = o.groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("cal_month")).agg((F.avg("o_totalprice") / 100000).alias("value"))
    return G.complete_years(cells, "k").select("k", "year", "cal_month", "value")


_BASIN = "['Final El Niño Advisory', 'Final La Niña Advisory', 'El Niño Advisory', 'La Niña Advisory', 'El Niño Watch', 'La Niña Watch', 'Not Active']"


@query("advisories", f"""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 8 THEN 'Something else' ELSE {_BASIN}[s_suppkey % 7 + 1] END AS alert, CASE s_suppkey % 3 WHEN 0 THEN printf('%d July 2026', s_suppkey % 28 + 1) WHEN 1 THEN printf('July %d, 2026', s_suppkey % 28 + 1) END AS date,
'Part ' || s_suppkey || ' is expected.' AS synopsis FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    alert = F.when(k % 9 == 8, "Something else").otherwise(F.element_at(F.array(*map(F.lit, D.BASIN_ALERTS)), (k % 7 + 1).cast("int")))
    date = F.when(k % 3 == 0, F.format_string("%d July 2026", k % 28 + 1)).when(k % 3 == 1, F.format_string("July %d, 2026", k % 28 + 1)).otherwise("")
    text = F.concat(date, F.lit(" ENSO  Alert System Status: "), alert, F.lit(" Synopsis: "), F.format_string("Part %d is expected.", k), F.when(k % 2 == 0, " [12] more").otherwise(" Climate Prediction Center"))
    return t(spark, sf, "supplier").select(k.alias("k"), D.advisory(text).alias("a")).select("k", "a.*")


@query("index_statements", f"""WITH s AS (SELECT s_suppkey AS doc, s_suppkey % 7 AS c FROM supplier WHERE s_suppkey % 7 <> 6)
SELECT doc::VARCHAR AS doc, CASE c WHEN 1 THEN 'implausible value' WHEN 2 THEN 'ambiguous values' END AS problem, CASE WHEN c NOT IN (1, 2) THEN printf('%d-%02d', (2020 + doc % 5)::INT, (doc % 12 + 1)::INT) END AS period,
{rd("CASE WHEN c NOT IN (1, 2) THEN (doc % 40 - 20) / 10.0::DOUBLE END")} AS value, CASE WHEN c NOT IN (1, 2) THEN 2 END AS page_no FROM s""")
def _(spark, sf):
    k, c = F.col("s_suppkey"), F.col("s_suppkey") % 7
    month = F.element_at(F.array(*map(F.lit, D.MONTHS_ES)), (k % 12 + 1).cast("int"))
    number = F.translate(F.format_string("%.1f", (k % 40 - 20) / 10), "-.", "−,")
    said = F.concat(F.lit("El ICEN correspondiente a "), F.when(month == "septiembre", "setiembre").otherwise(month), F.lit(" de "), (2020 + k % 5).cast("string"), F.lit(" fue "), F.when(c == 1, "9,9").otherwise(number), F.lit(" °C. "))
    text = F.when(c == 2, F.concat(said, said)).when(c == 6, "El ICEN no se publica.").otherwise(said)
    both = F.array(F.struct(F.lit(1).alias("page_no"), F.lit("Nada del ICEN aquí").alias("text")), F.struct(F.lit(2).alias("page_no"), text.alias("text")))
    pages = t(spark, sf, "supplier").select(k.cast("string").alias("doc"), F.explode(both).alias("p")).select("doc", "p.*")
    return D.icen_facts(pages).select("doc", "problem", "period", "value", "page_no")


@query("newest_post", "SELECT arg_max(s_suppkey, (s_suppkey % 365, s_suppkey)) AS id, 'Comunicado ' || arg_max(s_suppkey, (s_suppkey % 365, s_suppkey)) AS title FROM supplier WHERE s_suppkey % 3 = 0")
def _(spark, sf):
    k = F.col("s_suppkey")
    rendered = lambda x: F.struct(x.alias("rendered"))
    day = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (k % 365).cast("int")), "yyyy-MM-dd")
    post = F.struct(k.alias("id"), day.alias("date"), rendered(F.concat(F.when(k % 3 == 0, "Comunicado ").otherwise("Nota "), k.cast("string"))).alias("title"), rendered(F.lit("<p>x</p>")).alias("content"))
    bodies = t(spark, sf, "supplier").groupBy(F.floor(k / 1000)).agg(F.to_json(F.collect_list(post)).alias("body"))
    return D.newest_post(bodies, "^Comunicado").select("id", "title")


@query("newest_link", "SELECT max(2000 + s_suppkey % 20)::INT AS year, max(s_suppkey) FILTER (WHERE s_suppkey % 20 = (SELECT max(s_suppkey % 20) FROM supplier))::INT AS number FROM supplier")
def _(spark, sf):
    link = F.format_string("<li><a class='x' href=\"/f/%d.pdf\">Boletín N° %d - %d</a>", "s_suppkey", "s_suppkey", 2000 + F.col("s_suppkey") % 20)
    pages = t(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 1000)).agg(F.array_join(F.collect_list(link), "").alias("html"))
    return D.newest_link(pages).select("year", "number")


@query("pdf_problems", "SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'wrong type' WHEN 1 THEN 'no header' WHEN 2 THEN 'no end' END AS problem, sha256('%PDF-1.7 ' || s_suppkey || ' %%EOF') AS digest FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey")
    whole = F.concat(F.lit("%PDF-1.7 "), k.cast("string"), F.lit(" %%EOF"))
    body = F.when(k % 5 == 1, F.concat(F.lit("x"), whole)).when(k % 5 == 2, F.substring_index(whole, " ", 2)).otherwise(whole)
    kind = F.when(k % 5 == 0, "text/html").otherwise("application/pdf; v=1")
    return t(spark, sf, "supplier").select(k.alias("k"), D.pdf_problem(F.encode(body, "utf-8"), kind).alias("problem"), F.sha2(whole, 256).alias("digest"))


@query("file_manifest", "SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS sha256, sum(length(n_name) + 1)::BIGINT AS length FROM nation")
def _(spark, sf):
    """The manifest of a folder with one text file."""
    folder = K.new_folder(spark, "manifest")
    t(spark, sf, "nation").select("n_name").coalesce(1).sortWithinPartitions("n_name").write.text(folder)
    return K.manifest(spark, folder).where("length > 0").select("sha256", "length")


@query("append_ledger", "SELECT s_nationkey AS k, 2 * count(*) AS entries FROM supplier GROUP BY 1")
def _(spark, sf):
    """A ledger that the same entries were added to twice: nothing is replaced."""
    folder, entries = K.new_folder(spark, "ledger"), t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    for _ in range(2):
        K.append_ledger(entries, folder)
    return spark.read.parquet(folder).groupBy("k").agg(F.count(F.lit(1)).alias("entries"))


@query("normal_cdf", f"""WITH {P.POINTS_SQL}, x AS (SELECT indicator_id, month, value AS v, 1 / (1 + 0.3275911::DOUBLE * abs(value / sqrt(2.0::DOUBLE))) AS t FROM points WHERE value IS NOT NULL),
e AS (SELECT *, 1 - t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-v * v / 2) AS a FROM x)
SELECT indicator_id, month, {rd('0.5::DOUBLE * (1 + sign(v) * a)')} AS below FROM e""")
def _(spark, sf):
    return P.indicator_points(spark, sf).where("value is not null").select("indicator_id", "month", S.normal_cdf(F.col("value")).alias("below"))
