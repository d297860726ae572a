"""Queries over base facts, pages, texts and events: sources, joins, documents, retrieval, sinks, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import aggregates as A, quality as Q, retrieval as R, segments as SG, windows as W
from tidemark.plans.series_queries import IDS, rd, rounded
from tidemark.sinks import publication as K
from tidemark.sources import documents as D, grids as G, points as P, text_tables as T
from tidemark.streaming import incremental as I

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return P.table(spark, sf_dir, name)


# Text tables: monthly means are written as lines of each format and parsed again.

_MONTHLY = """m AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, round(avg(o_totalprice) / 100000 - 2.5, 2) AS v FROM orders GROUP BY ALL)"""


def _monthly(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.round(F.avg("o_totalprice") / 100000 - 2.5, 2).alias("v"))


def _year_lines(spark, sf_dir, sep: str, fill: str, form: str = "%.2f"):
    """k and line: a table of years for each priority."""
    wide = _monthly(spark, sf_dir).groupBy("k", "y").pivot("m", list(range(1, 13))).agg(F.first("v"))
    cells = [F.when(F.col(str(i)).isNotNull(), F.format_string(form, F.col(str(i)))).otherwise(fill) for i in range(1, 13)]
    return wide.select("k", F.concat_ws(sep, F.col("y").cast("string"), *cells).alias("line"))


def _noise(spark, *lines: str):
    """Lines that a parser should skip."""
    return spark.createDataFrame([("-", x) for x in lines], "k string, line string")


_YEARS = f"""WITH {_MONTHLY}, g AS (SELECT k, y, mm.mm FROM (SELECT DISTINCT k, y FROM m) CROSS JOIN range(1, 13) mm(mm))
SELECT g.k, printf('%04d-%02d', g.y, g.mm) AS month, {rd('m.v')} AS value FROM g LEFT JOIN m ON m.k = g.k AND m.y = g.y AND m.m = g.mm"""


@query("source_wide_years", _YEARS)
def _(spark, sf):
    return T.wide_years(_year_lines(spark, sf, ",", "-99.00").unionByName(_noise(spark, "# note", "year,1,2", "")), keep=("k",))


@query("source_wide_years_spaces", _YEARS)
def _(spark, sf):
    return T.wide_years(_year_lines(spark, sf, "  ", "-999.0").unionByName(_noise(spark, "<html>")), low=-999.0, high=None, size=1e6, keep=("k",))


@query("source_wide_years_exact", _YEARS)
def _(spark, sf):
    return T.wide_years(_year_lines(spark, sf, " ", "-99.99"), low=None, high=None, exact=(-99.99, -999.0, -9999.0), keep=("k",))


@query("source_monthly_section", _YEARS)
def _(spark, sf):
    """A text for each priority, with a section before the wanted one."""
    body = _year_lines(spark, sf, "", "-999.9", "%+.2f").select("k", F.concat(F.substring("line", 1, 4), F.lit(" "), F.substring("line", 5, 10_000)).alias("line"))
    text = body.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("b")).select("k", F.concat(F.lit("ANOMALY\n1800 1 2 3 4 5 6 7 8 9 10 11 12\nSTANDARDIZED    DATA\nYEAR JAN\n"), "b").alias("text"))
    return T.monthly_sections(text, "Standardized", keep=("k",))


@query("source_seasonal", f"""WITH {_MONTHLY} SELECT k, ['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ'][m] AS season, printf('%04d-%02d', y, m) AS month, {rd('v')} AS value, CASE WHEN y >= 2001 THEN 'preliminary' ELSE 'final' END AS flag FROM m""")
def _(spark, sf):
    lines = _monthly(spark, sf).select("k", F.format_string(" %s  %d %.2f", F.element_at(F.array(*map(F.lit, S.SEASONS)), F.col("m")), "y", "v").alias("line"))
    return T.seasonal(lines.unionByName(_noise(spark, "SEAS YR ANOM", "# x")), 2001, keep=("k",))


@query("source_weekly", f"""WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE AS day, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') / 100000 - 2.5, 1) AS a, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH') / 100000 - 2.5, 1) AS b FROM orders GROUP BY 1),
z AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT day, 'nino12' AS region, {rd('a')} AS value FROM z UNION ALL SELECT day, 'nino34', {rd('b')} FROM z""")
def _(spark, sf):
    o = t(spark, sf, "orders")
    part = lambda k: F.round(F.avg(F.when(F.col("o_orderpriority") == k, F.col("o_totalprice"))) / 100000 - 2.5, 1)
    w = o.groupBy(F.date_trunc("week", "o_orderdate").alias("d")).agg(part("1-URGENT").alias("a"), part("2-HIGH").alias("b")).where("a is not null and b is not null")
    lines = w.select(F.concat(F.lit(" "), F.upper(F.date_format("d", "ddMMMyyyy")), F.format_string("     23.4%+.1f     25.1-0.3     26.6%+.1f     28.6 0.3", "a", "b")).alias("line"))
    return T.weekly(lines.unionByName(spark.createDataFrame([(" Weekly SST data",), (" 03JAN1990     23.4-99.9     25.1-0.3     26.6-99.9     28.6 0.3",)], "line string")))


@query("source_dated_csv", f"WITH {_MONTHLY} SELECT k, printf('%04d-%02d', y, m) AS month, {rd('CASE WHEN m <> 7 THEN v END')} AS value FROM m")
def _(spark, sf):
    lines = _monthly(spark, sf).select("k", F.format_string("%d-%02d-01, %.2f", "y", "m", F.when(F.col("m") == 7, -99.99).otherwise(F.col("v"))).alias("line"))
    return T.dated(lines.unionByName(_noise(spark, "Date,Value")), keep=("k",))


@query("source_multi_column", f"""WITH {_MONTHLY} SELECT CASE k WHEN '1-URGENT' THEN 'nino12' WHEN '2-HIGH' THEN 'nino3' WHEN '3-MEDIUM' THEN 'nino34' ELSE 'nino4' END AS indicator_id, printf('%04d-%02d', y, m) AS month, {rd('v')} AS value
FROM m WHERE k <> '5-LOW' AND (y, m) IN (SELECT (y, m) FROM m WHERE k <> '5-LOW' GROUP BY y, m HAVING count(*) = 4)""")
def _(spark, sf):
    ks = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    wide = _monthly(spark, sf).groupBy("y", "m").pivot("k", ks).agg(F.first("v")).dropna()
    lines = wide.select(F.format_string("%d %d 20.0 %.2f 21.0 %.2f 22.0 %.2f 23.0 %.2f", "y", "m", *(F.col(f"`{k}`") for k in ks)).alias("line"))
    return T.multi_column(lines, {"nino12": 3, "nino3": 5, "nino34": 7, "nino4": 9}).withColumn("value", F.col("value"))


@query("published_round_trip", f"WITH {P.POINTS_SQL} SELECT indicator_id, month, {rd('round(value, 4)')} AS value, flag FROM points")
def _(spark, sf):
    lines = K.series_lines(P.indicator_points(spark, sf), {"source": "orders", "units": "z"})
    return T.published_csv(lines, ["indicator_id"])


# Grids: prices by month and nation as cells.

_GRID = """g AS (SELECT (year(l_shipdate) - 1990) * 12 + month(l_shipdate) - 1 AS month_idx, (l_suppkey % 9 * 2.5 - 10)::DOUBLE AS lat, (190 + l_partkey % 11 * 5)::DOUBLE AS lon, avg(l_discount) AS value FROM lineitem GROUP BY ALL),
gg AS (SELECT month_idx, lat, lon, CASE WHEN (lat + lon + month_idx)::INT % 7 <> 0 THEN value END AS value FROM g)"""


def _grid(spark, sf):
    li = t(spark, sf, "lineitem")
    g = li.groupBy(S.month_idx(F.year("l_shipdate"), F.month("l_shipdate")).alias("month_idx"), (F.col("l_suppkey") % 9 * 2.5 - 10).cast("double").alias("lat"), (190 + F.col("l_partkey") % 11 * 5).cast("double").alias("lon")).agg(F.avg("l_discount").alias("value"))
    return g.withColumn("value", F.when(F.round(F.col("lat") + F.col("lon") + F.col("month_idx")).cast("int") % 7 != 0, F.col("value")))


_GRID = _GRID.replace("(lat + lon + month_idx)::INT", "round(lat + lon + month_idx)::INT")


@query("area_mean_box", f"WITH {_GRID} SELECT month_idx, {rd('avg(value)')} AS mean FROM gg WHERE lat BETWEEN -5 AND 5 AND lon BETWEEN 190 AND 220 GROUP BY 1")
def _(spark, sf):
    return A.area_mean(_grid(spark, sf), ["month_idx"], S.in_box(F.col("lat"), F.col("lon"), -5, 5, -170, -140)).select(F.col("month_idx").cast("long").alias("month_idx"), "mean")


@query("area_mean_cos", f"WITH {_GRID} SELECT month_idx, {rd('sum(value * cos(radians(lat))) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) END)')} AS mean FROM gg GROUP BY 1")
def _(spark, sf):
    return A.area_mean_cos(_grid(spark, sf), ["month_idx"]).select(F.col("month_idx").cast("long").alias("month_idx"), "mean")


@query("area_mean_rows", f"WITH {_GRID}, r AS (SELECT month_idx, lat, avg(value) AS v FROM gg WHERE value IS NOT NULL GROUP BY 1, 2) SELECT month_idx, {rd('sum(v * cos(radians(lat))) / sum(cos(radians(lat)))')} AS mean FROM r GROUP BY 1")
def _(spark, sf):
    return A.area_mean_rows(_grid(spark, sf), ["month_idx"]).select(F.col("month_idx").cast("long").alias("month_idx"), "mean")


@query("opendap_months", f"""WITH {_GRID} SELECT month_idx, lat, {rd('round(value, 3)')} AS value, lon FROM gg WHERE value IS NOT NULL""")
def _(spark, sf):
    """One response for each month, its rows and axis in text, parsed again."""
    g = _grid(spark, sf)
    cell = F.when(F.col("value").isNotNull(), F.format_string("%.3f", "value")).otherwise("NaN")
    line = g.groupBy("month_idx", "lat").agg(F.sort_array(F.collect_list(F.struct("lon", cell.alias("v")))).alias("c")).select("month_idx", F.round((F.col("lat") + 10) / 2.5).cast("int").alias("i"), F.array_join(F.transform("c", lambda x: x["v"]), ", ").alias("l"), F.transform("c", lambda x: x["lon"]).alias("lons"))
    block = line.groupBy("month_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "l"))), lambda x: F.format_string("[0][0][%d], %s", x["i"], x["l"])), "\n").alias("b"))
    texts = block.select("month_idx", F.concat(F.lit("Dataset {}\n---\nuwnd.uwnd[1][1][9][11]\n"), "b", F.lit("\n\nuwnd.time[1]\n1297320.0\n")).alias("text"))
    rows = G.opendap_block(texts, "uwnd", ["month_idx"])
    lons = line.select("month_idx", F.col("i").alias("i_row"), F.posexplode("lons").alias("i_lon", "lon"))
    return rows.join(lons, ["month_idx", "i_row", "i_lon"]).where("value is not null").select(F.col("month_idx").cast("long").alias("month_idx"), (F.col("i_row") * 2.5 - 10).alias("lat"), "value", "lon")


@query("longitudes", "SELECT DISTINCT n_nationkey, (n_nationkey * 30 - 360)::DOUBLE AS lon, (((n_nationkey * 30 - 360) % 360 + 360) % 360)::DOUBLE AS positive, (CASE WHEN ((n_nationkey * 30 - 360) % 360 + 360) % 360 > 180 THEN ((n_nationkey * 30 - 360) % 360 + 360) % 360 - 360 ELSE ((n_nationkey * 30 - 360) % 360 + 360) % 360 END)::DOUBLE AS negative, ((n_nationkey * 30 - 360) % 360 + 360) % 360 BETWEEN 270 AND 300 AS coastal FROM nation")
def _(spark, sf):
    lon = (F.col("n_nationkey") * 30 - 360).cast("double")
    return t(spark, sf, "nation").select("n_nationkey", lon.alias("lon"), S.to_positive(lon).alias("positive"), S.to_negative(lon).alias("negative"), S.in_box(F.lit(0.0), lon, -10, 0, -90, -60).alias("coastal")).distinct()


@query("negative_convention", "SELECT avg((n_nationkey * 30 - 360 BETWEEN -180 AND 180)::INT) > 0.5 AS negative FROM nation")
def _(spark, sf):
    lon = F.col("n_nationkey") * 30 - 360
    return t(spark, sf, "nation").select((F.coalesce(F.avg(lon.between(-180, 180).cast("int")), F.lit(1.0)) > 0.5).alias("negative"))


@query("epoch_months", "SELECT DISTINCT o_orderdate::DATE AS day, strftime(o_orderdate, '%Y-%m') AS by_hours, strftime(o_orderdate, '%Y-%m') AS by_days FROM orders")
def _(spark, sf):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1800-01-01").cast("date"))
    return t(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"), G.hours_month(days * 24).alias("by_hours"), G.days_month(days).alias("by_days")).distinct()


# Pages and texts.

_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("page_plain_text", f"SELECT page_id, {_PLAIN} AS plain FROM pages")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", S.plain_text(F.col("html")).alias("plain"))


@query("page_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a>', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL""")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(D.links(F.col("html"))).alias("l")).groupBy("page_id", "l.href").agg(F.count(F.lit(1)).alias("n"))


@query("page_table_cells", """WITH c AS (SELECT c_custkey // 1000 * 100 + c_nationkey AS page, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_custkey // 1000 * 100 + c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT page::BIGINT AS id, 0::INT AS i_table, r::INT AS i_row, k::INT AS i_cell, [c_custkey::VARCHAR, c_name || ' & co', c_mktsegment][k + 1] AS text FROM c, (VALUES (0), (1), (2)) v(k)
UNION ALL SELECT DISTINCT page, 0, 0, k, ['key', 'name', 'segment'][k + 1] FROM c, (VALUES (0), (1), (2)) v(k)""")
def _(spark, sf):
    """Pages with a table of customers of a nation, at most 1000 a page; the raw pages are for page_table_count."""
    row = F.format_string("<tr><td> %d <td><b>%s</b> &amp;\n co</td><td>%s</tr>", "c_custkey", "c_name", "c_mktsegment")
    page = (F.floor(F.col("c_custkey") / 1000) * 100 + F.col("c_nationkey")).cast("long")
    body = t(spark, sf, "customer").groupBy(page.alias("page_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]), "").alias("b"))
    return D.tables(body.select("page_id", F.concat(F.lit("<html><p>x</p><table><tr><th>key<th>name<th>segment</tr>"), "b", F.lit("</table>")).alias("html")), "page_id", "html")


@query("page_table_count", "SELECT count(*) FILTER (WHERE regexp_matches(html, '(?i)<table[ >]')) = 0 AS none FROM pages")
def _(spark, sf):
    """Whether the raw pages hold a table at all."""
    return D.tables(t(spark, sf, "pages"), "page_id", "html").agg((F.count(F.lit(1)) == 0).alias("none"))


@query("page_digests", "SELECT page_id, sha256(html) AS digest, substr(sha256(html), 1, 16) AS short, octet_length(encode(html)) > 1000 AS large FROM pages")
def _(spark, sf):
    p = t(spark, sf, "pages")
    return p.select("page_id", F.sha2("html", 256).alias("digest"), F.substring(F.sha2("html", 256), 1, 16).alias("short"), (F.octet_length("html") > 1000).alias("large"))


@query("page_hosts", r"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 20")
def _(spark, sf):
    return t(spark, sf, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(20)


# The words are written out here, so that the SQL is no copy of the operator's list.
_KEYS = r"""CASE WHEN regexp_matches(lower(text), 'niño 1\+2|nino 1\+2|1\+2|costero|costa|icen|tsm costa|tsm niño 1\+2') THEN 'nino12' END,
CASE WHEN regexp_matches(lower(text), 'icen|índice costero|indice costero|el niño|la niña|compar|diferencia|versus|vs') THEN 'icen' END,
CASE WHEN regexp_matches(lower(text), 'niño 3\.4|nino 3\.4|3\.4|cuenca|roni|oni|tsm cuenca|tsm niño 3\.4|el niño|la niña|compar|diferencia|versus|vs') THEN 'nino34' END,
CASE WHEN regexp_matches(lower(text), 'roni|índice oceánico relativo|indice oceanico relativo') THEN 'roni' END,
CASE WHEN regexp_matches(lower(text), 'soi|oscilación del sur|oscilacion del sur|tahiti|darwin|presión|presion') THEN 'soi' END,
CASE WHEN regexp_matches(lower(text), 'viento|850|zonal|alisio|alisios|westerly|easterly|del oeste|del este') THEN 'u850' END,
CASE WHEN regexp_matches(lower(text), 'd20|termoclina|isoterma de 20|isoterma 20|subsuperficie|subsuperficial') THEN 'd20' END"""


@query("question_indicators", f"SELECT conv_id, turn, array_to_string(list_sort(list_filter([{_KEYS}], lambda x: x IS NOT NULL)), ',') AS ids FROM conversations WHERE role = 'user'")
def _(spark, sf):
    return t(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(R.detect_indicators(F.col("text")), ",").alias("ids"))


@query("grounding", f"""WITH {P.POINTS_SQL}, a AS (SELECT conv_id * 1000 + turn AS question_id, unnest(list_filter([{_KEYS}], lambda x: x IS NOT NULL)) AS indicator_id FROM conversations WHERE role = 'user'),
s AS (SELECT indicator_id, avg(value) AS mean, min(value) AS least, max(value) AS most FROM points WHERE value IS NOT NULL GROUP BY 1)
SELECT question_id, indicator_id, '1998-01' AS month, {rd('p.value')} AS value, {rd('mean')} AS mean, {rd('least')} AS least, {rd('most')} AS most FROM a JOIN s USING (indicator_id) LEFT JOIN points p ON p.indicator_id = a.indicator_id AND p.month = '1998-01'""")
def _(spark, sf):
    q = t(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat("text", F.lit(" 1998-01")).alias("question"))
    return R.grounding(q, P.indicator_points(spark, sf))


@query("grounded_answers", f"""WITH {P.POINTS_SQL}, a AS (SELECT conv_id * 1000 + turn AS question_id, unnest(list_filter([{_KEYS}], lambda x: x IS NOT NULL)) AS indicator_id FROM conversations WHERE role = 'user'),
s AS (SELECT indicator_id, avg(value) AS mean FROM points WHERE value IS NOT NULL GROUP BY 1), l AS (SELECT question_id, indicator_id, indicator_id || ' ' || coalesce('1998-01:' || printf('%.2f', round(p.value, 2) + 0.0::DOUBLE), '-') || ' ' || printf('%.2f', round(mean, 2) + 0.0::DOUBLE) AS line FROM a JOIN s USING (indicator_id) LEFT JOIN points p ON p.indicator_id = a.indicator_id AND p.month = '1998-01')
SELECT question_id, string_agg(line, '; ' ORDER BY indicator_id) AS answer FROM l GROUP BY 1""")
def _(spark, sf):
    q = t(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat("text", F.lit(" 1998-01")).alias("question"))
    return R.answers(R.grounding(q, P.indicator_points(spark, sf)))


@query("value_at", f"WITH {P.POINTS_SQL} SELECT indicator_id, {rd('value')} AS value FROM points WHERE month = '1997-12'")
def _(spark, sf):
    return R.value_at(P.indicator_points(spark, sf), "1997-12")


@query("months_in_text", r"SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN printf('%d-%02d', 1990 + conv_id % 30, 1 + turn % 12) END AS month FROM conversations")
def _(spark, sf):
    c = t(spark, sf, "conversations")
    asked = F.concat("text", F.when(F.col("conv_id") % 3 == 0, F.format_string(" en %d-%02d.", 1990 + F.col("conv_id") % 30, 1 + F.col("turn") % 12)).otherwise(" 1899-13"))
    return c.select("conv_id", "turn", R.detect_month(asked).alias("month"))


_WANTED = ("the", "der", "entre", "license", "public")


@query("bm25_search", f"""WITH tk AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3) AS t FROM documents),
tot AS (SELECT count(*) AS nd, avg(len(t)) AS ms FROM tk), hit AS (SELECT doc_id, len(t) AS size, unnest(list_filter(t, lambda w: w IN {_WANTED})) AS w FROM tk), tf AS (SELECT doc_id, size, w, count(*) AS tf FROM hit GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, {rd('sum(ln((nd - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / ms)))')} AS score FROM tf JOIN df USING (w) CROSS JOIN tot GROUP BY 1""")
def _(spark, sf):
    return R.bm25(t(spark, sf, "documents"), " ".join(_WANTED))


@query("keyword_overlap", r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM documents) SELECT doc_id, round(len(list_intersect(ws, ['the', 'and', 'of', 'to'])) / 4.0::DOUBLE, 4) AS score FROM w""")
def _(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return t(spark, sf, "documents").select("doc_id", R.overlap_score(words, F.array(*map(F.lit, ("the", "and", "of", "to")))).alias("score"))


@query("upper_case_tokens", r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Z]+')) AS token FROM documents) SELECT token, count(*) AS n FROM w WHERE length(token) BETWEEN 2 AND 5 GROUP BY 1 ORDER BY n DESC, token LIMIT 25""")
def _(spark, sf):
    return t(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z]+"), F.lit(0))).alias("token")).where(F.length("token").between(2, 5)).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(25)


@query("term_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(concat_ws(' ', lang, source, text)), 'license') ORDER BY doc_id")
def _(spark, sf):
    return t(spark, sf, "documents").where(F.contains(F.lower(F.concat_ws(" ", "lang", "source", "text")), F.lit("license"))).select("doc_id", "lang").orderBy("doc_id")


# Joins, sets and tables.


@query("weekly_against_monthly", f"""WITH w AS (SELECT event_type AS region, strftime(ts, '%Y-%m') AS month, date_trunc('week', ts) AS wk, avg(value) AS value FROM events GROUP BY ALL),
a AS (SELECT region, month, avg(value) AS a, count(*) AS weeks FROM w GROUP BY ALL HAVING count(*) >= 3), b AS (SELECT event_type AS region, strftime(ts, '%Y-%m') AS month, avg(value) AS b FROM events GROUP BY ALL)
SELECT region, month, weeks, {rd('a')} AS a, {rd('b')} AS b, {rd('abs(a - b)')} AS difference, abs(a - b) <= 0.5 AS within FROM a JOIN b USING (region, month)""")
def _(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_type").alias("region"), F.date_format("ts", "yyyy-MM").alias("month"), F.date_trunc("week", "ts").alias("wk"), "value")
    return Q.weekly_against_monthly(e.groupBy("region", "month", "wk").agg(F.avg("value").alias("value")), e.groupBy("region", "month").agg(F.avg("value").alias("value")), 0.5)


@query("latest_preferring_final", f"""WITH e AS (SELECT event_type, ts::DATE AS day, CASE WHEN event_id % 2 = 0 THEN 'final' ELSE 'preliminary' END AS flag, sum(value) AS total FROM events GROUP BY ALL)
SELECT event_type, day, flag, {rd('total')} AS total FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC, (flag = 'final') DESC) = 1""")
def _(spark, sf):
    e = t(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("day"), F.when(F.col("event_id") % 2 == 0, "final").otherwise("preliminary").alias("flag")).agg(F.sum("value").alias("total"))
    return W.latest_preferring_final(e, "event_type", "day")


@query("indicator_dimension_join", f"""SELECT r_name, n_name, count(*) AS customers, {rd('sum(o_totalprice) / 1000000')} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def _(spark, sf):
    o, c, n, r = (t(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), (F.sum("o_totalprice") / 1000000).alias("total"))


@query("set_differences", "SELECT c_custkey AS custkey, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def _(spark, sf):
    return Q.set_differences(t(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")), t(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@query("sources_supporting", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    s, li = t(spark, sf, "supplier"), t(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return s.join(li, s["s_suppkey"] == li["l_suppkey"], "left_semi").select("s_suppkey")


@query("distinct_union", "SELECT strftime(o_orderdate, '%Y-%m') AS month FROM orders UNION SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem")
def _(spark, sf):
    return t(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).union(t(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM"))).distinct()


@query("dedup_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("k", F.struct("user_id", "event_type"))
    return Q.first_by(e, "k", F.col("event_id")).select("user_id", "event_type", "event_id")


@query("asof_join", f"""SELECT e.event_id, l.event_id AS last_error FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') l ON e.user_id = l.user_id AND e.ts >= l.ts WHERE e.event_type = 'purchase'""")
def _(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    of = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    return SG.as_of(of("purchase"), of("error"), "user_id", "ts", "event_id", "last_error").select("event_id", "last_error")


@query("pivot_report", "SELECT o_orderstatus, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '{p}'), 0), 2) AS \"{p}\"" for p, *_ in P.INDICATORS) + " FROM orders GROUP BY 1")
def _(spark, sf):
    return A.pivot_report(t(spark, sf, "orders"), ["o_orderstatus"], "o_orderpriority", [p for p, *_ in P.INDICATORS], "o_totalprice")


@query("run_statistics", f"SELECT event_type, {rd('avg(value)')} AS mean, {rd('coalesce(stddev_samp(value), 0)')} AS std, {rd('min(value)')} AS least, {rd('max(value)')} AS most FROM events GROUP BY 1")
def _(spark, sf):
    return A.run_statistics(t(spark, sf, "events"), ["event_type"], "value")


@query("json_scalars", "SELECT event_type, sum((props::JSON->>'$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("total"), F.count(F.lit(1)).alias("n"))


@query("grouped_timeline", "SELECT user_id, event_id, event_type, (row_number() OVER w)::INT AS place, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, sf):
    return SG.timeline(t(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "place", "before")


#: Sources and levels whose outcomes the events stand for, by user.
_RUNGS = [
    ("noaa-cpc-roni", 0), ("noaa-cpc-roni", 3), ("enfen-imarpe-icen", 0), ("enfen-imarpe-icen", 3), ("noaa-psl-nino12", 0), ("noaa-cpc-wksst", 2), ("noaa-psl-nino12", 3),
    ("noaa-psl-nino34", 0), ("noaa-psl-nino34", 3), ("noaa-cpc-soi", 0), ("noaa-cpc-soi", 3), ("noaa-cpc-cpac850", 0), ("noaa-cpc-wpac850", 1), ("noaa-cpc-cpac850", 3),
    ("noaa-cpc-godas-d20", 0), ("noaa-cpc-godas-d20", 3), ("noaa-cpc-enso-advisory", 0), ("noaa-cpc-enso-advisory", 3), ("enfen-imarpe-status", 0), ("enfen-imarpe-status", 3),
]


@query("fallback_resolution", """WITH rung(i, source_id, level) AS (VALUES (0, 'noaa-cpc-roni', 0), (1, 'noaa-cpc-roni', 3), (2, 'enfen-imarpe-icen', 0), (3, 'enfen-imarpe-icen', 3), (4, 'noaa-psl-nino12', 0), (5, 'noaa-cpc-wksst', 2), (6, 'noaa-psl-nino12', 3), (7, 'noaa-psl-nino34', 0), (8, 'noaa-psl-nino34', 3),
(9, 'noaa-cpc-soi', 0), (10, 'noaa-cpc-soi', 3), (11, 'noaa-cpc-cpac850', 0), (12, 'noaa-cpc-wpac850', 1), (13, 'noaa-cpc-cpac850', 3), (14, 'noaa-cpc-godas-d20', 0), (15, 'noaa-cpc-godas-d20', 3), (16, 'noaa-cpc-enso-advisory', 0), (17, 'noaa-cpc-enso-advisory', 3), (18, 'enfen-imarpe-status', 0), (19, 'enfen-imarpe-status', 3)),
last AS (SELECT user_id % 20 AS i, arg_max(event_type IN ('view', 'click', 'purchase'), (ts, event_id)) AS ok FROM events GROUP BY 1), up AS (SELECT source_id, level FROM rung JOIN last USING (i) WHERE ok),
node(metric_id, level, source_id) AS (VALUES ('roni', 0, 'noaa-cpc-roni'), ('roni', 3, 'noaa-cpc-roni'), ('roni', 4, ''), ('icen', 0, 'enfen-imarpe-icen'), ('icen', 1, ''), ('icen', 3, 'enfen-imarpe-icen'), ('icen', 4, ''), ('nino12', 0, 'noaa-psl-nino12'), ('nino12', 2, 'noaa-cpc-wksst'), ('nino12', 3, 'noaa-psl-nino12'), ('nino12', 4, ''),
('nino34', 0, 'noaa-psl-nino34'), ('nino34', 2, 'noaa-cpc-wksst'), ('nino34', 3, 'noaa-psl-nino34'), ('nino34', 4, ''), ('soi', 0, 'noaa-cpc-soi'), ('soi', 3, 'noaa-cpc-soi'), ('soi', 4, ''), ('u850', 0, 'noaa-cpc-cpac850'), ('u850', 1, 'noaa-cpc-wpac850'), ('u850', 3, 'noaa-cpc-cpac850'), ('u850', 4, ''),
('d20', 0, 'noaa-cpc-godas-d20'), ('d20', 3, 'noaa-cpc-godas-d20'), ('d20', 4, ''), ('basin_official_status', 0, 'noaa-cpc-enso-advisory'), ('basin_official_status', 3, 'noaa-cpc-enso-advisory'), ('basin_official_status', 4, ''), ('coastal_official_status', 0, 'enfen-imarpe-status'), ('coastal_official_status', 3, 'enfen-imarpe-status'), ('coastal_official_status', 4, ''))
SELECT metric_id, min(n.level)::INT AS level, arg_min(n.source_id, n.level) AS source_id FROM node n LEFT JOIN up u ON u.source_id = n.source_id AND u.level = n.level WHERE u.level IS NOT NULL OR n.level = 4 GROUP BY metric_id""")
def _(spark, sf):
    """The source in use for each of the nine metrics, by the last outcome of each source."""
    rungs = F.array(*(F.struct(F.lit(s).alias("source_id"), F.lit(n).alias("level")) for s, n in _RUNGS))
    e = t(spark, sf, "events").select(F.element_at(rungs, (F.col("user_id") % len(_RUNGS) + 1).cast("int")).alias("r"), "ts", "event_id", F.col("event_type").isin("view", "click", "purchase").alias("ok"))
    return Q.resolve_fallback(Q.fallback_table(spark), Q.available_sources(e.select("r.*", "ts", "event_id", "ok"), ["ts", "event_id"]))


@query("incoherent_publications", "SELECT 'n' || n_nationkey AS name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'p2' END AS publication_id FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 1")
def _(spark, sf):
    k = F.col("n_nationkey")
    files = t(spark, sf, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("name"), F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 1, "p2").otherwise("p1").alias("publication_id"))
    return Q.incoherent_publications(files)


@query("run_summary", "SELECT count(*) FILTER (WHERE event_type <> 'error') AS passed, count(*) FILTER (WHERE event_type = 'error') AS failed, coalesce(bool_and(event_type <> 'error') FILTER (WHERE user_id = 1), true) AS critical_ok FROM events")
def _(spark, sf):
    ok = F.col("event_type") != "error"
    return t(spark, sf, "events").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.coalesce(F.bool_and(F.when(F.col("user_id") == 1, ok)), F.lit(True)).alias("critical_ok"))


# Sinks.


@query("series_files", f"""WITH {P.POINTS_SQL} SELECT indicator_id, '# source: orders' || chr(10) || 'month,flag' || chr(10) || string_agg(month || ',' || flag, chr(10) ORDER BY month_idx) AS body, true AS digest_fits, count(value) AS known FROM points GROUP BY 1""")
def _(spark, sf):
    """Values are checked by published_round_trip; here all else of the files, and their digests."""
    bodies = K.file_bodies(K.series_lines(P.indicator_points(spark, sf), {"source": "orders"}))
    marker = F.locate("# file_sha256: ", F.col("body"))
    above = F.substring("body", F.lit(1), marker - 1)
    fits = (F.sha2(above, 256) == F.col("file_sha256")) & F.contains("body", F.concat(F.lit("# file_sha256: "), F.col("file_sha256")))
    plain = F.rtrim(F.regexp_replace(above, r"(?m)^(\d{4}-\d{2}|month),[^,]*,", "$1,"), F.lit("\n"))
    return bodies.select("indicator_id", plain.alias("body"), fits.alias("digest_fits"), F.regexp_count("body", F.lit(r"(?m)^\d{4}-\d{2},[-0-9]")).cast("long").alias("known"))


@query("nested_series", f"WITH {P.POINTS_SQL} SELECT indicator_id, scope, month, {rd('value')} AS value, flag FROM points")
def _(spark, sf):
    kind = "indicatorId string, scope string, checksum string, points array<struct<month:string,value:double,flag:string>>"
    back = K.nested_series(P.indicator_points(spark, sf)).select(F.from_json("json", kind).alias("j"))
    return back.select(F.col("j.indicatorId").alias("indicator_id"), F.col("j.scope").alias("scope"), F.explode("j.points").alias("p")).select("indicator_id", "scope", "p.month", "p.value", "p.flag")


@query("series_checksums", f"""WITH {P.POINTS_SQL}, w AS (SELECT indicator_id, list([ascii(month[1]) + length(month), CASE WHEN value IS NULL THEN 9999 ELSE round_even(value * 1000, 0)::BIGINT END + 2654435769] ORDER BY month_idx) AS l FROM points GROUP BY 1)
SELECT indicator_id, upper(lpad(to_hex(list_reduce(list_prepend(xor(2166136261::BIGINT, length(indicator_id)::BIGINT), flatten(l)), lambda h, x: (xor(h & 4294967295, x & 4294967295) * 16777619) & 4294967295)), 8, '0')) AS checksum FROM w""")
def _(spark, sf):
    return K.checksums(P.indicator_points(spark, sf))


@query("export_csv", f"WITH {P.POINTS_SQL} SELECT month, concat_ws(',', month, coalesce(printf('%.3f', value), ''), flag) AS line FROM points WHERE indicator_id = 'soi'")
def _(spark, sf):
    p = P.indicator_points(spark, sf).withColumn("value", F.when(F.col("value").isNotNull(), F.format_string("%.3f", "value")))
    return K.export(p, "soi", "csv", IDS)


@query("snapshot_round_trip", f"WITH {P.POINTS_SQL} SELECT indicator_id, month, {rd('value')} AS value, flag, 'pub-2' AS publication_id FROM points")
def _(spark, sf):
    p = P.indicator_points(spark, sf).select("indicator_id", "month", "value", "flag")
    store = K.Snapshots(spark, K.new_folder(spark, "snapshots"))
    store.publish({"points": K.stamped(p.limit(0), "pub-1")})
    store.publish({"points": K.stamped(p, "pub-2")})
    return store.read("points")


@query("health_upsert", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'current' ELSE 'prior' END AS run FROM nation")
def _(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    return Q.upsert(n.where("id % 3 = 0").withColumn("run", F.lit("current")), n.withColumn("run", F.lit("prior")), "id")


# Streams and event windows.

_TUMBLING = f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, {rd('sum(value)')} AS total FROM events GROUP BY ALL"


@query("stream_tumbling", _TUMBLING)
def _(spark, sf):
    return I.stream_to_table(spark, sf, lambda e: I.tumbling(e, "1 day"))


@query("batch_tumbling", _TUMBLING)
def _(spark, sf):
    return I.tumbling(t(spark, sf, "events"), "1 day")


@query("sliding_windows", f"""WITH s AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start, event_type, value FROM events)
SELECT start, event_type, count(*) AS n, {rd('sum(value)')} AS total FROM s GROUP BY ALL""")
def _(spark, sf):
    return I.sliding(t(spark, sf, "events"), "12 hours", "6 hours").select("start", "event_type", "n", (F.col("mean") * F.col("n")).alias("total"))


@query("session_windows", f"""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, {rd('sum(value)')} AS total FROM s GROUP BY user_id, k""")
def _(spark, sf):
    return I.sessions(t(spark, sf, "events"), "30 minutes")


@query("stream_deduplicated", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    twice = lambda e: I.deduplicated(e.unionByName(e), ["event_id"], "1 day").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return I.stream_to_table(spark, sf, twice)


@query("future_rejected", "SELECT event_type, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-17') AS rejected, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-17') AS kept FROM events GROUP BY 1")
def _(spark, sf):
    late = I.is_future(F.col("ts"), F.lit("2024-01-15").cast("timestamp"))
    return t(spark, sf, "events").withColumn("late", late).groupBy("event_type").agg(F.count_if("late").alias("rejected"), F.count_if(~F.col("late")).alias("kept"))


@query("stream_current_rows", f"SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(spark, sf):
    stream = I.table_stream(spark, sf, "events")
    table = K.Snapshots(spark, K.new_folder(spark, "current-rows"))
    I.keep_current(spark, stream, table, "user_id", [F.col("ts"), F.col("event_id")], K.new_folder(spark, "stream-state"))
    return table.read("rows").select("user_id", "event_id")


@query("repeated_keys", "SELECT user_id, event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return t(spark, sf, "events").groupBy("user_id", "event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("watchdog", "SELECT event_type, max(ts) AS last, date_diff('second', max(ts), TIMESTAMP '2024-02-01') / 3600 > 30 AS alarm FROM events GROUP BY 1")
def _(spark, sf):
    age = (F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp(F.max("ts"))) / 3600
    return t(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("last"), (age > 30).alias("alarm"))
