"""Queries over the canonical points: windows, events, aggregates, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import policies, scalars as S
from tidemark.operators import aggregates as A, events as E, quality as Q, windows as W
from tidemark.sources import points as P

IDS = ["d20", "nino12", "nino34", "soi", "u850"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Phase of a value in SQL.
PHASE = "CASE WHEN {0} >= {1} THEN 'El Niño' WHEN {0} <= -{1} THEN 'La Niña' ELSE 'Neutral' END"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rd(x: str) -> str:
    return f"(round({x}, 4) + 0.0::DOUBLE)"


def month(x: str) -> str:
    return f"printf('%04d-%02d', (1990 + {x} // 12)::INT, ({x} % 12 + 1)::INT)"


def query(name: str, sql: str):
    """Registers a query of the points and its oracle, SQL after the points' common table expressions."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(P.indicator_points(spark, sf_dir)))

        QUERIES[name] = run
        ORACLES[name] = f"WITH {P.POINTS_SQL}, " + sql if sql.lstrip()[:6].upper() != "SELECT" else f"WITH {P.POINTS_SQL} " + sql
        return f

    return add


@query("indicator_points", f"SELECT indicator_id, scope, month_idx, month, {rd('value')} AS value, flag FROM points")
def _(p):
    return p


@query("trailing_mean_3", f"""SELECT indicator_id, month, {rd("CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END")} AS mean, flag
FROM points WINDOW w AS (PARTITION BY indicator_id ORDER BY month_idx ROWS 2 PRECEDING)""")
def _(p):
    return W.trailing_mean(p).select("indicator_id", "month", "mean", "flag")


@query("rolling3_category_counts", """m AS (
SELECT indicator_id, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS v
FROM points WINDOW w AS (PARTITION BY indicator_id ORDER BY month_idx ROWS 2 PRECEDING)
), c AS (
SELECT indicator_id, CASE WHEN v IS NULL THEN 'Sin datos' WHEN abs(v) < 0.4 THEN 'Normal'
 ELSE (CASE WHEN v >= 0 THEN 'El Niño Costero' ELSE 'La Niña Costera' END) || ' ' ||
 (CASE WHEN abs(v) < 1 THEN 'débil' WHEN abs(v) < 1.5 THEN 'moderado' WHEN abs(v) < 2 THEN 'fuerte' ELSE 'muy fuerte' END) END AS category
FROM m)
SELECT indicator_id, category, count(*) AS n FROM c GROUP BY ALL""")
def _(p):
    return W.trailing_mean(p).groupBy("indicator_id", S.icen_category(F.col("mean")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("phase_categories", """SELECT indicator_id, month,
CASE WHEN value IS NULL THEN 'Sin datos' WHEN value >= 0.5 THEN 'El Niño (cuenca)' WHEN value <= -0.5 THEN 'La Niña (cuenca)' ELSE 'ENSO Neutral (cuenca)' END AS roni,
CASE WHEN value IS NULL THEN 'Sin datos' WHEN value >= 0.5 THEN 'Componente atmosférica de La Niña' WHEN value <= -0.5 THEN 'Componente atmosférica de El Niño' ELSE 'Componente atmosférica neutral' END AS soi,
CASE WHEN value IS NULL THEN 'Sin datos' WHEN value > 0.5 THEN 'Anomalía del oeste (flujo hacia el este)' WHEN value < -0.5 THEN 'Anomalía del este (flujo hacia el oeste)' ELSE 'Anomalía zonal débil / neutral' END AS wind,
CASE WHEN value IS NULL THEN 'Sin datos' WHEN value > 0 THEN 'Anomalía del oeste (flujo hacia el este)' WHEN value < 0 THEN 'Anomalía del este (flujo hacia el oeste)' ELSE 'Calmo' END AS wind_sign,
CASE WHEN value IS NULL THEN 'Sin datos' WHEN value * 10 > 5 THEN 'Termoclina más profunda de lo normal (señal de El Niño de cuenca)' WHEN value * 10 < -5 THEN 'Termoclina más somera de lo normal (señal de La Niña de cuenca)' ELSE 'Profundidad de la termoclina cerca de lo normal' END AS thermocline,
CASE WHEN value IS NULL THEN 'Sin datos' WHEN value * 10 > 10 THEN 'Termoclina más profunda de lo normal (señal de El Niño de cuenca)' WHEN value * 10 < -10 THEN 'Termoclina más somera de lo normal (señal de La Niña de cuenca)' ELSE 'Profundidad de la termoclina cerca de lo normal' END AS thermocline_wide
FROM points""")
def _(p):
    v = F.col("value")
    return p.select(
        "indicator_id", "month", S.roni_category(v).alias("roni"), S.soi_category(v).alias("soi"), S.wind_direction(v)["label"].alias("wind"),
        S.wind_direction(v, 0.0)["label"].alias("wind_sign"), S.thermocline(v * 10).alias("thermocline"), S.thermocline(v * 10, 10.0).alias("thermocline_wide"),
    )


def _rule_sql(policy: str, what: int) -> str:
    parts = ["WHEN value IS NULL THEN '" + (policies.NO_DATA if what == 0 else policies.NO_COLOUR) + "'"]
    for rule in policies.POLICIES[policy]:
        low = "true" if rule[2] is None else f"value {'>=' if rule[4] else '>'} {rule[2]}"
        high = "true" if rule[3] is None else f"value {'<=' if rule[5] else '<'} {rule[3]}"
        parts.append(f"WHEN {low} AND {high} THEN '{rule[what]}'")
    return "CASE " + " ".join(parts) + f" ELSE '{policies.UNCLASSIFIED if what == 0 else policies.NO_COLOUR}' END"


@query("threshold_policies", "SELECT indicator_id, month, " + ", ".join(f"{_rule_sql(p, 0)} AS {p}_label, {_rule_sql(p, 1)} AS {p}_color" for p in policies.POLICIES) + " FROM points")
def _(p):
    return p.select("indicator_id", "month", *(policies.evaluate(F.col("value"), k)[c].alias(f"{k}_{c}") for k in policies.POLICIES for c in ("label", "color")))


@query("threshold_rule_join", """b(indicator_id, policy) AS (VALUES ('nino12', 'coastal'), ('nino12', 'icen_official'), ('nino34', 'basin'), ('d20', 'thermocline'), ('soi', 'soi'))
SELECT indicator_id, policy, month, CASE policy """ + " ".join(f"WHEN '{p}' THEN {_rule_sql(p, 0)}" for p in policies.POLICIES) + """ END AS label,
CASE policy """ + " ".join(f"WHEN '{p}' THEN {_rule_sql(p, 1)}" for p in policies.POLICIES) + " END AS color FROM points JOIN b USING (indicator_id)")
def _(p):
    spark = p.sparkSession
    bridge = spark.createDataFrame(policies.BRIDGE, "indicator_id string, policy string")
    rows = p.join(F.broadcast(bridge), "indicator_id").select("indicator_id", "policy", "month", "value")
    return policies.classify_by_rules(rows, policies.rule_table(spark)).select("indicator_id", "policy", "month", "label", "color")


@query("probability_bands", f"""w AS (
SELECT indicator_id, month, count(value) OVER f AS n, count(*) FILTER (WHERE value >= 0.5) OVER f AS a, count(*) FILTER (WHERE value <= -0.5) OVER f AS b, avg(value) OVER f AS m
FROM points WINDOW f AS (PARTITION BY indicator_id ORDER BY month_idx ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING))
SELECT indicator_id, month, CASE WHEN n > 0 THEN round(100.0::DOUBLE * a / n) ELSE 0 END::INT AS prob_nino,
CASE WHEN n > 0 THEN round(100.0::DOUBLE * (n - a - b) / n) ELSE 0 END::INT AS prob_neutral, CASE WHEN n > 0 THEN round(100.0::DOUBLE * b / n) ELSE 0 END::INT AS prob_nina, {rd('m')} AS mean FROM w""")
def _(p):
    return W.probability_bands(p).drop("month_idx")


def _trend_sql(width: int) -> str:
    return f"""k AS (
SELECT *, CASE WHEN value IS NOT NULL THEN count(value) OVER (PARTITION BY indicator_id ORDER BY month_idx)::DOUBLE END AS k,
row_number() OVER (PARTITION BY indicator_id ORDER BY month_idx) AS i FROM points
), t AS (
SELECT indicator_id, month_idx, month, i, count(value) OVER f AS n, coalesce(regr_slope(value, k) OVER f, 0) AS slope,
CASE WHEN coalesce(var_pop(value) OVER f, 0) < 1e-20 OR coalesce(var_pop(k) OVER f, 0) = 0 THEN 0 ELSE regr_r2(value, k) OVER f END AS r2, avg(value) OVER f AS mean
FROM k WINDOW f AS (PARTITION BY indicator_id ORDER BY month_idx ROWS {width - 1} PRECEDING)
), trend AS (SELECT * FROM t WHERE i >= {width} AND n >= {width} / 2)"""


@query("rolling_trend_24", f"{_trend_sql(24)} SELECT indicator_id, month, {rd('slope')} AS slope, {rd('r2')} AS r2, {rd('mean')} AS mean FROM trend")
def _(p):
    return W.rolling_trend(p, 24).drop("month_idx")


@query("latest_trend_12", f"""{_trend_sql(12)} SELECT indicator_id, {rd('arg_max(slope, month_idx)')} AS slope, max(month_idx) AS month_idx,
CASE WHEN arg_max(slope, month_idx) > 0.01 THEN 'creciente' WHEN arg_max(slope, month_idx) < -0.01 THEN 'decreciente' ELSE 'estable' END AS direction FROM trend GROUP BY 1""")
def _(p):
    return W.latest_trend(p, 12)


PAIRS_SQL = """pr AS (
SELECT a.indicator_id AS id_a, b.indicator_id AS id_b, a.month_idx, a.month, a.value AS a, b.value AS b
FROM points a JOIN points b ON a.month_idx = b.month_idx AND a.indicator_id < b.indicator_id)"""


@query("correlations", f"""{PAIRS_SQL}, c AS (SELECT id_a, id_b, count(*) AS n, corr(a, b) AS r FROM pr WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)
SELECT id_a, id_b, n, {rd('r')} AS r, CASE WHEN abs(r) >= 0.7 THEN 'Fuerte' WHEN abs(r) >= 0.4 THEN 'Moderada' WHEN abs(r) >= 0.2 THEN 'Débil' ELSE 'Nula' END AS strength FROM c WHERE n >= 10""")
def _(p):
    return A.correlations(p)


@query("top_correlations", f"""{PAIRS_SQL}, c AS (SELECT id_a, id_b, count(*) AS n, corr(a, b) AS r FROM pr WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)
SELECT id_a, id_b, {rd('r')} AS r FROM c WHERE n >= 10 ORDER BY abs(c.r) DESC, id_a, id_b LIMIT 4""")
def _(p):
    return A.correlations(p).select("id_a", "id_b", "r").limit(4)


@query("correlation_matrix", f"""{PAIRS_SQL}, c AS (SELECT id_a, id_b, count(*) AS n, corr(a, b) AS r FROM pr WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
m AS (SELECT id_a, id_b, r FROM c UNION ALL SELECT id_b, id_a, r FROM c)
SELECT i.indicator_id AS id_a, """ + ", ".join(f"CASE WHEN i.indicator_id = '{c}' THEN 1.0::DOUBLE ELSE {rd(f'''coalesce(max(m.r) FILTER (WHERE m.id_b = '{c}'), 0)''')} END AS {c}" for c in IDS) + """
FROM (SELECT DISTINCT indicator_id FROM points) i LEFT JOIN m ON m.id_a = i.indicator_id GROUP BY i.indicator_id""")
def _(p):
    return A.correlation_matrix(p, IDS)


_ROLLING = f"""{PAIRS_SQL}, rc AS (
SELECT id_a, id_b, month_idx, month, row_number() OVER w AS i, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) OVER f AS n, corr(a, b) OVER f AS r
FROM pr WINDOW w AS (PARTITION BY id_a, id_b ORDER BY month_idx), f AS (PARTITION BY id_a, id_b ORDER BY month_idx ROWS 35 PRECEDING)),
rolled AS (SELECT id_a, id_b, month_idx, month, CASE WHEN n < 18 THEN 0 ELSE r END AS r FROM rc WHERE i >= 36)"""


@query("rolling_correlation_36", f"{_ROLLING} SELECT id_a, id_b, month, {rd('r')} AS r FROM rolled")
def _(p):
    return W.rolling_correlation(p, 36).drop("month_idx")


@query("current_rolling_correlation", f"{_ROLLING} SELECT id_a, id_b, max(month) AS month, {rd('arg_max(r, month_idx)')} AS r FROM rolled GROUP BY 1, 2")
def _(p):
    return W.rolling_correlation(p, 36).groupBy("id_a", "id_b").agg(F.max("month").alias("month"), F.max_by("r", "month_idx").alias("r"))


@query("phase_changes", f"""k AS (SELECT *, {PHASE.format('value', 0.5)} AS to_phase FROM points WHERE value IS NOT NULL),
l AS (SELECT *, lag(to_phase) OVER (PARTITION BY indicator_id ORDER BY month_idx) AS from_phase FROM k)
SELECT indicator_id, month, from_phase, to_phase, {rd('value')} AS value FROM l WHERE from_phase <> to_phase""")
def _(p):
    return W.phase_changes(p).drop("month_idx")


@query("alert_states", f"""k AS (SELECT *, CASE WHEN value >= 0.4 THEN 'warm' WHEN value <= -0.4 THEN 'cool' ELSE 'neutral' END AS side FROM points WHERE value IS NOT NULL),
d AS (SELECT *, first_value(side) OVER (PARTITION BY indicator_id ORDER BY month_idx DESC) AS direction FROM k),
s AS (SELECT *, min((side = direction)::INT) OVER (PARTITION BY indicator_id ORDER BY month_idx DESC) AS same FROM d),
c AS (SELECT indicator_id, direction, arg_max(value, month_idx) AS current, max(month) AS month, CASE WHEN direction = 'neutral' THEN 0 ELSE sum(same) END::INT AS run FROM s GROUP BY 1, 2)
SELECT indicator_id, direction, {rd('current')} AS current, month, run AS consecutive, CASE WHEN direction = 'neutral' THEN 0 ELSE least(100, round(100.0::DOUBLE * run / 3)) END::INT AS progress,
CASE WHEN direction = 'neutral' THEN 'Neutral' WHEN run >= 3 THEN 'Cumplido' ELSE 'En vigilancia' END AS status FROM c""")
def _(p):
    return W.alert_states(p, 0.4, 3)


@query("latest_known", f"SELECT indicator_id, max(month_idx) AS month_idx, max(month) AS month, {rd('arg_max(value, month_idx)')} AS value, arg_max(flag, month_idx) AS flag FROM points WHERE value IS NOT NULL GROUP BY 1")
def _(p):
    return W.latest_known(p)


@query("last_24_months", f"SELECT indicator_id, month, {rd('value')} AS value, flag FROM points QUALIFY row_number() OVER (PARTITION BY indicator_id ORDER BY month_idx DESC) <= 24")
def _(p):
    return W.last_rows(p, 24).select("indicator_id", "month", "value", "flag")


@query("phase_space_60", f"""a AS (SELECT month_idx, month, value FROM points WHERE indicator_id = 'nino34' AND value IS NOT NULL QUALIFY row_number() OVER (ORDER BY month_idx DESC) <= 60)
SELECT a.month, {rd('a.value')} AS nino34, {rd('b.value')} AS soi, {PHASE.format('a.value', 0.5)} AS phase FROM a LEFT JOIN points b ON b.indicator_id = 'soi' AND b.month_idx = a.month_idx""")
def _(p):
    a = W.last_rows(p.where("indicator_id = 'nino34' and value is not null"), 60).select("month_idx", "month", F.col("value").alias("nino34"))
    b = p.where("indicator_id = 'soi'").select("month_idx", F.col("value").alias("soi"))
    return a.join(b, "month_idx", "left").select("month", "nino34", "soi", S.phase(F.col("nino34")).alias("phase"))


def _periods_sql(threshold: float, where: str, name: str) -> str:
    return f"""{name}k AS (SELECT indicator_id, month_idx, value, {PHASE.format('value', threshold)} AS phase FROM points WHERE value IS NOT NULL AND {where}),
{name}t AS (SELECT *, CASE WHEN phase IS DISTINCT FROM lag(phase) OVER w THEN 1 ELSE 0 END AS turn, lead(month_idx) OVER w AS nxt FROM {name}k WINDOW w AS (PARTITION BY indicator_id ORDER BY month_idx)),
{name}i AS (SELECT *, sum(turn) OVER (PARTITION BY indicator_id ORDER BY month_idx) AS island FROM {name}t),
{name} AS (SELECT indicator_id, phase, min(month_idx) AS start_idx, coalesce(arg_max_null(nxt, month_idx), (SELECT max(month_idx) FROM points))::INT AS end_idx,
 arg_min(month_idx, (-abs(value), month_idx)) AS peak_idx, arg_min(value, (-abs(value), month_idx)) AS peak
 FROM {name}i WHERE phase <> 'Neutral' GROUP BY indicator_id, island, phase)"""


@query("periods", f"""{_periods_sql(0.5, 'true', 'pd')} SELECT indicator_id, phase, start_idx, end_idx, peak_idx, {rd('peak')} AS peak, end_idx - start_idx + 1 AS duration FROM pd""")
def _(p):
    return E.extract_periods(p)


_HISTORY = f"""{_periods_sql(0.5, "indicator_id = 'nino34'", 'ba')}, {_periods_sql(0.4, "indicator_id = 'nino12'", 'co')},
h AS (SELECT *, 'cuenca' AS scope, 0 AS scope_ord, 0.5 AS thr FROM ba UNION ALL SELECT *, 'costero', 1, 0.4 FROM co),
cat AS (SELECT scope || '-' || (row_number() OVER (ORDER BY start_idx, scope_ord) - 1) || '-' || {month('start_idx')} AS id, scope, phase, {month('start_idx')} AS start_month, {month('end_idx')} AS end_month,
 {month('peak_idx')} AS peak_month, round(peak, 2) AS peak_value, (end_idx - start_idx + 1)::INT AS duration,
 (CASE WHEN peak >= 0 THEN 'El Niño' ELSE 'La Niña' END) || (CASE WHEN scope = 'costero' THEN (CASE WHEN peak >= 0 THEN ' Costero' ELSE ' Costera' END) ELSE '' END) || ' ' ||
 (CASE WHEN abs(peak) < 1 THEN 'débil' WHEN abs(peak) < 1.5 THEN 'moderado' WHEN abs(peak) < 2 THEN 'fuerte' ELSE 'muy fuerte' END) AS intensity,
 (1990 + start_idx // 12)::INT AS year, ((1990 + start_idx // 12) // 10 * 10)::INT AS decade,
 CASE WHEN abs(round(peak, 2)) < 1 THEN 1 WHEN abs(round(peak, 2)) < 1.5 THEN 2 WHEN abs(round(peak, 2)) < 2 THEN 3 ELSE 4 END AS intensity_rank, start_idx, peak_idx FROM h)"""
CATALOG_COLUMNS = "id, scope, phase, start_month, end_month, peak_month, peak_value, duration, intensity, year, decade, intensity_rank"


@query("event_catalog", f"{_HISTORY} SELECT {CATALOG_COLUMNS} FROM cat")
def _(p):
    return E.event_catalog(p)


@query("event_catalog_filtered", f"{_HISTORY} SELECT {CATALOG_COLUMNS} FROM cat WHERE scope = 'cuenca' AND intensity_rank >= 2 ORDER BY abs(peak_value) DESC, id")
def _(p):
    return E.event_catalog(p).where("scope = 'cuenca' and intensity_rank >= 2").orderBy(F.abs("peak_value").desc(), "id")


@query("decade_summary", f"{_HISTORY} SELECT decade, count(*) AS events, count(*) FILTER (WHERE phase = 'El Niño') AS warm, count(*) FILTER (WHERE phase = 'La Niña') AS cold FROM cat GROUP BY 1")
def _(p):
    return A.decade_summary(E.event_catalog(p))


@query("scope_comparison", f"""{_HISTORY} SELECT scope, count(*) AS events, count(*) FILTER (WHERE phase = 'El Niño') AS warm, count(*) FILTER (WHERE phase = 'La Niña') AS cold,
{rd('avg(duration)')} AS mean_duration, {rd('avg(abs(peak_value))')} AS mean_peak, {rd('max(abs(peak_value))')} AS max_peak FROM cat GROUP BY 1""")
def _(p):
    return E.scope_comparison(E.event_catalog(p))


@query("event_series", f"""pk AS (SELECT indicator_id AS event_id, arg_max(month_idx, (abs(value), -month_idx)) AS peak_idx FROM points WHERE value IS NOT NULL GROUP BY 1),
g AS (SELECT event_id, peak_idx, unnest(range(-24, 25)) AS off FROM pk)
SELECT g.event_id, i.indicator_id, g.off::INT AS "offset", CASE WHEN g.off = 0 THEN 'Pico' WHEN g.off > 0 THEN '+' || g.off ELSE g.off::VARCHAR END AS label, {rd('p.value')} AS value
FROM g CROSS JOIN (SELECT DISTINCT indicator_id FROM points) i LEFT JOIN points p ON p.indicator_id = i.indicator_id AND p.month_idx = g.peak_idx + g.off""")
def _(p):
    peaks = p.where("value is not null").groupBy(F.col("indicator_id").alias("event_id")).agg(F.max_by("month_idx", F.struct(F.abs("value"), -F.col("month_idx"))).alias("peak_idx"))
    return E.event_series(p, peaks)


@query("event_window_slice", f"SELECT indicator_id, month, {rd('value')} AS value FROM points WHERE month BETWEEN '1997-04' AND '1998-06'")
def _(p):
    return p.where(F.col("month").between("1997-04", "1998-06")).select("indicator_id", "month", "value")


_CLIM = """clim AS (SELECT i.indicator_id, m.m::INT AS cal_month, coalesce(avg(value), 0) AS mean, coalesce(stddev_pop(value), 0) AS std, coalesce(min(value), 0) AS least, coalesce(max(value), 0) AS most, count(value) AS n
FROM (SELECT DISTINCT indicator_id FROM points) i CROSS JOIN range(1, 13) m(m) LEFT JOIN points p ON p.indicator_id = i.indicator_id AND p.month_idx % 12 + 1 = m.m GROUP BY 1, 2)"""


@query("climatology", f"{_CLIM} SELECT indicator_id, cal_month, {rd('mean')} AS mean, {rd('std')} AS std, {rd('least')} AS least, {rd('most')} AS most, n FROM clim")
def _(p):
    return A.climatology(p)


@query("latest_vs_climatology", f"""{_CLIM}, l AS (SELECT indicator_id, arg_max(value, month_idx) AS value, max(month_idx) AS mi, max(month) AS month FROM points WHERE value IS NOT NULL GROUP BY 1)
SELECT l.indicator_id, l.month, {rd('l.value')} AS value, {rd('mean')} AS mean, {rd('l.value - mean')} AS difference, abs(l.value - mean) > 1.5 * std AS outside FROM l JOIN clim c ON c.indicator_id = l.indicator_id AND c.cal_month = l.mi % 12 + 1""")
def _(p):
    return A.latest_vs_climatology(p)


@query("base_period_anomaly", f"SELECT indicator_id, month, {rd('value - avg(CASE WHEN 1990 + month_idx // 12 BETWEEN 1995 AND 1998 THEN value END) OVER (PARTITION BY indicator_id, month_idx % 12)')} AS anomaly FROM points")
def _(p):
    return A.base_anomaly(p, 1995, 1998).select("indicator_id", "month", "anomaly")


@query("percentile_ranks", f"""SELECT indicator_id, month, {rd('value')} AS value, round(100.0::DOUBLE * (rank() OVER (PARTITION BY indicator_id ORDER BY value) - 1) / count(*) OVER (PARTITION BY indicator_id))::INT AS percentile FROM points WHERE value IS NOT NULL""")
def _(p):
    return A.percentile_ranks(p).select("indicator_id", "month", "value", "percentile")


@query("fact_sheets", f"""{_trend_sql(12).replace('trend AS', 'trend12 AS').replace('k AS (', 'k12 AS (').replace('FROM k WINDOW', 'FROM k12 WINDOW').replace('), t AS (', '), t12 AS (').replace('FROM t WHERE', 'FROM t12 WHERE')},
{_trend_sql(24).replace('trend AS', 'trend24 AS').replace('k AS (', 'k24 AS (').replace('FROM k WINDOW', 'FROM k24 WINDOW').replace('), t AS (', '), t24 AS (').replace('FROM t WHERE', 'FROM t24 WHERE')},
lp AS (SELECT indicator_id, max(month) AS month, arg_max_null(value, month_idx) AS value FROM points GROUP BY 1)
SELECT p.indicator_id, lp.month AS latest_month, {rd('lp.value')} AS latest_value, {rd('avg(p.value)')} AS mean, {rd('stddev_pop(p.value)')} AS std, {rd('min(p.value)')} AS least, {rd('max(p.value)')} AS most,
CASE WHEN lp.value IS NOT NULL THEN round(100.0::DOUBLE * count(*) FILTER (WHERE p.value < coalesce(lp.value, 0)) / count(*)) END::INT AS percentile,
{rd('coalesce((SELECT arg_max(slope, month_idx) FROM trend12 t WHERE t.indicator_id = p.indicator_id), 0)')} AS slope_12, {rd('coalesce((SELECT arg_max(slope, month_idx) FROM trend24 t WHERE t.indicator_id = p.indicator_id), 0)')} AS slope_24,
count(*) FILTER (WHERE p.value > 0) AS positive, count(*) FILTER (WHERE p.value < 0) AS negative, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE p.value > 0) / count(*))::INT AS positive_share
FROM points p JOIN lp USING (indicator_id) WHERE p.value IS NOT NULL GROUP BY p.indicator_id, lp.month, lp.value""")
def _(p):
    return A.fact_sheets(p)


_PHASED = f"ph AS (SELECT p.*, {PHASE.format('r.value', 0.5)} AS phase FROM points p JOIN points r ON r.indicator_id = 'nino34' AND r.month_idx = p.month_idx WHERE p.value IS NOT NULL AND r.value IS NOT NULL)"


@query("box_stats", f"""{_PHASED}, b AS (SELECT indicator_id, phase, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, min(value) AS mn, max(value) AS mx, count(*) AS n, list(value ORDER BY value) AS vs FROM ph GROUP BY 1, 2),
w AS (SELECT *, greatest(mn, q1 - 1.5 * (q3 - q1)) AS lo, least(mx, q3 + 1.5 * (q3 - q1)) AS hi FROM b)
SELECT i.indicator_id, c.phase, {', '.join(f"{rd(f'coalesce({x}, 0)')} AS {y}" for x, y in (('q1', 'q1'), ('q2', 'median'), ('q3', 'q3'), ('lo', 'whisker_low'), ('hi', 'whisker_high'), ('mn', 'least'), ('mx', 'most')))}, coalesce(n, 0) AS n,
coalesce(len(list_filter(vs, lambda v: v < lo OR v > hi)), 0)::INT AS n_outliers
FROM (SELECT DISTINCT indicator_id FROM points) i CROSS JOIN (VALUES ('El Niño'), ('Neutral'), ('La Niña')) c(phase) LEFT JOIN w USING (indicator_id, phase)""")
def _(p):
    return A.box_stats(p, most_outliers=1000).withColumn("outliers", F.size("outliers")).withColumnRenamed("outliers", "n_outliers")


@query("months_by_phase", f"{_PHASED} SELECT indicator_id, phase, count(*) AS n FROM ph GROUP BY 1, 2")
def _(p):
    return A.with_phase(p).groupBy("indicator_id", "phase").agg(F.count(F.lit(1)).alias("n"))


@query("quadrants", """q AS (SELECT a.value AS x, b.value AS y FROM points a JOIN points b ON a.indicator_id = 'nino34' AND b.indicator_id = 'soi' AND a.month_idx = b.month_idx WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE x > 0 AND y > 0) AS pp, count(*) FILTER (WHERE x > 0 AND y < 0) AS pn, count(*) FILTER (WHERE x < 0 AND y > 0) AS np, count(*) FILTER (WHERE x < 0 AND y < 0) AS nn FROM q)
SELECT *, """ + ", ".join(f"round(100.0::DOUBLE * {k} / total)::INT AS {k}_share" for k in ("pp", "pn", "np", "nn")) + " FROM c")
def _(p):
    return A.quadrants(p)


@query("year_matrix", "y AS (SELECT *, 1990 + month_idx // 12 AS year, dense_rank() OVER (PARTITION BY indicator_id ORDER BY month_idx // 12 DESC) AS r FROM points) SELECT indicator_id, year::INT AS year, "
       + ", ".join(f"{rd(f'max(value) FILTER (WHERE month_idx % 12 = {m - 1})')} AS \"{m}\"" for m in range(1, 13)) + " FROM y WHERE r <= 15 GROUP BY 1, 2")
def _(p):
    return A.year_matrix(p)


@query("wide_table", "SELECT month, " + ", ".join(f"{rd(f'''max(value) FILTER (WHERE indicator_id = '{c}')''')} AS {c}" for c in IDS) + " FROM points GROUP BY month")
def _(p):
    return A.wide_table(p, IDS)


@query("composite_index", f"""cw AS (SELECT month, {', '.join(f"max(value) FILTER (WHERE indicator_id = '{c}') AS {c}" for c in IDS)} FROM points GROUP BY month),
cv AS (SELECT *, nino34 / 1.0 * 0.3 + nino12 / 1.2 * 0.25 - soi / 1.5 * 0.2 + d20 / 8.0 * 0.15 + u850 / 2.0 * 0.1 AS v FROM cw WHERE {' AND '.join(f'{c} IS NOT NULL' for c in IDS)})
SELECT month, {rd('v')} AS value, {rd('nino34')} AS c_nino34, {rd('nino12 / 1.2')} AS c_nino12, {rd('-soi / 1.5')} AS c_soi, {rd('d20 / 8.0')} AS c_d20, {rd('u850 / 2.0')} AS c_u850,
CASE WHEN v >= 1.5 THEN 'El Niño fuerte (cuenca)' WHEN v >= 0.8 THEN 'El Niño (cuenca)' WHEN v >= 0.3 THEN 'Tendencia cálida' WHEN v <= -1.5 THEN 'La Niña fuerte (cuenca)' WHEN v <= -0.8 THEN 'La Niña (cuenca)' WHEN v <= -0.3 THEN 'Tendencia fría' ELSE 'Neutral' END AS category FROM cv""")
def _(p):
    return A.composite_index(p)


@query("series_summary", f"SELECT indicator_id, {rd('avg(value)')} AS mean, {rd('min(value)')} AS least, {rd('max(value)')} AS most, count(value) AS n FROM points GROUP BY 1")
def _(p):
    return p.groupBy("indicator_id").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))


@query("quality_summary", f"""SELECT indicator_id, max(month) AS last_month, {rd('arg_max_null(value, month_idx)')} AS last_value, count(*) FILTER (WHERE flag = 'preliminary') AS preliminary, count(*) FILTER (WHERE value IS NULL) AS missing,
(date_diff('hour', (max(month) || '-01')::TIMESTAMP + INTERVAL 1 MONTH, TIMESTAMP '2002-01-01'))::DOUBLE AS age_hours FROM points GROUP BY 1""")
def _(p):
    start = F.to_date(F.concat(F.max("month"), F.lit("-01")))
    return p.groupBy("indicator_id").agg(
        F.max("month").alias("last_month"), F.max_by("value", "month_idx").alias("last_value"), F.count_if(F.col("flag") == "preliminary").alias("preliminary"),
        F.count_if(F.col("value").isNull()).alias("missing"), Q.freshness_hours(start, F.lit("2002-01-01").cast("timestamp")).alias("age_hours"),
    )


@query("freshness_states", """l AS (SELECT indicator_id, last_day((max(month) || '-01')::DATE) AS d FROM points WHERE value IS NOT NULL GROUP BY 1)
SELECT indicator_id, d AS observed, CASE WHEN indicator_id = 'soi' THEN 'FAILED' WHEN date_diff('day', d, DATE '2001-11-15') > 90 THEN 'STALE' WHEN date_diff('day', d, DATE '2001-11-15') > 45 THEN 'DELAYED' ELSE 'PRELIMINARY' END AS state FROM l""")
def _(p):
    last = W.latest_known(p).select("indicator_id", S.month_end(F.col("month_idx")).alias("observed"))
    state = Q.freshness_state(F.col("observed"), F.lit("2001-11-15").cast("date"), F.lit("45 days"), F.lit("90 days"), F.lit("Last two are preliminary"), F.col("indicator_id") == "soi")
    return last.withColumn("state", state)


@query("within_cadence", "SELECT indicator_id, date_diff('day', last_day((max(month) || '-01')::DATE), DATE '2001-10-01') <= 60 AS fresh FROM points WHERE value IS NOT NULL GROUP BY 1")
def _(p):
    return W.latest_known(p).select("indicator_id", Q.within_cadence(S.month_end(F.col("month_idx")), F.lit("2001-10-01").cast("date"), 60).alias("fresh"))


@query("out_of_bounds", f"SELECT indicator_id, month, {rd('value')} AS value FROM points WHERE value NOT BETWEEN -2 AND 2")
def _(p):
    return Q.out_of_bounds(p, "value", -2.0, 2.0).select("indicator_id", "month", "value")


@query("not_monotonic", f"b AS (SELECT *, lag(value IGNORE NULLS) OVER (PARTITION BY indicator_id ORDER BY month_idx) AS bf FROM points) SELECT indicator_id, month, {rd('value')} AS value, {rd('bf')} AS before FROM b WHERE value < bf")
def _(p):
    return W.not_monotonic(p, "indicator_id", "month_idx", "value").select("indicator_id", "month", "value", "before")


@query("index_against_source", f"""a AS (SELECT month_idx, month, value FROM points WHERE indicator_id = 'nino34'), b AS (SELECT month_idx, value FROM points WHERE indicator_id = 'nino12')
SELECT month, {rd('abs(a.value - b.value)')} AS difference, 0.3::DOUBLE AS tolerance, coalesce(abs(a.value - b.value) >= 0.05, true) AS within FROM a JOIN b USING (month_idx)""")
def _(p):
    a = p.where("indicator_id = 'nino34'").select("month_idx", "month", F.col("value").alias("a"))
    b = p.where("indicator_id = 'nino12'").select("month_idx", F.col("value").alias("b"))
    return a.join(b, "month_idx").select("month", *Q.discrepancy("index", F.col("a"), F.col("b"), 0.3, F.abs(F.col("a") - F.col("b")) >= 0.05)).drop("metric_id")


@query("discrepancy_roll_up", """m AS (SELECT month_idx, value AS b, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS a FROM points WHERE indicator_id = 'nino12' WINDOW w AS (ORDER BY month_idx ROWS 2 PRECEDING)),
d AS (SELECT coalesce(abs(a - b) <= 1.0, true) AS ok FROM m) SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS within, count(*) FILTER (WHERE NOT ok) AS outside, bool_and(ok) AS coherent FROM d""")
def _(p):
    both = W.trailing_mean(p.where("indicator_id = 'nino12'"))
    return Q.roll_up(both.select(*Q.discrepancy("mean", F.col("mean"), F.col("value"), 1.0, F.abs(F.col("mean") - F.col("value")) <= 1.0)))


@query("official_against_index", f"""SELECT month, {rd('value')} AS value, CASE month_idx % 3 WHEN 0 THEN 'El Niño Advisory' WHEN 1 THEN 'La Niña Advisory' ELSE 'ENSO-Neutral' END AS alert,
CASE WHEN value IS NULL THEN true WHEN month_idx % 3 = 0 THEN value >= 0.4 WHEN month_idx % 3 = 1 THEN value <= -0.4 ELSE abs(value) <= 0.7 END AS fits FROM points WHERE indicator_id = 'nino34'""")
def _(p):
    alert = F.when(F.col("month_idx") % 3 == 0, "El Niño Advisory").when(F.col("month_idx") % 3 == 1, "La Niña Advisory").otherwise("ENSO-Neutral")
    return p.where("indicator_id = 'nino34'").select("month", "value", alert.alias("alert"), Q.official_against_index(alert, F.col("value")).alias("fits"))


@query("sorted_page", f"SELECT indicator_id, month, {rd('value')} AS value FROM points ORDER BY points.value DESC NULLS LAST, indicator_id, month LIMIT 24 OFFSET 24")
def _(p):
    return p.orderBy(F.desc_nulls_last("value"), "indicator_id", "month").offset(24).limit(24).select("indicator_id", "month", "value")


@query("high_probability_months", """w AS (SELECT month, month_idx, count(value) OVER f AS n, count(*) FILTER (WHERE value >= 0.5) OVER f AS a FROM points WHERE indicator_id = 'nino34' WINDOW f AS (ORDER BY month_idx ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
p AS (SELECT month, CASE WHEN n > 0 THEN round(100.0::DOUBLE * a / n) ELSE 0 END::INT AS prob_nino FROM w) SELECT * FROM p WHERE prob_nino > 50 ORDER BY month DESC LIMIT 20""")
def _(p):
    return W.probability_bands(p.where("indicator_id = 'nino34'")).where("prob_nino > 50").orderBy(F.desc("month")).limit(20).select("month", "prob_nino")


@query("tick_sample", f"SELECT indicator_id, month, {rd('value')} AS value FROM points QUALIFY (row_number() OVER (PARTITION BY indicator_id ORDER BY month_idx) - 1) % 12 = 0")
def _(p):
    return p.withColumn("i", F.row_number().over(W.by_month()) - 1).where("i % 12 = 0").select("indicator_id", "month", "value")


@query("preliminary_last_3", "SELECT indicator_id, month, CASE WHEN row_number() OVER (PARTITION BY indicator_id ORDER BY month_idx DESC) <= 3 THEN 'preliminary' ELSE 'final' END AS flag FROM points")
def _(p):
    return W.mark_preliminary(p, 3).select("indicator_id", "month", "flag")


@query("calendar_labels", """SELECT DISTINCT month, printf('%s %d–%s %d–%s %d', strftime((month || '-01')::DATE - INTERVAL 2 MONTH, '%b'), year((month || '-01')::DATE - INTERVAL 2 MONTH), strftime((month || '-01')::DATE - INTERVAL 1 MONTH, '%b'), year((month || '-01')::DATE - INTERVAL 1 MONTH), strftime((month || '-01')::DATE, '%b'), year((month || '-01')::DATE)) AS label,
round(1990 + month_idx / 12.0::DOUBLE, 4) AS fractional_year, last_day((month || '-01')::DATE) AS month_end FROM points""")
def _(p):
    i = F.col("month_idx")
    return p.select("month", S.window_label(i).alias("label"), S.fractional_year(i).alias("fractional_year"), S.month_end(i).alias("month_end")).distinct()


@query("clamped_and_cdf", f"SELECT indicator_id, month, {rd('greatest(-1.0, least(1.0, value / 1.5))')} AS share FROM points WHERE value IS NOT NULL")
def _(p):
    return p.where("value is not null").select("indicator_id", "month", S.clamp(F.col("value"), 1.5).alias("share"))


@query("frames_with_gaps", f"SELECT month, {rd('value')} AS value, value IS NULL AS has_gap FROM points WHERE indicator_id = 'nino34' QUALIFY row_number() OVER (ORDER BY month_idx DESC) <= 120")
def _(p):
    return W.last_rows(p.where("indicator_id = 'nino34'"), 120).select("month", "value", F.col("value").isNull().alias("has_gap"))


@query("data_quality", """s AS (SELECT indicator_id, bool_or(value IS NULL) AS bad, count(*) FILTER (WHERE value IS NULL) AS missing FROM points GROUP BY 1)
SELECT CASE WHEN bool_or(bad) THEN 'DEGRADED' ELSE 'OK' END AS state, count(*) FILTER (WHERE bad) AS incomplete, sum(missing)::BIGINT AS missing FROM s""")
def _(p):
    s = p.groupBy("indicator_id").agg(F.bool_or(F.col("value").isNull()).alias("bad"), F.count_if(F.col("value").isNull()).alias("missing"))
    return s.agg(F.when(F.bool_or("bad"), "DEGRADED").otherwise("OK").alias("state"), F.count_if("bad").alias("incomplete"), F.sum("missing").alias("missing"))


@query("prior_snapshot_upsert", f"""SELECT indicator_id, month, {rd("CASE WHEN indicator_id IN ('nino12', 'soi') THEN value * 2 ELSE value END")} AS value FROM points""")
def _(p):
    fresh = p.where("indicator_id in ('nino12', 'soi')").withColumn("value", F.col("value") * 2)
    return Q.upsert(fresh, p, "indicator_id").select("indicator_id", "month", "value")
