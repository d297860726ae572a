"""Queries of fields, forecasts and impacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import synthesis as Y
from tidemark.plans.series_queries import month, rd, rounded
from tidemark.sources import points as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(P.indicator_points(spark, sf_dir)))
        ORACLES[name] = f"WITH {P.POINTS_SQL}, {sql}"
        return f

    return add


def _cells(lats, lons, width, reach, coast) -> str:
    return f"""mo AS (SELECT month_idx, {', '.join(f"coalesce(max(value) FILTER (WHERE indicator_id = '{c}'), 0) AS {c}" for c in ('nino12', 'nino34', 'd20', 'u850'))} FROM points GROUP BY 1),
ce AS (SELECT a.lat::DOUBLE AS lat, b.lon::DOUBLE AS lon, greatest(0, least(1, (b.lon + 120) / {width}::DOUBLE)) AS e, 1 - least(1, abs(a.lat) / {reach}::DOUBLE) AS w, 1 - abs(a.lat) / {coast}::DOUBLE AS c
FROM (SELECT unnest({list(lats)}) AS lat) a CROSS JOIN (SELECT unnest({list(lons)}) AS lon) b),
fi AS (SELECT month_idx, lat, lon, nino34 * (1 - e) * w + nino12 * e * c AS sst, d20 * w * (0.5 + 0.5 * e) + nino34 * 4 * (1 - e) * w AS d20, u850 * (0.7 + 0.6 * w) * (1 - greatest(0, (lon + 120) / 110) * 0.3) AS u, -0.4 * nino34 * sign(lat) * w AS v FROM mo CROSS JOIN ce)"""


@query("gridded_fields", f"{_cells(Y.LATS, Y.LONS, 55, 14, 13)} SELECT month_idx, lat, lon, {rd('sst')} AS sst, {rd('d20')} AS d20, {rd('u')} AS u, {rd('v')} AS v, {rd('sqrt(u * u + v * v)')} AS speed FROM fi")
def _(p):
    return Y.fields(p)


@query("map_cells", f"{_cells(Y.MAP_LATS, Y.LONS, 50, 15, 12)} SELECT month_idx, lat, lon, {rd('sst')} AS sst, {rd('d20')} AS d20 FROM fi")
def _(p):
    return Y.map_cells(p)


@query("hovmoller", f"""mo AS (SELECT month_idx, max(value) FILTER (WHERE indicator_id = 'nino34') AS a, max(value) FILTER (WHERE indicator_id = 'nino12') AS b FROM points GROUP BY 1),
lo AS (SELECT unnest({list(Y.HOVMOLLER_LONS)})::DOUBLE AS lon)
SELECT month_idx, lon, {rd('(9 * a + coalesce(b, a) * 3) * (lon - 120) / 165 - 6 * a * (1 - (lon - 120) / 165) * (1 - (lon - 120) / 165) + sin(month_idx / 7.0::DOUBLE + lon) * 1.2')} AS value FROM mo CROSS JOIN lo WHERE month_idx > (SELECT max(month_idx) FROM mo) - 96""")
def _(p):
    return Y.hovmoller(p)


@query("forecast_central", f"""la AS (SELECT max(month_idx) AS m0, coalesce(arg_max_null(value, month_idx), 0.5) AS now FROM points WHERE indicator_id = 'nino34'), k AS (SELECT unnest(range(12)) AS k)
SELECT k::INT AS k, {month('(m0 + k)')} AS month, {rd('now * exp(-k / 6.0::DOUBLE) + 0.15::DOUBLE * cos(2 * pi() * ((m0 + k) % 12 - 11) / 12.0::DOUBLE)')} AS central FROM la CROSS JOIN k""")
def _(p):
    return Y.forecast(p).select("k", "month", "central")


@query("regional_impacts", f"""la AS (SELECT coalesce(arg_max_null(value, month_idx) FILTER (WHERE indicator_id = 'nino12'), 0) AS a, coalesce(arg_max_null(value, month_idx) FILTER (WHERE indicator_id = 'nino34'), 0) AS b FROM points),
de(code, lat) AS (VALUES {', '.join(f"('{c}', {x}::DOUBLE)" for c, x in Y.DEPARTMENTS)}), s AS (SELECT code, greatest(0, 1 - abs(lat + 6) / 14) AS w, a, b FROM de CROSS JOIN la),
r AS (SELECT code, w, round(a * w + b * 0.2::DOUBLE * (1 - w), 2) AS sst FROM s)
SELECT code, {rd('sst')} AS sst, {rd('round(sst * 45 * w, 1)')} AS rain, CASE WHEN round(sst * 45 * w, 1) > 60 THEN 4 WHEN round(sst * 45 * w, 1) > 30 THEN 3 WHEN round(sst * 45 * w, 1) > 10 THEN 2 ELSE 1 END AS risk FROM r""")
def _(p):
    return Y.impacts(p).orderBy(F.desc("risk"), "code")
