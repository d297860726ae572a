"""Fields, forecasts and impacts spread from index values by fixed weights. Their random part is left at 0.

A month's values come from the points, so a field of many months is a join with a small table of cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

# Grids, departments (code, latitude) and horizon.
LATS, LONS = tuple(range(12, -13, -3)), tuple(range(-175, -74, 10))
MAP_LATS = tuple(range(15, -16, -5))
HOVMOLLER_LONS = tuple(range(120, 286, 15))
DEPARTMENTS = [("TUM", -3.57), ("PIU", -5.19), ("LAM", -6.71), ("LBR", -7.62), ("ANC", -9.53), ("LIM", -12.05), ("ICA", -14.07), ("ARE", -16.4), ("MOQ", -17.2), ("TAC", -18.01)]
HORIZON = 12


def cells(spark: SparkSession, lats=LATS, lons=LONS) -> DataFrame:
    return spark.createDataFrame([(float(a), float(b)) for a in lats for b in lons], "lat double, lon double")


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def by_month(points: DataFrame, ids: list[str]) -> DataFrame:
    return points.groupBy("month_idx").pivot("indicator_id", ids).agg(F.first("value"))


def fields(points: DataFrame, lats=LATS, lons=LONS, width: float = 55.0, reach: float = 14.0, coast: float = 13.0) -> DataFrame:
    """Temperature, thermocline and wind of each month and cell; unknown indices count as 0."""
    months = by_month(points, ["nino12", "nino34", "d20", "u850"]).na.fill(0.0)
    east = unit((F.col("lon") + 120) / width)
    mid = 1 - F.least(F.lit(1.0), F.abs("lat") / reach)
    u = F.col("u850") * (0.7 + 0.6 * mid) * (1 - F.greatest(F.lit(0.0), (F.col("lon") + 120) / 110) * 0.3)
    v = -0.4 * F.col("nino34") * F.signum("lat") * mid
    return months.join(F.broadcast(cells(points.sparkSession, lats, lons))).select(
        "month_idx", "lat", "lon",
        (F.col("nino34") * (1 - east) * mid + F.col("nino12") * east * (1 - F.abs("lat") / coast)).alias("sst"),
        (F.col("d20") * mid * (0.5 + 0.5 * east) + F.col("nino34") * 4 * (1 - east) * mid).alias("d20"),
        u.alias("u"), v.alias("v"), F.sqrt(u * u + v * v).alias("speed"),
    )


def map_cells(points: DataFrame) -> DataFrame:
    """The coarser fields of a map."""
    return fields(points, MAP_LATS, LONS, 50.0, 15.0, 12.0).select("month_idx", "lat", "lon", "sst", "d20")


def hovmoller(points: DataFrame, months: int = 96) -> DataFrame:
    """Thermocline along the equator for the last months; months without the basin index are null."""
    lons = points.sparkSession.createDataFrame([(float(x),) for x in HOVMOLLER_LONS], "lon double")
    last = points.agg(F.max("month_idx").alias("last"))
    wide = by_month(points, ["nino34", "nino12"]).join(F.broadcast(last)).where(F.col("month_idx") > F.col("last") - months)
    east = (F.col("lon") - 120) / 165
    deep = 9 * F.col("nino34") + F.coalesce("nino12", "nino34") * 3
    value = deep * east - 6 * F.col("nino34") * (1 - east) * (1 - east) + F.sin(F.col("month_idx") / 7 + F.col("lon")) * 1.2
    return wide.join(F.broadcast(lons)).select("month_idx", "lon", value.alias("value"))


def forecast(points: DataFrame, indicator: str = "nino34") -> DataFrame:
    """Central value and probabilities of the phases for the next months, from the last row (0.5 where unknown)."""
    last = points.where(F.col("indicator_id") == indicator).groupBy("indicator_id").agg(F.max("month_idx").alias("at"), F.coalesce(F.max_by("value", "month_idx"), F.lit(0.5)).alias("now"))
    ahead = last.select("at", "now", F.explode(F.sequence(F.lit(0), F.lit(HORIZON - 1))).alias("k"))
    idx = F.col("at") + F.col("k")
    central = F.col("now") * F.exp(-F.col("k") / 6) + 0.15 * F.cos(2 * math.pi * (idx % 12 - 11) / 12)
    sigma = 0.3 + F.col("k") * 0.08

    def percent(z: Column) -> Column:
        return F.round(F.least(F.lit(95.0), unit(S.normal_cdf(z)) * 100)).cast("int")

    nino, nina = percent((central - 0.5) / sigma), percent((-0.5 - central) / sigma)
    return ahead.select("k", S.month_text(idx).alias("month"), central.alias("central"), nino.alias("prob_nino"), F.greatest(F.lit(0), 100 - nino - nina).alias("prob_neutral"), nina.alias("prob_nina"))


def impacts(points: DataFrame) -> DataFrame:
    """Anomaly, rain and risk of the coastal departments in the last month; unknown indices count as 0."""
    deps = points.sparkSession.createDataFrame(DEPARTMENTS, "code string, lat double")
    last = by_month(points, ["nino12", "nino34"]).agg(*(F.coalesce(F.max_by(c, "month_idx"), F.lit(0.0)).alias(c) for c in ("nino12", "nino34")))
    w = F.greatest(F.lit(0.0), 1 - F.abs(F.col("lat") + 6) / 14)
    sst = F.round(F.col("nino12") * w + F.col("nino34") * 0.2 * (1 - w), 2)
    rain = F.round(sst * 45 * w, 1)
    risk = F.when(rain > 60, 4).when(rain > 30, 3).when(rain > 10, 2).otherwise(1)
    return deps.join(F.broadcast(last)).select("code", sst.alias("sst"), rain.alias("rain"), risk.alias("risk"))
