"""Gridded and station observations: text responses, their contract, and area means."""

from __future__ import annotations

import datetime
import re
import urllib.parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opendap_block(texts: DataFrame, variable: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Grid rows of text responses (`text`): i_time, i_row, i_lon, value. A response without the variable raises. Columns in keep stay."""
    head = f"{variable}.{variable}["
    at = F.locate(head, F.col("text"))
    rest = F.when(at > 0, F.substring("text", at, F.length("text"))).otherwise(F.raise_error(F.lit(f"no data of {variable}")))
    block = F.element_at(F.split(rest, r"\n\s*\n"), 1)
    lines = texts.select(*keep, F.explode(F.split(block, "\n")).alias("line")).where(F.col("line").rlike(r"^\s*\[\d+\]"))
    index = F.regexp_extract_all("line", F.lit(r"\[(\d+)\]"), F.lit(1))
    values = F.split(F.regexp_replace("line", r"^\s*(\[\d+\])+\s*,\s*", ""), r"\s*,\s*")
    cells = lines.select(*keep, index.alias("i"), F.posexplode(values).alias("i_lon", "v"))
    return cells.select(*keep, F.col("i")[0].cast("int").alias("i_time"), F.element_at("i", -1).cast("int").alias("i_row"), "i_lon", known(F.col("v").try_cast("double")).alias("value"))


def opendap_axis(texts: DataFrame, variable: str, axis: str) -> DataFrame:
    """An axis of the response: i, value."""
    line = F.regexp_extract("text", rf"(?m)^\s*{variable}\.{axis}\[\d+\]\s*\n(.+)$", 1)
    return texts.select(F.posexplode(F.split(F.trim(line), r"\s*,\s*")).alias("i", "v")).select("i", F.col("v").try_cast("double").alias("value"))


def known(v: Column, limit: float = 1e6) -> Column:
    """v, null for NaN and for sizes of the limit or more."""
    return F.when(~F.isnan(v) & (F.abs(v) < limit), v)


def hours_month(hours: Column) -> Column:
    """YYYY-MM of hours since 1800-01-01."""
    return F.date_format(F.timestamp_seconds(hours.cast("long") * 3600 - 5364662400), "yyyy-MM")


def days_month(days: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), days.cast("int")), "yyyy-MM")


def complete_years(cells: DataFrame, key: str) -> DataFrame:
    """Months of every year that has any, null where a month lacks. cells: key, year, cal_month, value."""
    full = cells.select(key, "year").distinct().withColumn("cal_month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return full.join(cells, [key, "year", "cal_month"], "left")


#: Missing markers of the CSV services.
MISSING = ("nan", "na", "", "-999")


def two_header_csv(lines: DataFrame) -> DataFrame:
    """Data lines of a CSV with a line of names and a line of units: n, c; ragged lines are dropped. lines: n, line.

    Take cells with get(): a projection may run before ragged lines are gone.
    """
    width = F.size(F.split(F.min_by("line", "n"), ",", -1))
    wide = lines.agg(width.alias("w"))
    rows = lines.where("n >= 2").select("n", F.split("line", ",", -1).alias("c"))
    return rows.join(F.broadcast(wide)).where(F.size("c") == F.col("w")).select("n", "c")


def grid_observation(cells: DataFrame, least: float, most: float, as_of: Column) -> DataFrame:
    """One row: the weighted mean of a grid of one time, its point count, and what is wrong with it (null if nothing).

    cells: at timestamp, lat, lon, depth, value.
    """
    v = known(F.col("value"))
    weight = F.when(v.isNotNull(), F.cos(F.radians("lat")))
    repeated = cells.groupBy("at", "lat", "lon").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_copies"))
    found = cells.agg(
        F.countDistinct("at").alias("times"), F.max("at").alias("at"), F.round(F.sum(v * weight) / F.sum(weight), 4).alias("value"), F.count(v).alias("point_count"),
        F.count_if(F.abs("depth") > 0.01).alias("deep"), F.count_if(~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 360)).alias("off"),
        F.count_if(v.isNotNull() & ~v.between(least, most)).alias("wild"),
    )
    problem = (
        F.when(F.col("point_count") == 0, "no values").when(F.col("times") != 1, "not one time").when(F.col("most_copies") > 1, "duplicate cell")
        .when(F.col("deep") > 0, "depth").when(F.col("off") > 0, "coordinates").when(F.col("wild") > 0, "implausible value").when(F.col("at") > as_of + F.expr("interval 2 days"), "future time")
    )
    return found.join(repeated).select("at", "value", "point_count", problem.alias("problem"))


def station_observation(rows: DataFrame, accepted: tuple[int, ...] = (1, 2)) -> DataFrame:
    """One row: the mean over stations of the latest day, their names, and what is wrong. rows: station, at, value, quality."""
    good = rows.where(F.col("quality").isin(*accepted) & known(F.col("value")).isNotNull())
    repeated = rows.groupBy("station", "at").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_copies"), F.count_if(F.col("station").isNull()).alias("nameless"))
    last = good.agg(F.max(F.to_date("at")).alias("day"))
    found = good.join(last, F.to_date("at") == F.col("day")).groupBy("day").agg(F.avg("value").alias("value"), F.sort_array(F.collect_set("station")).alias("stations"))
    problem = F.when(F.col("nameless") > 0, "no station").when(F.col("most_copies") > 1, "duplicate observation")
    return found.join(repeated).select("day", "value", F.size("stations").alias("station_count"), "stations", problem.alias("problem"))


def grid_request(base: str, dataset: str, variable: str, south: float, north: float, west: float, east: float, allowed: tuple[str, ...]) -> str:
    """The address of a bounded request for the last time of a grid."""
    if variable not in allowed:
        raise ValueError(f"variable not allowed: {variable}")
    if not (-90 <= south <= north <= 90 and west <= east):
        raise ValueError("bounds out of order")
    return f"{base}/griddap/{dataset}.csv?{variable}[last][(0.0)][({south:g}):({north:g})][({west:g}):({east:g})]"


def station_request(base: str, dataset: str, columns: list[str], start: str, south: float, north: float, west: float, east: float, allowed: tuple[str, ...]) -> str:
    """The address of a bounded request for the latest row of each station of a box, from a day on."""
    if dataset not in allowed:
        raise ValueError(f"dataset not allowed: {dataset}")
    if not columns or not all(re.fullmatch(r"[0-9A-Za-z_]+", c) for c in columns):
        raise ValueError("columns are names of letters, digits and _")
    if not (-90 <= south <= north <= 90 and west <= east):
        raise ValueError("bounds out of order")
    limits = [("time>=", f"{datetime.date.fromisoformat(start)}T00:00:00Z"), ("latitude>=", f"{south:g}"), ("latitude<=", f"{north:g}"), ("longitude>=", f"{west:g}"), ("longitude<=", f"{east:g}")]
    asked = "".join("&" + urllib.parse.quote(name + value, safe="") for name, value in limits)
    return f"{base}/tabledap/{dataset}.csv?{','.join(columns)}{asked}&orderByMax({urllib.parse.quote(chr(34) + 'station,time' + chr(34), safe=',')})"
