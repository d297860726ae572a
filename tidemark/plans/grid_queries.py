"""Queries of grids in text files, through the data source, and of area means and climatologies over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.series_queries import rd, rounded
from tidemark.plans.table_queries import _GRID, _grid
from tidemark.sinks.publication import new_folder
from tidemark.sources import grid_files as GF

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


_DAY = "make_date(1990 + month_idx // 12, month_idx % 12 + 1, 1)"


def _texts(spark, sf, kind: str):
    """A file for each month of the grid of discounts: its days and box in the name."""
    g = _grid(spark, sf).withColumn("day", F.make_date((1990 + F.floor(F.col("month_idx") / 12)).cast("int"), (F.col("month_idx") % 12 + 1).cast("int"), F.lit(1)))
    box = [F.format_string("%.1f", f(c)) for c in ("lat", "lon") for f in (F.min, F.max)]
    lines = lambda x, sep: F.array_join(x, sep)
    if kind == "csv":
        line = F.format_string("%sT00:00:00Z,0.0,%.1f,%.1f,%s", F.col("day").cast("string"), "lat", "lon", F.when(F.col("value").isNotNull(), F.format_string("%.3f", "value")).otherwise("NaN"))
        files = g.groupBy("day").agg(lines(F.sort_array(F.collect_list(line)), "\n").alias("b"), F.array(*box).alias("box"))
        text = F.concat(F.lit("time,depth,latitude,longitude,anom\nUTC,m,degrees_north,degrees_east,1\n"), "b", F.lit("\n"))
    else:
        cell = F.when(F.col("value").isNotNull(), F.format_string("%.3f", "value")).otherwise("NaN")
        lons = F.array(*(F.lit(190.0 + 5 * i) for i in range(11)))
        rows = g.groupBy("day", "lat").agg(F.map_from_entries(F.collect_list(F.struct("lon", cell.alias("v")))).alias("at"))
        rows = rows.select("day", "lat", lines(F.transform(lons, lambda x: F.coalesce(F.try_element_at("at", x), F.lit("NaN"))), ", ").alias("line"), F.array(F.lit("190.0"), F.lit("240.0")).alias("ends"))
        files = rows.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("lat", "line"))).alias("r"), F.array(F.format_string("%.1f", F.min("lat")), F.format_string("%.1f", F.max("lat")), F.lit("190.0"), F.lit("240.0")).alias("box"))
        body = lines(F.transform("r", lambda x, i: F.concat(F.lit("[0]["), i.cast("string"), F.lit("], "), x["line"])), "\n")
        hours = (F.datediff("day", F.lit("1800-01-01").cast("date")) * 24).cast("string")
        axis = lambda name, values: F.concat(F.lit(f"anom.{name}["), F.size(values).cast("string"), F.lit("]\n"), lines(values, ", "), F.lit("\n\n"))
        text = F.concat(
            F.lit("Dataset {}\n---\nanom.anom[1]["), F.size("r").cast("string"), F.lit("][11]\n"), body, F.lit("\n\n"),
            axis("time", F.array(hours)), axis("lat", F.transform("r", lambda x: x["lat"].cast("string"))), axis("lon", F.transform(lons, lambda x: x.cast("string"))),
        )
    last = F.last_day("day").cast("string")
    return files.select(F.concat(F.concat_ws("_", F.lit("anom"), F.col("day").cast("string"), last, F.array_join("box", "_")), F.lit(f".{kind}")).alias("name"), text.alias("text"))


def _read(spark, sf, kind: str):
    folder = new_folder(spark, f"grid-{kind}")
    GF.write_files(_texts(spark, sf, kind), folder)
    return GF.read_grids(spark, folder, "anom")


_CELLS = f"SELECT {_DAY} AS day, lat AS latitude, lon AS longitude, {rd('round(value, 3)')} AS value FROM gg"


@query("grid_files_opendap", f"WITH {_GRID} {_CELLS} WHERE value IS NOT NULL")
def _(spark, sf):
    """All cells of all months, through files."""
    return _read(spark, sf, "asc").where("value is not null").select(F.col("time").cast("date").alias("day"), "latitude", "longitude", "value")


@query("grid_files_erddap", f"WITH {_GRID} {_CELLS}")
def _(spark, sf):
    return _read(spark, sf, "csv").select(F.col("time").cast("date").alias("day"), "latitude", "longitude", "value")


@query("grid_files_box", f"WITH {_GRID}, b AS ({_CELLS} WHERE lat BETWEEN -5 AND 5 AND lon BETWEEN 190 AND 220 AND {_DAY} BETWEEN DATE '1993-01-01' AND DATE '1996-12-31') SELECT day, count(value) AS points, {rd('sum(value * cos(radians(latitude))) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(latitude)) END)')} AS mean FROM b GROUP BY day HAVING count(value) > 0")
def _(spark, sf):
    """The monthly mean of a box and some years: the conditions choose files and rows in the reader."""
    cells = _read(spark, sf, "asc").where("time >= timestamp '1993-01-01' and time <= timestamp '1996-12-31' and latitude >= -5 and latitude <= 5 and longitude >= 190 and longitude <= 220 and value is not null")
    weight = F.cos(F.radians("latitude"))
    return cells.groupBy(F.col("time").cast("date").alias("day")).agg(F.count("value").alias("points"), (F.sum(F.col("value") * weight) / F.sum(weight)).alias("mean"))
