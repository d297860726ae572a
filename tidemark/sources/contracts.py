"""Contracts of sources: whether a text has the shape that its parser wants, its last period, and contracts of CSV services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.sources.grids import MISSING
from tidemark.sources.text_tables import NUMBER

#: Lines that a seasonal or dated table and a table of years should have.
LEAST_LINES, LEAST_YEARS = 100, 50


def content_lines(text: Column) -> Column:
    """Lines that are neither empty nor a comment."""
    return F.filter(F.split(F.trim(text), r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))


def last(lines: Column) -> Column:
    return F.try_element_at(lines, F.lit(-1))


def first_problem(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), problem) for bad, problem in checks), F.lit(None).cast("string"))


def seasonal_contract(text: Column, least: int = LEAST_LINES) -> Column:
    """problem and last period of a table of season, year and anomaly."""
    lines = content_lines(text)
    c = F.split(F.trim(last(lines)), r"\s+")
    problem = first_problem(
        (~(F.contains(text, F.lit("SEAS")) | F.contains(text, F.lit("DJF"))), "no header"), (F.size(lines) < least, "too few lines"), (F.size(c) < 3, "last line is short"),
        (F.get(c, 1).try_cast("int").isNull() | F.get(c, 2).try_cast("double").isNull(), "last line is not numeric"),
    )
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), F.format_string("%s-%02d", F.get(c, 1), S.season_month(F.get(c, 0)))).alias("period"))


def dated_contract(text: Column, least: int = LEAST_LINES) -> Column:
    """problem and last period of a table of date and value."""
    lines = content_lines(text)
    c = F.split(last(lines), ",")
    head = F.get(lines, 0)
    problem = first_problem(
        (F.size(lines) < least, "too few lines"), (~(F.contains(head, F.lit("Date")) | F.contains(head, F.lit(","))), "no header"), (F.size(c) < 2, "last line is short"),
        (F.trim(F.get(c, 1)).try_cast("double").isNull(), "last line is not numeric"),
    )
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), F.substring(F.trim(F.get(c, 0)), 1, 7)).alias("period"))


def monthly_contract(text: Column, least: int = LEAST_YEARS) -> Column:
    """problem and last period of a table of a year and twelve values, fused negatives included; fill values are no period."""
    lines = F.filter(F.split(F.trim(text), r"\r?\n"), lambda x: x.rlike(r"^\d"))
    end = last(lines)
    values = F.slice(F.regexp_extract_all(F.substring(end, 5, 10_000), F.lit(NUMBER), F.lit(0)), 1, 12)
    known = F.size(F.filter(values, lambda x: x.cast("double") > -90))
    problem = first_problem((F.size(lines) < least, "too few lines"), (~end.rlike(r"^\d{4}"), "no year"), (F.size(values) < 12, "too few values"))
    return F.struct(problem.alias("problem"), F.when(problem.isNull() & (known > 0), F.format_string("%s-%02d", F.substring(end, 1, 4), known)).alias("period"))


def weekly_contract(text: Column) -> Column:
    days = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(\d{2}[A-Z]{3}\d{4})\s"), F.lit(1))
    problem = first_problem((~(F.contains(text, F.lit("Weekly SST")) | F.contains(text, F.lit("Nino"))), "no header"), (~F.contains(text, F.lit("JAN")), "no months"))
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), F.date_format(F.try_to_timestamp(F.initcap(last(days)), F.lit("ddMMMyyyy")), "yyyy-MM-dd")).alias("period"))


def advisory_contract(text: Column) -> Column:
    speaks = F.contains(text, F.lit("ENSO")) | F.contains(text, F.lit("El Niño")) | F.contains(text, F.lit("La Niña"))
    return F.struct(first_problem((~F.contains(text, F.lit("Alert System Status")), "no status"), (~speaks, "another subject")).alias("problem"), F.lit(None).cast("string").alias("period"))


def posts_contract(text: Column) -> Column:
    """problem and last period of a JSON array of posts."""
    post = F.get(F.from_json(text, "array<map<string,string>>"), 0)
    title = F.get_json_object(F.element_at(post, "title"), "$.rendered")
    problem = first_problem(
        (F.try_parse_json(text).isNull(), "not JSON"), (post.isNull(), "no posts"),
        (F.size(F.array_except(F.array(*map(F.lit, ("date", "link", "title", "content"))), F.map_keys(post))) > 0, "fields are absent"), (title.isNull(), "no title"),
    )
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), F.substring(F.element_at(post, "date"), 1, 10)).alias("period"))


CONTRACTS = {"seasonal": seasonal_contract, "dated": dated_contract, "monthly": monthly_contract, "weekly": weekly_contract, "advisory": advisory_contract, "posts": posts_contract}


def judged(texts: DataFrame) -> DataFrame:
    """texts (source_id, kind, text) with problem, period and a short digest of the text."""
    found = F.lit(None).cast("struct<problem:string,period:string>")
    for kind, contract in CONTRACTS.items():
        found = F.when(F.col("kind") == kind, contract(F.col("text"))).otherwise(found)
    named = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.struct(F.lit("empty").alias("problem"), F.lit(None).cast("string").alias("period"))).otherwise(found)
    unknown = ~F.col("kind").isin(*CONTRACTS)
    return texts.select("source_id", "kind", F.when(unknown, "no contract").otherwise(named["problem"]).alias("problem"), named["period"].alias("period"), F.substring(F.sha2("text", 256), 1, 16).alias("digest"))


def roll_up(found: DataFrame, advisory_only: tuple[str, ...] = ()) -> DataFrame:
    """One row: passed, failed, and whether all that block a release passed. Kinds in advisory_only never block."""
    bad = F.col("problem").isNotNull()
    return found.agg(F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed"), F.coalesce(~F.bool_or(bad & ~F.col("kind").isin(*advisory_only)), F.lit(True)).alias("may_release"))


# CSV services: a line of names, a line of units, data lines.


def fingerprint(names: Column, units: Column) -> Column:
    """A digest of names and units: it changes with the schema and not with the data."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat(F.array_join(names, "|"), F.lit("\n"), F.array_join(units, "|")), 256), 1, 16))


def headed(texts: DataFrame, id_col: str, wanted: dict[str, str | None]) -> DataFrame:
    """texts (id, text) with names, units, fingerprint, rows (maps of cells), and a problem of the header. wanted: column, unit or None."""
    lines = F.split("text", "\n")
    cut = lambda x: F.split(x, ",", -1)
    split = texts.select(id_col, cut(F.get(lines, 0)).alias("names"), cut(F.coalesce(F.get(lines, 1), F.lit(""))).alias("units"), F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))).alias("lines"))
    unit = F.map_from_arrays("names", "units")
    same = F.size("names") == F.size("units")
    off = [F.coalesce(F.element_at(F.when(same, unit), c), F.lit("")) != u for c, u in wanted.items() if u is not None]
    problem = F.when(F.size(F.array_except(F.array(*map(F.lit, wanted)), "names")) > 0, "column is absent").when(~same, "header lines differ").when(F.greatest(*off, F.lit(False)), "unit changed")
    rows = F.filter(F.transform("lines", cut), lambda c: F.size(c) == F.size(F.col("names")))
    return split.select(id_col, fingerprint(F.col("names"), F.col("units")).alias("fingerprint"), problem.alias("problem"), "names", rows.alias("rows"))


def _cells(head: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """A row per data line of texts with a good header: id and the wanted cells as text."""
    good = head.where("problem is null").select(id_col, "names", F.explode("rows").alias("c"))
    return good.select(id_col, *(F.trim(F.get("c", F.array_position("names", c).cast("int") - 1)).alias(c) for c in columns))


#: Least and most plausible values of a grid's variables.
BOUNDS = {"sst": (-3.0, 45.0), "anom": (-15.0, 15.0), "err": (0.0, 10.0)}


def grid_contract(texts: DataFrame, id_col: str, variable: str, unit: str, as_of: Column) -> DataFrame:
    """By text, the mean of its grid weighted by the cosine of latitude, with its time, points and fingerprint; or a problem."""
    head = headed(texts, id_col, {"time": None, "depth": None, "latitude": "degrees_north", "longitude": "degrees_east", variable: unit})
    raw = _cells(head, id_col, ["time", "depth", "latitude", "longitude", variable])
    gone = F.lower(variable).isin(*MISSING, "-999.0")
    value = F.col(variable).try_cast("double")
    read = raw.select(
        id_col, F.col("time").try_cast("timestamp").alias("at"), *(F.col(c).try_cast("double").alias(c) for c in ("depth", "latitude", "longitude")),
        F.when(~gone & ~F.isnan(value), value).alias("v"), (~gone & value.isNull()).alias("odd"),
    )
    copies = read.groupBy(id_col, "at", "depth", "latitude", "longitude").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("known"), F.max("v").alias("most"), F.min("v").alias("least"), F.sum("v").alias("total"), F.bool_or("odd").alias("odd")
    )
    weight = F.cos(F.radians("latitude"))
    place = (F.abs("depth") <= 0.01) & F.col("latitude").between(-90, 90) & (F.col("longitude") >= 0) & (F.col("longitude") < 360)
    low, high = BOUNDS[variable]
    found = copies.groupBy(id_col).agg(
        F.count_if(F.col("at") > as_of + F.expr("interval 2 days")).alias("future"), F.count_if(~F.coalesce(place, F.lit(False))).alias("off"), F.max("n").alias("copies"), F.count_if("odd").alias("odd"),
        F.count_if((F.col("least") < low) | (F.col("most") > high)).alias("wild"), F.sum("known").alias("points"), F.countDistinct(F.when(F.col("known") > 0, F.col("at"))).alias("times"),
        F.max("at").alias("at"), (F.sum(F.col("total") * weight) / F.sum(F.col("known") * weight)).alias("value"),
    )
    problem = F.coalesce(
        "problem", F.when(F.col("future") > 0, "future time"), F.when(F.col("off") > 0, "coordinates"), F.when(F.col("copies") > 1, "duplicate cell"), F.when(F.col("odd") > 0, "malformed value"),
        F.when(F.col("wild") > 0, "implausible value"), F.when(F.coalesce("points", F.lit(0)) == 0, "no values"), F.when(F.col("times") != 1, "not one time"),
    )
    joined = head.select(id_col, "fingerprint", "problem").join(found, id_col, "left").withColumn("problem", problem)
    fine = F.col("problem").isNull()
    return joined.select(id_col, F.when(fine, F.col("at")).alias("at"), F.when(fine, F.round("value", 4)).alias("value"), F.when(fine, F.col("points")).alias("point_count"), "fingerprint", "problem")


def station_contract(texts: DataFrame, id_col: str, variable: str, unit: str, quality: str, as_of: Column, accepted: tuple[int, ...] = (1, 2)) -> DataFrame:
    """By text, the plain mean over stations of the latest day with accepted quality, and the stations; or a problem."""
    head = headed(texts, id_col, {"station": None, "longitude": None, "latitude": None, "time": None, variable: unit, quality: None})
    raw = _cells(head, id_col, ["station", "longitude", "latitude", "time", variable, quality])
    number = {c: F.col(c).try_cast("double") for c in ("longitude", "latitude", variable, quality)}
    read = raw.select(id_col, "station", F.col("time").try_cast("timestamp").alias("at"), *(x.alias(f"n{i}") for i, x in enumerate(number.values())), F.greatest(*(x.isNull() for x in number.values())).alias("odd"))
    lon, lat, v, grade = (F.col(f"n{i}") for i in range(4))
    good = grade.cast("int").isin(*accepted) & ~F.isnan(v)
    keyed = read.groupBy(id_col, "station", "at").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("odd").alias("odd"), F.bool_or(~((lon >= 0) & (lon < 360) & lat.between(-90, 90))).alias("off"), F.count_if(good).alias("known"), F.sum(F.when(good, v)).alias("total")
    )
    # The latest day of a text is the largest of the days' structs: one row per text and day, then one per text.
    days = keyed.groupBy(id_col, F.to_date("at").alias("day")).agg(
        F.sum("total").alias("total"), F.sum("known").alias("known"), F.array_sort(F.collect_set(F.when(F.col("known") > 0, F.col("station")))).alias("stations"), F.count_if("odd").alias("odd"),
        F.count_if("off").alias("off"), F.max("n").alias("copies"), F.count_if(F.coalesce("station", F.lit("")) == "").alias("nameless"), F.count_if(F.col("at") > as_of + F.expr("interval 2 days")).alias("future"),
    )
    latest = F.max(F.when(F.col("known") > 0, F.struct("day", "total", "known", "stations"))).alias("d")
    found = days.groupBy(id_col).agg(latest, *(F.sum(c).alias(c) for c in ("odd", "off", "nameless", "future")), F.max("copies").alias("copies"))
    problem = F.coalesce(
        "problem", F.when(F.col("nameless") > 0, "no station"), F.when(F.col("future") > 0, "future time"), F.when(F.col("copies") > 1, "duplicate observation"), F.when(F.col("odd") > 0, "malformed value"),
        F.when(F.col("off") > 0, "coordinates"), F.when(F.col("d").isNull(), "no accepted values"),
    )
    joined = head.select(id_col, "fingerprint", "problem").join(found, id_col, "left").withColumn("problem", problem)
    fine = F.col("problem").isNull()
    return joined.select(
        id_col, F.when(fine, F.col("d.day")).alias("day"), F.when(fine, F.round(F.col("d.total") / F.col("d.known"), 4)).alias("value"), F.when(fine, F.size("d.stations")).alias("station_count"),
        F.when(fine, F.col("d.stations")).alias("stations"), "fingerprint", "problem",
    )
