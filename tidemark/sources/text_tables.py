"""Parsers of text tables of observations, as DataFrame transformations over lines or whole texts.

Lines come as rows with a column `line`; their order never matters, since every row carries its own period. A parser
gives month and value, null where a value is missing or a sentinel. Columns named in `keep` stay, such as the source of
a line where several are read together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
MONTH_CODES = [m.upper() for m in S.MONTH_NAMES]


def read_lines(spark, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def missing(v: Column, low: float | None = None, high: float | None = None, size: float | None = None, exact: tuple[float, ...] = ()) -> Column:
    """v, null where a sentinel: low or less, high or more, larger than size, or one of exact."""
    bad = v.isNull()
    if low is not None:
        bad = bad | (v <= low)
    if high is not None:
        bad = bad | (v >= high)
    if size is not None:
        bad = bad | (F.abs(v) > size)
    if exact:
        bad = bad | v.isin(*exact)
    return F.when(~bad, v)


def _twelve(rows: DataFrame, year: Column, cells: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per month from arrays of at least twelve cells."""
    return rows.select(*keep, year.alias("_y"), F.posexplode(F.slice(cells, 1, 12)).alias("_m", "_v")).select(*keep, F.format_string("%04d-%02d", F.col("_y"), F.col("_m") + 1).alias("month"), F.col("_v").try_cast("double").alias("value"))


def wide_years(lines: DataFrame, low: float | None = -99.0, high: float | None = 9999.0, size: float | None = None, exact: tuple[float, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """A table of a year and twelve values a line, by commas or white space. Other lines, markup and comments are skipped."""
    line = F.trim("line")
    cells = F.split(line, r"[\s,]+")
    rows = lines.where(~line.rlike("^[#<]")).select(*keep, cells.alias("c")).where((F.size("c") >= 13) & F.col("c")[0].try_cast("int").isNotNull())
    found = _twelve(rows, F.col("c")[0].try_cast("int"), F.slice("c", 2, 12), keep)
    return found.withColumn("value", missing(F.col("value"), low, high, size, exact))


def wide_problems(lines: DataFrame, keys: tuple[str, ...] = (), looked_at: int = 39) -> DataFrame:
    """What keeps lines of files from being such a table: keys and problem, a row for each. lines need a number, `n`.

    The first line that is no comment names the year, and one of the `looked_at` lines after it holds a year and twelve
    cells. Each file's lines are summed up where they are: its header is the line with the least number, and the rows
    after it are told by the numbers of the least few.
    """
    line = F.trim("line")
    body = lines.where((line != "") & ~line.startswith("#")).withColumn("c", F.split(line, r"[\s,]+"))
    good = (F.size("c") >= 13) & F.col("c")[0].try_cast("int").isNotNull()
    # Lines before a row, of those that count: rows further on than the limit are no help.
    own = Window.partitionBy(*keys).orderBy("n")
    placed = body.withColumn("_at", F.row_number().over(own)).where(F.col("_at") <= looked_at + 1)
    head = placed.groupBy(*keys).agg(F.min_by(F.lower(line), "n").alias("head"), F.count_if(good & (F.col("_at") > 1)).alias("rows"))
    checks = F.array(F.when(~F.coalesce(F.col("head").rlike("^(year|\\d{4})"), F.lit(False)), "no header"), F.when(F.col("rows") == 0, "no rows"))
    return head.select(*keys, F.explode(F.array_compact(checks)).alias("problem"))


def seasonal(lines: DataFrame, as_of_year: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Season, year and value a line; the month is the season's centre; the year of as_of is preliminary."""
    c = F.split(F.trim("line"), r"\s+")
    rows = lines.select(*keep, c.alias("c")).where(F.size("c") >= 3).select(*keep, F.col("c")[0].alias("season"), F.col("c")[1].try_cast("int").alias("y"), F.col("c")[2].try_cast("double").alias("v")).where("y is not null and v is not null")
    return rows.select(*keep, "season", F.format_string("%04d-%02d", "y", S.season_month(F.col("season"))).alias("month"), missing(F.col("v"), -99.0).alias("value"), F.when(F.col("y") >= as_of_year, "preliminary").otherwise("final").alias("flag"))


def weekly(lines: DataFrame) -> DataFrame:
    """Date and eight fused numbers a line; anomalies of the first and third region; weeks of -90 or less are dropped."""
    line = F.trim("line")
    day = F.to_date(F.concat(F.substring(line, 6, 4), F.lpad(F.array_position(F.array(*map(F.lit, MONTH_CODES)), F.substring(line, 3, 3)).cast("string"), 2, "0"), F.substring(line, 1, 2)), "yyyyMMdd")
    numbers = F.regexp_extract_all(F.substring(line, 10, 1000), F.lit(r"[-+]?\d+\.?\d*"), F.lit(0))
    rows = lines.where(line.rlike(r"^\d{2}[A-Z]{3}\d{4}\s")).select(day.alias("day"), numbers.alias("x")).where(F.size("x") >= 8)
    parts = F.array(*(F.struct(F.lit(r).alias("region"), F.round(F.col("x")[k].cast("double"), 2).alias("value")) for r, k in (("nino12", 1), ("nino34", 5))))
    return rows.select("day", F.explode(parts).alias("p")).select("day", "p.region", "p.value").where("value > -90")


def monthly_sections(texts: DataFrame, marker: str | None = None, fill: float = -999.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Years of twelve values, fused negatives included, from whole texts (`text`), after a marker if one is given."""
    text = F.col("text")
    if marker:
        at = F.locate(marker.upper(), F.upper(text))
        text = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(F.raise_error(F.lit(f"required section not found: {marker}")))
    rows = texts.select(*keep, F.explode(F.split(text, "\n")).alias("line")).select(*keep, F.trim("line").alias("line")).where(F.col("line").rlike(r"^\d{4}(\D|$)"))
    values = F.regexp_extract_all(F.substring("line", 5, 10_000), F.lit(NUMBER), F.lit(0))
    found = _twelve(rows.withColumn("v", values).where(F.size("v") >= 12), F.substring("line", 1, 4).cast("int"), F.col("v"), keep)
    return found.withColumn("value", missing(F.col("value"), low=fill, size=1e6))


def dated(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Date and value a line, by a comma."""
    c = F.split(F.trim("line"), r"\s*,\s*")
    rows = lines.select(*keep, F.try_to_timestamp(c[0], F.lit("yyyy-M-d")).alias("d"), c[1].try_cast("double").alias("v")).where("d is not null and v is not null")
    return rows.select(*keep, F.date_format("d", "yyyy-MM").alias("month"), missing(F.col("v"), -99.0).alias("value"))


def multi_column(lines: DataFrame, columns: dict[str, int], first_year: int = 1950, exact: tuple[float, ...] = (-99.99, -999.0, -9999.0)) -> DataFrame:
    """Year, month and columns a line; columns are numbered from 0."""
    c = F.split(F.trim("line"), r"\s+")
    rows = lines.select(c.alias("c")).where((F.size("c") > max(columns.values())) & (F.col("c")[0].try_cast("int") >= first_year))
    parts = F.array(*(F.struct(F.lit(k).alias("indicator_id"), F.col("c")[i].try_cast("double").alias("v")) for k, i in columns.items()))
    return rows.select(F.format_string("%04d-%02d", F.col("c")[0].try_cast("int"), F.col("c")[1].try_cast("int")).alias("month"), F.explode(parts).alias("p")).select("p.indicator_id", "month", missing(F.col("p.v"), exact=exact).alias("value"))


def published_csv(lines: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """month,value,flag lines after a preamble of comments; an empty value is null. Columns in keep stay."""
    c = F.split(F.trim("line"), ",", -1)
    rows = lines.where(F.trim("line").rlike(r"^\d{4}-\d{2},")).select(*keep, c.alias("c"))
    return rows.select(*keep, F.col("c")[0].alias("month"), F.col("c")[1].try_cast("double").alias("value"), F.when(F.size("c") > 2, F.col("c")[2]).alias("flag"))
