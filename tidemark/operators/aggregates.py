"""Aggregates over series: climatologies, correlations, distributions, roll-ups, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.windows import latest_known, latest_trend, pairs, pearson


def cal_month() -> Column:
    return (F.pmod("month_idx", F.lit(12)) + 1).cast("int")


def cal_year() -> Column:
    return (F.floor(F.col("month_idx") / 12) + 1990).cast("int")


def climatology(points: DataFrame) -> DataFrame:
    """Mean, population deviation, least, most and count of each calendar month; all twelve, zeros where none is known."""
    months = points.select("indicator_id").distinct().withColumn("cal_month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    found = points.where("value is not null").groupBy("indicator_id", cal_month().alias("cal_month")).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n")
    )
    return months.join(found, ["indicator_id", "cal_month"], "left").na.fill(0.0, ["mean", "std", "least", "most"]).na.fill(0, ["n"])


def base_anomaly(points: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Value less the mean of its calendar month in the base years; null without either."""
    own = Window.partitionBy("indicator_id", cal_month())
    base = F.avg(F.when(cal_year().between(first_year, last_year), F.col("value"))).over(own)
    return points.withColumn("anomaly", F.col("value") - base)


def correlations(points: DataFrame, least: int = 10) -> DataFrame:
    """Correlation and strength of each pair with `least` complete months, the strongest first."""
    found = pairs(points).where("a is not null and b is not null").groupBy("id_a", "id_b").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("a", "b").alias("c"), F.var_pop("a").alias("x"), F.var_pop("b").alias("y")
    )
    r = pearson(F.col("c"), F.col("x"), F.col("y"))
    return found.where(F.col("n") >= least).select("id_a", "id_b", "n", r.alias("r"), S.strength(r).alias("strength")).orderBy(F.abs("r").desc(), "id_a", "id_b")


def correlation_matrix(points: DataFrame, ids: list[str]) -> DataFrame:
    """The symmetric matrix, a row per indicator: 1 on the diagonal, 0 for a missing pair."""
    r = correlations(points).select("id_a", "id_b", "r")
    both = r.unionByName(r.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "r"))
    wide = points.select(F.col("indicator_id").alias("id_a")).distinct().join(both, "id_a", "left").groupBy("id_a").pivot("id_b", ids).agg(F.first("r"))
    return wide.select("id_a", *(F.when(F.col("id_a") == c, 1.0).otherwise(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in ids))


def percentile_ranks(points: DataFrame) -> DataFrame:
    """Of each known value, the share of its series' known values below it, in whole percent."""
    known = points.where("value is not null")
    below = F.rank().over(Window.partitionBy("indicator_id").orderBy("value")) - 1
    return known.withColumn("percentile", F.round(100.0 * below / F.count(F.lit(1)).over(Window.partitionBy("indicator_id"))).cast("int"))


def fact_sheets(points: DataFrame) -> DataFrame:
    """A row per indicator: statistics, the last row, its percentile, two slopes, counts by sign."""
    last = points.groupBy("indicator_id").agg(F.max_by(F.struct("month", "value"), "month_idx").alias("last"))
    joined = points.where("value is not null").join(last, "indicator_id")
    sheet = joined.groupBy("indicator_id", "last").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0).alias("positive"), F.count_if(F.col("value") < 0).alias("negative"),
        F.count_if(F.col("value") < F.coalesce(F.col("last.value"), F.lit(0.0))).alias("below"),
    )
    for width in (12, 24):
        sheet = sheet.join(latest_trend(points, width).select("indicator_id", F.col("slope").alias(f"slope_{width}")), "indicator_id", "left").na.fill(0.0, [f"slope_{width}"])
    return sheet.select(
        "indicator_id", F.col("last.month").alias("latest_month"), F.col("last.value").alias("latest_value"), "mean", "std", "least", "most",
        F.when(F.col("last.value").isNotNull(), F.round(100.0 * F.col("below") / F.col("n"))).cast("int").alias("percentile"),
        "slope_12", "slope_24", "positive", "negative", "n", F.round(100.0 * F.col("positive") / F.col("n")).cast("int").alias("positive_share"),
    )


def with_phase(points: DataFrame, reference: str = "nino34") -> DataFrame:
    """Known points with the phase of the reference indicator in their month."""
    ref = points.where((F.col("indicator_id") == reference) & F.col("value").isNotNull()).select("month_idx", S.phase(F.col("value")).alias("phase"))
    return points.where("value is not null").join(ref, "month_idx")


def box_stats(points: DataFrame, reference: str = "nino34", most_outliers: int = 20) -> DataFrame:
    """Quartiles, whiskers and outliers of each indicator by phase; zeros for a phase without values."""
    phases = points.select("indicator_id").distinct().withColumn("phase", F.explode(F.array(*map(F.lit, ("El Niño", "Neutral", "La Niña")))))
    found = with_phase(points, reference).groupBy("indicator_id", "phase").agg(
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("value")).alias("values"),
    )
    q1, q2, q3 = (F.element_at("q", k) for k in (1, 2, 3))
    low, high = F.greatest("least", q1 - 1.5 * (q3 - q1)), F.least("most", q3 + 1.5 * (q3 - q1))
    boxes = found.select(
        "indicator_id", "phase", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), low.alias("whisker_low"), high.alias("whisker_high"), "least", "most", "n",
        F.slice(F.filter("values", lambda v: (v < low) | (v > high)), 1, most_outliers).alias("outliers"),
    )
    full = phases.join(boxes, ["indicator_id", "phase"], "left").na.fill(0.0, ["q1", "median", "q3", "whisker_low", "whisker_high", "least", "most"]).na.fill(0, ["n"])
    return full.withColumn("outliers", F.coalesce("outliers", F.array().cast("array<double>")))


def decade_summary(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("decade").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("phase") == "El Niño").alias("warm"), F.count_if(F.col("phase") == "La Niña").alias("cold"))


def quadrants(points: DataFrame, x: str = "nino34", y: str = "soi") -> DataFrame:
    """Months in each strict quadrant of two indicators; months on an axis count in the total only."""
    a = points.where(F.col("indicator_id") == x).select("month_idx", F.col("value").alias("x"))
    b = points.where(F.col("indicator_id") == y).select("month_idx", F.col("value").alias("y"))
    both = a.join(b, "month_idx").where("x is not null and y is not null")
    signs = {"pp": "x > 0 and y > 0", "pn": "x > 0 and y < 0", "np": "x < 0 and y > 0", "nn": "x < 0 and y < 0"}
    counted = both.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.expr(c)).alias(k) for k, c in signs.items()))
    return counted.select("total", *signs, *(F.round(100.0 * F.col(k) / F.col("total")).cast("int").alias(f"{k}_share") for k in signs))


def year_matrix(points: DataFrame, years: int = 15) -> DataFrame:
    """The last years of each indicator, a column per calendar month."""
    ranked = points.withColumn("year", cal_year()).withColumn("cal_month", cal_month()).withColumn("_r", F.dense_rank().over(Window.partitionBy("indicator_id").orderBy(F.desc(cal_year()))))
    return ranked.where(F.col("_r") <= years).groupBy("indicator_id", "year").pivot("cal_month", list(range(1, 13))).agg(F.first("value"))


def wide_table(points: DataFrame, ids: list[str]) -> DataFrame:
    """A row per month and a column per indicator."""
    return points.groupBy("month").pivot("indicator_id", ids).agg(F.first("value"))


def latest_vs_climatology(points: DataFrame) -> DataFrame:
    """The last known value against its calendar month; outside when 1.5 deviations away."""
    last = latest_known(points).withColumn("cal_month", cal_month())
    joined = last.join(climatology(points).select("indicator_id", "cal_month", "mean", "std"), ["indicator_id", "cal_month"])
    diff = F.col("value") - F.col("mean")
    return joined.select("indicator_id", "month", "value", "mean", diff.alias("difference"), (F.abs(diff) > 1.5 * F.col("std")).alias("outside"))


def area_mean(cells: DataFrame, keys: list[str], inside: Column | None = None) -> DataFrame:
    """Plain mean of the known cells in a box."""
    kept = cells if inside is None else cells.where(inside)
    return kept.groupBy(*keys).agg(F.avg("value").alias("mean"))


def area_mean_cos(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of known cells weighted by the cosine of latitude."""
    w = F.when(F.col("value").isNotNull(), F.cos(F.radians("lat")))
    return cells.groupBy(*keys).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("mean"))


def area_mean_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each latitude row first, then of the rows, weighted by the cosine of latitude."""
    rows = cells.where("value is not null").groupBy(*keys, "lat").agg(F.avg("value").alias("row_mean"))
    w = F.cos(F.radians("lat"))
    return rows.groupBy(*keys).agg((F.sum(F.col("row_mean") * w) / F.sum(w)).alias("mean"))


def composite_index(points: DataFrame) -> DataFrame:
    """Weighted sum of five scaled indicators, for the months in which all are known."""
    # Scale and weight.
    parts = {"nino34": (1.0, 0.30), "nino12": (1.2, 0.25), "soi": (-1.5, 0.20), "d20": (8.0, 0.15), "u850": (2.0, 0.10)}
    wide = points.groupBy("month_idx", "month").pivot("indicator_id", [*parts]).agg(F.first("value")).dropna(subset=[*parts])
    value = sum((F.col(k) / scale * weight for k, (scale, weight) in parts.items()), F.lit(0.0))
    return wide.select("month", value.alias("value"), *((F.col(k) / scale).alias(f"c_{k}") for k, (scale, _) in parts.items()), S.composite_category(value).alias("category"))


def pivot_report(df: DataFrame, rows: list[str], column: str, columns: list, value: str, how: str = "sum") -> DataFrame:
    """Rows by columns of sum, count, average, max or min; sum for any other word; missing cells are 0."""
    agg = {"count": F.count, "average": F.avg, "max": F.max, "min": F.min}.get(how, F.sum)
    names = [str(c) for c in columns]
    wide = df.groupBy(*rows).pivot(column, columns).agg(agg(F.col(value).cast("double")).cast("double"))
    return wide.na.fill(0.0, names).select(*rows, *(F.round(F.col(f"`{c}`"), 2).alias(c) for c in names))


def run_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one value), least and most."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))


def base_anomalies(rows: DataFrame, key: str, first: int, last: int, mean_digits: int = 3, digits: int = 2) -> DataFrame:
    """rows (key, year, cal_month, value) with anomaly: against the rounded mean of the month in the base years, rounded itself.

    Both roundings are of decimals, ties away from zero. A month without a known value in the base years has no anomaly.
    """
    base = F.avg(F.when(F.col("year").between(first, last), F.col("value"))).over(Window.partitionBy(key, "cal_month"))
    return rows.withColumn("anomaly", F.round(F.col("value") - F.round(base, mean_digits), digits))


def against_climatology(rows: DataFrame, climatology: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """rows (key, year, cal_month, value) with anomaly: the value less the month's one of climatology (key, cal_month, value).

    A climatology that lacks one of the twelve months of a key of rows, or its value, raises.
    """
    full = climatology.groupBy(key).agg(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("cal_month", "value"))).alias("_m"))  # twelve entries a key
    months = F.array_distinct(F.transform("_m", lambda m: m["cal_month"]))
    checked = full.select(F.col(key).alias("_k"), F.when(F.size(F.array_intersect(months, F.array(*(F.lit(i) for i in range(1, 13))))) == 12, F.map_from_entries("_m")).alias("_m"))
    broken = F.raise_error(F.concat(F.lit("climatology is incomplete: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("double")
    joined = rows.join(checked, F.col(key) == F.col("_k"), "left")
    normal = F.when(F.col("_m").isNull(), broken).otherwise(F.try_element_at("_m", F.col("cal_month")))
    return joined.select(*rows.columns, F.round(F.col("value") - normal, digits).alias("anomaly"))


def year_lines(rows: DataFrame, key: str, value: str, fill: str = "-99.99", digits: int = 2) -> DataFrame:
    """key, year, line: twelve values a year, filled where a month is unknown or absent."""
    cells = rows.groupBy(key, "year").agg(F.map_from_entries(F.collect_list(F.struct("cal_month", value))).alias("_m"))  # twelve entries
    texts = [F.when(v.isNotNull(), F.format_string(f"%.{digits}f", v)).otherwise(fill) for v in (F.try_element_at("_m", F.lit(i)) for i in range(1, 13))]
    return cells.select(key, "year", F.concat_ws(" ", F.col("year").cast("string"), *texts).alias("line"))
