"""Checks: freshness, plausibility, cross-validation, fallback, coherence of publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import segments

#: Levels of a fallback.
PRIMARY, EQUIVALENT, LOWER_CADENCE, LAST_VALID, UNAVAILABLE = range(5)
# Metric, level, source. Level 4 is always available.
FALLBACKS = [
    ("roni", PRIMARY, "noaa-cpc-roni"), ("roni", LAST_VALID, "noaa-cpc-roni"), ("roni", UNAVAILABLE, ""),
    ("icen", PRIMARY, "enfen-imarpe-icen"), ("icen", EQUIVALENT, ""), ("icen", LAST_VALID, "enfen-imarpe-icen"), ("icen", UNAVAILABLE, ""),
    ("nino12", PRIMARY, "noaa-psl-nino12"), ("nino12", LOWER_CADENCE, "noaa-cpc-wksst"), ("nino12", LAST_VALID, "noaa-psl-nino12"), ("nino12", UNAVAILABLE, ""),
    ("nino34", PRIMARY, "noaa-psl-nino34"), ("nino34", LOWER_CADENCE, "noaa-cpc-wksst"), ("nino34", LAST_VALID, "noaa-psl-nino34"), ("nino34", UNAVAILABLE, ""),
    ("soi", PRIMARY, "noaa-cpc-soi"), ("soi", LAST_VALID, "noaa-cpc-soi"), ("soi", UNAVAILABLE, ""),
    ("u850", PRIMARY, "noaa-cpc-cpac850"), ("u850", EQUIVALENT, "noaa-cpc-wpac850"), ("u850", LAST_VALID, "noaa-cpc-cpac850"), ("u850", UNAVAILABLE, ""),
    ("d20", PRIMARY, "noaa-cpc-godas-d20"), ("d20", LAST_VALID, "noaa-cpc-godas-d20"), ("d20", UNAVAILABLE, ""),
    ("basin_official_status", PRIMARY, "noaa-cpc-enso-advisory"), ("basin_official_status", LAST_VALID, "noaa-cpc-enso-advisory"), ("basin_official_status", UNAVAILABLE, ""),
    ("coastal_official_status", PRIMARY, "enfen-imarpe-status"), ("coastal_official_status", LAST_VALID, "enfen-imarpe-status"), ("coastal_official_status", UNAVAILABLE, ""),
]
# What must never stand for a metric.
PROHIBITED = [
    ("roni", "nino34-rolling-mean"), ("roni", "oni"),
    ("icen", "nino12-rolling-mean"), ("icen", "nino12-weekly"), ("icen", "nino34"),
    ("soi", "coastal-soi"),
    ("u850", "surface-wind"), ("u850", "wind-anomaly"), ("u850", "wind-other-region"),
    ("d20", "d20-point"), ("d20", "d20-from-chart-colours"),
    ("basin_official_status", "operational-signal"), ("basin_official_status", "roni-above-limit"), ("basin_official_status", "rapid-observation"),
    ("coastal_official_status", "icen"), ("coastal_official_status", "nino12-high"),
]


def prohibited_uses(used: DataFrame) -> DataFrame:
    """Rows (metric_id, source_id) whose source must not stand for the metric."""
    return used.where(F.struct("metric_id", "source_id").isin(*(F.struct(F.lit(m).alias("metric_id"), F.lit(x).alias("source_id")) for m, x in PROHIBITED)))


def available_sources(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """source_id and level of what can be used: sources and caches whose last outcome is ok. outcomes: source_id, level, ok."""
    last = outcomes.groupBy("source_id", "level").agg(F.max_by("ok", F.struct(*order)).alias("ok"))
    return last.where("ok").select("source_id", "level")


def fallback_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FALLBACKS, "metric_id string, level int, source_id string")


def resolve_fallback(nodes: DataFrame, available: DataFrame) -> DataFrame:
    """The first level of each metric whose source is available. available: source_id, level."""
    held = available.select(F.col("source_id").alias("_s"), F.col("level").alias("_l"), F.lit(True).alias("_up")).distinct()
    joined = nodes.join(held, (F.col("source_id") == F.col("_s")) & (F.col("level") == F.col("_l")), "left")
    usable = joined.where(F.col("_up") | (F.col("level") == UNAVAILABLE))
    return usable.groupBy("metric_id").agg(F.min("level").alias("level"), F.min_by("source_id", "level").alias("source_id"))


def first_number(text: Column) -> Column:
    """The first whole number in a text such as "45 days"."""
    return F.regexp_extract(text, r"\d+", 0).try_cast("int")


def freshness_state(observed: Column, as_of: Column, slo: Column, stale: Column, policy: Column, failed: Column) -> Column:
    """FAILED, UNKNOWN, STALE, DELAYED, PRELIMINARY or CURRENT, by the age in days against the two limits."""
    age = F.datediff(as_of, observed)
    return (
        F.when(failed, "FAILED")
        .when(observed.isNull(), "UNKNOWN")
        .when(age > first_number(stale), "STALE")
        .when(age > first_number(slo), "DELAYED")
        .when(F.contains(F.lower(policy), F.lit("prelim")), "PRELIMINARY")
        .otherwise("CURRENT")
    )


def freshness_hours(month_start: Column, as_of: Column) -> Column:
    """Hours since the end of a month; none for a month that lasts."""
    return F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - F.unix_timestamp(F.add_months(month_start, 1).cast("timestamp"))) / 3600.0)


def within_cadence(observed: Column, as_of: Column, days: int) -> Column:
    """Whether the age is at most `days`; a date in the future passes."""
    return F.datediff(as_of, observed) <= days


def out_of_bounds(rows: DataFrame, value: str, least: float, most: float) -> DataFrame:
    return rows.where(F.col(value).isNotNull() & ~F.col(value).between(least, most))


def discrepancy(metric: str, a: Column, b: Column, tolerance: float, within: Column) -> list[Column]:
    """Columns of a comparison; it passes when a side is unknown."""
    diff = F.abs(a - b)
    return [F.lit(metric).alias("metric_id"), diff.alias("difference"), F.lit(tolerance).alias("tolerance"), F.when(diff.isNull(), True).otherwise(within).alias("within")]


def weekly_against_monthly(weekly: DataFrame, monthly: DataFrame, tolerance: float, least_weeks: int = 3) -> DataFrame:
    """Means of months with enough weeks against the monthly value. weekly: region, month, value; monthly: the same."""
    means = weekly.where("value is not null").groupBy("region", "month").agg(F.avg("value").alias("a"), F.count(F.lit(1)).alias("weeks")).where(F.col("weeks") >= least_weeks)
    joined = means.join(monthly.where("value is not null").select("region", "month", F.col("value").alias("b")), ["region", "month"])
    diff = F.abs(F.col("a") - F.col("b"))
    return joined.select("region", "month", "weeks", "a", "b", diff.alias("difference"), (diff <= tolerance).alias("within"))


def roll_up(discrepancies: DataFrame) -> DataFrame:
    return discrepancies.agg(F.count(F.lit(1)).alias("total"), F.count_if("within").alias("within"), F.count_if(~F.col("within")).alias("outside"), F.coalesce(F.bool_and("within"), F.lit(True)).alias("coherent"))


def official_against_index(alert: Column, index: Column) -> Column:
    """Whether an official alert fits the index."""
    return (
        F.when(index.isNull(), True)
        .when(alert == "El Niño Advisory", index >= 0.4)
        .when(alert == "La Niña Advisory", index <= -0.4)
        .when(alert == "ENSO-Neutral", F.abs(index) <= 0.7)
        .otherwise(True)
    )


def incoherent_publications(files: DataFrame) -> DataFrame:
    """Files without a publication id, or of another than the most frequent one. files: name, publication_id."""
    counts = files.groupBy("publication_id").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where("publication_id is not null").agg(F.max_by("publication_id", F.struct("n", "publication_id")).alias("top"))
    return files.join(F.broadcast(top)).where(~F.col("publication_id").eqNullSafe(F.col("top"))).select("name", "publication_id")


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, and which."""
    a = left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left"))
    b = right.select(key).distinct().join(left.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right"))
    return a.unionByName(b)


def failure_runs(outcomes: DataFrame, key: str, order: list[str], failures: int = 5, most: int = segments.MOST) -> DataFrame:
    """By source: its longest run of failures, the one it is in, and whether that is long enough for an alarm. outcomes have ok.

    A run is what follows a success; runs are counted by (key, run), which Spark combines before it shuffles them, and
    their numbers come from a scan in segments, so a source with many outcomes is no single task.
    """
    turns = segments.runs(outcomes, key, order, F.col("ok"), most).rows
    runs = turns.groupBy(key, "_run").agg(F.count_if(~F.col("ok")).alias("_n"))
    found = runs.groupBy(key).agg(F.max("_n").alias("longest"), F.max_by("_n", "_run").alias("current"))
    return found.withColumn("alarm", F.col("current") >= failures)


def watchdog(outcomes: DataFrame, key: str, order: list[str], as_of: Column, hours: int = 30, failures: int = 3) -> DataFrame:
    """By source: its last success, the failures since, and an alarm when that is `hours` ago with fewer than `failures`.

    With more failures in a row the failures themselves are the alarm.
    """
    last = outcomes.where("ok").groupBy(key).agg(F.max(order[0]).alias("last"))
    runs = failure_runs(outcomes, key, order, failures).select(key, F.col("current").alias("failures"))
    old = (F.unix_timestamp(as_of) - F.unix_timestamp("last")) / 3600 > hours
    return last.join(runs, key).select(key, "last", "failures", (old & (F.col("failures") < failures)).alias("alarm"))


def latest_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key with the largest values of these, nulls lowest; an aggregate, combined before it is shuffled."""
    return _picked(rows, key, F.max_by(F.struct(*rows.columns), F.struct(*order)))


def first_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key with the smallest values of these."""
    return _picked(rows, key, F.min_by(F.struct(*rows.columns), F.struct(*order)))


def _picked(rows: DataFrame, key: str, row: Column) -> DataFrame:
    return rows.groupBy(F.col(key).alias("_key")).agg(row.alias("_row")).select("_row.*")


def upsert(current: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """current, and the rows of prior whose key it lacks."""
    return current.unionByName(prior.join(current.select(key).distinct(), key, "left_anti"))
