"""Events: runs of one phase in a series, their history, catalogue and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

#: Indicator, scope and threshold of the runs that make the history.
HISTORY = [("nino34", "cuenca", 0.5), ("nino12", "costero", 0.4)]


def extract_periods(points: DataFrame, threshold: float | Column = 0.5, strict_end: bool = False) -> DataFrame:
    """Runs of months of one phase, per indicator; the threshold may be a column of it.

    Unknown months don't break a run. A run ends with the month that breaks it, and an open one with the last row,
    known or not; strict_end ends it with its own last month instead. The peak is the first month of the largest size.
    """
    w = Window.partitionBy("indicator_id").orderBy("month_idx")
    rows = points.withColumn("last_idx", F.max("month_idx").over(Window.partitionBy("indicator_id")))
    known = rows.where("value is not null").withColumn("phase", S.phase(F.col("value"), threshold))
    turned = known.withColumn("turn", F.coalesce(F.lag("phase").over(w) != F.col("phase"), F.lit(True)).cast("int")).withColumn("next_idx", F.lead("month_idx").over(w))
    islands = turned.withColumn("island", F.sum("turn").over(w))
    peak = F.min_by(F.struct("value", "month_idx"), F.struct(-F.abs("value"), F.col("month_idx")))
    runs = islands.where("phase <> 'Neutral'").groupBy("indicator_id", "island", "phase").agg(
        F.min("month_idx").alias("start_idx"), F.max("month_idx").alias("own_end"), F.max_by("next_idx", "month_idx").alias("break_idx"), F.max("last_idx").alias("last_idx"), peak.alias("peak")
    )
    end = F.col("own_end") if strict_end else F.coalesce("break_idx", "last_idx")
    return runs.select(
        "indicator_id", "phase", "start_idx", end.alias("end_idx"), F.col("peak.month_idx").alias("peak_idx"), F.col("peak.value").alias("peak"),
        S.month_span(F.col("start_idx"), end).alias("duration"),
    )


def alert_history(points: DataFrame) -> DataFrame:
    """Periods of all scopes with their intensity, in one pass over the points."""
    of = lambda part: F.coalesce(*(F.when(F.col("indicator_id") == row[0], F.lit(part(i, row))) for i, row in enumerate(HISTORY)))
    threshold = of(lambda i, row: row[2])
    found = extract_periods(points.where(F.col("indicator_id").isin(*(row[0] for row in HISTORY))), threshold)
    named = found.select("*", of(lambda i, row: row[1]).alias("scope"), of(lambda i, row: i).alias("scope_ord"), threshold.alias("threshold"))
    return named.withColumn("intensity", S.intensity_label(F.col("peak"), F.col("scope"), F.col("threshold")))


def event_catalog(points: DataFrame) -> DataFrame:
    """The history in order of start, numbered, with year, decade and rank. Few rows: one window over all of them."""
    order = Window.orderBy("start_idx", "scope_ord")
    rounded = F.round("peak", 2)
    year = (F.floor(F.col("start_idx") / 12) + 1990).cast("int")
    return alert_history(points).select(
        F.concat_ws("-", "scope", (F.row_number().over(order) - 1).cast("string"), S.month_text(F.col("start_idx"))).alias("id"),
        "scope", "phase", S.month_text(F.col("start_idx")).alias("start_month"), S.month_text(F.col("end_idx")).alias("end_month"),
        S.month_text(F.col("peak_idx")).alias("peak_month"), rounded.alias("peak_value"), "duration", "intensity",
        year.alias("year"), (F.floor(year / 10) * 10).cast("int").alias("decade"), S.intensity_rank(rounded).alias("intensity_rank"),
    )


def event_series(points: DataFrame, peaks: DataFrame, reach: int = 24) -> DataFrame:
    """Each event's values from `reach` months before its peak to as many after; months outside the series are null.

    peaks: event_id, peak_idx. The offsets are exploded, so that the interval join is an equi-join on the month.
    """
    at = peaks.select("event_id", "peak_idx", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")).withColumn("month_idx", (F.col("peak_idx") + F.col("offset")).cast("int"))
    label = F.when(F.col("offset") == 0, "Pico").when(F.col("offset") > 0, F.concat(F.lit("+"), F.col("offset").cast("string"))).otherwise(F.col("offset").cast("string"))
    # The ids of all indicators are one short list, which goes with every row.
    ids = points.agg(F.array_sort(F.collect_set("indicator_id")).alias("_ids"))
    grid = at.join(F.broadcast(ids)).withColumn("indicator_id", F.explode("_ids"))
    return grid.join(points.select("indicator_id", "month_idx", "value"), ["indicator_id", "month_idx"], "left").select("event_id", "indicator_id", "offset", label.alias("label"), "value")


def scope_comparison(catalog: DataFrame) -> DataFrame:
    """Measures of the events of each scope, a row per scope."""
    return catalog.groupBy("scope").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("phase") == "El Niño").alias("warm"), F.count_if(F.col("phase") == "La Niña").alias("cold"),
        F.avg("duration").alias("mean_duration"), F.avg(F.abs("peak_value")).alias("mean_peak"), F.max(F.abs("peak_value")).alias("max_peak"),
    )


def scope_table(catalog: DataFrame, points: DataFrame) -> DataFrame:
    """Ten measures of each scope as text: scope, metric, value. Its events, its rule, and where its index stands now."""
    rules = [(scope, indicator, threshold) for indicator, scope, threshold in HISTORY]
    latest = points.groupBy("indicator_id").agg(F.max_by("value", "month_idx").alias("now"))
    known = scope_comparison(catalog).join(F.broadcast(catalog.sparkSession.createDataFrame(rules, "scope string, indicator_id string, threshold double")), "scope").join(latest, "indicator_id")
    one, two = (lambda c: F.format_string("%.1f", F.round(c, 1))), (lambda c: F.format_string("%.2f", F.round(c, 2) + F.lit(0.0)))
    text = {
        "events": F.col("events").cast("string"), "warm": F.col("warm").cast("string"), "cold": F.col("cold").cast("string"), "mean duration": one("mean_duration"), "mean peak": two("mean_peak"),
        "largest peak": two("max_peak"), "threshold": F.concat(F.lit("±"), F.col("threshold").cast("string")), "persistence": F.lit("3 months"),
        "current": F.when(F.col("now").isNull(), "-").otherwise(two("now")), "state": F.coalesce(S.phase(F.col("now"), F.col("threshold")), F.lit("-")),
    }
    return known.select("scope", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in text.items()))).alias("x")).select("scope", "x.*")
