"""The consolidated status: current values with their freshness, checked against the series they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.quality import freshness_state
from tidemark.operators.windows import latest_known


def status_rows(points: DataFrame, as_of: Column, slo_days: int = 45, stale_days: int = 90) -> DataFrame:
    """A row per indicator: state, value (null when stale), the last known value, category of what is shown."""
    last = latest_known(points)
    state = freshness_state(S.month_end(F.col("month_idx")), as_of, F.lit(str(slo_days)), F.lit(str(stale_days)), F.when(F.col("flag") == "preliminary", "prelim").otherwise(""), F.lit(False))
    shown = F.when(F.col("state") != "STALE", F.col("value"))
    return last.withColumn("state", state).select("indicator_id", "month", "state", shown.alias("value"), F.col("value").alias("last_known"), S.status_category(F.col("indicator_id"), shown).alias("category"))


def rapid_rows(observations: DataFrame, as_of: Column, slo_days: int = 3, stale_days: int = 7) -> DataFrame:
    """A row per daily metric: its last known day, on which a final value beats a preliminary one, with its state.

    observations: metric_id, source_id, day, value, flag, point_count. A preliminary value is labelled so while it is
    current; a stale one is shown as the last known only. These rows are context and stand for no index.
    """
    known = observations.where(F.col("value").isNotNull() & ~F.isnan("value"))
    order = F.struct("day", (F.col("flag") == "final").alias("final"), "source_id")
    last = known.groupBy("metric_id").agg(F.max_by(F.struct("source_id", "day", "value", "flag", "point_count"), order).alias("r")).select("metric_id", "r.*")
    state = freshness_state(F.col("day"), as_of, F.lit(str(slo_days)), F.lit(str(stale_days)), F.when(F.col("flag") == "preliminary", "prelim").otherwise(""), F.lit(False))
    named = last.withColumn("state", state)
    return named.select("metric_id", "source_id", "day", "flag", "state", F.when(F.col("state") != "STALE", F.col("value")).alias("value"), F.col("value").alias("last_known"), "point_count")


def status_document(rows: DataFrame, publication_id: str, rapid: DataFrame | None = None) -> DataFrame:
    """One JSON document of all rows, and of the rapid observations beside them."""
    gathered = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    parts = gathered(rows, "indicators")
    if rapid is not None:
        parts = parts.crossJoin(gathered(rapid, "rapidObservations"))  # one row on either side
    return parts.select(F.to_json(F.struct(F.lit(publication_id).alias("publicationId"), *parts.columns), {"ignoreNullFields": "false"}).alias("json"))


def disagreements(status: DataFrame, points: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Indicators whose status differs from the last known value of the series."""
    tail = latest_known(points).select("indicator_id", F.col("value").alias("series_value"))
    return status.where("value is not null").join(tail, "indicator_id").where(F.abs(F.col("value") - F.col("series_value")) > tolerance).select("indicator_id", "value", "series_value")


def text_problems(files: DataFrame, least_lines: int, longest: int, marker: str) -> DataFrame:
    """What is wrong with text files (name, text), a row per problem."""
    lines = F.split("text", "\n")
    checks = [
        F.when(F.size(lines) < least_lines, "too few lines"),
        F.when(F.array_max(F.transform(lines, F.length)) > longest, "line too long"),
        F.when(~F.contains("text", F.lit(marker)), "no marker"),
        F.when(F.col("text").rlike("(?i)<html|<!doctype"), "markup"),
        F.when(F.col("text").rlike(r"[^\x00-\x7F]"), "not plain"),
    ]
    return files.select("name", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def topics_for(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics (topic_id, words) of which a word stands in a question (question_id, question), once each."""
    words = topics.select("topic_id", F.explode(F.split(F.lower("words"), r"[\s/]+")).alias("word"))
    asked = questions.select("question_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    return asked.join(words, "word").select("question_id", "topic_id").distinct()


def merged_set(sets: list[DataFrame], key: str) -> DataFrame:
    """All rows, those of earlier sets first where keys repeat."""
    all_rows = None
    for i, rows in enumerate(sets):
        part = rows.withColumn("_set", F.lit(i))
        all_rows = part if all_rows is None else all_rows.unionByName(part)
    first = all_rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in all_rows.columns if c not in (key, "_set")]), "_set").alias("r"))
    return first.select(key, "r.*")
