"""Checks before a release: what is wrong with published files, health records, manifests and sources, a row per problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of a source and of its freshness, and names of made-up data.
HEALTH_STATES = ("HEALTHY", "FAILED", "QUARANTINED")
FRESHNESS_STATES = ("CURRENT", "WITHIN_EXPECTED_CADENCE", "NOT_DUE", "PUBLICATION_EXPECTED", "DELAYED", "PRELIMINARY", "STALE", "FAILED", "QUARANTINED", "UNKNOWN")
OLD_FRESHNESS_STATE, OLD_VERSIONS = "FRESH", "3.0."
MADE_UP, NOT_MADE_UP = ("demostración", "sintético", "synthetic"), ("not synthetic", "no sintético")


def each(rows: DataFrame, name: Column, checks: list[Column]) -> DataFrame:
    """name and problem: a row per check that is not null."""
    return rows.select(name.alias("name"), F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def id_problems(files: DataFrame, exempt: tuple[str, ...] = ("source-registry.json",)) -> DataFrame:
    """JSON files (name, text) that don't parse, lack the publication id, or have another than the most frequent one."""
    read = files.select("name", F.get_json_object("text", "$.publicationId").alias("id"), F.try_parse_json("text").isNull().alias("broken"))
    top = read.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("id", F.struct("n", "id")).alias("top"))
    joined = read.join(F.broadcast(top))  # one row
    lacks = F.col("id").isNull() & ~F.col("broken") & ~F.col("name").isin(*exempt)
    return each(joined, F.col("name"), [F.when(F.col("broken"), "not JSON"), F.when(lacks, "no publication id"), F.when(F.col("id") != F.col("top"), "another publication id")])


def absent(wanted: DataFrame, files: DataFrame, problem: str) -> DataFrame:
    """Names that are wanted and not there."""
    return wanted.select("name").distinct().join(files.select("name"), "name", "left_anti").withColumn("problem", F.lit(problem))


def label_problems(files: DataFrame) -> DataFrame:
    """Files (name, text) that speak of made-up data, unless to deny it."""
    low = F.lower("text")
    said = lambda words: [F.contains(low, F.lit(w)) for w in words]
    return each(files, F.col("name"), [F.when(F.greatest(*said(MADE_UP)) & ~F.greatest(*said(NOT_MADE_UP)), "made-up data")])


def health_problems(health: DataFrame, data_version: str = "") -> DataFrame:
    """Health records (id, evidence, status, freshness, valid_end) without evidence or with states that don't exist."""
    old = data_version.startswith(OLD_VERSIONS)
    known = (*FRESHNESS_STATES, OLD_FRESHNESS_STATE) if old else FRESHNESS_STATES
    no = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = [
        F.when(no("evidence"), "no evidence"),
        F.when(~F.coalesce(F.col("status").isin(*HEALTH_STATES), F.lit(False)), "unknown status"),
        F.when(~F.coalesce(F.col("freshness").isin(*known), F.lit(False)), "unknown freshness"),
        F.when(F.lit(not old) & (F.col("status") == "HEALTHY") & no("valid_end"), "no valid period"),
    ]
    return each(health, F.col("id").cast("string"), checks)


def manifest_problems(listed: DataFrame, there: DataFrame) -> DataFrame:
    """Names of a manifest without a file, and files (not hidden ones) that it does not list."""
    return absent(listed, there, "listed, not there").unionByName(absent(there.where(~F.col("name").startswith(".")), listed, "there, not listed"))


def release_problems(versions: DataFrame, indicators: DataFrame, sources: DataFrame, wanted_sources: DataFrame, version: str) -> DataFrame:
    """versions: data_version of the manifests; indicators: id, ok, stale; sources and wanted_sources: name."""
    other = versions.where(~F.col("data_version").eqNullSafe(F.lit(version))).select(F.lit("manifest").alias("name"), F.lit("another data version").alias("problem"))
    failed = indicators.where(~F.coalesce("ok", F.lit(False)) & ~F.coalesce("stale", F.lit(False))).select(F.col("id").cast("string").alias("name"), F.lit("failed without a stale value").alias("problem"))
    return other.unionByName(failed).unionByName(absent(wanted_sources, sources, "source is absent"))


def report(problems: DataFrame) -> DataFrame:
    """passed, errors and the names with a problem, in one row."""
    return problems.agg((F.count(F.lit(1)) == 0).alias("passed"), F.count(F.lit(1)).alias("errors"), F.countDistinct("name").alias("names"))


def signals(latest: DataFrame, evaluated: Column) -> DataFrame:
    """Operational signals: indicator_id, value, label, color, unclassified of the latest values."""
    return latest.withColumn("s", evaluated).select("indicator_id", "value", "s.label", "s.color", "s.unclassified")


def unavailable(products: DataFrame, message: str, reason: str) -> DataFrame:
    """A JSON document for each product (name) that is not published."""
    body = F.struct(F.lit("UNAVAILABLE").alias("status"), F.lit(message).alias("message"), F.lit(reason).alias("reason"), F.col("name").alias("product"))
    return products.select(F.concat("name", F.lit(".json")).alias("file"), F.to_json(body).alias("json"))


def payout_scores(rows: DataFrame) -> DataFrame:
    """Status, safety score (0 to 100) and rating of payouts. rows: payout_ratio, growth, years, yield; null is unknown."""
    ratio, growth, years, rate = (F.col(c) for c in ("payout_ratio", "growth", "years", "yield"))
    by_ratio = F.when(ratio.isNull(), 0).when(ratio < 40, 20).when(ratio < 60, 10).when(ratio < 80, -10).otherwise(-20)
    by_growth = F.when(growth.isNull(), 0).when(growth > 10, 15).when(growth > 5, 10).when(growth > 0, 5).otherwise(-15)
    by_years = F.when(years >= 25, 15).when(years >= 10, 10).when(years >= 5, 5).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), 50 + by_ratio + by_growth + by_years - F.when(rate > 8, 10).otherwise(0)))
    status = F.when(ratio.isNull(), "unknown").when(ratio < 40, "safe").when(ratio < 60, "moderate").when(ratio < 80, "high").otherwise("unsustainable")
    scored = rows.withColumn("payout_status", status).withColumn("score", score.cast("int"))
    return scored.withColumn("rating", F.when(F.col("score") >= 80, "excellent").when(F.col("score") >= 60, "good").when(F.col("score") >= 40, "moderate").otherwise("poor"))
