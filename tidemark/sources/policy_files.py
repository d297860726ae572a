"""Threshold policies from files: a plain subset of YAML, read with column functions.

A file holds keys with values at its margin, lists of texts below a key, and below `rules` one entry for each rule:

    policy_id: "coastal-v2"
    applies_to: icen
    does_not_apply_to:
      - "roni"
    rules:
      - label: "Normal"
        min: -0.7
        max: 0.5
        min_inclusive: true

Files are small: one with more than `limit` characters raises. Lines of other forms are no error, as descriptions run over
several lines; what a policy lacks is told by problems().

Defined cases: comments and empty lines are passed over; null, ~ and nothing are null; limits are exclusive unless a file
says otherwise; a rule keeps its place in the file; files without a policy id are told by their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT = 1_000_000


def lines_of(spark: SparkSession, folder: str, limit: int = LIMIT) -> DataFrame:
    """file, n, section (the key at the margin that a line belongs to), item, key, value of the lines of all policy files."""
    texts = spark.read.option("pathGlobFilter", "*.{yaml,yml}").text(folder, wholetext=True)
    large = F.raise_error(F.concat(F.lit("policy file is too large: "), F.input_file_name())).cast("string")
    named = texts.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.when(F.length("value") > limit, large).otherwise(F.col("value")).alias("text"))
    rows = named.select("file", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).where(~F.col("line").rlike(r"^\s*(#|$)"))
    margin = F.regexp_extract("line", r"^(\w+):", 1)
    order = Window.partitionBy("file").orderBy("n")
    told = rows.withColumn("section", F.last(F.when(margin != "", margin), ignorenulls=True).over(order))
    told = told.withColumn("item", F.sum(F.when(F.col("line").rlike(r"^\s+- "), 1).otherwise(0)).over(Window.partitionBy("file", "section").orderBy("n")).cast("int") - 1)
    key = F.regexp_extract("line", r"^\s*(?:- )?(\w+):(?:\s|$)", 1)
    raw = F.trim(F.when(key != "", F.regexp_extract("line", r"^\s*(?:- )?\w+:\s*(.*)$", 1)).otherwise(F.regexp_extract("line", r"^\s+- (.*)$", 1)))
    return told.select("file", "n", "section", "item", F.when(key != "", key).alias("key"), F.col("line").rlike(r"^\w").alias("at_margin"), value_of(raw).alias("value"))


def value_of(raw: Column) -> Column:
    """A plain value: quotes go, and a comment after it."""
    quoted = F.regexp_extract(raw, r"""^(["'])(.*)\1\s*(?:#.*)?$""", 2)
    plain = F.trim(F.regexp_replace(raw, r"\s+#.*$", ""))
    return F.when(raw.rlike(r"""^["']"""), quoted).otherwise(F.when(~plain.isin("", "null", "~"), plain))


def policies(lines: DataFrame) -> DataFrame:
    """file, policy, name, version, applies_to, excluded: a row for each file."""
    top = lambda key: F.max(F.when(F.col("at_margin") & (F.col("section") == key), F.col("value")))
    excluded = F.array_sort(F.collect_set(F.when(~F.col("at_margin") & (F.col("section") == "does_not_apply_to") & F.col("key").isNull(), F.col("value"))))
    return lines.groupBy("file").agg(top("policy_id").alias("policy"), top("policy_name").alias("name"), top("version").alias("version"), top("applies_to").alias("applies_to"), excluded.alias("excluded"))


def rules(lines: DataFrame) -> DataFrame:
    """file, policy and the columns of policies.rule_table, in the order of each file."""
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    entries = lines.where((F.col("section") == "rules") & ~F.col("at_margin")).groupBy("file", F.col("item").alias("ord")).agg(
        of("label").alias("label"), of("color").alias("color"), of("min").try_cast("double").alias("least"), of("max").try_cast("double").alias("most"),
        F.coalesce(of("min_inclusive") == "true", F.lit(False)).alias("least_in"), F.coalesce(of("max_inclusive") == "true", F.lit(False)).alias("most_in"),
    )
    return entries.join(policies(lines).select("file", "policy"), "file").select("file", "policy", "ord", "label", "color", "least", "most", "least_in", "most_in")


def problems(lines: DataFrame) -> DataFrame:
    """file and what is wrong with it: no id, an id of another file too, no rules, a rule without a label, limits in the wrong order."""
    named = policies(lines)
    twice = named.where("policy is not null").groupBy("policy").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    of_file = rules(lines).groupBy("file").agg(F.count_if(F.col("label").isNull()).alias("nameless"), F.count_if(F.col("least") > F.col("most")).alias("turned"))
    both = named.join(of_file, "file", "left").join(twice.select("policy", F.lit(True).alias("again")), "policy", "left")
    checks = [
        F.when(F.col("policy").isNull(), "no id"), F.when(F.col("again"), "id is taken"), F.when(F.col("nameless").isNull(), "no rules"),
        F.when(F.col("nameless") > 0, "rule without a label"), F.when(F.col("turned") > 0, "limits in the wrong order"),
    ]
    return both.select("file", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of the files without a problem, for policies.classify_by_rules."""
    lines = lines_of(spark, folder)
    return rules(lines).join(problems(lines).select("file").distinct(), "file", "left_anti").drop("file")
