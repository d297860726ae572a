"""The canonical long table of indicator points, made from base facts.

indicator_points: indicator_id, scope, month_idx (months since 1990-01), month, value, flag. Orders stand for the raw
readings: each priority is an indicator, the mean price of a month its reading. The only wide work is the monthly
aggregate, which Spark combines before its shuffle; everything after it runs on a few rows per indicator and month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

#: Priority, indicator and scope.
INDICATORS = [
    ("1-URGENT", "nino12", "coastal"),
    ("2-HIGH", "nino34", "basin"),
    ("3-MEDIUM", "soi", "basin"),
    ("4-NOT SPECIFIED", "d20", "basin"),
    ("5-LOW", "u850", "basin"),
]
COVERAGE, PRELIMINARY = 0.8, 2
SCHEMA = "indicator_id string, scope string, month_idx int, month string, value double, flag string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDICATORS, "o_orderpriority string, indicator_id string, scope string")


def monthly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """indicator_id, scope, month_idx, raw, n."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    cells = orders.groupBy("o_orderpriority", S.month_idx(F.year("o_orderdate"), F.month("o_orderdate")).alias("month_idx")).agg(F.avg("o_totalprice").alias("raw"), F.count(F.lit(1)).alias("n"))
    return cells.join(F.broadcast(indicators(spark)), "o_orderpriority").drop("o_orderpriority")


def on_spine(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a row for every month between the first and the last of all keys; months without a reading are null.

    A key's months, bounded by the calendar, go through one map, so that the facts behind rows are read once and not
    a second time for the ends of the spine.
    """
    others = [c for c in rows.columns if c not in (*keys, "month_idx")]
    held = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("month_idx", F.struct(*others)))).alias("_at"), F.min("month_idx").alias("_a"), F.max("month_idx").alias("_b"))
    every = Window.partitionBy()  # one row per key
    reach = held.select(*keys, "_at", F.min("_a").over(every).alias("_a"), F.max("_b").over(every).alias("_b"))
    spine = reach.select(*keys, "_at", F.explode(F.sequence("_a", "_b")).alias("month_idx"))
    return spine.select(*keys, "month_idx", F.try_element_at("_at", F.col("month_idx")).alias("_r")).select(*keys, "month_idx", "_r.*")


def indicator_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical table: z-scores of the monthly means; thin months are null; the last months are preliminary."""
    own = Window.partitionBy("indicator_id")
    cells = monthly_cells(spark, sf_dir)
    z = (F.col("raw") - F.avg("raw").over(own)) / F.stddev_pop("raw").over(own)
    scored = cells.select("indicator_id", "scope", "month_idx", F.when(F.col("n") >= COVERAGE * F.avg("n").over(own), z).alias("value"))
    full = on_spine(scored, ["indicator_id", "scope"])
    last = F.max("month_idx").over(own)
    return full.select(
        "indicator_id", "scope", "month_idx", S.month_text(F.col("month_idx")).alias("month"), "value",
        F.when(F.col("month_idx") > last - PRELIMINARY, "preliminary").otherwise("final").alias("flag"),
    )


#: The same table in DuckDB SQL, as common table expressions named dim, cells and points.
POINTS_SQL = """
dim(o_orderpriority, indicator_id, scope) AS (
  VALUES ('1-URGENT', 'nino12', 'coastal'), ('2-HIGH', 'nino34', 'basin'), ('3-MEDIUM', 'soi', 'basin'),
         ('4-NOT SPECIFIED', 'd20', 'basin'), ('5-LOW', 'u850', 'basin')
), cells AS (
  SELECT indicator_id, scope, ((year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1)::INT AS month_idx,
         avg(o_totalprice) AS raw, count(*) AS n
  FROM orders JOIN dim USING (o_orderpriority) GROUP BY ALL
), scored AS (
  SELECT indicator_id, scope, month_idx,
         CASE WHEN n >= 0.8 * avg(n) OVER w THEN (raw - avg(raw) OVER w) / stddev_pop(raw) OVER w END AS value
  FROM cells WINDOW w AS (PARTITION BY indicator_id)
), spine AS (
  SELECT indicator_id, scope, unnest(range((SELECT min(month_idx) FROM cells), (SELECT max(month_idx) FROM cells) + 1))::INT AS month_idx
  FROM (SELECT DISTINCT indicator_id, scope FROM cells)
), points AS (
  SELECT s.indicator_id, s.scope, s.month_idx,
         printf('%04d-%02d', 1990 + s.month_idx // 12, s.month_idx % 12 + 1) AS month, c.value,
         CASE WHEN s.month_idx > max(s.month_idx) OVER (PARTITION BY s.indicator_id) - 2 THEN 'preliminary' ELSE 'final' END AS flag
  FROM spine s LEFT JOIN scored c USING (indicator_id, month_idx)
)
"""
