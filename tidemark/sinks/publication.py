"""Published artefacts: text files with a preamble, nested JSON, manifests, ledgers and atomically swapped snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.sinks.manifests import whole_digests
from tidemark.sinks.snapshots import Snapshots


#: Temporary folders of local sessions without one of their own, as in tests.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. A local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", "") or _own.get(app := spark.sparkContext.applicationId, "")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        found = _own[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def series_lines(points: DataFrame, preamble: dict[str, str], digits: int | None = 4) -> DataFrame:
    """Lines of a month,value,flag file for each indicator: indicator_id, n, line; comments first; null is empty."""
    value = F.format_string(f"%.{digits}f", "value") if digits is not None else F.col("value").cast("string")
    body = F.concat_ws(",", "month", F.coalesce(F.when(F.col("value").isNotNull(), value), F.lit("")), "flag")
    head = [f"# {k}: {v}" for k, v in preamble.items()] + ["month,value,flag"]
    top = points.select("indicator_id").distinct().select("indicator_id", F.posexplode(F.array(*map(F.lit, head))).alias("n", "line"))
    return top.unionByName(points.select("indicator_id", (F.col("month_idx") + len(head)).alias("n"), body.alias("line")))


def file_bodies(lines: DataFrame) -> DataFrame:
    """The whole file of each indicator and its SHA-256, as a trailer and a column. A file is one indicator's series."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    whole = lines.groupBy("indicator_id").agg(F.concat(body, F.lit("\n")).alias("body"))
    return whole.select("indicator_id", F.concat("body", F.lit("# file_sha256: "), F.sha2("body", 256), F.lit("\n")).alias("body"), F.sha2("body", 256).alias("file_sha256"))


def nested_series(points: DataFrame) -> DataFrame:
    """One JSON object per indicator: its points in order and a checksum over them."""
    ordered = points.groupBy("indicator_id", "scope").agg(F.sort_array(F.collect_list(F.struct("month_idx", "month", "value", "flag"))).alias("p"))
    flat = F.transform("p", lambda x: F.struct(x["month"].alias("month"), x["value"].alias("value"), x["flag"].alias("flag")))
    return ordered.select("indicator_id", F.to_json(F.struct(F.col("indicator_id").alias("indicatorId"), "scope", S.folded_checksum(F.col("indicator_id"), flat).alias("checksum"), flat.alias("points")), {"ignoreNullFields": "false"}).alias("json"))


def checksums(points: DataFrame) -> DataFrame:
    ordered = points.groupBy("indicator_id").agg(F.sort_array(F.collect_list(F.struct("month_idx", "month", "value"))).alias("p"))
    return ordered.select("indicator_id", S.folded_checksum(F.col("indicator_id"), F.col("p")).alias("checksum"))


def quoted_csv(df: DataFrame) -> Column:
    """A CSV line of all columns: quotes around what holds a comma, quote or line break."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.array_join(F.array(*map(cell, df.columns)), ",")


def export(points: DataFrame, dataset: str, fmt: str, ids: list[str]) -> DataFrame:
    """Rows of one indicator, or of all as a wide table, as CSV or JSON lines."""
    if dataset == "all":
        rows = points.groupBy("month").pivot("indicator_id", ids).agg(F.first("value"))
    else:
        rows = points.where(F.col("indicator_id") == dataset).select("month", "value", "flag")
    line = quoted_csv(rows) if fmt == "csv" else F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select("month", line.alias("line"))


def data_document(points: DataFrame, dimensions: DataFrame, as_of: str) -> DataFrame:
    """One JSON document of all series, for readers that take one: as_of and, by indicator, its description, checksum and points.

    dimensions: indicator_id and what describes it. The document holds months times indicators, which calendars bound.
    """
    p = points.groupBy("indicator_id").agg(F.sort_array(F.collect_list(F.struct("month_idx", "month", "value", "flag"))).alias("_p"))
    flat = F.transform("_p", lambda x: F.struct(x["month"].alias("month"), x["value"].alias("value"), x["flag"].alias("flag")))
    described = p.join(dimensions, "indicator_id", "left")
    extra = [c for c in dimensions.columns if c != "indicator_id"]
    series = F.struct(F.col("indicator_id").alias("indicatorId"), *extra, S.folded_checksum(F.col("indicator_id"), flat).alias("checksum"), flat.alias("points"))
    rows = described.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("indicator_id", series.alias("s"))))).alias("series"))
    return rows.select(F.to_json(F.struct(F.lit(as_of).alias("asOf"), "series"), {"ignoreNullFields": "false"}).alias("json"))


def stamped(rows: DataFrame, publication_id: str) -> DataFrame:
    return rows.withColumn("publication_id", F.lit(publication_id))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """File, size and SHA-256 of the data files of a folder. A task reads a file in pieces, so none is held whole."""
    return whole_digests(spark, folder).where(F.col("file").startswith("part-") | F.contains("file", F.lit("/part-"))).select(F.element_at(F.split("file", "/"), -1).alias("file"), "length", "sha256")


def append_ledger(entries: DataFrame, folder: str) -> None:
    entries.write.mode("append").parquet(folder)


__all__ = ["Snapshots", "append_ledger", "checksums", "data_document", "export", "file_bodies", "manifest", "nested_series", "new_folder", "quoted_csv", "series_lines", "shared_dir", "stamped"]
