"""Streams of observations: windows, deduplication, rejection, and keyed tables kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import latest_by, upsert
from tidemark.sinks.publication import Snapshots, new_folder

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events as they arrive as Parquet files in a folder. The schema is fixed."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one Parquet file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def timed(events: DataFrame, late: str) -> DataFrame:
    """events with a watermark, which wants a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Count and sum by type and window; with `late`, windows close that long after the latest event."""
    rows = timed(events, late) if late else events
    found = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, slide: str) -> DataFrame:
    found = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("w.start").alias("start"), "n", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first of events with equal keys, as long as they arrive within `late` of each other."""
    return timed(events, late).dropDuplicatesWithinWatermark(keys)


def is_future(at: Column, as_of: Column, days: int = 2) -> Column:
    """Whether a time lies more than `days` after as_of; an unknown time does not."""
    return F.coalesce(at > as_of + F.make_dt_interval(F.lit(days)), F.lit(False))


def split_future(events: DataFrame, as_of: Column, days: int = 2) -> tuple[DataFrame, DataFrame]:
    """Events up to `days` after as_of, and those beyond."""
    late = is_future(F.col("ts"), as_of, days)
    return events.where(~late), events.where(late)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands everything that is there to `each`, batch by batch, and stops. A rerun goes on where it stopped."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def keep_current(spark: SparkSession, stream: DataFrame, table: Snapshots, key: str, order: list[Column], checkpoint: str, buckets: int = 64, name: str = "rows") -> None:
    """Keeps the latest row of each key as a table of `table`. A batch that is handed over again changes nothing.

    Keys are dealt to buckets by hash; a batch reads and rewrites the buckets of its keys only, and its number is noted
    with the version. Writers of other tables or buckets don't disturb it; after one of the same buckets it runs again.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def each(batch: DataFrame, batch_id: int) -> None:
        def change(own) -> None:
            if (own.marked(checkpoint) or 0) > batch_id:
                return
            touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most one row a bucket
            if touched:
                merged = batch.unionByName(own.read(name, touched)) if own.holds(name) else batch
                own.replace_buckets(name, latest_by(merged, key, *order).withColumn("_bucket", bucket), "_bucket")
                own.mark(checkpoint, batch_id + 1)

        if not batch.isEmpty():
            table.update(change)

    run_available(stream, each, checkpoint)


def stream_to_table(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """The result of a transformation over the events as a stream, after all that is there: a table in the shared folder.

    complete: the last batch's result replaces those before; append: results are added, and closed windows only.
    """
    out, checkpoint = new_folder(spark, "stream-out"), new_folder(spark, "stream-state")
    stream = table_stream(spark, sf_dir, "events")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    shaped = transform(stream)
    query = shaped.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return spark.read.schema(shaped.schema).parquet(out)


__all__ = ["deduplicated", "event_stream", "is_future", "keep_current", "run_available", "sessions", "sliding", "split_future", "stream_to_table", "table_stream", "tumbling", "upsert"]
