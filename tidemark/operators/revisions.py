"""Bitemporal tables: what was valid when, as known when.

A row says what held for a key over a valid time, and was known from known_from (included) to known_to (excluded, null
while nothing newer is known). Batches of what became known are merged in any order and any number of times: the rows
of a key are put in the order in which they became known, and each ends where the next begins. So a late batch splits
the interval that it falls into, and a batch that comes again changes nothing. Statements that repeat the one before are
kept, as a late one may come between them; joined() gives the intervals without them.

Defined cases: a row without a key's column or known_from is left out; of two statements for one key and time, one that
is withdrawn gives way to one that isn't, then the larger values count; withdrawn rows end what was known before
without saying anything new; null values are values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sinks.snapshots import Snapshots, Transaction


def revised(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Intervals of what is known from statements (keys, values, known_from, withdrawn): with known_to.

    The window holds the revisions of one key.
    """
    real = rows.where(" and ".join(f"`{c}` is not null" for c in [*keys, "known_from"]))
    one = real.groupBy(*keys, "known_from").agg(F.max(F.struct(~F.col("withdrawn"), *values)).alias("_r"))
    said = one.select(*keys, "known_from", *(F.col(f"_r.{c}").alias(c) for c in values), (~F.col("_r.col1")).alias("withdrawn"))
    return said.withColumn("known_to", F.lead("known_from").over(Window.partitionBy(*keys).orderBy("known_from"))).select(*keys, *values, "known_from", "known_to", "withdrawn")


def joined(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The intervals without those that repeat the one before, and without withdrawals of what was never said."""
    order = Window.partitionBy(*keys).orderBy("known_from")
    state = F.struct(*values, "withdrawn")
    new = rows.withColumn("_before", F.lag(state).over(order)).where(F.when(F.col("_before").isNull(), ~F.col("withdrawn")).otherwise(~F.col("_before").eqNullSafe(state)))
    return new.withColumn("known_to", F.lead("known_from").over(order)).drop("_before")


def as_known(rows: DataFrame, known_at: Column, valid_at: Column | None = None, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """What was known at a time, of all valid times or of one."""
    held = rows.where((F.col("known_from") <= known_at) & (F.col("known_to").isNull() | (F.col("known_to") > known_at)) & ~F.col("withdrawn"))
    return held if valid_at is None else held.where((F.col(valid_from) <= valid_at) & (F.col(valid_to) > valid_at))


class RevisionTable:
    """A bitemporal table of a store, by buckets of its keys. A batch reads and rewrites the buckets of its keys only."""

    def __init__(self, store: Snapshots, name: str, keys: list[str], values: list[str], buckets: int = 64):
        self.store, self.name, self.keys, self.values, self.buckets = store, name, keys, values, buckets

    def merge(self, batch: DataFrame) -> int | None:
        """Merges statements: keys, values, known_from and, if they have it, withdrawn. Returns the version, or None for an empty batch."""
        if "withdrawn" not in batch.columns:
            batch = batch.withColumn("withdrawn", F.lit(False))
        said = batch.select(*self.keys, *self.values, "known_from", F.coalesce("withdrawn", F.lit(False)).alias("withdrawn"))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r["b"] for r in said.select(bucket.alias("b")).distinct().collect()]  # at most one row a bucket

        def change(own: Transaction) -> None:
            rows = said
            if own.holds(self.name):
                rows = rows.unionByName(own.read(self.name, touched).drop("known_to"))
            own.replace_buckets(self.name, revised(rows, self.keys, self.values).withColumn("_bucket", bucket), "_bucket")

        return self.store.update(change) if touched else None

    def rows(self, version: int | None = None) -> DataFrame:
        return self.store.read(self.name, version)

    def as_known(self, known_at: Column, valid_at: Column | None = None) -> DataFrame:
        return as_known(self.rows(), known_at, valid_at)


def revision_sizes(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By key: how often the value was revised, and from what to what, by the first and the last statement."""
    said = joined(rows, keys, [value]).where("not withdrawn")
    ends = said.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("revisions"), F.min_by(value, "known_from").alias("first"), F.max_by(value, "known_from").alias("last"))
    return ends.withColumn("moved", F.col("last") - F.col("first"))


def table(spark: SparkSession, folder: str, name: str, keys: list[str], values: list[str], buckets: int = 64) -> RevisionTable:
    return RevisionTable(Snapshots(spark, folder, keep=3), name, keys, values, buckets)
