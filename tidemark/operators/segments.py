"""Ordered operators on keys of any size: a scan in two levels.

A window over a key sorts the key's rows in one task. Here keys with more than `most` rows are cut into segments, ranges
of time of about `most` rows each. A window runs inside each segment; one row of each segment, its summary, is scanned
over the key; and what it carries from the segments before is joined back to the rows. The summaries of a key are
fewer than its rows by the factor `most`, so neither level holds a large group.

Segments follow from counts: the rows of large keys are counted by cells of time, a running sum over cells deals the
cells to segments, and rows find theirs by key and cell. A cell is never split, so it should be short enough to hold
well under `most` rows of one key. Keys below the limit are segment 0, and need no summary.

Defined cases: rows go by the order columns, ascending, nulls first; a null key is a key of its own; rows that are equal
in all order columns come in any order, so the last of these should be unique; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sinks.publication import new_folder

MOST, CELL = 1_000_000, 3600
#: Cells of large keys, and summaries, that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Segmented:
    """rows with _seg: 0 for keys that are whole, else from 1 on in the order of time."""

    rows: DataFrame
    key: str
    order: list[str]
    n_segments: int

    def window(self) -> WindowSpec:
        return Window.partitionBy(self.key, "_seg").orderBy(*(F.asc_nulls_first(c) for c in self.order))

    def position(self) -> Column:
        """The place of a row among the others of its key, for max_by: nulls first, as in the window."""
        return F.struct(*self.order)

    def select(self, *columns: str | Column) -> DataFrame:
        """The rows without their segments."""
        return self.rows.select(*columns)

    def with_column(self, name: str, value: Column) -> Segmented:
        return replace(self, rows=self.rows.withColumn(name, value))

    def _carried(self, summary: Column, over: Column, name: str) -> DataFrame:
        """rows with `name`: `over` (a window over "_sum" of earlier segments) of the summaries of their key's segments."""
        if not self.n_segments:
            return self.rows
        sums = self.rows.where("_seg > 0").groupBy(self.key, "_seg").agg(summary.alias("_sum"))
        carried = sums.select(F.col(self.key).alias("_k"), F.col("_seg").alias("_s"), over.over(self._before()).alias(name))
        few = F.broadcast(carried) if self.n_segments <= BROADCAST_ROWS else carried
        return self.rows.join(few, F.col(self.key).eqNullSafe(F.col("_k")) & (F.col("_seg") == F.col("_s")), "left").drop("_k", "_s")

    def _before(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)

    def running_sum(self, value: Column, out: str) -> Segmented:
        """out: the sum of value over the key's rows up to and with each; nulls count nothing."""
        zero = F.lit(0).cast("long")
        found = self._carried(F.sum(value), F.sum("_sum"), "_carry")
        here = F.coalesce(F.sum(value).over(self.window().rowsBetween(Window.unboundedPreceding, 0)), zero)
        carry = F.coalesce(F.col("_carry"), zero) if self.n_segments else zero
        return replace(self, rows=found.withColumn(out, here + carry).drop("_carry"))

    def numbered(self, out: str) -> Segmented:
        """out: the place of each row in its key, from 1."""
        return self.running_sum(F.lit(1), out)

    def last_known(self, value: Column, out: str, with_own: bool = True) -> Segmented:
        """out: the last value that isn't null among the key's rows before each, and its own if with_own."""
        held = F.when(value.isNotNull(), self.position())
        found = self._carried(F.max_by(value, held), F.last("_sum", ignorenulls=True), "_carry")
        here = F.last(value, ignorenulls=True).over(self.window().rowsBetween(Window.unboundedPreceding, 0 if with_own else -1))
        return replace(self, rows=found.withColumn(out, F.coalesce(here, F.col("_carry")) if self.n_segments else here).drop("_carry"))

    def previous(self, value: Column, out: str) -> Segmented:
        """out: the value of the row before, null or not."""
        boxed = F.struct(value.alias("v"))
        found = self._carried(F.max_by(boxed, self.position()), F.last("_sum"), "_carry")
        here = F.lag(boxed).over(self.window())
        return replace(self, rows=found.withColumn(out, (F.coalesce(here, F.col("_carry")) if self.n_segments else here)["v"]).drop("_carry"))


def cell_of(time: Column, kind: T.DataType, cell: int) -> Column:
    """The cell of a time (of `cell` seconds), of a date (days) or of a number; nulls come first."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        at = F.unix_seconds(time.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        at = F.unix_date(time).cast("long") * 86400
    else:
        at = time
    return F.coalesce(F.floor(at / cell).cast("long"), F.lit(-(1 << 62)))


def segmented(rows: DataFrame, key: str, order: list[str], most: int = MOST, cell: int = CELL) -> Segmented:
    """rows with their segments; order begins with the time."""
    spark, time = rows.sparkSession, order[0]
    at = cell_of(F.col(time), rows.schema[time].dataType, cell)
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(F.col(key).alias("_k"))
    keys = new_folder(spark, "large-keys")
    large.write.parquet(keys)
    large = spark.read.schema(large.schema).parquet(keys)
    n_large = large.count()  # at most the rows divided by `most`
    if not n_large:
        return Segmented(rows.withColumn("_seg", F.lit(0)), key, order, 0)
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    counted = rows.select(key, at.alias("_cell")).join(small(large, n_large), F.col(key).eqNullSafe(F.col("_k"))).groupBy("_k", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    cells = counted.select("_k", "_cell", (F.floor(upto / most) + 1).cast("int").alias("_s"))
    place = new_folder(spark, "segments")
    cells.write.parquet(place)
    cells = spark.read.schema(cells.schema).parquet(place)
    found = cells.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct(F.struct("_k", "_s")).alias("segments")).first()
    joined = rows.withColumn("_at", at).join(small(cells, found["cells"]), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_cell")), "left")
    return Segmented(joined.withColumn("_seg", F.coalesce("_s", F.lit(0))).drop("_k", "_cell", "_s", "_at"), key, order, max(1, found["segments"]))


def timeline(rows: DataFrame, key: str, order: list[str], what: str, most: int = MOST, cell: int = CELL) -> DataFrame:
    """rows with their place in their key's order, and what came before."""
    cut = segmented(rows, key, order, most, cell).numbered("place").previous(F.col(what), "before")
    return cut.select(*rows.columns, F.col("place").cast("int").alias("place"), "before")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str, most: int = MOST, cell: int = CELL) -> DataFrame:
    """left with the value of the last row of right, of the same key, at or before its time; null where there is none.

    Of rows of right with equal times the one with the largest value counts.
    """
    asked = left.withColumn("_right", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    given = right.select(F.col(key), F.col(time), F.col(value).alias("_right")).withColumn("_side", F.lit(0))
    both = asked.unionByName(given, allowMissingColumns=True)
    found = segmented(both, key, [time, "_side", "_right"], most, cell).last_known(F.col("_right"), out)
    return found.rows.where("_side = 1").select(*left.columns, out)


def runs(rows: DataFrame, key: str, order: list[str], ok: Column, most: int = MOST, cell: int = CELL) -> Segmented:
    """rows with _run: the number of rows so far for which ok holds. Equal numbers are one run of others, after such a row."""
    return segmented(rows, key, order, most, cell).running_sum(F.coalesce(ok.cast("long"), F.lit(0).cast("long")), "_run")


def current_runs(rows: DataFrame, key: str, order: list[str], side: str, most: int = MOST, cell: int = CELL) -> DataFrame:
    """By key: the side of its last row, and how many rows in a row end with it. Null sides are passed over."""
    placed = segmented(rows.where(F.col(side).isNotNull()), key, order, most, cell).numbered("_place")
    by_side = placed.rows.groupBy(key, side).agg(F.max("_place").alias("_last"))
    last = by_side.groupBy(key).agg(F.max(F.struct("_last", side)).alias("_top"), F.sort_array(F.collect_list("_last"), asc=False).alias("_ends"))  # one entry a side
    return last.select(key, F.col(f"_top.{side}").alias(side), (F.col("_top._last") - F.coalesce(F.try_element_at("_ends", F.lit(2)), F.lit(0))).alias("run"))


def sessions(rows: DataFrame, key: str, order: list[str], gap_seconds: int, most: int = MOST, cell: int = CELL) -> DataFrame:
    """rows with session: their number of the key's session, from 1; a session ends before a pause of the gap or longer."""
    cut = segmented(rows, key, order, most, cell).previous(F.col(order[0]), "_before")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    new = F.col("_before").isNull() | (micros(order[0]) - micros("_before") >= gap_seconds * 1_000_000)
    return cut.running_sum(new.cast("long"), "session").select(*rows.columns, "session")


def not_monotonic(rows: DataFrame, key: str, order: list[str], value: str, most: int = MOST, cell: int = CELL) -> DataFrame:
    """Rows smaller than the last value before them that isn't null."""
    found = segmented(rows, key, order, most, cell).last_known(F.col(value), "before", with_own=False)
    return found.select(*rows.columns, "before").where(F.col(value) < F.col("before"))


def changes(rows: DataFrame, key: str, order: list[str], state: str, most: int = MOST, cell: int = CELL) -> DataFrame:
    """Rows whose state differs from the last known one before, with from_state."""
    found = segmented(rows.where(F.col(state).isNotNull()), key, order, most, cell).previous(F.col(state), "from_state")
    return found.select(*rows.columns, "from_state").where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))
