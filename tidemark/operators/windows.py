"""Window operators over series of points (indicator_id, month_idx, value, ...), partitioned by indicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def by_month(key: str = "indicator_id") -> WindowSpec:
    return Window.partitionBy(key).orderBy("month_idx")


def trailing_mean(points: DataFrame, width: int = 3, calendar: bool = False, out: str = "mean") -> DataFrame:
    """Mean of the last `width` rows if all are known, else null. calendar counts months instead of rows."""
    w = by_month()
    w = w.rangeBetween(-(width - 1), 0) if calendar else w.rowsBetween(-(width - 1), 0)
    return points.withColumn(out, F.when(F.count("value").over(w) == width, F.avg("value").over(w)))


def probability_bands(points: DataFrame, width: int = 12) -> DataFrame:
    """Shares of the phases, in percent, and the mean in a centred window of known values."""
    half = width // 2
    w = by_month().rowsBetween(-half, half)
    n = F.count("value").over(w)

    def share(inside: Column) -> Column:
        return F.when(n > 0, F.round(100.0 * F.count(F.when(inside, 1)).over(w) / n)).otherwise(0).cast("int")

    v = F.col("value")
    return points.select(
        "indicator_id", "month_idx", "month",
        share(v >= 0.5).alias("prob_nino"), share((v < 0.5) & (v > -0.5)).alias("prob_neutral"), share(v <= -0.5).alias("prob_nina"),
        F.avg("value").over(w).alias("mean"),
    )


def rolling_trend(points: DataFrame, width: int = 24) -> DataFrame:
    """Slope and r² of the known values of the last `width` rows against their order among known values.

    Rows before the width-th, and frames with fewer than half the values, give none. A frame's known values have
    consecutive ranks among all known ones, so a running count serves as their order.
    """
    w = by_month()
    frame = w.rowsBetween(-(width - 1), 0)
    ranked = points.withColumn("_k", F.count("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")).withColumn("_i", F.row_number().over(w))
    x = F.when(F.col("value").isNotNull(), F.col("_k"))
    measured = ranked.select(
        *points.columns, "_i",
        F.count("value").over(frame).alias("_n"), F.covar_pop(x, F.col("value")).over(frame).alias("_xy"),
        F.var_pop(x).over(frame).alias("_xx"), F.var_pop("value").over(frame).alias("_yy"), F.avg("value").over(frame).alias("mean"),
    )
    found = measured.where((F.col("_i") >= width) & (F.col("_n") >= width / 2))
    slope = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")).otherwise(0.0)
    flat = (F.col("_xx") <= 0) | (F.col("_yy") < 1e-20)
    fit = F.when(flat, 0.0).otherwise(F.col("_xy") * F.col("_xy") / (F.col("_xx") * F.col("_yy")))
    return found.select("indicator_id", "month_idx", "month", slope.alias("slope"), fit.alias("r2"), "mean")


def latest_trend(points: DataFrame, width: int = 24) -> DataFrame:
    """The last slope of each indicator, and what it says."""
    last = rolling_trend(points, width).groupBy("indicator_id").agg(F.max_by("slope", "month_idx").alias("slope"), F.max("month_idx").alias("month_idx"))
    return last.withColumn("direction", F.when(F.col("slope") > 0.01, "creciente").when(F.col("slope") < -0.01, "decreciente").otherwise("estable"))


def pearson(cov: Column, var_x: Column, var_y: Column) -> Column:
    """A correlation, 0 where a side doesn't vary."""
    return F.when((var_x < 1e-20) | (var_y < 1e-20), 0.0).otherwise(cov / F.sqrt(var_x * var_y))


def pairs(points: DataFrame) -> DataFrame:
    """Every two indicators month by month: id_a < id_b, month_idx, a, b. An equi-join on the month."""
    left = points.select("month_idx", "month", F.col("indicator_id").alias("id_a"), F.col("value").alias("a"))
    right = points.select("month_idx", F.col("indicator_id").alias("id_b"), F.col("value").alias("b"))
    return left.join(right, "month_idx").where("id_a < id_b")


def rolling_correlation(points: DataFrame, width: int = 36) -> DataFrame:
    """Correlation of each pair over the last `width` rows; 0 with under half of them complete."""
    w = Window.partitionBy("id_a", "id_b").orderBy("month_idx")
    frame = w.rowsBetween(-(width - 1), 0)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    x, y = F.when(both, F.col("a")), F.when(both, F.col("b"))
    measured = pairs(points).select(
        "id_a", "id_b", "month_idx", "month", F.row_number().over(w).alias("_i"), F.count(x).over(frame).alias("_n"),
        F.covar_pop(x, y).over(frame).alias("_c"), F.var_pop(x).over(frame).alias("_x"), F.var_pop(y).over(frame).alias("_y"),
    )
    r = F.when(F.col("_n") < width / 2, 0.0).otherwise(pearson(F.col("_c"), F.col("_x"), F.col("_y")))
    return measured.where(F.col("_i") >= width).select("id_a", "id_b", "month_idx", "month", r.alias("r"))


def phase_changes(points: DataFrame, limit: float = 0.5) -> DataFrame:
    """Months whose phase differs from that of the last known month before."""
    known = points.where("value is not null").withColumn("to_phase", S.phase(F.col("value"), limit))
    moved = known.withColumn("from_phase", F.lag("to_phase").over(by_month()))
    return moved.where("from_phase is not null and from_phase <> to_phase").select("indicator_id", "month_idx", "month", "from_phase", "to_phase", "value")


def alert_states(points: DataFrame, threshold: float | Column, required: int = 3) -> DataFrame:
    """The run of months that ends with the last known one, in its direction; unknown months don't break it."""
    side = F.when(F.col("value") >= threshold, "warm").when(F.col("value") <= -threshold, "cool").otherwise("neutral")
    back = Window.partitionBy("indicator_id").orderBy(F.desc("month_idx"))
    known = points.where("value is not null").withColumn("side", side).withColumn("direction", F.first("side").over(back))
    running = known.withColumn("same", F.min((F.col("side") == F.col("direction")).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    counted = running.groupBy("indicator_id", "direction").agg(F.max_by("value", "month_idx").alias("current"), F.max("month_idx").alias("month_idx"), F.sum("same").alias("run"))
    neutral = F.col("direction") == "neutral"
    run = F.when(neutral, 0).otherwise(F.col("run")).cast("int")
    return counted.select(
        "indicator_id", "direction", "current", S.month_text(F.col("month_idx")).alias("month"), run.alias("consecutive"),
        F.when(neutral, 0).otherwise(F.least(F.lit(100), F.round(100.0 * run / required))).cast("int").alias("progress"),
        F.when(neutral, "Neutral").when(run >= required, "Cumplido").otherwise("En vigilancia").alias("status"),
    )


def alert_states_of(points: DataFrame, thresholds: dict[str, float], required: int = 3) -> DataFrame:
    """alert_states of several indicators, each by its own threshold, in one pass over the points."""
    own = points.sparkSession.createDataFrame(list(thresholds.items()), "indicator_id string, _threshold double")
    return alert_states(points.join(F.broadcast(own), "indicator_id"), F.col("_threshold"), required)  # a row for each given threshold


def latest_known(points: DataFrame) -> DataFrame:
    """The last known point of each indicator."""
    return points.where("value is not null").groupBy("indicator_id").agg(F.max_by(F.struct("month_idx", "month", "value", "flag"), "month_idx").alias("p")).select("indicator_id", "p.*")


def last_rows(points: DataFrame, n: int) -> DataFrame:
    """The last n months of each indicator."""
    return points.withColumn("_r", F.row_number().over(Window.partitionBy("indicator_id").orderBy(F.desc("month_idx")))).where(F.col("_r") <= n).drop("_r")


def mark_preliminary(points: DataFrame, n: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("indicator_id").orderBy(F.desc("month_idx")))
    return points.withColumn("flag", F.when(r <= n, "preliminary").otherwise("final"))


def not_monotonic(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows smaller than the last non-null value before them, in the order given."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.last(value, ignorenulls=True).over(w)).where(F.col(value) < F.col("before"))


def latest_preferring_final(rows: DataFrame, key: str, date: str, flag: str = "flag") -> DataFrame:
    """One row per key: the latest date, on which a final value beats a preliminary one."""
    w = Window.partitionBy(key).orderBy(F.desc(date), F.desc(F.col(flag) == "final"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
