"""Checks of rows while they are written: metrics and rejected rows from one pass over the facts.

Rules name what a row must hold. Each row gets the list of rules that it breaks; rows without any go to the folder
ok=true and all others, with their list, to ok=false, in one write. The metrics are observed in the same job: they see
every row once and reach the driver as one row.

Defined cases: a rule that gives null is broken; an empty table gives metrics of 0 and null bounds; a task that runs
again counts once, as a task's metrics and files are those of its last attempt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Checked:
    """What a checked write left: the rows by outcome, and the metrics."""

    folder: str
    source: DataFrame
    metrics: dict

    def _rows(self, ok: str) -> DataFrame:
        spark = self.source.sparkSession
        kind = spark.createDataFrame([], self.source.schema).withColumn("broken", F.array().cast("array<string>")).withColumn("ok", F.lit(True)).schema
        return spark.read.schema(kind).parquet(self.folder).where(F.col("ok") == (ok == "true")).drop("ok")

    def accepted(self) -> DataFrame:
        return self._rows("true").drop("broken")

    def rejected(self) -> DataFrame:
        """The rows that broke a rule, with broken: the rules, in their order."""
        return self._rows("false")

    def quality(self, degraded_from: float = 0.0, failed_from: float = 0.1) -> DataFrame:
        """One row: state, rows, rejected, share; OK up to a share of rejected rows, then DEGRADED, then FAILED. No rows at all are a failure."""
        n, bad = self.metrics["rows"], self.metrics["rejected"]
        share = bad / n if n else None
        state = "FAILED" if share is None or share > failed_from else "DEGRADED" if share > degraded_from else "OK"
        return self.source.sparkSession.createDataFrame([(state, n, bad, share)], "state string, rows long, rejected long, share double")

    def by_rule(self) -> DataFrame:
        """rule, broken: a row for each rule."""
        found = [(k.removeprefix("broken_"), v) for k, v in self.metrics.items() if k.startswith("broken_")]
        return self.source.sparkSession.createDataFrame(found, "rule string, broken long")


def write_checked(rows: DataFrame, folder: str, rules: dict[str, Column], bounds: list[str] = ()) -> Checked:  # type: ignore[assignment]
    """Writes rows to a folder and checks them on the way. bounds: columns whose least and largest values are observed."""
    listed = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    marked = rows.withColumn("broken", listed).withColumn("ok", F.size("broken") == 0)
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("ok")).alias("rejected")]
    metrics += [F.count_if(F.array_contains("broken", name)).alias(f"broken_{name}") for name in rules]
    metrics += [f(c).alias(f"{n}_{c}") for c in bounds for n, f in (("least", F.min), ("most", F.max))]
    metrics += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in bounds]
    marked.observe(seen, *metrics).write.partitionBy("ok").parquet(folder)
    return Checked(folder, rows, seen.get)
