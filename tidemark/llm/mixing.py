"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id. A document's first copy finishes at the cumulative size of
its source up to and with it, divided by the source's target; its second copy one whole source later. Copies are taken
in the order of these virtual finish times, over all sources, until the total budget is used up. As the rates are the
targets, every source has taken about its target when virtual time reaches 1.

No step sorts a source or the corpus in one task. Cumulative sums run inside hash ranges of a source, whose number
grows with the rows, plus the sum of the ranges before. The global order is cut into ranges of virtual time; whole
ranges are taken by their sums, and only the range in which the budget ends is sorted.

Defined cases: a null or empty text has size 0 and is never taken; a null source comes last; null ids are drawn like one
id; rows that repeat an id are mixed like any others; equal finish times go by source; an empty table, or one without
words, takes nothing; other columns stay as they are in mixed_rows(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
#: Rows that one range of a source should hold on average.
RANGE_ROWS = 20_000
#: Ranges of one unit of virtual time, and units before the last, open range.
TIME_RANGES, TIME_UNITS = 16_384, 4


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: _rank, source, source_size, target. The windows run over one row per source.

    Sources are filled in the order in which they reach their cap; those that don't, share what is left by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(0, Window.unboundedFollowing)
    level = (
        ranked.withColumn("_w", weight.cast("double"))
        .withColumn("_cap", F.col("source_size").cast("double") * repeats)
        .withColumn("_budget", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(filled), F.lit(0.0))) / F.sum("_w").over(rest))
        .withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
        .withColumn("_level", F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(every)["_level"])
    )
    return level.select(
        "_rank", "source", "source_size", "_budget",
        F.when(F.col("_full") | F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w"))).alias("target"),
    )


def shuffle_key(id_col: str = "doc_id", seed: str = "mix") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def finish_times(sizes: DataFrame, targets: DataFrame, ranges: int, id_col: str = "doc_id") -> DataFrame:
    """sizes with _rank, source_size, target, _budget and _cum, the size of the source up to and with the row."""
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("_u", shuffle_key(id_col)).withColumn(
        "_range", F.floor(F.conv(F.substring("_u", 1, 7), 16, 10).cast("long") * ranges / float(16**7)).cast("int")
    )
    before = (
        rows.groupBy("_rank", "_range").agg(F.sum("size").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_rank").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("_rank", "_range").orderBy("_u", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_cum", F.sum("size").over(inside)).join(before, ["_rank", "_range"]).withColumn("_cum", F.col("_cum") + F.col("_before")).drop("_before", "_u", "_range")


def copies(timed: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """A row per document and copy: _f, the virtual finish time, and _slot, its range."""
    times = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: (F.col("_cum") + k * F.col("source_size")) / F.col("target"))
    return timed.where("size > 0").select("_rank", "size", "_budget", F.explode(times).alias("_f")).withColumn("_slot", slot(F.col("_f")))


def slot(finish: Column) -> Column:
    return F.least(F.floor(finish * TIME_RANGES), F.lit(TIME_RANGES * TIME_UNITS)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken (words, repeats counted)."""
    sizes = common.stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), common.words(F.col(text_col)).alias("size")), "mix-sizes")
    ranges = max(16, min(1 << 20, sizes.count() // RANGE_ROWS))
    timed = common.stored(finish_times(sizes, source_targets(sizes, weights, share, repeats), ranges), "mix-times")
    every = copies(timed, repeats)
    # One row per range of virtual time: a bounded table.
    sums = every.groupBy("_slot").agg(F.sum("size").alias("_n"), F.max("_budget").alias("_budget"))
    order = Window.orderBy("_slot")
    ends = sums.withColumn("_upto", F.sum("_n").over(order)).where("_upto > _budget").agg(F.min(F.struct("_slot", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("x")).first()["x"]
    if ends is None:
        last_slot, last = TIME_RANGES * TIME_UNITS + 1, None
    else:
        last_slot = ends["_slot"]
        inside = Window.partitionBy("_slot").orderBy("_f", "_rank").rowsBetween(Window.unboundedPreceding, 0)
        fits = every.where(F.col("_slot") == last_slot).withColumn("_upto", F.sum("size").over(inside) + F.lit(ends["_before"])).where("_upto <= _budget")
        last = fits.agg(F.max(F.struct("_f", "_rank")).alias("x")).first()["x"]

    def taken(copy: int) -> Column:
        finish = (F.col("_cum") + copy * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target"))
        inside = slot(finish) < last_slot
        if last is not None:
            cut = F.struct(F.lit(last["_f"]).alias("_f"), F.lit(last["_rank"]).alias("_rank"))
            inside = inside | ((slot(finish) == last_slot) & (F.struct(finish.alias("_f"), F.col("_rank")) <= cut))
        return F.when(inside, F.col("size")).otherwise(F.lit(0))

    total = sum((taken(k) for k in range(1, repeats)), taken(0))
    return timed.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", total.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it. Rows of one id and size are taken alike."""
    taken = mix(docs, id_col, text_col, source_col, **options).where("taken > 0")
    own_id, own_size, many, copy = (common.fresh(docs, x) for x in ("id", "size", "copies", "copy"))
    counts = taken.groupBy(F.col(id_col).alias(own_id), F.col("size").alias(own_size)).agg(F.min((F.col("taken") / F.col("size")).cast("int")).alias(many))
    here = F.col(id_col).eqNullSafe(F.col(own_id)) & (common.words(F.col(text_col)) == F.col(own_size))
    joined = docs.join(counts, here).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many))))
    return joined.select(*(docs[c] for c in docs.columns))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM d GROUP BY source
), w AS (
  SELECT *, (CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, source_size::DOUBLE * 2 AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
  FROM s
), lv AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
            / sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM w
), f AS (
  SELECT *, cap <= lv * w AS is_full FROM lv
), t AS (
  SELECT source, rnk, source_size, budget,
         CASE WHEN is_full THEN cap ELSE least(cap, (SELECT lv FROM f WHERE NOT is_full ORDER BY cap / w, rnk LIMIT 1) * w) END AS target
  FROM f
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rnk, t.budget,
         sum(d.size) OVER (PARTITION BY t.rnk ORDER BY md5('mix:' || d.doc_id::VARCHAR), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT doc_id, rnk, size, budget, (cum + k.k * source_size)::DOUBLE / target AS f FROM c, (VALUES (0), (1)) AS k(k) WHERE size > 0
), g AS (
  SELECT doc_id, size, budget, sum(size) OVER (ORDER BY f, rnk ROWS UNBOUNDED PRECEDING) AS upto FROM e
), h AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM g WHERE upto <= budget GROUP BY doc_id
)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(h.taken, 0)::BIGINT AS taken
FROM c LEFT JOIN h ON c.doc_id = h.doc_id
"""
