"""Exact deduplication that stays safe when one text makes up a large share of the rows.

Three merges, each grouping by the digest and the full normalised text:

1. locally, in each task before its shuffle (Spark's partial aggregate over the grouping key);
2. among rows of one digest and one salt, so that a text with a third of all rows is spread over `salts` groups;
3. among the winners of the salts, at most `salts` rows a text.

In all of them equal digests with unequal texts stay apart. Only ids, digests and counts travel back to the rows, which
find their group by SHA-256 and length: texts don't move a second time.

Defined cases: a null text is empty; a text of white space only equals one space, not the empty text; a null id is
larger than any id; of rows that repeat both id and text one stays; a text of any length is compared whole; an empty table
gives an empty result; other columns stay as they are in keep_first(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

SALTS = 16


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(common.whole(text), common.SPACE + "+", " ")


def salt_of(salts: int) -> Column:
    """A number below `salts` for each row, by its place: null and repeated ids spread as well. Any deal gives the same groups."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(salts))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: _digest, _length, keep_id, group_size."""
    rows = docs.select(
        F.col(id_col).alias("_id"),
        normalised(text_col).alias("_norm"),
        salt_of(salts).alias("_salt"),
    ).withColumn("_digest", F.unhex(F.sha2("_norm", 256)))
    salted = rows.groupBy("_digest", "_salt", "_norm").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    merged = salted.groupBy("_digest", "_norm").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    return merged.select("_digest", F.octet_length("_norm").alias("_length"), "keep_id", "group_size")


def _named(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """One row per row of docs: _id, _digest, _length, keep_id, group_size, kept. Of rows that repeat id and text one is kept."""
    repeated = groups(docs, id_col, text_col, salts).where("group_size > 1")
    spread = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        normalised(text_col).alias("_norm"),
        salt_of(salts).alias("_salt"),
    ).select("_id", "_salt", F.unhex(F.sha2("_norm", 256)).alias("_digest"), F.octet_length("_norm").alias("_length"))
    same = Window.partitionBy("_digest", "_length", "_id").orderBy("_salt")
    return (
        rows.join(spread, ["_digest", "_length", "_salt"], "left")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")))
        .withColumn("_first", F.row_number().over(same) == 1)
        .select(
            "_id", "_digest", "_length", "keep_id",
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("_id").eqNullSafe(F.col("keep_id")) & F.col("_first")).alias("kept"),
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    return _named(docs, id_col, text_col, salts).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each normalised text, whatever ids repeat or are null.

    It is a row with the smallest id. A row is found by its id, digest and length; where several rows of the smallest id
    hold the text, any one of them stays, so their other columns don't count.
    """
    digest, length, keep = (common.fresh(docs, x) for x in ("digest", "length", "keep"))
    named = common.stored(_named(docs, id_col, text_col, salts).where(F.col("_id").eqNullSafe(F.col("keep_id"))).select("_id", "_digest", "_length", "kept"), "first-copies")
    norm = common.fresh(docs, "norm")
    marked = docs.withColumn(norm, normalised(text_col)).withColumns({digest: F.unhex(F.sha2(norm, 256)), length: F.octet_length(norm)}).drop(norm)
    of = lambda rows: rows.select(F.col("_id").alias(keep), F.col("_digest").alias("_d"), F.col("_length").alias("_l"))
    on = F.col(id_col).eqNullSafe(F.col(keep)) & (F.col(digest) == F.col("_d")) & (F.col(length) == F.col("_l"))
    found = marked.join(of(named.where("kept")), on, "left_semi")
    several = of(named.where("not kept")).distinct()
    if not several.isEmpty():
        # Equal rows of one id: tasks keep one each, then salts, so that no group of them meets in one task.
        columns = [F.col(f"`{c}`") for c in docs.columns]
        salt = common.fresh(docs, "salt")
        again = found.join(several, on, "left_semi").withColumn(salt, salt_of(salts))
        one = again.groupBy(id_col, digest, length, salt).agg(F.first(F.struct(*columns)).alias("_row")).groupBy(id_col, digest, length).agg(F.first("_row").alias("_row"))
        found = found.join(several, on, "left_anti").drop(digest, length).unionByName(one.select("_row.*"))
    return found.select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
