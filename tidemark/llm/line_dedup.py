"""Drop lines that many documents share.

Lines are exploded with their positions and hashed by their keys; distinct documents are counted per hash; hashes over
the threshold meet the exploded lines again and give each document the positions to drop, between which its text is put
together again by position. Counting is two partial aggregates: (key, document) first, whose groups hold one document,
then key. Shared keys are few, as each is in many lines; up to BROADCAST_ROWS of them are broadcast, more meet the lines
by a join whose keys are salted, as a third of all documents may hold one. The texts move once, by document.

Defined cases: a null or empty text is one empty line; keys without a code point never count; rows that repeat an id
count as one document, and each keeps its own lines; all null ids are one document; an empty table gives an empty
result; work is linear in the lines of a document, however long; columns of docs stay as they are, but for those with
the name of an added one, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

MIN_DOCS = 10
SALTS = 16
#: Shared hashes, of 16 bytes, that a broadcast holds at most.
BROADCAST_ROWS = 500_000


def line_key(line: Column) -> Column:
    stripped = F.trim(line, F.lit(common.SPACE_CHARS))
    # lower() folds more than A-Z, but not in a line of ASCII, and is much faster there.
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, common.UPPER, common.UPPER.lower()))


def lines(text_col: str = "text") -> Column:
    return F.split(common.whole(text_col), "\n", -1)


def row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows of one id and text only, and the same in every attempt of a task."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("id "), F.col(id_col).cast("string")), F.lit("null")), F.lit(":"), common.whole(text_col))))


def exploded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _row, _pos and _h, 128 bits of the key, for each line whose key has a code point."""
    each = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_row"), F.posexplode(lines(text_col)).alias("_pos", "_line"))
    return each.select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key")).where("_key <> ''").select("_id", "_row", "_pos", F.unhex(F.md5("_key")).alias("_h"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """_row and _drop, the sorted positions of its lines that at least min_docs documents hold, for rows with any."""
    every = common.stored(exploded(docs, id_col, text_col), "lines")
    held = every.groupBy("_h", "_id").agg(F.lit(1).alias("_one"))
    shared = common.stored(held.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs).select("_h"), "shared-lines")
    if shared.count() <= broadcast_rows:
        hits = every.join(F.broadcast(shared), "_h")
    else:
        spread = shared.select("_h", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
        hits = every.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int")).join(spread, ["_h", "_salt"])
    return hits.groupBy("_row").agg(F.array_sort(F.collect_set("_pos")).alias("_drop"))


def between(every: Column, drop: Column) -> Column:
    """The items of an array but those at the sorted places of drop."""

    def pieces(x: Column) -> Column:
        items, cuts = x["items"], x["cuts"]
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda i: F.slice(items, cuts[i] + 2, cuts[i + 1] - cuts[i] - 1)))

    cuts = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(every)))
    # Within transform() the arrays are made once, not for each piece.
    return F.element_at(F.transform(F.array(F.struct(every.alias("items"), cuts.alias("cuts"))), pieces), 1)


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, broadcast_rows: int = BROADCAST_ROWS, lines_col: str = "_lines", kept_col: str = "_kept") -> DataFrame:
    """docs with the number of lines before, and the array of lines that stay in their order."""
    row, drop = common.fresh(docs, "row"), common.fresh(docs, "drop")
    hit = dropped_lines(docs, min_docs, id_col, text_col, salts, broadcast_rows).select(F.col("_row").alias(row), F.col("_drop").alias(drop))
    joined = docs.withColumn(row, row_key(id_col, text_col)).join(hit, row, "left")
    keep = [c for c in docs.columns if c.lower() not in (lines_col.lower(), kept_col.lower())]
    return joined.select(
        *keep,
        F.size(lines(text_col)).cast("long").alias(lines_col),
        F.when(F.col(drop).isNull(), lines(text_col)).otherwise(between(lines(text_col), F.col(drop))).alias(kept_col),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return drop_common_lines(docs).select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        (F.col("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), hot AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key
GROUP BY k.doc_id
"""
