"""A stored inverted index for BM25 ranking, which reads the query's terms only and stops at the top k.

Postings are dealt to buckets by term, one folder each, and within a term to blocks of DOCS documents in a row. A block's
row holds its postings and the largest share of a score that any of them can give. A search reads the folders of its
terms. Summed over the terms, the largest shares bound the scores of a block of documents; the blocks with the highest
bounds are scored first, and of the others only those whose bound reaches the k-th score found so far. So the top k is
exact, though most postings are not read.

A document's share depends on the mean size of all documents, which the index keeps. Scores and the order of equal ones
(smaller id first) are those of retrieval.bm25.

Defined cases: a null text has no word and counts among the documents, but not in their mean size; words shorter than `least`
characters are none; a null id is left out of the postings; an empty table, or a query of unknown words, gives nothing.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sinks.snapshots import Snapshots

DOCS, BUCKETS = 4096, 64
K1, B, LEAST = 1.5, 0.75, 3
POSTINGS = "term string, block long, df long, most double, postings array<struct<doc_id: long, tf: long, size: long>>"


def words(text: Column, least: int = LEAST) -> Column:
    """Words of a text: runs of letters, digits and _ of `least` or more characters, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) >= least)


def share(tf: Column, size: Column, mean_size: float) -> Column:
    """What a word of a document adds to a score, without the word's own weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_size))


@dataclass
class TextIndex:
    spark: SparkSession
    folder: str
    n_docs: int
    mean_size: float

    def weight(self, df: int) -> float:
        return math.log((self.n_docs - df + 0.5) / (df + 0.5) + 1)

    def read(self, terms: list[str]) -> DataFrame:
        """Blocks of these terms; the folders of other buckets are not listed for reading."""
        rows = self.spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{self.folder}/postings")
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term")).alias("b")).distinct()
        return rows.where(F.col("bucket").isin(*(r["b"] for r in asked.collect())) & F.col("term").isin(*terms))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
    """Writes an index of all documents to a folder.

    Texts are read and cut into words once: the counts of words by document, and the blocks, are tables in the folder
    `building`, which is removed at the end.
    """
    spark = docs.sparkSession
    counts = _written(_counts(docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w"))), f"{folder}/building/counts")
    every = counts.where("term is null")  # documents, by id and size
    total = every.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum(F.col("size") * F.col("tf")) / F.sum(F.when(F.col("size").isNotNull(), F.col("tf")))).alias("mean")).first()
    mean = total["mean"] or 1.0
    tf = counts.where("term is not null and doc_id is not null")
    block = F.floor(F.col("doc_id") / DOCS).alias("block")
    found = tf.groupBy("term", block).agg(F.count(F.lit(1)).alias("n"), F.max(share(F.col("tf"), F.col("size"), mean)).alias("most"), F.sort_array(F.collect_list(F.struct("doc_id", "tf", "size"))).alias("postings"))  # DOCS of them at most
    found = _written(found, f"{folder}/building/blocks")
    df = found.groupBy("term").agg(F.sum("n").alias("df"))
    rows = found.join(df, "term").select("term", "block", "df", "most", "postings", bucket_of(F.col("term")).alias("bucket"))
    rows.repartition("bucket", F.pmod(F.xxhash64("term", "block"), F.lit(8))).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{folder}/postings")
    Snapshots(spark, folder).write_text("totals", json.dumps({"n_docs": total["n"], "mean_size": mean}))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/building")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return TextIndex(spark, folder, total["n"], mean)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counts(sized: DataFrame) -> DataFrame:
    """doc_id, size, term, tf of each word of each document, and of the null term, which each row of the documents has once."""
    none = F.array(F.lit(None).cast("string"))
    size = F.when(F.col("w").isNotNull(), F.size("w")).cast("long")
    each = sized.select("doc_id", size.alias("size"), F.explode(F.concat(none, F.coalesce("w", F.array().cast("array<string>")))).alias("term"))
    return each.groupBy("doc_id", "size", "term").agg(F.count(F.lit(1)).alias("tf"))


def load(spark: SparkSession, folder: str) -> TextIndex:
    total = json.loads(Snapshots(spark, folder).read_text("totals"))
    return TextIndex(spark, folder, total["n_docs"], total["mean_size"])


class Query:
    """A query against an index: the blocks of its words, the bounds of blocks of documents, and exact scores."""

    def __init__(self, index: TextIndex, text: str):
        self.index = index
        asked = sorted({w for w in re.findall(r"\w+", text.lower()) if len(w) >= LEAST})
        self.rows = index.read(asked) if asked else None
        # A row for each word of the query.
        self.df = {r["term"]: r["df"] for r in self.rows.groupBy("term").agg(F.max("df").alias("df")).collect()} if asked else {}
        if self.df:
            self.weight = F.element_at(F.create_map(*(F.lit(x) for t, n in self.df.items() for x in (t, index.weight(n)))), F.col("term"))

    def bounds(self) -> DataFrame:
        """block and the highest score that a document of it can have; reads no postings."""
        return self.rows.groupBy("block").agg(F.sum(self.weight * F.col("most")).alias("bound"))

    def scores(self, blocks: DataFrame) -> DataFrame:
        own = self.rows.join(blocks.select("block"), "block", "left_semi").select(self.weight.alias("w"), F.explode("postings").alias("p"))
        part = F.col("w") * share(F.col("p.tf"), F.col("p.size"), self.index.mean_size)
        return own.groupBy("p.doc_id").agg(F.sum(part).alias("score")).where("score > 0")

    def open_blocks(self, k: int, first_blocks: int) -> DataFrame:
        """The blocks that can hold one of the k best documents: the bound reaches the k-th score of the blocks with the highest ones."""
        bounds = self.bounds()
        top = self.scores(bounds.orderBy(F.desc("bound"), "block").limit(first_blocks)).orderBy(F.desc("score"), "doc_id").limit(k).collect()
        # Sums of doubles may differ in their last bits, so a bound counts as a little larger.
        return bounds.where(F.col("bound") * (1 + 1e-9) >= (top[-1]["score"] if len(top) == k else 0.0))


def search(index: TextIndex, text: str, k: int = 10, first_blocks: int = 8) -> DataFrame:
    """rank, doc_id, score of the k best documents of a query."""
    query = Query(index, text)
    if not query.df:
        return index.spark.createDataFrame([], "rank int, doc_id long, score double")
    found = query.scores(query.open_blocks(k, first_blocks)).orderBy(F.desc("score"), "doc_id").limit(k)
    listed = found.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("l"))  # k of them at most
    return listed.select(F.posexplode("l").alias("i", "x")).select((F.col("i") + 1).alias("rank"), "x.doc_id", (-F.col("x.s")).alias("score"))
