"""Token counts by source, language and tokenizer version, maintained by deltas.

Each batch of changes becomes signed sums: an insert adds a document and its tokens, a delete takes them away, a revised
count adds the difference. Sums are additive, so totals are the sum over committed batches. A batch is written to a folder
of the attempt, which becomes the batch's by one rename: of two writers of one id one wins, and the other's folder goes.
Committing an id that is there changes nothing, and what a broken attempt left is in no total. compact() folds all batches into one snapshot, whose table remembers their ids, a row for each,
and then removes their folders; one that broke off after its snapshot counts no batch twice.

Defined cases: a null source, language or version is a group of its own; a change of unknown kind, or with a null count,
raises; rows that repeat are changes of their own; a group whose documents and tokens come back to 0 leaves the totals;
without batches the totals are empty, and an empty batch adds nothing; other columns of a batch are not read; columns of
documents stay in counted(), but for the text and those with the name of a count, which is put in their place.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe, common, spans

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = "source string, lang string, tokenizer_version string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Signed sums of changes: change (insert, delete, revise), the keys, n_tokens, old_tokens (for revise)."""
    unknown = F.raise_error(F.concat(F.lit("unknown change or null count: "), F.coalesce("change", F.lit("null"))))
    docs = F.when(F.col("change") == "insert", 1).when(F.col("change") == "delete", -1).when(F.col("change") == "revise", 0).otherwise(unknown.cast("int"))
    tokens = F.when(F.col("change") == "revise", F.col("n_tokens") - F.col("old_tokens")).otherwise(docs * F.col("n_tokens"))
    sums = changes.groupBy(*KEYS).agg(F.sum(docs).alias("docs"), F.sum(F.coalesce(tokens, unknown.cast("long"))).alias("tokens"))
    return sums.select(*KEYS, F.col("docs").cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, kind: str) -> list[str]:
        """Names of the folders of a kind that have their marker, in order."""
        files = self._files("")
        if not files.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._path(""))]
        marker = "sums/_SUCCESS" if kind == "snapshot=" else "_SUCCESS"
        return sorted(n for n in names if n.startswith(kind) and files.exists(self._path(f"{n}/{marker}")))

    def _folded(self) -> DataFrame | None:
        """batch: the ids in the last snapshot."""
        names = self._complete("snapshot=")
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/{names[-1]}/batches") if names else None

    def _open(self) -> list[str]:
        """Folders of committed batches that the last snapshot lacks. Reads the ids of folders that are there."""
        names = self._complete("batch=")
        folded = self._folded()
        if not names or folded is None:
            return names
        ids = {unquote(n.removeprefix("batch=")): n for n in names}
        return sorted(set(names) - {ids[r["batch"]] for r in folded.where(F.col("batch").isin(list(ids))).distinct().collect()})

    def committed(self, batch: str) -> bool:
        if self._files("").exists(self._path(f"batch={quote(batch, safe='')}/_SUCCESS")):
            return True
        folded = self._folded()
        return folded is not None and not folded.where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch once; False if it was there already."""
        if self.committed(batch):
            return False
        token, target = uuid.uuid4().hex, f"batch={quote(batch, safe='')}"
        draft, files = f"attempt={token}", self._files("")
        signed(changes).write.parquet(f"{self.folder}/{draft}")
        files.create(self._path(f"{draft}/_{token}")).close()
        if files.exists(self._path(target)) and not files.exists(self._path(f"{target}/_SUCCESS")):
            files.delete(self._path(target), True)
        files.rename(self._path(draft), self._path(target))
        if files.exists(self._path(f"{target}/_{token}")):
            return True
        # Another writer was first; a rename onto its folder fails or moves the attempt into it.
        for left in (draft, f"{target}/{draft}"):
            files.delete(self._path(left), True)
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens."""
        paths = [f"{self.folder}/{n}" for n in self._open()] + [f"{self.folder}/{n}/sums" for n in self._complete("snapshot=")[-1:]]
        if not paths:
            return self.spark.createDataFrame([], SUMS)
        sums = self.spark.read.schema(SUMS).parquet(*paths).groupBy(*KEYS)
        return sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """A snapshot of all committed batches; its sums are written last and complete it, and what it folded is removed."""
        before, folders = self._complete("snapshot="), self._open()
        name = f"snapshot={int(before[-1].removeprefix('snapshot=')) + 1 if before else 0:09d}"
        ids = self.spark.createDataFrame([(unquote(n.removeprefix("batch=")),) for n in folders], "batch string")
        folded = self._folded()
        (ids if folded is None else folded.unionByName(ids)).write.mode("overwrite").parquet(f"{self.folder}/{name}/batches")
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/{name}/sums")
        for old in (*self._complete("batch="), *before):
            if old in before or old in folders:
                self._files("").delete(self._path(old), True)


def counted(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs without the text, with n_words, n_bpe and n_bpe_normalised: the count after white space is made single."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(bpe.read_bytes(vocabulary or bpe.default_vocabulary()))
    added = ["n_words", "n_bpe", "n_bpe_normalised"]
    keep = [c for c in docs.columns if c not in (text_col, *added)]

    def run(batches):
        resolved = bpe._encoder(ranks.value).resolved
        for batch in batches:
            at = 0
            for some in spans.chunks(spans.strings(batch.column(text_col))):
                found = []
                normal = [" ".join(b.decode() for b in t.encode().split()) for t in some]
                for each in (some, normal):
                    points, text_ends = spans.joined(each)
                    starts, ends = spans.pretokens(points)
                    _, size = resolved.ids(points, starts, ends)
                    upto = np.concatenate(([0], np.cumsum(size)))[spans.per_text(starts, text_ends)]
                    found.append(pa.array(np.diff(upto, prepend=0), pa.int64()))
                n_words = pa.array([t.count(" ") + 1 if t else 0 for t in normal], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(some)) for c in keep), n_words, *found], names=[*keep, *added])
                at += len(some)

    return docs.select(*keep, text_col).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in added]))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents, two of them sent twice.

    Both versions count every document; the vocabulary's counts are revised to those of normalised white space; then
    documents of under 20 words are deleted from both.
    """
    docs = common.stored(counted(common.documents(spark, sf_dir).select("source", "lang", "text")), "token-counts")
    by_words = docs.select("source", "lang", F.lit("words-1").alias("tokenizer_version"), F.col("n_words").alias("n_tokens"), F.col("n_words").alias("old_tokens"), "n_words")
    by_bpe = docs.select("source", "lang", F.lit("byte_bpe_50k").alias("tokenizer_version"), F.col("n_bpe_normalised").alias("n_tokens"), F.col("n_bpe").alias("old_tokens"), "n_words")
    rollup = Rollup(spark, common.new_folder(spark, "token-rollup"))
    inserted = by_words.unionByName(by_bpe).select(*KEYS, F.lit("insert").alias("change"), F.col("old_tokens").alias("n_tokens"), F.lit(None).cast("long").alias("old_tokens"))
    revised = by_bpe.select(*KEYS, F.lit("revise").alias("change"), "n_tokens", "old_tokens")
    deleted = by_words.unionByName(by_bpe).where("n_words < 20").select(*KEYS, F.lit("delete").alias("change"), "n_tokens", F.lit(None).cast("long").alias("old_tokens"))
    for batch, changes in (("1-insert", inserted), ("2-revise", revised), ("1-insert", inserted), ("3-delete", deleted), ("2-revise", revised)):
        rollup.commit(batch, changes)
    return rollup.totals()
