"""Manifests of files of any size: digests of fixed-size blocks, joined into a tree by file.

A task reads some blocks, each by its place in its file, so a large file is read by many tasks and no file is one value.
The digests of up to FAN blocks in a row make a digest of the next level, and so on until a file has one, its root. The
root depends on the bytes and the block size only, and of two manifests the blocks that differ can be named.

Drivers and executors reach the folder by pyarrow, so it needs a scheme that pyarrow knows, such as file, hdfs or s3.

Defined cases: an empty file has one empty block; files are found in all folders below, and those whose name begins with
. or _ are left out, as readers do; an empty folder has an empty manifest.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, FAN = 8 << 20, 1024


def files_of(folder: str) -> list[tuple[str, int]]:
    """Files below a folder, by their path from there, and sizes. One entry a file reaches the driver."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    found = files.get_file_info(fs.FileSelector(base, recursive=True))
    named = [(f.path[len(base) :].lstrip("/"), f.size) for f in found if f.is_file]
    return sorted((n, s) for n, s in named if not any(part[0] in "._" for part in n.split("/")))


def whole_digests(spark: SparkSession, folder: str, piece: int = 1 << 20) -> DataFrame:
    """file, length, sha256 of each file as a whole, for formats that ask for that. A file is one task's, read in pieces."""
    listed = spark.createDataFrame(files_of(folder), "file string, size long").repartition("file")

    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = []
            for name in names:
                digest = hashlib.sha256()
                with files.open_input_stream(f"{base}/{name}") as opened:
                    while part := opened.read(piece):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], names=["file", "length", "sha256"])

    return listed.mapInArrow(run, "file string, length long, sha256 string")


def blocks(spark: SparkSession, folder: str, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """file, i, length, sha256 of each block, in as many tasks as asked (those of a shuffle by default)."""
    listed = spark.createDataFrame(files_of(folder), "file string, size long")
    last = F.greatest(F.ceil(F.col("size") / block) - 1, F.lit(0)).cast("long")
    each = listed.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    dealt = each.repartition(tasks, "file", "i") if tasks else each.repartition("file", "i")

    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            found = []
            for name, size, i in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_file(f"{base}/{name}") as opened:
                    part = opened.read_at(max(0, min(block, size - i * block)), i * block)
                found.append((name, i, len(part), hashlib.sha256(part).hexdigest()))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found) if found else [()] * 4, kinds)], names=["file", "i", "length", "sha256"])

    return dealt.mapInArrow(run, "file string, i long, length long, sha256 string")


def roots(found: DataFrame, most_blocks: int) -> DataFrame:
    """file, length, n_blocks, root of each file. most_blocks: of the largest file, it tells how many levels there are."""
    level = found.select("file", "i", "length", F.lit(1).cast("long").alias("n"), "sha256")
    while True:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "sha256"))), lambda x: x["sha256"]), "")  # FAN of them at most
        level = level.groupBy("file", F.floor(F.col("i") / FAN).alias("i")).agg(F.sum("length").alias("length"), F.sum("n").alias("n"), F.sha2(F.unhex(joined), 256).alias("sha256"))
        most_blocks = -(-most_blocks // FAN)
        if most_blocks <= 1:
            return level.select("file", "length", F.col("n").alias("n_blocks"), F.col("sha256").alias("root"))


def manifest(spark: SparkSession, folder: str, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """file, length, n_blocks, root of all files of a folder."""
    largest = max((size for _, size in files_of(folder)), default=0)
    return roots(blocks(spark, folder, block, tasks), -(-largest // block))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, i and what happened, of blocks that are new, gone or changed between two tables of blocks()."""
    a, b = old.select("file", "i", F.col("sha256").alias("_a")), new.select("file", "i", F.col("sha256").alias("_b"))
    both = a.join(b, ["file", "i"], "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select("file", "i", F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").otherwise("changed").alias("what"))
