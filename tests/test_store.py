import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import retrieval as R, text_index as TI
from tidemark.sinks import manifests as M


@pytest.fixture
def folder(tmp_path):
    r = random.Random(1)
    os.makedirs(tmp_path / "f" / "deep")
    for name, size in (("a.bin", 100_000), ("deep/b.bin", 12_345), ("empty", 0), ("exact", 4000), ("_SUCCESS", 3), (".hidden", 3)):
        (tmp_path / "f" / name).write_bytes(r.randbytes(size))
    return tmp_path / "f"


def plain_root(data, block, fan):
    level = [hashlib.sha256(data[i : i + block]).digest() for i in range(0, max(1, len(data)), block)]
    n = len(level)
    while True:
        level = [hashlib.sha256(b"".join(level[i : i + fan])).digest() for i in range(0, len(level), fan)]
        if -(-n // fan) <= 1:
            return level[0].hex()
        n = -(-n // fan)


@pytest.mark.parametrize("fan", [1024, 3])
def test_roots_depend_on_bytes_only(spark, folder, monkeypatch, fan):
    monkeypatch.setattr(M, "FAN", fan)
    found = [{r["file"]: tuple(r)[1:] for r in M.manifest(spark, str(folder), 1000, tasks).collect()} for tasks in (1, 7, None)]
    assert found[0] == found[1] == found[2] and set(found[0]) == {"a.bin", "deep/b.bin", "empty", "exact"}
    largest = -(-100_000 // 1000)
    for name, (length, n_blocks, root) in found[0].items():
        data = (folder / name).read_bytes()
        assert (length, n_blocks) == (len(data), max(1, -(-len(data) // 1000)))
        if fan == 1024 or n_blocks == largest:
            assert root == plain_root(data, 1000, fan)


def test_changed_blocks_are_named(spark, folder):
    before = M.blocks(spark, str(folder), 1000).cache()
    assert before.count() == 100 + 13 + 1 + 4
    data = bytearray((folder / "a.bin").read_bytes())
    data[41_234] ^= 1
    (folder / "a.bin").write_bytes(data + b"more")
    (folder / "new").write_bytes(b"x")
    os.remove(folder / "exact")
    found = sorted(tuple(r) for r in M.differences(before, M.blocks(spark, str(folder), 1000)).collect())
    assert found == [("a.bin", 41, "changed"), ("a.bin", 100, "new"), *(("exact", i, "gone") for i in range(4)), ("new", 0, "new")]
    os.makedirs(folder / "none")
    assert M.manifest(spark, str(folder / "none")).count() == 0


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Few documents hold the rare words; frequent ones are in all blocks."""
    r = random.Random(8)
    held, TI.DOCS = TI.DOCS, 16
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "of", "delta_1", "Ñandú"] + ["rare", "seldom"] * (i % 37 == 0)) for _ in range(r.randint(1, 60)))) for i in range(600)]
    rows += [(700, None), (701, ""), (None, "alpha rare"), (702, "rare " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    folder = str(tmp_path_factory.mktemp("index"))
    TI.build(docs, folder)
    yield docs, TI.load(spark, folder)
    TI.DOCS = held


@pytest.mark.parametrize("query, k", [("rare seldom", 5), ("alpha beta RARE", 12), ("ñandú", 700), ("delta_1 unknown", 3), ("alpha", 1)])
def test_top_k_is_that_of_all_scores(index, query, k):
    docs, own = index
    want = [(r["doc_id"], round(r["score"], 9)) for r in R.bm25(docs, query).where("doc_id is not null").orderBy(F.desc(F.round("score", 12)), "doc_id").limit(k).collect()]
    if "alpha" in query or "rare" in query.lower():  # the row without an id is no posting, which moves the words' weights a little
        docs = docs.withColumn("text", F.when(F.col("doc_id").isNotNull(), F.col("text")))
        want = [r["doc_id"] for r in R.bm25(docs, query).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k).collect()]
        assert [r["doc_id"] for r in TI.search(own, query, k, 2).orderBy("rank").collect()] == want
    else:
        assert [(r["doc_id"], round(r["score"], 9)) for r in TI.search(own, query, k, 2).orderBy("rank").collect()] == want


def test_a_query_reads_its_buckets_and_blocks(spark, index):
    _, own = index
    query = TI.Query(own, "rare seldom")
    files = [r[0] for r in query.rows.select(F.input_file_name()).distinct().collect()]
    wanted = {r["b"] for r in spark.createDataFrame([("rare",), ("seldom",)], "t string").select(TI.bucket_of(F.col("t")).alias("b")).collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} == wanted
    every, some = TI.Query(own, "alpha rare").bounds().count(), TI.Query(own, "alpha rare").open_blocks(3, 8).count()
    assert some < every / 2
    plan = query.bounds()._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan.split("ReadSchema")[1]
    assert TI.search(own, "of an", 5).count() == 0 and TI.search(own, "unknown", 5).count() == 0
