"""Copies of any ids, words of 100,000 characters and texts of a million code points."""

import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.test_arrow import encoding
from tidemark.llm import bpe, exact_dedup, fertility, jaccard, langid, spans, token_counts, token_files


def test_one_row_of_each_text_stays(spark):
    rows = [(3, "b b"), (5, "a a"), (5, "b b"), (7, "c c"), (7, "c c"), (None, "n n"), (None, "b b"), (None, "n  n"), (5, "a\ta"), (9, None), (8, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _digest int").repartition(3)
    kept = sorted(((r["doc_id"], " ".join((r["text"] or "").split())) for r in exact_dedup.keep_first(docs).collect()), key=str)
    assert kept == sorted([(3, "b b"), (5, "a a"), (7, "c c"), (None, "n n"), (8, "")], key=str)
    assert exact_dedup.keep_first(docs).columns == docs.columns
    marked = exact_dedup.exact_dedup(docs).where("kept").select("doc_id").collect()
    assert sorted(str(r["doc_id"]) for r in marked) == sorted(str(k) for k, _ in kept)


def test_one_of_many_equal_rows_stays(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 < 2, "same text").otherwise(F.col("id").cast("string")).alias("text"), F.lit("x").alias("source"))
    found = exact_dedup.keep_first(docs)
    assert found.where("text = 'same text'").collect()[0]["doc_id"] == 0 and found.count() == 1001
    assert exact_dedup.keep_first(docs.where("doc_id is null")).count() == 1001


def held_bytes(table):
    return sum(x.items.nbytes for x in (table.flat, table.points, table.id_at, table.n_ids, table.point_at, table.n_points)) + table.keys.nbytes + table.slots.nbytes


def test_the_table_of_spans_is_bounded_in_bytes():
    r = random.Random(3)
    calls = []
    table = spans.Resolved(lambda texts: (calls.append(len(texts)), spans.listed([[len(t), ord(t[0])] for t in texts]))[1])
    for i in range(60):
        words = ["".join(r.choice("abcdefgh") for _ in range(8)) * r.choice([12_500, 125, 1]) for _ in range(20)] + ["ab", f"w{i}"]
        points, _ = spans.joined([" ".join(words)])
        starts, ends = spans.words(points)
        ids, sizes = table.ids(points, starts, ends)
        assert ids.tolist() == [x for w in words for x in (len(w), ord(w[0]))] and sizes.tolist() == [2] * len(words)
        assert held_bytes(table) < 80e6
    small = spans.Resolved(lambda texts: spans.listed([[len(t)] for t in texts]), most_points=60)
    for _ in range(3):
        points, _ = spans.joined(["aaaa bbbbbbbb cc aaaa", "dddddddddddddddddddddddd eeeeeeeeeeeeeeeee"])
        assert small.ids(points, *spans.words(points))[0].tolist() == [4, 8, 2, 4, 24, 17]
        assert small.points.used <= 60


@pytest.fixture(scope="module")
def large(spark):
    """Texts of a million code points, one with a word changed, and long words."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randint(1, 9))) for _ in range(170_000)]
    text = " ".join(words)
    near = " ".join([*words[:80_000], "other", *words[80_001:]])
    long_words = " ".join("".join(r.choice("0123456789abcdef+/") for _ in range(100_000)) for _ in range(3))
    assert len(text) > 900_000
    return spark.createDataFrame([(1, text, "en", "a"), (2, near, "en", "a"), (3, long_words + " and some words", "de", "a"), (4, "und das ist der kurze text", "de", "b"), (5, text[:1_000] + "!", "en", "b")], "doc_id long, text string, lang string, source string")


def test_large_texts_are_encoded_whole(spark, large, tmp_path):
    public: tiktoken.Encoding = encoding()
    want = {r["doc_id"]: public.encode_ordinary(r["text"]) for r in large.where("doc_id <> 3").collect()}
    found = {r["doc_id"]: r for r in bpe.encode_decode(large.select("doc_id", "text")).collect()}
    assert all(found[i]["ids"] == ids for i, ids in want.items())
    for r in large.collect():
        assert found[r["doc_id"]]["decoded"].decode() == r["text"]
    counts = token_counts.counted(large).agg(F.sum("n_bpe")).first()[0]
    assert counts == sum(r["n_tokens"] for r in found.values())
    folder = str(tmp_path / "files")
    files = token_files.read_token_files(token_files.write_token_files(large.select("doc_id", "text"), folder, sequence=512, per_batch=16), folder)
    assert {r["doc_id"]: r["n_tokens"] for r in files.collect()} == {i: r["n_tokens"] + 1 for i, r in found.items()}


def test_large_texts_are_measured_compared_and_named(large):
    sizes = {r["doc_id"]: len(r["text"].split()) for r in large.collect()}
    measured = {r["doc_id"]: r for r in fertility.judged(fertility.measures(large)).collect()}
    assert {i: m["n_words"] for i, m in measured.items()} == sizes
    comps = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(large).collect()}
    assert comps == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    named = {r["doc_id"]: r["lang_pred"] for r in langid.identify(large, langid.learn(large)).collect()}
    assert named[1] == named[2] == named[5] == "en"


def test_of_two_writers_of_a_batch_one_wins(spark, tmp_path):
    import threading

    schema = "source string, lang string, tokenizer_version string, change string, n_tokens long, old_tokens long"
    won, folder = [], str(tmp_path / "rollup")

    def work(n):
        own = token_counts.Rollup(spark, folder)
        own.committed = lambda batch: False  # both are past the check
        won.append(own.commit("x", spark.createDataFrame([("s", "en", "v", "insert", n, None)], schema)))

    threads = [threading.Thread(target=work, args=(n,)) for n in (1, 10, 100)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    total = token_counts.Rollup(spark, folder).totals().collect()
    assert sorted(won) == [False, False, True] and len(total) == 1 and total[0]["docs"] == 1 and total[0]["tokens"] in (1, 10, 100)
    assert sorted(p.name for p in (tmp_path / "rollup").iterdir()) == ["batch=x"] and not list((tmp_path / "rollup" / "batch=x").glob("attempt=*"))
