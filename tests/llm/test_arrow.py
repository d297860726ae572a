import base64
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, components, fertility, jaccard, langid, spans, token_counts, token_files

ALPHABET = "ab sretvlmd'' \n\t\r 0189²!?#é ñ漢字 😀 　\x1c\x85\x00"


def noise(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_spans_are_the_matches_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    texts = noise(3000) + ["", "'s", "'", "a'll've  'd"]
    points, _ = spans.joined(texts)
    assert [spans.text_of(points, a, b) for a, b in zip(*spans.pretokens(points))] == [w for t in texts for w in pattern.findall(t)]
    assert [spans.text_of(points, a, b).encode() for a, b in zip(*spans.words(points))] == [w for t in texts for w in t.encode().split()]


def test_hash_depends_on_content_only():
    points, _ = spans.joined(["abc xx abc", "abc", "acb"])
    h = spans.hashes(points, *spans.words(points))
    assert h[0] == h[2] == h[3] and len(set(h.tolist())) == 3


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_public_encoder_and_round_trips(corpus, empty):
    own, public = bpe.Encoder(bpe.read_bytes(bpe.default_vocabulary())), encoding()
    texts = [t.replace("\x1c", "") for t in noise(500)] + [r["text"] or "" for r in corpus.collect()]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == public.encode_ordinary(text)
        assert own.decode(ids.tolist()) == text.encode()
    assert own.tier.get(b"\xff\xfe not there") == -1
    found = bpe.encode_decode(corpus).collect()
    assert len(found) == corpus.count()
    assert all(r["decoded"].decode() == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in found)
    assert bpe.encode_decode(empty).count() == 0


def test_fertility_counts(corpus, empty):
    found = {r["doc_id"]: r for r in fertility.judged(fertility.measures(corpus)).collect()}
    assert fertility.measures(corpus).count() == corpus.count()
    for r in corpus.where("doc_id is not null").collect():
        text = r["text"] or ""
        words, m = text.encode().split(), found[r["doc_id"]]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
        assert (m["n_words"], m["n_repeat_words"]) == (len(words), len(covered))
        assert m["word_chars"] == sum(len(w.decode()) for w in words)
        assert m["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (m["base_failed"] and m["kept"])
    assert fertility.measures(empty).count() == 0


def test_repeated_windows_stay_within_a_text():
    half = "a b c d e f g h"
    splitter = fertility.Splitter(open(fertility.default_vocabulary(), "rb").read())
    found = fertility.measure([half, half, half + " " + half, "x\nx\n\n\nx y\nx"], splitter)
    assert found["n_repeat_words"].tolist() == [0, 0, 16, 0]
    assert found["n_dup_lines"].tolist() == [0, 0, 0, 2]


def test_token_files_round_trip(spark, corpus, empty, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_files.default_vocabulary())
    model.encode_special_tokens = True
    docs = corpus.where("doc_id is not null").dropDuplicates(["doc_id"])
    folder = str(tmp_path / "files")
    manifest = token_files.write_token_files(docs, folder, sequence=64, per_batch=4)
    found = {r["doc_id"]: r for r in token_files.read_token_files(manifest, folder).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*model.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        assert (found[r["doc_id"]]["start"], found[r["doc_id"]]["n_tokens"]) == (start, len(ids))
        assert found[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = manifest.orderBy("part").first()
    from pyarrow import fs

    file = token_files.TokenFile(one["file"], 64, 4, fs.LocalFileSystem())
    whole = file.ids(0, one["n_ids"])
    assert len(whole) == one["n_ids"] == file.n_masked()
    assert file.ids(130, 300).tolist() == whole[130:430].tolist()
    other = str(tmp_path / "none")
    assert token_files.read_token_files(token_files.write_token_files(empty, other), other).count() == 0


def test_token_files_give_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    model, mark = Tokenizer.from_file(token_files.default_vocabulary()), "<|endoftext|>"
    texts = [f"x {mark} y", mark, f"{mark}{mark}  \n", f"a  {mark}\t b'{mark}ll <|endoftext>", None, "", "plain  text"]
    folder = str(tmp_path / "files")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = token_files.read_token_files(token_files.write_token_files(df, folder, sequence=8, per_batch=2), folder).orderBy("doc_id").collect()
    want = [[*model.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert want[0] == [87, 220, 50256, 331, 0]
    assert [r["n_tokens"] for r in found] == [len(x) for x in want]
    assert [r["start"] for r in found] == [sum(map(len, want[:i])) for i in range(len(want))]
    assert [r["ids_crc32"] for r in found] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


def sets_of(text):
    w = [a.lower() for a in (text or "").encode().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(docs):
    parent = {r["doc_id"]: r["doc_id"] for r in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = [(r["doc_id"], sets_of(r["text"])) for r in docs]
    for i, (a, x) in enumerate(held):
        for b, y in held[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {a: (find(a), len(x)) for a, x in held}


def test_jaccard_components_equal_all_pairs(corpus, empty):
    docs = [r for r in corpus.collect() if r["doc_id"] is not None]
    want = plain_components(docs)
    found = jaccard.near_duplicates(corpus).collect()
    assert len(found) == corpus.count()
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["component_id"], r["n_shingles"]) == want[r["doc_id"]]
    assert len({c for c, _ in want.values()}) < len(want) - 10
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_with_hot_ngrams_and_far_copies(spark, monkeypatch):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(60)] = word()
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(passage + [word() for _ in range(r.randint(5, 40))])) for i in range(150)]
    monkeypatch.setattr(jaccard, "HOT_LEAST", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(df).collect()}
    want = plain_components([{"doc_id": i, "text": t} for i, t in rows])
    assert found == {k: c for k, (c, _) in want.items()}


def test_jaccard_of_more_short_texts_in_a_task_than_16_bits_number(spark):
    # Six Arrow batches hold 59,999 distinct texts, the seventh 10,000 more; copies are the last ten pairs.
    n, pairs = 70_000, 10
    ten = F.concat_ws(" ", *(F.concat(F.lit(f"{c}x"), F.floor(F.col("id") / 2).cast("string")) for c in "abcdefghij"))
    short = F.when(F.col("id") == 1, "t0").otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
    text = F.when(F.col("id") < n - 2 * pairs, short).otherwise(F.concat(ten, F.when(F.col("id") % 2 == 1, " more").otherwise("")))
    df = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).where("component_id <> doc_id").collect()}
    assert found == {1: 0, **{i: i - 1 for i in range(n - 2 * pairs + 1, n, 2)}}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7)]
    random.Random(2).shuffle(edges)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_planes_round_trip():
    x = np.array([1, 1 << 40, 5, (1 << 64) - 1], np.uint64)
    assert jaccard.numbers(jaccard.planes(x), np.uint64).tolist() == x.tolist()


def test_language_of_held_out_documents(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs.where(langid.held_out()), profiles).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "é")], "doc_id long, text string")
    odd_found = {r["doc_id"]: r for r in langid.identify(odd, profiles).collect()}
    assert all(odd_found[i]["lang_pred"] == "und" and odd_found[i]["score"] == 0 for i in (1, 2, 3))
    assert odd_found[4]["lang_pred"] in profiles.names
    assert langid.identify(odd, langid.learn(empty)).where("lang_pred <> 'und'").count() == 0
    assert "score" in langid.accepted(spark.createDataFrame([(1, "the of", 0.5)], "doc_id long, text string, score double"), profiles).columns


def test_token_counts_by_deltas(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    schema = "source string, lang string, tokenizer_version string, change string, n_tokens long, old_tokens long"
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    totals = lambda: {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    assert totals() == {}
    first = batch(("a", "en", "v", "insert", 10, None), ("a", "en", "v", "insert", 5, None), (None, "en", "v", "insert", 7, None))
    assert rollup.commit("1", first) and not rollup.commit("1", first)
    assert totals() == {("a", "en"): (2, 15), (None, "en"): (1, 7)}
    rollup.commit("2", batch(("a", "en", "v", "revise", 12, 10), (None, "en", "v", "delete", 7, None)))
    assert totals() == {("a", "en"): (2, 17)}
    rollup.compact()
    assert totals() == {("a", "en"): (2, 17)}
    assert not rollup.commit("2", first)
    rollup.commit("3", batch(("a", "en", "v", "delete", 5, None)))
    assert totals() == {("a", "en"): (1, 12)}


def test_token_counts_equal_counting_again(corpus):
    public = encoding()
    found = defaultdict(Counter)
    for r in token_counts.counted(corpus.select("source", "doc_id", "text")).collect():
        found[r["doc_id"]] = r
    for r in corpus.where("doc_id is not null").collect():
        words = (r["text"] or "").encode().split()
        own = found[r["doc_id"]]
        assert own["n_words"] == len(words)
        assert own["n_bpe"] == len(public.encode_ordinary(r["text"] or ""))
        assert own["n_bpe_normalised"] == len(public.encode_ordinary(b" ".join(words).decode()))


def test_pipeline_keeps_columns_and_round_trips(spark, corpus, tmp_path):
    import corpus_pipeline

    docs = corpus.withColumn("extra", F.lit(1))
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    now = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert last and all(r["round_trip"] for r in last)
