"""Ranked search, conversation tries and the quality model against plain versions of the same."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical, prefix_trie, quality_model

TERM = re.compile(lexical.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranking(docs, text, k):
    """(doc_id, score) of the k best, by the formula of the contract."""
    held = [(i, Counter(plain_terms(t))) for i, t in docs if plain_terms(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for i, c in held:
        m = 100 - 25 + (25 * c.total() * n) // total
        score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
        if score > 0:
            found.append((i, score))
    return sorted(found, key=lambda x: (-x[1], x[0] is None, x[0]))[:k]


def test_terms_are_the_matches_of_the_pattern(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("aZ9_ -.é漢😀\x7f\x00\n") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", "x" * 50, " " * 50]
    for piece in (1 << 20, 7, 1):
        monkeypatch.setattr(lexical, "PIECE", piece)
        for t in texts:
            assert [x.decode() for some in lexical.terms(t.encode()) for x in some] == plain_terms(t)
    assert lexical.counts(None) == Counter()


@pytest.mark.parametrize("shard, block", [(1_000_000, 1000), (300, 2)])
def test_search_equals_plain_scores(spark, corpus, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    docs = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    texts = [(1, docs[0][1]), (2, "one ONE Common line the the"), (3, None), (4, "—"), (None, "of 漢字かな交じり文"), (2, docs[130][1]), (7, "unheardofword")]
    items = spark.createDataFrame(texts, "item_id long, text string").withColumn("score", F.lit(0))
    index = lexical.build_index(corpus)
    if shard == 300:
        assert index.shards.count() > 10
    found = defaultdict(list)
    for r in lexical.search(index, items, k=7).orderBy("item_id", "rank").collect():
        found[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    ranked = lambda text: [(n + 1, *x) for n, x in enumerate(ranking(docs, text, 7))]
    assert sorted(found[2]) == sorted(ranked(texts[1][1]) + ranked(texts[5][1]))
    for item, text in (texts[0], texts[4]):
        assert found[item] == ranked(text)
    assert set(found) == {1, 2, None}


def test_best_keeps_the_smallest_ids_of_a_tie():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(0, 40))
        score, ids, k = r.integers(0, 4, n), r.permutation(100)[:n], int(r.integers(1, 12))
        want = sorted([(-s, i) for s, i in zip(score, ids) if s > 0])[:k]
        assert sorted((-score[p], ids[p]) for p in lexical.best(score, ids, k)) == want


def test_search_without_documents_or_queries(spark, corpus, empty):
    queries = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(lexical.build_index(empty), queries).count() == 0
    assert lexical.search(lexical.build_index(corpus), queries.limit(0)).count() == 0


def plain_trie(rows):
    """conv_id, depth -> the other columns, by sets of prefixes."""
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def totals(p):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [totals(k) for k in kids[p]]
        return (sum(b[0] for b in below) or 1, (len(members[p]) - 1) * words + sum(b[1] for b in below))

    found = {}
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        found[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *totals(p), hashlib.sha256(ends.encode()).hexdigest())
    return found


def conversations(kind, r):
    if kind == "mixed":
        rows = []
        for c in [*range(-3, 45), 1000, 1007]:
            for t in range(r.randint(1, 7)):
                rows.append((c, t if r.random() > 0.1 else None, r.choice(["user", "assistant", None]), r.choice(["a b", "a b", "c", "", None, "long text here"])))
        return rows + [rows[0], rows[0], (None, 0, "user", "x")]
    if kind == "grown":  # each conversation is the one before and a turn more: one long chain
        return [(c * 20, t, "user", f"turn {t}") for c in range(60) for t in range(c + 1)]
    if kind == "comb":  # at every depth one branch ends and one goes on
        return [(c * 20, t, "user", f"turn {t}" if t < c else f"other {c}") for c in range(50) for t in range(c + 1)]
    return [(c * 20, t, "user", ["hi", "you there", "bye now then"][t]) for c in range(150) for t in range(3)]  # copies


@pytest.mark.parametrize("kind", ["mixed", "grown", "comb", "copies"])
def test_trie_equals_sets_of_prefixes(spark, monkeypatch, kind):
    monkeypatch.setattr(prefix_trie, "RANGE", 64)
    rows = conversations(kind, random.Random(1))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).repartition(3)
    rounds = []
    stored = prefix_trie.common.stored
    monkeypatch.setattr(prefix_trie.common, "stored", lambda df, name: (rounds.append(name), stored(df, name))[1])
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in prefix_trie.prefix_trie(table).collect()}
    assert found == plain_trie(rows)
    # Chains don't take a round for each turn.
    assert rounds.count("trie-state") <= 12


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).count() == 0
    one = none.unionByName(spark.createDataFrame([(8, 1, "user", "x")], none.schema))
    assert [tuple(r)[:7] for r in prefix_trie.prefix_trie(one).collect()] in ([(8, 0, None, 1, 0, 1, 0)], [(8, 0, None, 1, 1, 1, 0), (8, 1, 8, 1, 0, 1, 0)])


def test_words_and_sums_equal_a_plain_count():
    texts = ["Ab ab, AB 12!\n\n x", "", " \t", "é漢 é漢 é漢 é漢", "one"]
    words, shapes = (x.astype(int) for x in quality_model.index_vectors())
    got = quality_model.words_of(texts)
    plain = [re.findall(r"\n+|\d+|[^\W\d_]+|[^\w\s]+", t) for t in texts]
    assert (got.last - got.first).tolist() == [len(p) for p in plain]
    assert got.bucket[got.first[0]] == got.bucket[got.first[0] + 1] and got.shape[got.first[0]] != got.shape[got.first[0] + 1]
    sums = np.zeros((quality_model.WORDS, quality_model.DIM + 1), np.int64)
    quality_model.add_up(sums, got)
    want = np.zeros_like(sums)
    for a, b in zip(got.first, got.last):
        own = [words[got.bucket[i]] + shapes[got.shape[i]] for i in range(a, b)]
        for i in range(b - a):
            near = [own[k] for k in range(max(0, i - 2), min(b - a, i + 3)) if k != i]
            want[got.bucket[a + i], :-1] += sum(near, np.zeros(quality_model.DIM, int))
            want[got.bucket[a + i], -1] += 1
    assert (sums == want).all()
    vectors = quality_model.finished(sums)
    found = quality_model.pooled(texts, vectors)
    assert found.shape == (5, quality_model.SIZE) and not found[1:3].any()
    own = np.array([words[got.bucket[i]] + shapes[got.shape[i]] for i in range(got.first[3], got.last[3])], float)
    d = quality_model.DIM
    assert np.allclose(found[3, d : 2 * d], own.mean(axis=0)) and np.allclose(found[3, 2 * d : 3 * d], own.std(axis=0), atol=1e-5)


def test_quality_model_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    found = quality_model.op11_quality_model(spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(rows) > 500 and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] for r in good]) > 0.99 and np.mean([r["predicted"] for r in bad]) < 0.12
    loss = -np.mean([math.log(max(1e-9, r["score"] if r["quality"] else 1 - r["score"])) for r in rows])
    assert loss < 0.06  # of calibrated scores; a constant share of labels gives 0.4
    assert found.where("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.3 as int)").isEmpty()


def test_quality_scores_of_odd_rows(spark, corpus, empty):
    vectors = quality_model.word_vectors(corpus)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(5, 0), (7, None), (None, 1)], "doc_id long, quality int")
    rows = quality_model.labelled_rows(labels, F.lit(True))
    assert rows.count() == 100 and rows.where("_id = 5 and _label = 1").count() == 1
    network = quality_model.learn(corpus, rows, vectors)
    scored = quality_model.quality_scores(corpus, network, vectors).collect()
    assert len(scored) == corpus.count()
    blank = {r["score"] for r in scored if r["doc_id"] in (200, 201)}
    assert len(blank) == 1 and 0 <= blank.pop() <= 1
    assert quality_model.quality_scores(empty, network, vectors).count() == 0
    none = quality_model.learn(corpus, quality_model.labelled_rows(labels.limit(0), F.lit(True)), vectors)
    assert {r["score"] for r in quality_model.quality_scores(corpus, none, vectors).collect()} == {0.5}
    assert quality_model.labelled_rows(labels, F.lit(True), sample=20).count() < 50
    assert np.array_equal(quality_model.word_vectors(corpus.repartition(5))[0], vectors[0])
