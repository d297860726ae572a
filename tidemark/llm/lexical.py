"""Ranked lexical search over document shards with precomputed integer impacts.

An index is a table with one row per shard of documents: its ids, its own vocabulary, and postings in compressed sparse
rows, one row per term, which hold a document of the shard and the impact of the term's occurrences in it. A task fills a
shard until it holds about `SHARD` postings, so neither a frequent term nor a large corpus makes a long row.

A search goes over all shards in two steps. The lengths of the rows, summed over shards, are the terms' document
frequencies, and so give their weights. Then each shard is scored term at a time: a dense array of sums over its
documents gets weight times impact for one query term after another. The best k of a shard are found by partial
selection, with ties at the border decided by id; a task merges the shards it reads, and Spark the tasks. Queries are
taken in blocks of bounded size, each against all shards.

Defined cases: a null text has no term, is in no result and counts nowhere; documents with a null id are ranked after
others of their score; rows that repeat an id are documents of their own, and queries that repeat an item id are ranked
each by themselves; a query without terms, or with unknown ones only, has no result; a text of any length is whole; an
empty table, of documents or of queries, gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: A term: a longest run of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 as they count in terms: A-Z in lower case, and a space for what is in none.
BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Postings of a shard, about; documents of a shard at most; bytes of a text that are split at once.
SHARD, SHARD_DOCS, PIECE = 1_000_000, 1 << 16, 1 << 20
#: Queries and query terms of a block at most (one query may exceed the second).
BLOCK_ITEMS, BLOCK_TERMS = 1000, 200_000
TOP = 20

SHARDS = "ids array<long>, terms array<binary>, starts binary, owner binary, impact binary"


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    low, at = (text or b"").translate(BYTES), 0
    while at < len(low):
        end = at + PIECE
        if end < len(low):
            cut = low.rfind(b" ", at + 1, end)
            cut = cut if cut >= 0 else low.find(b" ", end)
            end = cut if cut >= 0 else len(low)
        yield low[at:end].split()
        at = end


def counts(text: bytes | None) -> Counter:
    found: Counter = Counter()
    for some in terms(text):
        found.update(some)
    return found


def length_part(n: int, n_docs: int, n_terms: int) -> int:
    """The part of an impact's divisor that stands for a document's length against the mean."""
    return 100 - 25 + 25 * n * n_docs // n_terms


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Documents of a shard that is being filled."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.ids, self.lengths, self.term, self.tf, self.postings = [], [], [], [], 0

    def add(self, doc_id: int | None, found: Counter, length: int) -> None:
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.term.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
        self.tf.append(np.fromiter(found.values(), np.int64, len(found)))
        self.postings += len(found)

    def row(self) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, self.term), np.int64, len(self.term))
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        m = np.repeat(np.array(self.lengths, np.int64), sizes)
        term, tf = np.concatenate(self.term), np.concatenate(self.tf)
        impact = (1_000_000_000 * tf // (1000 * tf + 12 * m)).astype(np.int32)
        order = np.argsort(term, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.number))))).astype(np.int64)
        columns = [pa.array([self.ids], pa.list_(pa.int64())), pa.array([list(self.number)], pa.list_(pa.binary()))]
        columns += [pa.array([x.tobytes()], pa.binary()) for x in (starts, owner[order], impact[order])]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "terms", "starts", "owner", "impact"])


@dataclass
class Index:
    shards: DataFrame
    n_docs: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of all documents, as a table in the shared folder."""
    n = F.regexp_count(F.col(text_col), F.lit(TERM)).cast("long")
    sums = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"]

    def run(batches):
        shard = Shard()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                few = batch.slice(at, 64)
                for doc_id, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist()):
                    if found := counts(text):
                        shard.add(doc_id, found, length_part(found.total(), n_docs, n_terms))
                    if shard.postings >= SHARD or len(shard.ids) == SHARD_DOCS:
                        yield shard.row()
                        shard = Shard()
        if shard.ids:
            yield shard.row()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return Index(common.stored(rows.mapInArrow(run, SHARDS), "lexical-index"), n_docs)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, of equal ones those of the smallest ids; in no order."""
    found = np.flatnonzero(score > 0)
    if len(found) <= k:
        return found
    own = score[found]
    border = np.partition(own, len(own) - k)[len(own) - k]
    above, level = found[own > border], found[own == border]
    more = k - len(above)
    return np.concatenate((above, level[np.argpartition(ids[level], more - 1)[:more]]))


#: Stands for a null id, after all others.
_NO_ID = np.iinfo(np.int64).max


def _blocks(queries: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with their terms, in blocks that fit in memory."""
    held, n = [], 0
    for row in queries.select(item_col, F.col(text_col).cast("binary")).toLocalIterator():
        found = counts(bytes(row[1]) if row[1] is not None else None)
        if held and (len(held) == BLOCK_ITEMS or n + len(found) > BLOCK_TERMS):
            yield held
            held, n = [], 0
        held.append((row[0], found))
        n += len(found)
    if held:
        yield held


def _search_block(index: Index, block: list[tuple[int | None, Counter]], k: int, first: int) -> DataFrame:
    """_query, doc_id, score: the best k of each task for each query of a block."""
    spark = index.shards.sparkSession
    asked = sorted({t for _, found in block for t in found})
    shared = spark.sparkContext.broadcast(asked)

    def lengths(batches):
        wanted = pa.array(shared.value, pa.binary())
        for batch in batches:
            for own, starts in zip(batch.column(0), batch.column(1)):
                row = pc.index_in(wanted, value_set=own.values)
                here = np.flatnonzero(row.is_valid())
                at = np.frombuffer(starts.as_py(), np.int64)
                spot = row.drop_null().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(at[spot + 1] - at[spot])], names=["term", "n"])

    # One row for each term of the block at most.
    df = {r["term"]: r["n"] for r in index.shards.select("terms", "starts").mapInArrow(lengths, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    number = {t: i for i, t in enumerate(asked)}
    weights = [[(number[t], times * weight(index.n_docs, df[number[t]])) for t, times in found.items() if number[t] in df] for _, found in block]
    shared_weights = spark.sparkContext.broadcast(weights)

    def score(batches):
        wanted, queries = pa.array(shared.value, pa.binary()), shared_weights.value
        top = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        for batch in batches:
            for own_ids, own, starts, owner, impact in zip(*batch.columns):
                ids = own_ids.values.fill_null(_NO_ID).to_numpy()
                row = pc.index_in(wanted, value_set=own.values).fill_null(-1).to_numpy()
                at = np.frombuffer(starts.as_py(), np.int64)
                owner, impact = np.frombuffer(owner.as_py(), np.uint16), np.frombuffer(impact.as_py(), np.int32)
                for q, parts in enumerate(queries):
                    total = np.zeros(len(ids), np.int64)
                    for term, w in parts:
                        if (r := row[term]) >= 0:
                            a, b = at[r], at[r + 1]
                            total[owner[a:b]] += w * impact[a:b].astype(np.int64)
                    spot = best(total, ids, k)
                    if len(spot):
                        scores, found = np.concatenate((top[q][0], total[spot])), np.concatenate((top[q][1], ids[spot]))
                        spot = best(scores, found, k)
                        top[q] = scores[spot], found[spot]
        sizes = [len(s) for s, _ in top]
        if sum(sizes):
            found = np.concatenate([x for _, x in top])
            columns = [pa.array(np.repeat(np.arange(first, first + len(top)), sizes)), pa.array(found, mask=found == _NO_ID), pa.array(np.concatenate([s for s, _ in top]))]
            yield pa.RecordBatch.from_arrays(columns, names=["_query", "doc_id", "score"])

    return index.shards.mapInArrow(score, "_query long, doc_id long, score long")


def search(index: Index, queries: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 of each query."""
    spark, parts, names, first = index.shards.sparkSession, [], [], 0
    for block in _blocks(queries, item_col, text_col):
        parts.append(_search_block(index, block, k, first))
        # Each block's items go with its rows; ids repeat or are null, so numbers stand for them.
        named = spark.createDataFrame([(first + i, item) for i, (item, _) in enumerate(block)], f"_query long, {item_col} long")
        place = Window.partitionBy("_query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = parts[-1].withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        names.append(ranked.join(F.broadcast(named), "_query").select(item_col, "rank", "doc_id", "score"))
        first += len(block)
    if not names:
        return spark.createDataFrame([], f"{item_col} long, rank int, doc_id long, score long")
    found = names[0]
    for more in names[1:]:
        found = found.unionByName(more)
    return found


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(common.documents(spark, sf_dir)), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT count(*) AS nd, sum(len(t))::BIGINT AS nt FROM d WHERE len(t) > 0
), p AS (
  SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d
), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf CROSS JOIN s GROUP BY term
), q AS (
  SELECT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark)
), f AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // nt)))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) CROSS JOIN s GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM f WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 20
"""
