"""Byte-level BPE: encoding by a rank file, and decoding.

Two tiers: a minimal perfect hash finds pre-tokens that are whole entries of the vocabulary; all others are merged on a
heap over a linked list of their bytes. Each task resolves a distinct pre-token once and keeps a bounded number of them.
Texts never shuffle: encoding is one pass over the documents.

Defined cases: a null text is empty; an empty text has no ids; a text of any length is whole; rows that repeat one another
are coded alike; an empty table gives an empty result; other columns stay as they are, but for those with the name of an
added column, which are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm import common, spans

#: Seeds of the two hashes of a key.
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PerfectHash:
    """Maps n keys to 0..n-1 without gaps: a bucket's displacement, found when it is built, moves its keys to free slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // per_bucket)
        self.shift = np.zeros(self.buckets, np.int64)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        pairs = [self._pair(k) for k in keys]  # the upper half of a chooses the bucket, the lower half the step
        for i, (a, _) in enumerate(pairs):
            members[(a >> 32) % self.buckets].append(i)
        free = np.ones(n, bool)
        slot = [0] * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        alone = [b for b in order if len(members[b]) == 1]
        for b in order:
            if len(members[b]) < 2:
                break
            d = 0
            while True:
                spots = {(pairs[i][1] + d * (pairs[i][0] | 1)) % n for i in members[b]}
                if len(spots) == len(members[b]) and all(free[s] for s in spots):
                    break
                d += 1
            self.shift[b] = d
            for i in members[b]:
                slot[i] = (pairs[i][1] + d * (pairs[i][0] | 1)) % n
                free[slot[i]] = False
        for b, s in zip(alone, np.flatnonzero(free).tolist()):
            slot[members[b][0]] = s
            self.shift[b] = -s - 1
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for i, s in enumerate(slot):
            self.keys[s], self.values[s] = keys[i], i

    @staticmethod
    def _pair(key: bytes) -> tuple[int, int]:
        import xxhash

        return xxhash.xxh3_64_intdigest(key, _SEEDS[0]), xxhash.xxh3_64_intdigest(key, _SEEDS[1])

    def get(self, key: bytes) -> int:
        """The number of the key, or -1."""
        a, b = self._pair(key)
        d = int(self.shift[(a >> 32) % self.buckets])
        s = -d - 1 if d < 0 else (b + d * (a | 1)) % self.n
        return self.values[s] if self.keys[s] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of lowest rank, the first of equals, merges until none is left."""
    n = len(piece)
    after = list(range(1, n + 1))  # where each part ends, and so where the next begins
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = after[i]
        if mid <= i or mid >= n or after[mid] != end:  # a part of this pair has merged meanwhile
            continue
        after[i], after[mid] = end, -1
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        whole = list(self.ranks)
        self.ids_of = [self.ranks[k] for k in whole]
        self.tier = PerfectHash(whole)
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            self.pieces[i] = piece
        self.resolved = spans.Resolved(self._resolve)

    def _resolve(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for token in tokens:
            piece = token.encode()
            k = self.tier.get(piece)
            found.append([self.ids_of[k]] if k >= 0 else merge(piece, self.ranks))
        return spans.listed(found)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for some in spans.chunks(texts):
            points, text_ends = spans.joined(some)
            starts, ends = spans.pretokens(points)
            ids, size = self.resolved.ids(points, starts, ends)
            upto = np.concatenate(([0], np.cumsum(size)))[spans.per_text(starts, text_ends)]
            out += np.split(ids, upto[:-1])
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _encoder(rank_file: bytes) -> Encoder:
    return Encoder(rank_file)


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, digests: bool = False) -> DataFrame:
    """docs with its ids and the decoded text: ids array<int>, decoded binary; with digests their SHA-256 instead.

    vocabulary is the path of a rank file on the driver; its content, of a fixed size, goes to the executors.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_bytes(vocabulary or default_vocabulary()))
    kept = [c for c in docs.columns if not digests or c != text_col]
    added = [T.StructField("n_tokens", T.LongType())] + (
        [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        if digests
        else [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    )
    names = {f.name for f in added}
    schema = T.StructType([docs.schema[c] for c in kept if c not in names] + added)
    keep = [c for c in kept if c not in names]

    def run(batches):
        encoder = _encoder(ranks.value)
        for batch in batches:
            at = 0
            for some in spans.chunks(spans.strings(batch.column(text_col))):
                ids = encoder.encode(some)
                listed = [x.tolist() for x in ids]
                columns = [batch.column(c).slice(at, len(some)) for c in keep] + [pa.array(map(len, ids), pa.int64())]
                if digests:
                    columns.append(pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in listed], pa.string()))
                    columns.append(pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in listed], pa.string()))
                else:
                    ends = np.cumsum([0, *map(len, ids)])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32), pa.int32())))
                    columns.append(pa.array([encoder.decode(x) for x in listed], pa.binary()))
                at += len(some)
                yield pa.RecordBatch.from_arrays(columns, names=keep + [f.name for f in added])

    return docs.mapInArrow(spans.freed(run), schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.documents(spark, sf_dir).select("doc_id", "text"), digests=True)
