"""A quality classifier over random-indexing word vectors, with a two-layer network and calibrated probabilities.

Words are runs of letters, digits or other signs, and line breaks; each has a fixed sparse index vector of -1, 0 and 1,
the sum of one for the word in lower case and one for its shape (kind, case, length). A word's vector is the sum of the
index vectors of the words around it, over all documents; words are dealt to `WORDS` buckets by hash, so these sums are
a table of fixed size, however many words there are. Tasks add up their own documents and Spark the tasks. A document is
pooled into the mean of its words' vectors, weighted down for frequent words, the mean and deviation of its index
vectors, and how much they cancel out.

A network with one hidden layer learns labels from at most about `SAMPLE` labelled documents, chosen by a hash of their
id; a share of them is kept back, to stop the training and to fit the temperature that divides the network's output
before it becomes a probability. Only the sums, the sample's pooled vectors and the network reach the driver.

Defined cases: null and empty texts, and those of spaces and tabs only, are a vector of zeros and get its score; without
labels, or with labels of one value, every score is the share of that value (0.5 without any); null labels teach
nothing; a document whose label rows disagree has the larger label; rows that repeat are scored alike; null ids are
labelled by none; a text of any length is whole; an empty table gives an empty result; quality_scores() replaces a
column with the name of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, spans

#: Buckets of words, numbers of a vector, and those of an index vector that are not 0.
WORDS, DIM, NONZERO = 1 << 15, 32, 4
#: Numbers of a document: three vectors, two lengths, and how alike neighbours are.
SIZE = 3 * DIM + 3
#: Words on either side that count as around.
AROUND = 2
#: A word with this share of all words counts half in a document's mean.
RARE = 1e-3
#: Labelled documents that are learned from, about, and the share kept back.
SAMPLE, KEPT_BACK = 20_000, 0.2
HIDDEN, EPOCHS, RATE, DECAY, BATCH, SEED = 32, 60, 3e-3, 1e-3, 128, 11
#: Scores from here on are label 1.
LEAST_SCORE = 0.3

_LINE = 4
#: Kinds times cases times lengths.
SHAPES = 5 * 4 * 8
_LENGTHS = np.array([2, 3, 5, 9, 17, 41])


@functools.cache
def _case() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its lower case, whether it is upper case, and its kind, with a line break as one of its own."""
    lower, upper = np.arange(spans.END + 1, dtype=np.uint32), np.zeros(spans.END + 1, bool)
    for i in range(0x1E944):  # there is no case beyond
        if (c := chr(i)).isupper():
            upper[i] = True
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
    kinds = spans.classes().copy()
    kinds[spans.END] = 0
    kinds[10] = _LINE
    return lower, upper, kinds


@functools.cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Index vectors of word buckets and of shapes. The last of each is of zeros, for gaps."""
    draw = np.random.default_rng(SEED)

    def some(n: int) -> np.ndarray:
        found = np.zeros((n + 1, DIM), np.int8)
        places = np.argsort(draw.random((n, DIM)), axis=1)[:, :NONZERO]
        np.put_along_axis(found[:n], places, draw.choice(np.array([-1, 1], np.int8), (n, NONZERO)), axis=1)
        return found

    return some(WORDS), some(SHAPES)


@dataclass
class Words:
    """Words of some texts, with AROUND gaps before each text and after the last: bucket, shape, and where each text's words begin and end."""

    bucket: np.ndarray
    shape: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def index(self) -> np.ndarray:
        words, shapes = index_vectors()
        return words[self.bucket] + shapes[self.shape]


def words_of(texts: list[str]) -> Words:
    points, text_ends = spans.joined(texts)
    lower, upper, kinds = _case()
    kind = kinds[points]
    turn = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], turn)) if len(points) else turn
    ends = np.append(turn, len(points))
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    lengths = ends - starts
    up = np.concatenate(([0], np.cumsum(upper[points])))
    many = up[ends] - up[starts]
    case = np.where(many == 0, 0, np.where(many == lengths, np.where(lengths > 1, 2, 1), np.where((many == 1) & upper[points[starts]], 1, 3)))
    shape = (kind[starts] * 4 + case) * 8 + np.searchsorted(_LENGTHS, lengths, side="right")
    bucket = (spans.hashes(lower[points], starts, ends) % np.uint64(WORDS)).astype(np.int64)
    upto = np.searchsorted(starts, text_ends)
    n = np.diff(upto, prepend=0)
    gaps = AROUND * np.arange(1, len(texts) + 1)
    place = np.arange(len(starts)) + np.repeat(gaps, n)
    spaced = lambda x, gap: _put(np.full(len(x) + AROUND * (len(texts) + 1), gap), place, x)
    return Words(spaced(bucket, WORDS), spaced(shape, SHAPES), upto - n + gaps, upto + gaps)


def _put(found: np.ndarray, place: np.ndarray, x: np.ndarray) -> np.ndarray:
    found[place] = x
    return found


def add_up(sums: np.ndarray, words: Words) -> None:
    """Adds index vectors of neighbours, and in the last column occurrences, to the sums of the words' buckets."""
    index = words.index()
    n = len(index) - 2 * AROUND
    near = sum(index[k : k + n] for k in range(2 * AROUND + 1) if k != AROUND)
    own = words.bucket[AROUND : AROUND + n]
    order = np.argsort(own.astype(np.uint16), kind="stable")[: int((own < WORDS).sum())]
    bucket = own[order]
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    if len(start):
        sums[bucket[start], :DIM] += np.add.reduceat(near[order].astype(np.int32), start, axis=0)
        sums[bucket[start], DIM] += np.diff(start, append=len(bucket))


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vectors and weights of buckets, see finished(); from all documents."""
    names = [f"v{i}" for i in range(DIM + 1)]

    def run(batches):
        sums = np.zeros((WORDS, DIM + 1), np.int64)
        for batch in batches:
            for some in spans.chunks(spans.strings(batch.column(0))):
                add_up(sums, words_of(some))
        here = np.flatnonzero(sums[:, DIM])
        yield pa.RecordBatch.from_arrays([pa.array(here), *(pa.array(sums[here, i]) for i in range(DIM + 1))], names=["bucket", *names])

    parts = docs.select(text_col).mapInArrow(run, ", ".join(f"{c} long" for c in ["bucket", *names]))
    # A row for each of the buckets at most.
    total = parts.groupBy("bucket").agg(*(F.sum(c).cast("double").alias(c) for c in names)).toArrow()
    sums = np.zeros((WORDS, DIM + 1))
    sums[total.column("bucket").to_numpy()] = np.stack([total.column(c).to_numpy() for c in names], axis=1)
    return finished(sums)


def finished(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sums of all documents: weighted vectors of buckets, and the weights; a last one of zeros stands for gaps."""
    length = np.linalg.norm(sums[:, :DIM], axis=1, keepdims=True)
    weight = RARE / (RARE + sums[:, DIM] / max(1.0, sums[:, DIM].sum()))
    vectors = sums[:, :DIM] / np.maximum(length, 1e-9) * weight[:, None]
    return np.pad(vectors, ((0, 1), (0, 0))).astype(np.float32), np.append(weight, 0).astype(np.float32)


def pooled(texts: list[str], vectors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A vector of `SIZE` numbers for each text."""
    words = words_of(texts)
    n = words.last - words.first
    held = np.flatnonzero(n)
    found = np.zeros((len(texts), SIZE), np.float32)
    if not len(held):
        return found
    # Gaps are zeros, so sums may run from one text's first word to the next one's.
    first, count = words.first[held], n[held][:, None].astype(np.float32)
    each = lambda x: np.add.reduceat(x, first, axis=0)
    index = words.index()
    real = index.astype(np.float32)
    mean = each(real) / count
    alike = sum(np.pad(np.einsum("ij,ij->i", index[k:], index[:-k]), (0, k)) for k in range(1, AROUND + 1))
    weight = vectors[1][words.bucket]
    found[held, :DIM] = each(vectors[0][words.bucket]) / each(weight)[:, None]
    found[held, DIM : 2 * DIM] = mean
    found[held, 2 * DIM : 3 * DIM] = np.sqrt(np.maximum(each(real * real) / count - mean * mean, 0))
    found[held, 3 * DIM] = np.linalg.norm(found[held, :DIM], axis=1)
    found[held, 3 * DIM + 1] = np.linalg.norm(mean, axis=1)
    found[held, 3 * DIM + 2] = each(alike.astype(np.float32)) / count[:, 0]
    return found


@dataclass
class Network:
    """Layers over scaled inputs; the output divided by the temperature is the log of the odds of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def output(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(x) / self.temperature, -30, 30)))


def loss(output: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log-likelihood."""
    return float(np.mean(np.logaddexp(0, output) - y * output))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """A network for labels y (0 or 1), of the epoch with the least loss on the part kept back, and its temperature."""
    x, y, draw = x.astype(np.float64), y.astype(np.float64), np.random.default_rng(SEED)
    if len(y) < 2 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        odds = np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)
        d = x.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(odds))
    order = draw.permutation(len(y))
    back = order[: max(1, int(KEPT_BACK * len(y)))]
    own = order[len(back) :] if len(order) > len(back) else order
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    net = Network(mean, scale, draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    values = [net.w1, net.b1, net.w2, np.array(net.b2)]
    moved, squared, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    best, least = None, np.inf
    for _ in range(EPOCHS):
        for at in range(0, len(own), BATCH):
            some = draw.choice(own, min(BATCH, len(own)), replace=False) if at == 0 and len(own) < BATCH else own[at : at + BATCH]
            z = (x[some] - mean) / scale
            hidden = np.tanh(z @ values[0] + values[1])
            error = (1 / (1 + np.exp(-(hidden @ values[2] + values[3]))) - y[some]) / len(some)
            back_to = np.outer(error, values[2]) * (1 - hidden**2)
            slopes = [z.T @ back_to + DECAY * values[0], back_to.sum(axis=0), hidden.T @ error + DECAY * values[2], error.sum()]
            step += 1
            for i, slope in enumerate(slopes):
                moved[i] = 0.9 * moved[i] + 0.1 * slope
                squared[i] = 0.999 * squared[i] + 0.001 * slope**2
                values[i] = values[i] - RATE * (moved[i] / (1 - 0.9**step)) / (np.sqrt(squared[i] / (1 - 0.999**step)) + 1e-8)
        own = draw.permutation(own)
        net = Network(mean, scale, values[0], values[1], values[2], float(values[3]))
        if (now := loss(net.output(x[back]), y[back])) < least:
            best, least = net, now
    # The temperature with the least loss on the part kept back. Its labels count as a little less than sure, as it is
    # small; the loss has one minimum in the temperature's logarithm.
    ones = y[back].sum()
    sure = np.where(y[back] == 1, (ones + 1) / (ones + 2), 1 / (len(back) - ones + 2))
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
    best.temperature = float(choices[np.argmin([loss(best.output(x[back]) / t, sure) for t in choices])])
    return best


def labelled_rows(labels: DataFrame, allowed: Column, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """_id, _label of about `sample` labelled documents at most, among those that are allowed."""
    known = labels.where(allowed & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    n = known.count()
    return known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(sample * (1 << 20) / max(1, n)))


def _with_vectors(docs: DataFrame, vectors, keep: list[str], text_col: str, added: list[T.StructField], make) -> DataFrame:
    """docs' columns `keep`, and what `make` gives for the pooled vectors of each run of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # of fixed size

    def run(batches):
        for batch in batches:
            at = 0
            for some in spans.chunks(spans.strings(batch.column(text_col))):
                columns = [batch.column(c).slice(at, len(some)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, make(pooled(some, shared.value))], names=[*keep, *(f.name for f in added)])
                at += len(some)

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *added]))


def learn(docs: DataFrame, rows: DataFrame, vectors, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network for labelled_rows(), of which there are a bounded number."""
    texts = docs.join(F.broadcast(rows), docs[id_col] == F.col("_id")).select("_id", "_label", F.col(text_col).alias("_text"))
    as_bytes = lambda x: pa.array([row.tobytes() for row in x], pa.binary())
    found = _with_vectors(texts, vectors, ["_id", "_label"], "_text", [T.StructField("_x", T.BinaryType())], as_bytes).toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, SIZE)), np.zeros(0))
    # Rows arrive in any order; the same sample gives the same network.
    every = found.sort_by([("_id", "ascending"), ("_x", "ascending")])
    x = np.stack([np.frombuffer(v, np.float32) for v in every.column("_x").to_pylist()])
    return fit(x, every.column("_label").to_numpy())


def quality_scores(docs: DataFrame, network: Network, vectors, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs without the text, with score_col: the probability of label 1."""
    keep = [c for c in docs.columns if c not in (text_col, score_col)]
    net = docs.sparkSession.sparkContext.broadcast(network)
    return _with_vectors(docs, vectors, keep, text_col, [T.StructField(score_col, T.DoubleType())], lambda x: pa.array(net.value.scores(x.astype(np.float64)), pa.float64()))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    vectors = word_vectors(docs)
    network = learn(docs, labelled_rows(common.table(spark, sf_dir, "labels"), ~held_out()), vectors)
    scored = quality_scores(docs, network, vectors)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
