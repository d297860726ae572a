"""Language identification by rank-order profiles.

A language's profile is the ranked list of its most frequent character n-grams. A document's own list is compared with
each profile by out-of-place distance: the sum, over its n-grams, of how far their ranks lie apart, with the length of
the profile for n-grams that it lacks. The nearest profile is the prediction; the score is 1 minus the distance as a
share of the largest one.

Profiles are learned from about `sample` labelled documents of each language, chosen by a hash of their id; n-grams are
counted in the tasks, summed by a shuffle, and only the profiles (languages times `size` rows) reach the driver.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled document every text is
`und`; ties go to the first language by name; null ids may be labelled, like any others; rows that repeat are predicted
alike; a text of any length is whole; an empty table gives an empty result; identify() replaces columns with the names
of its two, accepted() leaves all as they are.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, spans

SIZE, WIDEST, SAMPLE = 300, 4, 2000
#: Texts that share next to nothing with any profile score below this.
LEAST_SCORE = 0.1
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return spans.classes() == 1


def grams(texts: list[str], widest: int = WIDEST) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the words of texts, 1 to `widest` letters wide with word ends, and the text of each.

    All runs without letters are one word end. An n-gram of two or more holds word ends at its ends only.
    """
    points, text_ends = spans.joined([" " + t.lower() for t in texts])
    letter = _letters()[points]
    stays = letter.copy()
    stays[1:] |= letter[:-1] & ~letter[1:]  # the first of a run without letters
    stays[0] = True
    # A text begins with a word end of its own.
    begins = np.concatenate(([0], text_ends[:-1] + 1))
    stays[begins] = True
    at = np.flatnonzero(stays)
    real = letter[at]
    value = np.where(real, points[at], spans.END)
    h = spans.mixed(value.astype(np.uint64) + np.uint64(0x51ED27))
    doc = np.searchsorted(text_ends, at)
    found, owner = [], []
    for width in range(1, widest + 1):
        n = len(at) - width + 1
        if n <= 0:
            break
        fits = doc[:n] == doc[width - 1 :]
        if width == 1:
            fits = real.copy()
        elif width == 2:
            fits &= real[:n] | real[1 : 1 + n]
        for k in range(1, width - 1):
            fits &= real[k : k + n]
        found.append(spans.windows(h, width)[fits])
        owner.append(doc[:n][fits])
    return (np.concatenate(found), np.concatenate(owner)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _by_text(texts: list[str], widest: int):
    """The n-grams of each text in turn."""
    for some in spans.chunks(texts, 300_000):
        found, owner = grams(some, widest)
        order = np.argsort(owner, kind="stable")
        yield from np.split(found[order], np.cumsum(np.bincount(owner, minlength=len(some)))[:-1])


def ranked(found: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by hash."""
    key, count = np.unique(found, return_counts=True)
    return key[np.argsort(-count, kind="stable")[:size]]


class Profiles:
    def __init__(self, languages: dict[str, list[int]], size: int):
        self.names, self.size = sorted(languages), size
        self.keys, self.ranks = [], []
        for name in self.names:
            key = np.array(languages[name], np.uint64)
            order = np.argsort(key)
            self.keys.append(key[order])
            self.ranks.append(order)

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        rank, far = np.arange(len(own)), []
        for key, ranks in zip(self.keys, self.ranks):
            spot = np.minimum(np.searchsorted(key, own), len(key) - 1)
            far.append(int(np.where(key[spot] == own, np.abs(ranks[spot] - rank), self.size).sum()))
        best = int(np.argmin(far))
        return self.names[best], 1.0 - far[best] / (self.size * len(own))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", size: int = SIZE, widest: int = WIDEST, sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages of labelled rows; rows without a label or text teach nothing."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)).alias("_draw")
    )
    # One number per language reaches the driver and goes into the filter, so no text moves to draw the sample.
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles({}, size)
    below = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, float(sample) * (1 << 20) / n)))
    chosen = rows.where(F.col("_draw") < F.element_at(below, F.col("_lang"))).select("_lang", "_text")

    def count(batches):
        for batch in batches:
            sums: dict[tuple[str, int], int] = {}
            for lang, found in zip(batch.column("_lang").to_pylist(), _by_text(spans.strings(batch.column("_text")), widest)):
                key, n = np.unique(found, return_counts=True)
                for k, v in zip(key.view(np.int64).tolist(), n.tolist()):
                    sums[lang, k] = sums.get((lang, k), 0) + v
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in sums], pa.string()), pa.array([x for _, x in sums], pa.int64()), pa.array(sums.values(), pa.int64())], names=["lang", "gram", "n"])

    counts = chosen.mapInArrow(spans.freed(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("_r") <= size)
    found: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "_r").collect():
        found.setdefault(row["lang"], []).append(row["gram"] & 0xFFFFFFFFFFFFFFFF)
    return Profiles(found, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", widest: int = WIDEST, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with pred_col and score_col. Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    keep = [c for c in docs.columns if c not in (pred_col, score_col)]
    source = docs.select(*keep)

    def run(batches):
        known = shared.value
        for batch in batches:
            near = [known.nearest(ranked(x, known.size)) for x in _by_text(spans.strings(batch.column(text_col)), widest)]
            added = [pa.array([x for x, _ in near], pa.string()), pa.array([x for _, x in near], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*keep, pred_col, score_col])

    return source.mapInArrow(spans.freed(run), T.StructType([*source.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))


def accepted(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is in a known language: it has letters, and some profile is near enough.

    All columns stay as they are, whatever their names.
    """
    pred, score = common.fresh(docs, "lang_pred"), common.fresh(docs, "score")
    named = identify(docs, profiles, text_col, pred_col=pred, score_col=score)
    return named.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).drop(pred, score)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    profiles = learn(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")
