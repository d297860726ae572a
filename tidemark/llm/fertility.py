"""Quality rules from tokeniser fertility.

Two public vocabularies split each word: one of sentence pieces with byte fallback ("piece"), one of byte-level merges
("byte"). By each of them a document is measured by its characters per token, the share of its tokens that are bytes of
a character, and the entropy of its tokens. Each script has a band for each measure of each vocabulary, and a document
outside a band of its script is rejected. Entropy is compared with the most that as many tokens can have, counting
ENTROPY_TOKENS at most: beyond, the entropy of a text hardly grows.

fit_bands() takes bands from clean labelled documents: quantiles of each script, widened by a margin. BANDS holds the
production ones: the lower limits and the share of bytes of Latin were fitted so, and all else is set around sample
sentences, as labelled documents have but one script.

The base rules run beside it: too few words, or too many words in windows that the text repeats.

A pass over the documents, without a shuffle. Each task splits a distinct word once and keeps a bounded number of them.

Defined cases: a null or empty text has no words and fails the base rules; its measures are null; a text without a
letter has the script "none"; of scripts with as many letters, the first in names() counts; every row gives one row, also
rows that repeat; a text of any length is whole; an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, spans

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
ENTROPY_TOKENS = 1024

#: First code points of runs of letters, and their script: enough to tell scripts with bands of their own.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "indic"), (0x0E00, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x323B0, "other"),
]

#: Bands by script and vocabulary: least and most characters per token, most share of bytes, least share of the largest entropy.
BANDS = {
    "latin": {"piece": (1.64, 8.0, 0.02, 0.63), "byte": (1.62, 8.0, 0.09, 0.625)},
    "cyrillic": {"piece": (1.2, 6.0, 0.10, 0.50), "byte": (0.5, 4.0, 0.45, 0.40)},
    "greek": {"piece": (0.5, 4.0, 0.30, 0.38), "byte": (0.45, 4.0, 0.55, 0.40)},
    "hebrew": {"piece": (0.5, 4.0, 0.30, 0.38), "byte": (0.4, 3.0, 0.70, 0.38)},
    "arabic": {"piece": (0.5, 4.0, 0.30, 0.40), "byte": (0.5, 3.0, 0.55, 0.45)},
    "indic": {"piece": (0.45, 3.0, 0.35, 0.45), "byte": (0.3, 2.0, 0.93, 0.40)},
    "hangul": {"piece": (0.4, 3.0, 0.45, 0.50), "byte": (0.2, 2.0, 0.95, 0.45)},
    "kana": {"piece": (0.5, 3.0, 0.45, 0.50), "byte": (0.4, 2.0, 0.75, 0.50)},
    "han": {"piece": (0.5, 3.0, 0.60, 0.55), "byte": (0.3, 2.0, 0.93, 0.55)},
    "other": {"piece": (0.2, 8.0, 0.98, 0.30), "byte": (0.15, 8.0, 0.98, 0.30)},
    "none": {"piece": (0.5, 8.0, 0.60, 0.45), "byte": (0.4, 8.0, 0.60, 0.45)},
}
DEFAULT_SCRIPT = "other"
#: Of fitted bands: the quantile left out on each side, the margin as a share of the limit, and the rows that a script needs.
QUANTILE, MARGIN, LEAST_ROWS = 0.001, 0.03, 200


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_vocabulary() -> str:
    return vocabulary_path("piece_bpe_32k.model")


class Splitter:
    """Splits words by a sentence-piece model; each word stands alone."""

    name = "piece"

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.resolved = spans.Resolved(lambda w: spans.listed(self.model.encode(w, num_threads=1)))


class ByteSplitter:
    """Splits words, each after a space, by a byte-level model of the tokenizers library."""

    name = "byte"

    def __init__(self, model: bytes):
        from tidemark.llm.token_files import library_encoder

        self.model, encode = library_encoder(model.decode())
        self.size = self.model.get_vocab_size()
        own = {c: b for b, c in enumerate(byte_characters())}
        self.is_byte = np.zeros(self.size, bool)
        for piece, i in self.model.get_vocab(with_added_tokens=False).items():
            self.is_byte[i] = partial(bytes(own[c] for c in piece))
        self.resolved = spans.Resolved(lambda w: encode([" " + x for x in w]))


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def partial(piece: bytes) -> bool:
    """Whether a piece holds no whole character."""
    return not piece.decode("utf-8", "ignore")


@functools.lru_cache(maxsize=2)
def _splitter(model: bytes, kind: type = Splitter):
    return kind(model)


@functools.cache
def _script_of() -> np.ndarray:
    """The number of the script in names(), for letters; 0 for all else."""
    kinds = np.zeros(spans.END + 1, np.uint8)
    ends = [a for a, _ in SCRIPTS[1:]] + [spans.END]
    for (a, name), b in zip(SCRIPTS, ends):
        kinds[a:b] = names().index(name)
    kinds[spans.classes() != 1] = 0
    return kinds


@functools.cache
def names() -> list[str]:
    return ["none", *dict.fromkeys(name for _, name in SCRIPTS)]


def repeated_words(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int = WINDOW) -> np.ndarray:
    """Words of each document in windows of `width` words that the document holds twice or more."""
    if len(h) < width:
        return np.zeros(n_docs, np.int64)
    first = np.flatnonzero(doc[: len(h) - width + 1] == doc[width - 1 :])
    w = spans.windows(h, width)[first]
    # A window of another document is another window.
    key = spans.mixed(w + doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    turn = np.zeros(len(h) + 1, np.int64)
    np.add.at(turn, first[twice], 1)
    np.add.at(turn, first[twice] + width, -1)
    return np.bincount(doc[np.cumsum(turn[:-1]) > 0], minlength=n_docs)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    found = [x for x in text.split("\n") if x.strip(common.SPACE_CHARS)]
    return len(found) - len(set(found))


def entropy(ids: np.ndarray, doc: np.ndarray, n_docs: int, vocabulary: int) -> np.ndarray:
    """Bits per token of each document."""
    n = np.maximum(np.bincount(doc, minlength=n_docs), 1)
    key, count = np.unique(doc.astype(np.int64) * vocabulary + ids, return_counts=True)
    return np.log2(n) - np.bincount(key // vocabulary, count * np.log2(count), n_docs) / n


def measure(texts: list[str], *splitters) -> dict[str, np.ndarray]:
    """Counts and measures of some texts."""
    n = len(texts)
    points, text_ends = spans.joined(texts)
    starts, ends = spans.words(points)
    doc = np.searchsorted(text_ends, starts)
    by_splitter = {}
    for x in splitters:
        ids, size = x.resolved.ids(points, starts, ends)
        token_doc = np.repeat(doc, size)
        by_splitter |= {
            f"n_tokens_{x.name}": np.bincount(token_doc, minlength=n),
            f"n_bytes_{x.name}": np.bincount(token_doc, x.is_byte[ids], n).astype(np.int64),
            f"entropy_{x.name}": entropy(ids, token_doc, n, x.size),
        }
    letters = _script_of()[points]
    held = np.flatnonzero(letters)
    scripts = np.zeros((n, len(names())), np.int64)
    np.add.at(scripts, (np.searchsorted(text_ends, held), letters[held]), 1)
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": np.bincount(doc, ends - starts, n).astype(np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated_words(spans.hashes(points, starts, ends), doc, n),
        **by_splitter,
        "script": np.array(names())[scripts.argmax(axis=1)],
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
NAMES = [Splitter.name, ByteSplitter.name]
#: Columns of a vocabulary's measures, before its name, in the order of the limits of a band.
MEASURES = ["chars_per_token", "byte_share", "entropy_share"]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, byte_vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: id, the counts, those of each vocabulary, and script."""
    spark = docs.sparkSession
    paths = (vocabulary or default_vocabulary(), byte_vocabulary or vocabulary_path("byte_bpe_50k.json"))
    models = spark.sparkContext.broadcast([open(p, "rb").read() for p in paths])
    rows = docs.select(F.col(id_col).alias("_id"), common.whole(text_col).alias("_text"))
    counts = [*COUNTS, *(f"{c}_{v}" for v in NAMES for c in ("n_tokens", "n_bytes"))]
    entropies = [f"entropy_{v}" for v in NAMES]

    def run(batches):
        splitters = [_splitter(model, kind) for model, kind in zip(models.value, (Splitter, ByteSplitter))]
        for batch in batches:
            at = 0
            for some in spans.chunks(spans.strings(batch.column("_text"))):
                found = measure(some, *splitters)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(at, len(some)), *(pa.array(found[c], pa.int64()) for c in counts), *(pa.array(found[c]) for c in entropies), pa.array(found["script"].tolist(), pa.string())],
                    names=["_id", *counts, *entropies, "script"],
                )
                at += len(some)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"_id {kind}", *(f"{c} long" for c in counts), *(f"{c} double" for c in entropies), "script string"])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def with_measures(measured: DataFrame) -> DataFrame:
    """measured with base_failed and the three measures of each vocabulary; null without a token."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    added = [base.alias("base_failed")]
    for v in NAMES:
        n = F.col(f"n_tokens_{v}").cast("double")
        shares = [F.col("word_chars") / n, F.col(f"n_bytes_{v}") / n, F.col(f"entropy_{v}") / F.log2(F.least(n, F.lit(float(ENTROPY_TOKENS))))]
        added += [F.when(n > least, x).alias(f"{m}_{v}") for m, x, least in zip(MEASURES, shares, (0, 0, 1))]
    return measured.select("*", *added)


def fit_bands(measured: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, least_rows: int = LEAST_ROWS, bands: dict = BANDS) -> dict:
    """Bands of the rows of measured, which should be clean ones; `bands` of scripts with fewer than least_rows.

    The aggregates are one row per script, which the driver collects.
    """
    good = with_measures(measured).where("not base_failed")
    limits = [F.percentile_approx(f"{m}_{v}", q, 100_000).alias(f"{m}_{v}_{k}") for v in NAMES for m in MEASURES for k, q in (("low", quantile), ("high", 1 - quantile))]
    found = {}
    for r in good.groupBy("script").agg(F.count(F.lit(1)).alias("n"), *limits).where(F.col("n") >= least_rows).collect():
        found[r["script"]] = {
            v: (r[f"chars_per_token_{v}_low"] * (1 - margin), r[f"chars_per_token_{v}_high"] * (1 + margin), r[f"byte_share_{v}_high"] * (1 + margin) + 0.01, r[f"entropy_share_{v}_low"] * (1 - margin))
            for v in NAMES
        }
    return {**bands, **found}


def band(vocabulary: str, part: int, bands: dict = BANDS) -> Column:
    """A limit of the document's script."""
    chosen = F.lit(float(bands[DEFAULT_SCRIPT][vocabulary][part]))
    for name, limits in bands.items():
        chosen = F.when(F.col("script") == name, F.lit(float(limits[vocabulary][part]))).otherwise(chosen)
    return chosen


def judged(measured: DataFrame, bands: dict = BANDS) -> DataFrame:
    """measured with base_failed, the measures, and kept."""
    inside = F.lit(True)
    for v in NAMES:
        inside = (
            inside
            & F.col(f"chars_per_token_{v}").between(band(v, 0, bands), band(v, 1, bands))
            & (F.col(f"byte_share_{v}") <= band(v, 2, bands))
            & (F.coalesce(f"entropy_share_{v}", F.lit(0.0)) >= band(v, 3, bands))
        )
    return with_measures(measured).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(measures(common.documents(spark, sf_dir)))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "script", *(f"{m}_{v}" for v in NAMES for m in MEASURES))
