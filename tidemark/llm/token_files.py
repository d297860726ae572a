"""Token ids in Arrow files of equal-length sequences.

A file is an Arrow IPC file whose batches hold two fixed-size lists, `tokens` and `mask`, of `sequence` items; all
batches but the last have `per_batch` sequences. The place of any token follows by division, so a reader that maps the
file reaches any sequence, or any document's ids, without copying. A second file beside it lists the documents: id,
start within the file, number of ids. Documents follow one another in ascending id, each closed by an end id; the last
sequence of a file is filled up with end ids under a false mask.

Documents are range-partitioned by id, so each task writes the files of one range, and the files in order are the corpus
in order. Every attempt of a task writes under names of its own, and the manifest, a row per file, commits them: Spark
keeps the rows of one attempt of each task, so files of lost or repeated attempts are in no manifest and never read.
Nothing is renamed. Offsets are sums over the manifest; each file is read back by a task of its own.

Texts are cut at the vocabulary's added tokens first, which get their own ids, as the library does by default.

Defined cases: a null or empty text has its end id alone; null ids come first; rows that repeat an id follow one
another, ordered by a hash of their texts; a text of any length is whole; an empty table writes no file; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common, spans

SEQUENCE, PER_BATCH = 2048, 256
MANIFEST = "file string, docs_file string, part long, n_docs long, n_ids long, sequence long, per_batch long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def library_encoder(vocabulary: str):
    """A byte-level model of the tokenizers library, and a function from pre-tokens to their ids and how many each has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(vocabulary)
    piece_bytes = np.zeros(model.get_vocab_size(), np.int64)  # a piece of a byte-level vocabulary has a character for each byte
    for piece, i in model.get_vocab(with_added_tokens=False).items():
        piece_bytes[i] = len(piece)

    def encode(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [tokens[k : k + 1000] for k in range(0, len(tokens), 1000)]
        ids = np.array([i for x in model.encode_batch_fast(runs, is_pretokenized=True, add_special_tokens=False) for i in x.ids], np.uint32)
        # Each token's ids end where their bytes do.
        upto, ends = np.cumsum(piece_bytes[ids]), np.cumsum([len(t.encode()) for t in tokens])
        last = np.searchsorted(upto, ends)
        if len(last) and last[-1] == len(ids) - 1 and (upto[last] == ends).all():
            return ids, np.diff(last, prepend=-1)
        return spans.listed([x.ids for x in model.encode_batch_fast(tokens, add_special_tokens=False)])

    return model, encode


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """Ids of spans by the tokenizers library, each distinct pre-token once; the type that holds every id; the added tokens."""
    model, encode = library_encoder(vocabulary)
    kind = np.uint16 if model.get_vocab_size() <= 1 << 16 else np.uint32
    added = model.get_added_tokens_decoder()
    if any(x.single_word or x.lstrip or x.rstrip for x in added.values()):
        raise ValueError("added tokens that take in their surroundings are not supported")
    return spans.Resolved(encode), kind, {x.content: i for i, x in added.items()}


def cut_at(texts: list[str], added: dict[str, int], end_id: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts cut at added tokens, the longest first: pieces, the id after each (end_id after a text), pieces of each text."""
    if not any(x in t for x in added for t in texts):
        return texts, np.full(len(texts), end_id), np.ones(len(texts), np.int64)
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    cuts = [pattern.split(t) for t in texts]
    after = [i for c in cuts for i in (*(added[x] for x in c[1::2]), end_id)]
    return [x for c in cuts for x in c[0::2]], np.array(after), np.array([len(c) // 2 + 1 for c in cuts])


class _Writer:
    """Packs ids into sequences and writes them and the documents' list, under names that no other attempt has."""

    def __init__(self, folder: str, part: int, kind, end_id: int, sequence: int, per_batch: int):
        self.files, base = arrow_fs.FileSystem.from_uri(folder)
        self.kind, self.end_id, self.sequence, self.per_batch = kind, end_id, sequence, per_batch
        name = f"{base}/part-{part:07d}-{uuid.uuid4().hex}"
        self.names = [f"{name}.arrow", f"{name}.docs.arrow"]
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("tokens", pa.list_(item, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.docs_schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64())])
        self.sinks = [self.files.open_output_stream(x) for x in self.names]
        self.out = [pa.ipc.new_file(s, schema) for s, schema in zip(self.sinks, (self.schema, self.docs_schema))]
        self.held, self.n_held, self.n_ids, self.n_docs = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of whole documents, end ids included, and how many each has."""
        starts = self.n_ids + np.cumsum(sizes) - sizes
        self.out[1].write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.docs_schema))
        self.n_docs += len(sizes)
        self.n_ids += len(ids)
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        if self.n_held >= self.sequence * self.per_batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat, block = np.concatenate(self.held), self.sequence * self.per_batch
        whole = len(flat) if last else len(flat) // block * block
        for at in range(0, whole, block):
            ids = flat[at : min(at + block, whole)]
            short = -len(ids) % self.sequence
            mask = np.arange(len(ids) + short) < len(ids)
            ids = np.concatenate((ids, np.full(short, self.end_id, self.kind)))
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
            self.out[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.n_held:
            self._flush(True)
        for x in (*self.out, *self.sinks):
            x.close()


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, sequence: int = SEQUENCE, per_batch: int = PER_BATCH) -> DataFrame:
    """Writes the files and returns their manifest, one row per file."""
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    arrow_fs.FileSystem.from_uri(folder)[0].create_dir(arrow_fs.FileSystem.from_uri(folder)[1], recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), common.whole(text_col).alias("_text"))
    ordered = rows.repartitionByRange("_id").sortWithinPartitions("_id", F.xxhash64("_text"))

    def run(batches):
        from pyspark import TaskContext

        part, writer = TaskContext.get().partitionId(), None
        resolved, kind, added = _encoder(model.value)
        for batch in batches:
            at = 0
            for some in spans.chunks(spans.strings(batch.column("_text"))):
                pieces, after, many = cut_at(some, added, end_id)
                points, piece_ends = spans.joined(pieces)
                starts, ends = spans.pretokens(points)
                ids, size = resolved.ids(points, starts, ends)
                upto = np.concatenate(([0], np.cumsum(size)))[spans.per_text(starts, piece_ends)]
                ids = np.insert(ids, upto, after)
                sizes = np.diff(upto[np.cumsum(many) - 1], prepend=0) + many
                writer = writer or _Writer(folder, part, kind, end_id, sequence, per_batch)
                writer.add(batch.column("_id").slice(at, len(some)), ids, sizes)
                at += len(some)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"file": writer.names[0], "docs_file": writer.names[1], "part": part, "n_docs": writer.n_docs, "n_ids": writer.n_ids, "sequence": sequence, "per_batch": per_batch}])

    return common.stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")


class TokenFile:
    """Random access to one file; local files are mapped, not read."""

    def __init__(self, path: str, sequence: int, per_batch: int, files: arrow_fs.FileSystem):
        local = isinstance(files, arrow_fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else files.open_input_file(path))
        self.sequence, self.block, self.at, self.flat = sequence, sequence * per_batch, -1, None

    def batch(self, k: int) -> np.ndarray:
        """The ids of batch k, as a view."""
        if k != self.at:
            self.at, self.flat = k, self.reader.get_batch(k).column("tokens").flatten().to_numpy(zero_copy_only=True)
        return self.flat

    def pieces(self, start: int, n: int):
        """Views of ids start to start + n - 1, one per batch that holds some."""
        while n > 0:
            k, offset = divmod(start, self.block)
            piece = self.batch(k)[offset : offset + n]
            yield piece
            start, n = start + len(piece), n - len(piece)

    def ids(self, start: int, n: int) -> np.ndarray:
        return np.concatenate([*self.pieces(start, n)]) if n else np.empty(0, np.uint16)

    def n_masked(self) -> int:
        """Ids under a true mask."""
        return sum(int(self.reader.get_batch(k).column("mask").flatten().true_count) for k in range(self.reader.num_record_batches))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    # A task for each file; the number is explicit, so that adaptive execution doesn't merge them.
    last = manifest.agg(F.max("part").alias("x")).first()["x"]
    spread = placed.repartitionById(1 if last is None else last + 1, F.col("part").cast("int"))

    def run(batches):
        files = arrow_fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["file"], row["sequence"], row["per_batch"], files)
                if tokens.n_masked() != row["n_ids"]:
                    raise ValueError(f"{row['file']} holds {tokens.n_masked()} ids, its manifest {row['n_ids']}")
                with files.open_input_file(row["docs_file"]) as source:
                    listed = pa.ipc.open_file(source)
                    for k in range(listed.num_record_batches):
                        part = listed.get_batch(k)
                        sums = []
                        for start, n in zip(part.column("start").to_pylist(), part.column("n_ids").to_pylist()):
                            crc = 0
                            for piece in tokens.pieces(start, n):
                                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        starts = pa.compute.add(part.column("start"), row["_before"])
                        yield pa.RecordBatch.from_arrays([part.column("id"), starts, part.column("n_ids"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "tokens")
    return read_token_files(write_token_files(common.documents(spark, sf_dir), folder), folder)
