"""Near duplicates: a similarity join over word n-grams, partitioned vertically.

The n-grams of the corpus have one global order. It is cut into fragments by hash, and each document's set into segments,
one per fragment. Three kinds of work run fragment by fragment and are put together per document or per pair:

1. Frequencies. A task packs the segments of many documents into one row per fragment, so that a shuffle moves columns
   of hashes, not rows. A fragment counts the documents of each n-gram and returns those in two or more. The number of
   fragments grows with the corpus and each has a task of its own, so a task's memory does not. N-grams in a large share
   of all documents are counted beforehand, by the tasks, and skip their fragment, so no fragment holds a group that
   grows with the corpus.
2. Candidates, by a prefix filter: ordered from rare to frequent, two sets with the overlap that a link needs share
   an n-gram early in both. A document without enough shared n-grams has no partner at all and is done.
3. Overlaps. The partial overlaps of a pair are counted in each fragment and summed per pair. A set with many partners
   is salted, so that its pairs spread over tasks.

Documents with equal sets are one node from the start. Pairs are not formed within groups: first every candidate bucket
compares its members with one leader; after that, documents outside the largest component of a bucket are compared
with what is not yet connected to them. A pair that is left out lies within one component, so no link is lost. Of that
second step, rows whose place allows no partner of any size in the bucket are left out before, sizes meet by classes, and
large buckets are cut into blocks on both sides.

Sets are compared by 64-bit hashes of their n-grams, and equal sets found by 128-bit fingerprints.

Defined cases: a null text, or one without words, has an empty set, links with nothing and is its own component; fewer
words than the n-gram's are one n-gram; rows that repeat an id are one node; a null id has no component; a text of any
length is whole; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, spans
from tidemark.llm.components import components

WIDTH = 5
# A link needs 4 * intersection >= 3 * union, which is 7 * intersection >= 3 * (sum of sizes).
#: N-grams of one fragment, on average, and fragments at least.
FRAGMENT, LEAST_FRAGMENTS = 2_000_000, 8
#: An n-gram is counted beforehand if a task meets it in this share of a batch's documents.
HOT_SHARE, HOT_LEAST = 512, 1000
#: N-grams that a task packs at once, and documents.
PACK, PACK_DOCS = 1_000_000, 60_000
#: Fragments in which a pair's overlap is counted: a power of two, by the n-grams that one should hold of the largest set.
OVERLAP_NGRAMS, LEAST_BITS, MOST_BITS = 2048, 2, 6
#: Frequent n-grams that are counted beforehand at most, the most frequent ones; others go through their fragments.
HOT_MOST = 500_000
#: Partners of a set that one salt takes, and rows on each side of a block of a bucket.
PARTNERS, BLOCK = 2000, 2000
#: Keys of sets, of 16 bytes, that a broadcast holds at most.
BROADCAST_ROWS = 100_000


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams."""
    points, text_ends = spans.joined(texts)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    starts, ends = spans.words(points)
    h = spans.hashes(points, starts, ends)
    doc = np.searchsorted(text_ends, starts)
    n = np.bincount(doc, minlength=len(texts))
    full = spans.windows(h, width)
    if len(full):
        fits = doc[: len(full)] == doc[width - 1 :]
        full = full[fits]
    parts = np.split(full, np.cumsum(np.maximum(n - width + 1, 0))[:-1])
    first = np.cumsum(n) - n
    for i in np.flatnonzero((n > 0) & (n < width)):
        parts[i] = spans.windows(h[first[i] : first[i] + n[i]], int(n[i])) + np.uint64(n[i])
    return [np.unique(p) for p in parts]


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits of a set."""
    a = spans.mixed(hashes).sum(dtype=np.uint64)
    b = spans.mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def planes(x: np.ndarray) -> bytes:
    """The bytes of x, all first bytes before all second ones; sorted numbers pack well that way."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def numbers(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T.copy().view(kind).ravel()


def document_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """_id, n_shingles, _key (null for an empty set), and _hot, in one row of each batch: its frequent n-grams."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), common.whole(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            sizes, keys, seen = [], [], {}
            for some in spans.chunks(spans.strings(batch.column("_text"))):
                for s in shingle_sets(some, width):
                    sizes.append(len(s))
                    keys.append(fingerprint(s) if len(s) else None)
                    if len(s):
                        seen.setdefault(keys[-1], s)
            hot: list[dict] = []
            if seen:
                key, count = np.unique(np.concatenate([*seen.values()]), return_counts=True)
                often = count >= max(8, len(seen) // HOT_SHARE)
                hot = [{"h": h, "n": n} for h, n in zip(key[often].view(np.int64).tolist(), count[often].tolist())]
            listed = pa.array([hot] + [None] * (len(sizes) - 1) if sizes else [], pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), listed], names=["_id", "n_shingles", "_key", "_hot"])

    return rows.mapInArrow(spans.freed(run), "_id long, n_shingles long, _key binary, _hot array<struct<h: long, n: long>>")


SEGMENTS = "frag int, keys binary, sizes binary, h binary, owner binary, count binary"


def segments(docs: DataFrame, id_col: str, text_col: str, width: int, fragments: int, hot) -> DataFrame:
    """Rows of packed segments: for a fragment, n-grams (h) and the set each belongs to (owner, into keys and sizes).

    Frequent n-grams go, with their counts, to fragments after the others, by their set's key.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("_text"))

    def packed(sets: dict[bytes, np.ndarray]):
        hot_keys, hot_counts = hot.value
        keys = b"".join(sets)
        sizes = np.fromiter(map(len, sets.values()), np.uint32, len(sets))
        h = np.concatenate([*sets.values()])
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        count = np.zeros(len(h), np.uint32)
        if len(hot_keys):
            spot = np.minimum(np.searchsorted(hot_keys, h), len(hot_keys) - 1)
            count = np.where(hot_keys[spot] == h, hot_counts[spot], 0).astype(np.uint32)
        # Fragments are ranges of hashes, so one sort by hash puts them in order.
        order = np.argsort(np.where(count > 0, ~np.uint64(0), h), kind="stable")
        h, owner, count = h[order], owner[order], count[order]
        plain = int((count == 0).sum())
        frag = fragment_of(h, fragments).astype(np.int32)
        if plain < len(h):
            bucket = np.frombuffer(keys, np.uint64)[0::2] % np.uint64(fragments)
            frag[plain:] = fragments + bucket[owner[plain:]].astype(np.int32)
            order = plain + np.lexsort((h[plain:], frag[plain:]))
            frag[plain:], h[plain:], owner[plain:], count[plain:] = frag[order], h[order], owner[order], count[order]
        cut = np.flatnonzero(np.diff(frag, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(frag)]):
            used, local = np.unique(owner[a:b], return_inverse=True)
            few = np.frombuffer(keys, "V16")[used].tobytes()
            yield int(frag[a]), few, planes(sizes[used]), planes(h[a:b]), planes(local.astype(np.uint16)), planes(count[a:b]) if frag[a] >= fragments else b""

    def run(batches):
        held: dict[bytes, np.ndarray] = {}
        total = 0

        def flush():
            found = [*packed(held)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), [pa.int32()] + [pa.binary()] * 5)], names=["frag", "keys", "sizes", "h", "owner", "count"])

        for batch in batches:
            for some in spans.chunks(spans.strings(batch.column("_text"))):
                for s in shingle_sets(some, width):
                    if len(s) and (key := fingerprint(s)) not in held:
                        held[key] = s
                        total += len(s)
                        # After each set, as owners are 16 bits.
                        if total >= PACK or len(held) >= PACK_DOCS:
                            yield flush()
                            held, total = {}, 0
        if held:
            yield flush()

    return rows.mapInArrow(spans.freed(run), SEGMENTS)


def fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    """Ranges of hashes, in order."""
    return ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows together: distinct keys, their sizes, and n-grams with the key and count of each; no counts if rows have none."""
    keys, sizes, hs, owners, counts, n = [], [], [], [], [], 0
    for row in table.select(["keys", "sizes", "h", "owner", "count"]).to_batches():
        for k, s, h, o, c in zip(*(row.column(i).to_pylist() for i in range(5))):
            keys.append(np.frombuffer(k, np.uint64).reshape(-1, 2))
            sizes.append(numbers(s, np.uint32))
            hs.append(numbers(h, np.uint64))
            owners.append(numbers(o, np.uint16).astype(np.int32) + np.int32(n))
            counts.append(numbers(c, np.uint32) if c else np.zeros(0, np.uint32))
            n += len(keys[-1])
    pairs = np.concatenate(keys)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.ones(n, bool)
    new[1:] = (pairs[order][1:] != pairs[order][:-1]).any(axis=1)
    number = np.empty(n, np.int32)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return pairs[first], np.concatenate(sizes)[first], np.concatenate(hs), number[np.concatenate(owners)], np.concatenate(counts)


SHARED = "bucket int, keys binary, sizes binary, h binary, owner binary, count binary"


def shared_ngrams(packed: DataFrame, fragments: int) -> DataFrame:
    """Of each fragment, the n-grams of two or more sets, packed again by bucket of sets."""

    def run(table: pa.Table) -> pa.Table:
        pairs, sizes, h, owner, count = unpacked(table)
        order = np.lexsort((owner, h))
        h, owner, count = h[order], owner[order], count[order] if len(count) else count
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        if not new.all():
            h, owner, count = h[new], owner[new], count[new] if len(count) else count
        if not len(count):  # frequent n-grams come with theirs, and in fragments of their own
            start = np.flatnonzero(np.diff(h, prepend=~h[:1]))
            n = np.diff(start, append=len(h)).astype(np.uint32)
            count = np.repeat(n, n)
        del order, new
        keep = count > 1
        h, owner, count = h[keep], owner[keep], count[keep]
        bucket = (pairs[:, 0] % np.uint64(fragments)).astype(np.int64)[owner]
        order = np.argsort(bucket, kind="stable")
        h, owner, count, bucket = h[order], owner[order], count[order], bucket[order]
        rows = []
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
            for at in range(a, b, 1 << 22):
                to = min(b, at + (1 << 22))
                used, local = np.unique(owner[at:to], return_inverse=True)
                for u in range(0, len(used), 1 << 16):  # owners are 16 bits
                    inside = (local >= u) & (local < u + (1 << 16))
                    few = used[u : u + (1 << 16)]
                    rows.append((int(bucket[at]), pairs[few].tobytes(), planes(sizes[few]), planes(h[at:to][inside]), planes((local[inside] - u).astype(np.uint16)), planes(count[at:to][inside])))
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.table([pa.array(x, t) for x, t in zip(columns, [pa.int32()] + [pa.binary()] * 5)], names=["bucket", "keys", "sizes", "h", "owner", "count"])

    return packed.repartitionById(2 * fragments, "frag").groupBy("frag").applyInArrow(run, SHARED)


def candidates(shared: DataFrame, fragments: int) -> DataFrame:
    """Sets that can have a partner: _key, n, alone (n-grams of no other set), hs (the others, from rare to frequent)."""

    def run(table: pa.Table) -> pa.Table:
        pairs, sizes, h, owner, count = unpacked(table)
        order = np.lexsort((h, count, owner))
        h, owner = h[order], owner[order]
        held = np.bincount(owner, minlength=len(pairs))
        n = sizes.astype(np.int64)
        can = held >= (3 * n + 3) // 4
        values = h[can[owner]].view(np.int64)
        ends = np.concatenate(([0], np.cumsum(held[can])))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        keys = pa.array([p.tobytes() for p in pairs[can]], pa.binary())
        return pa.table([keys, pa.array(n[can]), pa.array((n - held)[can]), listed], names=["_key", "n", "alone", "hs"])

    return shared.repartitionById(fragments, "bucket").groupBy("bucket").applyInArrow(run, "_key binary, n long, alone long, hs array<long>")


def needed(na: Column, nb: Column) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.floor((3 * (na + nb) + 6) / 7)


def early(a: str, b: str) -> Column:
    """Whether sets whose first common n-gram is at these places can have the overlap they need."""
    need = needed(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return (F.col(f"{a}.pos") <= F.col(f"{a}.n") - need + 1) & (F.col(f"{b}.pos") <= F.col(f"{b}.n") - need + 1)


def pair(a: str, b: str) -> list[Column]:
    return [F.col(f"{x}.{c}").alias(f"{name}{k}") for k, x in (("a", a), ("b", b)) for name, c in (("key_", "_key"), ("rep_", "rep"), ("n_", "n"))]


def with_segments(pairs: DataFrame, stored_pairs: DataFrame, cut: DataFrame, k: str, other: str) -> DataFrame:
    """pairs with seg_k of each fragment; pairs of a set with many partners are spread by salts, over as many copies of its segments."""
    key, salt = f"key_{k}", f"salt_{k}"
    crowded = stored_pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("_salts")).where("_salts > 1")
    few = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
    on_pairs = pairs.join(few, key, "left").withColumn(salt, F.pmod(F.xxhash64(f"key_{other}"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    sides = cut.select(F.col("_key").alias(key), "f", F.col("seg").alias(f"seg_{k}")).join(few, key, "left")
    sides = sides.withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    on = [key, salt, *(["f"] if "f" in pairs.columns else [])]
    return on_pairs.join(sides, on).drop(salt)


def linked(pairs: DataFrame, sets: DataFrame, bits: int) -> DataFrame:
    """The pairs that are links: overlaps are counted in each fragment and summed per pair."""
    pairs = common.stored(pairs.distinct(), "pairs")
    named = pairs.select(F.explode(F.array("key_a", "key_b")).alias("_key")).distinct()
    if named.count() <= BROADCAST_ROWS:  # other sets stay where they are; with more, most sets have a pair
        sets = sets.join(F.broadcast(named), "_key", "left_semi")
    fragment = F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1)))
    cut = sets.select("_key", "hs", fragment.alias("f")).select("_key", "f", F.filter("hs", lambda x: F.shiftrightunsigned(x, 64 - bits) == F.col("f")).alias("seg")).where(F.size("seg") > 0)
    parts = with_segments(with_segments(pairs, pairs, cut, "b", "a"), pairs, cut, "a", "b")
    counted = parts.groupBy("key_a", "key_b", "rep_a", "rep_b", "n_a", "n_b").agg(F.sum(F.size(F.array_intersect("seg_a", "seg_b"))).alias("overlap"))
    return counted.where("7 * overlap >= 3 * (n_a + n_b)").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def size_class(n: Column) -> Column:
    """Sets of linked sizes are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")


def salted_join(rows: DataFrame, each: DataFrame, counts: DataFrame) -> DataFrame:
    """rows joined with each, which has one row for an n-gram, on h. An n-gram of many rows is dealt by set to as many salts as they need.

    counts: h and many, the rows of each n-gram.
    """
    crowded = common.stored(counts.where(F.col("many") > PARTNERS).select("h", F.ceil(F.col("many") / PARTNERS).cast("int").alias("_salts")), "crowded")
    few = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(few, "h", "left").withColumn("_salt", F.pmod(F.xxhash64("_key"), salts).cast("int")).drop("_salts")
    right = each.join(few, "h", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, ["h", "_salt"]).drop("_salt")


def blocked(known: DataFrame) -> DataFrame:
    """Pairs of sets of different components that share an early n-gram, without those of the largest component of each."""
    bounds = common.stored(known.groupBy("h").agg(F.min("n").alias("least_n"), F.count(F.lit(1)).alias("many")), "bounds")
    least = F.greatest("least_n", F.floor((3 * F.col("n") + 3) / 4))
    able = salted_join(known, bounds.drop("many"), bounds).where(F.col("pos") <= F.col("n") - needed(F.col("n"), least) + 1).drop("least_n")
    # Of each n-gram, the component with the most sets; all others are compared with every set not connected to them.
    sizes = able.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("many"))
    largest = sizes.groupBy("h").agg(F.max(F.struct("many", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("many").alias("ny")).where("comps > 1")  # at most a row for each n-gram
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    largest = largest.select("h", F.col("top.comp").alias("top"), blocks(F.col("ny")).alias("ky"), blocks(F.col("ny") - F.col("top.many")).alias("kx"))
    rows = common.stored(salted_join(able, largest, bounds).select("*", (F.col("comp") == F.col("top")).alias("in_top"), size_class(F.col("n")).alias("cls")), "open-candidates")
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    x = rows.where("not in_top").withColumn("bx", F.pmod(F.xxhash64("_key"), F.col("kx")).cast("int")).withColumn("by", upto("ky"))
    x = x.withColumn("cls", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)))
    y = rows.withColumn("by", F.pmod(F.xxhash64("_key"), F.col("ky")).cast("int")).withColumn("bx", upto("kx"))
    x, y = x.alias("x"), y.alias("y")
    together = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("h", "cls", "bx", "by")]
    meets = (F.col("x.comp") != F.col("y.comp")) & early("x", "y") & (F.col("y.in_top") | (F.col("x._key") < F.col("y._key")))
    return x.join(y, [*together, meets]).select(*pair("x", "y"))


def join_components(sets: DataFrame, bits: int) -> DataFrame:
    """node, component over the links between sets (_key, rep, n, alone, hs), for nodes with a link."""
    early_n = F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1 - F.col("alone")
    rows = common.stored(
        sets.select("_key", "rep", "n", "alone", F.posexplode(F.slice("hs", F.lit(1), F.greatest(early_n, F.lit(0)).cast("int"))).alias("i", "h"))
        .select("h", "_key", "rep", "n", (F.col("alone") / F.col("n")).alias("odd"), (F.col("alone") + F.col("i") + 1).alias("pos")),
        "candidates",
    )
    # One leader for each n-gram: the set with the least share of n-grams of its own.
    leaders = rows.groupBy("h").agg(F.min(F.struct("odd", "rep", "_key", "n", "pos")).alias("lead"), F.count(F.lit(1)).alias("many")).where("many > 1")
    leaders = common.stored(leaders, "leaders")
    met = salted_join(rows.select("h", "_key", F.struct("_key", "rep", "n", "pos").alias("r")), leaders.select("h", F.col("lead").alias("l")), leaders)
    first = common.stored(linked(met.where((F.col("l._key") != F.col("r._key")) & early("l", "r")).select(*pair("l", "r")), sets, bits), "links")
    by_first = common.stored(components(first), "components")

    known = rows.join(by_first, rows["rep"] == by_first["node"], "left").select(rows["*"], F.coalesce("component", "rep").alias("comp"))
    second = linked(blocked(common.stored(known, "candidates")), sets, bits)
    named = second.join(by_first.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(by_first.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    bridges = components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    nodes = by_first.unionByName(bridges.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    return nodes.join(bridges.select(F.col("node").alias("component"), F.col("component").alias("final")), "component", "left").select("node", F.coalesce("final", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id."""
    spark = docs.sparkSession
    found = common.stored(document_sets(docs, id_col, text_col, width), "sets")
    totals = found.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("docs"), F.coalesce(F.max("n_shingles"), F.lit(0)).alias("most")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, (totals["most"] // OVERLAP_NGRAMS).bit_length()))
    fragments = max(LEAST_FRAGMENTS, -(-totals["n"] // FRAGMENT))
    often = found.select(F.explode("_hot").alias("x")).groupBy("x.h").agg(F.sum("x.n").alias("n")).where(F.col("n") >= max(HOT_LEAST, totals["docs"] // HOT_SHARE))
    hot = often.orderBy(F.desc("n"), "h").limit(HOT_MOST).toArrow()
    hot_keys, hot_counts = hot.column("h").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(hot_keys)
    shared_hot = spark.sparkContext.broadcast((hot_keys[order], hot_counts[order].astype(np.uint32)))

    classes = found.where("_key is not null and _id is not null").groupBy("_key").agg(F.min("_id").alias("rep"))
    packed = segments(docs, id_col, text_col, width, fragments, shared_hot)
    sets = common.stored(candidates(shared_ngrams(packed, fragments), fragments).join(classes, "_key"), "candidate-sets")
    comps = join_components(sets, bits)
    of_class = classes.join(comps, classes["rep"] == comps["node"], "left").select("_key", F.coalesce("component", "rep").alias("component_id"))
    rows = found.select("_id", "n_shingles", "_key")
    return rows.join(of_class, "_key", "left").select(
        F.col("_id").alias(id_col),
        "n_shingles",
        F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of docs that are the smallest id of their component; rows without an id stay. All columns stay as they are."""
    found = near_duplicates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width=width)
    keep = common.fresh(docs, "keep")
    first = found.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias(keep)).distinct()
    return docs.join(first, F.col(id_col).eqNullSafe(F.col(keep)), "left_semi")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 7 * o >= 3 * (na.n + nb.n)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
