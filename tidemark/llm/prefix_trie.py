"""A trie of conversation prefixes, with subtree totals by leaf-peeling message passing.

A node is a distinct sequence of first turns; its smallest member and its depth name it. Turns become digests, and each
conversation's sorted stream of digests becomes a chain of SHA-256 values, one per prefix, with a running state only. An
aggregate over these values makes the nodes.

Totals go from the leaves to the root. A node holds a counter of its unfinished children; when it is 0, the node is
finished and sends its totals to its parent, whose messages are summed before they are delivered. A node with one
unfinished child left points at it: its total is what it holds plus the child's. While that child has one child left
too, the node takes over what the child holds and points further down, so long conversations without branches take
rounds in the logarithm of their length. Which child is left follows from the exclusive or of the children's ids. Each
round is a stored table of the nodes still open and those it finished.

The ids of the conversations that end at a node are joined by ranges of ids, which bounds every list, and the ranges are
hashed one after the other.

Defined cases: a null conversation id is no conversation, and its rows are left out; a null turn comes first; turns of
equal number go by role, then by the SHA-256 of role and text, so rows that repeat are turns of their own, one after the
other; null roles and texts are empty; a text of any length is whole; a conversation without turns is a member of the
root only; an empty table has no root; other columns are not read, whatever their names. One conversation's turns are
sorted and chained in one task, with spilling and without being gathered.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Conversations that share the head of the first one, and turns of a head at most.
FAMILY, HEADS = 20, 4
#: Ids whose list is joined at once.
RANGE = 4096
_ROOT = hashlib.sha256(b"").digest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest, words: the turns of each conversation in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), common.words(text).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "digest", "words")


def head_length() -> Column:
    return F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id, part, pos, digest, words: a start of each conversation (part 0), the head of its family (1) and its own turns after as many (2)."""
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = rows.where("pos = 0").select("conv_id", first.alias("_family"), head_length().alias("_h"))
    heads = rows.where((F.col("conv_id") == first) & (F.col("pos") < HEADS - 1)).select(F.col("conv_id").alias("_family"), "pos", "digest", "words")
    given = convs.join(heads, "_family").where(F.col("pos") < F.col("_h")).select("conv_id", F.lit(1).alias("part"), "pos", "digest", "words")
    own = rows.where(F.col("pos") >= head_length()).select("conv_id", F.lit(2).alias("part"), "pos", "digest", "words")
    start = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return start.unionByName(given).unionByName(own)


MEMBERS = "conv_id long, depth long, node binary, parent binary, words long, ends boolean"


def members(parts: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one included: its node's digest and its parent's."""

    def run(batches):
        held, state, depth = None, _ROOT, 0
        for batch in batches:
            found = []
            for conv, digest, words in zip(*(c.to_pylist() for c in batch.columns)):
                parent = None
                if digest is None:
                    state, depth = _ROOT, 0
                else:
                    parent, depth = state, depth + 1
                    state = hashlib.sha256(parent + digest).digest()
                if held:
                    found.append((*held, digest is None))
                held = (conv, depth, state, parent, words)
            yield made(found)
        if held:
            yield made([(*held, True)])

    def made(rows):
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["conv_id", "depth", "node", "parent", "words", "ends"])

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return ordered.select("conv_id", "digest", "words").mapInArrow(run, MEMBERS)


def end_digests(rows: DataFrame) -> DataFrame:
    """node, ends_sha256: of the ids of conversations that end there, ascending, with commas between."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    ranges = rows.where("ends").groupBy("node", F.floor(F.col("conv_id") / RANGE).alias("_range")).agg(ids.alias("ids"))

    def run(batches):
        node, digest = None, None
        for batch in batches:
            found = []
            for own, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    found.append((node, digest.hexdigest()))
                node, digest = own, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    return ranges.repartition("node").sortWithinPartitions("node", "_range").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def nodes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, words, n_children, rest (exclusive or of the children's ids), ends_sha256."""
    plain = rows.groupBy("node", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    plain = common.stored(plain.join(end_digests(rows), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)), "trie-plain")
    # Nearly every first turn hangs at the root, which is one row; other parents are met by a join.
    root = plain.where("depth = 0").select(F.col("conv_id").alias("parent_conv_id"))
    at_root = plain.where("depth = 1").join(F.broadcast(root))
    parents = plain.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deeper = plain.where("depth > 1").join(parents, "parent")
    every = plain.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).unionByName(at_root).unionByName(deeper).drop("node", "parent")
    every = common.stored(every, "trie-edges")
    children = every.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), F.bit_xor("conv_id").alias("rest"))
    return every.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


KEY = ["conv_id", "depth"]


def _open_state(found: DataFrame) -> DataFrame:
    """State of the nodes before the first round: left (unfinished children), rest, to_conv and to_depth (the child pointed at), leaves, saved."""
    leaf = F.col("n_children") == 0
    one = F.col("n_children") == 1
    return found.select(
        "conv_id", "depth", F.col("parent_conv_id").alias("parent"), F.col("n_children").alias("left"), "rest",
        F.when(one, F.col("rest")).alias("to_conv"), F.when(one, F.col("depth") + 1).alias("to_depth"),
        F.when(leaf, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )


def _round(state: DataFrame) -> DataFrame:
    """The nodes that state had open, after its finished ones have sent their totals and pointers have moved down."""
    done, fields = state.where("left = 0"), state.columns
    # Messages to parents with several children left; of the sums, each parent gets one row.
    sent = done.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("conv_id").alias("x"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
    )
    left = F.col("left") - F.coalesce("n", F.lit(0))
    many = (
        state.where("left > 1").join(sent, KEY, "left")
        .withColumn("left", left)
        .withColumn("rest", F.when(F.col("x").isNull(), F.col("rest")).otherwise(F.col("rest").bitwiseXOR(F.col("x"))))
        .withColumn("to_conv", F.when(F.col("left") == 1, F.col("rest")))
        .withColumn("to_depth", F.when(F.col("left") == 1, F.col("depth") + 1))
        .withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0)))
        .withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        .select(*fields)
    )
    single = _follow(state.where("left = 1"), done)
    both = many.unionByName(single)
    return both.where("left <> 1").unionByName(_follow(both.where("left = 1"), both.where("left < 2")))


def _follow(single: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes with one child left, each with what the node that it points at holds, if that is below; the pointer moves to where that one's points."""
    held = below.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("left").alias("_left"), F.col("to_conv").alias("_conv"), F.col("to_depth").alias("_depth"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    met = F.col("_left").isNotNull()
    moved = single.join(held, ["to_conv", "to_depth"], "left").select(
        "conv_id", "depth", "parent", F.coalesce("_left", "left").alias("left"), "rest",
        F.when(met, F.col("_conv")).otherwise(F.col("to_conv")).alias("to_conv"), F.when(met, F.col("_depth")).otherwise(F.col("to_depth")).alias("to_depth"),
        (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
    )
    return moved


def subtree_totals(found: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens of all nodes."""
    state = common.stored(_open_state(found), "trie-state")
    finished = [state]
    while not state.where("left > 0").isEmpty():
        state = common.stored(_round(state), "trie-state")
        finished.append(state)
    every = finished[0]
    for more in finished[1:]:
        every = every.unionByName(more)
    return every.where("left = 0").select("conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = common.stored(members(rebuilt(common.stored(turns(conversations), "trie-turns"))), "trie-members")
    found = common.stored(nodes(rows), "trie-nodes")
    return found.join(subtree_totals(found), KEY).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(common.table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t256 AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS tab FROM range(256) r(i)
), c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT conv_id, turn, role, sha256(length(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM c
), o AS (
  SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, role, k) AS l FROM k GROUP BY conv_id
), h AS (
  SELECT conv_id, l, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
         lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 4 AS h FROM o CROSS JOIN t256
), r AS (
  SELECT i.conv_id, list_concat(coalesce(b.l[1:h], []), coalesce(i.l[h + 1:], [])) AS s FROM h i LEFT JOIN o b ON b.conv_id = i.conv_id - i.conv_id % 20
), m AS (
  SELECT conv_id, d, len(s) AS n, sha256(array_to_string([x.k FOR x IN s[1:d]], ',')) AS p,
         CASE WHEN d > 0 THEN sha256(array_to_string([x.k FOR x IN s[1:d - 1]], ',')) END AS pp, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)
), n AS (
  SELECT p, any_value(pp) AS pp, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM m GROUP BY p, d
), ch AS (
  SELECT pp AS p, count(*) AS n_children FROM n WHERE pp IS NOT NULL GROUP BY pp
), u AS (
  SELECT a.p, count(*) FILTER (WHERE ch.p IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.w)::BIGINT AS saved_tokens
  FROM n x JOIN m a ON a.conv_id = x.conv_id AND a.d <= x.depth LEFT JOIN ch ON ch.p = x.p GROUP BY a.p
)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
FROM n JOIN u ON u.p = n.p LEFT JOIN ch ON ch.p = n.p LEFT JOIN n q ON q.p = n.pp
"""
