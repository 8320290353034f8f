"""Operator 11: the trie of all conversations' beginnings, level by level.

Conversations that are still together at a depth are grouped by (parent node, next turn) and named by their least id; one
that is alone in its node is no longer live, as the rest of it is a chain. Levels then go up again, each joined with the
sums of the one below. Turns are compared by SHA-256 of role and text, so texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmill.llm import common as C
from webmill.operators.places import places

FAMILY = 20
MOST_SHARED = 4
#: Ids of a node that are joined to one string before they come to the task that hashes them.
IDS = 256
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, pos, turn, words): the turns of each conversation in order, from 1, as hashes, with the words of their texts.

    Null turns come first; of equal turns the order is by role, then by hash. Rows without an id belong to no
    conversation. Repeated rows are turns of their own. A conversation's rows are put in order in ranges, so that no
    task holds all of a long one.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    words = F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("long")
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("at"), role.alias("role"), key.alias("turn"), words.alias("words"))
    return places(rows, [F.asc_nulls_first("at"), F.col("role"), F.col("turn")], ["c"], "pos", C.table).select("c", "pos", "turn", "words")


def rebuild(turns: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Every conversation c begins with the first h turns of conversation c - c % family, h = crc32(decimal c) % most, and goes
    on with its own after its first h: (c, pos, turn, words), and (c, length), which also has conversations without turns."""
    turns = C.table(turns)
    n = C.table(turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    h = (C.crc32_of_id("c") % most).cast("int")
    whole = n.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % family).alias("b"))
    base = n.select(F.col("c").alias("b2"), F.col("n").alias("nb"))
    whole = whole.join(base, F.col("b") == F.col("b2"), "left").select("c", "b", "h", F.least("h", F.coalesce("nb", F.lit(0))).alias("taken"), "n")
    whole = C.table(whole.withColumn("length", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int")))
    first = turns.filter(F.col("pos") < most).select(F.col("c").alias("b2"), "pos", "turn", "words")
    head = whole.filter("taken > 0").join(first, (F.col("b") == F.col("b2")) & (F.col("pos") <= F.col("taken"))).select("c", "pos", "turn", "words")
    own = whole.select(F.col("c").alias("c2"), "h", "taken")
    tail = turns.join(own, F.col("c") == F.col("c2")).filter("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn", "words")
    return head.unionByName(tail), whole.select("c", "length")


def _levels(turns: DataFrame, lengths: DataFrame) -> tuple[C.Levels, C.Levels, int]:
    """Nodes (conv_id, parent, n, words, length of a lone member) and members (c, node, length) of nodes that are shared, by depth."""
    spark = turns.sparkSession
    nodes, members = C.Levels(spark), C.Levels(spark)
    root = lengths.agg(F.min("c").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("words"), F.max("length").alias("length"))
    least, n = nodes.add(root.filter("n > 0"), 0).agg(F.max("conv_id"), F.max("n")).first()
    live = members.add(lengths.filter(F.lit((n or 0) > 1)).select("c", F.lit(least).cast("long").alias("node"), "length"), 0)
    depth = 0
    while not live.isEmpty():
        depth += 1
        next_turn = turns.filter(F.col("pos") == depth).select(F.col("c").alias("c2"), "turn", "words")
        met = C.table(live.join(next_turn, F.col("c") == F.col("c2")).drop("c2"))
        groups = met.groupBy("node", "turn").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"), F.max("length").alias("length"))
        named = nodes.add(groups.select("conv_id", F.col("node").alias("parent"), "n", "words", "length", "turn"), depth)
        shared = named.filter("n > 1").select(F.col("parent").alias("node2"), F.col("turn").alias("turn2"), "conv_id")
        live = members.add(met.join(shared, (F.col("node") == F.col("node2")) & (F.col("turn") == F.col("turn2"))).select("c", F.col("conv_id").alias("node"), "length"), depth)
        C.drop(met)
    return nodes, members, depth


def _rolled(nodes: C.Levels, deepest: int) -> DataFrame:
    """nodes with n_children, n_leaves and saved, from the deepest level up. What is alone has one leaf below it and saves nothing."""
    rolled, below = C.Levels(nodes.spark), None
    for depth in range(deepest, -1, -1):
        level = nodes.at(depth).select("conv_id", "parent", "n", "words", "length")
        if below is None:
            level = level.withColumns({"kids": F.lit(None).cast("long"), "leaves": F.lit(None).cast("long"), "sum": F.lit(None).cast("long")})
        else:
            sums = below.groupBy(F.col("parent").alias("up")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("sum"))
            level = level.join(sums, F.col("conv_id") == F.col("up"), "left").drop("up")
        alone = F.col("n") == 1
        below = rolled.add(
            level.select(
                "conv_id", "parent", "n", "length",
                F.when(alone, (F.col("length") > depth).cast("long")).otherwise(F.coalesce("kids", F.lit(0))).alias("n_children"),
                F.when(alone, 1).otherwise(F.coalesce("leaves", F.lit(1))).cast("long").alias("n_leaves"),
                F.when(alone, 0).otherwise((F.col("n") - 1) * F.col("words") + F.coalesce("sum", F.lit(0))).cast("long").alias("saved"),
            ),
            depth,
        )
    return rolled.all()


def id_hashes(ends: DataFrame) -> DataFrame:
    """(depth, node, sha) of (depth, node, c): SHA-256 of each node's ids in order, joined by commas. Ids are put in order and
    joined in short strings by range; these pass by in the task that hashes a node's, which holds none of them."""

    def pack(batches):
        for b in batches:
            if b.num_rows:
                depth, node, c = (b.column(x).to_numpy() for x in ("depth", "node", "c"))
                new = np.concatenate(([True], (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])))
                start = np.flatnonzero(new)
                place = np.arange(len(c)) - np.repeat(start, np.diff(np.append(start, len(c))))
                cut = np.flatnonzero(place % IDS == 0)
                text = list(map(str, c.tolist()))
                joined = [",".join(text[i:j]) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(c)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(depth[cut]), pa.array(node[cut]), pa.array(c[cut]), pa.array(joined)], ["depth", "node", "first", "ids"])

    def digest(batches):
        of, state, out = None, None, []
        for b in batches:
            for depth, node, ids in zip(*(b.column(x).to_pylist() for x in ("depth", "node", "ids")), strict=True):
                if (depth, node) != of:
                    if of:
                        out.append((*of, state.hexdigest()))
                    of, state = (depth, node), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(("depth", "node", "sha"), r, strict=True)) for r in out], schema=names)
                out = []
        if of:
            out.append((*of, state.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "node", "sha"), r, strict=True)) for r in out], schema=names)

    names = pa.schema([("depth", pa.int32()), ("node", pa.int64()), ("sha", pa.string())])
    packed = C.table(ends.repartitionByRange("depth", "node", "c").sortWithinPartitions("depth", "node", "c").mapInArrow(pack, "depth int, node long, first long, ids string"))
    return packed.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, "depth int, node long, sha string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of all prefixes of the conversations in lengths (c, length), whose turns are (c, pos, turn, words).

    Per node conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. (depth, conv_id) names a node. No conversations, no nodes. As many rounds as the deepest shared prefix
    has turns.
    """
    turns, lengths = C.table(turns), C.table(lengths)
    nodes, members, deepest = _levels(turns, lengths)
    rolled = _rolled(nodes, deepest)
    shared = rolled.filter("n > 1").join(id_hashes(members.all().filter("length = depth").select("depth", "node", "c")).select(F.col("depth").alias("depth2"), "node", "sha"), (F.col("depth") == F.col("depth2")) & (F.col("conv_id") == F.col("node")), "left")
    shared = shared.select("conv_id", "depth", "parent", "n", "n_children", "n_leaves", "saved", F.coalesce("sha", F.lit(NOTHING)).alias("sha"))
    # What is alone goes on as a chain to its end.
    lone = rolled.filter("n = 1").select("*", F.explode(F.sequence("depth", "length")).alias("d"))
    sha = F.when(F.col("d") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING)
    parent = F.when(F.col("d") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id"))
    lone = lone.select("conv_id", F.col("d").alias("depth"), parent.alias("parent"), "n", (F.col("d") < F.col("length")).cast("long").alias("n_children"), "n_leaves", "saved", sha.alias("sha"))
    both = shared.unionByName(lone)
    return both.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt upon the first turns of its family's first."""
    return trie(*rebuild(turns_of(C.read(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH RECURSIVE
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, turn, role, text, sha256(length(role) || ':' || role || text) AS k FROM t),
o AS (SELECT c, k, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, k) AS pos FROM s),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
crc(c, w, i, v) AS (
  SELECT c, c::VARCHAR, 0, 4294967295::BIGINT FROM n
  UNION ALL
  SELECT c, w, i + 1, xor(x >> 1, (x & 1) * 3988292384) FROM (SELECT c, w, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(w, i // 8 + 1, 1))) ELSE v END AS x FROM crc WHERE i < 8 * length(w)) q),
h AS (SELECT c, c - c % 20 AS b, xor(v, 4294967295::BIGINT) % 4 AS h FROM crc WHERE i = 8 * length(w)),
r AS (
  SELECT h.c, o.pos, o.k, o.text FROM h JOIN o ON o.c = h.b AND o.pos <= h.h
  UNION ALL
  SELECT h.c, o.pos - h.h + least(h.h, coalesce(b.n, 0)), o.k, o.text FROM h JOIN o ON o.c = h.c AND o.pos > h.h LEFT JOIN n b ON b.c = h.b),
l AS (SELECT h.c, count(r.c) AS len FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
p AS (
  SELECT c, pos AS d, string_agg(k, ',') OVER (PARTITION BY c ORDER BY pos) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
  UNION ALL SELECT c, 0, '', 0 FROM h),
m AS (SELECT c, d, words, min(c) OVER (PARTITION BY d, path) AS node FROM p),
a AS (SELECT d, node, count(*) AS n, max(words) AS words FROM m GROUP BY d, node),
q AS (SELECT a.d, a.node, a.n, a.words, m.node AS parent FROM a LEFT JOIN m ON m.c = a.node AND m.d = a.d - 1),
k AS (SELECT q.d, q.node, count(z.node) AS kids FROM q LEFT JOIN q z ON z.d = q.d + 1 AND z.parent = q.node GROUP BY q.d, q.node),
u AS (
  SELECT m.d, m.node, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((q.n - 1) * q.words) AS saved
  FROM q JOIN k ON k.d = q.d AND k.node = q.node JOIN m ON m.c = q.node AND m.d <= q.d GROUP BY m.d, m.node),
e AS (SELECT m.d, m.node, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS sha FROM m JOIN l ON l.c = m.c AND l.len = m.d GROUP BY m.d, m.node)
SELECT q.node AS conv_id, q.d::BIGINT AS depth, q.parent AS parent_conv_id, q.n::BIGINT AS n_convs, k.kids::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves,
       u.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM q JOIN k ON k.d = q.d AND k.node = q.node JOIN u ON u.d = q.d AND u.node = q.node LEFT JOIN e ON e.d = q.d AND e.node = q.node
"""
