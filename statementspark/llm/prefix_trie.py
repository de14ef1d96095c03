"""The prefix trie of conversations, rolled up by pointer jumping.

**Nodes.** A sequence of turns has a digest: two 64-bit sums (exclusive or) of hashes of every turn's place and content, so that the digest of
each prefix is a running sum over a conversation, and a node's parent is its own digest less its last turn. What is
summed are SHA-256 digests of (role, text) mixed with the place; texts never move.

**Rollup.** Every node points at its parent and holds its own leaf count and savings. In round k each node gives its sum to the node it
points at, 2^k levels up, and then points where that one points: after round k a node holds the sum of its descendants less than
2^(k+1) levels below it. So ceil(log2(depth + 1)) rounds serve all ancestors, with equi-joins by digest and sums that are aggregated
before they move. Nodes whose pointer would leave the root take no part any more, so later rounds only hold deep ones. The state
of each round is written to the shared folder.

**Conversations that end at a node** stream through a task sorted by number, and are hashed as they pass, so a node where a third of all
conversations ends takes no memory.

Null id: a conversation without a number, whose decimal is the empty string and which has no other's turns before it. Null turn: before
all others. Null role or text: empty. Equal turns: by the digest of role and text; repeated rows: each is a turn. Empty or very long
texts: whole. Empty table: no nodes, not even a root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FAMILY, MOST = 5, 9
NODE = ("depth", "a", "b")


def _decimal(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(""))


def rebuild(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): each conv_id with ``n`` turns after it was rebuilt, and their (conv_id, pos, digest, bytes).

    A family of conversations shares the beginning of its first one; all its rows meet by one exchange.
    """
    empty = lambda c: F.coalesce(rows[c].cast("string"), F.lit(""))
    role, text = empty("role"), empty("text")
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    conv = rows["conv_id"].cast("long")
    turns = rows.select(conv.alias("conv_id"), rows["turn"].cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    turns = turns.withColumn("family", _decimal(F.col("conv_id") - F.col("conv_id") % FAMILY))
    order = Window.partitionBy("family", "conv_id").orderBy(F.asc_nulls_first("turn"), "digest", "bytes")
    turns = materialize(turns.repartition("family").withColumn("i", F.row_number().over(order) - 1).drop("turn"), "trie-turns")
    shared = F.when(F.col("conv_id").isNull(), 0).otherwise(F.crc32(_decimal(F.col("conv_id")).cast("binary")) % MOST)
    convs = turns.groupBy("family", "conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("h", shared)
    heads = convs.where(_decimal(F.col("conv_id")) == F.col("family")).select("family", F.col("own").alias("there"))
    convs = convs.join(heads, "family", "left").withColumn("base", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("family", F.col("conv_id").alias("c"), "h", "base", (F.col("base") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n")), "trie-convs")
    # At most eight turns of a family's first conversation go to each of its members.
    first = turns.where((_decimal(F.col("conv_id")) == F.col("family")) & (F.col("i") < MOST)).select("family", "i", "digest", "bytes")
    given = first.join(convs, "family").where("i < base").select(F.col("c").alias("conv_id"), F.col("i").alias("pos"), "digest", "bytes")
    mine = turns.join(convs.drop("family"), turns["conv_id"].eqNullSafe(convs["c"])).where("i >= h")
    own = mine.select("conv_id", (F.col("base") + F.col("i") - F.col("h")).alias("pos"), "digest", "bytes")
    return convs.select(F.col("c").alias("conv_id"), "n"), given.unionByName(own)


def nodes_of(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): every node with the digest of its parent, and the node at which each conversation ends."""
    mixed = [F.xxhash64(F.lit(k), "digest", "pos") for k in (1, 2)]
    paths = turns.select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "bytes", mixed[0].alias("x"), mixed[1].alias("y"))
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    paths = paths.withColumns({"a": F.bit_xor("x").over(upto), "b": F.bit_xor("y").over(upto)})
    paths = materialize(paths, "trie-paths")
    nodes = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first(F.col("a").bitwiseXOR(F.col("x"))).alias("pa"), F.first(F.col("b").bitwiseXOR(F.col("y"))).alias("pb"), F.first("bytes").alias("bytes")
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("bytes"))
    last = convs.withColumnRenamed("conv_id", "c")
    ends = paths.join(last, paths["conv_id"].eqNullSafe(last["c"]) & (paths["depth"] == last["n"])).select(*NODE, "conv_id")
    ends = ends.unionByName(convs.where("n = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
    return nodes.unionByName(root), ends


def _renamed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns])


def roll_up(nodes: DataFrame, value_cols: tuple[str, ...], depth: int) -> DataFrame:
    """``nodes`` with each of ``value_cols`` summed over the node's subtree, by doubling."""
    sums = [F.sum(c).alias(c) for c in value_cols]
    state, own, step, frames = nodes.select(*NODE, "pa", "pb", *value_cols), value_cols, 1, ()
    while step <= depth:
        given = state.where("pa IS NOT NULL").groupBy((F.col("depth") - step).alias("g_depth"), F.col("pa").alias("g_a"), F.col("pb").alias("g_b")).agg(*[s.alias("g_" + c) for s, c in zip(sums, own, strict=True)])
        out = state.join(given, (F.col("depth") == F.col("g_depth")) & (F.col("a") == F.col("g_a")) & (F.col("b") == F.col("g_b")), "left")
        out = out.select(*NODE, "pa", "pb", *[(F.col(c) + F.coalesce("g_" + c, F.lit(0))).alias(c) for c in own])
        # Where the node that it points at points: only nodes at least twice as deep have a next pointer.
        above = _renamed(state.where("pa IS NOT NULL"), "u_", *NODE, "pa", "pb")
        far = out.where(F.col("depth") >= 2 * step).join(above, (F.col("depth") - step == F.col("u_depth")) & (F.col("pa") == F.col("u_a")) & (F.col("pb") == F.col("u_b")))
        near = out.where(F.col("depth") < 2 * step).withColumns({"pa": F.lit(None).cast("long"), "pb": F.lit(None).cast("long")})
        moved = far.select(*NODE, F.col("u_pa").alias("pa"), F.col("u_pb").alias("pb"), *own)
        state = materialize(moved.unionByName(near), "trie-round", frames)
        frames, step = (state,), 2 * step
    return state.drop("pa", "pb")


def _hash_ends(batches):
    """Rows (node, conversation) sorted by both: each node's hash of its conversations' numbers."""
    node, sha, first = None, None, True
    names = ["e_depth", "e_a", "e_b", "ends_sha256"]

    def batch_of(done):
        columns = list(zip(*done, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 3 else pa.int64()) for k, x in enumerate(columns)], names=names)

    for batch in batches:
        done = []
        for depth, a, b, conv in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if sha is None or (depth, a, b) != node:
                if sha is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha, first = (depth, a, b), hashlib.sha256(), True
            sha.update((("" if first else ",") + ("" if conv is None else str(conv))).encode())
            first = False
        yield batch_of(done)
    if sha is not None:
        yield batch_of([(*node, sha.hexdigest())])


def build(rows: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations (conv_id, turn, role, text), as the contract names its columns."""
    nodes, ends = nodes_of(*rebuild(rows))
    nodes = materialize(nodes, "trie-nodes")
    up = nodes.where("pa IS NOT NULL").groupBy((F.col("depth") - 1).alias("k_depth"), F.col("pa").alias("k_a"), F.col("pb").alias("k_b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(up, (F.col("depth") == F.col("k_depth")) & (F.col("a") == F.col("k_a")) & (F.col("b") == F.col("k_b")), "left").drop("k_depth", "k_a", "k_b")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}), "trie-linked")
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    summed = _renamed(roll_up(nodes, ("n_leaves", "saved_tokens"), depth), "s_", *NODE, "n_leaves", "saved_tokens")
    parents = _renamed(nodes, "p_", *NODE, "conv_id")
    hashed = ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(_hash_ends, "e_depth long, e_a long, e_b long, ends_sha256 string")
    same = lambda p: (F.col("depth") == F.col(f"{p}_depth")) & (F.col("a") == F.col(f"{p}_a")) & (F.col("b") == F.col(f"{p}_b"))
    out = nodes.drop("n_leaves", "saved_tokens").join(summed, same("s")).join(hashed, same("e"), "left")
    out = out.join(parents, (F.col("depth") - 1 == F.col("p_depth")) & (F.col("pa") == F.col("p_a")) & (F.col("pb") == F.col("p_b")), "left")
    nothing = F.sha2(F.lit(""), 256)
    return out.select(
        "conv_id", "depth", F.col("p_conv_id").alias("parent_conv_id"), "n_convs", "n_children", F.col("s_n_leaves").alias("n_leaves"), F.col("s_saved_tokens").alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
