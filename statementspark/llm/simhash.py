"""Near duplicates by SimHash: a self-join of a binary trie over fingerprints, then connected components.

**Fingerprints** (:func:`fingerprints`). Word shingles are hashed in the JVM; a task then adds up the bits of each
document's hashes with numpy. Only (id, fingerprint) leaves the task.

**Links** (:func:`links`). Fingerprints are made distinct first, so a third of all rows being one copy costs nothing.
They form a binary trie, which is walked some levels at a time: a frontier row is a pair of nodes at the same
depth with the number of bits that differ so far; one step brings together the children of both whose new bits differ in no more
than is left of the budget. In the first half a child names the few it may pair with, so pairs grow with the fingerprints
and not with the product of children; below, nodes hold few. A node is paired with itself only while
it holds two fingerprints. Of ``d`` differing bits, one half of the 64 holds at most d // 2, so there are two walks,
one with the halves exchanged, and each allows only d // 2 in its first half: that keeps the frontier in
proportion to the fingerprints, with nothing lost. Where two nodes hold many fingerprints, their pairs are dealt out by
node pair, never all rows to one task.

**Components** (:func:`components`). Links are contracted by alternating large-star and small-star steps until
nothing changes; links live in files of the shared folder, never on the driver.

Null, empty or blank text: fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence is
the shingle. Null ids: ids like any other for the fingerprint, ignored as component ids unless a component has no
other. Repeated rows: one row out for each row in. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import materialize, words_of

DISTANCE = 3
SHINGLE = 3
#: Depths at which a walk stops to prune; the last is the whole fingerprint.
DEPTHS = (16, 24, 32, 40, 48, 64)


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of all word shingles of the ASCII-lower-cased text, repeats included."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = words_of(lowered)
    joined = F.transform(F.sequence(F.lit(0), F.size("__w") - shingle), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(F.col("__w"), i + k) for k in range(shingle)])))
    return words, F.when(F.size("__w") == 0, F.array().cast("array<bigint>")).when(F.size("__w") < shingle, F.array(F.xxhash64(F.concat_ws(" ", "__w")))).otherwise(joined)


def fold_bits(hashes: pa.Array) -> np.ndarray:
    """One fingerprint for each list of hashes: a bit is 1 if it is set in over half of them."""
    sizes = np.asarray(hashes.value_lengths().fill_null(0), np.int64)
    values = np.asarray(hashes.flatten()).view(np.uint64)
    ends = np.cumsum(sizes)
    out = np.zeros(len(sizes), np.uint64)
    step = 1 << 18
    sums = np.zeros((len(sizes), 64), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for lo in range(0, len(values), step):
        part = values[lo : lo + step]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        who = owner[lo : lo + step]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        sums[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    for bit in range(64):
        out |= (2 * sums[:, bit] > sizes).astype(np.uint64) << np.uint64(bit)
    assert not len(ends) or ends[-1] == len(values)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(doc_id long, the long columns ``keep``, fp long), one row for each row of ``docs``."""
    words, hashes = shingle_hashes(F.col("__t"), shingle)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), *keep, docs[text_col].alias("__t")).select("doc_id", *keep, words.alias("__w")).select("doc_id", *keep, hashes.alias("h"))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            for lo in range(0, n, 1024):
                part = batch.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fold_bits(part.column(part.num_columns - 1)))], names=["doc_id", *keep, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *keep, "fp")))


def _bits(x: str, lo: int, hi: int) -> str:
    """SQL: bits lo to hi of a 64-bit value, counted from the top."""
    return f"(shiftrightunsigned({x}, {64 - hi}) & {(1 << (hi - lo)) - 1 if hi - lo < 64 else -1}L)"


def _walk(fps: DataFrame, distance: int, half: int, swap: bool) -> DataFrame:
    """Pairs (a, b), a < b, within ``distance`` and at most ``half`` bits apart in the first 32 of the walk's order."""
    turned = fps.select("fp", (F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)") if swap else F.col("fp")).alias("x"))
    node = lambda depth: f"shiftrightunsigned(x, {64 - depth})" if depth < 64 else "x"
    frontier = None
    # A batch of levels: nodes with the number of fingerprints below them.
    for lo, hi in zip((0, *DEPTHS), DEPTHS, strict=False):
        budget = half if hi <= 32 else distance
        width = hi - lo
        last = hi == 64
        nodes = turned.select(F.expr(node(lo) if lo else "0L").alias("up"), F.expr(node(hi)).alias("at"))
        nodes = nodes.groupBy("up", "at").agg(F.count(F.lit(1)).alias("n"))
        if frontier is None:
            # From the root: every node with itself and with those that differ in up to ``budget`` bits, by key.
            flips = [0, *[1 << k for k in range(width)]] if budget == 1 else _masks(width, budget)
            masks = F.array(*[F.lit(m).cast("long") for m in flips])
            left = nodes.select(F.col("at").alias("a"), F.col("n").alias("na"), F.explode(masks).alias("m"))
            left = left.select("a", "na", F.col("a").bitwiseXOR(F.col("m")).alias("b"), F.bit_count("m").alias("err")).where("a <= b AND (a < b OR na > 1)")
            frontier = left.join(nodes.select(F.col("at").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "err")
        elif hi <= 32:
            # Few bits may differ yet: each child of a names the children of b that it may pair with, and meets those alone.
            a = nodes.select(F.col("up").alias("a"), F.col("at").alias("a2"), F.col("n").alias("na"))
            b = nodes.select(F.col("up").alias("b"), F.col("at").alias("b2"))
            flips = F.filter(F.array(*[F.lit(m).cast("long") for m in _masks(width, budget)]), lambda m: F.bit_count(m) + F.col("err") <= budget)
            grown = frontier.join(a, "a").select("a", "b", "err", "a2", "na", F.explode(flips).alias("m"))
            want = F.shiftleft("b", width).bitwiseOR(F.col("a2").bitwiseXOR(F.col("m")).bitwiseAND((1 << width) - 1))
            # Of one parent, only in order; a node with itself only if it holds two.
            grown = grown.select("b", "a2", want.alias("b2"), (F.col("err") + F.bit_count("m")).alias("err"), (F.col("a") != F.col("b")).alias("two"), "na")
            grown = grown.where("two OR a2 < b2 OR (a2 = b2 AND na > 1)")
            frontier = grown.join(b, ["b", "b2"]).select(F.col("a2").alias("a"), F.col("b2").alias("b"), "err")
        else:
            a = nodes.select(F.col("up").alias("a"), F.col("at").alias("a2"), F.col("n").alias("na"))
            b = nodes.select(F.col("up").alias("b"), F.col("at").alias("b2"))
            grown = frontier.join(a, "a").join(b, "b")
            diff = F.expr(f"bit_count((a2 ^ b2) & {(1 << width) - 1}L)")
            kept = (F.col("a2") < F.col("b2")) if last else (F.col("a2") < F.col("b2")) | ((F.col("a2") == F.col("b2")) & (F.col("na") > 1))
            # A pair of different parents is met once; of one parent, only in order.
            grown = grown.where((F.col("a") != F.col("b")) | kept).select(F.col("a2").alias("a"), F.col("b2").alias("b"), (F.col("err") + diff).alias("err"))
            frontier = grown.where(F.col("err") <= budget)
        if hi == 32:
            frontier = materialize(frontier, "simhash-frontier")
    back = lambda c: F.expr(f"shiftleft({c}, 32) | shiftrightunsigned({c}, 32)") if swap else F.col(c)
    return frontier.select(back("a").alias("a"), back("b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _masks(width: int, budget: int) -> list[int]:
    out, last = [0], [0]
    for _ in range(budget):
        last = sorted({m | 1 << k for m in last for k in range(width) if not m >> k & 1})
        out += last
    return out


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """All pairs (a, b), a < b, of distinct ``fp`` values that differ in at most ``distance`` bits."""
    # Each walk is written by itself: one plan at a time for the driver to hold and compile.
    walks = [materialize(_walk(fps, distance, distance // 2, swap), "simhash-links") for swap in (False, True)]
    return walks[0].unionByName(walks[1]).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of the links (a, b) reaches.

    The smallest neighbours are written before links meet them, so that both sides of that join are plain tables, and Spark splits
    the links of a vertex that very many share.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    stamp = None
    while True:
        # Large star: neighbours that are larger than u point to the smallest neighbour of u.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large", (least,))
        # Small star: smaller neighbours and u itself point to the smallest of them.
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low", (now,))
        now = materialize(large.join(low, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc", (low, large))
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if stamp == tuple(seen):
            break
        stamp = tuple(seen)
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("v"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``: the smallest doc_id that links reach."""
    marked = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    roots = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    groups = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-groups")
    named = rooted.join(groups, "root").select(F.col("fp").alias("__fp"), "component_id")
    return marked.join(named, marked["fp"] == F.col("__fp")).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """One document of each component, with its columns: that with the smallest id, then text hash.

    With ``similarity``, documents whose sets of word shingles are so similar are linked too, however many bits differ.

    Rows that are equal in id and text are one document, of which one row stays: they become one before they move. A component in
    which all ids are null keeps one text hash. Documents are shuffled once, to meet the few bytes that say which of them stay.
    """
    key = F.xxhash64(F.col(text_col))
    tagged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("__key", F.xxhash64("text"))
    marked = materialize(fingerprints(tagged.select("doc_id", "text", "__key"), shingle, keep=("__key",)), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("first")), "simhash-fps")
    found = links(distinct.select("fp"), distance)
    if similarity is not None:
        near = near_copies.links(tagged.select(F.col("__key").alias("key"), "text"), marked.select(F.col("__key").alias("key"), "fp"), similarity)
        found = found.unionByName(near)
    roots = components(found)
    rooted = distinct.join(roots, distinct["fp"] == roots["v"], "left").select(F.coalesce("root", "fp").alias("root"), "first")
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.xxhash64("first.doc_id", "first.__key").alias("__who"), F.col("first.__key").alias("__key"))
    # Columns travel in one struct, so none can clash with ours; both sides are dealt out by the same two columns.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col(id_col).cast("long").alias("__id"), key.alias("__key")).withColumn("__who", F.xxhash64("__id", "__key"))
    return rows.groupBy("__who", "__key").agg(F.first("__row").alias("__row")).join(stay, ["__who", "__key"], "left_semi").select("__row.*")
