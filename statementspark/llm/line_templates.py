"""Line dedup with a log-template tree of fixed depth.

Words that hold a digit are variable fields. The tree's inner nodes are the number of words of a line and then its leading
words; in a leaf, lines that agree in at least ``similarity`` of their words share a template, in which the words that
differ become fields. A template is recurring when its lines stand in at least ``min_docs`` documents. Of a recurring
template the first occurrence stays, in the document with the smallest (id, text hash), and all others are dropped: so
boilerplate goes, and the one text that is repeated is not lost.

**At scale.** A line is 40 bytes until it is known to matter: the hashes of its leaf and of itself, and its place. One
aggregate of longs with map-side combining finds the leaves that hold two documents or more, a tenth of all in prose; lines
of other leaves never move again. Only leaves with two different lines and two documents need words, so only their lines
are read again, once for each different line, as 32-bit codes. Those leaves go to the texts by broadcast up to ``most_leaves``
of them and by a shuffle join beyond. What comes back to the documents is a list of line numbers; texts are
shuffled once, for that join.

**The tree does not depend on partitions.** A leaf's lines are clustered in the order of their hashes. A leaf of more than
``node`` different lines is dealt to slices of that size by a hash of the line, the slices' templates are dealt out and clustered
again under another hash, and so on until a round merges nothing: a leaf with a third of all lines is so spread over many
tasks, and what it becomes is decided by its lines alone.

Null text: no lines, stays null. Lines with fewer than ``min_words`` words are templates by themselves: only equal masked lines
recur, and of lines of fields alone only those whose numbers are equal too. Of equally similar templates the first made
wins. Blank lines are never dropped. Null ids sort first. Rows equal in id and text are one document. A document may lose all its
lines; its text is then empty. Very long texts and lines: whole, one row each. Empty table: no rows. Other columns pass through
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, materialize

MIN_DOCS = 2
MIN_WORDS = 4
SIMILARITY = 0.7
DEPTH = 3
NODE = 1024
#: Leaves whose lines are clustered go to the texts by broadcast up to this many (8 bytes each).
MOST_LEAVES = 1_000_000
FIELD = "<*>"
#: A whole word that holds a digit; the look-behind and possessive loops keep it linear.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def masked(line: F.Column, min_words: int = MIN_WORDS) -> F.Column:
    """A line with variable fields masked and trimmed; a short line of fields alone stays as it is."""
    fields = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+){{1,{max(1, min_words - 1)}}}$"
    short = line.rlike(fields) if min_words > 1 else F.lit(False)
    # Most lines hold no digit; finding that out is far cheaper than masking.
    return F.btrim(F.when(~line.rlike("[0-9]") | short, line).otherwise(F.regexp_replace(line, VARIABLE, FIELD)), F.lit(WS_CHARS))


def tree_lines(docs: DataFrame, min_words: int = MIN_WORDS, depth: int = DEPTH) -> DataFrame:
    """(d, h, p, leaf, key, w) of every line of ``docs`` (d, h, text) that is not blank: its place, leaf, hash and words."""
    lines = docs.select("d", "h", F.posexplode(F.split("text", "\n")).alias("p", "raw")).select("d", "h", "p", masked(F.col("raw"), min_words).alias("line")).where("line <> ''")
    lines = lines.select("d", "h", "p", F.xxhash64("line").alias("key"), F.split("line", WS).alias("w"))
    # A short line is a leaf of its own: only equal ones meet.
    leaf = F.when(F.size("w") < min_words, F.xxhash64(F.lit(-1), "key")).otherwise(F.xxhash64(F.size("w"), *[F.get("w", F.lit(k)) for k in range(depth)]))
    return lines.select("d", "h", "p", leaf.alias("leaf"), "key", "w")


def cluster(coded: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The template of each line of one leaf, first come first served.

    ``coded``: lines x words, as codes; 0 is a field. Fields fit anything, but a template of fields alone says nothing:
    they count as agreement only up to the number of words that agree.
    """
    templates = np.empty_like(coded)
    count, out = 0, np.empty(len(coded), np.int64)
    need = similarity * coded.shape[1]
    for k, row in enumerate(coded):
        if count:
            same = ((templates[:count] == row) & (row != 0)).sum(axis=1)
            fields = ((templates[:count] == 0) | (row == 0)).sum(axis=1)
            score = same + np.minimum(fields, same)
            best = int(score.argmax())
            if score[best] >= need and same[best] > 0:
                templates[best][templates[best] != row] = 0
                out[k] = best
                continue
        templates[count] = row
        out[k] = count
        count += 1
    return templates[out]


def fit(batches, similarity: float = SIMILARITY):
    """Arrow: rows (leaf, part, key, codes), each (leaf, part) whole and sorted by key; (key, codes) with the line's template for its codes."""
    left: pa.Table | None = None

    def clustered(rows: pa.Table):
        rows = rows.combine_chunks()
        group, codes = _groups(rows), rows.column("codes").combine_chunks()
        ends, flat = np.asarray(codes.offsets).astype(np.int64), np.array(codes.flatten())
        ends -= ends[0]
        starts = np.flatnonzero(np.append(True, group))
        for lo, hi in zip(starts, np.append(starts[1:], rows.num_rows), strict=True):
            if hi - lo > 1:
                flat[ends[lo] : ends[hi]] = cluster(flat[ends[lo] : ends[hi]].reshape(hi - lo, -1), similarity).ravel()
        made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays([rows.column("key").combine_chunks(), made], names=["key", "codes"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (rows if left is None else pa.concat_tables([left, rows])).combine_chunks()
        last = np.flatnonzero(_groups(rows))
        done = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
        if done:
            yield from clustered(rows.slice(0, done))
        left = rows.slice(done)
    if left is not None and left.num_rows:
        yield from clustered(left)


def _groups(rows: pa.Table) -> np.ndarray:
    """Whether each row but the first starts a new (leaf, part)."""
    leaf, part = rows.column("leaf").to_numpy(), rows.column("part").to_numpy()
    return (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1])


def _cluster_round(rows: DataFrame, similarity: float, node: int, seed: int) -> DataFrame:
    """(leaf, key, big, tid, codes): each (leaf, key, codes) with its template; ``big``: the leaf had more than one slice."""
    sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).select(F.col("leaf").alias("__leaf"), F.ceil(F.col("n") / node).alias("slices"))
    dealt = rows.join(sizes, F.col("leaf") == F.col("__leaf")).select("leaf", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("slices")).alias("part"), "key", "codes", (F.col("slices") > 1).alias("big"))
    dealt = materialize(dealt, "line-slices")
    whole = dealt.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "key")
    found = whole.select("leaf", "part", F.struct("leaf", "key", "big").alias("key"), "codes").mapInArrow(lambda batches: fit(batches, similarity), "key struct<leaf:long,key:long,big:boolean>, codes array<int>")
    return found.select("key.*", F.xxhash64("key.leaf", "codes").alias("tid"), "codes")


def cluster_leaves(lines: DataFrame, similarity: float = SIMILARITY, node: int = NODE) -> DataFrame:
    """(key, tid) of distinct lines (leaf, key, codes), all lines of one leaf having one length; see the module's docstring."""
    found = materialize(_cluster_round(lines, similarity, node, 0), "line-templates")
    merged, seed = found.where("NOT big").select("key", "tid"), 0
    open_ = found.where("big")  # each round reads what the one before wrote
    moved = open_.select("key", "tid")
    while not open_.isEmpty():
        before = materialize(open_.groupBy("leaf", F.col("tid").alias("key")).agg(F.first("codes").alias("codes")), "line-before")
        seed += 1
        after = materialize(_cluster_round(before, similarity, node, seed), "line-after")
        to = after.select(F.col("key").alias("tid"), F.col("tid").alias("to"))
        moved = materialize(moved.join(to, "tid", "left").select("key", F.coalesce("to", "tid").alias("tid")), "line-moved", (moved,) if seed > 1 else ())
        # A leaf goes on while a round merges some of its templates.
        now = after.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tid").alias("m")).where("m < n").select("leaf")
        open_ = materialize(after.join(now, "leaf", "left_semi"), "line-open")
    return merged.unionByName(moved)


def recurring_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_words: int = MIN_WORDS,
    similarity: float = SIMILARITY,
    depth: int = DEPTH,
    node: int = NODE,
    most_leaves: int = MOST_LEAVES,
) -> DataFrame:
    """(d, h, p, tid, own) of every line of ``docs`` (d, h, text) that fits a recurring template; ``own``: its document has the first."""
    lines = materialize(tree_lines(docs, min_words, depth).drop("w"), "lines")
    who = F.xxhash64("d", "h")
    leaves = lines.groupBy("leaf").agg(F.min(who).alias("a"), F.max(who).alias("b"), F.min("key").alias("k"), F.max("key").alias("l"))
    leaves = materialize(leaves.where("a <> b").select("leaf", (F.col("k") != F.col("l")).alias("mixed")), "line-leaves")
    held = materialize(lines.join(leaves, "leaf").select("d", "h", "p", "leaf", "key", "mixed"), "line-held")
    mixed = leaves.where("mixed").select("leaf")
    few = mixed.limit(most_leaves + 1).count() <= most_leaves
    codes = F.transform("w", lambda x: F.when(x == FIELD, F.lit(0)).otherwise(F.hash(x)))
    words = tree_lines(docs, min_words, depth).join(F.broadcast(mixed) if few else mixed, "leaf", "left_semi").select("leaf", "key", codes.alias("codes"))
    tids = cluster_leaves(materialize(words.groupBy("leaf", "key").agg(F.first("codes").alias("codes")), "line-codes"), similarity, node)
    alike = held.where("mixed").join(tids, "key").select("d", "h", "p", "tid")
    held = materialize(held.where("NOT mixed").select("d", "h", "p", F.col("leaf").alias("tid")).unionByName(alike), "line-fits")
    found = held.groupBy("tid").agg(F.min(F.struct("d", "h")).alias("first"), F.min(who).alias("a"), F.max(who).alias("b")).where("a <> b")
    if min_docs < 2:
        raise ValueError("a recurring template stands in two documents at least")
    if min_docs > 2:
        enough = held.groupBy("tid", "d", "h").agg(F.lit(1).alias("one")).groupBy("tid").agg(F.count("one").alias("n")).where(F.col("n") >= min_docs)
        found = found.join(enough, "tid", "left_semi")
    found = materialize(found.select("tid", F.col("first.d").alias("first_d"), F.col("first.h").alias("first_h")), "line-recurring")
    return held.join(found, "tid").select("d", "h", "p", "tid", (F.col("d").eqNullSafe(F.col("first_d")) & F.col("h").eqNullSafe(F.col("first_h"))).alias("own"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and the counts ``n_lines`` and ``n_kept``; ``tree`` as :func:`recurring_lines`."""
    keyed = docs.select(docs[id_col].cast("long").alias("d"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"))
    hits = recurring_lines(keyed, **tree).select("d", "h", F.struct("tid", "p", "own").alias("x"))
    lists = hits.groupBy("d", "h").agg(F.sort_array(F.collect_set("x")).alias("x"))
    keep_one = lambda x, i: x["own"] & ((i == 0) | (F.get("x", i - 1)["tid"] != x["tid"]))
    drops = lists.select(F.col("d").alias("__d"), F.col("h").alias("__h"), F.transform(F.filter("x", lambda x, i: ~keep_one(x, i)), lambda x: x["p"]).alias("__drop")).where(F.size("__drop") > 0)
    # Columns of the input travel in one struct, so none can clash with ours.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text"))
    rows = rows.join(drops, rows["__id"].eqNullSafe(F.col("__d")) & (F.xxhash64(rows["__text"]) == F.col("__h")), "left")
    rows = rows.select("__row", "__text", F.split("__text", "\n").alias("__lines"), "__drop")
    kept = F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drop"), lambda i: F.get("__lines", i)), "\n")
    )
    n_lines = F.coalesce(F.when(F.col("__text") == "", F.lit(0)).otherwise(F.size("__lines")), F.lit(0))
    rows = rows.select("__row", kept.alias("__kept"), n_lines.alias("n_lines"), (n_lines - F.coalesce(F.size("__drop"), F.lit(0))).alias("n_kept"))
    return rows.select(*[F.col("__kept").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_kept")], "n_lines", "n_kept")
