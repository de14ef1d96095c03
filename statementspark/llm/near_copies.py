"""Links between texts whose sets of word shingles have a Jaccard similarity of at least ``similarity``.

SimHash at a few bits is too narrow for such a bound, and its trie at a dozen bits too wide to walk. So MinHash bands find
the candidates and the whole sets decide: a pair at similarity 0.8 shares none of ``BANDS`` bands of ``ROWS`` minima with
probability (1 - 0.8 ** ROWS) ** BANDS = 2e-5, and no pair below the bound is linked.

**At scale.** Equal sets are one set, and a task gives each set's bands once. Shingles are made again, from one text of each set, for
those sets alone that share a band with another; their keys go to the texts by broadcast up to ``MOST_KEYS`` and by a shuffle join
beyond. A band's bucket is compared with its smallest member, its head. Who is near the head is done with; who is so far from it that
no set near the head can be near both (1 - similarity is a metric, so below 2 * similarity - 1) meets none of those; who lies
between meets them. All not near the head then are a smaller bucket with a head of their own, round by round, until buckets have at
most ``PAIRWISE`` members, which meet each other, or ``HEADS`` rounds are over. So a large group of near copies costs its size
and not its square, whatever its head is.

Null id or key: as any other. Very long texts: whole. Extra columns are not read.
Fewer words than a shingle: the whole sequence is the shingle. Null, empty or blank text: the empty set, equal only to
itself. Words are compared by 64-bit hashes of their ASCII-lower-cased form. Empty table: no links.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 6
#: Smaller sets reach a similarity of 0.8 only if they are equal; any bound below takes all sets.
LEAST = 4
#: Keys of texts that are compared go to the texts by broadcast up to this many (8 bytes each).
MOST_KEYS = 1_000_000
#: Rounds of heads, and the size of a bucket whose members simply meet; the links are the same with any.
HEADS, PAIRWISE = 8, 16
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mix(x: np.ndarray) -> np.ndarray:
    for m in MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def word_hashes(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(words_of(lowered), lambda w: F.xxhash64(w))


def shingle_sets(words: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each list of word hashes."""
    ends = np.cumsum(np.asarray(words.value_lengths().fill_null(0), np.int64))
    flat = np.asarray(words.flatten()).view(np.uint64)
    n = max(0, len(flat) - shingle + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(shingle):
        rolled = rolled * MIX[0] + flat[k : k + n]
    rolled, out = _mix(rolled), []
    for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
        if hi - lo >= shingle:
            out.append(np.unique(rolled[lo : hi - shingle + 1]))
        else:
            one = np.full(min(1, hi - lo), hi - lo, np.uint64)
            for w in flat[lo:hi]:
                one = one * MIX[0] + w
            out.append(_mix(one))
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """sets x BANDS hashes of ROWS minima each; no set may be empty."""
    rng = np.random.default_rng(8)
    factors = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat, out = np.concatenate(sets), np.zeros((len(sets), BANDS), np.uint64)
    starts = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    for k, factor in enumerate(factors):
        band = k // ROWS
        least = np.minimum.reduceat((flat * factor) ^ factors[k - 1], starts)
        out[:, band] = _mix(out[:, band] + least + np.uint64(band))
    return out


def _sids(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set."""
    with np.errstate(over="ignore"):
        return np.array([_mix(s + np.uint64(len(s))).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def set_rows(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(key, sid, bands) of each row (key, text); bands once for each set of a task, else null."""
    least = LEAST if similarity >= SIMILARITY else 1

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = shingle_sets(part.column(1), shingle)
                sids = _sids(sets)
                new = []
                for k, sid in enumerate(sids.tolist()):
                    if len(sets[k]) >= least and sid not in seen:
                        seen.add(sid)
                        new.append(k)
                made: list = [None] * len(sets)
                if new:
                    for k, row in zip(new, bands([sets[k] for k in new]).view(np.int64), strict=True):
                        made[k] = row
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sids), pa.array(made, pa.list_(pa.int64()))], names=["key", "sid", "bands"])

    return docs.select("key", word_hashes(F.col("text")).alias("w")).mapInArrow(run, "key long, sid long, bands array<long>")


def whole_sets(texts: DataFrame, owners: DataFrame, need: DataFrame, shingle: int) -> DataFrame:
    """(sid, grams) of the sets ``need``, made again from one text of each: only sets that are compared are ever written."""
    keys = materialize(owners.join(need, "sid", "left_semi").groupBy("sid").agg(F.min("key").alias("key")).select("key").distinct(), "near-keys")
    few = keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    chosen = texts.join(F.broadcast(keys) if few else keys, "key", "left_semi")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = shingle_sets(batch.column(0).slice(lo, 256), shingle)
                sids = _sids(sets).tolist()
                new = [k for k, sid in enumerate(sids) if sid not in seen and not seen.add(sid)]
                yield pa.RecordBatch.from_arrays([pa.array([sids[k] for k in new], pa.int64()), pa.array([sets[k].view(np.int64) for k in new], pa.list_(pa.int64()))], names=["sid", "grams"])

    found = chosen.select(word_hashes(F.col("text")).alias("w")).mapInArrow(run, "sid long, grams array<long>")
    return materialize(found.dropDuplicates(["sid"]), "near-whole")


def _judge(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """(x, y, kind) of pairs of sets (x, y): 2 near, 1 neither near nor far, 0 far."""
    both = pairs.join(whole.select(F.col("sid").alias("x"), F.col("grams").alias("gx")), "x").join(whole.select(F.col("sid").alias("y"), F.col("grams").alias("gy")), "y")

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            kinds = []
            for k in range(batch.num_rows):
                a, b = x[k].values.to_numpy(), y[k].values.to_numpy()
                met = len(np.intersect1d(a, b, assume_unique=True))
                held = len(a) + len(b) - met
                kinds.append(2 if met >= similarity * held - 1e-9 else 1 if met >= (2 * similarity - 1) * held - 1e-9 else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.int32())], names=["x", "y", "kind"])

    return materialize(both.select("x", "y", "gx", "gy").mapInArrow(run, "x long, y long, kind int"), "near-judged")


def compare(members: DataFrame, whole: DataFrame, similarity: float) -> tuple[list[DataFrame], int]:
    """Tables (x, y) of near sets among those that share a bucket, (band, sid) each; and how many pairs were compared."""
    near, between, compared, state = [], [], 0, members
    ordered = (F.least("u", "w").alias("x"), F.greatest("u", "w").alias("y"))
    for _ in range(HEADS):
        # Written before members meet them: of two plain tables Spark splits a band that very many sets share.
        heads = materialize(state.groupBy("band").agg(F.min("sid").alias("x"), F.max("sid").alias("hi")).where("x < hi").select("band", "x"), "near-heads")
        pairs = materialize(state.join(heads, "band").where("sid <> x").select("band", "x", F.col("sid").alias("y")), "near-pairs")
        judged = _judge(pairs.select("x", "y").distinct(), whole, similarity)
        compared += judged.count()
        seen = materialize(pairs.join(judged, ["x", "y"]), "near-seen")
        near.append(judged.where("kind = 2").select("x", "y"))
        between.append(seen.where("kind = 1").select("band", F.col("y").alias("u")).join(seen.where("kind = 2").select("band", F.col("y").alias("w")), "band").select(*ordered))
        state = seen.where("kind < 2").select("band", F.col("y").alias("sid"))
        if (state.groupBy("band").count().agg(F.max("count")).first()[0] or 0) <= PAIRWISE:
            break
    between.append(state.withColumnRenamed("sid", "u").join(state.withColumnRenamed("sid", "w"), "band").where("u < w").select(*ordered))
    rest = materialize(functools.reduce(DataFrame.unionByName, between).distinct(), "near-rest")
    if not rest.isEmpty():
        judged = _judge(rest, whole, similarity)
        compared += judged.count()
        near.append(judged.where("kind = 2").select("x", "y"))
    return near, compared


def links(texts: DataFrame, vertices: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between the vertices ``fp`` of near copies. ``texts``: (key, text); ``vertices``: (key, fp), one for each key."""
    sets = materialize(set_rows(texts, shingle, similarity), "near-sets")
    owners = materialize(sets.select("key", "sid").distinct().join(vertices.select("key", "fp").distinct(), "key"), "near-owners")
    least = materialize(owners.groupBy("sid").agg(F.min("fp").alias("v")), "near-least")
    buckets = sets.where("bands IS NOT NULL").select("sid", F.explode("bands").alias("band"))
    groups = materialize(buckets.groupBy("band").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("band"), "near-groups")
    members = materialize(buckets.join(groups, "band").select("band", "sid").distinct(), "near-members")
    near, _ = compare(members, whole_sets(texts, owners, members.select("sid").distinct(), shingle), similarity)
    near = functools.reduce(DataFrame.unionByName, near)
    found = near.join(least.select(F.col("sid").alias("x"), F.col("v").alias("a")), "x").join(least.select(F.col("sid").alias("y"), F.col("v").alias("b")), "y")
    same = owners.join(least, "sid").select(F.col("fp").alias("a"), F.col("v").alias("b"))
    return materialize(found.select("a", "b").unionByName(same).where("a <> b").distinct(), "near-links")
