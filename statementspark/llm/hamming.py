"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is the signs of an embedding under seeded random hyperplanes. Codes are cut into segments, and an index
holds the codes under each of their segment values. A query's segments are probed one after another at radius 0, then at
radius 1, and so on. A code that no probe has met once segments 0 to s were probed at radius r has more than r bits apart from the query in
those and r or more in the others, so everything up to segments * r + s is covered: a query closes once its k-th
verified distance is no more than that, and the radius grows for the others alone.

**At scale.** Rows with the same code are one code with its k + 1 smallest ids, which is all that an answer can hold; so a
third of all rows being one vector is one index entry. Equal queries are searched once. Distinct codes are dealt to blocks
of ``block`` by a hash, and so are distinct queries; each pair of an index block and a query block is one group, whose task
builds the block's multi-index, with as many segments as keep a segment near log2 of its codes, and searches it
with numpy. Only codes travel, 16 bytes each, and of each group at most k + 1 codes a query come back. There
is no broadcast and nothing on the driver but counts. Probes of a radius are enumerated masks while these are fewer than
the segment's distinct values in the block, and those values beyond; so a query costs no more than its block, whatever the data.

Ties go to the smaller id. A row is no neighbour of itself, by id; rows with a null id, a null embedding, one with a
null or NaN in it, or one of another length than the most common (of equally common ones the smallest) have no code and
take no part. Repeated rows with one id are one row. Fewer rows than k: all of them. Empty table: no rows. Extra columns are
not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BITS = 64
#: Codes of an index block, and queries of a query block.
BLOCK = 1 << 20
#: Rows to which a small index may be repeated so that its queries are dealt to more tasks.
SPREAD = 1 << 22
#: Candidates that are verified at once.
CHUNK = 1 << 20


def codes(vectors: DataFrame, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): one row for each distinct id and code."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>").alias("v"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x))")
    first = rows.select(F.size("v").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    size = first["n"] if first else 1
    planes = np.random.default_rng(seed).standard_normal((size, BITS)).astype(np.float32)

    def run(batches):
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), np.float32).reshape(-1, size)
            bits = np.packbits(flat @ planes > 0, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64).ravel())], names=["id", "code"])

    return rows.where(F.size("v") == size).mapInArrow(run, "id long, code long").distinct()


def cuts(count: int) -> list[int]:
    """Where segments start, and 64: as many segments as bring their width near log2 of the number of codes."""
    n = min(16, max(2, round(BITS / max(4.0, np.log2(max(count, 1))))))
    return [round(BITS * k / n) for k in range(n + 1)]


@lru_cache(maxsize=64)
def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.uint64)


@lru_cache(maxsize=256)
def _ways(width: int, radius: int) -> int:
    out = 1
    for k in range(radius):
        out = out * (width - k) // (k + 1)
    return out


class Index:
    """The multi-index of one block: ``codes`` (distinct, uint64), how many ids each speaks for and its smallest id."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, least: np.ndarray):
        self.codes, self.weights, self.least = codes, weights, least
        self.cuts = cuts(len(codes))
        self.segments = []
        for lo, hi in zip(self.cuts, self.cuts[1:], strict=False):
            own = self._part(codes, lo, hi)
            order = np.argsort(own, kind="stable")
            values, starts = np.unique(own[order], return_index=True)
            self.segments.append((order, values, np.append(starts, len(own))))

    @staticmethod
    def _part(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (x >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def _probe(self, queries: np.ndarray, s: int, radius: int):
        """Pairs (query, number of the value in segment ``s``) at ``radius``, some queries at a time."""
        lo, hi = self.cuts[s], self.cuts[s + 1]
        own, values = self._part(queries, lo, hi), self.segments[s][1]
        masks = _ways(hi - lo, radius) <= len(values)
        size = max(1, CHUNK // max(1, min(_ways(hi - lo, radius), len(values))))
        for at in range(0, len(queries), size):
            some = own[at : at + size, None]
            if masks:
                want = some ^ _masks(hi - lo, radius)[None, :]
                place = np.minimum(np.searchsorted(values, want.ravel()), len(values) - 1)
                hit = np.flatnonzero(values[place] == want.ravel())
                yield at + hit // want.shape[1], place[hit]
            else:
                q, v = np.nonzero(np.bitwise_count(some ^ values[None, :]) == radius)
                yield at + q, v

    def _meet(self, queries: np.ndarray, s: int, radius: int):
        """Verified pairs (query, code, distance) that no earlier probe met."""
        order, _, starts = self.segments[s]
        for q, v in self._probe(queries, s, radius):
            sizes = starts[v + 1] - starts[v]
            ends = np.cumsum(sizes)
            first = 0
            while first < len(q):
                # Some values at a time; a value with a third of all codes is one slice by itself.
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, "right")))
                part = sizes[first:last]
                inside = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
                code = order[np.repeat(starts[v[first:last]], part) + inside]
                who = np.repeat(q[first:last], part)
                apart = queries[who] ^ self.codes[code]
                new = np.ones(len(who), bool)
                for j, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
                    if j != s:
                        new &= np.bitwise_count(self._part(apart, lo, hi)) > (radius if j < s else radius - 1)
                yield who[new], code[new], np.bitwise_count(apart[new]).astype(np.int64)
                first = last

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance): for each query the ``most`` nearest codes by distance and smallest id, and no fewer ids than that."""
        seen = np.zeros((len(queries), BITS + 1), np.int64)  # ids met, by distance
        bound = np.full(len(queries), BITS)
        open_ = np.arange(len(queries))
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = len(self.cuts) - 1
        for step in range(n * (max(np.diff(self.cuts)) + 1)):
            radius, s = divmod(step, n)
            if not len(open_):
                break
            if radius > self.cuts[s + 1] - self.cuts[s]:
                continue
            for q, code, d in self._meet(queries[open_], s, radius):
                q = open_[q]
                near = d <= bound[q]
                q, code, d = q[near], code[near], d[near]
                np.add.at(seen, (q, d), self.weights[code])
                kept.append((q, code, d))
            enough = np.cumsum(seen[open_], axis=1) >= most
            bound[open_] = np.where(enough.any(axis=1), enough.argmax(axis=1), BITS)
            open_ = open_[~(enough.any(axis=1) & (bound[open_] <= n * radius + s))]
            if sum(len(x[0]) for x in kept) > 4 * CHUNK:
                kept = [self._best(kept, bound, most)]
        return self._best(kept, bound, most)

    def _best(self, kept: list, bound: np.ndarray, most: int):
        if not kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, code, d = (np.concatenate(x) for x in zip(*kept, strict=True))
        near = d <= bound[q]
        q, code, d = q[near], code[near], d[near]
        order = np.lexsort((self.least[code], d, q))
        q, code, d = q[order], code[order], d[order]
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        return q[rank < most], code[rank < most], d[rank < most]


def _search_block(codes: pa.Table, queries: pa.Table, most: int) -> pa.Table:
    """One group: an index block and a query block."""
    number = lambda table, name: np.asarray(table.column(name).combine_chunks())
    asked = number(queries, "q").view(np.uint64)
    index = Index(number(codes, "code").view(np.uint64), number(codes, "n"), number(codes, "least"))
    q, code, d = index.search(asked, most) if codes.num_rows and queries.num_rows else (np.zeros(0, np.int64),) * 3
    return pa.table({"q": asked[q].view(np.int64), "code": index.codes[code].view(np.int64), "d": d})


def search(base: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) from (id, code) tables; exact."""
    most = k + 1
    few = F.row_number().over(Window.partitionBy("code").orderBy("id")) <= most
    distinct = base.withColumn("few", few).where("few").groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = materialize(distinct, "mih-codes")
    asked = materialize(queries.select("id", "code").distinct(), "mih-queries")
    sought = materialize(asked.select(F.col("code").alias("q")).distinct(), "mih-sought")
    n, m = distinct.count(), sought.count()
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = max(1, -(-n // block))
    right = max(1, -(-m // block), min(parts // left, m, SPREAD // max(1, n)))
    deal = lambda c, blocks: F.pmod(F.xxhash64(c, F.lit(11)), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    index = distinct.select("code", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("least"), deal("code", left).cast("int").alias("a"), every(right).alias("b"))
    probes = sought.select("q", deal("q", right).cast("int").alias("b"), every(left).alias("a"))
    pairs = index.groupBy("a", "b").cogroup(probes.groupBy("a", "b"))
    found = materialize(pairs.applyInArrow(lambda codes, queries: _search_block(codes, queries, most), "q long, code long, d long"), "mih-found")
    # The smallest ids of the nearest codes of all blocks.
    rows = found.join(distinct, "code").select("q", "d", F.explode("ids").alias("id"))
    top = F.row_number().over(Window.partitionBy("q").orderBy("d", "id")) <= most
    best = rows.withColumn("top", top).where("top").drop("top")
    answers = asked.join(best, asked["code"] == best["q"]).where(asked["id"] != best["id"])
    answers = answers.select(asked["id"].alias("query_id"), best["id"].alias("neighbour_id"), F.col("d").cast("long").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return answers.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
