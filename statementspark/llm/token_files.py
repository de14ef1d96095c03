"""Token-id files: an adaptive context-mixing range coder over blocks of documents.

**File format.** A dataset of Parquet files with one row per block: ``part`` and ``block`` (together the order of
documents), ``n_docs``, ``n_ids``, ``ids_crc32`` (of the block's ids as little-endian 32-bit integers) and ``data``. Spark
writes the rows, so a lost task leaves no half file and any store that Spark reaches will do. ``data`` is

    magic "SSK3" | u32 steps | u32 lanes | u32 ids | u32 documents | u32 bytes of document table | document table (zlib: doc
    ids as i64, one byte each for null, number of ids as u32) | u32 words in each lane | the lanes' 16-bit words

**Model.** Every block starts from nothing and can be read without any other. Its ids are dealt to lanes of ``STEPS`` ids, as
runs of the stream (the last lane is filled up with the last id), and step t codes the t-th id of every lane, all under the
block's model as step t-1 left it: a full block has 1024 lanes, so its model learns in 2048 steps. A task codes several blocks
side by side, each with tables of its own, only to give numpy longer rows. Three predictors speak for the next id: order
2 (a candidate id by the two ids before, hashed), order 1 (a candidate by the id before), order 0 (counts of all ids). Each
candidate has a confidence that rises when it was right and falls when it was wrong. How often a candidate was right at
the present pair of confidences gives the weights, and the mixture

    freq(id) = order0[id] + spike2 * (id == candidate2) + spike1 * (id == candidate1)

goes to a carry-less range coder with 64-bit state. The decoder makes the same updates, so a block needs no table.

A block ends with the document that fills it, so a very long text makes one long block, with more lanes. Ties: documents with
one id stand in the order of their texts' hashes. Null or empty text: only the end id. Null or repeated ids: null sorts first, repeated rows are documents of their own.
Empty table: no blocks and no rows. Extra columns are not read. A damaged block raises an error that names it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import END_ID, encoder, with_end

MAGIC = b"SSK3"
#: Ids that a lane of a block holds, one after another.
STEPS = 2048
BLOCK_IDS = 1 << 21
#: Blocks that are coded side by side.
GROUP = 4
SLAB = 64  # steps whose ids are turned from runs to rows, or back, at a time
BLOCKS = "part int, block int, n_docs long, n_ids long, ids_crc32 long, data binary"
DOCS = "part int, block int, doc_id long, before long, n_tokens long, ids_crc32 long"

U = np.uint64
TOP, BOT, S16 = U(1) << U(48), U(1) << U(40), U(16)
MIX_BITS = 17
REFRESH, STALE = 8, 16  # steps between two sums of the order-0 counts: at least so many, and later this part of all steps so far
WEIGH = 2  # steps between two looks at how often candidates were right
GAIN = 24  # what one sighting adds to an order-0 count
RATIO = 255  # the most that a candidate may weigh against order 0
SURE = 7  # the highest confidence
NEAR_BITS = 16  # first bits of a running sum that a search looks at first


class Model:
    """What both sides know after each step, for several blocks side by side: each has tables of its own, at an offset."""

    def __init__(self, lanes: list[int], alphabet: int, steps: int):
        n, self.alphabet = len(lanes), alphabet
        #: Of the sums that every lane looks into: half the size, and so half the cache, wherever they fit.
        self.kind = np.int32 if GAIN * steps * sum(lanes) + n * alphabet < 1 << 31 else np.int64
        block = np.repeat(np.arange(n), lanes)
        self.at_id, self.at_cum, self.at_mix, self.at_cell = block * alphabet, block * (alphabet + 1), n * alphabet + (block << MIX_BITS), block << 6
        self.block = block
        self.count = np.ones((n, alphabet), np.int64)
        #: Running sums of a block's counts, on top of all blocks before it: so one search serves all lanes.
        self.cum = np.zeros((n, alphabet + 1), np.int64)
        self.seen: list[np.ndarray] = []
        self.step, self.refresh = 0, 0
        #: Where the last id stands among the counts, and the last two ids.
        self.at_last, self.last, self.before = self.at_id, np.zeros(len(block), np.uint32), np.zeros(len(block), np.uint32)
        # A slot holds candidate << 3 | confidence. Those of order 1 come first, then those of order 2; so do the two rows of ``h``, ``p``, ``c`` and ``k``.
        self.slots, self.h = np.zeros(n * alphabet + (n << MIX_BITS), np.int32), np.zeros((2, len(block)), np.int64)
        #: How often no candidate was right, only that of order 1, and that of order 2, in each cell.
        self.tally = np.concatenate([np.full(n << 6, 2, np.int64), np.ones(n << 7, np.int64)])
        self.sure2, self.sure1 = np.tile(np.arange(64) >= 8, n), np.tile(np.arange(64) % 8 > 0, n)

    def predict(self):
        """Candidates, their spikes (0 where there is none, and of order 1 where both are one) and the order-0 totals of all lanes."""
        if self.step == self.refresh:
            self.refresh += max(REFRESH, self.step // STALE)
            if self.seen:
                self.count += GAIN * np.bincount(np.concatenate(self.seen), minlength=self.count.size).reshape(self.count.shape)
                self.seen = []
            self.cum[:, 0] = 0
            np.cumsum(self.count, axis=1, out=self.cum[:, 1:])
            totals = self.cum[:, -1].copy()
            self.base = np.cumsum(totals) - totals
            self.cum += self.base[:, None]
            self.flat = self.cum.ravel().astype(self.kind)
            self.near = None
            self.totals, self.start = np.repeat(totals, 64), self.base[self.block].astype(self.kind)
            self.total = totals[self.block]
        if self.step % WEIGH == 0:
            miss, hits1, hits2 = self.tally.reshape(3, -1)
            self.weight2 = np.minimum(self.totals * hits2 // miss, self.totals * RATIO) * self.sure2
            self.weight1 = np.minimum(self.totals * hits1 // miss, self.totals * RATIO) * self.sure1
        self.step += 1
        # Only bits 8 to 24 of the sum count, so it may overflow.
        mixed = self.last * np.uint32(0x9E3779B1)
        mixed += self.before * np.uint32(0x85EBCA77)
        mixed >>= np.uint32(8)
        mixed &= np.uint32((1 << MIX_BITS) - 1)
        self.h[0] = self.at_last
        np.add(self.at_mix, mixed, out=self.h[1])
        self.p = self.slots.take(self.h)
        self.c, self.k = self.p >> 3, self.p & 7
        self.sure = self.k > 0
        (c1, c2), (k1, k2) = self.c, self.k
        self.same = (c1 == c2) & self.sure[1]
        self.cell = self.at_cell + ((k2 << 3) | np.where(self.same, 0, k1))
        return c2, self.weight2.take(self.cell), c1, self.weight1.take(self.cell), self.total

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order-0 counts of all smaller ids of the lane's block, and of the ids themselves."""
        at = self.at_cum + ids
        low = self.flat.take(at)
        at += 1
        return low - self.start, self.flat.take(at) - low

    def find(self, sums: np.ndarray) -> np.ndarray:
        """Where the last running sum that is not above each of ``sums`` stands. Most are told by their first bits alone."""
        if self.near is None:
            self.bits = max(0, int(self.flat[-1]).bit_length() - NEAR_BITS)
            self.near = np.cumsum(np.bincount((self.flat >> self.bits) + 1, minlength=(1 << NEAR_BITS) + 1)) - 1
        head = sums >> self.bits
        found = self.near.take(head + 1)
        rest = np.flatnonzero(self.near.take(head) != found)
        # In ascending order, as a search that follows a smaller one is near it.
        key = sums[rest].astype(self.kind)
        order = np.argsort(key)
        found[rest[order]] = np.searchsorted(self.flat, key[order], side="right") - 1
        return found

    def update(self, ids: np.ndarray) -> None:
        """``ids``: of 32 bits."""
        hit = (ids == self.c) & self.sure
        kind = (hit[1].view(np.int8) << 1) | (hit[0] > hit[1])
        self.tally += np.bincount(self.cell + kind * np.int64(len(self.tally) // 3), minlength=len(self.tally))
        moved = self.p + np.where(hit, self.k < SURE, -((self.k + 1) >> 1))
        self.slots[self.h] = np.where(hit | (self.k > 1), moved, (ids << 3) | 1)
        self.at_last = self.at_id + ids
        self.seen.append(self.at_last)
        self.before, self.last = self.last, ids.view(np.uint32)


def _shift(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes must put out or take in a word now, as places and as bits to shift by; ranges that lie across a border are cut."""
    near = (low ^ (low + size)) < TOP
    small = size < BOT
    across = np.flatnonzero(small & ~near)
    if len(across):
        size[across] = (~low[across] + U(1)) & (BOT - U(1))
    now = near | small
    return np.flatnonzero(now), now * S16


def shape(count: int, steps: int = STEPS) -> tuple[int, int]:
    """Steps and lanes of a block of so many ids."""
    steps = max(1, min(steps, count))
    return steps, -(-count // steps)


def encode_ids(blocks: list[np.ndarray], alphabet: int, steps: int = STEPS) -> list[list[np.ndarray]]:
    """The 16-bit words of each lane of each block. All blocks must have one number of steps."""
    lanes = [shape(len(ids), steps)[1] for ids in blocks]
    steps = shape(len(blocks[0]), steps)[0]
    # Lane k of a block holds its ids k * steps to (k + 1) * steps; the last lane goes on with the last id.
    grid = np.concatenate([np.append(ids, np.full(n * steps - len(ids), ids[-1], ids.dtype)).reshape(n, steps) for ids, n in zip(blocks, lanes, strict=True)])
    total_lanes = sum(lanes)
    model = Model(lanes, alphabet, steps)
    low, size = np.zeros(total_lanes, U), np.full(total_lanes, 2**64 - 1, U)
    words, owners = [], []
    owner_kind = np.uint16 if total_lanes <= 1 << 16 else np.int32  # a stable sort of 16 bits is by digits
    for t in range(steps):
        if t % SLAB == 0:
            rows = np.ascontiguousarray(grid[:, t : t + SLAB].T).astype(np.int32)
        x = rows[t % SLAB]
        c2, s2, c1, s1, total = model.predict()
        start, freq = model.span(x)
        freq = freq + s2 * (x == c2) + s1 * (x == c1)
        start = start + s2 * (c2 < x) + s1 * (c1 < x)
        part = size // (total + s2 + s1).view(U)
        low += part * start.view(U)
        np.multiply(part, freq.view(U), out=size)
        out, by = _shift(low, size)
        words.append((low >> U(48)).astype(np.uint16)[out])
        owners.append(out.astype(owner_kind))
        low <<= by
        size <<= by
        more = out
        while len(more):
            a, b = low[more], size[more]
            out, by = _shift(a, b)
            words.append((a[out] >> U(48)).astype(np.uint16))
            owners.append(more[out].astype(owner_kind))
            low[more], size[more] = a << by, b << by
            more = more[out]
        model.update(x)
    for _ in range(4):
        words.append((low >> U(48)).astype(np.uint16))
        owners.append(np.arange(total_lanes, dtype=owner_kind))
        low <<= S16
    owner, word = np.concatenate(owners), np.concatenate(words)
    streams = np.split(word[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=total_lanes))[:-1])
    ends = np.cumsum(lanes)
    return [streams[e - n : e] for n, e in zip(lanes, ends, strict=True)]


def decode_ids(blocks: list[tuple[np.ndarray, np.ndarray, int]], alphabet: int, steps: int = STEPS) -> list[np.ndarray]:
    """The ids of blocks, each given as (words, words of each lane, number of ids); all must have one number of steps."""
    lanes = [len(sizes) for _, sizes, _ in blocks]
    steps = shape(blocks[0][2], steps)[0]
    model = Model(lanes, alphabet, steps)
    sizes = np.concatenate([x for _, x, _ in blocks])
    at = np.cumsum(sizes) - sizes
    words = np.concatenate([*[w for w, _, _ in blocks], np.zeros(4, np.uint16)])
    n = len(sizes)
    low, size, code = np.zeros(n, U), np.full(n, 2**64 - 1, U), np.zeros(n, U)
    for _ in range(4):
        code = (code << S16) | words.take(at, mode="clip")
        at += 1
    rows, out = np.empty((SLAB, n), np.int32), np.empty((n, steps), np.int32)
    for t in range(steps):
        c2, s2, c1, s1, total = model.predict()
        all_ = total + s2 + s1
        part = size // all_.view(U)
        v = np.minimum(((code - low) // part).view(np.int64), all_ - 1)
        (at1, at2), (freq1, freq2) = model.span(model.c)
        at2, at1 = at2 + s1 * (c1 < c2), at1 + s2 * (c2 < c1)
        freq2, freq1 = freq2 + s2, freq1 + s1
        end2, end1 = at2 + freq2, at1 + freq1
        is2, is1 = (v >= at2) & (v < end2), (v >= at1) & (v < end1)
        rest = np.flatnonzero(~(is2 | is1))  # only what no candidate claims is looked up in order 0
        is1 &= ~model.same
        x, start, freq = np.where(is1, c1, c2), np.where(is1, at1, at2), np.where(is1, freq1, freq2)
        if len(rest):
            r = v[rest]
            plain = r - s2[rest] * (r >= end2[rest]) - s1[rest] * (r >= end1[rest])
            base = model.start[rest]
            found = model.find(plain + base)
            below = model.flat.take(found)
            x[rest] = np.minimum(found - model.at_cum[rest], alphabet - 1)
            start[rest] = below - base + (r - plain)
            freq[rest] = model.flat.take(found + 1) - below
        low += part * start.view(U)
        np.multiply(part, freq.view(U), out=size)
        need, by = _shift(low, size)
        low <<= by
        size <<= by
        code <<= by
        while len(need):
            code[need] |= words.take(at[need], mode="clip")
            at[need] += 1
            a, b = low[need], size[need]
            again, by = _shift(a, b)
            low[need], size[need] = a << by, b << by
            need = need[again]
            code[need] <<= S16
        rows[t % SLAB] = x
        if (t + 1) % SLAB == 0 or t + 1 == steps:
            out[:, t - t % SLAB : t + 1] = rows[: t % SLAB + 1].T
        model.update(x)
    ends = np.cumsum(lanes)
    return [out[e - k : e].ravel()[:count].view(np.uint32) for k, e, (_, _, count) in zip(lanes, ends, blocks, strict=True)]


def encode_blocks(blocks: list[tuple[list, np.ndarray, np.ndarray]], alphabet: int, steps: int = STEPS) -> list[bytes]:
    """The bytes of each block (doc ids, number of ids of each, all ids); those with one number of steps are coded side by side."""
    out: list[bytes] = [b""] * len(blocks)
    for some in _alike([shape(len(ids), steps)[0] if len(ids) else 0 for _, _, ids in blocks]):
        coded = encode_ids([blocks[k][2] for k in some], alphabet, steps) if len(blocks[some[0]][2]) else [[] for _ in some]
        for k, streams in zip(some, coded, strict=True):
            doc_ids, sizes, ids = blocks[k]
            keys = np.array([x or 0 for x in doc_ids], "<i8")
            null = np.array([x is None for x in doc_ids], np.uint8)
            docs = zlib.compress(keys.tobytes() + null.tobytes() + np.asarray(sizes).astype("<u4").tobytes())
            head = MAGIC + struct.pack("<5I", shape(len(ids), steps)[0], len(streams), len(ids), len(doc_ids), len(docs))
            out[k] = head + docs + np.array([len(s) for s in streams], "<u4").tobytes() + b"".join(s.astype("<u2").tobytes() for s in streams)
    return out


def _alike(kinds: list[int]) -> list[list[int]]:
    return [[k for k, x in enumerate(kinds) if x == kind] for kind in dict.fromkeys(kinds)]


def decode_blocks(datas: list[bytes], alphabet: int) -> list[tuple[list, np.ndarray, np.ndarray]]:
    """Doc ids, number of ids of each and all ids, of each block."""
    parts = []
    for data in datas:
        if data[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        steps, lanes, count, n, table = struct.unpack_from("<5I", data, 4)
        raw = zlib.decompress(data[24 : 24 + table])
        keys, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
        streams = np.frombuffer(data, "<u4", lanes, 24 + table).astype(np.int64)
        words = np.frombuffer(data, "<u2", int(streams.sum()), 24 + table + 4 * lanes)
        parts.append((steps, [None if e else int(k) for k, e in zip(keys, null, strict=True)], np.frombuffer(raw, "<u4", n, 9 * n).astype(np.int64), (words, streams, count)))
    out: list = [None] * len(parts)
    for some in _alike([p[0] * bool(p[3][2]) for p in parts]):
        coded = [parts[k][3] for k in some]
        for k, ids in zip(some, decode_ids(coded, alphabet, parts[some[0]][0]) if coded[0][2] else [np.zeros(0, np.uint32) for _ in some], strict=True):
            out[k] = (parts[k][1], parts[k][2], ids)
    return out


def write_ids(docs: DataFrame, tokenizer: str, alphabet: int, end_id: int = END_ID, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write blocks in ascending order of ids; the written dataset."""

    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        waiting: list[tuple[list, np.ndarray, np.ndarray]] = []
        keys: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        total = 0

        def close():
            nonlocal keys, held, sizes, total
            waiting.append((keys, np.array(sizes), np.concatenate(held)))
            keys, held, sizes, total = [], [], [], 0

        def flush():
            nonlocal block
            coded = encode_blocks(waiting, alphabet)
            rows = [(part, block + k, len(own), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), data) for k, ((own, _, ids), data) in enumerate(zip(waiting, coded, strict=True))]
            block += len(rows)
            waiting.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            texts, owners = batch.column(1), batch.column(0).to_pylist()
            for lo in range(0, len(owners), 1000):
                ids, starts = with_end(*encoder(tokenizer).encode(texts.slice(lo, 1000)), end_id)
                for k, key in enumerate(owners[lo : lo + 1000]):
                    keys.append(key)
                    held.append(ids[starts[k] : starts[k + 1]])
                    sizes.append(int(starts[k + 1] - starts[k]))
                    total += sizes[-1]
                    if total >= block_ids:
                        close()
                        if len(waiting) == GROUP:
                            yield flush()
        if keys:
            close()
        if waiting:
            yield flush()

    text = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    return materialize(text.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS), "token-ids")


def read_ids(blocks: DataFrame, alphabet: int) -> DataFrame:
    """Documents from written blocks, with their place in the whole stream: (doc_id, start, n_tokens, ids_crc32)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                rows = batch.slice(lo, GROUP).to_pylist()
                for row, (keys, sizes, ids) in zip(rows, decode_blocks([r["data"] for r in rows], alphabet), strict=True):
                    raw = np.ascontiguousarray(ids, "<u4")
                    if zlib.crc32(raw.tobytes()) != row["ids_crc32"]:
                        raise ValueError(f"block {row['part']}.{row['block']} is damaged")
                    ends = np.cumsum(sizes)
                    sums = [zlib.crc32(raw[e - s : e].tobytes()) for s, e in zip(sizes, ends, strict=True)]
                    n = len(keys)
                    columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DOCS.split(", ")])

    docs = blocks.select("part", "block", "data", "ids_crc32").mapInArrow(run, DOCS)
    # Two levels of running sums: over the parts, of which there are as many as tasks wrote, and inside each part.
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = sizes.select("part", "block", inner.alias("block_start")).join(parts, "part")
    joined = docs.join(starts, ["part", "block"])
    return joined.select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
