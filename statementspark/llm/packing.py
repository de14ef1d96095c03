"""Packing documents into sequences of fixed capacity by minimum bin slack.

Each task packs what it reads and keeps a pool of pieces. A document longer than the capacity is cut into full
pieces, which are sequences of their own, and a rest. For each window a bitset subset-sum dynamic programme runs
over the pool's remaining lengths with their counts, longest first, and keeps the reachable sums after each
length; backtracking through those bitsets gives how many pieces of each length fill the window closest to
the capacity. The longest piece of the pool always goes into the window, so none waits for ever. Where no set of whole
pieces fills a window, the longest piece left is cut to fit; the very last rest of a task is cut into powers of
two, which need no padding.

No row leaves its task: there is no shuffle, no group and no key that could be hot. State is one pool of at most
``pool`` + one batch of pieces.

Null or empty text: one id, the end id. Null or repeated ids: each row is a document of its own. Empty table: no
rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import END_ID, encoder, with_end

CAPACITY = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill ``capacity`` best, with the longest piece among them.

    ``counts``: remaining pieces by length, none over ``capacity``. Bit s of ``reach`` says that sum s can be made.
    """
    lengths = sorted(counts, reverse=True)
    longest = lengths[0]
    room = capacity - longest
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in lengths:
        have = counts[size] - (size == longest)
        if size > room or have <= 0:
            continue
        steps.append((size, have, reach))
        # Count in binary: shifts by 1, 2, 4, ... pieces reach every number of pieces up to ``have``.
        chunk, left = 1, min(have, room // size)
        while left > 0:
            take = min(chunk, left)
            reach |= (reach << (size * take)) & full
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    chosen[longest] += 1
    for size, have, before in reversed(steps):
        used = 0
        while not before >> total & 1:
            total -= size
            used += 1
        if used > have:
            raise AssertionError("backtracking left the counts")
        if used:
            chosen[size] += used
    return dict(chosen)


class Packer:
    """Takes pieces, gives placed pieces. A piece: (payload of the caller, start, ids)."""

    def __init__(self, base: int, capacity: int = CAPACITY, pool: int = 1024):
        self.base, self.capacity, self.pool_size = base, capacity, pool
        self.pool: dict[int, list] = defaultdict(list)
        self.waiting, self.next = 0, 0
        self.out: list[tuple] = []

    def _place(self, pieces: list) -> None:
        """One sequence from pieces in this order."""
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.base + self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        ids = np.ascontiguousarray(ids, "<u4")
        full = len(ids) // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            self._place([(doc, start, ids[start : start + self.capacity], len(ids))])
        if full < len(ids):
            self.pool[len(ids) - full].append((doc, full, ids[full:].copy(), len(ids)))
            self.waiting += 1

    def _take(self, size: int):
        piece = self.pool[size].pop()
        if not self.pool[size]:
            del self.pool[size]
        self.waiting -= 1
        return piece

    def _window(self) -> list:
        chosen = best_fill({k: len(v) for k, v in self.pool.items()}, self.capacity)
        return [self._take(size) for size in sorted(chosen, reverse=True) for _ in range(chosen[size])]

    def _full_window(self) -> tuple[list, int]:
        """A window and the slack left in it: where nothing fits whole, the longest piece is cut to fill it."""
        pieces = self._window()
        slack = self.capacity - sum(len(p[2]) for p in pieces)
        while slack and self.waiting:
            doc, start, ids, total = self._take(max(self.pool))
            pieces.append((doc, start, ids[:slack], total))
            if len(ids) > slack:
                self.pool[len(ids) - slack].append((doc, start + slack, ids[slack:], total))
                self.waiting += 1
            slack -= min(slack, len(ids))
        return pieces, slack

    def drain(self, least: int) -> None:
        """Fill windows while more than ``least`` pieces wait and they hold more than one window."""
        while self.waiting > least and sum(k * len(v) for k, v in self.pool.items()) >= self.capacity:
            self._place(self._full_window()[0])

    def finish(self) -> None:
        while self.waiting:
            pieces, slack = self._full_window()
            if not slack:
                self._place(pieces)
                continue
            left = self.capacity - slack  # the last window: powers of two
            while left:
                room, group = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    doc, start, ids, total = pieces.pop(0)
                    group.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        pieces.insert(0, (doc, start + room, ids[room:], total))
                    room -= min(room, len(ids))
                self._place(group)

    def rows(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = list(zip(*self.out, strict=True)) or [[]] * len(names)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    pool: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their places in sequences; see the module's docstring.

    ``tokenizer`` is the path of a tokenizers file that every executor has. ``sequence_id`` holds the task's number in
    the bits from 32 up.
    """

    def run(batches):
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, pool)
        for batch in batches:
            texts, keys = batch.column(1), batch.column(0).to_pylist()
            for lo in range(0, len(keys), 1000):
                ids, starts = with_end(*encoder(tokenizer).encode(texts.slice(lo, 1000)), END_ID)
                for k, key in enumerate(keys[lo : lo + 1000]):
                    packer.add(key, ids[starts[k] : starts[k + 1]])
                packer.drain(pool)
                yield packer.rows()
        packer.finish()
        yield packer.rows()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, PIECES)
