"""Repair of conversation structure: cheapest edits by Dial's bucket queue, and the first audit by tight arcs.

A conversation is well formed where the initials of its roles are ``(s?(ua)+)?``. That grammar has four states (nothing yet, after s,
after u, after a), so a conversation of n rows is a graph of 4 (n + 1) nodes, (rows done, state), with arcs for Keep, Rerole, Delete
and Insert that cost 0 to 4. From a state only one role can follow besides s, so an arc's initial says where it leads.

**Distances** to the goal are found by Dial's algorithm from the last row to the first: nodes wait in buckets by distance, the
lowest bucket is emptied first, and the small costs keep few buckets open. **Audit:** from the start, among the arcs that
lose no distance, the one with the least initial; no cycle is free, so the walk ends, and no other cheapest audit is smaller.
A conversation longer than ``SEGMENT`` rows is solved segment by segment from its end, keeping four distances at each border, and each
segment once more on the way forth: memory for one segment, the same result.

**Rows.** Faults and positions are windows of a conversation after one exchange by its id: they spill, and hold no group. A
row then is one letter; letters of a conversation meet in one string, which is as long as the audit that the contract asks
for. Texts meet again as sorted rows behind their conversation's audit, and are hashed as they pass. One task serves a
conversation, as its hash is sequential; no task holds one.

Null id, turn, role or text: a null turn comes first and is no turn of ``gaps``; other nulls are one space here, as in the key that
damages. Rows equal in turn: by role, then text; repeated rows: the later ones are duplicates. Empty or very long texts: whole.
Conversations without a row left are results. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WS_CHARS, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SEGMENT = 1 << 16
#: States: nothing yet, after s, after u, after a; what a user or assistant turn leads to, and where each role may be kept.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GOALS = (0, 3)
#: Letters of a row: initial of its role, or ``o``; in capitals if truncated; ``x``: has to go.
LETTERS = "suaoSUAOx"


def row_arcs(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the arcs that use up a row, least initial first."""
    out = [("D", DELETE, state)]
    if letter == "x":
        return out
    more = TRUNCATED * letter.isupper()
    if (state, letter.lower()) in KEPT:
        out.append(("K", KEEP + more, KEPT[state, letter.lower()]))
    return [*out, ("R", REROLE + more, NEXT[state])]


_BACK = {x: [(q, cost, p) for p in range(4) for _, cost, q in row_arcs(x, p)] for x in LETTERS}
_INTO = {x: [[(cost, p) for q, cost, p in arcs if q == state] for state in range(4)] for x, arcs in _BACK.items()}
_INSERTED = [[p for p in range(4) if NEXT[p] == q] for q in range(4)]


def distances(letters: str, ends: list[int]) -> list[int]:
    """Cost from each node to the goal; node 4 i + q stands before row i in state q. ``ends``: of the four nodes behind the last row."""
    far = 1 << 60
    dist = [far] * (4 * len(letters) + 4)
    buckets: dict[int, list[int]] = {}
    for q, d in enumerate(ends):
        if d < far:
            dist[4 * len(letters) + q] = d
            buckets.setdefault(d, []).append(4 * len(letters) + q)
    low = min(buckets, default=0)
    while buckets:
        while low not in buckets:
            low += 1
        for node in buckets.pop(low):
            if dist[node] < low:
                continue  # reached more cheaply meanwhile
            i, q = divmod(node, 4)
            reached = [(low + INSERT, 4 * i + p) for p in _INSERTED[q]]
            if i:
                reached += [(low + cost, 4 * i - 4 + p) for cost, p in _INTO[letters[i - 1]][q]]
            for d, other in reached:
                if d < dist[other]:
                    dist[other] = d
                    buckets.setdefault(d, []).append(other)
    return dist


def walk(letters: str, dist: list[int], state: int, ends: bool) -> tuple[list[str], int]:
    """The initials from ``state`` along tight arcs, and the state behind the last row; ``ends``: the conversation ends there."""
    out, i = [], 0
    while i < len(letters) or (ends and dist[4 * i + state]):
        here = dist[4 * i + state]
        arcs = [(name, 4 * i + 4 + q, cost) for name, cost, q in (row_arcs(letters[i], state) if i < len(letters) else [])]
        arcs.append(("I", 4 * i + NEXT[state], INSERT))
        name, node, _ = min(x for x in arcs if dist[x[1]] + x[2] == here)
        out.append(name)
        i, state = divmod(node, 4)
    return out, state


def repair(letters: str, segment: int = SEGMENT) -> tuple[int, str]:
    """(cost, audit) of a conversation given by the letters of its rows."""
    parts = [letters[k : k + segment] for k in range(0, len(letters), segment)] or [""]
    borders = [[0 if q in GOALS else 1 << 60 for q in range(4)]]
    # Behind the last row inserts still lead to the goal.
    borders[0] = distances("", borders[0])
    for part in reversed(parts):
        borders.append(distances(part, borders[-1])[:4])
    borders.reverse()
    state, audit = 0, []
    for k, part in enumerate(parts):
        found, state = walk(part, distances(part, borders[k + 1]), state, k == len(parts) - 1)
        audit += found
    return borders[0][0], "".join(audit)


_known = lru_cache(1 << 16)(repair)


def repairs(letters: pa.Array) -> pa.Array:
    """Struct (cost, audit) of each string of letters; short ones recur and are solved once."""
    found = [_known(x) if len(x) <= 64 else repair(x) for x in letters.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["cost", "audit"])


def _crc(conv_id: Column, turn: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(text(conv_id), F.lit(":"), text(turn)).cast("binary"))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): every row after damage, a repeated one twice, a dropped one once and ``gone``."""
    fault = _crc(F.col("conv_id"), F.col("turn")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(role)
    copies = F.explode(F.sequence(F.lit(0), F.when(fault == 3, 1).otherwise(0))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), copies)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and a hash of the repaired conversation for every conv_id of rows as :func:`damage` gives them."""
    at = ("gone", F.asc_nulls_first("turn"), "role", "text", "copy")
    there = ~F.col("gone")
    by = Window.partitionBy("conv_id").orderBy(*at)
    same = Window.partitionBy("conv_id", "role", "text").orderBy(*at)
    ends = F.substring(F.rtrim("text", F.lit(WS_CHARS)), -1, 1)
    # One exchange, by conversation, serves all that follows up to the written rows.
    rows = rows.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    blank = ~F.col("text").rlike(WORD)
    fault = F.when(blank, "b").when(F.col("again"), "d").when(~ends.isin(".", "!", "?"), "t").otherwise("")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({"pos": F.row_number().over(by), "fault": fault, "initial": initial, "before": F.lag(initial).over(by), "last_turn": F.lag("turn").over(by)})
    letter = F.when(F.col("fault").isin("b", "d"), "x").otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    rows = rows.withColumn("letter", F.when(F.col("fault") == "t", F.upper(letter)).otherwise(letter))
    rows = rows.withColumns({"illegal": there & F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au"), "new_turn": there & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))})
    rows = materialize(rows.select("conv_id", "pos", "turn", "gone", "fault", "letter", "illegal", "new_turn", F.when(there, F.col("role")).alias("role"), F.when(there, F.col("text")).alias("text")), "turn-rows")
    turn = F.when(there, F.col("turn"))
    many = lambda kind: F.count_if(there & (F.col("fault") == kind)).alias({"b": "blank", "d": "duplicate", "t": "truncated"}[kind])
    met = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_if("new_turn"), F.lit(0)).alias("gaps"), many("b"), many("d"), many("t"), F.count_if("illegal").alias("illegal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(there, F.struct("pos", "letter")))), lambda x: x["letter"]), "").alias("letters"),
    )
    names = [c for c in met.columns if c != "letters"]

    def solve(batches):
        for batch in batches:
            found = repairs(batch.column("letters"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found.flatten()], names=[*names, "cost", "audit"])

    kinds = dict(met.dtypes)
    solved = materialize(met.mapInArrow(solve, ", ".join(f"{c} {kinds[c]}" for c in names) + ", cost long, audit string"), "turn-audits")
    # Each conversation's audit, then its rows in order, stream through one task.
    stream = solved.select("conv_id", F.lit(0).alias("pos"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    stream = stream.unionByName(rows.where(there).select("conv_id", "pos", F.lit("").alias("audit"), "role", "text"))
    hashed = stream.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_hash_repaired, "h_conv long, repaired_sha256 string")
    return solved.join(hashed, solved["conv_id"].eqNullSafe(hashed["h_conv"])).drop("h_conv")


class _Rebuilder:
    """Applies one audit to the rows as they come, and hashes what remains."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first, self.sha = audit, 0, 0, True, hashlib.sha256()

    def _add(self, role: str, text: str) -> None:
        if not self.first:
            self.sha.update(b"\n")
        self.first = False
        self.sha.update(f"{role}:{text}".encode())

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._made("")
            self.at += 1

    def _made(self, text: str) -> None:
        self.state = NEXT[self.state]
        self._add("user" if self.state == 2 else "assistant", text)

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            self._add(role, text)
        elif edit == "R":
            self._made(text)

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def _hash_repaired(batches):
    """Rows sorted by conversation, the audit first: (conversation, hash)."""
    conv, now = None, None
    for batch in batches:
        done: list[tuple] = []
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for c, pos, audit, role, text in zip(*(x.to_pylist() for x in part.columns), strict=True):
                if pos == 0:
                    if now:
                        done.append((conv, now.digest()))
                    conv, now = c, _Rebuilder(audit)
                else:
                    now.row(role, text)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["h_conv", "repaired_sha256"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([now.digest()], pa.string())], names=["h_conv", "repaired_sha256"])
