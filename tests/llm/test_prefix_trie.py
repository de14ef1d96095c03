import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statementspark.llm import prefix_trie as P
from statementspark.llm import queries

from ..conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows):
    """The trie by hand: a dictionary of paths."""
    own = {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda v: (*v[:2], hashlib.sha256(f"{len(v[2])}:{v[2]}{v[3]}".encode()).hexdigest(), len(v[3].encode())))] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        whole = ([] if c is None else own.get(c - c % 5, [])[:h]) + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    least = lambda path: min((c for c, _ in members[path] if c is not None), default=None)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted((c for c, end in cs if end), key=lambda c: (c is not None, c or 0))
        out.append((
            least(path), len(path), least(path[:-1]) if path else None, len(cs), sum(len(p) == len(path) + 1 for p in below), sum(not any(len(x) > len(p) and x[: len(p)] == p for x in below) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def result(frame):
    return sorted((tuple(r[n] for n in NAMES) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("longest", [0, 3, 20, 70])
def test_against_the_trie_by_hand(spark, longest):
    rng = np.random.default_rng(longest)
    rows = []
    for c in [*range(30), 1000, 1003, None]:
        for t in range(int(rng.integers(1, longest + 2))):
            rows.append((c, None if rng.random() < 0.05 else t, ["user", None, ""][rng.integers(0, 3)], ["same", "é", None, ""][rng.integers(0, 4)] if t > 2 else "same"))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"i": F.lit("clash"), "digest": F.lit(1), "h": F.lit(2), "family": F.lit(3)})
    assert result(P.build(df)) == expected(rows)


def test_roll_up_reaches_all_ancestors(spark):
    """A chain of 100 nodes, its sums by seven rounds."""
    n = spark.range(101).selectExpr("id AS depth", "id AS a", "-id AS b", "IF(id = 0, NULL, id - 1) AS pa", "IF(id = 0, NULL, 1 - id) AS pb", "id AS v")
    got = {r.depth: r.v for r in P.roll_up(n, ("v",), 100).collect()}
    assert got == {d: sum(range(d, 101)) for d in range(101)}


def test_empty_table(spark):
    assert P.build(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op13_jumping_trie(spark, SF)) == expected(rows)
