import numpy as np
import pytest

from statementspark.llm import hamming as M


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("k, block", [(1, M.BLOCK), (4, M.BLOCK), (4, 13)])
def test_search_by_brute_force(spark, k, block):
    rng = np.random.default_rng(k)
    centres = [int(rng.integers(0, 1 << 63)) for _ in range(4)]
    rows = []
    for i in range(160):
        flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))
        rows.append((i, centres[i % 4] ^ flips if i % 5 else centres[0]))
    asked = [r for r in rows if r[0] % 40 == 0]
    make = lambda r: spark.createDataFrame([(i, signed(c)) for i, c in r], "id long, code long")
    got = {}
    for r in M.search(make(rows), make(asked), k, block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbour_id))
    for i, c in asked:
        want = sorted((bin(c ^ d).count("1"), j) for j, d in rows if j != i)[:k]
        assert [x[1:] for x in sorted(got[i])] == want


@pytest.mark.parametrize("count, alike", [(1, 0), (40, 0), (3000, 0), (3000, 20), (3000, 44)])
def test_index_by_brute_force(monkeypatch, count, alike):
    # alike: bits that all codes share, so that one value of a segment holds them all.
    monkeypatch.setattr(M, "CHUNK", 5000)
    rng = np.random.default_rng(count + alike)
    codes = np.unique(rng.integers(0, 1 << 63, count, dtype=np.uint64) >> np.uint64(alike))
    index = M.Index(codes, rng.integers(1, 4, len(codes)), rng.permutation(len(codes)))
    queries = np.append(codes[:20], rng.integers(0, 1 << 63, 20, dtype=np.uint64))
    q, code, d = index.search(queries, 5)
    for k, x in enumerate(queries):
        every = sorted((int(x ^ c).bit_count(), int(index.least[j]), j) for j, c in enumerate(codes))
        want = [(dist, j) for dist, _, j in every[:5]]
        got = [(int(b), int(a)) for a, b in zip(code[q == k], d[q == k], strict=True)]
        bound = next((dist for n, (dist, _, j) in enumerate(every) if sum(index.weights[i] for _, _, i in every[: n + 1]) >= 5), 64)
        assert got == [w for w in want if w[0] <= bound]


def test_codes_and_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (None, [1.0, 2.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [-1.0, -2.0]), (7, [None, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, code string")
    coded = M.codes(df)
    got = {r.id: r.code for r in coded.collect()}
    assert set(got) == {1, 2, 6} and got[1] == got[2] and coded.count() == 3
    found = sorted((r.query_id, r["rank"], r.neighbour_id, r.distance) for r in M.search(coded, coded).collect())
    assert found[0] == (1, 1, 2, 0) and len(found) == 6
    assert found[1][3] == bin((got[1] ^ got[6]) & (2**64 - 1)).count("1")
    empty = M.codes(df.where("false"))
    assert M.search(empty, empty).count() == 0
