import re

import numpy as np
import pytest
import xxhash

from statementspark.llm import simhash as S


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def smallest(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_fingerprints(spark):
    texts = ["A b c d", "a B c d", "one two", "ÉA éa x", "", None, " \n", "w " * 20_000, "x y z x y z x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp for r in S.fingerprints(df).collect()}
    assert got == {k: signed(fingerprint(t)) for k, t in enumerate(texts)}


@pytest.mark.parametrize("distance", [1, 3, 4])
def test_links_by_brute_force(spark, distance):
    rng = np.random.default_rng(distance)
    found = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(25):
        base = int(rng.integers(0, 1 << 63)) * 2
        found |= {base} | {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, distance + 2), replace=False)) for _ in range(6)}
    fps = sorted(found)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= distance}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = S.links(df, distance).collect()
    assert len(got) == len(want) and {tuple(sorted(r)) for r in got} == want


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(3)
    pairs = [(k, k + 1) for k in range(40)] + [tuple(map(int, rng.integers(50, 200, 2))) for _ in range(90)]
    want = smallest(200, pairs)
    got = {r.v: r.root for r in S.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(want[v] == root for v, root in got.items())
    assert {v for a, b in pairs if a != b for v in (a, b)} == set(got)


def test_documents(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from all of the other animals in these woods"
    rows = [(5, text, "a"), (3, text, "b"), (9, text.upper(), "c"), (1, "something wholly different is written in this one here", "d"), (8, None, "e"), (7, "", "f"), (None, text, "g"), (3, text, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.component_id) for r in S.near_duplicates(df).collect())
    assert got == sorted([("5", 3), ("3", 3), ("9", 3), ("1", 1), ("8", 7), ("7", 7), ("None", 3), ("3", 3)])
    kept = S.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 7]
    assert S.near_duplicates(df.where("false")).count() == 0
