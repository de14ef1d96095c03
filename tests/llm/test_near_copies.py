from itertools import combinations

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from statementspark.llm import near_copies as N

from .test_simhash import smallest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or len(a & b) >= 0.8 * len(a | b)


def texts():
    rng = np.random.default_rng(4)
    out = [None, "", "one two", "ONE two", "one two three"]
    for _ in range(20):
        base = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(8, 300))]
        out.append(" ".join(base))
        for _ in range(5):
            near = list(base)
            for at in rng.integers(0, len(near), 1 + int(rng.integers(0, 1 + len(near) // 35))):
                near[at] = f"x{rng.integers(0, 5000)}"
            out.append(" ".join(near))
    return out


def test_links_by_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "key long, text string")
    found = {tuple(sorted(r)) for r in N.links(df, df.selectExpr("key", "key AS fp")).collect()}
    want = [(i, k) for i, k in combinations(range(len(rows)), 2) if similar(rows[i], rows[k])]
    assert len(want) > 50 and found <= set(want)
    assert smallest(len(rows), found) == smallest(len(rows), want)


def test_the_stage_drops_near_copies_that_differ_in_many_bits(spark):
    rows = texts()
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(rows)], SCHEMA)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").select("doc_id").collect()]
    assert not [(i, k) for i, k in combinations(kept, 2) if similar(rows[i], rows[k])]


def test_an_outlier_at_the_head_of_a_bucket_costs_its_size(spark):
    """One set far from 5,000 near copies that share its band, and smaller than all of them by key; two more sets stand between."""
    rng = np.random.default_rng(1)
    base = np.sort(rng.choice(1 << 40, 60, replace=False))
    sets = {k: np.sort(np.append(base, [(1 << 41) + k])) for k in range(10, 5010)}
    sets[0] = np.sort(rng.choice(1 << 40, 60, replace=False))
    sets[6000] = np.sort(np.append(base[:48], rng.choice(1 << 40, 8, replace=False)))  # 0.7 from all
    sets[6001] = np.sort(np.append(sets[6000][1:], 1 << 42))  # near the last alone
    whole = spark.createDataFrame([(k, v.tolist()) for k, v in sets.items()], "sid long, grams array<long>").repartition(8)
    near, compared = N.compare(whole.select(F.lit(7).cast("long").alias("band"), "sid"), whole, 0.8)
    links = {(r.x, r.y) for df in near for r in df.collect()}
    assert compared < 6 * len(sets)
    component = {k: k for k in sets}

    def root(k):
        while component[k] != k:
            k = component[k]
        return k

    for x, y in links:
        component[max(root(x), root(y))] = min(root(x), root(y))
    assert {root(k) for k in range(10, 5010)} == {10} and {root(0), root(6000), root(6001)} == {0, 6000}


def test_rounds_give_the_components_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = [np.sort(rng.choice(1000, 40, replace=False)) for _ in range(4)]
    sets = {}
    for k in range(160):
        c = centres[k % 4] if k % 9 else rng.choice(1000, 40, replace=False)
        drop = rng.integers(0, 14)
        sets[k] = np.unique(np.append(c[rng.permutation(len(c))[drop:]], rng.choice(1000, drop)))
    whole = spark.createDataFrame([(k, v.tolist()) for k, v in sets.items()], "sid long, grams array<long>")
    near, _ = N.compare(whole.select(F.lit(7).cast("long").alias("band"), "sid"), whole, 0.8)

    def parts(links):
        component = dict.fromkeys(sets)
        component = {k: k for k in component}
        for _ in sets:
            for x, y in links:
                component[x] = component[y] = min(component[x], component[y])
        return component

    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    want = {(x, y) for x in sets for y in sets if x < y and alike(sets[x], sets[y])}
    got = {(r.x, r.y) for df in near for r in df.collect()}
    assert got <= want and len(want) > 200 and parts(got) == parts(want)
