from collections import Counter

import pytest
from pyspark.sql import functions as F

from statementspark.llm import mixing as M
from statementspark.llm.common import count_words


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Reshare the excess by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        total = sum(w[s] for s in open_)
        give = {s: left * w[s] / total for s in open_}
        over = [s for s in open_ if give[s] > most * sizes[s]]
        if not over:
            return capped | give
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


def test_targets_by_brute_force(spark):
    for sizes in ({"a": 100, "b": 50, "c": 500, None: 70}, {"é": 10, "z": 1000, "Z": 5, "b": 5, "q": 400, "r": 2}, {"x": 5}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in M.targets(df).collect()}
        assert got == pytest.approx(water(sizes))


def mixed(spark, rows, seed=17):
    df = spark.createDataFrame(rows, "source string, doc_id long, size long")
    return M.expand(M.mix_classes(df, seed=seed))


def test_sums_caps_and_reruns(spark):
    rows = [(("a", "b", None)[k % 3], k, 5 + k * 7 % 90) for k in range(600)] + [("hot", k, 10) for k in range(300)]
    got = mixed(spark, rows).toPandas()
    assert len(got) == 900
    assert (got["copies"] <= 2).all()
    for _, part in got.groupby("source", dropna=False):
        assert abs((part["copies"] * part["size"]).sum() - part["target"].iloc[0]) <= part["size"].max()
    again = mixed(spark, list(reversed(rows))).toPandas()
    key = ["source", "doc_id", "size", "copies"]
    assert got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()


def test_each_document_keeps_its_probability(spark):
    rows = [("a", k, 10 + k) for k in range(6)] + [("b", 100 + k, 100) for k in range(4)]
    taken = {k: 0 for k in range(6)}
    runs = 30
    for seed in range(runs):
        for r in mixed(spark, rows, seed).where("source = 'a'").collect():
            taken[r.doc_id] += r.copies
            rate = r.target / r.source_size
    # Half a copy more or less over 30 runs is far outside chance for a broken draw.
    assert all(abs(n / runs - rate) < 0.45 for n in taken.values())


def test_odd_rows(spark):
    assert mixed(spark, []).count() == 0
    rows = [("a", 1, 0), ("a", None, 5), ("a", None, 5), ("a", None, 5), (None, None, 0), ("b", 2, 3)]
    got = mixed(spark, rows).toPandas()
    assert len(got) == 6 and (got["copies"] >= 0).all()
    docs = spark.createDataFrame([(1, "x y", "a", "k"), (1, "x y", "a", "k"), (2, None, None, "z"), (3, "w", "b", "k")], "doc_id long, text string, source string, copies string")
    out = M.mix(docs, F.lit(2).cast("long"))
    assert out.columns == docs.columns and out.count() > 0


def test_equal_rows_and_null_ids_are_mixed_whole(spark):
    rows = [(None, f"text {k} of four", "a", "x") for k in range(40)] + [(1, "one and the same row", "b", "y")] * 30 + [(2, "alone here", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, source string")
    size = count_words(F.col("text"))
    found = [sorted((str(r.doc_id), r.text, r.n, str(r.source)) for r in M.mix(docs.repartition(k), size).collect()) for k in (1, 5)]
    assert found[0] == found[1]
    taken = {s: sum(len(x[1].split()) for x in found[0] if x[3] == s) for s in ("x", "y", "None")}
    want = {str(r.source): r.target for r in M.targets(docs.groupBy("source").agg(F.sum(size).alias("source_size"))).collect()}
    assert all(abs(taken[s] - want[s]) <= 5 for s in taken)
    assert all(n <= 2 for n in Counter(x[1] for x in found[0] if x[0] == "None").values())
