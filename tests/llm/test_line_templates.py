import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from statementspark.llm import line_templates as T

DOCS = "doc_id long, text string, n_lines int, keep string"


def run(spark, rows, **kw):
    found = T.dedup_lines(spark.createDataFrame(rows, DOCS), **kw)
    return {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in found.collect()}


def test_repeats_go_and_the_first_stays(spark):
    rows = [(2, "the same long line here\nonly two words of mine", 0, "a"), (1, "the same long line here\nmy own thing to say", 0, "b"), (3, "\tthe same long line here \nshort one", 0, "c")]
    got = run(spark, rows)
    assert got[1] == ("the same long line here\nmy own thing to say", 2, 2)
    assert got[2] == ("only two words of mine", 2, 1)
    assert got[3] == ("short one", 2, 1)


def test_variable_fields_and_differing_words_share_a_template(spark):
    rows = [(1, "page 3 of 10 printed for office", 0, ""), (2, "page 47 of 99 printed for office", 0, ""), (3, "job run went well on host alpha today", 0, ""), (4, "job run went well on host beta today", 0, ""), (5, "job run went far away from every alpha", 0, "")]
    got = run(spark, rows)
    assert [got[k][2] for k in (1, 2, 3, 4, 5)] == [1, 0, 1, 0, 1]


def test_repeats_inside_one_document_stay_when_no_other_has_them(spark):
    got = run(spark, [(1, "la la la la la\nla la la la la", 0, ""), (2, "something else entirely in here", 0, "")])
    assert got[1][2] == 2
    got = run(spark, [(1, "la la la la la\nla la la la la", 0, ""), (2, "la la la la la", 0, "")])
    assert (got[1][0], got[2][0]) == ("la la la la la", "")


def test_odd_rows(spark):
    rows = [(None, None, 0, ""), (1, "", 0, ""), (None, "a line that stands in two", 0, ""), (7, "a line that stands in two", 0, ""), (8, "own line of this doc", 0, ""), (8, "own line of this doc", 0, "")]
    df = T.dedup_lines(spark.createDataFrame(rows, DOCS))
    got = sorted((str(r.doc_id), str(r.text), r.keep) for r in df.collect())
    assert len(got) == 6
    assert ("7", "", "") in got and ("None", "a line that stands in two", "") in got
    assert sum(x[1] == "own line of this doc" for x in got) == 2
    assert T.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(f"w{chr(97 + k % 26)}" for k in range(30_000))
    assert run(spark, [(1, long, 0, ""), (2, long, 0, "")])[2][0] == ""


def test_batches_may_cut_a_leaf(spark):
    coded = np.array([[1, 2, 3, 4], [1, 2, 3, 5], [9, 8, 7, 6]], np.int32)
    assert T.cluster(coded).tolist() == [[1, 2, 3, 0], [1, 2, 3, 0], [9, 8, 7, 6]]
    rows = pa.RecordBatch.from_pylist([{"leaf": k // 4, "part": 0, "key": k, "codes": [1, 2, 3, 4 + k % 4]} for k in range(12)], pa.schema([("leaf", pa.int64()), ("part", pa.int64()), ("key", pa.int64()), ("codes", pa.list_(pa.int32()))]))
    for size in (1, 3, 5, 12):
        out = [r for b in T.fit(rows.slice(k, size) for k in range(0, 12, size)) for r in b.to_pylist()]
        assert [r["key"] for r in out] == list(range(12)) and all(r["codes"] == [1, 2, 3, 0] for r in out)


def tree(rows, node=10**9):
    """What stays of each (doc_id, text), by the definition: leaves in memory, their lines in the order of their hashes."""
    masked = lambda w: "<*>" if re.search("[0-9]", w) else w
    places, lines = [], {}
    for d, text in rows:
        for p, line in enumerate(text.split("\n")):
            words = line.split()
            if not words:
                continue
            plain = len(words) < 4 and all(re.search("[0-9]", w) for w in words)
            made = tuple(words if plain else map(masked, words))
            key = xxhash.xxh64_intdigest(" ".join(made).encode(), seed=42)
            leaf = made if len(made) < 4 else (len(made), *made[:3])
            lines.setdefault(leaf, {})[key - (1 << 64) if key >> 63 else key] = made
            places.append((d, p, leaf, made))
    template = {}
    for leaf, own in lines.items():
        found = []
        for key in sorted(own):
            words = own[key]
            same = [sum(a == b != "<*>" for a, b in zip(words, t, strict=True)) for t in found]
            score = [s + min(s, sum("<*>" in (a, b) for a, b in zip(words, t, strict=True))) for s, t in zip(same, found, strict=True)]
            best = max(range(len(found)), key=lambda k: (score[k], -k), default=None)
            if best is not None and score[best] >= 0.7 * len(words) and same[best]:
                found[best] = tuple(a if a == b else "<*>" for a, b in zip(words, found[best], strict=True))
            else:
                best = len(found)
                found.append(words)
            template[leaf, words] = (leaf, best)
    docs, kept = {}, {}
    for d, _, leaf, words in places:
        docs.setdefault(template[leaf, words], set()).add(d)
    firsts = set()
    for d, p, leaf, words in sorted(places):
        t = template[leaf, words]
        if len(docs[t]) < 2 or (d == min(docs[t]) and t not in firsts):
            kept.setdefault(d, []).append(p)
            firsts.add(t)
    return {d: "\n".join(x for p, x in enumerate(text.split("\n")) if not x.split() or p in kept.get(d, [])) for d, text in rows}


def crowd():
    rng = np.random.default_rng(4)
    names = "alpha beta gamma delta eps zeta eta".split()
    some = lambda k: " ".join(rng.choice(names, k))
    rows = []
    for d in range(120):
        lines = [f"one two three {some(int(rng.integers(1, 5)))}", f"got {d} items from {some(2)}", some(2), f"my own {d}x {some(6)}", "", "Page 3"]
        rows.append((d, "\n".join(rng.permutation(lines))))
    return rows


@pytest.mark.parametrize("partitions", ["4", "31"])
def test_tree_by_brute_force(spark, partitions):
    rows = crowd()
    df = spark.createDataFrame([(d, t, 0, "") for d, t in rows], DOCS)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: r.text for r in T.dedup_lines(df).collect()}
        sliced = {r.doc_id: r.text for r in T.dedup_lines(df.repartition(int(partitions) // 2 or 1), node=5, most_leaves=0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == tree(rows)
    SLICED.setdefault("x", sliced)
    assert sliced == SLICED["x"]  # the same in another layout


SLICED: dict = {}


def test_short_lines_recur_only_when_equal(spark):
    got = run(spark, [(1, "All rights reserved.\nPage 3\n\n17", 0, ""), (2, "All rights reserved.\nPage 4\n\n18", 0, ""), (3, "All rights waived.\n17\n", 0, "")])
    assert [got[k][0] for k in (1, 2, 3)] == ["All rights reserved.\nPage 3\n\n17", "\n18", "All rights waived.\n"]


def test_slices_of_one_leaf_are_merged(spark):
    words = [f"{a} {b}" for a in ("k", "l", "m", "n", "o", "p") for b in ("q", "r", "s", "t")]
    rows = [(k, f"one two three four five six {w}", 0, "") for k, w in enumerate(words)] + [(50, "one two three other words in here now", 0, "")]
    assert sorted(k for k, v in run(spark, rows, node=2).items() if v[2]) == [0, 50]


def test_similar_lines_of_one_document_are_no_repeat(spark):
    both = "job run went well on host alpha today\njob run went well on host beta today"
    rows = [(1, both, 0, ""), (2, "own", 0, "")]
    assert run(spark, rows)[1] == (both, 2, 2)
    assert run(spark, [*rows, (1, both, 0, "")])[1] == (both, 2, 2)
    rows += [(3, "job run went well on host gamma today", 0, "")]
    assert run(spark, rows)[3][0] == "" and run(spark, rows, min_docs=3)[3][2] == 1
