import re

import numpy as np
from pyspark.sql import functions as F

from statementspark.llm import quality as Q

from ..conftest import SF


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
ODD = [None, "", " \n\t", "a", "é# <b>\n x\x0by ", "a b c d e f a b c d e", "a a a a a a a", "l\nl\n l\n\n\nl", "w " * 20_000, "1 2 3 4 5 6 7 8 9 10", "  x y"]


def test_counts_by_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "w": F.lit(1)})
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in Q.judge(df, []).collect()}
    assert got == {k: brute(t) for k, t in enumerate(ODD)}


def test_whole_table_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id]) for r in Q.judge(docs, []).collect())


def test_rules_are_learned_in_order_and_applied(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(400):
        kind = k % 4
        words = [w + str(rng.integers(1e6)) for w in rng.choice(["tame", "calm", "mild", "soft"], 40)]
        if kind == 0:
            words = [w + " #" for w in words]
        if kind == 1:
            words = [w.upper() + "Q" * 30 for w in words]
        rows.append((k, " ".join(words), 0 if kind < 2 else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = Q.learn(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert 1 <= len(rules) <= Q.RULES
    got = {r.doc_id: r for r in Q.judge(df, rules).collect()}
    assert all(got[k].kept == (q == 1) for k, _, q in rows)
    assert {got[k].rule for k, _, q in rows if q == 0} <= set(range(1, len(rules) + 1))


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.learn(df, none) == []
    assert Q.judge(df, []).first().kept
    assert Q.judge(df.where("false"), []).count() == 0


def test_learned_rules_are_right_on_rows_they_were_not_grown_on(spark):
    folder = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rules = Q.learn(docs, labels)
    assert rules
    part = docs.select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), F.lit(3)) >= 2).alias("pruned")).toPandas()
    judged = Q.judge(docs, rules).select("doc_id", "base_failed", "rule").toPandas()
    rows = judged.merge(part, on="doc_id").merge(labels.toPandas(), on="doc_id")
    rows = rows[rows["pruned"] & ~rows["base_failed"]]
    for k in range(1, len(rules) + 1):
        caught = rows[rows["rule"] == k]
        assert len(caught) and (caught["quality"] == 0).mean() >= Q.PRECISION
    assert rows[rows["quality"] == 1]["rule"].eq(0).mean() > 0.99


def test_repeated_and_null_ids_and_ties(spark):
    good, bad = "calm words that say one thing after another and no more 1 2 3", "LOUD WORDS # THAT SHOUT # ONE THING AFTER ANOTHER # AND MORE"
    rows = [(k // 2, f"{good if k // 2 % 2 else bad} {k // 2}") for k in range(240)] + [(None, bad + " x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k % 120, k % 2) for k in range(240)] + [(None, 0), (3, None)], "doc_id long, quality int")
    rules = Q.learn(df, labels)
    assert rules == Q.learn(df.repartition(7), labels.repartition(3))  # equal gains, one result
    got = Q.judge(df, rules).select("doc_id", "kept").collect()
    assert len(got) == 242 and all(r.kept == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None)
