"""Rules as an inverted index, stores with repeated keys, the edit log, and classifiers that fail."""

import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from statementspark.functions import rules
from statementspark.jobs import registry
from statementspark.operators import categorize as C
from statementspark.sources import stores

RULE = rules.SCHEMA
PAIR = "merchant_key string, description string"


def fits(rule, key, text):
    pattern, _, _, _, kind = rule
    hay = f"{key or ''} || {text or ''}".lower()
    if kind == "word":
        return f" {pattern} " in " " + re.sub("[^a-z0-9_]", " ", hay) + " "
    return pattern in hay if kind == "text" else bool(re.search(pattern, hay))


def test_rules_of_all_kinds_against_every_pair(spark):
    rng = random.Random(5)
    words = ["uber", "ola", "a", "tea", "stall", "hotel", "x9", "restaurant", "c/o", "7eleven", "pay", "credit", "card"]
    patterns = {rng.choice(["", "the "]) + " ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(120)}
    patterns |= {"hotel.*restaurant", "hotel.restaurant", "ho+tel", "(uber|ola)", "x.9", "tea.+stall", "^uber", "c/o", "&", "ref 0{3}", "12.*34", "r.f", "pay...card", "axis.*000", "stall .* hotel"}
    kinds = {p: "regex" if re.search(rules.SPECIAL, p) else "word" if re.match(rules.PLAIN, p) and len(p) <= 4 else "text" for p in patterns}
    table = [(p, f"c{k}", len(p), k, kinds[p]) for k, p in enumerate(sorted(patterns, key=lambda p: (-len(p), p)))]
    texts = [" ".join(rng.choices([*words, "REF000123456789", "123456789012", "12x34", "&", "axis", "reference"], k=rng.randint(0, 6))) for _ in range(300)] + [None, "", "&", "HOTEL blue Restaurant 998877665544"]
    pairs = sorted({(rng.choice(["uber", "tea stall", "", None, "unknown"]), t) for t in texts}, key=repr)
    want = {}
    for key, text in pairs:
        found = [r for r in table if fits(r, key, text)]
        if found:
            want[key, text] = min(found, key=lambda r: r[3])[1]
    df = spark.createDataFrame([*pairs, *pairs], PAIR).withColumns({"gram": F.lit("clash"), "kind": F.lit(1)})
    out = C.match_rules(df, spark.createDataFrame(table, RULE))
    got = {(r.merchant_key, r.description): r.category for r in out.collect()}
    assert got == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    # An index made before, and a rule table without rows.
    assert {(r.merchant_key, r.description): r.category for r in C.match_rules(df, C.file_rules(spark.createDataFrame(table, RULE))).collect()} == want
    assert C.match_rules(df, spark.createDataFrame([], RULE)).count() == 0


def test_a_hundred_thousand_rules(spark):
    """Rules made of part names: each narration meets those it shares a rare gram with."""
    parts = spark.read.parquet("/root/testdata/sf0.1/part.parquet")
    names = parts.select(F.concat("p_name", F.lit(" "), "p_partkey").alias("pattern"))
    more = names.select(F.explode(F.array(*[F.concat("pattern", F.lit(f" v{k}")) for k in range(5)])).alias("pattern"))
    table = more.select("pattern", F.lit("Travel").alias("category"), F.length("pattern").alias("specificity"), F.row_number().over(Window.orderBy("pattern")).alias("priority"), F.lit("text").alias("kind"))
    assert table.count() >= 100_000
    said = names.select(F.lit("k").alias("merchant_key"), F.concat(F.lit("POS "), F.upper("pattern"), F.lit(" V3")).alias("description"))
    got = C.match_rules(said, table).where("category = 'Travel'")
    assert got.count() == said.distinct().count()


TAGGED = "date date, description string, debit double, credit double, seq long"


def test_repeated_keys_never_multiply_transactions(spark):
    df = spark.createDataFrame([(None, "UPI/DR/1/ZZTOP/YESB/zztop@ybl/x", 5.0, 0.0, 1), (None, "UPI/DR/1/QQ SHOP/YESB/qq@ybl/x", 5.0, 0.0, 2)], TAGGED)
    own = spark.createDataFrame([("zztop", "A", 1), ("zztop", "B", 3), ("zztop", "C", 2)], "merchant_key string, category string, seq long")
    learned = spark.createDataFrame([("qq shop", "Travel", "q", 0.5, "m", 9), ("qq shop", "Groceries", "q", 0.6, "m", 2)], "merchant_key string, category string, display string, confidence double, model string, seq long")
    got = C.categorize(df, own, learned, rules.load_rules(spark)).orderBy("seq").collect()
    assert [(r.category, r.category_source, r.confidence) for r in got] == [("B", "override", 1.0), ("Travel", "cache", 0.5)]
    bare = C.categorize(df, own.drop("seq"), learned.drop("seq"), rules.load_rules(spark))
    assert bare.count() == 2 and bare.orderBy("seq").first().category == "C"  # without an order the greatest value stands
    assert set(bare.columns) == {*df.columns, "merchant", "merchant_key", "channel", "vpa", "category", "category_source", "confidence"}


def test_stores_of_accounts_do_not_mix(spark):
    df = spark.createDataFrame([(1, "UPI/DR/1/ZZTOP/YESB/zztop@ybl/x", 5.0, 0.0), (2, "UPI/DR/1/ZZTOP/YESB/zztop@ybl/x", 5.0, 0.0)], "account_id long, description string, debit double, credit double")
    own = spark.createDataFrame([(2, "zztop", "Mine")], "account_id long, merchant_key string, category string")
    none = spark.createDataFrame([], "account_id long, merchant_key string, category string, confidence double")
    got = C.categorize(df, own, none, rules.load_rules(spark), keys=("account_id",)).orderBy("account_id").collect()
    assert [r.category for r in got] == ["Uncategorised", "Mine"]
    edits = spark.createDataFrame([(1, "ZZtop", "X", 1), (1, "zztop", "Y", 2), (2, "zztop", "Uncategorised", 1)], "account_id long, merchant_key string, category string, seq long")
    assert [tuple(r) for r in C.set_overrides(own, edits, ("account_id",)).select("account_id", "merchant_key", "category").collect()] == [(1, "zztop", "Y")]


ANSWER = "merchant_key string, category string, display string, confidence double, model string, seq long"


def test_the_last_answer_of_a_key_wins(spark):
    said = spark.createDataFrame([("acme", "Travel", "A", 0.5, "m", 1), ("Acme", "Groceries", None, None, None, 3), ("acme", "Imaginary", "", 0.1, "m", 9), ("acme", "Shopping", "", 0.2, "m", 2), (" !", "Travel", "", 0.2, "m", 4)], ANSWER)
    asked = spark.createDataFrame([("acme",), ("acme",)], "merchant_key string")
    assert [(r.merchant_key, r.category) for r in C.validate_labels(said, asked).collect()] == [("acme", "Shopping")]
    cache = spark.createDataFrame([("acme", "Rent & Housing", "x", 0.9, "", 0), ("old", "Travel", "o", 0.9, "", 0), ("old", "Shopping", "o", 0.9, "", 1)], ANSWER)
    assert sorted(map(tuple, C.remember(cache, said).collect())) == [("acme", "Groceries", "Acme", 0.8, ""), ("old", "Shopping", "o", 0.9, "")]
    rows = spark.createDataFrame([("acme", "Uncategorised", "none", 0.0), ("b", "Travel", "rule", 0.9)], "merchant_key string, category string, category_source string, confidence double")
    assert sorted(map(tuple, C.apply_labels(rows, said).collect())) == [("acme", "Imaginary", "llm", 0.1), ("b", "Travel", "rule", 0.9)]


BATCH = "batch long, merchant_key string, merchant string, narration string, channel string, direction string"


@pytest.mark.parametrize("bad, kept", [({3}, 6), ({0}, 0), (set(), 10), ({4, 1}, 2), ({9}, 10)])
def test_answers_before_a_failing_batch_stay(spark, bad, kept):
    batches = spark.createDataFrame([(k // 2, f"m{k}", "M", "n", "UPI", "debit") for k in range(10)], BATCH)

    def say(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["batch"].iloc[0] in bad:
            raise OSError("no network")
        return pd.DataFrame({"merchant_key": pdf["merchant_key"], "category": "Travel", "display": "", "confidence": 0.5, "model": "x"})

    got = C.classify(batches, say).orderBy("seq").collect()
    assert [r.merchant_key for r in got] == [f"m{k}" for k in range(kept)]
    assert len({r.seq for r in got}) == kept


def test_a_classifier_of_one_account_that_fails_leaves_the_others(spark):
    batches = spark.createDataFrame([(a, b, f"m{a}{b}", "M", "n", "UPI", "debit") for a in (1, 2) for b in range(3)], "account_id long, " + BATCH)

    def say(pdf):
        if (pdf["account_id"].iloc[0], pdf["batch"].iloc[0]) == (1, 1):
            return pd.DataFrame({"nothing": [1]})  # an answer that cannot be read is a failure too
        return pd.DataFrame({"merchant_key": pdf["merchant_key"], "category": "Travel", "display": "", "confidence": 0.5, "model": "x"})

    got = C.classify(batches, say, keys=("account_id",)).collect()
    assert sorted(r.merchant_key for r in got) == ["m10", "m20", "m21", "m22"]


def test_stores_tell_entries_by_their_type(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"a": "2nd home", "b": "Travel", "c": 7, "d": "true", "e": True, "f": None, "g": ["x"], "h": {"i": "j"}, "k": "[l]", "m": '{"n": 1}', "": "empty", "q r": ""}, indent=2))
    got = sorted(map(tuple, stores.read_overrides(spark, str(tmp_path / "a.json")).collect()))
    assert got == [("", "empty"), ("a", "2nd home"), ("b", "Travel"), ("d", "true"), ("k", "[l]"), ("m", '{"n": 1}'), ("q r", "")]
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("[1, 2]")
    (tmp_path / "d.json").write_text("")
    for name in "bcd":
        assert stores.read_overrides(spark, str(tmp_path / f"{name}.json")).count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"x": {"category": "Travel", "confidence": "0.5"}, "y": "no object", "z": {"display": "Z"}}))
    assert sorted(map(tuple, stores.read_cache(spark, str(tmp_path / "e.json")).collect())) == [("x", "Travel", None, 0.5, None), ("z", None, "Z", None, None)]
    (tmp_path / "f.json").write_text(json.dumps({"categories": ["A", 1, None, "B"]}))
    assert sorted(r.name for r in stores.read_custom_categories(spark, str(tmp_path / "f.json")).collect()) == ["A", "B"]
    assert stores.read_overrides(spark, str(tmp_path / "missing"), ("account_id",)).columns == ["account_id", "merchant_key", "category"]


EDIT = "merchant_key string, op string, seq long, category string"


def test_a_log_of_edits(spark, tmp_path):
    path = str(tmp_path / "log")
    stores.append_edits(spark.createDataFrame([("a", "set", 5, "A"), ("a", "set", 2, "B"), ("b", "set", 1, "C"), ("c", "delete", 9, None)], EDIT), path, 1)
    stores.append_edits(spark.createDataFrame([(None, "clear", 3, None), ("d", "set", 2, "D"), ("b", "set", 4, "E"), ("a", "set", 4, "F"), ("a", "delete", 6, None)], EDIT), path, 2)
    at = lambda v: sorted(map(tuple, stores.store_at(stores.read_edits(spark, path, v)).collect()))
    assert at(1) == [("a", "A"), ("b", "C")]
    assert at(2) == at(None) == [("b", "E")]
    with pytest.raises(Exception, match="(?i)exists"):
        stores.append_edits(spark.createDataFrame([("a", "set", 5, "A")], EDIT), path, 2)


def test_remember_hears_every_account_and_what_the_whole_ledger_asks(spark, tmp_path):
    """Accounts from 997 on count too, and the last valid answer to a question replaces a later one whose key is written otherwise."""
    orders = [(24 * a + k, a, 100.0 * a, "1995-01-01") for a, k in ((2023, 17), (2044, 17), (2128, 0))]  # 17: a payee that nothing resolves
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.merchant_key: r.category for r in registry.QUERIES["remember"](spark, str(tmp_path)).collect()}
    assert {k: c for k, c in got.items() if k.startswith("nobody")} == {f"nobody asked {x}": "Travel" for x in ("dbdf", "dbgg", "dcdl")}
    # Only heard; asked, with Groceries by its own key and Travel written otherwise; the same, but nobody asked.
    assert {k: c for k, c in got.items() if k.startswith("vendor qx")} == {"vendor qxdm": "Groceries", "vendor qxhb": "Groceries", "vendor qxcfg": "Travel"}
