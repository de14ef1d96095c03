import datetime as dt

import pytest
from pyspark.sql import functions as F

from statementspark.functions import rules, scalars
from statementspark.operators import categorize, insights, proof, review
from statementspark.sources import statements, stores

ROW = "account_id int, source_file string, seq long, date date, description string, debit double, credit double, balance double"


def rows(spark, *items, schema=ROW):
    return spark.createDataFrame(list(items), schema)


def line(seq, debit, credit, balance, day=1, text="x", file="f"):
    return (1, file, seq, dt.date(2024, 1, day), text, debit, credit, balance)


def test_reconcile_uses_the_row_right_before(spark):
    df = rows(spark, line(1, 0.0, 5.0, 5.0), line(2, 2.0, 0.0, None), line(3, 1.0, 0.0, 2.0), line(4, 1.0, 0.0, 0.5))
    got = [r.reconciled for r in proof.reconcile(df).orderBy("seq").collect()]
    assert got == [True, True, True, False]
    report = proof.parse_report(proof.reconcile(df)).first()
    assert (report.rows_reconciled, report.unreconciled_rows, report.reconciled) == (3, [3], False)


def test_report_without_balances(spark):
    df = rows(spark, line(1, 1.0, 0.0, None), line(2, 2.0, 0.0, None))
    report = proof.parse_report(proof.reconcile(df)).first()
    assert report.summary == "2 rows parsed (no balance column — cannot verify)"
    assert report.reconciliation_rate == 0.0


def test_direction_walks_over_missing_balances(spark):
    df = rows(spark, line(1, 5.0, 0.0, 100.0), line(2, 7.0, 0.0, None), line(3, 4.0, 0.0, 104.0), line(4, 9.0, 0.0, 95.0)).withColumn("ambiguous", F.lit(True))
    got = [(r.debit, r.credit) for r in proof.direction_from_balance(df).orderBy("seq").collect()]
    assert got == [(5.0, 0.0), (7.0, 0.0), (0.0, 4.0), (9.0, 0.0)]


def test_newest_first_is_reversed_and_same_days_keep_their_order(spark):
    days = [5, 5, 3, 1]
    df = rows(spark, *[line(k, 1.0, 0.0, None, d, f"t{k}") for k, d in enumerate(days)]).withColumnRenamed("seq", "line_no")
    got = [r.description for r in proof.ensure_chronological(df).orderBy("seq").collect()]
    assert got == ["t3", "t2", "t1", "t0"]


def test_combine_ignores_the_file_and_treats_null_balances_as_equal(spark):
    df = rows(spark, line(1, 1.0, 0.0, None, file="b"), line(1, 1.0, 0.0, None, file="a"), line(2, 1.0, 0.0, 3.0, file="b"))
    assert sorted(r.source_file for r in proof.combine(df).collect()) == ["a", "b"]


TAGGED = ROW + ", merchant string, merchant_key string, channel string, category string, category_source string, confidence double"


def tagged(spark, *items):
    return rows(spark, *items, schema=TAGGED)


def test_money_rules(spark):
    def one(seq, debit, credit, category, day=1):
        return (*line(seq, debit, credit, None, day), "M", "m", "Other", category, "rule", 0.9)

    df = tagged(spark, one(1, 10.0, 0.0, "Transfers"), one(2, 5.0, 0.0, "Uncategorised", 3), one(3, 0.0, 7.0, "Investments & SIP"), one(4, 0.0, 9.0, "Transfers"))
    head = insights.headline(df).first()
    assert (head.money_in, head.money_out, head.excluded, head.largest_category) == (7.0, 5.0, 10.0, "Uncategorised")
    assert insights.by_category(df).count() == 1
    assert [r.amount for r in insights.daily(df, True).orderBy("date").collect()] == [10.0, 0.0, 5.0]


def test_empty_tables(spark):
    df = tagged(spark)
    assert insights.headline(df).first().transactions == 0
    assert insights.daily(df).count() == insights.by_month(df).count() == insights.detect_recurring(df).count() == 0
    assert categorize.coverage(df).first().value_rate == 0.0
    assert review.needs_review(df).count() == 0


def test_keys_of_one_account_are_the_plain_result(spark):
    def one(seq, debit, day):
        return (*line(seq, debit, 0.0, None, day), "M", "m", "Other", "Shopping", "rule", 0.9)

    df = tagged(spark, one(1, 4.0, 1), one(2, 6.0, 9))
    for f in (insights.by_category, insights.by_month, insights.daily, insights.top_merchants, insights.monthly_totals):
        keyed = f(df, keys=("account_id",)).drop("account_id")
        plain = f(df)
        assert sorted(map(tuple, keyed.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_layers_in_order(spark):
    df = rows(spark, line(1, 5.0, 0.0, None, text="POS 1 AMAZON SHOP"), line(2, 0.0, 5.0, None, text="AMAZON SHOP REFUND"), line(3, 5.0, 0.0, None, text="QQQQ WWWW"), line(4, 0.0, 5.0, None, text="QQQQ WWWW"))
    none = spark.createDataFrame([], "merchant_key string, category string, display string, confidence double, model string")
    got = [(r.category, r.category_source, r.confidence) for r in categorize.categorize(df, none.select("merchant_key", "category"), none, rules.load_rules(spark)).orderBy("seq").collect()]
    assert got == [("Shopping", "rule", 0.9), ("Income", "rule", 0.9), ("Uncategorised", "none", 0.0), ("Income", "heuristic", 0.6)]
    own = spark.createDataFrame([("qqqq wwww", "Clubs")], "merchant_key string, category string")
    got = categorize.categorize(df, own, none, rules.load_rules(spark)).where("seq = 3").first()
    assert (got.category, got.category_source, got.confidence) == ("Clubs", "override", 1.0)


def test_short_rules_need_word_bounds(spark):
    df = spark.createDataFrame([("currently", "current account"), ("flat rent", "x")], "merchant_key string, description string")
    got = {r.merchant_key: r.category for r in categorize.match_rules(df, rules.load_rules(spark, {"Rent & Housing": "rent"})).collect()}
    assert got == {"flat rent": "Rent & Housing"}


def test_classifier_runs_batch_by_batch(spark):
    pending = spark.createDataFrame([(f"k{i}", "M", "n", "Other", "debit", float(i)) for i in range(5)], "merchant_key string, merchant string, narration string, channel string, direction string, amount double")
    batches = categorize.batch_merchants(pending, size=2, max_batches=2)
    assert [r.merchant_key for r in batches.orderBy("batch", "merchant_key").collect()] == ["k3", "k4", "k1", "k2"]
    said = categorize.classify(batches, lambda pdf: pdf.assign(category="Travel", display="", confidence=0.7, model="m-1")[["merchant_key", "category", "display", "confidence", "model"]])
    assert categorize.validate_labels(said, batches).count() == 4


def test_files_to_transactions(spark, tmp_path):
    good = "My Bank;;\r\n\r\nDate;Narration;Withdrawal Amt.;Deposit Amt.;Closing Balance\r\n03/01/2024;B SHOP;;5.00;15.00\r\n02/01/2024;\"A; SHOP\";1.00;;10.00\r\n01/01/2024;C SHOP;1.00;;11.00\r\nTotal;;2.00;5.00;\r\n"
    (tmp_path / "good.csv").write_bytes("﻿".encode() + good.encode())
    (tmp_path / "latin.csv").write_bytes("Date,Details,Amount,Type,Balance\n1/2/24,Café – x,\"1,000.00\",DR,5\n2/2/24,y,3,CR,8\n".encode("cp1252"))
    (tmp_path / "junk.csv").write_bytes(b"nothing here\nat all\n")
    found, reports, errors = statements.ingest(spark, str(tmp_path))
    got = {(r.source_file, r.seq): (str(r.date), r.description, r.debit, r.credit) for r in found.collect()}
    assert got["good.csv", 1] == ("2024-01-01", "C SHOP", 1.0, 0.0)
    assert got["good.csv", 2][1] == "A; SHOP"
    assert got["latin.csv", 1] == ("2024-02-01", "Café – x", 1000.0, 0.0)
    assert len(got) == 5
    assert {r.source_file: r.reconciled for r in reports.collect()} == {"good.csv": True, "latin.csv": True}
    assert [r.source_file for r in errors.collect()] == ["junk.csv"]


@pytest.mark.parametrize(
    "cells, mapping",
    [
        (["Date", "Narration", "Chq./Ref.No.", "Value Dt", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"], {"date": 3, "description": 1, "debit": 4, "credit": 5, "balance": 6}),
        (["Txn Date", "Remarks", "Amount", "Dr / Cr"], {"date": 0, "description": 1, "amount": 2, "drcr": 3}),
        (["a", None, ""], {}),
    ],
)
def test_map_header(cells, mapping):
    assert statements.map_header(cells) == mapping


def test_stores(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"swiggy": "Groceries", "bad": 3, "worse": ["x"]}')
    assert [tuple(r) for r in stores.read_overrides(spark, str(tmp_path / "o.json")).collect()] == [("swiggy", "Groceries")]
    (tmp_path / "c.json").write_text('{"k": {"category": "Travel", "display": "K", "confidence": 0.5, "model": "m"}}')
    assert stores.read_cache(spark, str(tmp_path / "c.json")).first().confidence == 0.5
    assert stores.read_cache(spark, str(tmp_path / "absent.json")).count() == 0
    (tmp_path / "b.json").write_text("{broken")
    assert stores.read_custom_categories(spark, str(tmp_path / "b.json")).count() == 0
    one = stores.add_category(spark.createDataFrame([], "name string"), " Pets ")
    assert [r.name for r in stores.add_category(one, "pets").collect()] == ["Pets"]
    assert [r.name for r in stores.add_category(one, "travel").collect()] == ["Pets"]


def test_exports(spark, tmp_path):
    df = tagged(spark, (*line(1, 4.0, 0.0, 1.0), "M", "m", "Other", "Shopping", "rule", 0.9)).withColumn("decided_by", F.lit("Rule"))
    stores.export_transactions(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().direction == "Out"
    assert stores.export_report_tables(df, str(tmp_path / "report")) == ["transactions", "by_category", "by_month"]


def test_text_statement(spark):
    text = ["Page 1", "01-02-2024 FIRST SHOP 10.00 CR 110.00", "more of it", "02-02-2024 SECOND 02/02/2024 1,00,000.00 0.00 99.00", "opening balance here", "03-02-2024 no amount"]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(text)], "source_file string, line_no int, line string")
    got = [tuple(r)[2:] for r in statements.parse_text_statement(df).orderBy("line_no").collect()]
    assert got[0] == (dt.date(2024, 2, 1), "FIRST SHOP more of it", 0.0, 10.0, 110.0, False)
    assert got[1] == (dt.date(2024, 2, 2), "SECOND", 100000.0, 0.0, 99.0, True)


def test_header_words_with_and_without_signs():
    said = ["Txn Date", "Narration", "Withdrawal(Dr)", "Deposit_Amt.", "Closing-Balance", "Chq/Ref No."]
    assert statements.map_header(said) == {"date": 0, "description": 1, "debit": 2, "credit": 3, "balance": 4}
    assert statements.map_header(["Date", "Remarks", "Amount", "Dr / Cr", "Balance"])["drcr"] == 3
    assert statements.map_header(["Date", "Remarks", "Amount", "Txn Type"])["drcr"] == 3
    assert "debit" not in statements.map_header(["Date", "Withdrawn from", "indraw"])
    assert statements.map_header([None, "", "DEBIT/CREDIT(INR)"]) == {"drcr": 2}


def test_split_of_quoted_and_torn_lines(spark):
    said = ['a,"b, ""c""",d', "a,,b", 'x,"y', '"q",', "", '"1,23,456.00","2"']
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(said)], "source_file string, line_no int, line string")
    got = statements.split_cells(lines, spark.createDataFrame([("f", ",")], "source_file string, delimiter string"))
    want = [["a", 'b, "c"', "d"], ["a", "", "b"], ['x,"y'], ["q", ""], [""], ["1,23,456.00", "2"]]
    assert [r.cells for r in got.orderBy("line_no").collect()] == want
    long = spark.createDataFrame([("f", 0, ",".join(['"a,b"'] * 100_000))], "source_file string, line_no int, line string")
    assert statements.split_cells(long, spark.createDataFrame([("f", ",")], "source_file string, delimiter string")).selectExpr("size(cells)").first()[0] == 100_000


def test_rule_files(spark, tmp_path):
    text = "# mine\nTravel:\n  - irctc\n  - 'make my trip'  \n\nGroceries:\n  - \"big.*bazaar\"\n  - dmart # shop\n  - abc\n"
    (tmp_path / "rules.yaml").write_text(text)
    got = [(r.pattern, r.category, r.kind, r.priority) for r in rules.read_rules(spark, str(tmp_path / "rules.yaml")).orderBy("priority").collect()]
    assert got == [("make my trip", "Travel", "text", 0), ("big.*bazaar", "Groceries", "regex", 1), ("irctc", "Travel", "text", 2), ("dmart", "Groceries", "text", 3), ("abc", "Groceries", "word", 4)]
    for bad in ("Imaginary:\n  - x\n", "  - x\n", "Travel:\n  - (x\n"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ValueError):
            rules.read_rules(spark, str(tmp_path / "bad.yaml"))
    (tmp_path / "lists.yaml").write_text("# own\nTravel: [irctc, 'make, trip', \"a b\"]  # three\nGroceries:\n- dmart\nShopping: []\n")
    got = [(r.pattern, r.category) for r in rules.read_rules(spark, str(tmp_path / "lists.yaml")).orderBy("priority").collect()]
    assert got == [("make, trip", "Travel"), ("irctc", "Travel"), ("dmart", "Groceries"), ("a b", "Travel")]
    raw = spark.createDataFrame([("Travel", " b ", 1), ("Travel", "a", 0), ("Groceries", "", 2)], rules.RAW)
    assert [(r.pattern, r.priority) for r in rules.rank_rules(raw).collect()] == [("a", 0), ("b", 1)]
    with pytest.raises(Exception, match="no such category"):
        rules.rank_rules(spark.createDataFrame([("Nope", "x", 0)], rules.RAW)).collect()


def test_rules_with_digits_see_whole_narrations(spark):
    df = spark.createDataFrame([("m", "PAID 123456789012 box8 shop"), ("m", "PAID 999999999999 shop"), (None, None)], "merchant_key string, description string")
    table = spark.createDataFrame(rules._ranked([("456789", "Travel"), ("shop", "Shopping"), ("box8", "Groceries"), ("id 1\\d+", "Income")]), rules.SCHEMA)
    got = {r.description: r.category for r in categorize.match_rules(df, table).collect()}
    assert got == {"PAID 123456789012 box8 shop": "Income", "PAID 999999999999 shop": "Shopping"}


def test_model_families(spark):
    df = spark.createDataFrame([("claude-y",), ("CLAUDE",), ("gpt-x",), ("ChatGPT",), ("o1",), ("O4-mini",), ("llama",), ("my gpt",)], "m string")
    assert [r.f for r in df.select(scalars.model_family(F.col("m")).alias("f")).collect()] == ["Claude", "Claude", "OpenAI", "OpenAI", "OpenAI", "OpenAI", "AI", "AI"]


def test_masked_references_leave_addresses(spark):
    df = spark.createDataFrame([("UPI/123456789012/x",), ("UPI/123456789012@ybl/9",), ("a 12345678901",), (None,)], "m string")
    assert [r.f for r in df.select(scalars.without_references(F.col("m")).alias("f")).collect()] == ["UPI/000000000000/x", "UPI/123456789012@ybl/9", "a 12345678901", None]


def test_files_of_both_kinds_through_ingest(spark, tmp_path):
    (tmp_path / "cells.csv").write_text("Bank\n\nDate,Narration,Debit,Credit,Balance\n01/02/2024,tea,10.00,,90.00\n02/02/2024,pay,,5.00,95.00\n")
    (tmp_path / "text.txt").write_text("My bank\n01-02-2024 tea stall 10.00 DR 90.00\nand more of it\n02-02-2024 pay 5.00 95.00\n03-02-2024 gift 20.00 75.00\n")
    (tmp_path / "none.txt").write_text("nothing here\n01-02-2024 once 5.00 5.00\n")
    found, reports, errors = statements.ingest(spark, str(tmp_path))
    got = sorted((r.source_file, r.seq, r.description, r.debit, r.credit, r.balance, r.reconciled) for r in found.collect())
    assert got == [
        ("cells.csv", 1, "tea", 10.0, 0.0, 90.0, True), ("cells.csv", 2, "pay", 0.0, 5.0, 95.0, True),
        ("text.txt", 1, "tea stall and more of it", 10.0, 0.0, 90.0, True), ("text.txt", 2, "pay", 0.0, 5.0, 95.0, True), ("text.txt", 3, "gift", 20.0, 0.0, 75.0, True),
    ]
    assert {(r.source_file, r.strategy_no, r.reconciliation_rate) for r in reports.collect()} == {("cells.csv", 1, 1.0), ("text.txt", 2, 1.0)}
    assert [r.source_file for r in errors.collect()] == ["none.txt"]


def test_stores_are_written_and_read(spark, tmp_path):
    tags = spark.createDataFrame([("a b", "Travel"), ("c", 'Own "x"')], "merchant_key string, category string")
    stores.write_store(tags, str(tmp_path / "tags"))
    assert sorted(map(tuple, stores.read_overrides(spark, str(tmp_path / "tags")).collect())) == [("a b", "Travel"), ("c", 'Own "x"')]
    stores.write_store(tags.where("false"), str(tmp_path / "none"))
    assert stores.read_overrides(spark, str(tmp_path / "none")).count() == 0
    assert stores.read_overrides(spark, str(tmp_path / "missing")).count() == 0


def test_custom_period_is_swapped_and_kept_inside(spark):
    df = rows(spark, line(1, 1.0, 0.0, 1.0, day=5), line(2, 1.0, 0.0, 1.0, day=20))
    got = lambda *x: tuple(insights.resolve_period(df, custom=x).first())
    day = lambda d: dt.date(2024, 1, d)
    assert got("2024-01-12", "2024-01-07") == (day(7), day(12)) and got("2023-01-01", "2024-01-09") == (day(5), day(9))
