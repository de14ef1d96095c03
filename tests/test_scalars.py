import datetime

import pytest
from pyspark.sql import functions as F

from statementspark.functions import fixed, rules, scalars


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_amount(spark):
    texts = ["1,83,834.55", "(450.00)", "Rs. 12", "₹ 7.5 Cr", "-216.07", "+164.00", "NIL", "-", "", None, "ABC", "inr 3 dr", "(5"]
    assert column(spark, texts, scalars.clean_amount) == [183834.55, -450.0, 12.0, 7.5, -216.07, 164.0, None, None, None, None, None, 3.0, 5.0]


@pytest.mark.parametrize(
    "text, fmt, day",
    [
        ("1/4/2025", "d/M/yyyy", datetime.date(2025, 4, 1)),
        ("01/04/25", "d/M/yyyy", None),
        ("01/04/98", "d/M/yy", datetime.date(1998, 4, 1)),
        ("01/04/2025", "d/M/yy", None),
        ("05-APR-2024", "d-MMM-yyyy", datetime.date(2024, 4, 5)),
        ("2024-02-30", "yyyy-M-d", None),
    ],
)
def test_parse_date(spark, text, fmt, day):
    assert column(spark, [text], lambda c: scalars.parse_date(c, fmt)) == [day]


def test_clock_time_is_cut(spark):
    assert column(spark, ["25 Aug 2026 08:35 PM", "1/1/2024, 10:00:01", "x"], scalars.date_text) == ["25 Aug 2026", "1/1/2024", "x"]


@pytest.mark.parametrize(
    "text, merchant, channel",
    [
        ("UPI/DR/412345678901/BLUE KITE/YESB/bluekite@ybl/Payment", "Blue Kite", "UPI"),
        ("POS 4512XXXXXXXX1234 GREEN LEAF STORES", "Green Leaf Stores", "Card"),
        ("ATW-4512XXXX1234-S1CW-CITY", "ATM Withdrawal", "ATM"),
        ("NEFT-CITIN0012345678-NORTH WIND LIMITED-SALARY", "North Wind", "NEFT"),
        ("UPI/Little Cafe/YESB/660312345678/You are payi", "Little Cafe", "UPI"),
        ("", "Unknown", "Other"),
        (None, "Unknown", "Other"),
        ("NEFT 1234567890123", "Unknown", "NEFT"),
    ],
)
def test_extract_merchant(spark, text, merchant, channel):
    (found,) = column(spark, [text], scalars.extract_merchant)
    assert (found.merchant, found.channel) == (merchant, channel)
    assert found.merchant_key == merchant.lower()


def test_rupees_and_compact(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (123456.0,), (-1234567.891,), (None,), (12345678.0,)], "x double")
    got = [tuple(r) for r in rows.select(scalars.rupees(F.col("x")), scalars.rupees(F.col("x"), 2), scalars.compact(F.col("x"))).collect()]
    assert got[0] == ("₹0", "₹0.50", "₹0")
    assert got[1][0] == "₹2"
    assert got[2] == ("₹1,23,456", "₹1,23,456.00", "₹1.23L")
    assert got[3][1] == "-₹12,34,567.89"
    assert got[4] == ("—", "—", "—")
    assert got[5][2] == "₹1.23Cr"


def test_rules_rank_longest_first_and_refuse_unknown_categories():
    table = rules.rows({"Shopping": "abc abcdef", "Travel": "xyz"})
    assert [r[0] for r in table] == ["abcdef", "abc", "xyz"]
    assert [r[4] for r in table] == ["text", "word", "word"]
    with pytest.raises(ValueError):
        rules.rows({"Nothing": "a"})
    assert fixed.CATEGORIES[-1] == fixed.UNCATEGORISED


LOOSE = {
    "5/6/2024": "2024-06-05", "5/13/2024": "2024-05-13", "13/5/2024": "2024-05-13", "13/13/2024": None, "31/04/2024": None, "2024/5/6": "2024-05-06", "2024/13/6": "2024-06-13", "2024.05.06": "2024-05-06",
    "20240506": "2024-05-06", "06052024": "2024-05-06", "6 May 2024": "2024-05-06", "May 6, 2024": "2024-05-06", "6th of May, 2024": "2024-05-06", "Mon, 6 May 2024": "2024-05-06", "Thursday 2 May 2024": "2024-05-02",
    "6-may-24": "2024-05-06", "6 Sept 69": "1969-09-06", "May 2024 6": "2024-05-06", "2024-May-6": "2024-05-06", "2024 6 May": "2024-05-06", "6 Mayo 2024": None, "May 2024": None, "6/5": None, "1 2 3 4": None, "": None, None: None,
    "2024-05-06T10:11:12Z": "2024-05-06", "5 August 2024 10:30 AM": "2024-08-05", "5 Augu 2024": "2024-08-05", "5 ma 2024": None, "99/99/99": None, "1/1/123": None, "29 Feb 2023": None, "29 Feb 2024": "2024-02-29", "3\xa0May\xa02024": "2024-05-03",
}


def test_loose_dates(spark):
    df = spark.createDataFrame([(k,) for k in LOOSE], "t string").select("t", scalars.loose_date(F.col("t")).cast("string").alias("d"))
    assert {r.t: r.d for r in df.collect()} == LOOSE
