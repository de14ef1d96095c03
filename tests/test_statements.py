"""Records with line breaks in quotes, and rollups in one pass, against plain Python."""

import collections
import csv
import datetime as dt
import io
import random
import statistics

import pytest
from pyspark.sql import functions as F

from statementspark.operators import insights, proof
from statementspark.sources import statements

LINE = "source_file string, line_no int, line string"


def records(text):
    """(first line, whole text) of each record as the csv module reads them, and whether the text ends inside a quote."""
    lines = text.split("\n")
    out, done = [], 0
    while done < len(lines):
        for end in range(done + 1, len(lines) + 1):
            part = "\n".join(lines[done:end])
            reader = csv.reader(io.StringIO(part + "\n;end", newline=""), delimiter=";")
            rows = list(reader)
            if rows[-1][-1] == "end" and len(rows) > 1:
                out.append((done, part))
                done = end
                break
        else:
            return out, True
    return out, False


def test_records_of_random_texts_against_the_csv_module(spark):
    rng = random.Random(2)
    texts = {f"f{k}": "".join(rng.choices(["a", '"', '""', ";", "\n", ' "', '";"', '";\n"', '"\n'], k=rng.randint(0, 14))) for k in range(1500)}
    lines = [(f, n, line) for f, text in texts.items() for n, line in enumerate(text.split("\n"))]
    rng.shuffle(lines)
    got = collections.defaultdict(list)
    for r in statements.assemble_records(spark.createDataFrame(lines, LINE)).collect():
        got[r.source_file].append((r.line_no, r.line, r.torn))
    torn_files = 0
    for f, text in texts.items():
        want, torn = records(text)
        torn_files += torn
        if torn:
            want = list(enumerate(text.split("\n")))
        assert sorted(got[f]) == [(n, line, torn) for n, line in want], repr(text)
    assert 100 < torn_files < 1400


def test_quoted_cells_with_line_breaks_to_transactions(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Bank\n"Two\nlines of preamble"\nDate,Narration,Debit,Credit,Balance\n01/02/2024,"SHOP ""A""\n\nRoad, 5",10.00,,90.00\n02/02/2024,B,,5.00,95.00\n"Total\nof all",,10.00,5.00,\n')
    (tmp_path / "b.csv").write_text('Date,Narration,Debit,Credit,Balance\n01/02/2024,A,10.00,,90.00\n02/02/2024,B,,5.00,95.00\n03/02/2024,"C,,1.00,96.00\n')
    lines = statements.read_statement_lines(spark, str(tmp_path))
    rows, errors = statements.ingest_lines(lines)
    got = sorted((r.source_file, r.seq, r.description, r.debit, r.credit, r.balance) for r in rows.collect())
    assert got[:2] == [("a.csv", 1, 'SHOP "A" Road, 5', 10.0, 0.0, 90.0), ("a.csv", 2, "B", 0.0, 5.0, 95.0)]
    assert [g[:3] for g in got[2:4]] == [("b.csv", 1, "A"), ("b.csv", 2, "B")]
    assert [(r.kind, r.source_file) for r in errors.collect()] == [("quotes", "b.csv")]


def test_one_pass_reads_lines_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Narration,Debit,Credit,Balance\n01/02/2024,A,10.00,,90.00\n02/02/2024,B,,5.00,95.00\n")
    lines = statements.read_statement_lines(spark, str(tmp_path))
    for frame, scans in ((statements.ingest_lines(lines)[0], 1), (statements.ingest_best(lines)[0], 2), (statements.ingest_best(lines)[1], 2)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("binaryFile") <= scans
        assert frame.count() > 0


SPENT = "k int, date date, category string, debit double, credit double"


def spent(rng, n):
    start = dt.date(2023, 12, 20)
    return [(rng.randint(0, 3), start + dt.timedelta(rng.randint(0, 90)), rng.choice(["Travel", "Shopping", "Transfers", "Groceries", "Other", "Rent & Housing"]), rng.choice([0.0, 1.25, 10.5, 99.99]), 0.0) for _ in range(n)]


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_daily_and_by_month_against_plain_python(spark, keys):
    rng = random.Random(4)
    rows = spent(rng, 160) + [(7, dt.date(2024, 2, 28), "Travel", 5.0, 0.0), (8, None, "Travel", 5.0, 0.0)]
    df = spark.createDataFrame(rows, SPENT)
    of = collections.defaultdict(list)
    for k, day, category, debit, _ in rows:
        if debit > 0 and category != "Transfers":
            of[(k,) if keys else ()].append((day, category, debit))
    days, cells = [], []
    for key, mine in of.items():
        sums = collections.Counter()
        for day, _, debit in mine:
            if day:
                sums[day] += debit
        if sums:
            first, last = min(sums), max(sums)
            for n in range((last - first).days + 1):
                day = first + dt.timedelta(n)
                seven = [sums[day - dt.timedelta(j)] for j in range(min(7, n + 1))]
                days.append((*key, day, round(sums[day], 2), round(sum(seven) / len(seven), 4)))
        whole, months = collections.Counter(), collections.Counter()
        for _, category, debit in mine:
            whole[category] += debit
        top = sorted(whole, key=lambda c: (-round(whole[c], 2), c))[:2]
        for day, category, debit in mine:
            months[day and day.replace(day=1), category if category in top else "Other"] += debit
        cells += [(*key, m, b, round(months[m, b], 2)) for m in {m for m, _ in months} for b in {b for _, b in months}]
    assert sorted(map(tuple, insights.daily(df, keys=keys).collect()), key=repr) == sorted(days, key=repr)
    assert sorted(map(tuple, insights.by_month(df, top_n=2, keys=keys).collect()), key=repr) == sorted(cells, key=repr)
    for made in (insights.daily(df, keys=keys), insights.by_month(df, keys=keys)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
        assert made.where("false").count() == 0
    assert insights.daily(df.where("false"), keys=keys).count() == insights.by_month(df.where("false"), keys=keys).count() == 0


PAID = "merchant_key string, merchant string, date date, debit double, credit double, category string"


def test_medians_from_counts_are_those_of_the_rows(spark):
    rng = random.Random(6)
    start = dt.date(2023, 1, 1)
    rows = []
    for m in range(40):
        step, amount = rng.choice([7, 14, 30, 91, 45]), rng.choice([5.0, 99.9, 1e6])
        for k in range(rng.randint(1, 12)):
            rows.append((f"m{m}", "M" if m % 7 else None, start + dt.timedelta(k * step + rng.randint(-1, 1)), round(amount * rng.choice([1, 1, 1.05, 0.95]), 2), 0.0, rng.choice(["Travel", "Insurance"])))
    rows += [("hot", "H", start + dt.timedelta(30 * (k % 12)), 10.0 + k % 3, 0.0, "Travel") for k in range(3000)] + [("none", "N", None, 3.0, 0.0, "Travel")] * 3
    df = spark.createDataFrame(rows, PAID)
    plain, counted = (insights.detect_recurring(df, by_counts=x) for x in (False, True))
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, counted.collect()), key=repr) and plain.count() > 5
    assert insights.detect_recurring(df.where("false"), by_counts=True).count() == 0
    values = {g: [rng.choice([0.0, 0.5, 3.0, 1e9, rng.random()]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 1000))}
    counts = spark.createDataFrame([(g, v, n) for g, vs in values.items() for v, n in collections.Counter(vs).items()], "g string, v double, n long")
    assert {r.g: r["median"] for r in insights.exact_median(counts, ["g"], "v").collect()} == {g: statistics.median(vs) for g, vs in values.items()}


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_segments_of_a_ledger_are_the_whole(spark, segment):
    rng = random.Random(segment)
    rows, files = [], [("a", 40), ("b", 1), ("c", 3), ("d", 0), ("e", 200)]
    for f, n in files:
        balance, day = 100.0, dt.date(2024, 1, 1)
        for seq in range(1, n + 1):
            debit = rng.choice([0.0, 5.0, 7.5])
            credit = 0.0 if debit else 4.0
            balance += credit - debit + rng.choice([0, 0, 0, 1])
            day += dt.timedelta(rng.choice([0, 1, -1, -1]))
            rows.append((f, seq, day, "x", debit, credit, None if rng.random() < 0.2 else balance, rng.random() < 0.5))
    df = spark.createDataFrame(rows, "source_file string, seq long, date date, description string, debit double, credit double, balance double, ambiguous boolean").repartition(5)
    whole = lambda d: sorted(map(tuple, d.select(sorted(d.columns)).collect()), key=repr)
    for f in (proof.reconcile, proof.direction_from_balance):
        assert whole(f(df, segment=segment)) == whole(f(df))
    lines = df.withColumnRenamed("seq", "line_no")
    assert whole(proof.ensure_chronological(lines, segment=segment)) == whole(proof.ensure_chronological(lines))
