"""Statement ledgers derived from the given tables, as SQL that Spark and an oracle engine read alike.

Money is computed in whole paise and divided last. Narration templates and their parameters are our own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import small_table

#: (kind, narration); {ref} is a 12-digit reference.
TEMPLATES = [
    ("debit", "UPI/DR/{ref}/SWIGGY/YESB/swiggy@ybl/Payment"),
    ("debit", "UPI-BIGBASKET-bigbasket@okaxis-HDFC0000123-{ref}-PAYMENT"),
    ("debit", "UPI/Corner Tea Stall/YESB/{ref}/You are payi"),
    ("credit", "REV-UPI/AMAZON PAY/YESB/{ref}/COMPLAIN"),
    ("debit", "POS 4512XXXXXXXX1234 FLIPKART INTERNET PRIVATE"),
    ("credit", "NEFT-CITIN{ref}-ACME WIDGETS LIMITED-SALARY"),
    ("debit", "IMPS-{ref}-RAVI KUMAR-HDFC-HOUSE RENT"),
    ("debit", "ACH D- LIC PREMIUM-{ref}"),
    ("debit", "NACH/BAJAJ FINANCE/{ref}/EMI"),
    ("debit", "SI-MUTUAL FUND SIP-{ref}-FOLIO 778899"),
    ("debit", "ATW-4512XXXXXXXX1234-S1CW{ref}-PUNE"),
    ("credit", "CREDIT INTEREST CAPITALISED {ref}"),
    ("debit", "AMB CHRG INCL GST {ref}"),
    ("debit", "SMS CHARGES FOR QUARTER {ref}"),
    ("debit", "CC PAYMENT {ref} BILLDESK"),
    ("debit", "FUND TRANSFER TO SELF {ref}"),
    ("credit", "MYNTRA REFUND {ref} ORDER RETURN"),
    ("debit", "UPI/DR/{ref}/SOMEONE UNKNOWN/UTIB/someone.u@oksbi/note"),
    ("debit", "ZZYX HOLDINGS QQ {ref}"),
    ("credit", "BY CLG ODDITY {ref}"),
    ("debit", "CHQ PAID {ref} VENDOR KAPOOR"),
    ("debit", "RTGS-{ref}-PROPERTY DEALERS-MAINTENANCE HOUSING"),
    ("debit", "TPT-NETFLIX COM-{ref}"),
    ("debit", "Decathlon Sports  Pune"),
]


def _narration() -> str:
    cases = []
    for k, (_, text) in enumerate(TEMPLATES):
        parts = text.split("{ref}")
        shown = " || lpad(CAST(o_orderkey AS STRING), 12, '0') || ".join(f"'{p}'" for p in parts)
        cases.append(f"WHEN {k} THEN {shown}")
    return "CASE o_orderkey % 24 " + " ".join(cases) + " END"


_CREDITS = ", ".join(str(k) for k, (kind, _) in enumerate(TEMPLATES) if kind == "credit")
_PAISE = "CAST(round(o_totalprice * 100) AS BIGINT)"
_SIGNED = f"CASE WHEN o_orderkey % 24 IN ({_CREDITS}) THEN {_PAISE} ELSE -{_PAISE} END"

LEDGER = f"""
SELECT o_custkey AS account_id, 'acct_' || CAST(o_custkey AS STRING) AS source_file,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq,
       CAST(o_orderdate AS DATE) AS date, o_orderkey, {_narration()} AS description,
       CASE WHEN o_orderkey % 24 IN ({_CREDITS}) THEN 0E0 ELSE {_PAISE} / 100E0 END AS debit,
       CASE WHEN o_orderkey % 24 IN ({_CREDITS}) THEN {_PAISE} / 100E0 ELSE 0E0 END AS credit,
       CAST(10000000 + sum({_SIGNED}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 100E0 AS balance
FROM {{orders}}"""

BROKEN = """
SELECT account_id, source_file, seq, date, o_orderkey, description, debit, credit,
       CASE WHEN account_id % 13 = 0 OR o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN balance + 1E0 ELSE balance END AS balance,
       o_orderkey % 5 = 0 AS ambiguous
FROM {ledger}"""

#: Letters of a number: names that no rule, channel or store knows.
_LETTERS = "translate(CAST({} AS STRING), '0123456789', 'BCDFGHJKLM')"
_VENDOR = _LETTERS.format("account_id % 997")
#: The ledger with some hundreds of payees that nothing resolves, whose amounts often tie.
STRANGERS = f"""
SELECT account_id, source_file, seq, date, o_orderkey,
       CASE WHEN o_orderkey % 24 IN (17, 18, 20) THEN 'CHQ PAID ' || lpad(CAST(o_orderkey AS STRING), 12, '0') || ' VENDOR QX' || {_VENDOR} ELSE description END AS description,
       CASE WHEN o_orderkey % 24 IN (17, 18, 20) THEN 100E0 + floor(debit / 20000) * 20000 ELSE debit END AS debit, credit, balance
FROM {{ledger}}"""
#: Answers of a classifier on them: valid ones, categories that do not exist or say nothing, keys that nobody asked for, and for many
#: keys two or three answers in no order, some with the key written otherwise; ``seq`` numbers answers.
_ANSWER = f"""
SELECT {{key}} AS merchant_key, CASE ({{k}}) % 4 WHEN 0 THEN 'Groceries' WHEN 1 THEN 'Travel' WHEN 2 THEN 'Imaginary' ELSE 'Uncategorised' END AS category,
       CASE WHEN account_id % 2 = 0 THEN '' ELSE 'Vendor' END AS display, CAST(CASE WHEN account_id % 5 = 0 THEN NULL ELSE 0.81234 END AS DOUBLE) AS confidence,
       CASE account_id % 3 WHEN 0 THEN 'Claude-y' WHEN 1 THEN 'o3-mini' ELSE '' END AS model, CAST({{seq}} AS BIGINT) AS seq
FROM (SELECT DISTINCT account_id FROM {{{{ledger}}}} WHERE account_id < 997) AS a WHERE {{where}}"""
_KEY = f"'vendor qx' || lower({_VENDOR})"
ANSWERS = " UNION ALL ".join(
    _ANSWER.format(key=key, k=k, seq=seq, where=where)
    for key, k, seq, where in (
        (_KEY, "account_id", "account_id", "true"), (_KEY, "account_id + 1", "5000 - account_id", "account_id % 3 = 0"), (_KEY, "account_id / 2", "account_id + 7000", "account_id % 5 = 0"),
        (f"'Vendor  QX' || {_VENDOR}", "account_id + 1", "account_id + 9000", "account_id % 7 = 0"), (f"'nobody asked ' || lower({_LETTERS.format('account_id')})", "1", "account_id", "true"),
    )
)
ANSWERS = ANSWERS.replace("account_id / 2", "CAST(floor(account_id / 2) AS BIGINT)")
#: The same of every account, so most keys have answers of many accounts; ``seq`` and ``account_id`` number those of a key.
EVERY_ANSWER = ANSWERS.replace(" WHERE account_id < 997", "").replace("AS BIGINT) AS seq", "AS BIGINT) AS seq, account_id")
#: Stores of accounts: own tags, some with names that look like something else, learned answers with a model each, own categories.
OWN_TAGS = f"""
SELECT account_id, 'payee ' || lower({_LETTERS.format('o_orderkey % 6')}) AS merchant_key,
 max(CASE o_orderkey % 9 WHEN 0 THEN 'Travel' WHEN 1 THEN '2nd home' WHEN 2 THEN 'true' WHEN 3 THEN '[boats]' WHEN 4 THEN chr(123) || 'pets' || chr(125) WHEN 5 THEN 'null' WHEN 6 THEN '-7' ELSE 'Own "' || CAST(account_id % 7 AS STRING) || '"' END) AS category
FROM {{ledger}} GROUP BY 1, 2"""
#: Store documents as lines: strings beside numbers, lists, objects and nulls, and lines that are no JSON. ``<`` and ``>`` stand for braces.
_TAG_NAME = f"'a ' || {_LETTERS.format('account_id')}"
TAG_DOCUMENTS = f"""
SELECT replace(replace(CASE WHEN account_id % 11 = 0 THEN 'broken ' ELSE '' END || '<"account_id": ' || CAST(account_id AS STRING) || ', "entries": <"' || {_TAG_NAME} || '": "2nd home", "b": ' || CAST(n AS STRING)
 || ', "c": ["x"], "d": <"e": "f">, "g": "true", "h": true, "i": null, "j": "[k]", "l": "' || CASE account_id % 3 WHEN 0 THEN '<m>' WHEN 1 THEN '7' ELSE 'Own' END || '", "n": -1.5>>', '<', chr(123)), '>', chr(125)) AS value
FROM (SELECT account_id, count(*) AS n FROM {{ledger}} GROUP BY 1) AS x"""
LEARNED = f"""SELECT account_id, 'payee ' || lower({_LETTERS.format('account_id')}) AS merchant_key, 'Shopping' AS category, 'Payee ' || CAST(account_id AS STRING) AS display, CAST(0.75 AS DOUBLE) AS confidence,
 CASE account_id % 8 WHEN 0 THEN 'claude-y' WHEN 1 THEN 'GPT-x' WHEN 2 THEN 'chatgpt' WHEN 3 THEN 'o1' WHEN 4 THEN 'O3-mini' WHEN 5 THEN 'llama-z' WHEN 6 THEN 'my claude' ELSE '' END AS model
 FROM (SELECT DISTINCT account_id FROM {{ledger}}) AS a"""
OWN_CATEGORIES = "SELECT DISTINCT account_id, 'Own ' || CAST(seq % 17 AS STRING) AS name FROM {ledger}"
#: Edits of tags: every transaction tags a payee, some delete, few empty the whole store; the later half is a second version.
EDITS = f"""
SELECT account_id, 'payee ' || lower({_LETTERS.format('o_orderkey % 4')}) AS merchant_key, CASE WHEN o_orderkey % 13 = 0 THEN 'clear' WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'set' END AS op, seq,
 'Own ' || CAST(o_orderkey % 7 AS STRING) AS category, CASE WHEN seq <= 5 THEN 1 ELSE 2 END AS v FROM {{ledger}}"""
#: A rule file's content made of the words of all narrations: some short, some long, some with a sign of regular expressions.
WORDS = """SELECT DISTINCT word FROM (SELECT explode(split(lower(description), '[^A-Za-z.]+')) AS word FROM {ledger}) AS w WHERE length(word) > 2"""
DUCK_WORDS = WORDS.replace("explode(split(", "unnest(string_split_regex(")

GAP = "CASE c_custkey % 8 WHEN 0 THEN 7 WHEN 1 THEN 14 WHEN 2 THEN 30 WHEN 3 THEN 91 WHEN 4 THEN 182 WHEN 5 THEN 365 WHEN 6 THEN 45 ELSE 30 END"
JITTER = "CASE WHEN c_custkey % 8 = 7 THEN 20 * (k % 2) ELSE (7 * c_custkey + 3 * k + k * k) % 3 - 1 END"
#: {days} turns a date and a number of days into a date in either dialect.
RECURRING = f"""
SELECT c_custkey AS account_id, 'plan_' || CAST(c_custkey AS STRING) AS merchant_key, 'Plan ' || CAST(c_custkey AS STRING) AS merchant,
       {{day}} AS date, k AS seq,
       ((10000 + 137 * c_custkey) * (100 + (CASE WHEN c_custkey % 11 = 0 THEN 30 ELSE 2 END) * (k % 3))) / 10000E0 AS debit, 0E0 AS credit,
       CASE WHEN c_custkey % 9 = 0 THEN 'Investments & SIP' WHEN c_custkey % 10 = 3 THEN 'Cash Withdrawal' ELSE 'Insurance' END AS category
FROM (SELECT c_custkey, k FROM {{customer}} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(k)) AS x WHERE k < 2 + c_custkey % 5"""
_DAYS = f"CAST(c_custkey % 28 + k * ({GAP}) + ({JITTER}) AS INT)"
SPARK_DAY, DUCK_DAY = f"date_add(DATE '2020-01-01', {_DAYS})", f"DATE '2020-01-01' + {_DAYS}"

OVERLAP = """
SELECT account_id, 'early_' || CAST(account_id AS STRING) AS source_file, seq, date, description, debit, credit, balance FROM {ledger} WHERE date <= DATE '1998-12-31'
UNION ALL
SELECT account_id, 'late_' || CAST(account_id AS STRING) AS source_file, seq, date, description, debit, credit, balance FROM {ledger} WHERE date >= DATE '1998-10-01'"""

OVERRIDES = [("corner tea stall", "Food & Dining"), ("zzyx holdings qq", "Club Fees")]
CACHE = [("someone unknown", "Groceries", "Someone", 0.65, "gpt-x"), ("decathlon sports pune", "Shopping", "Decathlon", 0.9, "claude-y"), ("vendor kapoor", "Nonsense", "Kapoor", 0.9, "")]
LABELS = [("vendor kapoor", "Groceries", "Kapoor", 0.81234, "claude-y"), ("nobody asked", "Travel", "", 0.8, ""), ("oddity", "Imaginary", "", 0.9, "")]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LEDGER, orders=orders(spark, sf_dir))


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BROKEN, ledger=ledger(spark, sf_dir))


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OVERLAP, ledger=ledger(spark, sf_dir))


def recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return spark.sql(RECURRING.replace("{day}", SPARK_DAY), customer=customer)


def strangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STRANGERS, ledger=ledger(spark, sf_dir))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ANSWERS, ledger=ledger(spark, sf_dir))


def of_ledger(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, ledger=ledger(spark, sf_dir))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share, for what a query writes and reads back."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back, as files that somebody else wrote: what follows plans from them alone."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def overrides(spark: SparkSession) -> DataFrame:
    return small_table(spark, OVERRIDES, "merchant_key string, category string")


def cache(spark: SparkSession) -> DataFrame:
    return small_table(spark, CACHE, "merchant_key string, category string, display string, confidence double, model string")


def labels(spark: SparkSession) -> DataFrame:
    return small_table(spark, LABELS, "merchant_key string, category string, display string, confidence double, model string")

_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', (month(date) - 1) * 3 + 1, 3)"
_DD, _MM, _YYYY = "lpad(CAST(day(date) AS STRING), 2, '0')", "lpad(CAST(month(date) AS STRING), 2, '0')", "CAST(year(date) AS STRING)"


def _money(expr: str) -> str:
    """SQL: a number of rupees as text with Indian grouping."""
    paise = f"CAST(round(abs({expr}) * 100) AS BIGINT)"
    part = lambda below, size: f"CAST(CAST(floor({paise} / {below}E0) AS BIGINT) % {size} AS STRING)"
    two = lambda below: f"lpad({part(below, 100)}, 2, '0')"
    last = f"lpad({part(100, 1000)}, 3, '0')"
    grouped = f"""CASE WHEN {paise} >= 1000000000 THEN {part(1000000000, 1000)} || ',' || {two(10000000)} || ',' || {two(100000)} || ',' || {last}
      WHEN {paise} >= 10000000 THEN {part(10000000, 100)} || ',' || {two(100000)} || ',' || {last} WHEN {paise} >= 100000 THEN {part(100000, 100)} || ',' || {last} ELSE {part(100, 1000)} END"""
    return f"(CASE WHEN {expr} < 0 THEN '-' ELSE '' END || {grouped} || '.' || lpad(CAST({paise} % 100 AS STRING), 2, '0'))"


_SEP = "CASE account_id % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE '|' END"
_DATE = f"CASE account_id % 3 WHEN 0 THEN {_DD} || '/' || {_MM} || '/' || {_YYYY} WHEN 1 THEN {_DD} || '-' || {_MON} || '-' || {_YYYY} ELSE {_DD} || ' ' || {_MON} || ' ' || {_YYYY} || ' 09:05 AM' END"
_HEAD = """CASE account_id % 3 WHEN 0 THEN 'Date' || s || 'Narration' || s || 'Chq./Ref.No.' || s || 'Value Dt' || s || 'Withdrawal Amt.' || s || 'Deposit Amt.' || s || 'Closing Balance'
 WHEN 1 THEN 'Sr No' || s || 'Value Date' || s || 'Transaction Remarks' || s || 'Amount' || s || 'Dr / Cr' || s || 'Balance'
 ELSE '#' || s || 'Transaction Date' || s || 'Value Date' || s || 'Transaction Details' || s || 'Chq / Ref No.' || s || 'DEBIT/CREDIT(INR)' || s || 'BALANCE(INR)' END"""
_QUOTED = lambda e: f"'\"' || {_money(e)} || '\"'"
_BODY = f"""CASE account_id % 3 WHEN 0 THEN d || s || description || s || '' || s || d || s || {_QUOTED('debit')} || s || {_QUOTED('credit')} || s || {_QUOTED('balance')}
 WHEN 1 THEN CAST(seq AS STRING) || s || d || s || description || s || {_QUOTED('(debit + credit)')} || s || CASE WHEN debit > 0 THEN 'DR' ELSE 'CR' END || s || {_QUOTED('balance')}
 ELSE CAST(seq AS STRING) || s || d || s || d || s || description || s || 'r1' || s || {_QUOTED('(credit - debit)')} || s || {_QUOTED('balance')} END"""

#: Delimited statements with three lines of preamble, a header, the body, a blank line and a footer.
LINES = f"""
WITH rows AS (SELECT *, count(*) OVER (PARTITION BY account_id) AS n, {_SEP} AS s, {_DATE} AS d FROM {{ledger}}),
files AS (SELECT DISTINCT account_id, source_file, n, s FROM rows)
SELECT source_file, CAST(0 AS INT) AS line_no, 'MY BANK LIMITED' AS line FROM files
UNION ALL SELECT source_file, CAST(1 AS INT), 'Statement of account' || s || 'for' || s || CAST(account_id AS STRING) FROM files
UNION ALL SELECT source_file, CAST(2 AS INT), '' FROM files
UNION ALL SELECT source_file, CAST(3 AS INT), {_HEAD} FROM files
UNION ALL SELECT source_file, CAST(3 + CASE WHEN account_id % 5 = 0 AND n >= 3 THEN n + 1 - seq ELSE seq END AS INT), {_BODY} FROM rows
UNION ALL SELECT source_file, CAST(4 + n AS INT), '' FROM files
UNION ALL SELECT source_file, CAST(5 + n AS INT), 'This is a computer generated statement' FROM files"""

#: Statements as printed text, every balance fifty million higher so that none is below zero; long narrations wrap, boilerplate stands between, some amounts have a suffix.
TEXT_LINES = f"""
WITH rows AS (SELECT *, {_DD} || '-' || {_MM} || '-' || {_YYYY} AS d FROM {{ledger}})
SELECT source_file, CAST(seq * 3 AS INT) AS line_no,
  d || ' ' || substr(description, 1, 40) || ' ' || {_money('(debit + credit)')} || CASE WHEN seq = 1 OR o_orderkey % 7 = 0 THEN CASE WHEN debit > 0 THEN ' DR' ELSE ' CR' END ELSE '' END || ' ' || {_money('(balance + 5E7)')} AS line
FROM rows
UNION ALL SELECT source_file, CAST(seq * 3 + 1 AS INT), substr(description, 41) FROM rows WHERE length(description) > 44
UNION ALL SELECT source_file, CAST(seq * 3 + 2 AS INT), 'Page 1 of account number 0001' FROM rows WHERE o_orderkey % 30 = 0"""


#: Statements whose narrations hold line breaks, quotes and delimiters, all in quotes; ``part`` numbers what a line is broken into.
_CUT = "substr(description, 1, 12) || chr(10) || substr(description, 13)"
QUOTED = f"""
SELECT source_file, CAST(0 AS BIGINT) AS n, 'Date;Narration;Withdrawal Amt.;Deposit Amt.;Closing Balance' AS record FROM {{ledger}} GROUP BY source_file
UNION ALL SELECT source_file, seq, {_DD} || '/' || {_MM} || '/' || {_YYYY} || ';"' || CASE seq % 3 WHEN 0 THEN {_CUT} || chr(10) || chr(10) || '""x; y""' WHEN 1 THEN {_CUT} ELSE description END || '";' || {_money('debit')} || ';' || {_money('credit')} || ';"' || {_money('balance')} || '"' FROM {{ledger}}"""
TORN = "SELECT source_file, CAST(1000000 AS BIGINT) AS n, 'x;y;\"torn' AS record FROM {ledger} WHERE account_id % 17 = 0 GROUP BY source_file"


def quoted_lines(spark: SparkSession, sf_dir: str, torn: bool = False) -> DataFrame:
    """The lines of such statements; with ``torn`` some end inside a quote."""
    records = of_ledger(spark, sf_dir, QUOTED)
    if torn:
        records = records.unionByName(of_ledger(spark, sf_dir, TORN))
    parts = records.select("source_file", "n", F.posexplode(F.split("record", "\n")).alias("part", "line"))
    return stored(parts.select("source_file", (F.col("n") * 8 + F.col("part")).cast("int").alias("line_no"), "line"), "quoted-lines")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark.sql(LINES, ledger=ledger(spark, sf_dir)), "lines")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark.sql(TEXT_LINES, ledger=ledger(spark, sf_dir)), "text-lines")


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all accounts, every second one printed as text."""
    even = F.substring("source_file", 6, 20).cast("long") % 2 == 0  # files are named by account
    return text_lines(spark, sf_dir).where(even).unionByName(lines(spark, sf_dir).where(~even))
