"""Every query by name, and the SQL that says the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, rules, scalars
from ..operators import categorize as C
from ..operators import insights as I
from ..operators import merchant, proof, review
from ..sources import statements, stores
from . import ledger as L
from . import oracle as O
from .oracle import ALL, ANNOTATED, BASE, INCOME, LEDGER, SPEND, hit, q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
ACCOUNT = ("account_id",)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merchant.annotate(L.ledger(spark, sf_dir))


def categorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.categorize(L.ledger(spark, sf_dir), L.overrides(spark), L.cache(spark), rules.load_rules(spark))


# Scalars, each on narrations or amounts of the whole ledger.


@query(f"{BASE} SELECT o_orderkey, {O.channel('description')} AS channel FROM ledger")
def detect_channel(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("o_orderkey", scalars.detect_channel(F.col("description")).alias("channel"))


@query(f"{BASE} SELECT o_orderkey, nullif(lower(regexp_extract(description, {q(fixed.VPA)}, 0)), '') AS vpa FROM ledger")
def extract_vpa(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("o_orderkey", scalars.extract_vpa(F.col("description")).alias("vpa"))


@query(f"{BASE} SELECT o_orderkey, {O.canonical('description')} AS canonical FROM ledger")
def canonical_merchant(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("o_orderkey", scalars.canonical_merchant(F.col("description")).alias("canonical"))


@query(f"{BASE} SELECT o_orderkey, {O.key('description')} AS made_key FROM ledger")
def make_key(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("o_orderkey", scalars.make_key(F.col("description")).alias("made_key"))


@query(f"{BASE}, t AS (SELECT o_orderkey, unnest(string_split_regex(upper(trim(description)), '[\\s/-]+')) AS token FROM ledger) SELECT o_orderkey, token, {O.noise('token')} AS noise FROM t")
def is_noise_token(spark, sf_dir):
    rows = L.ledger(spark, sf_dir).select("o_orderkey", F.explode(F.split(F.upper(F.trim("description")), r"[\s/-]+")).alias("token"))
    return rows.select("o_orderkey", "token", scalars.is_noise_token(F.col("token")).alias("noise"))


@query(f"{BASE} SELECT o_orderkey, {O.phrase('upper(description)')} AS phrase FROM ledger")
def clean_phrase(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("o_orderkey", scalars.clean_phrase(F.upper("description")).alias("phrase"))


@query(f"{BASE} SELECT o_orderkey, {O.display('description')} AS display FROM ledger")
def display_name(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("o_orderkey", scalars.display_name(F.col("description")).alias("display"))


_SHAPES = "CASE seq % 5 WHEN 0 THEN {m} WHEN 1 THEN '(' || {m} || ')' WHEN 2 THEN 'Rs. ' || {m} || ' Cr' WHEN 3 THEN '-' || {m} ELSE 'NIL' END".format(m=L._money("(debit + credit)"))


@query(
    f"{BASE}, t AS (SELECT o_orderkey, {_SHAPES} AS raw FROM ledger), n AS (SELECT *, replace(regexp_extract(trim(raw), {q(fixed.AMOUNT)}, 1), ',', '') AS x FROM t)"
    " SELECT o_orderkey, CASE WHEN raw LIKE '(%)' THEN -abs(try_cast(nullif(x, '') AS DOUBLE)) ELSE try_cast(nullif(x, '') AS DOUBLE) END AS amount FROM n"
)
def clean_amount(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("o_orderkey", scalars.clean_amount(F.expr(_SHAPES)).alias("amount"))


_FILE_DATE = L._DATE


@query(f"{BASE} SELECT o_orderkey, date FROM ledger")
def parse_dates(spark, sf_dir):
    rows = L.ledger(spark, sf_dir).select("o_orderkey", "source_file", F.expr(_FILE_DATE).alias("date_text"))
    return statements.parse_dates(rows).select("o_orderkey", "date")


@query(f"{BASE} SELECT o_orderkey, description AS body FROM ledger")
def strip_value_date(spark, sf_dir):
    rows = L.ledger(spark, sf_dir)
    shown = F.concat("description", F.lit(" "), F.date_format("date", "dd/MM/yyyy"))
    return rows.select("o_orderkey", scalars.strip_value_date(shown, F.col("date")).alias("body"))


@query(f"{BASE} SELECT o_orderkey, {hit('lower(description)', fixed.BOILERPLATE)} AS boilerplate FROM ledger")
def is_boilerplate(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("o_orderkey", scalars.is_boilerplate(F.col("description")).alias("boilerplate"))


_W = "CAST(CAST(round_even(abs(balance), 0) AS BIGINT) AS VARCHAR)"


@query(
    f"{BASE}, w AS (SELECT *, {_W} AS w FROM ledger), h AS (SELECT *, CASE WHEN length(w) > 3 THEN w[1:length(w) - 3] ELSE '' END AS h FROM w)"
    " SELECT o_orderkey, CASE WHEN balance < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN h = '' THEN w ELSE"
    " (CASE WHEN length(h) > 4 THEN h[1:length(h) - 4] || ',' ELSE '' END) || (CASE WHEN length(h) > 2 THEN h[greatest(1, length(h) - 3):length(h) - 2] || ',' ELSE '' END) || h[greatest(1, length(h) - 1):] || ',' || w[length(w) - 2:] END AS shown FROM h"
)
def rupees(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("o_orderkey", scalars.rupees(F.col("balance")).alias("shown"))


@query(
    f"{BASE}, m AS (SELECT o_orderkey, balance, abs(balance) AS m FROM ledger) SELECT o_orderkey, CASE WHEN balance < 0 THEN '-' ELSE '' END || '₹' ||"
    " CASE WHEN m >= 1e7 THEN printf('%.2f', round_even(m / 1e7, 2)) || 'Cr' WHEN m >= 1e5 THEN printf('%.2f', round_even(m / 1e5, 2)) || 'L' WHEN m >= 1e3 THEN printf('%.1f', round_even(m / 1e3, 1)) || 'k' ELSE printf('%.0f', round_even(m, 0)) END AS shown FROM m"
)
def compact(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("o_orderkey", scalars.compact(F.col("balance")).alias("shown"))


# Merchants and categories.


@query(f"{BASE}, {ANNOTATED} SELECT o_orderkey, merchant, merchant_key, channel, vpa FROM annotated")
def annotate(spark, sf_dir):
    return annotated(spark, sf_dir).select("o_orderkey", "merchant", "merchant_key", "channel", "vpa")


@query(f"{ALL} SELECT merchant_key, description, rule_category AS category, specificity FROM matched")
def match_rules(spark, sf_dir):
    return C.match_rules(annotated(spark, sf_dir), rules.load_rules(spark))


@query(f"{ALL} SELECT o_orderkey, merchant_key, category, category_source, confidence FROM categorized")
def categorize(spark, sf_dir):
    return categorized(spark, sf_dir).select("o_orderkey", "merchant_key", "category", "category_source", "confidence")


# Payees that nothing resolves, some hundreds of them.

_STRANGE = ALL.replace(BASE, f"WITH base AS ({LEDGER}), ledger AS ({L.STRANGERS.replace('{ledger}', 'base')}), answers AS ({L.ANSWERS.replace('{ledger}', 'base')})", 1)
_PENDING = f"{_STRANGE}, pending AS (SELECT merchant_key, merchant, description AS narration, channel, CASE WHEN credit > 0 THEN 'credit' ELSE 'debit' END AS direction, debit + credit AS amount FROM (SELECT *, row_number() OVER (PARTITION BY merchant_key ORDER BY debit + credit DESC, date, source_file, seq) AS n FROM categorized WHERE category = 'Uncategorised') WHERE n = 1)"


def strange(spark, sf_dir):
    return C.categorize(L.strangers(spark, sf_dir), L.overrides(spark), L.cache(spark), rules.load_rules(spark))


@query(f"{_PENDING} SELECT * FROM pending")
def pending_merchants(spark, sf_dir):
    return C.pending_merchants(strange(spark, sf_dir))


_BATCHES = "SELECT CAST(floor((row_number() OVER (ORDER BY amount DESC, merchant_key) - 1) / 40) AS BIGINT) AS batch, merchant_key, merchant, narration, channel, direction FROM pending ORDER BY amount DESC, merchant_key LIMIT 400"


@query(f"{_PENDING} {_BATCHES}")
def batch_merchants(spark, sf_dir):
    return C.batch_merchants(C.pending_merchants(strange(spark, sf_dir)))


def _by_length(batch):
    """A stand-in for a classifier: a batch in, its answers out; one batch it cannot do."""
    if (batch["batch"] == 3).any():
        raise RuntimeError("no answer")
    even = batch["merchant_key"].str.len() % 2 == 0
    return batch.assign(category=even.map({True: "Travel", False: "Groceries"}), display=batch["merchant"].str.upper(), confidence=0.75, model="by-length")[["merchant_key", "category", "display", "confidence", "model"]]


@query(f"{_PENDING}, b AS ({_BATCHES}) SELECT batch, merchant_key, CASE WHEN length(merchant_key) % 2 = 0 THEN 'Travel' ELSE 'Groceries' END AS category, upper(merchant) AS display, CAST(0.75 AS DOUBLE) AS confidence, 'by-length' AS model FROM b WHERE batch < 3")
def classify(spark, sf_dir):
    """The fourth batch fails: the answers of the three before it stay."""
    return C.classify(C.batch_merchants(C.pending_merchants(strange(spark, sf_dir))), _by_length).drop("seq")


_NAMED = f"category IN {O._in(fixed.CATEGORIES[:-1])}"
_VALID = f"{_PENDING}, valid AS (SELECT * FROM answers WHERE {_NAMED} AND merchant_key IN (SELECT merchant_key FROM pending) QUALIFY row_number() OVER (PARTITION BY merchant_key ORDER BY seq DESC) = 1)"


def _valid(spark, sf_dir):
    return C.validate_labels(L.answers(spark, sf_dir), C.pending_merchants(strange(spark, sf_dir)))


@query(f"{_VALID} SELECT merchant_key, category, display, confidence, model FROM valid")
def validate_labels(spark, sf_dir):
    return _valid(spark, sf_dir).drop("seq")


_LABELLED = "CASE WHEN c.category = 'Uncategorised' AND v.category IS NOT NULL THEN {} ELSE {} END"


@query(f"{_VALID} SELECT o_orderkey, {_LABELLED.format('v.category', 'c.category')} AS category, {_LABELLED.format(q('llm'), 'c.category_source')} AS category_source, {_LABELLED.format('coalesce(v.confidence, 0.8)', 'c.confidence')} AS confidence FROM categorized c LEFT JOIN valid v ON c.merchant_key = v.merchant_key")
def apply_labels(spark, sf_dir):
    """Answers that were asked for, several of them to many keys, on the transactions of the ledger: as many rows as before."""
    asked = C.pending_merchants(strange(spark, sf_dir))
    labels = L.answers(spark, sf_dir).where(F.col("category").isin(fixed.CATEGORIES[:-1])).join(asked.select("merchant_key"), "merchant_key", "left_semi")
    return C.apply_labels(strange(spark, sf_dir), labels).select("o_orderkey", "category", "category_source", "confidence")


_EVERY = _PENDING.replace(L.ANSWERS.replace("{ledger}", "base"), L.EVERY_ANSWER.replace("{ledger}", "base"), 1)
_LAST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY seq DESC, account_id DESC) = 1"
_KEPT = "coalesce(nullif(display, ''), merchant_key) AS display, round(coalesce(confidence, 0.8), 3) AS confidence, model"


@query(
    f"{_EVERY}, heard AS (SELECT {O.key('merchant_key')} AS k, category, {_KEPT} FROM answers WHERE {_NAMED} {_LAST.format(O.key('merchant_key'))}),"
    f" valid AS (SELECT {O.key('merchant_key')} AS k, category, {_KEPT} FROM answers WHERE {_NAMED} AND merchant_key IN (SELECT merchant_key FROM pending) {_LAST.format('merchant_key')}),"
    " new AS (SELECT * FROM valid UNION ALL SELECT * FROM heard WHERE k NOT IN (SELECT k FROM valid))"
    " SELECT k AS merchant_key, category, display, confidence, model FROM new UNION ALL SELECT * FROM cache WHERE merchant_key NOT IN (SELECT k FROM new)"
)
def remember(spark, sf_dir):
    """Answers of every account in no order, many to a key, some written otherwise: the last of each stays. Then those to what the whole
    ledger asks, of which the last valid one of a key replaces what was heard."""
    order = ("seq", "account_id")
    answers = L.of_ledger(spark, sf_dir, L.EVERY_ANSWER)
    valid = C.validate_labels(answers, C.pending_merchants(strange(spark, sf_dir)), order=order)
    return C.remember(C.remember(L.cache(spark), answers, order=order), valid, order=order)


#: Every transaction edits its merchant's tag, so each key has many edits.
_EDITS = "SELECT merchant_key, CASE o_orderkey % 7 WHEN 0 THEN 'Uncategorised' WHEN 1 THEN 'Shopping' ELSE 'Own ' || CAST(o_orderkey % 5 AS STRING) END AS category, o_orderkey AS seq FROM {}"


@query(f"{ALL}, edits AS ({_EDITS.format('categorized')}), last AS (SELECT {O.key('merchant_key')} AS merchant_key, arg_max(category, seq) AS category FROM edits GROUP BY 1) SELECT merchant_key, category FROM overrides WHERE merchant_key NOT IN (SELECT merchant_key FROM last) UNION ALL SELECT merchant_key, category FROM last WHERE category <> 'Uncategorised'")
def set_overrides(spark, sf_dir):
    edits = spark.sql(_EDITS.format("{rows}"), rows=annotated(spark, sf_dir))
    return C.set_overrides(L.overrides(spark), edits)


_LABEL = "CASE category_source " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.SOURCE_LABELS.items()) + " ELSE category_source END"


_FAMILY = "CASE WHEN lower(k.model) LIKE 'claude%' THEN 'Claude' WHEN regexp_matches(lower(k.model), '^(gpt|chatgpt|o1|o3|o4|o5)') THEN 'OpenAI' ELSE 'AI' END"
_DECIDED = f"{_LABEL} || CASE WHEN category_source IN ('cache', 'llm') AND k.model <> '' THEN ' (' || {_FAMILY} || ')' ELSE '' END"
_LEARNED = L.LEARNED.replace("{ledger}", "ledger")


@query(f"{BASE}, learned AS ({_LEARNED}), c AS (SELECT o_orderkey, 'payee ' || lower({L._LETTERS.format('account_id')}) AS merchant_key, CASE o_orderkey % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'rule' ELSE 'cache' END AS category_source FROM ledger) SELECT o_orderkey, {_DECIDED} AS decided_by FROM c LEFT JOIN (SELECT merchant_key AS mk, model FROM learned) k ON c.merchant_key = k.mk")
def decided_by_labels(spark, sf_dir):
    who = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'rule' ELSE 'cache' END")
    rows = L.ledger(spark, sf_dir).withColumns({"merchant_key": F.expr(f"'payee ' || lower({L._LETTERS.format('account_id')})"), "category_source": who})
    return C.decided_by_labels(rows, L.of_ledger(spark, sf_dir, L.LEARNED)).select("o_orderkey", "decided_by")


@query(f"{ALL} SELECT account_id, count(*) AS rows, count(*) FILTER (category <> 'Uncategorised') AS rows_categorised, round(sum(debit + credit), 2) AS value, round(coalesce(sum(debit + credit) FILTER (category <> 'Uncategorised'), 0), 2) AS value_categorised, round(count(*) FILTER (category <> 'Uncategorised') / count(*), 6) AS row_rate, round(round(coalesce(sum(debit + credit) FILTER (category <> 'Uncategorised'), 0), 2) / round(sum(debit + credit), 2), 6) AS value_rate FROM categorized GROUP BY account_id")
def coverage(spark, sf_dir):
    return C.coverage(categorized(spark, sf_dir), ACCOUNT)


# Rollups.


@query(f"{ALL} SELECT o_orderkey, debit, category FROM categorized WHERE {SPEND}")
def spending(spark, sf_dir):
    return I.spending(categorized(spark, sf_dir)).select("o_orderkey", "debit", "category")


@query(f"{ALL} SELECT o_orderkey, credit, category FROM categorized WHERE {INCOME}")
def income(spark, sf_dir):
    return I.income(categorized(spark, sf_dir)).select("o_orderkey", "credit", "category")


START, END = "1997-01-01", "1999-06-30"
_IN = f"date BETWEEN DATE '{START}' AND DATE '{END}'"


@query(f"{BASE} SELECT o_orderkey, date FROM ledger WHERE {_IN}")
def filter_period(spark, sf_dir):
    return I.filter_period(L.ledger(spark, sf_dir), START, END).select("o_orderkey", "date")


_SPAN = "SELECT account_id, min(date) AS start, max(date) AS \"end\", CAST(max(date) - min(date) + 1 AS INT) AS span_days FROM ledger GROUP BY account_id"


@query(f"{BASE} {_SPAN}")
def statement_span(spark, sf_dir):
    return I.statement_span(L.ledger(spark, sf_dir), ACCOUNT)


@query(f"{BASE}, s AS ({_SPAN}) SELECT account_id, CASE WHEN span_days > 6 * 30.44 THEN greatest(CAST(\"end\" - INTERVAL 6 MONTH AS DATE) + 1, start) ELSE start END AS start, \"end\" FROM s")
def resolve_period(spark, sf_dir):
    return I.resolve_period(L.ledger(spark, sf_dir), 6, ACCOUNT)


@query(f"{BASE}, s AS ({_SPAN}) SELECT account_id, least(greatest(DATE '{START}', start), \"end\") AS start, least(greatest(DATE '{END}', start), \"end\") AS \"end\" FROM s")
def resolve_custom_period(spark, sf_dir):
    return I.resolve_period(L.ledger(spark, sf_dir), keys=ACCOUNT, custom=(END, START))


_BYCAT = f"SELECT category, round(sum(debit), 2) AS amount, count(*) AS transactions FROM categorized WHERE {SPEND} GROUP BY category"


@query(f"{ALL}, g AS ({_BYCAT}) SELECT *, round(amount / sum(amount) OVER (), 6) AS share FROM g")
def by_category(spark, sf_dir):
    return I.by_category(categorized(spark, sf_dir))


_MONTH = "CAST(date_trunc('month', date) AS DATE)"


@query(f"{ALL}, g AS (SELECT category, round(sum(debit), 2) AS a FROM categorized WHERE {SPEND} GROUP BY category), r AS (SELECT category, CASE WHEN row_number() OVER (ORDER BY a DESC, category) <= 7 THEN category ELSE 'Other' END AS bucket FROM g), c AS (SELECT {_MONTH} AS month, bucket, round(sum(debit), 2) AS amount FROM categorized JOIN r USING (category) WHERE {SPEND} GROUP BY ALL) SELECT m.month, b.bucket, coalesce(c.amount, 0) AS amount FROM (SELECT DISTINCT month FROM c) m CROSS JOIN (SELECT DISTINCT bucket FROM c) b LEFT JOIN c ON c.month = m.month AND c.bucket = b.bucket")
def by_month(spark, sf_dir):
    return I.by_month(categorized(spark, sf_dir))


@query(f"{ALL} SELECT account_id, {_MONTH} AS month, round(coalesce(sum(credit) FILTER ({INCOME}), 0), 2) AS income, round(coalesce(sum(debit) FILTER ({SPEND}), 0), 2) AS spend, round(round(coalesce(sum(credit) FILTER ({INCOME}), 0), 2) - round(coalesce(sum(debit) FILTER ({SPEND}), 0), 2), 2) AS net FROM categorized GROUP BY ALL")
def monthly_totals(spark, sf_dir):
    return I.monthly_totals(categorized(spark, sf_dir), keys=ACCOUNT)


@query(f"{ALL}, n AS (SELECT merchant_key, merchant, category, count(*) AS k FROM categorized WHERE {SPEND} GROUP BY ALL), m AS (SELECT merchant_key, merchant, category FROM n QUALIFY row_number() OVER (PARTITION BY merchant_key, merchant ORDER BY k DESC, category) = 1), s AS (SELECT merchant_key, merchant, round(sum(debit), 2) AS amount, count(*) AS transactions FROM categorized WHERE {SPEND} GROUP BY ALL) SELECT s.*, m.category FROM s JOIN m USING (merchant_key, merchant) ORDER BY amount DESC, merchant_key, merchant LIMIT 15")
def top_merchants(spark, sf_dir):
    return I.top_merchants(categorized(spark, sf_dir))


@query(f"{ALL}, d AS (SELECT account_id, date, round(sum(debit), 2) AS amount FROM categorized WHERE {SPEND} GROUP BY ALL), s AS (SELECT account_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY account_id), f AS (SELECT s.account_id, s.date, coalesce(amount, 0) AS amount FROM s LEFT JOIN d ON d.account_id = s.account_id AND d.date = s.date) SELECT *, round(avg(amount) OVER (PARTITION BY account_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling FROM f")
def daily(spark, sf_dir):
    return I.daily(categorized(spark, sf_dir), keys=ACCOUNT)


def _head(rows: str, per: str) -> str:
    return (
        f"SELECT account_id, round(coalesce(sum(credit) FILTER ({INCOME}), 0), 2) AS money_in, round(coalesce(sum(debit) FILTER ({SPEND}), 0), 2) AS money_out, round(sum(debit) - coalesce(sum(debit) FILTER ({SPEND}), 0), 2) AS excluded,"
        f' count(*) AS transactions, count(DISTINCT date_trunc(\'month\', date)) AS months, min(date) AS start, max(date) AS "end", round(round(coalesce(sum(credit) FILTER ({INCOME}), 0), 2) - round(coalesce(sum(debit) FILTER ({SPEND}), 0), 2), 2) AS net,'
        f" round(round(coalesce(sum(debit) FILTER ({SPEND}), 0), 2) / {per}, 2) AS monthly_burn FROM {rows} GROUP BY account_id"
    )


def _largest(rows: str) -> str:
    return f"SELECT account_id, merchant AS largest_merchant, debit AS largest_amount, date AS largest_date, category AS largest_category FROM {rows} WHERE {SPEND} QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY debit DESC, date, seq) = 1"


@query(f"{ALL}, h AS ({_head('categorized', 'greatest(1, count(DISTINCT date_trunc(' + q('month') + ', date)))')}), l AS ({_largest('categorized')}) SELECT h.*, largest_merchant, largest_amount, largest_date, largest_category FROM h LEFT JOIN l USING (account_id)")
def headline(spark, sf_dir):
    return I.headline(categorized(spark, sf_dir), keys=ACCOUNT)


_BALANCES = (
    f"SELECT account_id, count(DISTINCT source_file) AS files, arg_max(balance, (date, seq)) FILTER (balance IS NOT NULL AND {_IN}) AS c, arg_max(balance, (date, seq)) FILTER (balance IS NOT NULL AND date < DATE '{START}') AS e,"
    f" arg_min(balance - credit + debit, (date, seq)) FILTER (balance IS NOT NULL AND {_IN}) AS u FROM {{}} GROUP BY account_id"
)
_BALSEL = "round(CASE WHEN c IS NOT NULL THEN coalesce(e, u) END, 2) AS opening_balance, round(c, 2) AS closing_balance, round(round(c, 2) - round(CASE WHEN c IS NOT NULL THEN coalesce(e, u) END, 2), 2) AS balance_change"
BROKEN_SQL = L.BROKEN.replace("{ledger}", "ledger")


@query(f"{BASE}, broken AS ({BROKEN_SQL}), b AS ({_BALANCES.format('broken')}) SELECT account_id, {_BALSEL} FROM b")
def period_balances(spark, sf_dir):
    return I.period_balances(L.broken(spark, sf_dir), START, END, ACCOUNT)


@query(
    f"{ALL}, v AS (SELECT * FROM categorized WHERE {_IN}), h AS ({_head('v', '((DATE ' + q(END) + ' - DATE ' + q(START) + ' + 1) / 30.44)')}), l AS ({_largest('v')}), b AS ({_BALANCES.format('categorized')}),"
    f" n AS (SELECT account_id, count(*) AS total FROM categorized GROUP BY 1), k AS (SELECT account_id, count(*) FILTER (credit > 0) AS credits, count(*) FILTER (debit > 0) AS debits FROM v GROUP BY 1)"
    f" SELECT h.*, largest_merchant, largest_amount, largest_date, largest_category, CAST(DATE '{END}' - DATE '{START}' + 1 AS INT) AS days, credits, debits, total, {_BALSEL} FROM h LEFT JOIN l USING (account_id) JOIN b USING (account_id) JOIN n USING (account_id) JOIN k USING (account_id)"
)
def period_summary(spark, sf_dir):
    return I.period_summary(categorized(spark, sf_dir), START, END, keys=ACCOUNT)


RECURRING = "WITH recur AS (" + L.RECURRING.replace("{day}", L.DUCK_DAY).replace("{customer}", "customer") + ")"
_CADENCE = "CASE " + " ".join(f"WHEN g BETWEEN {a} AND {b} THEN '{c}'" for c, a, b in fixed.CADENCES) + " END"
_RECUR = (
    f"{RECURRING}, gaps AS (SELECT *, date - lag(date) OVER (PARTITION BY account_id, merchant_key ORDER BY date) AS gap FROM recur WHERE debit > 0 AND category <> 'Cash Withdrawal'),"
    " a AS (SELECT account_id, merchant_key, merchant, min(category) AS category, median(debit) AS m, min(debit) AS lo, max(debit) AS hi, median(gap) AS g, min(gap) AS g0, max(gap) AS g1, count(*) AS occurrences, round(sum(debit), 2) AS total, max(date) AS last_paid FROM gaps GROUP BY ALL),"
    f" r AS (SELECT account_id, merchant_key, merchant, category, round(m, 2) AS typical_amount, {_CADENCE} AS cadence, occurrences, total, last_paid, last_paid + CAST(round_even(g, 0) AS INT) AS next_expected FROM a"
    " WHERE occurrences >= 3 AND m > 0 AND greatest(hi - m, m - lo) / m <= 0.15 AND greatest(g1 - g, g - g0) <= greatest(5, g * 0.35))"
)


@query(f"{_RECUR} SELECT account_id, merchant_key, date, CAST(gap AS DOUBLE) AS gap FROM gaps")
def payment_gaps(spark, sf_dir):
    return I.payment_gaps(L.recurring(spark, sf_dir), ACCOUNT).select("account_id", "merchant_key", "date", F.col("gap").cast("double").alias("gap"))


@query(f"{_RECUR} SELECT * FROM r WHERE cadence IS NOT NULL")
def detect_recurring(spark, sf_dir):
    return I.detect_recurring(L.recurring(spark, sf_dir), keys=ACCOUNT)


def _shared_plans(spark, sf_dir):
    return L.recurring(spark, sf_dir).withColumns({"merchant_key": F.concat(F.lit("plan "), (F.col("account_id") % 8).cast("string")), "merchant": F.lit("Plan")})


@query(
    f"{RECURRING}, s AS (SELECT 'plan ' || CAST(account_id % 8 AS VARCHAR) AS merchant_key, date, debit FROM recur WHERE debit > 0 AND category <> 'Cash Withdrawal'), g AS (SELECT *, date - lag(date) OVER (PARTITION BY merchant_key ORDER BY date) AS gap FROM s)"
    " SELECT merchant_key, round(median(debit), 4) AS amount, round(median(gap), 4) AS gap, count(*) AS occurrences, round(sum(debit), 2) AS total, max(date) AS last_paid FROM g GROUP BY 1"
)
def recurring_counts(spark, sf_dir):
    """All accounts as one ledger with eight merchants, each an eighth of all rows: exact medians from counts."""
    out = I.recurring_counts(_shared_plans(spark, sf_dir))
    return out.select("merchant_key", F.round("m", 4).alias("amount"), F.round("g", 4).alias("gap"), "occurrences", "total", "last_paid")


_FACTOR = "CASE cadence " + " ".join(f"WHEN '{c}' THEN {x}" for c, x in fixed.PER_MONTH.items()) + " END"
_NOT = O._in(fixed.NOT_SPENDING)


@query(f"{_RECUR} SELECT round(coalesce(sum(typical_amount * {_FACTOR}) FILTER (category NOT IN {_NOT}), 0), 2) AS per_month, count(*) FILTER (category IN {_NOT}) AS committed, round(round(coalesce(sum(typical_amount * {_FACTOR}) FILTER (category NOT IN {_NOT}), 0), 2) * 12, 2) AS per_year FROM r WHERE cadence IS NOT NULL")
def recurring_run_rate(spark, sf_dir):
    return I.recurring_run_rate(I.detect_recurring(L.recurring(spark, sf_dir), keys=ACCOUNT))


@query(f"{ALL} SELECT account_id, category, round(sum(debit), 2) AS amount, category IN {_NOT} AS not_spending FROM categorized GROUP BY ALL")
def category_totals(spark, sf_dir):
    return I.category_totals(categorized(spark, sf_dir), ACCOUNT)


# Review.


@query(f"{ALL} SELECT o_orderkey, category, confidence FROM categorized WHERE category = 'Uncategorised' OR (confidence < 0.7 AND category_source <> 'override')")
def needs_review(spark, sf_dir):
    return review.needs_review(categorized(spark, sf_dir)).select("o_orderkey", "category", "confidence")


@query(f"{ALL} SELECT account_id, count(*) FILTER ((category = 'Uncategorised' OR (confidence < 0.7 AND category_source <> 'override')) AND NOT {_IN}) AS elsewhere FROM categorized GROUP BY account_id")
def review_elsewhere(spark, sf_dir):
    return review.review_elsewhere(categorized(spark, sf_dir), START, END, keys=ACCOUNT)


_FILTER = "category IN ('Shopping', 'Groceries') AND (regexp_matches(lower(merchant), 'big|flip.*net') OR regexp_matches(lower(description), 'big|flip.*net')) AND debit + credit >= 50000"


def _filtered(spark, sf_dir):
    return review.apply_filters(categorized(spark, sf_dir), ["Shopping", "Groceries"], "big|flip.*net", 50000)


@query(f"{ALL} SELECT o_orderkey, merchant, category FROM categorized WHERE {_FILTER}")
def apply_filters(spark, sf_dir):
    return _filtered(spark, sf_dir).select("o_orderkey", "merchant", "category")


@query(f"{ALL} SELECT count(*) AS transactions, round(coalesce(sum(debit), 0), 2) AS debit, round(coalesce(sum(credit), 0), 2) AS credit FROM categorized WHERE {_FILTER}")
def filtered_totals(spark, sf_dir):
    return I.filtered_totals(_filtered(spark, sf_dir))


@query(f"{BASE} SELECT o_orderkey, debit + credit AS amount, CASE WHEN debit > 0 THEN 'Out' ELSE 'In' END AS direction FROM ledger")
def with_amount_direction(spark, sf_dir):
    return review.with_amount_direction(L.ledger(spark, sf_dir)).select("o_orderkey", "amount", "direction")


@query(f"{BASE} SELECT o_orderkey, debit, credit FROM ledger")
def sort_transactions(spark, sf_dir):
    return review.sort_transactions(L.ledger(spark, sf_dir), "amount", False).select("o_orderkey", "debit", "credit")


@query(f"{BASE} SELECT account_id, seq, description FROM ledger ORDER BY account_id, seq LIMIT 200")
def preview(spark, sf_dir):
    return review.preview(L.ledger(spark, sf_dir)).select("account_id", "seq", "description")


@query(f"{ALL} SELECT date, description, merchant, category, channel, CASE WHEN debit > 0 THEN 'Out' ELSE 'In' END AS direction, debit, credit, balance, {_DECIDED} AS category_source, confidence, source_file FROM categorized c LEFT JOIN (SELECT merchant_key AS mk, model FROM cache) k ON c.merchant_key = k.mk")
def export_transactions(spark, sf_dir):
    return stores.export_columns(C.decided_by_labels(categorized(spark, sf_dir), L.cache(spark)))


# Proof.

_BROKEN = f"{BASE}, broken AS ({BROKEN_SQL})"
_PROVED = f"{_BROKEN}, p AS (SELECT *, lag(balance) OVER w AS b, CAST(row_number() OVER w - 1 AS INT) AS row_no FROM broken WINDOW w AS (PARTITION BY source_file ORDER BY seq)), proved AS (SELECT *, CASE WHEN row_no = 0 THEN balance IS NOT NULL ELSE coalesce(abs((balance - b) - (credit - debit)) <= 0.02, true) END AS reconciled FROM p)"


@query(f"{_PROVED} SELECT o_orderkey, row_no, reconciled FROM proved")
def reconcile(spark, sf_dir):
    return proof.reconcile(L.broken(spark, sf_dir)).select("o_orderkey", "row_no", "reconciled")


_REPORT = (
    f"{_PROVED}, a AS (SELECT source_file, count(*) AS rows_total, count(*) FILTER (reconciled) AS good, count(balance) >= 2 AS has_balance, count(*) FILTER (NOT reconciled) AS bad, array_to_string(list(row_no ORDER BY row_no) FILTER (NOT reconciled), ',') AS nos FROM proved GROUP BY 1),"
    " report AS (SELECT source_file, rows_total, CASE WHEN has_balance THEN good ELSE 0 END AS rows_reconciled, CASE WHEN has_balance THEN coalesce(nos, '') ELSE '' END AS unreconciled_rows, has_balance, has_balance AND bad = 0 AS reconciled, CASE WHEN has_balance THEN round(good / rows_total, 6) ELSE 0 END AS reconciliation_rate,"
    " CASE WHEN NOT has_balance THEN rows_total || ' rows parsed (no balance column — cannot verify)' WHEN bad = 0 THEN 'Reconciled ' || good || '/' || rows_total || ' rows' ELSE 'Reconciled ' || good || '/' || rows_total || ' rows — ' || bad || ' row(s) do not add up' END AS summary FROM a)"
)


def _report(spark, sf_dir):
    return proof.parse_report(proof.reconcile(L.broken(spark, sf_dir)))


@query(f"{_REPORT} SELECT * FROM report")
def parse_report(spark, sf_dir):
    return _report(spark, sf_dir).withColumn("unreconciled_rows", F.array_join("unreconciled_rows", ","))


@query(f"{_REPORT} SELECT CAST(sum(rows_total) AS BIGINT) AS rows_total, CAST(sum(rows_reconciled) AS BIGINT) AS rows_reconciled, bool_and(reconciled) AS all_reconciled, bool_or(has_balance) AS any_balance, count(*) FILTER (NOT reconciled) AS problem_files FROM report")
def trust_summary(spark, sf_dir):
    return proof.trust_summary(_report(spark, sf_dir))


@query(
    f"{_BROKEN}, p AS (SELECT *, last_value(balance IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, debit + credit AS a FROM broken),"
    " k AS (SELECT *, ambiguous AND balance IS NOT NULL AND p IS NOT NULL AS known, CASE WHEN abs(balance - p + a) <= 0.02 THEN true WHEN abs(balance - p - a) <= 0.02 THEN false ELSE balance - p < 0 END AS out FROM p)"
    " SELECT o_orderkey, CASE WHEN known THEN CASE WHEN out THEN a ELSE 0 END ELSE debit END AS debit, CASE WHEN known THEN CASE WHEN out THEN 0 ELSE a END ELSE credit END AS credit FROM k"
)
def direction_from_balance(spark, sf_dir):
    return proof.direction_from_balance(L.broken(spark, sf_dir)).select("o_orderkey", "debit", "credit")


#: All accounts as one ledger in the order of their numbers, dealt out in segments.
_ONE = f"{_BROKEN}, one AS (SELECT * REPLACE ('all' AS source_file, CAST(o_orderkey + 1 AS BIGINT) AS seq) FROM broken)"
SEGMENT = 512


def _one_ledger(spark, sf_dir):
    return L.broken(spark, sf_dir).withColumns({"source_file": F.lit("all"), "seq": (F.col("o_orderkey") + 1).cast("long")})


@query(f"{_ONE}, p AS (SELECT *, lag(balance) OVER w AS b, CAST(row_number() OVER w - 1 AS INT) AS row_no FROM one WINDOW w AS (ORDER BY seq)) SELECT o_orderkey, row_no, CASE WHEN row_no = 0 THEN balance IS NOT NULL ELSE coalesce(abs((balance - b) - (credit - debit)) <= 0.02, true) END AS reconciled FROM p")
def reconcile_one_ledger(spark, sf_dir):
    return proof.reconcile(_one_ledger(spark, sf_dir), segment=SEGMENT).select("o_orderkey", "row_no", "reconciled")


@query(
    f"{_ONE}, p AS (SELECT *, last_value(balance IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, debit + credit AS a FROM one),"
    " k AS (SELECT *, ambiguous AND balance IS NOT NULL AND p IS NOT NULL AS known, CASE WHEN abs(balance - p + a) <= 0.02 THEN true WHEN abs(balance - p - a) <= 0.02 THEN false ELSE balance - p < 0 END AS out FROM p)"
    " SELECT o_orderkey, CASE WHEN known THEN CASE WHEN out THEN a ELSE 0 END ELSE debit END AS debit, CASE WHEN known THEN CASE WHEN out THEN 0 ELSE a END ELSE credit END AS credit FROM k"
)
def direction_one_ledger(spark, sf_dir):
    return proof.direction_from_balance(_one_ledger(spark, sf_dir), segment=SEGMENT).select("o_orderkey", "debit", "credit")


@query(f"{_ONE}, s AS (SELECT *, date - lag(date) OVER (ORDER BY seq) AS s FROM one), c AS (SELECT count(*) AS n, count(*) FILTER (s < 0) AS back, count(*) FILTER (s > 0) AS ahead FROM s) SELECT o_orderkey, CAST(CASE WHEN n >= 3 AND back > ahead THEN n + 1 - seq ELSE seq END AS BIGINT) AS seq FROM s, c")
def chronological_one_ledger(spark, sf_dir):
    rows = _one_ledger(spark, sf_dir).withColumnRenamed("seq", "line_no")
    return proof.ensure_chronological(rows, segment=SEGMENT).select("o_orderkey", "seq")


@query(f"{BASE}, c AS (SELECT account_id, count(*) AS n, count(*) FILTER (s < 0) AS back, count(*) FILTER (s > 0) AS ahead FROM (SELECT account_id, date - lag(date) OVER (PARTITION BY account_id ORDER BY CASE WHEN account_id % 5 = 0 THEN -seq ELSE seq END) AS s FROM ledger) GROUP BY 1) SELECT o_orderkey, CASE WHEN (account_id % 5 = 0) = (n >= 3 AND back > ahead) THEN seq ELSE n + 1 - seq END AS seq FROM ledger JOIN c USING (account_id)")
def ensure_chronological(spark, sf_dir):
    rows = L.ledger(spark, sf_dir).withColumn("line_no", F.when(F.col("account_id") % 5 == 0, -F.col("seq")).otherwise(F.col("seq"))).drop("seq")
    return proof.ensure_chronological(rows).select("o_orderkey", "seq")


OVERLAP_SQL = L.OVERLAP.replace("{ledger}", "ledger")


@query(f"{BASE}, o AS ({OVERLAP_SQL}) SELECT account_id, source_file, date, description, debit, credit, balance FROM o QUALIFY row_number() OVER (PARTITION BY account_id, date, description, debit, credit, balance ORDER BY source_file, seq) = 1")
def combine(spark, sf_dir):
    return proof.combine(L.overlap(spark, sf_dir), ACCOUNT).select("account_id", "source_file", "date", "description", "debit", "credit", "balance")


@query(f"{BASE}, o AS (SELECT * FROM ledger UNION ALL SELECT * REPLACE (seq + 1000 AS seq) FROM ledger WHERE o_orderkey % 3 = 0 UNION ALL SELECT * REPLACE (0 AS debit, 0 AS credit) FROM ledger WHERE o_orderkey % 7 = 0) SELECT source_file, date, description, debit, credit, balance FROM o WHERE debit > 0 OR credit > 0 QUALIFY row_number() OVER (PARTITION BY source_file, date, description, debit, credit, balance ORDER BY seq) = 1")
def finalize(spark, sf_dir):
    rows = L.ledger(spark, sf_dir)
    again = rows.where("o_orderkey % 3 = 0").withColumn("seq", F.col("seq") + 1000)
    still = rows.where("o_orderkey % 7 = 0").withColumns({"debit": F.lit(0.0), "credit": F.lit(0.0)})
    return proof.finalize(rows.unionByName(again).unionByName(still)).select("source_file", "date", "description", "debit", "credit", "balance")


_JUNKED = "CASE o_orderkey % 11 WHEN 0 THEN 'Opening Balance' WHEN 1 THEN 'Page 3' WHEN 2 THEN 'B/F' ELSE description END"


@query(f"{BASE} SELECT o_orderkey FROM ledger WHERE NOT {hit(f'lower(trim({_JUNKED}))', fixed.JUNK)} AND o_orderkey % 17 <> 0")
def drop_non_transactions(spark, sf_dir):
    rows = L.ledger(spark, sf_dir).withColumns({"description": F.expr(_JUNKED), "date": F.when(F.col("o_orderkey") % 17 != 0, F.col("date"))})
    return proof.drop_non_transactions(rows).select("o_orderkey")


# Ingest: statements rendered from the ledger, read back.

_SQUEEZED = "trim(regexp_replace(description, '\\s+', ' ', 'g'))"


@query(f"{BASE} SELECT DISTINCT source_file, CASE account_id % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE '|' END AS delimiter FROM ledger")
def sniff_delimiter(spark, sf_dir):
    return statements.sniff_delimiter(L.lines(spark, sf_dir))


@query(f"{BASE} SELECT DISTINCT source_file, 3 AS header_line, CASE account_id % 3 WHEN 0 THEN 'balance=6,credit=5,date=3,debit=4,description=1' WHEN 1 THEN 'amount=3,balance=5,date=1,description=2,drcr=4' ELSE 'balance=6,date=1,description=3,drcr=5' END AS mapping FROM ledger")
def find_header(spark, sf_dir):
    lines = L.lines(spark, sf_dir)
    found = statements.find_header(statements.split_cells(lines, statements.sniff_delimiter(lines)))
    pairs = F.array_sort(F.transform(F.map_entries("mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return found.select("source_file", "header_line", F.array_join(pairs, ",").alias("mapping"))


# A signed column under a flag's header needs three values to be told from a flag; shorter files are errors.
_READABLE = "account_id % 3 <> 2 OR account_id IN (SELECT account_id FROM ledger GROUP BY 1 HAVING count(*) >= 3)"


@query(f"{BASE} SELECT source_file, seq, date, {_SQUEEZED} AS description, debit, credit, balance FROM ledger WHERE {_READABLE}")
def ingest(spark, sf_dir):
    rows, _ = statements.ingest_lines(L.lines(spark, sf_dir))
    return rows.select("source_file", "seq", "date", "description", "debit", "credit", "balance")


@query(f"{BASE} SELECT DISTINCT 'parse' AS kind, source_file FROM ledger WHERE NOT ({_READABLE})")
def ingest_errors(spark, sf_dir):
    _, errors = statements.ingest_lines(L.lines(spark, sf_dir))
    return errors.select("kind", "source_file")


_BROKEN_UP = "CASE seq % 3 WHEN 0 THEN substr(description, 1, 12) || ' ' || substr(description, 13) || ' \"x; y\"' WHEN 1 THEN substr(description, 1, 12) || ' ' || substr(description, 13) ELSE description END"


@query(f"{BASE} SELECT source_file, seq, date, trim(regexp_replace({_BROKEN_UP}, '\\s+', ' ', 'g')) AS description, debit, credit, balance FROM ledger")
def ingest_quoted(spark, sf_dir):
    """Statements whose narrations hold line breaks, quotes and delimiters."""
    rows, _ = statements.ingest_lines(L.quoted_lines(spark, sf_dir))
    return rows.select("source_file", "seq", "date", "description", "debit", "credit", "balance")


@query(f"{BASE} SELECT DISTINCT 'quotes' AS kind, source_file, 'a quote that is never closed' AS message FROM ledger WHERE account_id % 17 = 0")
def ingest_quoted_errors(spark, sf_dir):
    """The same with some files that end inside a quote."""
    return statements.ingest_lines(L.quoted_lines(spark, sf_dir, torn=True))[1]


@query(f"{BASE}, q AS ({L.QUOTED.replace('{{ledger}}', 'ledger').replace('{ledger}', 'ledger')}) SELECT source_file, CAST(n * 8 AS INT) AS line_no, record AS line FROM q")
def assemble_records(spark, sf_dir):
    """Their lines put together again."""
    return statements.assemble_records(L.quoted_lines(spark, sf_dir)).drop("torn")


_WRAPPED = "CASE WHEN length(description) > 44 THEN substr(description, 1, 40) || ' ' || substr(description, 41) ELSE substr(description, 1, 40) END"
_TEXT = _SQUEEZED.replace("description", _WRAPPED)
_HIGH = "(CAST(round(balance * 100) AS BIGINT) + 5000000000) / 100.0"


@query(f"{BASE} SELECT source_file, date, {_TEXT} AS description, round(debit + credit, 2) AS amount, {_HIGH} AS balance, NOT (seq = 1 OR o_orderkey % 7 = 0) AS ambiguous FROM ledger")
def parse_text_statement(spark, sf_dir):
    rows = statements.parse_text_statement(L.text_lines(spark, sf_dir))
    return rows.select("source_file", "date", "description", F.round(F.col("debit") + F.col("credit"), 2).alias("amount"), "balance", "ambiguous")


_SEVERAL = "account_id IN (SELECT account_id FROM ledger GROUP BY 1 HAVING count(*) >= 2)"


@query(f"{BASE} SELECT source_file, seq, date, {_TEXT} AS description, debit, credit, {_HIGH} AS balance FROM ledger WHERE {_SEVERAL}")
def ingest_text(spark, sf_dir):
    rows, _ = statements.ingest_text(L.text_lines(spark, sf_dir))
    return rows.select("source_file", "seq", "date", "description", "debit", "credit", "balance")


@query(f"{BASE} SELECT DISTINCT 'parse' AS kind, source_file, 'fewer than two transaction rows' AS message FROM ledger WHERE NOT ({_SEVERAL})")
def ingest_text_errors(spark, sf_dir):
    return statements.ingest_text(L.text_lines(spark, sf_dir))[1]


_FILES = "SELECT account_id, source_file, count(*) AS n FROM ledger GROUP BY 1, 2"
_PICKED = f"SELECT source_file, CASE WHEN account_id % 2 = 0 THEN 2 ELSE 1 END AS strategy_no, n AS rows_total, CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END AS reconciliation_rate FROM f WHERE CASE WHEN account_id % 2 = 0 THEN n >= 2 ELSE account_id % 3 <> 2 OR n >= 3 END"


@query(f"{BASE}, f AS ({_FILES}) {_PICKED}")
def pick_best_parse(spark, sf_dir):
    """Files read as cells and as text; which parse proves more rows."""
    _, reports, _ = statements.ingest_best(L.mixed_lines(spark, sf_dir))
    return reports.select("source_file", "strategy_no", "rows_total", "reconciliation_rate")


@query(f"{BASE}, f AS ({_FILES}), p AS ({_PICKED}) SELECT source_file, 'parse' AS kind FROM f WHERE source_file NOT IN (SELECT source_file FROM p)")
def ingest_best_errors(spark, sf_dir):
    return statements.ingest_best(L.mixed_lines(spark, sf_dir))[2].select("source_file", "kind")


# The steps of ingest by themselves.

_ALL_LINES = L.LINES.replace("{ledger}", "ledger")


@query(f"{BASE}, l AS ({_ALL_LINES}) SELECT line, count(*) AS times FROM l WHERE trim(line) <> '' GROUP BY line")
def read_statement_lines(spark, sf_dir):
    path = L.scratch(spark, "statements")
    L.lines(spark, sf_dir).repartition("source_file").select("line").write.text(path)
    lines = statements.read_statement_lines(spark, path)
    return lines.where(F.trim("line") != "").groupBy("line").agg(F.count(F.lit(1)).alias("times"))


_DELIMITER = "CASE CAST(substr(source_file, 6) AS INT) % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE '|' END"
_CELLS = f"list_transform(string_split(array_to_string(list_transform(string_split(line, '\"'), lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, {_DELIMITER}, chr(1)) ELSE x END), ''), chr(1)), lambda c: trim(c))"


@query(f"{BASE}, l AS ({_ALL_LINES}) SELECT source_file, line_no, array_to_string({_CELLS}, '~') AS cells FROM l")
def split_cells(spark, sf_dir):
    lines = L.lines(spark, sf_dir)
    return statements.split_cells(lines, statements.sniff_delimiter(lines)).select("source_file", "line_no", F.array_join("cells", "~").alias("cells"))


_MAPPING = "CASE account_id % 3 WHEN 0 THEN 'balance=6,credit=5,date=3,debit=4,description=1' WHEN 1 THEN 'amount=3,balance=5,date=1,description=2,drcr=4' ELSE 'balance=6,date=1,description=3,drcr=5' END"


@query(f"{BASE} SELECT DISTINCT source_file, {_MAPPING} AS mapping FROM ledger")
def map_columns(spark, sf_dir):
    lines = L.lines(spark, sf_dir)
    heads = statements.split_cells(lines, statements.sniff_delimiter(lines)).where("line_no = 3")
    pairs = F.array_sort(F.transform(F.map_entries("mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return heads.select("source_file", statements.map_columns("cells").alias("mapping")).select("source_file", F.array_join(pairs, ",").alias("mapping"))


def _body(spark, sf_dir):
    lines = L.lines(spark, sf_dir).repartition("source_file")
    cells = statements.split_cells(lines, statements.sniff_delimiter(lines))
    return cells, statements.find_header(cells)


@query(f"{BASE}, f AS ({_FILES}) SELECT source_file, account_id % 3 = 2 AND n >= 3 AS flag_is_amount FROM f WHERE account_id % 3 <> 0")
def refine_layout(spark, sf_dir):
    cells, headers = _body(spark, sf_dir)
    return statements.refine_layout(cells.join(headers, "source_file").where("line_no > header_line"))


_LAYOUT = "CASE account_id % 3 WHEN 0 THEN 'debit/credit columns' WHEN 1 THEN 'amount + Dr/Cr indicator' ELSE 'signed amount column' END"


@query(f"{BASE}, f AS ({_FILES}) SELECT source_file, CAST(3 + CASE WHEN account_id % 5 = 0 AND n >= 3 THEN n + 1 - seq ELSE seq END AS INT) AS line_no, date, {_SQUEEZED} AS description, debit, credit, balance, {_LAYOUT} AS strategy FROM ledger JOIN f USING (account_id, source_file) WHERE account_id % 3 <> 2 OR n >= 3")
def assemble_transactions(spark, sf_dir):
    return statements.assemble_transactions(*_body(spark, sf_dir)).where("date IS NOT NULL")


_SHOWN = [
    ("d MMMM yyyy", "%-d %B %Y"), ("yyyy/MM/dd", "%Y/%m/%d"), ("MMMM d, yyyy", "%B %-d, %Y"), ("dd.MM.yyyy", "%d.%m.%Y"), ("yyyyMMdd", "%Y%m%d"), ("EEE, dd MMM yyyy", "%a, %d %b %Y"),
    ("MMM-dd-yyyy", "%b-%d-%Y"), ("d'th of' MMMM yyyy", "%-dth of %B %Y"), ("yyyy-MMM-d", "%Y-%b-%-d"), ("d MMM yy", "%-d %b %y"), ("MM/dd/yyyy", "%m/%d/%Y"),
]
_LONG_MONTH = f"CASE o_orderkey % {len(_SHOWN)} " + " ".join(f"WHEN {k} THEN strftime(date, {q(f)})" for k, (_, f) in enumerate(_SHOWN)) + " END"
#: The last shape has the month first, which only a day over 12 tells: others are read day first.
_READ = f"CASE WHEN o_orderkey % {len(_SHOWN)} = {len(_SHOWN) - 1} AND day(date) <= 12 THEN make_date(year(date), day(date), month(date)) ELSE date END"


@query(f"{BASE} SELECT o_orderkey, {_LONG_MONTH} AS date_text, {_READ} AS date FROM ledger")
def parse_loose_dates(spark, sf_dir):
    """Files in which every row has a shape of its own."""
    text = F.lit(None).cast("string")
    for k, (shape, _) in enumerate(_SHOWN):
        text = F.when(F.col("o_orderkey") % len(_SHOWN) == k, F.date_format("date", shape)).otherwise(text)
    rows = L.ledger(spark, sf_dir).select("o_orderkey", "source_file", text.alias("date_text"), F.pmod(F.hash("o_orderkey"), F.lit(16)).alias("part"))
    # Dealt to files of its own by the order's number, so that each holds all shapes.
    return statements.parse_dates(rows, file_keys=("part",)).select("o_orderkey", "date_text", "date")


# Rules and stores.


@query(f"{BASE}, w AS ({L.DUCK_WORDS.replace('{ledger}', 'ledger')}), r AS (SELECT trim(word) AS pattern, CASE length(word) % 3 WHEN 0 THEN 'Travel' WHEN 1 THEN 'Groceries' ELSE 'Shopping' END AS category, length(word) AS specificity FROM w) SELECT pattern, category, CAST(specificity AS INT) AS specificity, CAST(row_number() OVER (ORDER BY specificity DESC, pattern) - 1 AS INT) AS priority, CASE WHEN pattern LIKE '%.%' THEN 'regex' WHEN specificity <= 4 THEN 'word' ELSE 'text' END AS kind FROM r")
def load_rules(spark, sf_dir):
    """A rule table made of the words of all narrations."""
    words = L.of_ledger(spark, sf_dir, L.WORDS)
    size = F.length("word") % 3
    category = F.when(size == 0, "Travel").when(size == 1, "Groceries").otherwise("Shopping")
    return rules.rank_rules(words.select(category.alias("category"), F.col("word").alias("pattern"), F.lit(0).alias("place")))


@query(f"{BASE}, w AS ({L.DUCK_WORDS.replace('{ledger}', 'ledger')}) SELECT word AS pattern, 'Travel' AS category, CAST(length(word) AS INT) AS specificity, CAST(row_number() OVER (ORDER BY length(word) DESC, word) - 1 AS INT) AS priority, CASE WHEN word LIKE '%.%' THEN 'regex' WHEN length(word) <= 4 THEN 'word' ELSE 'text' END AS kind FROM w")
def read_rules(spark, sf_dir):
    """Rule files written from the words of all narrations, some as lists in a line, and read back."""
    path = L.scratch(spark, "rules")
    words = L.of_ledger(spark, sf_dir, L.WORDS).groupBy(F.substring("word", 1, 2).alias("part")).agg(F.sort_array(F.collect_list("word")).alias("w"))
    below = F.concat(F.lit("# rules\nTravel:\n"), F.array_join(F.transform("w", lambda w: F.concat(F.lit("  - "), w)), "\n"))
    inside = F.concat(F.lit("Travel: ["), F.array_join(F.transform("w", lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", "), F.lit("]"))
    words.repartitionByRange("part").sortWithinPartitions("part").select(F.when(F.size("w") % 2 == 0, below).otherwise(inside).alias("value")).write.text(path)
    return rules.read_rules(spark, path)


@query(
    f"{BASE}, d AS (SELECT account_id, {L._TAG_NAME} AS a FROM (SELECT DISTINCT account_id FROM ledger) AS x WHERE account_id % 11 <> 0), e AS (SELECT account_id, a AS merchant_key, '2nd home' AS category FROM d UNION ALL SELECT account_id, 'g', 'true' FROM d UNION ALL SELECT account_id, 'j', '[k]' FROM d"
    " UNION ALL SELECT account_id, 'l', CASE account_id % 3 WHEN 0 THEN chr(123) || 'm' || chr(125) WHEN 1 THEN '7' ELSE 'Own' END FROM d) SELECT * FROM e"
)
def read_overrides(spark, sf_dir):
    """Documents of all accounts, a line each: strings alone are tags, whatever they say, and broken lines are empty stores."""
    L.of_ledger(spark, sf_dir, L.TAG_DOCUMENTS).write.text(path := L.scratch(spark, "tags"))
    return stores.read_overrides(spark, path, ACCOUNT)


@query(f"{BASE} {L.OWN_TAGS.replace('{ledger}', 'ledger')}")
def write_store(spark, sf_dir):
    """The tags of all accounts written as documents and read back."""
    stores.write_store(L.of_ledger(spark, sf_dir, L.OWN_TAGS), path := L.scratch(spark, "overrides"), keys=ACCOUNT)
    return stores.read_overrides(spark, path, ACCOUNT)


@query(f"{BASE} {L.LEARNED.replace('{ledger}', 'ledger')}")
def read_cache(spark, sf_dir):
    stores.write_store(L.of_ledger(spark, sf_dir, L.LEARNED), path := L.scratch(spark, "cache"), keys=ACCOUNT)
    return stores.read_cache(spark, path, ACCOUNT)


@query(f"{BASE} {L.OWN_CATEGORIES.replace('{ledger}', 'ledger')}")
def read_custom_categories(spark, sf_dir):
    documents = L.of_ledger(spark, sf_dir, L.OWN_CATEGORIES).groupBy("account_id").agg(F.struct(F.collect_list("name").alias("categories")).alias("entries"))
    documents.select(F.to_json(F.struct("account_id", "entries")).alias("value")).write.text(path := L.scratch(spark, "categories"))
    return stores.read_custom_categories(spark, path, ACCOUNT)


def _log(spark, sf_dir) -> str:
    edits = L.of_ledger(spark, sf_dir, L.EDITS)
    path = L.scratch(spark, "edits")
    for version in (1, 2):
        stores.append_edits(edits.where(F.col("v") == version).drop("v"), path, version)
    return path


def _at(where: str, more: str = "") -> str:
    return (
        f"{BASE}, edits AS (SELECT account_id, merchant_key, op, seq, category, v FROM ({L.EDITS.replace('{ledger}', 'ledger')}) AS x WHERE {where}{more}), cleared AS (SELECT account_id, max((v, seq)) AS c FROM edits WHERE op = 'clear' GROUP BY 1),"
        " kept AS (SELECT e.* FROM edits e LEFT JOIN cleared USING (account_id) WHERE op <> 'clear' AND (c IS NULL OR (v, seq) > c) QUALIFY row_number() OVER (PARTITION BY e.account_id, merchant_key ORDER BY v DESC, seq DESC) = 1)"
        " SELECT account_id, merchant_key, category FROM kept WHERE op = 'set'"
    )


@query(_at("true"))
def store_at(spark, sf_dir):
    """The tags of all accounts after two versions of edits."""
    return stores.store_at(stores.read_edits(spark, _log(spark, sf_dir)), ACCOUNT)


@query(_at("v = 1"))
def store_at_version(spark, sf_dir):
    """The same as they were after the first version."""
    return stores.store_at(stores.read_edits(spark, _log(spark, sf_dir), 1), ACCOUNT)


_CLEARED = " UNION ALL SELECT DISTINCT account_id, CAST(NULL AS VARCHAR), 'clear', CAST(0 AS BIGINT), NULL, 3 FROM ledger WHERE account_id % 2 = 1"


@query(_at("true", _CLEARED))
def clear_overrides(spark, sf_dir):
    """The tags of all accounts, every second of which empties its store in a third version."""
    path = _log(spark, sf_dir)
    accounts = L.ledger(spark, sf_dir).where("account_id % 2 = 1").select("account_id").distinct()
    stores.append_edits(stores.clear(accounts, ACCOUNT), path, 3)
    return stores.store_at(stores.read_edits(spark, path), ACCOUNT)


@query(f"{BASE} SELECT account_id, merchant_key, display, model FROM ({L.LEARNED.replace('{ledger}', 'ledger')}) AS x WHERE account_id % 3 > 0")
def clear_cache(spark, sf_dir):
    """Learned answers of all accounts as a log; every third account then forgets them."""
    learned = L.of_ledger(spark, sf_dir, L.LEARNED).withColumns({"op": F.lit("set"), "seq": F.lit(1).cast("long")})
    stores.append_edits(learned, path := L.scratch(spark, "answers"), 1)
    stores.append_edits(stores.clear(learned.where("account_id % 3 = 0").select("account_id").distinct(), ACCOUNT), path, 2)
    return stores.store_at(stores.read_edits(spark, path), ACCOUNT).select("account_id", "merchant_key", "display", "model")


@query(f"{BASE}, {ANNOTATED} SELECT o_orderkey, merchant_key <> 'unknown' AS resolved FROM annotated")
def is_resolved(spark, sf_dir):
    return annotated(spark, sf_dir).select("o_orderkey", scalars.is_resolved(F.col("merchant_key")).alias("resolved"))


_GUESS = f"CASE channel WHEN 'ATM' THEN 'Cash Withdrawal|0.95' WHEN 'Charges' THEN 'Fees & Charges|0.95' WHEN 'Interest' THEN 'Income|0.95' ELSE CASE WHEN credit > 0 THEN CASE WHEN {hit('description', fixed.REFUND)} THEN 'Income|0.85' ELSE 'Income|0.6' END END END"


@query(f"{BASE}, {ANNOTATED} SELECT o_orderkey, {_GUESS} AS guess FROM annotated")
def heuristic_category(spark, sf_dir):
    guess = C.heuristic_category(F.col("channel"), F.col("credit") > 0, F.col("description"))
    return annotated(spark, sf_dir).select("o_orderkey", F.when(guess.isNotNull(), F.concat_ws("|", guess["category"], guess["confidence"].cast("string"))).alias("guess"))


@query(
    f"{ALL}, s AS (SELECT CAST(account_id AS VARCHAR) AS account, category, round(sum(debit), 2) AS amount, count(*) AS rows FROM categorized WHERE {SPEND} GROUP BY ALL) SELECT 'transactions' AS name, source_file AS place, date AS at, merchant || '|' || category || '|' || channel AS what, debit AS amount, credit AS more FROM categorized"
    f" UNION ALL SELECT 'by_category', account, CAST(NULL AS DATE), category, amount, CAST(rows AS DOUBLE) FROM s"
    f" UNION ALL SELECT 'by_month', CAST(account_id AS VARCHAR), {_MONTH}, NULL, round(coalesce(sum(debit) FILTER ({SPEND}), 0), 2), round(coalesce(sum(credit) FILTER ({INCOME}), 0), 2) FROM categorized GROUP BY ALL"
)
def export_report_tables(spark, sf_dir):
    """What was written, read back: the contents of the three tables that always have rows."""
    rows = C.decided_by_labels(categorized(spark, sf_dir), L.cache(spark))
    names = stores.export_report_tables(rows, path := L.scratch(spark, "report"), ACCOUNT)
    nothing = lambda kind: F.lit(None).cast(kind)
    shown = {
        "transactions": ["source_file", "date", F.concat_ws("|", "merchant", "category", "channel"), "debit", "credit"],
        "by_category": [F.col("account_id").cast("string"), nothing("date"), "category", "amount", F.col("transactions").cast("double")],
        "by_month": [F.col("account_id").cast("string"), "month", nothing("string"), "spend", "income"],
    }
    read = [spark.read.parquet(f"{path}/{n}").select(F.lit(n), *shown[n]).toDF("name", "place", "at", "what", "amount", "more") for n in names if n in shown]
    return functools.reduce(DataFrame.unionByName, read)


_CUSTOM = "SELECT DISTINCT 'Own ' || CAST(account_id % 5 AS STRING) AS name FROM {} UNION SELECT 'Travel'"


@query(f"{BASE} SELECT name FROM ({_CUSTOM.format('ledger')}) WHERE name NOT IN {O._in(fixed.CATEGORIES)} UNION ALL SELECT unnest({O._list(fixed.CATEGORIES)}) AS name")
def all_categories(spark, sf_dir):
    return stores.all_categories(spark.sql(_CUSTOM.format("{rows}"), rows=L.ledger(spark, sf_dir))).select("name")


@query(f"{BASE} SELECT name FROM ({_CUSTOM.format('ledger')}) UNION ALL SELECT 'Pets' AS name")
def add_category(spark, sf_dir):
    custom = spark.sql(_CUSTOM.format("{rows}"), rows=L.ledger(spark, sf_dir))
    return stores.add_category(stores.add_category(custom, " Pets "), "own 1")


