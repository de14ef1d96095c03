"""The same results as SQL for an oracle engine (DuckDB), written apart from the Spark operators.

Both sides share only fixed values: patterns, word lists, tables.
"""

from __future__ import annotations

from ..functions import fixed, rules
from . import ledger as L


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def _in(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def hit(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def _ic(p: str) -> str:
    return p if p.startswith("(?i)") else "(?i)" + p


LEDGER = L.LEDGER.replace("{orders}", "orders")
BASE = f"WITH ledger AS ({LEDGER})"


def channel(e: str) -> str:
    return "CASE " + " ".join(f"WHEN {hit(e, _ic(p))} THEN {q(n)}" for n, p in fixed.CHANNELS) + " ELSE 'Other' END"


def canonical(e: str) -> str:
    return "CASE " + " ".join(f"WHEN {hit(e, _ic(p))} THEN {q(n)}" for n, p in fixed.CANONICAL) + " END"


def noise(w: str) -> str:
    return (
        f"(length({w}) < 2 OR list_contains({_list([*fixed.NOISE_WORDS, *fixed.BANK_CODES])}, {w}) OR {hit(w, fixed.IFSC)} OR {hit(w, fixed.MASKED_CARD)} OR {hit(w, fixed.MONTH_STAMP)}"
        f" OR {hit(w, fixed.DATE_LIKE)} OR NOT {hit(w, '[A-Z]')} OR (length({w}) >= 8 AND length(regexp_replace({w}, '[^0-9]', '', 'g')) >= greatest(4, length({w}) // 2)))"
    )


def phrase(e: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(trim({e}), '\\s+'), lambda w: NOT {noise('w')}), ' ')"


def display(e: str) -> str:
    words = f"list_filter(list_transform(string_split_regex(trim({e}), '\\s+'), lambda w: regexp_replace(w, '[^A-Za-z0-9&''.]', '', 'g')), lambda w: w <> '')"
    shown = f"list_transform({words}, lambda w: CASE WHEN list_contains({_list(fixed.ACRONYMS)}, upper(w)) THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END)"
    return f"array_to_string(({shown})[1:6], ' ')"


def key(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'))"


ANNOTATED = f"""
raws AS (SELECT DISTINCT description, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS raw FROM ledger),
vpas AS (SELECT *, regexp_extract(raw, {q(fixed.VPA)}, 0) AS v, regexp_replace(upper(regexp_extract(raw, {q(fixed.VPA)}, 1)), '[^A-Z0-9]', '', 'g') AS handle FROM raws),
cut AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(upper(raw), {q(fixed.PREFIX)}, ' '), {q(fixed.CARD_INSIDE)}, ' ', 'g'), {q(fixed.LONG_NUMBER)}, ' ', 'g') AS u FROM vpas),
chunks AS (SELECT *, string_split_regex(CASE WHEN v = '' THEN u ELSE replace(u, upper(v), ' ') END, {q(fixed.SEPARATORS)}) AS c FROM cut),
phrases AS (SELECT *, list_filter(list_transform(c, lambda x: {phrase('x')}), lambda p: p <> '') AS f0 FROM chunks),
found AS (SELECT *, CASE WHEN len(f0) = 0 AND v <> '' THEN [upper(regexp_extract(raw, {q(fixed.VPA)}, 1))] ELSE f0 END AS f FROM phrases),
fits AS (SELECT *, list_filter(f, lambda p: regexp_replace(p, '[^A-Z0-9]', '', 'g') <> '' AND (contains(handle, regexp_replace(p, '[^A-Z0-9]', '', 'g')) OR contains(regexp_replace(p, '[^A-Z0-9]', '', 'g'), handle))) AS h FROM found),
picked AS (SELECT *, CASE WHEN v <> '' AND len(h) > 0 THEN h[1] WHEN {hit('raw', fixed.UPI_LAYOUT)} THEN f[1]
  ELSE list_filter(f, lambda p: length(p) = list_max(list_transform(f, lambda z: length(z))))[1] END AS p FROM fits),
named AS (SELECT *, coalesce({canonical('raw')}, CASE WHEN len(f) = 0 THEN 'Unknown' ELSE coalesce(nullif({display("trim(regexp_replace(p, '\\s*\\d{4,}\\s*$', ''))")}, ''), 'Unknown') END) AS merchant FROM picked),
narrations AS (SELECT description, merchant, coalesce(nullif({key('merchant')}, ''), 'unknown') AS merchant_key, {channel('raw')} AS channel, nullif(lower(v), '') AS vpa FROM named),
annotated AS (SELECT ledger.*, merchant, merchant_key, channel, vpa FROM ledger JOIN narrations USING (description))"""


def _values(rows, names: str) -> str:
    show = lambda v: "NULL" if v is None else (q(v) if isinstance(v, str) else (f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)))
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(show(v) for v in r) + ')' for r in rows)}) AS t({names})"


RULES = _values(rules.rows(rules.RULES), "pattern, category, specificity, priority, kind")
TABLES = f"""
rules AS ({RULES}), overrides AS ({_values(L.OVERRIDES, 'merchant_key, category')}),
cache AS ({_values(L.CACHE, 'merchant_key, category, display, confidence, model')}), labels AS ({_values(L.LABELS, 'merchant_key, category, display, confidence, model')})"""
MATCHED = """
pairs AS (SELECT DISTINCT merchant_key, description, lower(merchant_key || ' || ' || description) AS hay FROM annotated),
matched AS (SELECT merchant_key, description, arg_min(r.category, r.priority) AS rule_category, arg_min(r.specificity, r.priority) AS specificity FROM pairs, rules r
  WHERE CASE r.kind WHEN 'word' THEN contains(' ' || regexp_replace(hay, '[^a-z0-9_]', ' ', 'g') || ' ', ' ' || r.pattern || ' ') WHEN 'text' THEN contains(hay, r.pattern) ELSE regexp_matches(hay, r.pattern) END
  GROUP BY ALL)"""
_REF = hit("a.description", fixed.REFUND)
_LAYERS = f"""CASE WHEN o.category <> '' THEN {{0}} WHEN c.category IS NOT NULL THEN {{1}}
 WHEN m.rule_category IS NOT NULL AND a.credit > 0 AND m.rule_category NOT IN {_in(fixed.NOT_SPENDING)} AND {_REF} THEN {{2}}
 WHEN m.rule_category IS NOT NULL THEN {{3}} WHEN a.channel = 'ATM' THEN {{4}} WHEN a.channel = 'Charges' THEN {{5}} WHEN a.channel = 'Interest' THEN {{6}}
 WHEN a.credit > 0 THEN {{7}} ELSE {{8}} END"""
CATEGORIZED = f"""
categorized AS (SELECT a.*, {_LAYERS.format("o.category", "c.category", "'Income'", "m.rule_category", "'Cash Withdrawal'", "'Fees & Charges'", "'Income'", "'Income'", "'Uncategorised'")} AS category,
 {_LAYERS.format("'override'", "'cache'", "'rule'", "'rule'", "'heuristic'", "'heuristic'", "'heuristic'", "'heuristic'", "'none'")} AS category_source,
 CAST({_LAYERS.format("1.0", "coalesce(c.confidence, 0.8)", "0.9", "CASE WHEN m.specificity >= 6 THEN 0.9 ELSE 0.75 END", "0.95", "0.95", "0.95", f"CASE WHEN {_REF} THEN 0.85 ELSE 0.6 END", "0.0")} AS DOUBLE) AS confidence
 FROM annotated a LEFT JOIN overrides o USING (merchant_key) LEFT JOIN cache c ON c.merchant_key = a.merchant_key AND c.category IN {_in(fixed.CATEGORIES)}
 LEFT JOIN matched m ON m.merchant_key = a.merchant_key AND m.description = a.description)"""
ALL = f"{BASE}, {ANNOTATED}, {TABLES}, {MATCHED}, {CATEGORIZED}"
SPEND = f"debit > 0 AND category NOT IN {_in(fixed.NOT_SPENDING)}"
INCOME = "credit > 0 AND category <> 'Transfers'"
