"""A small dictionary of our own: brands and words, by category. A larger one is read with :func:`read_rules`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixed
from .tables import small_table

RULES = {
    "Food & Dining": "swiggy zomato restaurant dhaba bakery pizza cafe biryani",
    "Groceries": "bigbasket grofers supermarket kirana blinkit",
    "Transport & Fuel": "uber ola petrol fastag metro rapido",
    "Shopping": "amazon flipkart myntra shopping ikea",
    "Bills & Utilities": "electricity broadband airtel jio bescom",
    "Rent & Housing": "rent maintenance,housing society",
    "Health & Medical": "pharmacy hospital apollo clinic",
    "Entertainment & Subscriptions": "netflix spotify amazon,prime hotstar pvr",
    "Travel": "irctc makemytrip indigo hotel",
    "Education": "school university course tuition",
    "Insurance": "insurance lic premium",
    "Investments & SIP": "mutual,fund zerodha sip groww",
    "Loan & EMI": "loan emi bajaj,finance",
    "Fees & Charges": "annual,fee penalty",
    "Transfers": "credit,card,payment self fund,transfer",
    "Income": "salary dividend",
}
RAW = "category string, pattern string, place int"
#: A pattern of letters, digits and blanks alone, and what only a regular expression holds.
PLAIN, SPECIAL = "^[A-Za-z0-9 ]+$", r"[.*+?\[\](){}|^$\\]"


def rank_rules(raw: DataFrame) -> DataFrame:
    """(pattern, category, specificity, priority, kind) from (category, pattern, place): longest first, then as listed.

    Short plain patterns fit whole words only, other plain ones any text, all others are regular expressions. Blank patterns
    are dropped; a category that does not exist, or an expression that Spark cannot read, is an error where it is met. A rule table is
    a dictionary that people write, so one task ranks it.
    """
    text = F.trim("pattern")
    known = F.when(F.col("category").isin(fixed.CATEGORIES), F.col("category")).otherwise(F.raise_error(F.concat(F.lit("no such category: "), F.coalesce("category", F.lit("null")))))
    plain = text.rlike(PLAIN)
    kind = F.when(plain & (F.length(text) <= 4), "word").when(plain | ~text.rlike(SPECIAL), "text").otherwise("regex")
    rows = raw.where(text != "").select(F.lower(text).alias("pattern"), known.alias("category"), F.length(text).alias("specificity"), "place", kind.alias("kind"))
    place = F.row_number().over(Window.orderBy(F.desc("specificity"), "place", "pattern")) - 1
    return rows.select("pattern", "category", "specificity", place.alias("priority"), "kind")


def load_rules(spark: SparkSession, table: dict[str, str] | None = None) -> DataFrame:
    """The ranked rules of a dictionary in memory, of our own by default; a comma in a pattern is a space."""
    return small_table(spark, rows(RULES if table is None else table), SCHEMA)


def _unquoted(text):
    inner = F.regexp_extract(text, r"""^(["'])(.*)\1$""", 2)
    return F.when(text.rlike(r"""^(["']).*\1$"""), inner).otherwise(F.trim(F.regexp_replace(text, r"\s+#.*$", "")))


def _bad_expressions(batches):
    for frame in batches:
        def reason(pattern):
            try:
                re.compile(pattern)
            except re.error as error:
                return f"bad pattern {pattern!r}: {error}"

        yield frame.assign(problem=frame["pattern"].map(reason))[["problem"]].dropna()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The ranked rules of files in the shape ``Category:`` and, below it, lines ``- pattern``, or ``Category: [pattern, pattern]``; ``#`` starts a comment.

    Patterns may stand in quotes. Files are read side by side, in the order of their names for rules of one length. An unknown
    category, a pattern before any, or an expression that cannot be read is an error at once.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    head = F.regexp_extract("line", r"^([^\s#-].*?)\s*:\s*(\[.*\])?\s*(#.*)?$", 1)
    listed = F.regexp_extract("line", r"^[^\s#-].*?:\s*\[(.*)\]", 1)
    item = F.regexp_extract("line", r"^\s*-\s*(.*?)\s*$", 1)
    category = F.last(F.when(head != "", _unquoted(head)), True).over(Window.partitionBy("file").orderBy("line_no"))
    items = F.when(item != "", F.array(item)).when(listed != "", F.regexp_extract_all(listed, F.lit(r"""\s*("[^"]*"|'[^']*'|[^,\s][^,]*)"""), F.lit(1)))
    rows = lines.withColumn("category", category).select("category", "file", "line_no", F.posexplode(items).alias("k", "item"))
    rows = rows.select("category", _unquoted(F.trim("item")).alias("pattern"), F.struct("file", "line_no", "k").alias("place"))
    unknown = F.when(F.col("category").isNull(), F.concat(F.lit("a pattern before any category: "), "pattern")).when(~F.col("category").isin(fixed.CATEGORIES), F.concat(F.lit("no such category: "), "category"))
    expressions = rows.where(F.col("pattern").rlike(SPECIAL)).select("pattern").mapInPandas(_bad_expressions, "problem string")
    bad = rows.select(unknown.alias("problem")).where("problem IS NOT NULL").unionByName(expressions).first()
    if bad:
        raise ValueError(bad.problem)
    return rank_rules(rows)


SCHEMA = "pattern string, category string, specificity int, priority int, kind string"


def rows(table: dict[str, str]) -> list[tuple]:
    """The ranked rows of a dictionary in memory."""
    return _ranked([(p.replace(",", " "), c) for c, text in table.items() for p in text.split()])


def _ranked(listed: list[tuple[str, str]]) -> list[tuple]:
    """As :func:`rank_rules`, for a list on the driver, with its errors at once."""
    listed = [(p.strip(), c) for p, c in listed if p.strip()]
    unknown = {c for _, c in listed} - set(fixed.CATEGORIES)
    if unknown:
        raise ValueError(f"no such category: {sorted(unknown)}")
    out = []
    for k, (pattern, category) in enumerate(sorted(listed, key=lambda x: -len(x[0]))):
        plain = re.search(PLAIN, pattern)
        kind = "word" if plain and len(pattern) <= 4 else ("text" if plain or not re.search(SPECIAL, pattern) else "regex")
        if kind == "regex":
            try:
                re.compile(pattern)
            except re.error as error:
                raise ValueError(f"bad pattern {pattern!r}: {error}") from error
        out.append((pattern.lower(), category, len(pattern), k, kind))
    return out
