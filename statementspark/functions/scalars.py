"""Column functions: amounts, dates, narrations. All are built-in expressions; null in gives a defined value out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once: the optimizer never copies a lambda's argument into each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ignore_case(pattern: str) -> str:
    return pattern if pattern.startswith("(?i)") else "(?i)" + pattern


def first_match(text: Column, pairs: list[tuple[str, str]], default: Column) -> Column:
    """The name of the first pattern that matches."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in pairs:
        out = out.when(text.rlike(_ignore_case(pattern)), F.lit(name))
    return out.otherwise(default)


def clean_amount(col: Column) -> Column:
    """A money string as a double: parentheses on both ends mean minus; a Cr or Dr suffix gives no sign; else null."""
    text = F.trim(col)
    number = F.replace(F.regexp_extract(text, fixed.AMOUNT, 1), F.lit(","), F.lit(""))
    value = F.when(number == "", None).otherwise(number).try_cast("double")
    return F.when(text.startswith("(") & text.endswith(")"), -F.abs(value)).otherwise(value)


def date_text(col: Column) -> Column:
    """The text of a date without a clock time behind it."""
    return F.trim(F.regexp_replace(F.trim(col), fixed.CLOCK, ""))


def parse_date(text: Column, fmt: str) -> Column:
    """``text`` in one format or null. Two-digit years from 69 on are of the last century."""
    short = fmt.endswith("yy") and not fmt.endswith("yyyy")
    year = r"\d{2}$" if short else (r"\d{4}$" if not fmt.startswith("y") else r"^\d{4}")
    found = F.when(text.rlike(year) & (~text.rlike(r"\d{3}$") if short else F.lit(True)), F.try_to_date(text, fmt))
    return F.when(F.year(found) >= 2069, F.add_months(found, -1200)).otherwise(found) if short else found


MONTHS = "january february march april may june july august september october november december".split()
_NO_WORDS = "^(mon|tues?|wed(nes)?|thu(rs?)?|fri|sat(ur)?|sun)(day)?$|^(of|the|on)$"


def loose_date(text: Column) -> Column:
    """A date of any common shape, by what its parts are, or null.

    Parts are runs of digits or letters; names of weekdays and endings of ordinals say nothing. A part of four digits is the year, a
    name of three letters or more, or its whole, is the month. Three parts are needed, or one of eight digits. With the year in front, month
    and day follow. Else the day is before the month, unless only the other way can be: a second part over 12 is a day. A year of
    two digits stands last, and is of the last century from 69 on.
    """
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?:[ ,]+|(?<=\d)t)\d{1,2}:\d{2}.*$", ""), r"(\d)(st|nd|rd|th)\b", "$1")
    parts = F.filter(F.regexp_extract_all(clean, F.lit(r"(\d+|[a-z]+)"), F.lit(1)), lambda p: ~p.rlike(_NO_WORDS))
    month = lambda p: F.array_position(F.transform(F.array(*map(F.lit, MONTHS)), lambda m: (F.length(p) >= 3) & m.startswith(p)), True).cast("int")
    number = lambda p: p.try_cast("int")

    def date(year: Column, month_: Column, day: Column, digits: Column) -> Column:
        full = F.when(digits == 4, year).when((digits == 2) & (year >= 69), year + 1900).when(digits == 2, year + 2000)
        return F.try_to_date(F.format_string("%04d-%02d-%02d", full, month_, day), "yyyy-MM-dd")

    def of_three(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(k)) for k in range(3))
        x, y, z = number(a), number(b), number(c)
        first = F.length(a) == 4
        turned = (y > 12) & (x <= 12)
        named = F.when(month(b) > 0, F.when(first, date(x, month(b), z, F.length(a))).otherwise(date(z, month(b), x, F.length(c))))
        named = named.when(month(a) > 0, F.when(F.length(b) == 4, date(y, month(a), z, F.length(b))).otherwise(date(z, month(a), y, F.length(c)))).when(month(c) > 0, F.when(first, date(x, month(c), y, F.length(a))))
        plain = F.when(first, F.when((y > 12) & (z <= 12), date(x, z, y, F.length(a))).otherwise(date(x, y, z, F.length(a))))
        plain = plain.otherwise(F.when(turned, date(z, x, y, F.length(c))).otherwise(date(z, y, x, F.length(c))))
        return F.when(F.array_join(p, "").rlike("[a-z]"), named).otherwise(plain)

    def of_one(p: Column) -> Column:
        return F.when(p.rlike(r"^(19|20)\d{6}$"), F.try_to_date(p, "yyyyMMdd")).when(p.rlike(r"^\d{8}$"), F.try_to_date(p, "ddMMyyyy"))

    return let(parts, lambda p: F.when(F.size(p) == 3, of_three(p)).when(F.size(p) == 1, of_one(F.get(p, F.lit(0)))))


def without_references(col: Column) -> Column:
    """A narration with zeros for its long numbers, but for those of a payment address: what names its merchant is left."""
    return F.when(col.rlike("[0-9]{12}"), F.regexp_replace(col, fixed.LONG_NUMBER + r"(?![\w.\-]*@)", "0" * 12)).otherwise(col)


def is_resolved(merchant_key: Column) -> Column:
    """Whether a narration has a merchant that can be told from others."""
    return F.coalesce((merchant_key != "") & (merchant_key != "unknown"), F.lit(False))


def model_family(model: Column) -> Column:
    """What a stored model name is shown as."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for start, name in fixed.MODEL_FAMILIES.items():
        out = out.when(F.lower(model).startswith(start), F.lit(name))
    return out.otherwise(F.lit(fixed.OTHER_MODEL))


def make_key(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))


def detect_channel(col: Column) -> Column:
    return first_match(col, fixed.CHANNELS, F.lit("Other"))


def extract_vpa(col: Column) -> Column:
    """The first payment address, lower case, or null."""
    return F.lower(F.nullif(F.regexp_extract(col, fixed.VPA, 0), F.lit("")))


def canonical_merchant(col: Column) -> Column:
    return first_match(col, fixed.CANONICAL, F.lit(None).cast("string"))


def is_noise_token(word: Column) -> Column:
    """Whether an upper-case token is plumbing and no name."""
    digits = F.length(F.regexp_replace(word, "[^0-9]", ""))
    size = F.length(word)
    named = F.array_contains(F.array(*[F.lit(w) for w in [*fixed.NOISE_WORDS, *fixed.BANK_CODES]]), word)
    shaped = word.rlike(f"{fixed.IFSC}|{fixed.MASKED_CARD}|{fixed.MONTH_STAMP}|{fixed.DATE_LIKE}")
    return (size < 2) | named | shaped | ~word.rlike("[A-Z]") | ((size >= 8) & (digits >= F.greatest(F.lit(4), F.floor(size / 2))))


def clean_phrase(chunk: Column) -> Column:
    """A phrase without its noise words, in order."""
    return F.array_join(F.filter(F.split(F.trim(chunk), r"\s+"), lambda w: ~is_noise_token(w)), " ")


def display_name(col: Column) -> Column:
    """At most six words: acronyms in capitals, others capitalised, signs gone."""
    words = F.filter(F.transform(F.split(F.trim(col), r"\s+"), lambda w: F.regexp_replace(w, "[^A-Za-z0-9&'.]", "")), lambda w: w != "")
    acronyms = F.array(*[F.lit(w) for w in fixed.ACRONYMS])
    shown = F.transform(words, lambda w: F.when(F.array_contains(acronyms, F.upper(w)), F.upper(w)).otherwise(F.initcap(w)))
    return F.array_join(F.slice(shown, 1, 6), " ")


def squash(col: Column) -> Column:
    return F.regexp_replace(col, "[^A-Z0-9]", "")


def extract_merchant(col: Column) -> Column:
    """Struct (merchant, merchant_key, channel, vpa) of a narration."""

    def info(merchant: Column, raw: Column, vpa: Column) -> Column:
        key = F.coalesce(F.nullif(make_key(merchant), F.lit("")), F.lit("unknown"))
        return F.struct(merchant.alias("merchant"), key.alias("merchant_key"), detect_channel(raw).alias("channel"), vpa.alias("vpa"))

    def phrases(raw: Column) -> Column:
        text = F.regexp_replace(F.upper(raw), fixed.PREFIX, " ")
        text = F.regexp_replace(F.regexp_replace(text, fixed.CARD_INSIDE, " "), fixed.LONG_NUMBER, " ")
        vpa = F.upper(F.coalesce(extract_vpa(raw), F.lit("")))
        text = F.when(vpa == "", text).otherwise(F.replace(text, vpa, F.lit(" ")))
        found = F.filter(F.transform(F.split(text, fixed.SEPARATORS), clean_phrase), lambda p: p != "")
        return let(found, lambda f: F.when((F.size(f) == 0) & (vpa != ""), F.array(F.upper(F.regexp_extract(raw, fixed.VPA, 1)))).otherwise(f))

    def choose(raw: Column, found: Column) -> Column:
        handle = squash(F.upper(F.regexp_extract(raw, fixed.VPA, 1)))

        def fits(p: Column, h: Column) -> Column:
            return let(squash(p), lambda s: (s != "") & (F.contains(h, s) | F.contains(s, h)))

        by_handle = let(handle, lambda h: F.when(raw.rlike(fixed.VPA), F.get(F.filter(found, lambda p: fits(p, h)), F.lit(0))))
        longest = F.aggregate(found, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
        return F.coalesce(by_handle, F.when(raw.rlike(fixed.UPI_LAYOUT), F.get(found, F.lit(0))).otherwise(longest))

    def named(raw: Column, found: Column) -> Column:
        chosen = F.trim(F.regexp_replace(choose(raw, found), r"\s*\d{4,}\s*$", ""))
        shown = F.coalesce(F.nullif(display_name(chosen), F.lit("")), F.lit("Unknown"))
        return F.when(F.size(found) == 0, F.lit("Unknown")).otherwise(shown)

    def resolve(raw: Column) -> Column:
        merchant = F.coalesce(canonical_merchant(raw), let(phrases(raw), lambda f: named(raw, f)))
        return let(F.when(raw == "", F.lit("Unknown")).otherwise(merchant), lambda m: info(m, raw, extract_vpa(raw)))

    return let(F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " ")), resolve)


def is_refund(narration: Column) -> Column:
    return narration.rlike(fixed.REFUND)


def is_boilerplate(col: Column) -> Column:
    return F.lower(col).rlike(fixed.BOILERPLATE)


def strip_value_date(body: Column, day: Column) -> Column:
    """``body`` without a trailing date, when that is ``day``."""
    tail = F.regexp_extract(body, fixed.TRAILING_DATE, 1)
    same = F.coalesce(*[parse_date(tail, f) for f in fixed.DATE_FORMATS if "MMM" not in f]) == day
    return F.trim(F.when((tail != "") & F.coalesce(same, F.lit(False)), F.regexp_replace(body, fixed.TRAILING_DATE, "")).otherwise(body))


def group_lakh(whole: Column) -> Column:
    """Digits with Indian grouping: the last three, then pairs."""
    short = F.length(whole) <= 3
    start = F.substring(whole, F.lit(1), F.length(whole) - 3)
    grouped = F.regexp_replace(start, r"(\d)(?=(?:\d\d)+$)", "$1,")
    return F.when(short, whole).otherwise(F.concat(grouped, F.lit(","), F.right(whole, F.lit(3))))


def rupees(value: Column, decimals: int = 0) -> Column:
    """``₹1,23,456``: half-even rounding, minus before the sign; null is a dash."""
    size = F.format_string(f"%.{decimals}f", F.bround(F.abs(value.cast("double")), decimals))
    whole, fraction = F.substring_index(size, ".", 1), F.substring_index(size, ".", -1)
    shown = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.lit("₹"), group_lakh(whole), F.concat(F.lit("."), fraction) if decimals else F.lit(""))
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit("—")).otherwise(shown)


def compact(value: Column) -> Column:
    """``₹1.20L``, ``₹45.0k``: crore, lakh and thousand with 2, 2 and 1 decimals, else none."""
    size = F.abs(value.cast("double"))
    text = F.when(size >= 1e7, F.concat(F.format_string("%.2f", F.bround(size / 1e7, 2)), F.lit("Cr")))
    text = text.when(size >= 1e5, F.concat(F.format_string("%.2f", F.bround(size / 1e5, 2)), F.lit("L")))
    text = text.when(size >= 1e3, F.concat(F.format_string("%.1f", F.bround(size / 1e3, 1)), F.lit("k")))
    text = text.otherwise(F.format_string("%.0f", F.bround(size, 0)))
    shown = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.lit("₹"), text)
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit("—")).otherwise(shown)
