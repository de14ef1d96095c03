"""Secret scans: fixed patterns, and character Markov models for random strings that no pattern knows.

**Patterns.** ``assign``, ``access`` and ``hex`` find their spans, leftmost and without overlap in each kind; matches
that are too short are dropped.

**Models.** Two first-order character models, one of random strings and one of ordinary identifiers, are compared by
the log-likelihood ratio of a token's character steps. There is a pair of them for each alphabet, that is for each set of kinds of
characters (small and capital letters, digits, signs) that a token may hold, so no token is suspect for its alphabet alone. Both are trained
from labelled samples of bounded size: random strings are the values that the patterns found in ``sample`` documents with a match,
identifiers are tokens that no pattern claims in ``sample`` documents; each time those with the smallest hash of their id. Of both
every step is learned; random strings back off to the steps from kind to kind, within a kind all characters alike, identifiers to
all identifiers and to single characters. A token of 12 characters or more that overlaps no pattern's span becomes a span of kind
``random`` when its ratio is ``margin`` or more; shorter ones can hardly reach it. The model is 15 x 67 x 67 numbers whatever the
corpus, a literal in the plan.

Everything is a built-in function; a row never meets another but in the training counts. Positions are code points, end
exclusive. Null text: empty, no spans. No match at all in the sample: no model, so no ``random`` spans. Null or repeated
ids, repeated rows: each row by itself. Very long texts: whole. Ties of start: by kind. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The kinds of characters, as parts of ALPHABET.
PARTS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_=-")
#: Tokens that may be random.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{8,}"
SAMPLE = 4000
MARGIN = 14.0
BACK_OFF = 200.0
#: The share of characters in identifiers that the sample says nothing of.
UNSEEN = 0.1
#: What the size of a kind counts against learned steps from kind to kind.
PRIOR = 50.0
#: How many steps from a character the kinds of characters weigh in random strings.
RANDOM_BACK_OFF = 1000.0

SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
NONE = f"CAST(array() AS {SPAN})"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Matches with their places: what stands between matches and the matches themselves give running lengths."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.zip_with(between, whole, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("len"))), value, lambda s, v: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), v.alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(NONE).alias("out"))

    def place(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + x["len"]).alias("end"), x["value"].alias("value")))
        keep = x["len"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct((at + F.coalesce(x["len"], F.lit(0))).alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(steps, start, place, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.expr(NONE))


def base_spans(text: Column) -> Column:
    """Spans of the patterns, sorted by start, then kind."""
    parts = [_spans(text, ASSIGN, 0, 2, LEAST_VALUE), _spans(text, ACCESS, 1), _spans(text, HEX, 2)]
    return F.array_sort(F.concat(*parts))


def _free(spans: Column, base: Column) -> Column:
    return F.filter(spans, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def alphabet_of(token: Column) -> Column:
    """The set of kinds in a token, as a number from 1 to 15."""
    return sum((F.when(token.rlike(f"[{p.replace('-', chr(92) + '-')}]"), 1 << k).otherwise(0) for k, p in enumerate(PARTS)), F.lit(0))


def _steps(tokens: DataFrame) -> dict[tuple[int, str, str], int]:
    """Counts of character steps of a column ``token``, by the token's alphabet."""
    rows = tokens.where(F.length("token") > 1).select(alphabet_of(F.col("token")).alias("s"), "token")
    pairs = rows.select("s", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, 2))).alias("pair"))
    found = pairs.groupBy("s", "pair").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 15 x 67 x 67
    return {(r["s"], r["pair"][0], r["pair"][1]): r["n"] for r in found if len(r["pair"]) == 2 and set(r["pair"]) <= set(ALPHABET)}


def _random_logs(counts: dict, s: int) -> np.ndarray:
    """Log-probabilities of steps in random strings of the alphabet ``s``, by character.

    Where few were seen they back off to the steps between kinds of characters, spread evenly within a kind, which itself has the
    uniform as its prior: what a random string is before any was seen.
    """
    kind = np.array([next(k for k, p in enumerate(PARTS) if c in p) for c in ALPHABET])
    size = np.array([len(p) if s >> k & 1 else 0 for k, p in enumerate(PARTS)], float)
    kinds = np.tile(PRIOR * size / size.sum(), (len(PARTS), 1))
    own = np.zeros((len(ALPHABET),) * 2)
    for (alphabet, a, b), n in counts.items():
        if alphabet == s:
            own[ALPHABET.index(a), ALPHABET.index(b)] += n
            kinds[kind[ALPHABET.index(a)], kind[ALPHABET.index(b)]] += n
    kinds /= kinds.sum(axis=1, keepdims=True)
    own += RANDOM_BACK_OFF * kinds[kind][:, kind] / np.maximum(size[kind], 1)
    return np.log(np.maximum(own / own.sum(axis=1, keepdims=True), 1e-12))


def _identifier_logs(counts: dict, s: int) -> np.ndarray:
    """Log-probabilities of steps in identifiers of the alphabet ``s``; what it lacks backs off to all identifiers."""
    pooled, own = np.zeros((len(ALPHABET),) * 2), np.zeros((len(ALPHABET),) * 2)
    for (k, a, b), n in counts.items():
        pooled[ALPHABET.index(a), ALPHABET.index(b)] += n
        if k == s:
            own[ALPHABET.index(a), ALPHABET.index(b)] += n
    held = np.array([any(c in p and s >> k & 1 for k, p in enumerate(PARTS)) for c in ALPHABET], float)
    single = pooled.sum(axis=0) * held
    # A character that no identifier of the sample has is unlikely in others, but not unheard of.
    single = (1 - UNSEEN) * single / max(single.sum(), 1) + UNSEEN * held / held.sum()
    single /= single.sum()
    pooled = pooled * held + BACK_OFF * single
    pooled /= pooled.sum(axis=1, keepdims=True)
    own += BACK_OFF * pooled
    return np.log(np.maximum(own / own.sum(axis=1, keepdims=True), 1e-12))


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Log-likelihood ratios of all character steps: alphabets x ALPHABET x ALPHABET; None without a labelled secret."""
    rows = docs.select(F.col("doc_id"), F.col("text")).where("text IS NOT NULL")
    order = [F.xxhash64("doc_id"), F.xxhash64("text")]
    hit = F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)
    # Only hashes are ranked, never texts; the chosen ones are at most ``sample`` pairs, a side of proven size.
    keyed = rows.select("text", *[c.alias(n) for c, n in zip(order, ("__a", "__b"), strict=True)])
    first = lambda some: F.broadcast(some.select("__a", "__b").orderBy("__a", "__b").limit(sample).distinct())
    secret = keyed.join(first(keyed.where(hit)), ["__a", "__b"], "left_semi").select(F.explode(base_spans(F.col("text"))).alias("s")).select(F.col("s.value").alias("token"))
    plain = keyed.join(first(keyed), ["__a", "__b"], "left_semi").select("text", base_spans(F.col("text")).alias("base"))
    plain = plain.select(F.explode(F.array_except(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)), F.transform("base", lambda b: b["value"]))).alias("token"))
    good, bad = _steps(secret), _steps(plain)
    if not good or not bad:
        return None
    return np.stack([_random_logs(good, s) - _identifier_logs(bad, s) for s in range(1, 1 << len(PARTS))])


def ratio(token: Column, model: Column) -> Column:
    """Sum of the model's ratios over the token's character steps."""
    size = len(ALPHABET)
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, 1)) - 1
    first = (alphabet_of(token) - 1) * size * size
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(model, first + at(i) * size + at(i + 1)))


def scan(docs: DataFrame, model: np.ndarray | None, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end, value); ``kind`` numbers KINDS."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    # Each list of spans is a column of its own, so that what follows does not make it again.
    rows = rows.select("doc_id", base_spans(F.col("text")).alias("base"), (_spans(F.col("text"), TOKEN, 3) if model is not None else F.expr(NONE)).alias("tokens"))
    if model is None:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    # One literal: the optimizer turns the text into numbers once.
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model.ravel())), ",").cast("array<double>")
    added = F.filter(_free(F.col("tokens"), F.col("base")), lambda c: ratio(c["value"], table) >= margin)
    return rows.select("doc_id", "base", F.when(F.size("tokens") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
