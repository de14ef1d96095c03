"""Quality rules: counts of each text, fixed limits, and an ordered list of learned threshold rules.

**Counts** (:func:`counts`) are built-in functions over arrays inside one row, so a row never moves.

**Decision list** (:func:`learn`). Sequential covering over a bounded sample of labelled documents, at most ``sample`` of
them, those with the smallest hash of their id. Two thirds grow, one third prunes. A rule is a conjunction of thresholds
that covers bad documents: growing adds the threshold with the largest information gain over the rule so far until no
covered document is good; pruning cuts trailing thresholds while the rule does no worse on the other part; a rule
stays only if it is right on at least ``precision`` of what it covers there. Covered documents leave, and the next
rule is grown, up to ``rules``. Candidate thresholds are quantiles of each feature. The sample is counted by
aggregates; only those counts reach the driver.

Equal gains: the earlier feature of :data:`FEATURES`, then the lower threshold, then ``>`` before ``<=``. A document with several
labels counts once, as bad if any says so; rows of one id all count.

**Verdict.** Rules become one ordered conditional expression; the first that holds rejects, and the default keeps.

Null text: no words, so base_failed. No labelled rows, or of one class only: an empty list, which keeps all that pass
the fixed limits. Null or repeated ids, repeated rows: each row by itself; null ids have no label. Very long texts: whole. Empty
table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, materialize, words_of

#: Fixed values.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5

SAMPLE = 20_000
RULES, CONDITIONS, STEPS = 8, 3, 12
PRECISION = 0.97

FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "sign_share", "distinct_share")


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the features need)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    text = F.col("t")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    rows = rows.select(
        "doc_id",
        words_of(text).alias("w"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")).cast("long").alias("n_signs"),
    )
    windows = F.when(
        F.size("w") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id", "n_symbols", "n_upper", "n_signs",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("h"),
    )
    # Most texts repeat no window: only the others are sorted.
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("s", pairs).drop("h")
    again = F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate("p", start, lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), x - a["last"])).alias("sum")), lambda a: a["sum"])
    return rows.withColumn("n_repeat_words", F.when(F.col("p").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("p")


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > n * MOST_REPEATED)


def features() -> dict[str, Column]:
    """What rules may test, from the columns of :func:`counts`; never null."""
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("word_chars", "n_words", "n_lines"))
    found = (F.col("word_chars") / words, F.col("n_symbols") / chars, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words, F.col("n_upper") / chars, F.col("n_signs") / chars, F.col("n_distinct") / words)
    return dict(zip(FEATURES, found, strict=True))


Condition = tuple[str, str, float]


def holds(rule: list[Condition], columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for name, sign, limit in rule:
        out = out & ((columns[name] > limit) if sign == ">" else (columns[name] <= limit))
    return out


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """Information gained on the bad documents that stay covered."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rules: int = RULES, precision: float = PRECISION) -> list[list[Condition]]:
    """Ordered rules, each a conjunction of (feature, '>' or '<=', threshold) under which a document is bad."""
    order = [F.xxhash64("doc_id"), "doc_id", "quality"]
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    # The sample has at most ``sample`` rows of two numbers: a side of proven size.
    chosen = chosen.orderBy(*order).limit(sample).groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumnRenamed("doc_id", "__id")
    picked = docs.join(F.broadcast(chosen), docs["doc_id"].cast("long") == F.col("__id"), "left_semi")
    # Written before anything filters it: a filter pushed below the counts would make them again for each use.
    stats = materialize(counts(picked).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")), "quality-counts").where(~base_failed())
    columns = features()
    rows = stats.select((F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2).alias("grow"), *[c.alias(n) for n, c in columns.items()])
    rows = materialize(rows.coalesce(8), "quality-sample")
    columns = {n: F.col(n) for n in FEATURES}
    probes = [k / STEPS for k in range(STEPS)] + [0.97, 0.99, 1.0]
    marks = rows.where("grow").agg(*[F.percentile_approx(n, probes, 1000).alias(f"{n}_{b}") for n in FEATURES for b in ("all",)], *[F.percentile_approx(F.when(F.col("bad"), F.col(n)), probes, 1000).alias(f"{n}_bad") for n in FEATURES], *[F.percentile_approx(F.when(~F.col("bad"), F.col(n)), probes, 1000).alias(f"{n}_good") for n in FEATURES]).first()
    limits = {n: sorted({x for b in ("all", "bad", "good") for x in (marks[f"{n}_{b}"] or [])}) for n in FEATURES}

    def tally(where: Column) -> tuple[int, int, list[tuple[Condition, int, int]]]:
        """Bad and good rows, and those under each test: one histogram of all features gives every threshold."""
        over = lambda n: F.size(F.filter(F.lit(np.array(limits[n] or [0.0])), lambda x: columns[n] > x))
        bins = [F.struct(F.lit(n).alias("n"), over(n).alias("k")) for n in FEATURES]
        cells = rows.where(where).select("bad", F.explode(F.array(*bins)).alias("c")).groupBy("bad", "c.n", "c.k").agg(F.count(F.lit(1)).alias("rows"))
        counted = {(r["bad"], r["n"], r["k"]): r["rows"] for r in cells.collect()}  # features x thresholds x 2 at most
        bad, good = (sum(v for (b, n, _), v in counted.items() if b is want and n == FEATURES[0]) for want in (True, False))
        out = []
        for n in FEATURES:
            under = {True: 0, False: 0}
            for k, limit in enumerate(limits[n]):
                for b in under:
                    under[b] += counted.get((b, n, k), 0)
                out += [((n, ">", limit), bad - under[True], good - under[False]), ((n, "<=", limit), under[True], under[False])]
        return bad, good, out

    found: list[list[Condition]] = []
    left = F.lit(True)
    while len(found) < rules:
        rule: list[Condition] = []
        while len(rule) < CONDITIONS:
            bad, good, tests = tally(left & F.col("grow") & holds(rule, columns))
            if not bad or not good:
                break
            best, at = max((_gain(bad, good, p, n), -k) for k, (_, p, n) in enumerate(tests))
            if best <= 1e-9:
                break
            name, sign, limit = tests[-at][0]
            # Halfway to the next value seen: the same rows are covered, and unseen ones are judged by the nearer side.
            above = rows.where(left & F.col("grow") & holds(rule, columns) & (columns[name] > limit)).agg(F.min(columns[name])).first()[0]
            rule.append((name, sign, limit if above is None else (limit + above) / 2))
        if not rule:
            break
        covered = [holds(rule[: k + 1], columns) for k in range(len(rule))]
        row = rows.where(left & ~F.col("grow")).agg(*[F.count_if(c & (F.col("bad") if b else ~F.col("bad"))).alias(f"{'b' if b else 'g'}{k}") for k, c in enumerate(covered) for b in (True, False)]).first()
        cut = [(row[f"b{k}"], row[f"g{k}"]) for k in range(len(rule))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in cut]
        keep = max(range(len(rule)), key=lambda k: (worth[k], -k))
        p, n = cut[keep]
        if p + n == 0 or p / (p + n) < precision:
            break
        found.append(rule[: keep + 1])
        left = left & ~holds(found[-1], columns)
    return found


def verdict(rules: list[list[Condition]], columns: dict[str, Column]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, or 0."""
    if not rules:
        return F.lit(0)
    out = F.when(holds(rules[0], columns), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(holds(rule, columns), F.lit(k))
    return out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of all documents with base_failed, the ``rule`` that rejects them (0: none) and kept."""
    stats = counts(docs, id_col, text_col)
    stats = stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules, features())})
    return stats.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
