"""Categories in ordered layers: own tags, learned answers, rules, channel heuristics, a classifier's labels."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import is_refund, make_key, model_family, without_references
from .merchant import annotate

AMOUNT = "coalesce(debit, 0D) + coalesce(credit, 0D)"


GRAM = 4
#: Rules that no gram or word can find, short signs and expressions without a long literal, meet haystacks in this many blocks.
BLOCKS = 64
#: Expressions of literals with ``.``, ``.*`` and ``.+`` between them: every literal must stand in what they fit.
_LITERALS = r"^[^\\\[\](){}|?*+^$.]*(\.[*+]?[^\\\[\](){}|?*+^$.]*)*$"
_FITS = "CASE kind WHEN 'word' THEN contains(__words, concat(' ', pattern, ' ')) WHEN 'text' THEN contains(__hay, pattern) ELSE __hay RLIKE pattern END"
_RULE = ("pattern", "kind", "category", "specificity", "priority")


def _grams(text: str | Column) -> Column:
    """The distinct runs of ``GRAM`` characters of a text."""
    text = F.col(text) if isinstance(text, str) else text
    size = F.length(text)
    return F.when(size < GRAM, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM)))))


def file_rules(rules: DataFrame) -> DataFrame:
    """``rules`` with ``gram``, what they are filed under in an inverted index, and ``masked``, whether long numbers say nothing to them.

    A rule of whole words is filed under its first word. A text is filed under that of its grams which the fewest rules hold,
    and so is an expression by its literals. To ``masked`` rules, which have no digit and no wildcard that counts characters, a long
    number is like any other; all others are filed under something with a digit. Null: what has neither.
    """
    masked = ~F.col("pattern").rlike("[0-9]") & ((F.col("kind") != "regex") | (F.col("pattern").rlike(_LITERALS) & ~F.regexp_replace("pattern", r"\.[*]", "").contains(".")))
    rules = rules.select(*_RULE, masked.alias("masked"))
    literal = F.when(F.col("kind") == "text", F.array("pattern")).when((F.col("kind") == "regex") & F.col("pattern").rlike(_LITERALS), F.split("pattern", r"\.[*+]?"))
    usable = lambda g: F.col("masked") | g.rlike("[0-9]")
    held = rules.select(*rules.columns, F.explode(F.filter(F.array_distinct(F.flatten(F.transform(literal, _grams))), usable)).alias("gram"))
    common = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = held.join(common, "gram").groupBy(*rules.columns).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    words = rules.select(*rules.columns, F.split(F.trim("pattern"), " ")[0].alias("gram")).where((F.col("kind") == "word") & usable(F.col("gram")))
    filed = rarest.unionByName(words)
    rule = ["priority", "pattern", "kind"]
    loose = rules.join(filed.select(*rule), rule, "left_anti").select(*rules.columns, F.lit(None).cast("string").alias("gram"))
    return filed.unionByName(loose)


def _haystacks(pairs: DataFrame, key: str, text: str) -> DataFrame:
    """``pairs`` with ``__hay``, what rules are held against, and ``__words``, its words between blanks."""
    hay = F.lower(F.concat(F.coalesce(key, F.lit("")), F.lit(" || "), F.coalesce(text, F.lit(""))))
    return pairs.withColumn("__hay", hay).withColumn("__words", F.concat(F.lit(" "), F.regexp_replace("__hay", "[^a-z0-9_]", " "), F.lit(" ")))


def _fitting(hays: DataFrame, filed: DataFrame, keys: tuple[str, str], digits: bool = False) -> DataFrame:
    """(keys, category, specificity, priority) of haystacks and the rules that fit them: equi-joins by word, gram or block, then the whole rule.

    ``digits``: the rules are filed under words and grams with a digit alone.
    """
    held = F.concat(F.split(F.trim("__words"), " +"), _grams("__hay"))
    held = F.array_distinct(F.filter(held, lambda g: g.rlike("[0-9]")) if digits else held)
    # A haystack also holds the number of its block, behind a sign that no gram or word has, and a rule without a gram stands in every block.
    block = lambda k: F.concat(F.lit("\u0000block "), k.cast("string"))
    held = F.concat(held, F.array(block(F.pmod(F.xxhash64(*keys), F.lit(BLOCKS)))))
    keyed = hays.select(*keys, "__hay", "__words", F.explode(held).alias("__gram"))
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), block)
    filed = filed.withColumn("gram", F.explode(F.when(F.col("gram").isNull(), everywhere).otherwise(F.array("gram"))))
    return keyed.join(filed, F.col("__gram") == F.col("gram")).where(F.expr(_FITS)).select(*keys, "category", "specificity", "priority")


def match_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """(merchant_key, description, category, specificity) of distinct pairs that a rule fits: the first by priority.

    Rules are an inverted index (:func:`file_rules`; ``rules`` may be one already), so no haystack meets a rule with which it shares
    nothing. Rules without a digit say nothing of long reference numbers: they meet each distinct haystack with its numbers masked,
    of which there are few; only those with a digit and expressions meet whole haystacks. The best rule is an aggregate
    with partial aggregation, not a sort.
    """
    filed = rules if "gram" in rules.columns else file_rules(rules)
    pairs = df.select("merchant_key", "description", without_references(F.col("description")).alias("__masked")).distinct()
    best = lambda rows, *keys: rows.groupBy(*keys).agg(F.min_by(F.struct("category", "specificity", "priority"), "priority").alias("r"))
    short = _haystacks(pairs.select("merchant_key", "__masked").distinct(), "merchant_key", "__masked")
    masked = best(_fitting(short, filed.where("masked"), ("merchant_key", "__masked")), "merchant_key", "__masked")
    masked = masked.select(F.col("merchant_key").alias("__k"), F.col("__masked").alias("__m"), "r.*")
    spread = pairs.join(masked, pairs["merchant_key"].eqNullSafe(masked["__k"]) & pairs["__masked"].eqNullSafe(masked["__m"]))
    columns = ("merchant_key", "description", "category", "specificity", "priority")
    whole = _fitting(_haystacks(pairs, "merchant_key", "description"), filed.where("NOT masked"), ("merchant_key", "description"), digits=True)
    found = best(spread.select(*columns).unionByName(whole.select(*columns)), "merchant_key", "description")
    return found.select("merchant_key", "description", F.col("r.category").alias("category"), F.col("r.specificity").alias("specificity"))


def heuristic_category(channel: Column, is_credit: Column, narration: Column) -> Column:
    """Struct (category, confidence), or null."""
    guess = lambda c, x: F.struct(F.lit(c).alias("category"), x.alias("confidence"))
    known = {"ATM": "Cash Withdrawal", "Charges": "Fees & Charges", "Interest": "Income"}
    out = F.when(F.lit(False), F.lit(None))
    for name, category in known.items():
        out = out.when(channel == name, guess(category, F.lit(0.95)))
    return out.when(is_credit, guess("Income", F.when(is_refund(narration), F.lit(0.85)).otherwise(F.lit(0.6))))


def last_per_key(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row for each key: that which is last in ``order``; rows that tie there, or tables without such columns, go by their values.

    An aggregate with partial aggregation, so a key that is edited very often is one row of each task before anything moves.
    """
    order = tuple(c for c in order if c in rows.columns)
    values = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*order, *[c for c in values if c not in order]))
    return rows.groupBy(*keys).agg(last.alias("__last")).select(*keys, "__last.*")


def categorize(df: DataFrame, overrides: DataFrame, cache: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with merchant columns, category, category_source and confidence: the first layer that answers.

    ``keys``: columns by which the stores of several accounts are told apart. A store with several rows of a key counts as its last
    one (:func:`last_per_key`), so no transaction is ever multiplied.
    """
    rows = annotate(df)
    matched = match_rules(rows, rules).select(F.col("merchant_key").alias("__k"), F.col("description").alias("__d"), F.col("category").alias("__rule"), F.col("specificity").alias("__spec"))
    by = (*keys, "merchant_key")
    sided = lambda store, side: store.select(*[F.col(c).alias(f"__{side}_{c}") for c in store.columns])
    mine = sided(last_per_key(overrides.where("category <> ''"), by), "o").withColumnRenamed("__o_category", "__own")
    learned = sided(last_per_key(cache.where(F.col("category").isin(fixed.CATEGORIES)), by), "c").withColumnRenamed("__c_category", "__known").withColumn("__sure", F.coalesce("__c_confidence", F.lit(0.8)))
    on = lambda side: functools.reduce(Column.__and__, [F.col(c) == F.col(f"__{side}_{c}") for c in by])
    rows = rows.join(mine, on("o"), "left").join(learned, on("c"), "left")
    rows = rows.join(matched, rows["merchant_key"].eqNullSafe(matched["__k"]) & rows["description"].eqNullSafe(matched["__d"]), "left")
    credit = F.coalesce("credit", F.lit(0.0)) > 0
    result = lambda c, s, x: F.struct(c.alias("category"), F.lit(s).alias("category_source"), x.alias("confidence"))
    refund = credit & ~F.col("__rule").isin(fixed.NOT_SPENDING) & is_refund(F.col("description"))
    guess = heuristic_category(F.col("channel"), credit, F.col("description"))
    outcome = (
        F.when(F.col("__own").isNotNull(), result(F.col("__own"), "override", F.lit(1.0)))
        .when(F.col("__known").isNotNull(), result(F.col("__known"), "cache", F.col("__sure")))
        .when(F.col("__rule").isNotNull() & refund, result(F.lit("Income"), "rule", F.lit(0.9)))
        .when(F.col("__rule").isNotNull(), result(F.col("__rule"), "rule", F.when(F.col("__spec") >= 6, F.lit(0.9)).otherwise(F.lit(0.75))))
        .when(guess.isNotNull(), result(guess["category"], "heuristic", guess["confidence"]))
        .otherwise(result(F.lit(fixed.UNCATEGORISED), "none", F.lit(0.0)))
    )
    return rows.withColumn("__o", outcome).select(*[c for c in rows.columns if not c.startswith("__")], "__o.*")


def pending_merchants(df: DataFrame, order: tuple = ("date", "source_file", "seq")) -> DataFrame:
    """One row for each uncategorised merchant: its largest transaction, the first on ties."""
    rows = df.where(F.col("category") == fixed.UNCATEGORISED)
    key = F.coalesce(F.nullif("merchant_key", F.lit("")), make_key(F.col("description")))
    rows = rows.select(key.alias("merchant_key"), "merchant", "description", "channel", "credit", F.expr(AMOUNT).alias("amount"), *order).where("merchant_key <> ''")
    first = Window.partitionBy("merchant_key").orderBy(F.desc("amount"), *order)
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return rows.select("merchant_key", "merchant", F.col("description").alias("narration"), "channel", F.when(F.col("credit") > 0, "credit").otherwise("debit").alias("direction"), "amount")


def batch_merchants(pending: DataFrame, size: int = 40, max_batches: int = 10) -> DataFrame:
    """Batches for a classifier. What leaves has no amounts. The limit is the feature: a budget of requests."""
    top = pending.orderBy(F.desc("amount"), "merchant_key").limit(size * max_batches)
    number = F.row_number().over(Window.orderBy(F.desc("amount"), "merchant_key"))
    return top.withColumn("batch", F.floor((number - 1) / size)).select("batch", "merchant_key", "merchant", "narration", "channel", "direction")


LABEL = "merchant_key string, category string, display string, confidence double, model string"


def classify(batches: DataFrame, classifier, schema: str = LABEL, keys: tuple[str, ...] = ()) -> DataFrame:
    """Labels by a pluggable ``classifier(batch) -> pandas frame``, batch by batch on the executors, with ``batch`` and ``seq``.

    A batch that fails is one row with its ``error``, so it never fails the job. As if batches had been sent one after another,
    answers before the first failing batch stay and all from it on are dropped: a minimum over an account's batches (``keys``), whose number
    is the budget. ``seq`` numbers answers, so later ones of a key win (:func:`validate_labels`).
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(key, pdf):
        out = dict.fromkeys([*keys, "batch"])
        out.update(zip([*keys, "batch"], key, strict=True))
        try:
            said = classifier(pdf)[names].reset_index(drop=True)
            said = said.assign(seq=range(len(said)), error=None)
        except Exception as error:  # whatever a classifier raises is a result
            said = pd.DataFrame([dict.fromkeys(names) | {"seq": -1, "error": f"{type(error).__name__}: {error}"[:500]}])
        return said.assign(**out)[[*keys, "batch", *names, "seq", "error"]]

    kinds = dict(batches.dtypes)
    before = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "batch"))
    tried = batches.groupBy(*keys, "batch").applyInPandas(run, f"{before}, {schema}, seq long, error string")
    failed = F.min(F.when(F.col("error").isNotNull(), F.col("batch"))).over(Window.partitionBy(*keys))
    kept = tried.withColumn("__failed", failed).where("__failed IS NULL OR batch < __failed")
    return kept.withColumn("seq", F.col("batch") * (1 << 32) + F.col("seq")).drop("error", "__failed")


def _valid(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("category").isin([c for c in fixed.CATEGORIES if c != fixed.UNCATEGORISED]))


def validate_labels(labels: DataFrame, batch: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Answers with a category that exists, to a key that was asked; of several valid ones to a key the last."""
    by = (*keys, "merchant_key")
    return last_per_key(_valid(labels).join(batch.select(*by), list(by), "left_semi"), by, order)


def apply_labels(df: DataFrame, labels: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Labels on uncategorised rows. As many rows as before: of several labels of a key the last counts."""
    by = (*keys, "merchant_key")
    said = last_per_key(labels, by, order)
    said = said.select(*[F.col(c).alias(f"__l_{c}") for c in by], F.col("category").alias("__c"), F.coalesce("confidence", F.lit(0.8)).alias("__x"))
    rows = df.join(said, functools.reduce(Column.__and__, [df[c] == said[f"__l_{c}"] for c in by]), "left")
    hit = (F.col("category") == fixed.UNCATEGORISED) & F.col("__c").isNotNull()
    new = {"category": F.col("__c"), "category_source": F.lit("llm"), "confidence": F.col("__x")}
    return rows.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def remember(cache: DataFrame, labels: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The cache with labels put in, one row a key: keys are normalised, unknown categories skipped, and the last label of a key wins."""
    by = (*keys, "merchant_key")
    there = [c for c in order if c in labels.columns]
    new = _valid(labels).select(
        *keys, make_key(F.col("merchant_key")).alias("merchant_key"), "category", F.coalesce(F.nullif("display", F.lit("")), "merchant_key").alias("display"),
        F.round(F.coalesce("confidence", F.lit(0.8)), 3).alias("confidence"), F.coalesce("model", F.lit("")).alias("model"), *there,
    ).where("merchant_key <> ''")
    new = last_per_key(new, by, order).drop(*there)
    old = last_per_key(cache.select(*new.columns, *[c for c in there if c in cache.columns]), by, order).select(*new.columns)
    return new.unionByName(old.join(new.select(*by), list(by), "left_anti"))


def set_overrides(overrides: DataFrame, edits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Overrides after edits (merchant_key, category, seq): the last edit of a key wins, Uncategorised deletes."""
    by = (*keys, "merchant_key")
    last = edits.select(*keys, make_key(F.col("merchant_key")).alias("merchant_key"), "category", "seq").where("merchant_key <> ''")
    last = last_per_key(last, by).drop("seq")
    kept = last_per_key(overrides.select(*by, "category"), by).join(last.select(*by), list(by), "left_anti")
    return kept.unionByName(last.where(F.col("category") != fixed.UNCATEGORISED))


def decided_by_labels(df: DataFrame, cache: DataFrame) -> DataFrame:
    """``df`` with decided_by: who decided, and for learned answers which model family did."""
    models = last_per_key(cache.select("merchant_key", "model"), ("merchant_key",)).select(F.col("merchant_key").alias("__k"), F.nullif("model", F.lit("")).alias("__m"))
    rows = df.join(models, df["merchant_key"] == models["__k"], "left")
    names = F.create_map(*[F.lit(x) for pair in fixed.SOURCE_LABELS.items() for x in pair])
    label = F.coalesce(F.try_element_at(names, F.col("category_source")), F.col("category_source"))
    known = F.col("category_source").isin("cache", "llm") & F.col("__m").isNotNull()
    family = model_family(F.col("__m"))
    return rows.select(*[df[c] for c in df.columns], F.when(known, F.concat(label, F.lit(" ("), family, F.lit(")"))).otherwise(label).alias("decided_by"))


def coverage(df: DataFrame, keys: tuple = ()) -> DataFrame:
    """How much is categorised, by rows and by value."""
    known = F.col("category") != fixed.UNCATEGORISED
    value = F.expr(AMOUNT)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(known).alias("rows_categorised"), F.coalesce(F.round(F.sum(value), 2), F.lit(0.0)).alias("value"), F.coalesce(F.round(F.sum(F.when(known, value)), 2), F.lit(0.0)).alias("value_categorised"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return out.withColumns({"row_rate": rate("rows_categorised", "rows"), "value_rate": rate("value_categorised", "value")})
