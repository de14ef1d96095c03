"""Rollups of categorised transactions. ``keys`` come before every grouping: () for one ledger, ("account_id",) for many."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def is_spending(include_transfers: bool = False) -> Column:
    debit = F.coalesce("debit", F.lit(0.0)) > 0
    return debit if include_transfers else debit & ~F.col("category").isin(fixed.NOT_SPENDING)


def is_income() -> Column:
    return (F.coalesce("credit", F.lit(0.0)) > 0) & (F.col("category") != "Transfers")


def spending(df: DataFrame, include_transfers: bool = False) -> DataFrame:
    return df.where(is_spending(include_transfers))


def income(df: DataFrame) -> DataFrame:
    return df.where(is_income())


def _day(x: str | Column) -> Column:
    return F.to_date(F.lit(x)) if isinstance(x, str) else x


def filter_period(df: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Rows of the days from start to end, both included."""
    return df.where(F.to_date("date").between(_day(start), _day(end)))


def statement_span(df: DataFrame, keys: tuple = ()) -> DataFrame:
    out = df.groupBy(*keys).agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return out.withColumn("span_days", F.datediff("end", "start") + 1)


def resolve_period(df: DataFrame, months: int | None = None, keys: tuple = (), custom: tuple[str | Column, str | Column] | None = None) -> DataFrame:
    """(start, end) of the last ``months`` before the last transaction; where the ledger is shorter, of all of it.

    ``custom``: two days of choice, in either order, drawn into the ledger's own days.
    """
    span = statement_span(df, keys)
    if custom is not None:
        days = [F.least(F.greatest(_day(x), F.col("start")), F.col("end")) for x in custom]
        return span.select(*keys, F.least(*days).alias("start"), F.greatest(*days).alias("end"))
    if months is None:
        return span.select(*keys, "start", "end")
    first = F.greatest(F.date_add(F.add_months("end", -months), 1), F.col("start"))
    offered = F.col("span_days") > months * fixed.DAYS_PER_MONTH
    return span.select(*keys, F.when(offered, first).otherwise(F.col("start")).alias("start"), "end")


def by_category(df: DataFrame, include_transfers: bool = False, keys: tuple = ()) -> DataFrame:
    out = spending(df, include_transfers).groupBy(*keys, "category").agg(F.round(F.sum("debit"), 2).alias("amount"), F.count(F.lit(1)).alias("transactions"))
    # After the aggregate: at most 18 rows for each key.
    whole = F.sum("amount").over(Window.partitionBy(*keys))
    return out.withColumn("share", F.when(whole > 0, F.round(F.col("amount") / whole, 6)).otherwise(0.0))


def by_month(df: DataFrame, include_transfers: bool = False, top_n: int = 7, keys: tuple = ()) -> DataFrame:
    """(month, bucket, amount): the largest categories by name, the rest as Other; every month has every bucket.

    One scan: sums of (key, month, category) become one list for each key, as long as its months times its categories, and the
    ranking, the grid and its zeros are functions of that list.
    """
    sums = spending(df, include_transfers).groupBy(*keys, F.trunc("date", "MM").alias("month"), "category").agg(F.sum("debit").alias("debit"))
    lists = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("month", "category", "debit"))).alias("__cells"))
    total = lambda cells: F.round(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x["debit"]), 2)
    categories = F.array_distinct(F.transform("__cells", lambda x: x["category"]))
    ranked = F.sort_array(F.transform(categories, lambda c: F.struct((-total(F.filter("__cells", lambda x: x["category"].eqNullSafe(c)))).alias("o"), c.alias("category"))))
    lists = lists.filter(F.size("__cells") > 0).withColumn("__top", F.transform(F.slice(ranked, 1, top_n), lambda x: x["category"]))
    lists = lists.withColumn("__cells", F.transform("__cells", lambda x: F.struct(x["month"].alias("month"), F.when(F.array_contains("__top", x["category"]), x["category"]).otherwise("Other").alias("bucket"), x["debit"].alias("debit"))))
    grid = lists.select(*keys, "__cells", F.explode(F.array_distinct(F.transform("__cells", lambda x: x["month"]))).alias("month"))
    buckets = F.array_distinct(F.transform("__cells", lambda x: x["bucket"]))
    grid = grid.select(*keys, "month", F.filter("__cells", lambda x: x["month"].eqNullSafe(F.col("month"))).alias("__here"), F.explode(buckets).alias("bucket"))
    return grid.select(*keys, "month", "bucket", total(F.filter("__here", lambda x: x["bucket"] == F.col("bucket"))).alias("amount"))


def pivot_months(cells: DataFrame, buckets: list[str], keys: tuple = ()) -> DataFrame:
    """The wide form, with known columns."""
    return cells.groupBy(*keys, "month").pivot("bucket", buckets).agg(F.sum("amount")).na.fill(0.0)


def monthly_totals(df: DataFrame, include_transfers: bool = False, keys: tuple = ()) -> DataFrame:
    spend = F.sum(F.when(is_spending(include_transfers), F.col("debit")).otherwise(0.0))
    earned = F.sum(F.when(is_income(), F.col("credit")).otherwise(0.0))
    out = df.groupBy(*keys, F.trunc("date", "MM").alias("month")).agg(F.round(earned, 2).alias("income"), F.round(spend, 2).alias("spend"))
    return out.withColumn("net", F.round(F.col("income") - F.col("spend"), 2))


def top_merchants(df: DataFrame, limit: int = 15, include_transfers: bool = False, keys: tuple = ()) -> DataFrame:
    out = spending(df, include_transfers).groupBy(*keys, "merchant_key", "merchant").agg(
        F.round(F.sum("debit"), 2).alias("amount"), F.count(F.lit(1)).alias("transactions"), F.mode("category", True).alias("category")
    )
    if not keys:
        return out.orderBy(F.desc("amount"), "merchant_key", "merchant").limit(limit)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("amount"), "merchant_key", "merchant"))
    return out.withColumn("__n", rank).where(F.col("__n") <= limit).drop("__n")


def daily(df: DataFrame, include_transfers: bool = False, keys: tuple = ()) -> DataFrame:
    """Spend of each day from first to last, zeros filled, with the mean of up to seven days.

    Only days with spending are sorted, in one window by key: each is followed by its run of days without, made from
    it, and holds the sums of the six days before it (a frame in days), from which the means of the run follow.
    """
    sums = spending(df, include_transfers).where("date IS NOT NULL").groupBy(*keys, "date").agg(F.round(F.sum("debit"), 2).alias("amount"))
    by = Window.partitionBy(*keys).orderBy(F.unix_date("date"))
    near = F.collect_list(F.struct("date", "amount")).over(by.rangeBetween(-6, 0))
    days = sums.select(*keys, "date", near.alias("__near"), F.min("date").over(by.rangeBetween(Window.unboundedPreceding, 0)).alias("__first"), F.lead("date").over(by).alias("__next"))
    days = days.withColumnRenamed("date", "__on").select(*keys, "__on", "__near", "__first", F.explode(F.sequence("__on", F.coalesce(F.date_sub("__next", 1), F.col("__on")))).alias("date"))
    spent = F.aggregate(F.filter("__near", lambda x: F.datediff("date", x["date"]) <= 6), F.lit(0.0), lambda a, x: a + x["amount"])
    spent = F.when(F.datediff("date", "__on") > 6, 0.0).otherwise(spent)  # most days of a long run
    amount = F.when(F.col("date") == F.col("__on"), F.element_at("__near", -1)["amount"]).otherwise(0.0)
    return days.select(*keys, "date", amount.alias("amount"), F.round(spent / F.least(F.lit(7), F.datediff("date", "__first") + 1), 4).alias("rolling"))


def _figures(include_transfers: bool, inside: Column, order: tuple) -> list[Column]:
    """Aggregates of the key figures over rows that are ``inside``."""
    out_money = F.when(inside & is_spending(include_transfers), F.col("debit"))
    spent = F.round(F.coalesce(F.sum(out_money), F.lit(0.0)), 2)
    largest = F.min_by(F.struct("merchant", F.col("debit").alias("amount"), "date", "category"), F.when(out_money.isNotNull(), F.struct((-F.col("debit")).alias("o"), *order)))
    here = lambda c: F.when(inside, c)
    return [
        F.round(F.coalesce(F.sum(F.when(inside & is_income(), F.col("credit"))), F.lit(0.0)), 2).alias("money_in"), spent.alias("money_out"),
        F.round(F.coalesce(F.sum(here(F.col("debit"))), F.lit(0.0)) - F.coalesce(F.sum(out_money), F.lit(0.0)), 2).alias("excluded"),
        F.count_if(inside).alias("transactions"), F.size(F.collect_set(here(F.trunc("date", "MM")))).cast("long").alias("months"),
        F.min(here(F.col("date"))).alias("start"), F.max(here(F.col("date"))).alias("end"), largest.alias("l"),
    ]


HEADLINE = ("money_in", "money_out", "excluded", "transactions", "months", "start", "end")


def _headline(out: DataFrame, per: Column) -> list[Column]:
    """What follows from the figures, in order."""
    made = [F.round(F.col("money_in") - F.col("money_out"), 2).alias("net"), F.round(F.col("money_out") / per, 2).alias("monthly_burn")]
    return [*map(F.col, HEADLINE), *made, *[F.col(f"l.{c}").alias(f"largest_{c}") for c in ("merchant", "amount", "date", "category")]]


def headline(df: DataFrame, include_transfers: bool = False, period_days: int | Column | None = None, keys: tuple = (), order: tuple = ("date", "seq")) -> DataFrame:
    """One row of key figures for each key, in one aggregate."""
    out = df.groupBy(*keys).agg(*_figures(include_transfers, F.lit(True), order))
    per = F.greatest(F.col("months"), F.lit(1)) if period_days is None else (F.lit(period_days) if isinstance(period_days, int) else period_days) / fixed.DAYS_PER_MONTH
    return out.select(*keys, *_headline(out, per))


def _balances(inside: Column, before: Column, order: tuple) -> list[Column]:
    """Aggregates of a period's balances: as-of lookups without a sort, by max_by and min_by."""
    at = F.struct(*order)
    has = F.col("balance").isNotNull()
    return [
        (F.min("source_file") == F.max("source_file")).alias("one_file"),
        F.max_by("balance", F.when(has & inside, at)).alias("closing"),
        F.max_by("balance", F.when(has & before, at)).alias("earlier"),
        F.min_by(F.col("balance") - F.coalesce("credit", F.lit(0.0)) + F.coalesce("debit", F.lit(0.0)), F.when(has & inside, at)).alias("undone"),
    ]


def _balance_columns() -> list[Column]:
    good = F.coalesce("one_file", F.lit(False)) & F.col("closing").isNotNull()
    opening = F.when(good, F.round(F.coalesce("earlier", "undone"), 2))
    closing = F.when(good, F.round("closing", 2))
    return [opening.alias("opening_balance"), closing.alias("closing_balance"), F.round(closing - opening, 2).alias("balance_change")]


def _inside(start: str | Column, end: str | Column) -> tuple[Column, Column]:
    day = F.to_date("date")
    return F.coalesce(day.between(_day(start), _day(end)), F.lit(False)), day < _day(start)


def period_balances(df: DataFrame, start: str, end: str, keys: tuple = (), order: tuple = ("date", "seq")) -> DataFrame:
    """Opening and closing balance of a period and the change; null where several files mix their balances."""
    return df.groupBy(*keys).agg(*_balances(*_inside(start, end), order)).select(*keys, *_balance_columns())


def period_summary(df: DataFrame, start: str, end: str, include_transfers: bool = False, keys: tuple = (), order: tuple = ("date", "seq")) -> DataFrame:
    """Headline of a period with day, credit and debit counts, rows in all, and balances; keys without rows in it are absent.

    One aggregate over the ledger, with the period as a condition of each figure.
    """
    inside, before = _inside(start, end)
    counts = [F.count_if(inside & (F.col("credit") > 0)).alias("credits"), F.count_if(inside & (F.col("debit") > 0)).alias("debits"), F.count(F.lit(1)).alias("total")]
    out = df.groupBy(*keys).agg(*_figures(include_transfers, inside, order), *counts, *_balances(inside, before, order)).where("transactions > 0")
    days = F.datediff(_day(end), _day(start)) + 1
    return out.select(*keys, *_headline(out, days / fixed.DAYS_PER_MONTH), days.alias("days"), "credits", "debits", "total", *_balance_columns())


def payment_gaps(df: DataFrame, keys: tuple = ()) -> DataFrame:
    """Payments that may recur, each with its ``gap`` in days since the one before to the same merchant."""
    rows = df.where((F.coalesce("debit", F.lit(0.0)) > 0) & (F.col("category") != "Cash Withdrawal"))
    return rows.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy(*keys, "merchant_key", "merchant").orderBy("date"))))


def detect_recurring(df: DataFrame, min_occurrences: int = 3, amount_tolerance: float = 0.15, keys: tuple = (), by_counts: bool | None = None) -> DataFrame:
    """Merchants paid often, in like amounts and at like gaps.

    Medians are exact. With ``keys`` a group is one account's payments to a merchant, which meet in one task: the window and the
    aggregate share one exchange. Without, a merchant may hold any part of all rows, and everything comes from counts
    (:func:`recurring_counts`, the default there, or as ``by_counts`` says); the result is the same.
    """
    group = [*keys, "merchant_key", "merchant"]
    out = recurring_counts(df, keys) if (not keys if by_counts is None else by_counts) else payment_gaps(df, keys).groupBy(*group).agg(
        F.count(F.lit(1)).alias("occurrences"), F.percentile("debit", F.lit(0.5)).alias("m"), F.min("debit").alias("lo"), F.max("debit").alias("hi"),
        F.percentile("gap", F.lit(0.5)).alias("g"), F.min("gap").alias("g0"), F.max("gap").alias("g1"), F.round(F.sum("debit"), 2).alias("total"),
        F.max("date").alias("last_paid"), F.mode("category", True).alias("category"),
    )
    out = out.where((F.col("occurrences") >= min_occurrences) & (F.col("m") > 0))
    out = out.where(F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo")) / F.col("m") <= amount_tolerance)
    cadence = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, low, high in fixed.CADENCES:
        cadence = cadence.when(F.col("g").between(low, high), F.lit(name))
    out = out.withColumn("cadence", cadence).where("cadence IS NOT NULL")
    out = out.where(F.greatest(F.col("g1") - F.col("g"), F.col("g") - F.col("g0")) <= F.greatest(F.lit(5.0), F.col("g") * 0.35))
    next_ = F.date_add("last_paid", F.bround("g", 0).cast("int"))
    return out.select(*group, "category", F.round("m", 2).alias("typical_amount"), "cadence", "occurrences", "total", "last_paid", next_.alias("next_expected"))


def _bin(value: str) -> Column:
    """A bin of a value of zero or more: 64 to each doubling, so an account's values fall into some hundreds."""
    return F.when(F.col(value) > 0, F.floor(F.log2(value) * 64)).otherwise(F.lit(-1_000_000).cast("long"))


def exact_median(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, median) from (group, value, n): how often each value of zero or more stands there; as ``percentile(value, 0.5)`` gives it.

    A histogram finds the bins that hold the two middle ranks, then the values of those bins alone are counted through. No task
    sees a whole group: of its rows only counts of values move, and those of one or two bins are ordered.
    """
    coarse = counts.groupBy(*group, _bin(value).alias("__bin")).agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*group)
    upto = F.sum("n").over(by.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    coarse = coarse.withColumns({"__all": F.sum("n").over(by), "__before": upto - F.col("n")})
    low, high = F.floor((F.col("__all") - 1) / 2), F.ceil((F.col("__all") - 1) / 2)
    holds = lambda rank: (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("n"))
    middle = coarse.where(holds(low) | holds(high)).select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__bin").alias("__b"), "__before", "__all")
    near = counts.withColumn("__bin", _bin(value)).join(middle, functools.reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [F.col("__bin") == F.col("__b")]))
    place = F.col("__before") + F.sum("n").over(Window.partitionBy(*group, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    near = near.withColumn("__before", place)
    return near.groupBy(*group).agg(((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias("median"))


def recurring_counts(df: DataFrame, keys: tuple = ()) -> DataFrame:
    """What :func:`detect_recurring` judges, for ledgers where one merchant may have a third of all rows.

    Rows are counted by amount, by day and by category before they move. Gaps follow from days: one to the day before with a
    payment, and zeros for all but one payment of a day.
    """
    group = [*keys, "merchant_key", "merchant"]
    rows = df.where((F.coalesce("debit", F.lit(0.0)) > 0) & (F.col("category") != "Cash Withdrawal"))
    count = F.count(F.lit(1)).alias("n")
    amounts = rows.groupBy(*group, "debit").agg(count)
    days = rows.where("date IS NOT NULL").groupBy(*group, "date").agg(count)
    days = days.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy(*group).orderBy("date"))).cast("double"))
    gaps = days.select(*group, F.explode(F.array(F.struct("gap", F.lit(1).cast("long").alias("n")), F.struct(F.lit(0.0).alias("gap"), (F.col("n") - 1).alias("n")))).alias("g"))
    gaps = gaps.select(*group, "g.*").where("gap IS NOT NULL AND n > 0").groupBy(*group, "gap").agg(F.sum("n").alias("n"))
    by_amount = amounts.groupBy(*group).agg(F.sum("n").alias("occurrences"), F.min("debit").alias("lo"), F.max("debit").alias("hi"), F.round(F.sum(F.col("debit") * F.col("n")), 2).alias("total"))
    by_gap = gaps.groupBy(*group).agg(F.min("gap").alias("g0"), F.max("gap").alias("g1"))
    by_day = rows.groupBy(*group).agg(F.max("date").alias("last_paid"))
    common = rows.groupBy(*group, "category").agg(count).groupBy(*group).agg(F.min_by("category", F.struct((-F.col("n")).alias("o"), "category")).alias("category"))
    out = by_amount
    for part in (exact_median(amounts, group, "debit").withColumnRenamed("median", "m"), by_gap, exact_median(gaps, group, "gap").withColumnRenamed("median", "g"), by_day, common):
        part = part.select(*[F.col(c).alias(f"__{c}") if c in group else F.col(c) for c in part.columns])
        out = out.join(part, functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group]), "left").drop(*[f"__{c}" for c in group])
    return out


def recurring_run_rate(recurring: DataFrame, keys: tuple = ()) -> DataFrame:
    """What recurring payments cost in a month and a year; those that are not spending are counted as committed."""
    factor = F.expr("CASE cadence " + " ".join(f"WHEN '{c}' THEN {x}D" if "/" not in x else f"WHEN '{c}' THEN {x.split('/')[0]}D / {x.split('/')[1]}D" for c, x in fixed.PER_MONTH.items()) + " END")
    spent = ~F.col("category").isin(fixed.NOT_SPENDING)
    out = recurring.groupBy(*keys).agg(F.round(F.coalesce(F.sum(F.when(spent, F.col("typical_amount") * factor)), F.lit(0.0)), 2).alias("per_month"), F.count_if(~spent).alias("committed"))
    return out.withColumn("per_year", F.round(F.col("per_month") * 12, 2))


def category_totals(df: DataFrame, keys: tuple = ()) -> DataFrame:
    out = df.groupBy(*keys, "category").agg(F.round(F.sum("debit"), 2).alias("amount"))
    return out.withColumn("not_spending", F.col("category").isin(fixed.NOT_SPENDING))


def filtered_totals(df: DataFrame, keys: tuple = ()) -> DataFrame:
    zero = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("transactions"), zero("debit").alias("debit"), zero("credit").alias("credit"))
