"""Proving transactions against the running balance: order, direction, reconciliation, reports, combining files.

All windows are of one file, and all partition by ``file_keys``, so one exchange serves them. A ledger too long for one task is read in
segments: with ``segment`` rows are dealt out by file and place, so many to a task, each segment's last row, last known value and counts are
one row of a small table, and what lies before a segment is a window over that table alone. The results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

SAME = ("date", "description", "debit", "credit", "balance")
FILE = ("source_file",)


def _with_before(df: DataFrame, file_keys: tuple, order: str, segment: int, columns: tuple[str, ...]) -> DataFrame:
    """``df`` with ``__seg``; ``__rows``, how many rows lie before the segment; and of each column ``__last_c``, its value in the row right
    before the segment, and ``__known_c``, the last one before it that is not null."""
    rows = df.withColumn("__seg", F.floor(F.col(order) / segment))
    keys = (*file_keys, "__seg")
    small = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(F.struct(*columns), order).alias("last"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"known_{c}") for c in columns]
    )
    by = Window.partitionBy(*file_keys).orderBy("__seg")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__rows"), F.lag("last").over(by).alias("__l")]
    small = small.select(*keys, *carried, *[F.last(f"known_{c}", True).over(before).alias(f"__known_{c}") for c in columns])
    small = small.select("*", *[F.col("__l")[c].alias(f"__last_{c}") for c in columns]).drop("__l")
    return rows.join(small, list(keys))


def _lag(name: str, file_keys: tuple, order: str, segment: int | None) -> Column:
    """The value in the row before, also where that is in the segment before."""
    if not segment:
        return F.lag(name).over(Window.partitionBy(*file_keys).orderBy(order))
    by = Window.partitionBy(*file_keys, "__seg").orderBy(order)
    return F.when(F.row_number().over(by) == 1, F.col(f"__last_{name}")).otherwise(F.lag(name).over(by))


def _place(file_keys: tuple, order: str, segment: int | None) -> Column:
    """The number of a row in its file, from 1."""
    if not segment:
        return F.row_number().over(Window.partitionBy(*file_keys).orderBy(order))
    return (F.row_number().over(Window.partitionBy(*file_keys, "__seg").orderBy(order)) + F.col("__rows")).cast("int")


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("__seg", "__rows", "__last_", "__known_"))])


def ensure_chronological(df: DataFrame, line: str = "line_no", file_keys: tuple = FILE, segment: int | None = None) -> DataFrame:
    """``seq`` from the order of lines, reversed for a file that runs from newest to oldest. No sort by date."""
    rows = _with_before(df, file_keys, line, segment, ("date",)) if segment else df
    rows = rows.withColumns({"__step": F.datediff("date", _lag("date", file_keys, line, segment)), "__n": _place(file_keys, line, segment)})
    counts = {"__back": F.count_if(F.col("__step") < 0), "__ahead": F.count_if(F.col("__step") > 0), "__all": F.count(F.lit(1))}
    if segment:
        # One row a file, from partial sums; which of the two plans joins it is the planner's choice.
        totals = rows.groupBy(*[F.col(k).alias(f"__t_{k}") for k in file_keys], F.lit(1).alias("__one")).agg(*[c.alias(n) for n, c in counts.items()])
        same = F.lit(1) == F.col("__one")
        for k in file_keys:
            same = same & (F.col(k) == F.col(f"__t_{k}"))
        rows = rows.join(totals, same).drop("__one", *[f"__t_{k}" for k in file_keys])
    else:
        rows = rows.withColumns({n: c.over(Window.partitionBy(*file_keys)) for n, c in counts.items()})
    turned = (F.col("__all") >= 3) & (F.col("__back") > F.col("__ahead"))
    rows = rows.withColumn("seq", F.when(turned, F.col("__all") + 1 - F.col("__n")).otherwise(F.col("__n")).cast("long"))
    return _clean(rows.drop("__step", "__n", "__back", "__ahead", "__all"))


def drop_non_transactions(df: DataFrame) -> DataFrame:
    text = F.lower(F.trim(F.coalesce("description", F.lit(""))))
    moved = (F.coalesce("debit", F.lit(0.0)) != 0) | (F.coalesce("credit", F.lit(0.0)) != 0) | F.col("balance").isNotNull()
    return df.where(F.col("date").isNotNull() & ~text.rlike(fixed.JUNK) & moved)


def finalize(df: DataFrame, file_keys: tuple = FILE, order: tuple = ("seq",)) -> DataFrame:
    """Positive amounts, rows that move money, the first of rows that are equal in a file."""
    rows = df.withColumns({"debit": F.abs(F.coalesce("debit", F.lit(0.0))), "credit": F.abs(F.coalesce("credit", F.lit(0.0)))}).where("debit > 0 OR credit > 0")
    first = F.row_number().over(Window.partitionBy(*file_keys, *SAME).orderBy(*order))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n")


def reconcile(df: DataFrame, file_keys: tuple = FILE, segment: int | None = None) -> DataFrame:
    """``reconciled``: whether the balance moved, from the row right before, by credit less debit."""
    rows = _with_before(df, file_keys, "seq", segment, ("balance",)) if segment else df
    gap = F.abs((F.col("balance") - F.col("__b")) - (F.coalesce("credit", F.lit(0.0)) - F.coalesce("debit", F.lit(0.0))))
    rows = rows.withColumns({"__b": _lag("balance", file_keys, "seq", segment), "__i": _place(file_keys, "seq", segment)})
    good = F.when(F.col("__i") == 1, F.col("balance").isNotNull()).otherwise(F.coalesce(gap <= fixed.TOLERANCE, F.lit(True)))
    return _clean(rows.withColumns({"reconciled": good, "row_no": F.col("__i") - 1}).drop("__b", "__i"))


def parse_report(df: DataFrame, file_keys: tuple = FILE) -> DataFrame:
    """One row for each file of a reconciled table."""
    out = df.groupBy(*file_keys).agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if("reconciled").alias("good"), F.count("balance").alias("balances"),
        F.sort_array(F.collect_list(F.when(~F.col("reconciled"), F.col("row_no")))).alias("bad"),
    )
    out = out.withColumn("has_balance", F.col("balances") >= 2)
    out = out.withColumn("rows_reconciled", F.when(F.col("has_balance"), F.col("good")).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("unreconciled_rows", F.when(F.col("has_balance"), F.col("bad")).otherwise(F.array().cast("array<int>")))
    all_good = F.col("has_balance") & (F.size("unreconciled_rows") == 0)
    rate = F.when(F.col("has_balance"), F.round(F.col("rows_reconciled") / F.col("rows_total"), 6)).otherwise(0.0)
    proved = F.format_string("Reconciled %d/%d rows", "rows_reconciled", "rows_total")
    text = F.when(~F.col("has_balance"), F.format_string("%d rows parsed (no balance column — cannot verify)", "rows_total")).when(all_good, proved)
    text = text.otherwise(F.concat(proved, F.format_string(" — %d row(s) do not add up", F.size("unreconciled_rows"))))
    return out.select(*file_keys, "rows_total", "rows_reconciled", "unreconciled_rows", "has_balance", all_good.alias("reconciled"), rate.alias("reconciliation_rate"), text.alias("summary"))


def trust_summary(reports: DataFrame, keys: tuple = ()) -> DataFrame:
    return reports.groupBy(*keys).agg(
        F.coalesce(F.sum("rows_total"), F.lit(0)).alias("rows_total"), F.coalesce(F.sum("rows_reconciled"), F.lit(0)).alias("rows_reconciled"),
        F.coalesce(F.bool_and("reconciled"), F.lit(False)).alias("all_reconciled"), F.coalesce(F.bool_or("has_balance"), F.lit(False)).alias("any_balance"), F.count_if(~F.col("reconciled")).alias("problem_files"),
    )


def pick_best_parse(reports: DataFrame, file_keys: tuple = FILE, least: int = 2) -> DataFrame:
    """The report of each file's best strategy (``strategy_no``): rate, then rows, then the earlier; ``least`` rows at least."""
    order = Window.partitionBy(*file_keys).orderBy(F.desc("reconciliation_rate"), F.desc("rows_total"), "strategy_no")
    return reports.where(F.col("rows_total") >= least).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def direction_from_balance(df: DataFrame, file_keys: tuple = FILE, segment: int | None = None) -> DataFrame:
    """Debit and credit of ``ambiguous`` rows from the move since the last known balance."""
    rows = _with_before(df, file_keys, "seq", segment, ("balance",)) if segment else df
    known = F.last("balance", True).over(Window.partitionBy(*file_keys, *(("__seg",) if segment else ())).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"__p": F.coalesce(known, "__known_balance") if segment else known, "__a": F.coalesce("debit", F.lit(0.0)) + F.coalesce("credit", F.lit(0.0))})
    delta = F.col("balance") - F.col("__p")
    known = F.col("ambiguous") & delta.isNotNull()
    out = (F.abs(delta + F.col("__a")) <= fixed.TOLERANCE) | ((F.abs(delta - F.col("__a")) > fixed.TOLERANCE) & (delta < 0))
    debit = F.when(known, F.when(out, F.col("__a")).otherwise(0.0)).otherwise(F.col("debit"))
    credit = F.when(known, F.when(out, 0.0).otherwise(F.col("__a"))).otherwise(F.col("credit"))
    return _clean(rows.withColumns({"__d": debit, "__c": credit}).withColumns({"debit": F.col("__d"), "credit": F.col("__c")}).drop("__p", "__a", "__d", "__c"))


def combine(df: DataFrame, keys: tuple = (), order: tuple = ("source_file", "seq")) -> DataFrame:
    """All files as one ledger: of rows equal in all but the file, the first stays."""
    first = F.row_number().over(Window.partitionBy(*keys, *SAME).orderBy(*order))
    return df.withColumn("__n", first).where("__n = 1").drop("__n")
