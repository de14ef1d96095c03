"""Filters, sorts and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .categorize import AMOUNT

REASONS = ("all", "uncategorised", "low_confidence")


def suspect(floor: float = 0.7, reason: str = "all") -> Column:
    unknown = F.col("category") == fixed.UNCATEGORISED
    unsure = (F.col("confidence") < floor) & (F.col("category_source") != "override")
    return {"uncategorised": unknown, "low_confidence": unsure, "all": unknown | unsure}[reason]


def with_amount_direction(df: DataFrame) -> DataFrame:
    return df.withColumns({"amount": F.expr(AMOUNT), "direction": F.when(F.coalesce("debit", F.lit(0.0)) > 0, "Out").otherwise("In")})


def sort_transactions(df: DataFrame, by: str = "date", ascending: bool = True, order: tuple = ("account_id", "seq")) -> DataFrame:
    """Stable: ties stay in ledger order."""
    key = F.expr(AMOUNT) if by == "amount" else F.col(by)
    return df.orderBy(key.asc() if ascending else key.desc(), *order)


def needs_review(df: DataFrame, floor: float = 0.7, sort_by: str = "amount", ascending: bool = False, reason: str = "all", order: tuple = ("account_id", "seq")) -> DataFrame:
    return sort_transactions(df.where(suspect(floor, reason)), sort_by, ascending, order)


def review_elsewhere(df: DataFrame, start: str, end: str, floor: float = 0.7, keys: tuple = ()) -> DataFrame:
    """How many rows outside a period need review."""
    inside = F.to_date("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return df.groupBy(*keys).agg(F.count_if(suspect(floor) & ~inside).alias("elsewhere"))


def apply_filters(df: DataFrame, categories: list[str] | None = None, search: str | None = None, minimum: float | None = None) -> DataFrame:
    """``search`` is a regular expression on merchant or description, whatever the case."""
    if categories:
        df = df.where(F.col("category").isin(categories))
    if search:
        df = df.where(F.lower("merchant").rlike(search.lower()) | F.lower("description").rlike(search.lower()))
    return df if minimum is None else df.where(F.expr(AMOUNT) >= minimum)


def preview(df: DataFrame, n: int = 200, order: tuple = ("account_id", "seq")) -> DataFrame:
    """The first rows; the limit is the feature."""
    return df.orderBy(*order).limit(n)
