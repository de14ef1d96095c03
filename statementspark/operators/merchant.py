"""Narrations to merchants, once for each that differs in more than its reference numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import extract_merchant, without_references

COLUMNS = ("merchant", "merchant_key", "channel", "vpa")


def annotate(df: DataFrame, description: str = "description") -> DataFrame:
    """``df`` with merchant, merchant_key, channel and vpa.

    Nearly every narration holds a number of its own, but long numbers never name a merchant. So the regular expressions
    run on distinct narrations with their numbers masked (partial aggregation before the shuffle), and the result is joined back;
    the planner broadcasts it only while its measured size allows.
    """
    masked = without_references(F.col(description))
    names = df.select(masked.alias("__narration")).distinct()
    resolved = names.select("__narration", extract_merchant(F.col("__narration")).alias("__info"))
    joined = df.withColumn("__masked", masked).join(resolved, F.col("__masked").eqNullSafe(F.col("__narration")), "left")
    return joined.select(*[df[c] for c in df.columns if c not in COLUMNS], *[F.col("__info")[c].alias(c) for c in COLUMNS])
