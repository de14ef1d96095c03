"""Small tables that the program itself holds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` as a table of one literal, whose size the planner knows: no job reads them, and joins send them to all by that size."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    kind = "array<struct<" + ",".join(":".join(c.strip().split(" ")) for c in schema.split(",")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))
