"""Key-value stores (overrides, learned answers, own categories), their edit log, and exports.

A store is a set of documents, one JSON object for each person or account, in any number of files, which tasks read and write side
by side; entries are told by their type. What changes a store is appended to a log and never rewritten: a store at a version is the
last edit of each key (:func:`store_at`). Nothing overwrites what is being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.tables import small_table
from ..operators import insights, review


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _documents(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, doc) of each document as a variant: a whole file without ``keys``, else each line. What is no JSON is null, a missing path no document."""
    if not _exists(spark, path):
        return small_empty(spark, keys)
    doc = F.try_parse_json(F.col("value"))
    rows = spark.read.text(path, wholetext=not keys)
    return rows.select(*[F.try_variant_get(doc, f"$.{k}", "bigint").alias(k) for k in keys], (F.try_variant_get(doc, "$.entries", "variant") if keys else doc).alias("doc"))


def small_empty(spark: SparkSession, keys: tuple[str, ...]) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast("long").alias(k) for k in keys], F.try_parse_json(F.lit("{}")).alias("doc"))


def _entries(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, entry, value) of all entries of objects."""
    each = docs.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("doc").outer())).where("key IS NOT NULL")
    return each.select(*keys, F.col("key").alias("entry"), "value")


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def write_store(rows: DataFrame, path: str, key: str | None = "merchant_key", keys: tuple[str, ...] = ()) -> None:
    """The store as documents at a new ``path``: of each key its other columns, or its one other column as it is; without a key
    the one column as a list ``categories``.

    With ``keys`` each account is a document of its own on a line, ``{"account_id": 1, "entries": {...}}``, and files are as many as
    tasks. Without, the whole is one person's document in one file, the shape that people edit by hand.
    """
    values = [c for c in rows.columns if c != key and c not in keys]
    value = F.col(values[0]) if len(values) == 1 else F.struct(*values)
    if key is None:
        whole = F.struct(F.sort_array(F.collect_list(value)).alias("categories"))
    else:
        whole = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), value.alias("v")))))
    if not keys:
        return rows.agg(F.to_json(whole).alias("value")).write.text(path)
    rows.groupBy(*keys).agg(whole.alias("entries")).select(F.to_json(F.struct(*keys, "entries")).alias("value")).write.text(path)


def read_overrides(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, merchant_key, category); entries that are no strings are dropped, whatever a string says."""
    rows = _entries(_documents(spark, path, keys), keys).where(_is(F.col("value"), "STRING"))
    return rows.select(*keys, F.col("entry").alias("merchant_key"), F.try_variant_get("value", "$", "string").alias("category"))


def read_cache(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, merchant_key, category, display, confidence, model); entries that are no objects are dropped."""
    rows = _entries(_documents(spark, path, keys), keys).where(_is(F.col("value"), "OBJECT"))
    kinds = {"category": "string", "display": "string", "confidence": "double", "model": "string"}
    return rows.select(*keys, F.col("entry").alias("merchant_key"), *[F.try_variant_get("value", f"$.{c}", kind).alias(c) for c, kind in kinds.items()])


def read_custom_categories(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, name) of the lists ``categories``; what is no string is dropped."""
    docs = _documents(spark, path, keys).select(*keys, F.try_variant_get("doc", "$.categories", "variant").alias("doc"))
    each = docs.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer())).where(_is(F.col("value"), "STRING"))
    return each.select(*keys, F.try_variant_get("value", "$", "string").alias("name"))


def append_edits(edits: DataFrame, path: str, version: int) -> None:
    """Edits (keys, merchant_key, op, seq and values) as one more version of a log. ``op``: set, delete, or clear, which empties an account's store."""
    edits.write.parquet(f"{path}/version={version}")


def read_edits(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The log, up to ``version``: later versions' files are not read. Versions may lack columns, as clearings do."""
    log = spark.read.option("mergeSchema", True).parquet(path)
    return log if version is None else log.where(F.col("version") <= version)


def store_at(log: DataFrame, keys: tuple[str, ...] = (), key: str = "merchant_key", order: tuple[str, ...] = ("version", "seq")) -> DataFrame:
    """The store that a log makes: of each key the last edit after the account's last clearing, unless it deletes.

    Two aggregates with partial aggregation; where the clearings of accounts are few they are sent to all by their size.
    """
    values = [c for c in log.columns if c not in (*keys, key, "op", *order)]
    at = F.struct(*order).alias("__at")
    last = log.where("op <> 'clear'").withColumn("__at", at).groupBy(*keys, key).agg(F.max_by(F.struct("op", *values, "__at"), "__at").alias("e"))
    one = [F.lit(1).alias("__one")]
    cleared = log.where("op = 'clear'").groupBy(*[F.col(k).alias(f"__{k}") for k in keys], *one).agg(F.max(F.struct(*order)).alias("__cleared"))
    same = F.lit(1) == F.col("__one")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    kept = last.join(cleared, same, "left").where("e.op = 'set' AND (__cleared IS NULL OR e.__at > __cleared)")
    return kept.select(*keys, key, *[F.col(f"e.{c}").alias(c) for c in values])


def clear(accounts: DataFrame, keys: tuple[str, ...] = (), seq: int = 0) -> DataFrame:
    """Edits that empty the stores of ``accounts`` (one row each), to be appended to a log."""
    return accounts.select(*keys, F.lit(None).cast("string").alias("merchant_key"), F.lit("clear").alias("op"), F.lit(seq).cast("long").alias("seq"))


def all_categories(custom: DataFrame) -> DataFrame:
    """(position, name): the built-in ones, then own ones by name, Uncategorised last."""
    spark = custom.sparkSession
    fixed_ = small_table(spark, [(k, c, "") for k, c in enumerate(fixed.CATEGORIES[:-1])] + [(10_000, fixed.UNCATEGORISED, "")], "o int, name string, t string")
    own = custom.select("name").distinct().join(fixed_.select("name"), "name", "left_anti").select(F.lit(5_000).alias("o"), "name", F.col("name").alias("t"))
    return fixed_.unionByName(own)


def add_category(custom: DataFrame, name: str) -> DataFrame:
    """Own categories with one more, unless it is blank or there already, whatever the case."""
    name = name.strip()
    new = small_table(custom.sparkSession, [(name,)], "name string").where(F.col("name") != "")
    known = custom.select(F.lower("name").alias("l"))
    taken = name.lower() in {c.lower() for c in fixed.CATEGORIES}
    new = new.where(F.lit(not taken)).withColumn("l", F.lower("name")).join(known, "l", "left_anti").select("name")
    return custom.select("name").unionByName(new)


def export_columns(df: DataFrame, decided_by: str = "decided_by") -> DataFrame:
    """The columns of an export, in order."""
    rows = review.with_amount_direction(df)
    return rows.select("date", "description", "merchant", "category", "channel", "direction", "debit", "credit", "balance", F.col(decided_by).alias("category_source"), "confidence", "source_file")


def export_transactions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = export_columns(df).write
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def export_report_tables(df: DataFrame, path: str, keys: tuple = ()) -> list[str]:
    """Transactions, category, month and recurring tables under one directory; the last only where it has rows."""
    tables = {"transactions": export_columns(df), "by_category": insights.by_category(df, keys=keys), "by_month": insights.monthly_totals(df, keys=keys), "recurring": insights.detect_recurring(df, keys=keys)}
    written = []
    for name, table in tables.items():
        if name == "recurring" and table.isEmpty():
            continue
        table.write.parquet(f"{path}/{name}")
        written.append(name)
    return written
