"""Small helpers that all operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the data contracts define it: space, and tab to carriage return.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where that is unset do we choose one: a temp folder in local mode, where one machine is the whole
    cluster, and otherwise a folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        found = "file://" + tempfile.mkdtemp(prefix="statementspark-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, tag: str, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors.

    ``instead_of``: earlier results of this function that nothing needs once this one is written, as the state of a loop; their
    files are deleted then. All others stay until the cluster clears the folder, since results are read lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    for frame in instead_of:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.shared_path)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return out


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null or blank text: the empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))


def count_words(text: Column) -> Column:
    """Number of words as a long, without making them."""
    squeezed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.size(F.split(squeezed, WS))).cast("long")
