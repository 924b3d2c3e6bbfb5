"""Small pieces that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_RE = "[ \\t-\\r]+"
NO_ID = -(2**63)


#: Folders of local sessions that have no spark.checkpoint.dir, by application.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a local session may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="pairwright-")
    return _own_dirs[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write *df* as parquet in the shared folder and read it back.

    Later steps start from that table, so the plan stays short, what decided row ids or partition
    bounds is fixed, and a lost executor costs a read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pairwright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text, split at SPACE_RE; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns k1, k2 that tell rows apart by id and whole text.

    Rows that agree in both are one document that occurs again; they get the same key, on purpose. A null id
    takes the least long, so that keys join and sort before all others.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(body, F.length(body), F.col(text).isNull()).alias("k2")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sum(df: DataFrame, order: list, value: str, out: str, total: str | None = None) -> DataFrame:
    """Running sum of *value* in the global order of *order*, the row itself included.

    Range partitions are sorted and written once; only one sum per partition is added up in a single
    task (as many rows as partitions), and each partition's running sum starts from that offset.
    """
    spark = df.sparkSession
    from pyspark.sql import Window as W

    n = partitions(spark)
    held = cut(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    sums = held.groupBy("_pid").agg(F.sum(value).alias("_sum"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    run = W.partitionBy("_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # One row per partition: the bound of this broadcast is the number of partitions.
    return held.join(F.broadcast(sums), "_pid").withColumn(out, F.col("_base") + F.sum(value).over(run)).drop("_pid", "_base")
