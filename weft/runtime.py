"""Iteration and checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Bytes that Spark takes for a table of which it knows nothing.
UNKNOWN = 2**63 - 1


def settle(df: DataFrame) -> DataFrame:
    """Cut df's lineage with a checkpoint in the folder that the cluster shares, or in the warehouse where none is set.

    A checkpoint keeps the size that was estimated for its plan, and a join's is the product of its sides'. Where
    rounds join what they have made with itself, its digits would double again and again until they fill the driver,
    so a size above UNKNOWN is forgotten.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", "") and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    held = df.checkpoint()
    rows = held._jdf.queryExecution().analyzed()
    if rows.stats().sizeInBytes() <= UNKNOWN:
        return held
    jvm, session = spark._jvm, spark._jsparkSession
    none = jvm.scala.Option.empty()
    rows = jvm.org.apache.spark.sql.execution.LogicalRDD(rows.output(), rows.rdd(), rows.outputPartitioning(), rows.outputOrdering(), False, none, session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, rows), spark)


def kept(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys once and held in memory or on the executors' disks, so that joins and sums by these keys move only what they are joined with. What an executor loses is made again from df, which should be a table or a checkpoint."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.repartition(n, *keys).persist()
    held.count()  # how it is dealt is known once it is there
    return held


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own, wherever the cluster keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def iterate(start: DataFrame, step: Callable[[DataFrame], DataFrame], times: int, every: int = 5) -> DataFrame:
    """step applied `times` times; every few rounds the plan is cut."""
    now = start
    for i in range(1, times + 1):
        now = step(now)
        if i % every == 0 and i < times:
            now = settle(now)
    return now


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path where the cluster shares one: that of checkpoints, or the warehouse."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def running_sum(df: DataFrame, chunk: str, order: list, values: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """df with the sum of each value over all rows of its keys up to this one, in the order of chunk and order.

    Chunks are summed first, so that only their totals, not all rows, meet in one task.
    """
    keys = keys or []
    total = df.groupBy(*keys, chunk).agg(*(F.sum(v).alias(f"_{out}") for out, v in values.items()))
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    total = total.select(*keys, chunk, *(F.coalesce(F.sum(f"_{out}").over(before), F.lit(0)).alias(f"_{out}") for out in values))
    within = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.withColumns({out: F.sum(v).over(within) for out, v in values.items()}).join(total, [*keys, chunk])
    return out.withColumns({o: F.col(o) + F.col(f"_{o}") for o in values}).drop(*(f"_{o}" for o in values))


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with the place, from 0, of each row in the order of all rows: ranges of the order are counted, and numbered each by itself. order must tell rows apart for the places to be the same again."""
    n = min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # the driver gets a sample of each range
    dealt = settle(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each of n ranges
    before = before.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn(out, place).join(F.broadcast(before), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")
