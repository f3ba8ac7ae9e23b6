"""Tables in the shared folder that cut lineage, and orderings that never put a whole table into one task."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to so many rows of node tables are broadcast; beyond that the join shuffles.
SENT_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all machines see. Where none is set, one in /tmp on a local master, as
    in tests; on a cluster that is an error, as executors would write to disks of their own."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not made.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir should name a folder that all machines share")
        path = made.get() if made.isDefined() else "file:///tmp/checkpoints/copse-core"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what is lost with an executor is read again, not computed again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/copse-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the table of a stored() frame that nothing needs any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        if "/copse-" in file:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file[: file.index("/", file.index("/copse-") + 1)])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has no more than SENT_ROWS rows."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of value over the rows of the same keys up to this one in order.

    Rows are dealt by ranges of keys and order, summed up in each range, and ranges are added up from their totals, of
    which there is one for each range and key. Rows that tie in keys and order should have been grouped before.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.withColumn("_v", value).repartitionByRange(tasks, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range", *keys).agg(F.sum("_v").alias("_t"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(upto), F.lit(0))).drop("_t")
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumn("_inside", F.sum("_v").over(inside)).join(before, ["_range", *keys])
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_v", "_inside", "_before")


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Adds dense numbers from 0 in the given order, which should be of a unique key. Rows are shuffled and sorted once."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # the number of the range, and below 33 bits the place in it
    dealt = stored(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_place", place), "ranges")
    sizes = {r.part: r["count"] for r in dealt.groupBy(F.shiftright("_place", 33).cast("int").alias("part")).count().collect()}
    starts = [sum(n for k, n in sizes.items() if k < part) for part in range(max(sizes, default=0) + 1)]
    start = F.get(F.array(*(F.lit(n).cast("long") for n in starts)), F.shiftright("_place", 33).cast("int"))
    return dealt.withColumn(name, start + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place")
