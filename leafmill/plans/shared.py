"""Tables written to the shared folder of the cluster, which cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    One of this machine stands in only where all executors run in the driver's
    own process; on a cluster that names none this is an error, as each
    executor would write to its own disk.
    """
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if not named.isDefined():
        to = sc.getConf().get("spark.checkpoint.dir")
        if not to and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(to or tempfile.mkdtemp(prefix="leafmill-"))
        named = sc._jsc.sc().getCheckpointDir()
    return named.get()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder; it goes when the session ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table of ``written`` before the session ends; nothing may read ``df`` afterwards."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ranked(df: DataFrame, group: list[str], order: list, name: str, weight: Column | None = None) -> DataFrame:
    """``df`` with the rank from 0 of each row within its group, by ``order`` (nulls first); with ``weight``, the sum of the weights before the row instead.

    Rows are range-partitioned by group and order and written once; a rank is
    the place in a partition plus the sizes of the partitions before it, so a
    group of any size is spread over tasks.  Null is a group.
    """
    keys = [F.col(c).asc_nulls_first() if isinstance(c, str) else c.asc_nulls_first() for c in [*group, *order]]
    placed = df.withColumn("_w", F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    labels = [f"_g{i}" for i in range(len(group))]
    runs = placed.groupBy(*(F.col(g).alias(x) for g, x in zip(group, labels)), F.col("_part").alias("_p")).agg(F.sum("_w").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*(labels or [F.lit(1)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition that holds the group
    base = runs.select(*labels, "_p", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    on = reduce(and_, [F.col(g).eqNullSafe(F.col(x)) for g, x in zip(group, labels)], F.col("_part") == F.col("_p"))
    within = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_at") - F.col("_first") if weight is None else F.coalesce(F.sum("_w").over(within), F.lit(0))
    return placed.join(base, on).select(*df.columns, (F.col("_before") + place).alias(name))
