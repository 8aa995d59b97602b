"""Positions in a total order without a task that orders everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.session import settle


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``weight`` over the earlier rows of its ``keys`` under ``order``, which must be total.

    Rows are range-partitioned by keys and order, summed within their partition, and shifted by the sums of the same
    keys in earlier partitions; that table has one row per key and partition. So a key with most rows, or no key at all,
    is ordered by many tasks.
    """
    cols = [F.col(k) for k in keys]
    ranged = df.withColumn("__w", weight).repartitionByRange(*cols, *order).sortWithinPartitions(*cols, *order)
    frozen = settle(ranged.withColumn("__pid", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "ranged")
    earlier = Window.partitionBy("__pid", *keys).orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = frozen.groupBy("__pid", *keys).agg(F.sum("__w").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("__off", before).select("__pid", *[F.col(k).alias(f"__k_{k}") for k in keys], "__off")
    summed = frozen.withColumn("__sum", F.coalesce(F.sum("__w").over(earlier), F.lit(0)))
    same = summed["__pid"] == offsets["__pid"]
    for k in keys:
        same = same & summed[k].eqNullSafe(offsets[f"__k_{k}"])
    return summed.join(offsets, same).select(*[summed[c] for c in df.columns], (F.col("__sum") + F.col("__off")).alias(out))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "pos") -> DataFrame:
    """``df`` with the place of each row within its ``keys`` under ``order`` (from 1), which must be total; made by many tasks."""
    return running(df, keys, order, F.lit(1).cast("long"), "__before").select(*df.columns, (F.col("__before") + 1).cast("long").alias(out))
