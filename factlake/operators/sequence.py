"""Dense sequence numbers in a given order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept


def number(df: DataFrame, order: list[str], start: int = 1, name: str = "seq") -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in ascending order; ties in any order.

    Rows are range-partitioned by the order and written once; each partition numbers its own rows
    and adds the rows of the partitions before it, of which there is one count per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    joined = ranged.withColumn("_row", within).join(F.broadcast(offsets), "_part")  # a row per partition
    return joined.withColumn(name, (F.col("_before") + F.col("_row") + (start - 1)).cast("long")).drop("_part", "_row", "_before")


def running(df: DataFrame, order: str, amount: str, name: str = "upto") -> DataFrame:
    """``df`` with the sum of ``amount`` up to each row in ascending order, ties in any order; spread
    over partitions as in ``number``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(F.sum(amount).alias("_n"))
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.sum(amount).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.withColumn("_sum", within).join(F.broadcast(offsets), "_part")  # a row per partition
    return joined.withColumn(name, F.col("_before") + F.col("_sum")).drop("_part", "_sum", "_before")
