"""Places of rows in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.session import cut_lineage, default_parallelism


def with_place(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place (LONG, from 0) of each row in the order of ``order``; rows that tie there get places in any order.

    Rows are sorted into ranges, written once, and numbered inside each range; the number of rows before a range comes from one count
    per range.
    """
    parts = default_parallelism(df.sparkSession)
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row per range
    before: Column = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    local = Window.partitionBy("__part").orderBy(*order)
    numbered = ranged.withColumn("__local", F.row_number().over(local) - 1).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(name, (F.col("__local") + F.col("__before")).cast("long")).drop("__part", "__local", "__before")


def dense_index(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """The distinct non-null values of ``column`` with their place in sorted order, from 0."""
    return with_place(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], name)
