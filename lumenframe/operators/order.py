"""Places in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import checkpointed


def range_parts(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with _part: ranges of the order by number, equal keys in one; checkpointed, as the bounds are sampled."""
    return checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def positions(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with the place of each row in the order, from 1; a task sorts one range, and only the sizes of the ranges are summed in one."""
    parts = range_parts(df, *order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rows = parts.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
