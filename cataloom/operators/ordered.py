"""Global order without a single task: range partitions, then offsets between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranged(df: DataFrame, column: str) -> DataFrame:
    return df.repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id())


def with_positions(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``position`` (from 1) in the order of ``column``.

    Rows are numbered inside range partitions and shifted by the sizes of the
    partitions before; only those sizes (one row each) meet in one place.
    """
    from cataloom.workspace import materialise

    ranged = materialise(_ranged(df, column), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    inside = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(column)))
    return inside.join(before, "_part").withColumn("position", F.col("_r") + F.col("_before")).drop("_part", "_r", "_before")


def gaps(df: DataFrame, column: str) -> DataFrame:
    """``gap, after``: distances above 1 between neighbouring values of a whole-number column."""
    from cataloom.workspace import materialise

    ranged = materialise(_ranged(df.select(column), column), "ranged")
    inner = ranged.withColumn("after", F.lag(column).over(Window.partitionBy("_part").orderBy(column)))
    ends = ranged.groupBy("_part").agg(F.min(column).alias("low"), F.max(column).alias("high"))
    seams = ends.select(F.col("low").alias(column), F.lag("high").over(Window.orderBy("_part")).alias("after"))
    every = inner.select(column, "after").unionByName(seams).where("after is not null")
    return every.select((F.col(column) - F.col("after")).alias("gap"), "after").where("gap > 1")
