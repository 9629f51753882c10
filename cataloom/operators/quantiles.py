"""Quantiles by the exclusive method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.operators.ordered import with_positions


def exclusive_quantile(df: DataFrame, column: str, share: float, least: int = 1) -> DataFrame:
    """``n, q``: the value at position ``(n + 1) * share``, interpolated; null below ``least`` values."""
    placed = with_positions(df.where(F.col(column).isNotNull()).select(F.col(column).alias("x")), "x")
    size = df.agg(F.count(column).alias("n"))
    p = (F.col("n") + 1) * F.lit(share)
    near = placed.join(F.broadcast(size)).where((F.col("position") == F.floor(p)) | (F.col("position") == F.floor(p) + 1))  # size: one row
    ends = near.groupBy("n").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    got = size.join(ends, "n", "left")
    return got.select("n", F.when(F.col("n") >= least, F.col("a") + (p - F.floor(p)) * (F.col("b") - F.col("a"))).alias("q"))
