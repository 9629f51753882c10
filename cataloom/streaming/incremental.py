"""Incremental batches: high-water marks per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarks(df: DataFrame, key: str, at: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(at).alias("watermark"))


def changed_since(df: DataFrame, marks: DataFrame, key: str, at: str) -> DataFrame:
    """Rows newer than their key's mark; every row of a key without one."""
    return df.join(marks, key, "left").where(F.col("watermark").isNull() | (F.col(at) > F.col("watermark"))).drop("watermark")


def merge_watermarks(old: DataFrame, new: DataFrame, key: str, clean: bool = True) -> DataFrame:
    """New marks over old ones; a null never replaces a mark, and after an unclean run the old ones stay."""
    if not clean:
        return old
    return old.unionByName(new).groupBy(key).agg(F.max("watermark").alias("watermark"))


def same_logic(state_version: int | None, version: int) -> bool:
    """Whether kept state may be used; a changed or unknown version asks for a full run."""
    return state_version is not None and state_version == version
