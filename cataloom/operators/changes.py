"""Applying a feed of inserts, updates and deletes to a stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ways in which feeds write a deletion (fixed values; compared in lower case without outer blanks).
DELETES = ("delete", "deleted", "d", "del", "remove", "removed")
#: Ways in which feeds write an insert or update.
UPSERTS = ("insert", "inserted", "i", "ins", "add", "added", "create", "created", "new", "update", "updated", "u", "upd", "upsert", "upserted", "modify", "modified", "change", "changed", "replace", "replaced", "merge")


def is_delete(op: Column) -> Column:
    return F.lower(F.trim(op)).isin(*DELETES)


def is_upsert(op: Column) -> Column:
    return F.lower(F.trim(op)).isin(*UPSERTS)


def unreadable_changes(feed: DataFrame, op: str) -> DataFrame:
    """The rows of a feed whose operation is null or written in no known way; ``apply_changes`` passes over them."""
    return feed.where(~F.coalesce(is_delete(F.col(op)) | is_upsert(F.col(op)), F.lit(False)))


def apply_changes(base: DataFrame, feed: DataFrame, key: str, seq: str, base_seq: str, op: str, values: list[str]) -> DataFrame:
    """``key`` and ``values`` of every record alive after the feed.

    Each change is taken once; per key the highest log sequence among the
    stored row's ``base_seq`` and the feed's ``seq`` decides, found by window
    ranking (Catalyst limits each partition to its best row per key before the
    shuffle, so a key with a third of all changes moves a few rows; repeats of
    a change, whatever their number, fall away in the same ranking). A key
    whose deciding change is a delete is dropped; an insert or update carries
    the whole row, whether or not the key was known. An operation that is null
    or unknown changes nothing; ``unreadable_changes`` reports such rows.

    A null sequence is older than any other; on equal sequences the feed
    prevails over the stored row, then an upsert over a delete, then the
    greatest values. Null keys are left out. Arrival order and clocks play no
    part. An empty feed returns the stored state, an empty state the feed's;
    further columns are ignored.
    """
    stored = base.select(F.col(key).alias("_key"), F.col(base_seq).cast("long").alias("_seq"), F.lit(0).alias("_feed"), F.lit(1).alias("_live"), *[F.col(c).alias(f"_v_{c}") for c in values])
    read = feed.where(is_delete(F.col(op)) | is_upsert(F.col(op)))
    changes = read.select(F.col(key).alias("_key"), F.col(seq).cast("long").alias("_seq"), F.lit(1).alias("_feed"), F.when(is_delete(F.col(op)), 0).otherwise(1).alias("_live"), *[F.col(c).alias(f"_v_{c}") for c in values])
    every = stored.unionByName(changes).where("_key is not null")
    order = Window.partitionBy("_key").orderBy(F.col("_seq").desc_nulls_last(), F.col("_feed").desc(), F.col("_live").desc(), *[F.col(f"_v_{c}").desc_nulls_last() for c in values])
    last = every.withColumn("_rank", F.row_number().over(order)).where("_rank = 1 and _live = 1")
    return last.select(F.col("_key").alias(key), *[F.col(f"_v_{c}").alias(c) for c in values])
