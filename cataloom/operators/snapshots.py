"""What changed between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain_text(c: Column) -> Column:
    """Text without case and outer blanks; null for nothing."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def plain_list(c: Column) -> Column:
    """Sorted set of plain texts without a final slash; an empty list for null."""
    bare = F.transform(c, lambda u: F.regexp_replace(F.lower(F.trim(u)), r"[/\s]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(bare, F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != ""))))


def latest_delivery(df: DataFrame, keys: list[str], loaded: str, rest: list[str]) -> DataFrame:
    """One row per key: the latest delivered, ties going to the greatest values.

    A grouped maximum of a struct, so repeats combine before the shuffle.
    """
    order = F.struct(F.col(loaded).alias("_at"), *[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.max(order).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def validity_intervals(rows: DataFrame, key: str, snapshot: str, row_hash: str) -> DataFrame:
    """``key, row_hash, first, last``: runs of consecutive snapshots with one hash.

    Gaps and islands: within a key and hash, snapshot number minus row number is
    constant over a run. A key has at most one row per snapshot, so no window
    holds more rows than there are snapshots.
    """
    order = Window.partitionBy(key).orderBy(snapshot)
    before = F.lag(F.struct(snapshot, row_hash)).over(order)
    fresh = before.isNull() | (before[snapshot] != F.col(snapshot) - 1) | ~before[row_hash].eqNullSafe(F.col(row_hash))
    island = F.sum(fresh.cast("int")).over(order)
    return rows.select(key, snapshot, row_hash, island.alias("_island")).groupBy(key, "_island").agg(F.first(row_hash).alias(row_hash), F.min(snapshot).alias("first"), F.max(snapshot).alias("last")).drop("_island")


def snapshot_changes(df: DataFrame, key: str, snapshot: str, loaded: str, texts: list[str], lists: list[str]) -> DataFrame:
    """``snapshot, key, change_kind``: added, removed or changed against the snapshot before.

    Interval starts, ends and adjacencies become the events: an interval that
    starts where none ended just before is ``added``, one that follows directly
    on another of the same key is ``changed``, one that ends with none
    following is ``removed`` in the next snapshot. Snapshots are numbered
    consecutively; the first and last numbers bound the events.

    Letter case, outer blanks, a final slash, order and repetition in lists do
    not count and null equals empty. Of a key delivered more than once in a
    snapshot the latest ``loaded`` counts (null is earliest; ties go to the
    greatest plain values). Null keys or snapshots are left out; an empty table
    gives an empty result; other columns are ignored.
    """
    plain = [plain_text(F.col(c)).alias(c) for c in texts] + [plain_list(F.col(c)).alias(c) for c in lists]
    rows = df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(F.col(key).alias("_key"), F.col(snapshot).cast("int").alias("_no"), F.col(loaded).alias("_loaded"), F.sha2(F.to_json(F.struct(*plain)), 256).alias("_hash"))
    rows = latest_delivery(rows, ["_key", "_no"], "_loaded", ["_hash"])
    held = validity_intervals(rows, "_key", "_no", "_hash")
    bounds = df.agg(F.min(F.col(snapshot).cast("int")).alias("_low"), F.max(F.col(snapshot).cast("int")).alias("_high"))
    order = Window.partitionBy("_key").orderBy("first")
    meets = F.lag("last").over(order).eqNullSafe(F.col("first") - 1)
    followed = F.lead("first").over(order).eqNullSafe(F.col("last") + 1)
    ends = held.select("_key", "first", "last", meets.alias("_meets"), followed.alias("_followed")).join(F.broadcast(bounds))  # bounds: one row
    starts = F.when(F.col("first") > F.col("_low"), F.struct(F.col("first").alias("no"), F.when(F.col("_meets"), F.lit("changed")).otherwise(F.lit("added")).alias("kind")))
    stops = F.when((F.col("last") < F.col("_high")) & ~F.col("_followed"), F.struct((F.col("last") + 1).alias("no"), F.lit("removed").alias("kind")))
    events = ends.select("_key", F.explode(F.array_compact(F.array(starts, stops))).alias("e"))
    return events.select(F.col("e.no").alias(snapshot), F.col("_key").alias(key), F.col("e.kind").alias("change_kind"))
