"""Keyed state as tables: every write is a new table made of joins and grouped maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.workspace import materialise


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the new rows whose key it lacks, one per key; keys match null-safely."""
    on = [target[k].eqNullSafe(new[k]) for k in keys]
    fresh = new.join(target.select(*keys).distinct(), on, "left_anti").dropDuplicates(keys)
    return target.unionByName(fresh, allowMissingColumns=True)


def upsert(target: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """New rows over old ones; columns in ``keep`` take the old value where the new one is null."""
    rest = [c for c in target.columns if c not in keys]
    n = new.select(*keys, F.struct(*rest).alias("_new"))
    o = target.select(*keys, F.struct(*rest).alias("_old"))
    both = o.join(n, keys, "full")
    value = lambda c: F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).otherwise(F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")) if c in keep else F.col(f"_new.{c}"))
    return both.select(*keys, *[value(c).alias(c) for c in rest])


def push_forward(target: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The greater of old and new value per key."""
    return target.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.max(value).alias(value))


def replace_keys(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All old rows of the keys in ``new`` give way to its rows."""
    return target.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*target.columns))


def delete_keys(target: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return target.join(gone.select(key).distinct(), key, "left_anti")


def update_where(target: DataFrame, when: Column, **values: Column) -> DataFrame:
    return target.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def backup(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """A written copy of the table, and its number of rows."""
    kept = materialise(df, label)
    return kept, kept.count()


def positional(df: DataFrame, index: str, value: str) -> DataFrame:
    """``index, value`` for every place from 0 to the greatest index, null in the gaps."""
    top = df.agg(F.coalesce(F.max(index), F.lit(-1))).first()[0]
    places = df.sparkSession.range(int(top) + 1).withColumnRenamed("id", index)
    return places.join(df.select(F.col(index).cast("long").alias(index), value).dropDuplicates([index]), index, "left")


def relocate(tables: dict[str, tuple[DataFrame, str]], taken: DataFrame, top: int) -> dict[str, DataFrame]:
    """Rows whose key is in ``taken`` (``id``) move to ids above ``top``, in every table that refers to them."""
    numbered = taken.select("id").distinct().withColumn("moved", F.row_number().over(Window.orderBy("id")) + F.lit(top))  # collisions only
    out = {}
    for name, (df, key) in tables.items():
        m = numbered.withColumnRenamed("id", "_old")
        out[name] = df.join(F.broadcast(m) if numbered.limit(10_001).count() <= 10_000 else m, F.col(key) == F.col("_old"), "left").withColumn(key, F.coalesce("moved", key)).drop("_old", "moved")
    return out


def version_chain(steps: DataFrame, start: str, goal: str, most: int = 1000) -> list[str] | None:
    """Versions from ``start`` to ``goal`` along ``source -> version`` steps; none for a gap or a cycle.

    The step list of a release history is small; it is read up to ``most`` rows.
    """
    back = {r["version"]: r["source"] for r in steps.select("source", "version").orderBy("version").limit(most).collect()}
    chain, at = [], goal
    while at != start:
        if at not in back or at in chain:
            return None
        chain.append(at)
        at = back[at]
    return chain[::-1]


def group_labels(edges: DataFrame, most: int = 100) -> DataFrame:
    """``node, label``: smallest node of each linked group, by repeated minima with written rounds."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    for _ in range(most):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        step = labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = materialise(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "moved"), "labels")
        labels = step.select("node", "label")
        if not step.where("moved").limit(1).count():
            return labels
    raise RuntimeError("groups did not settle")


def closure_pairs(edges: DataFrame) -> DataFrame:
    """All pairs ``a < b`` inside linked groups (groups are few and small: dismissed duplicates)."""
    g = group_labels(edges)
    return g.withColumnRenamed("node", "a").join(g.withColumnRenamed("node", "b"), "label").where("a < b").select("a", "b")
