"""References to records that do not exist."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: References that one probe task should take.
TASK_ROWS = 250_000
#: Quantiles of the keys that set the range bounds, found over all references.
QUANTILES = 1_000


def parent_states(parents: DataFrame, key: Column, created: Column, deleted: Column) -> DataFrame:
    """``key, live, since``: one row per key that any row has.

    ``live``: some row is not deleted; ``since``: the earliest creation of
    those, null if one of them has no creation time (it has always been there).
    Combined before the shuffle.
    """
    rows = parents.select(key.cast("long").alias("key"), created.cast("timestamp_ntz").alias("made"), deleted.isNotNull().alias("gone")).where("key is not null")
    grouped = rows.groupBy("key").agg(F.max(~F.col("gone")).alias("live"), F.min(F.when(~F.col("gone"), F.col("made"))).alias("since"), F.max(~F.col("gone") & F.col("made").isNull()).alias("always"))
    return grouped.select("key", "live", F.when(~F.col("always"), F.col("since")).alias("since"))


def _ranges(known: DataFrame, task_rows: int) -> tuple[list[int], list[int]]:
    """Upper bounds of the key ranges but for the last, and the tasks that each range needs.

    One pass over all references. A key that stands for several quantiles is
    hot: its range gets as many tasks as it has rows for.
    """
    told = known.agg(F.count("*").alias("n"), F.percentile_approx("key", [i / QUANTILES for i in range(1, QUANTILES)], 10 * QUANTILES).alias("q")).first()
    step = max(1, math.floor(task_rows * QUANTILES / max(told["n"], 1)))
    marks = [int(c) for c in told["q"] or []]
    bounds = sorted(set(marks[step - 1 :: step])) if told["n"] > task_rows else []
    rows = np.diff(np.concatenate([[0], np.searchsorted(marks, bounds, side="right"), [QUANTILES]])) * told["n"] / QUANTILES
    return bounds, [max(1, math.ceil(r / (2 * task_rows))) for r in rows]


def _place(bounds: list[int], key: Column) -> Column:
    """Number of bounds below ``key``, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    width = math.ceil(math.sqrt(len(bounds)))
    chunks = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    chunk = F.least(F.size(F.filter(array([c[-1] for c in chunks]), lambda b: b < key)), F.lit(len(chunks) - 1))
    inner = F.element_at(F.array(*[array(c) for c in chunks]), chunk + 1)
    return chunk * width + F.size(F.filter(inner, lambda b: b < key))


def orphan_references(refs: DataFrame, parents: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows of ``refs`` whose key has no valid parent, with ``reason``.

    ``refs``: ``domain, key (long), made (timestamp_ntz)`` and any other
    columns but ``_range`` and ``_salt``; ``parents``: ``domain, key, live,
    since``. A reason is ``missing`` (no such key), ``deleted`` (no live row)
    or ``late`` (the earliest live row is newer than the reference).

    Keys are range-partitioned by quantiles over all references. A range's parents become
    sorted arrays, probed by binary search for whole batches of references.
    A range with many references is salted: its references spread over several
    tasks, each with that range's parents, so one key with a third of all
    references is no bottleneck. Misses are the only rows that leave a task.

    Null keys are left out; a reference without a time is never late; repeated
    rows give repeated results; empty tables are fine.
    """
    known = refs.where(F.col("key").isNotNull())
    bounds, load = _ranges(known, task_rows)

    def range_of(df: DataFrame) -> DataFrame:
        return df.withColumn("_range", _place(bounds, F.col("key")))

    asked, held = range_of(known), range_of(parents.where("key is not null"))
    salts = F.array(*[F.lit(n) for n in load])
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64(*known.columns), F.element_at(salts, F.col("_range") + 1).cast("long")).cast("int"))
    held = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.element_at(salts, F.col("_range") + 1) - 1)))
    keep = known.columns

    def probe(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        reason = np.full(len(left), None, dtype=object)
        for domain, part in left.groupby("domain").indices.items():
            own = right[right["domain"] == domain].sort_values("key")
            key = left["key"].to_numpy()[part]
            have = own["key"].to_numpy()
            if not len(have):
                reason[part] = "missing"
                continue
            at = np.minimum(np.searchsorted(have, key), len(have) - 1)
            missing = have[at] != key
            live = own["live"].to_numpy().astype(bool)[at]
            late = (own["since"].to_numpy()[at] > left["made"].to_numpy()[part]) & live
            reason[part] = np.where(missing, "missing", np.where(~live, "deleted", np.where(late, "late", None)))
        return left.assign(reason=reason)[reason != None][[*keep, "reason"]]  # noqa: E711

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields) + ", reason string"
    tasks = sum(load)
    return asked.repartition(max(2, tasks), "_range", "_salt").groupBy("_range", "_salt").cogroup(held.select("domain", "key", "live", "since", "_range", "_salt").repartition(max(2, tasks), "_range", "_salt").groupBy("_range", "_salt")).applyInPandas(probe, schema)


def whole(c: Column) -> Column:
    """The whole number written in ``c`` (outer blanks apart), null if it is none or beyond 64 bits."""
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("long"))


def catalogue_references(embeddings: DataFrame, recommendations: DataFrame) -> DataFrame:
    """``domain, key, made, ref_table, ref_id``: what the two tables refer to.

    Both pieces of a duplicate_scenes target, otherwise the piece before the
    first ``|``; outer blanks do not count and pieces that are no whole numbers
    are passed over. A target of type ``performer`` refers to a performer.
    """
    faces = embeddings.select(F.lit("scene").alias("domain"), F.col("stash_scene_id").cast("long").alias("key"), F.col("created_at").cast("timestamp_ntz").alias("made"), F.lit("scene_face_embeddings").alias("ref_table"), F.col("id").cast("long").alias("ref_id"))
    pieces = F.when(F.col("type") == "duplicate_scenes", F.split("target_id", ":")).otherwise(F.slice(F.split("target_id", r"\|"), 1, 1))
    told = recommendations.select(F.when(F.col("type") == "upstream_performer_changes", F.lit("performer")).otherwise(F.lit("scene")).alias("domain"), F.explode(pieces).alias("piece"), F.col("created_at").cast("timestamp_ntz").alias("made"), F.col("id").cast("long").alias("ref_id"))
    told = told.withColumn("key", whole(F.col("piece"))).where("key is not null").select("domain", "key", "made", F.lit("recommendations").alias("ref_table"), "ref_id")
    return faces.unionByName(told)


def catalogue_parents(scene: DataFrame, performers: DataFrame) -> DataFrame:
    scenes = parent_states(scene, whole(F.col("scene_id")), F.col("created_at"), F.col("deleted_at"))
    people = parent_states(performers, F.col("id"), F.col("created_at"), F.col("deleted_at"))
    return scenes.withColumn("domain", F.lit("scene")).unionByName(people.withColumn("domain", F.lit("performer")))


def catalogue_orphans(embeddings: DataFrame, recommendations: DataFrame, scene: DataFrame, performers: DataFrame, **sizes) -> DataFrame:
    """``ref_table, ref_id, ref_key, reason, period`` of every unresolved reference, once."""
    lost = orphan_references(catalogue_references(embeddings, recommendations), catalogue_parents(scene, performers), **sizes)
    return lost.select("ref_table", "ref_id", F.col("key").cast("string").alias("ref_key"), "reason", F.date_format("made", "yyyy-MM").alias("period")).distinct()


def orphan_report(lost: DataFrame) -> DataFrame:
    """Orphans, distinct lost keys per table, month and reason."""
    return lost.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("orphans"), F.countDistinct("ref_key").alias("lost_keys"))
