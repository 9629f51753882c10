"""Groups of scenes that pairwise matches link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.components import components

WHOLE = r"^[0-9]{1,18}$"


def matched_scenes(recommendations: DataFrame, least: float = 0.8) -> DataFrame:
    """Edges ``a, b`` of accepted duplicate_scenes rows.

    A confidence above 1 is on the 0 to 100 scale; where it is null,
    ``details.confidence`` (0 to 100) counts; with neither the row is passed
    over. Outer blanks of target_id and its two pieces do not count; other
    shapes, and a scene matched with itself, are passed over.
    """
    pieces = F.split(F.col("target_id"), ":")
    a, b = F.trim(pieces[0]), F.trim(pieces[1])
    told = F.get_json_object("details", "$.confidence").try_cast("double") / 100
    sure = F.coalesce(F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence")), told)
    kept = recommendations.where((F.col("type") == "duplicate_scenes") & (F.coalesce("status", F.lit("")) != "dismissed") & (sure >= least) & (F.size(pieces) == 2) & a.rlike(WHOLE) & b.rlike(WHOLE))
    return kept.select(a.cast("long").alias("a"), b.cast("long").alias("b")).where("a <> b").distinct()


def scene_groups(recommendations: DataFrame, least: float = 0.8) -> DataFrame:
    """``scene_id, group_id``: every linked scene with the smallest scene id of its group."""
    return components(matched_scenes(recommendations, least)).select(F.col("node").alias("scene_id"), F.col("component").alias("group_id"))
