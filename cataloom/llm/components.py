"""Connected components of pairwise matches by Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.workspace import materialise

#: Rounds after which the remaining edges would point to a fault: each round at least halves the components.
MOST_ROUNDS = 64


def _jump(parent: DataFrame) -> DataFrame:
    p, q = parent.alias("p"), parent.alias("q")
    return p.join(q, F.col("p.root") == F.col("q.node"), "left").select(F.col("p.node").alias("node"), F.coalesce(F.col("q.root"), F.col("p.root")).alias("root"), (F.col("q.root") != F.col("p.root")).alias("moved"))


def _collapse(parent: DataFrame) -> DataFrame:
    """Roots of all nodes (``node, root``) by pointer doubling."""
    while True:
        parent = materialise(_jump(parent), "pointers")
        if not parent.where("moved").limit(1).count():
            return parent.select("node", "root")
        parent = parent.select("node", "root")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an undirected edge table.

    The component is named by its smallest node. In every round each component
    picks its smallest outgoing edge (by the other end, so choices are
    deterministic) and hooks onto it; of two components that picked each other
    the smaller becomes the root. Trees collapse by pointer doubling, edges are
    relabelled and deduplicated, until none is left. A pick is a grouped
    minimum, combined before the shuffle, so a node that holds a third of all
    edges stays cheap; nothing is collected.

    Null ends are ignored; an edge from a node to itself makes the node a
    component of its own; repeated and reversed edges count once; an empty
    table gives an empty result; further columns are ignored.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    live = materialise(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = live.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    live = live.where("u <> v")
    for _ in range(MOST_ROUNDS):
        if not live.limit(1).count():
            break
        ends = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        picked = ends.groupBy("u").agg(F.min("v").alias("pick"))
        p, q = picked.alias("p"), picked.alias("q")
        hooked = p.join(q, F.col("p.pick") == F.col("q.u"), "left").select(F.col("p.u").alias("node"), F.when((F.col("q.pick") == F.col("p.u")) & (F.col("p.u") < F.col("p.pick")), F.col("p.u")).otherwise(F.col("p.pick")).alias("root"))
        roots = _collapse(materialise(hooked, "hooks"))
        labels = materialise(labels.join(roots, labels["component"] == roots["node"], "left").select(labels["node"], F.coalesce(roots["root"], labels["component"]).alias("component")), "labels")
        ru, rv = roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        relabelled = live.join(ru, "u").join(rv, "v").where("ru <> rv")
        live = materialise(relabelled.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
