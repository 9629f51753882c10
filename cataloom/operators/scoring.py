"""Scores of candidate scene pairs, and per-scene grouping of faces."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions import scalars as S


def cast_score(days: Column, cast_a: Column, cast_b: Column) -> Column:
    """Points for date and cast; only the first rule that holds counts (fixed values)."""
    shared = S.jaccard(cast_a, cast_b)
    exact = (F.size(cast_a) > 0) & (shared == 1.0)
    same_day, near, some = days == 0, days <= 7, (F.size(cast_a) > 0) | (F.size(cast_b) > 0)
    return (
        F.when(same_day & exact, 45)
        .when(same_day & (shared >= 0.5), 35)
        .when(near & exact, 35)
        .when(exact, 25)
        .when(same_day & some, 20)
        .when(shared >= 0.5, 15)
        .otherwise(0)
    )


def metadata_score(days: Column, cast_a: Column, cast_b: Column, studio_a: Column, studio_b: Column, length_a: Column, length_b: Column) -> Column:
    """0 to 60: date and cast, studio within a week, minus very unequal lengths."""
    studio = F.when((studio_a == studio_b) & (days <= 7), 10).otherwise(0)
    ratio = F.when((length_a > 0) & (length_b > 0), F.least(length_a, length_b) / F.greatest(length_a, length_b))
    penalty = F.when(ratio < 0.15, -20).when(ratio < 0.30, -10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(60), cast_score(days, cast_a, cast_b) + studio + penalty))


def hash_score(bits: Column) -> Column:
    """85 for equal hashes, 6.5 less for each differing bit, 0 beyond 10 bits or without."""
    return F.when(bits.isNull() | (bits > 10), 0.0).otherwise(85 - 6.5 * bits)


def face_score(overlap: Column, mean_difference: Column) -> Column:
    """Up to 75 from shared identities and how alike their proportions are."""
    return F.least(F.lit(75.0), 60 * overlap + F.greatest(F.lit(0.0), 15 * (1 - 4 * mean_difference)))


def pair_confidence(bits: Column, meta: Column, face: Column) -> Column:
    """0 to 95, one decimal; null where no signal speaks for a pair."""
    p = hash_score(bits)
    weaker = F.greatest(meta, face)
    strong = p + F.least(0.15 * meta, F.lit(5.0)) + F.least(0.1 * face, F.lit(5.0))
    middle = F.when((meta == 0) & (face == 0), 0.6 * p).otherwise(p + 0.4 * weaker)
    soft = weaker + 0.3 * F.least(meta, face)
    return F.when((p == 0) & (meta == 0) & (face == 0), None).otherwise(F.round(F.least(F.lit(95.0), F.when((p > 0) & (bits <= 4), strong).when(p > 0, middle).otherwise(soft)), 1))


def candidate_pairs(scenes: DataFrame) -> DataFrame:
    """``a < b``: scenes of one studio that share a performer."""
    k = scenes.where("studio_id is not null").select("scene_id", "studio_id", F.explode(F.array_distinct("performer_ids")).alias("p"))
    return k.withColumnRenamed("scene_id", "a").join(k.withColumnRenamed("scene_id", "b"), ["studio_id", "p"]).where("a < b").select("a", "b").distinct()


def scored_pairs(scenes: DataFrame, least: float = 0.0) -> DataFrame:
    """``a, b, confidence, label`` of all candidate pairs by their metadata."""
    s = scenes.select("scene_id", "studio_id", "date", F.array_distinct("performer_ids").alias("cast"), "duration_seconds")
    one, two = (s.select(F.col("scene_id").alias(k), F.struct("studio_id", "date", "cast", "duration_seconds").alias(f"s{k}")) for k in "ab")
    both = candidate_pairs(scenes).join(one, "a").join(two, "b")
    g = lambda k, c: F.col(f"s{k}.{c}")
    meta = metadata_score(S.days_between(g("a", "date"), g("b", "date")), g("a", "cast"), g("b", "cast"), g("a", "studio_id"), g("b", "studio_id"), g("a", "duration_seconds"), g("b", "duration_seconds")).cast("double")
    out = both.select("a", "b", pair_confidence(F.lit(None).cast("int"), meta, F.lit(0.0)).alias("confidence")).where(F.col("confidence") >= least)
    return out.withColumn("label", F.when(F.col("confidence") >= 80, "high").when(F.col("confidence") >= 50, "medium").otherwise("low"))


#: Rows whose products with the means are taken at once, means up to which they are simply compared, and means a product holds.
FOLD_ROWS, FEW_MEANS, STRIP_MEANS = 256, 512, 16_384
#: Room for the error of products in single precision; what lies within it is told in double precision.
FOLD_ROOM = 1e-5


class _Means:
    """Running sums of the clusters of one group and one length of vectors, in the order of opening."""

    def __init__(self, dim: int, limit: float) -> None:
        self.limit, self.n, self.numbers = limit, 0, []
        self.sums, self.norms, self.units = np.zeros((8, dim)), np.zeros(8), np.zeros((8, dim), np.float32)

    def _keep(self, at: int, total: np.ndarray) -> None:
        if at == len(self.sums):
            self.sums, self.norms, self.units = (np.concatenate([a, np.zeros_like(a)]) for a in (self.sums, self.norms, self.units))
        norm = math.sqrt(total @ total)
        self.sums[at], self.norms[at] = total, norm or math.inf
        self.units[at] = total / self.norms[at]

    def _near(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit row the means that may lie within the limit."""
        x, least = x.astype(np.float32), np.float32(1 - self.limit - FOLD_ROOM)
        rows, means = [], []
        for s in range(0, self.n, STRIP_MEANS):
            like = x @ self.units[s : min(s + STRIP_MEANS, self.n)].T
            i, j = np.divmod(np.flatnonzero(like >= least), like.shape[1])
            rows.append(i)
            means.append(j + s)
        rows, means = np.concatenate(rows), np.concatenate(means)
        means = means[np.argsort(rows, kind="stable")]
        return np.split(means, np.cumsum(np.bincount(rows, minlength=len(x)))[:-1])

    def join(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster (in the order of opening) of each row, and whether the row opens it."""
        at, opened = np.empty(len(x), np.int64), np.zeros(len(x), bool)
        sizes = np.linalg.norm(x, axis=1)
        for s in range(0, len(x), FOLD_ROWS):
            part = x[s : s + FOLD_ROWS]
            near = self._near(part / sizes[s : s + FOLD_ROWS, None]) if self.n > FEW_MEANS else None
            moved: list[int] = []  # since the products were taken
            for i, v in enumerate(part):
                held = np.concatenate([near[i], np.array(moved, np.int64)]) if near is not None else np.arange(self.n)
                best = -1
                if len(held):
                    sums, norms = (self.sums[: self.n], self.norms[: self.n]) if near is None else (self.sums[held], self.norms[held])
                    d = 1 - (sums @ v) / (norms * sizes[s + i])
                    least = d.min()
                    if least < self.limit:
                        best = int(held[d == least].min())
                if best < 0:
                    best, opened[s + i] = self.n, True
                    self._keep(best, v)
                    self.n += 1
                else:
                    self._keep(best, self.sums[best] + v)
                at[s + i] = best
                if near is not None and (not moved or best != moved[-1]):
                    moved.append(best)
        return at, opened


def online_clusters(faces: DataFrame, group: str, order: list[str], row_id: str, vector: str, limit: float = 0.6) -> DataFrame:
    """``group, row_id, cluster``: each row joins the nearest mean of its group within ``limit``, else opens a cluster.

    The result depends on the order of rows (nulls last), so a group is folded
    in one task, to which its rows come in order and in Arrow batches; it keeps the
    running sums of one group's clusters only. Directions of means are compared,
    so sums serve; the means that may be near come from products of many rows
    in single precision, the nearest is told in double precision. An unusable vector
    (null, empty, non-finite or all zero) opens a cluster that no other row joins.
    A row repeated under its id, group and order counts once.
    """

    def fold(batches):
        now, means, count, before = None, {}, 0, None
        for batch in batches:
            column = batch.column(2)
            values, offsets = column.values, np.asarray(column.offsets)
            flat = np.asarray(values.cast(pa.float64()).fill_null(math.nan))
            sizes = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
            groups, keys = batch.column(0).to_pylist(), list(zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns) if k != 2]))
            fresh = np.array([a != b for a, b in zip(keys, [before, *keys[:-1]])], bool)
            before = keys[-1] if keys else before
            starts = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]] + [len(groups)]
            cluster = np.empty(len(groups), np.int64)
            for s, e in zip(starts[:-1], starts[1:]):
                if groups[s] != now or now is None and not (s == 0 and count):
                    now, means, count = groups[s], {}, 0
                rows = s + np.nonzero(fresh[s:e])[0]
                opened, joined = np.ones(e - s, bool), {}
                for size in np.unique(sizes[rows]):
                    own = rows[sizes[rows] == size]
                    x = flat[offsets[own][:, None] + np.arange(size)]
                    good = np.isfinite(x).all(1) & (x != 0).any(1)
                    if good.any():
                        m = means.setdefault(int(size), _Means(int(size), limit))
                        at, new = m.join(x[good])
                        opened[own[good] - s] = new
                        joined |= dict(zip(own[good].tolist(), zip([m] * len(at), at.tolist())))
                for i in rows.tolist():
                    m, at = joined.get(i, (None, -1))
                    if opened[i - s]:
                        cluster[i], count = count, count + 1
                        if m is not None:
                            m.numbers.append(count - 1)
                    else:
                        cluster[i] = m.numbers[at]
            kept = pa.array(np.nonzero(fresh)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(cluster[fresh].astype(np.int32))], names=[group, row_id, "cluster"])

    kind = dict(faces.dtypes)
    rows = faces.select(*dict.fromkeys([group, row_id, vector, *order]))
    sorted_rows = rows.repartition(group).sortWithinPartitions(group, *[F.asc_nulls_last(c) for c in dict.fromkeys([*order, row_id])])
    return sorted_rows.mapInArrow(fold, f"`{group}` {kind[group]}, `{row_id}` {kind[row_id]}, cluster int")


def greedy_identities(votes: DataFrame, group: str, cluster: str, size: str, identity: str, score: str) -> DataFrame:
    """Clusters by size take their best identity that no earlier cluster of the group has taken.

    A group's votes come in that order, nulls last, and only the identities taken in one group are kept.
    """

    def pick(batches):
        now, taken, done, held = None, set(), None, False
        for batch in batches:
            kept = []
            for i, (g, c, n, name) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(4)])):
                if not held or g != now:
                    now, taken, done, held = g, set(), None, True
                if (n, c) != done and name not in taken:
                    taken.add(name)
                    done = (n, c)
                    kept.append(i)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(k) for k in (0, 1, 3, 4)], names=[group, cluster, identity, score])

    kind = dict(votes.dtypes)
    rows = votes.where(F.col(size).isNotNull() & F.col(cluster).isNotNull()).select(group, cluster, size, identity, F.col(score).cast("double").alias(score))
    best = F.desc_nulls_last(F.when(~F.isnan(score), F.col(score)))
    sorted_rows = rows.repartition(group).sortWithinPartitions(group, F.desc(size), cluster, best, F.asc_nulls_last(identity))
    return sorted_rows.mapInArrow(pick, f"`{group}` {kind[group]}, `{cluster}` {kind[cluster]}, `{identity}` {kind[identity]}, `{score}` double")
