"""Duplicate scenes with every signal, file signatures, and scenes near changed vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions import scalars as S
from cataloom.operators import scoring, vectors
from cataloom.plans.matching_queries import _USABLE, usable
from cataloom.plans.registry import Queries
from cataloom.plans.relational_queries import _SCENES, _VOTE, scenes, votes
from cataloom.workspace import materialise

q = Queries()


def scene_links(t) -> DataFrame:
    """``scene_id, endpoint, remote_id`` of fingerprint matches, the scene's links to catalogues."""
    p = F.split("target_id", r"\|")
    r = t("recommendations").where((F.col("type") == "scene_fingerprint_match") & (F.size(p) == 3))
    return r.select(F.trim(p[0]).alias("scene_id"), F.trim(p[1]).alias("endpoint"), F.trim(p[2]).alias("remote_id")).distinct()


def signatures(t) -> DataFrame:
    """``scene_id, identity, share, kinds``: each identity's share of a scene's matched faces."""
    g = votes(t).groupBy(F.col("stash_scene_id").cast("string").alias("scene_id"), F.col("stashdb_id").alias("identity")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("scene_id")
    return g.select("scene_id", "identity", (F.col("n") / F.sum("n").over(w)).alias("share"), F.count("*").over(w).alias("kinds"))


_DUP = f"""{_VOTE},
s as (select scene_id, studio_id, title, duration_seconds l, list_distinct(performer_ids) c, case when regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast(date as date) end d from {_SCENES}),
lk as (select distinct trim(split_part(target_id, '|', 1)) scene_id, trim(split_part(target_id, '|', 2)) ep, trim(split_part(target_id, '|', 3)) rid from recommendations where type = 'scene_fingerprint_match' and len(string_split(target_id, '|')) = 3),
mt as (select distinct x.scene_id a, y.scene_id b from lk x join lk y on x.ep = y.ep and x.rid = y.rid and x.scene_id < y.scene_id),
vt as (select distinct x.scene_id a, y.scene_id b from lk x join lk y on x.ep = y.ep and x.rid <> y.rid and x.scene_id < y.scene_id),
h as (select scene_id, cast(('0x' || substr(md5(title), 1, 16)) as ubigint) p from s where title is not null),
hp as (select x.scene_id a, y.scene_id b, bit_count(xor(x.p, y.p)) bits from h x join h y on x.scene_id < y.scene_id and bit_count(xor(x.p, y.p)) <= 10),
k as (select scene_id, studio_id, unnest(c) p from s where studio_id is not null),
st as (select distinct x.scene_id a, y.scene_id b from k x join k y on x.studio_id = y.studio_id and x.p = y.p and x.scene_id < y.scene_id),
sg as (select cast(stash_scene_id as varchar) sc, stashdb_id i, count(*) n from m group by all),
sh as (select sc, i, n / sum(n) over (partition by sc) r, count(*) over (partition by sc) c from sg),
fc as (select x.sc a, y.sc b, least(75e0, 60e0 * count(*) / (max(x.c) + max(y.c) - count(*)) + greatest(0e0, 15e0 * (1 - 4 * avg(abs(x.r - y.r))))) face from sh x join sh y on x.i = y.i and x.sc < y.sc group by all),
pairs as (select a, b from mt union select a, b from hp union select a, b from st),
f as (select p.a, p.b, abs(date_diff('day', x.d, y.d)) dd, coalesce(len(list_intersect(x.c, y.c)) / nullif(len(list_distinct(list_concat(x.c, y.c))), 0), 0) j, len(x.c) > 0 nx, len(x.c) > 0 or len(y.c) > 0 anyc, x.studio_id = y.studio_id st,
  case when x.l > 0 and y.l > 0 then least(x.l, y.l) / greatest(x.l, y.l) end r from pairs p join s x on x.scene_id = p.a join s y on y.scene_id = p.b),
m2 as (select a, b, cast(greatest(0, least(60, case when dd = 0 and nx and j = 1 then 45 when dd = 0 and j >= 0.5 then 35 when dd <= 7 and nx and j = 1 then 35 when nx and j = 1 then 25 when dd = 0 and anyc then 20 when j >= 0.5 then 15 else 0 end
  + case when st and dd <= 7 then 10 else 0 end + case when r < 0.15 then -20 when r < 0.30 then -10 else 0 end)) as double) meta from f),
z as (select m2.a, m2.b, meta, coalesce(face, 0e0) face, bits, coalesce(85e0 - 6.5e0 * bits, 0e0) p, mt.a is not null matched, vt.a is not null other
  from m2 left join fc on fc.a = m2.a and fc.b = m2.b left join hp on hp.a = m2.a and hp.b = m2.b left join mt on mt.a = m2.a and mt.b = m2.b left join vt on vt.a = m2.a and vt.b = m2.b),
c as (select *, case when matched then 100e0 when other then null when p = 0 and meta = 0 and face = 0 then null else round(least(95e0,
  case when p > 0 and bits <= 4 then p + least(0.15e0 * meta, 5e0) + least(0.1e0 * face, 5e0) when p > 0 and meta = 0 and face = 0 then 0.6e0 * p when p > 0 then p + 0.4e0 * greatest(meta, face) else greatest(meta, face) + 0.3e0 * least(meta, face) end), 1) end conf from z)"""


def scored(t) -> DataFrame:
    """``a < b`` with every signal and the confidence: candidates by shared links, near hashes, and studio with a shared performer.

    A shared link gives 100; links to other entries of one catalogue without a
    shared one forbid the pair. The hash of a scene is that of its title here.
    """
    s = scenes(t)
    l = scene_links(t)
    x, y = l.toDF("a", "ep", "ra"), l.toDF("b", "ep", "rb")
    same = x.join(y, (x["ep"] == y["ep"]) & (x["ra"] == y["rb"])).where("a < b").select("a", "b").distinct().withColumn("matched", F.lit(True))
    hashes = s.where("title is not null").select("scene_id", S.phash_bits(F.substring(F.md5("title"), 1, 16)).alias("h"))
    near = vectors.hamming_pairs(hashes, "scene_id", "h", 10)
    pairs = same.select("a", "b").union(near.select("a", "b")).union(scoring.candidate_pairs(s)).distinct()
    info = s.select("scene_id", "studio_id", "date", F.array_distinct("performer_ids").alias("cast"), "duration_seconds")
    one, two = (info.select(F.col("scene_id").alias(k), F.struct("studio_id", "date", "cast", "duration_seconds").alias(f"s{k}")) for k in "ab")
    g = lambda k, c: F.col(f"s{k}.{c}")
    meta = scoring.metadata_score(S.days_between(g("a", "date"), g("b", "date")), g("a", "cast"), g("b", "cast"), g("a", "studio_id"), g("b", "studio_id"), g("a", "duration_seconds"), g("b", "duration_seconds")).cast("double")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", meta.alias("meta"))
    f = signatures(t)
    fa, fb = f.toDF("a", "i", "ra", "ca"), f.toDF("b", "i", "rb", "cb")
    face = fa.join(fb, "i").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("ca").alias("ca"), F.max("cb").alias("cb"), F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("d"))
    face = face.select("a", "b", scoring.face_score(F.col("n") / (F.col("ca") + F.col("cb") - F.col("n")), F.col("d")).alias("face"))
    # links to different entries are looked for among the candidates only, not between all scenes of a catalogue
    other = both.select("a", "b").join(x, "a").join(y.withColumnRenamed("ep", "eb"), "b").where("ep = eb and ra <> rb").select("a", "b").distinct().withColumn("other", F.lit(True))
    z = both.join(face, ["a", "b"], "left").join(near, ["a", "b"], "left").join(same, ["a", "b"], "left").join(other, ["a", "b"], "left").na.fill(0.0, ["face"])
    conf = F.when(F.col("matched"), 100.0).when(F.col("other"), None).otherwise(scoring.pair_confidence(F.col("bits"), F.col("meta"), F.col("face")))
    return z.select("a", "b", "meta", "face", "bits", conf.alias("confidence"))


@q.add("k13_duplicate_scenes", f"{_DUP} select a, b, conf as confidence, case when conf >= 80 then 'high' else 'medium' end as label from c where conf >= 50")
def _(t):
    return scored(t).where("confidence >= 50").select("a", "b", "confidence", F.when(F.col("confidence") >= 80, "high").otherwise("medium").alias("label"))


@q.add("k16_hash_scores", f"{_DUP} select a, b, bits, p as score from (select distinct a, b, bits, 85e0 - 6.5e0 * bits p from hp)")
def _(t):
    hashes = scenes(t).where("title is not null").select("scene_id", S.phash_bits(F.substring(F.md5("title"), 1, 16)).alias("h"))
    return vectors.hamming_pairs(hashes, "scene_id", "h", 10).select("a", "b", "bits", scoring.hash_score(F.col("bits")).alias("score"))


@q.add("a20_share_differences", f"{_DUP} select x.sc as a, y.sc as b, round(avg(abs(x.r - y.r)), 6) as difference from sh x join sh y on x.i = y.i and x.sc < y.sc group by all")
def _(t):
    f = signatures(t)
    return f.toDF("a", "i", "ra", "ca").join(f.toDF("b", "i", "rb", "cb"), "i").where("a < b").groupBy("a", "b").agg(F.round(F.avg(F.abs(F.col("ra") - F.col("rb"))), 6).alias("difference"))


@q.add("x37_candidate_vetoes", f"{_DUP} select z.a, z.b, matched as same, other and not matched as veto from z where matched or other")
def _(t):
    """Shared and contradicting links of the candidate pairs."""
    l, c = scene_links(t), scored(t).select("a", "b")
    j = c.join(l.toDF("a", "ep", "ra"), "a").join(l.toDF("b", "eb", "rb"), "b").where("ep = eb").groupBy("a", "b").agg(F.bool_or(F.col("ra") == F.col("rb")).alias("same"))
    return j.select("a", "b", "same", (~F.col("same")).alias("veto"))


@q.add("a18_scored_matches", f"with l as (select scene_id, unnest(performer_ids) p, duration_seconds d from {_SCENES}), n as (select scene_id, count(distinct p) n from l group by 1), j as (select x.scene_id a, y.scene_id b, count(distinct x.p) matched, any_value(abs(x.d - y.d)) dd from l x join l y on x.p = y.p and x.scene_id < y.scene_id group by all) select a, b, matched, round(100e0 * matched / n.n, 1) as pct, coalesce(dd <= 5, false) as same_length from j join n on n.scene_id = j.a where matched >= 2")
def _(t):
    """Pairs of scenes with at least two shared members: count, share of the first's, and lengths within five seconds."""
    l = scenes(t).select("scene_id", F.explode(F.array_distinct("performer_ids")).alias("p"), F.col("duration_seconds").alias("d"))
    n = l.groupBy(F.col("scene_id").alias("a")).agg(F.countDistinct("p").alias("n"))
    j = l.toDF("a", "p", "da").join(l.toDF("b", "p", "db"), "p").where("a < b").groupBy("a", "b").agg(F.count("*").alias("matched"), F.max(F.abs(F.col("da") - F.col("db"))).alias("dd")).where("matched >= 2")
    return j.join(n, "a").select("a", "b", "matched", F.round(100.0 * F.col("matched") / F.col("n"), 1).alias("pct"), F.coalesce(F.col("dd") <= 5, F.lit(False)).alias("same_length"))


_SIDES = f"old as (select scene_id, arg_min(file_path, (created_at, updated_at)) path, arg_min(duration_seconds, (created_at, updated_at)) filter (duration_seconds is not null) d from (select distinct * from scene) group by 1), ext as (select cast(stash_scene_id as varchar) scene_id, max(timestamp_sec) last from scene_face_embeddings group by 1)"


@q.add("j24_file_signatures", f"with {_SIDES} select s.scene_id, case when e.scene_id is null then 'not_cached' when o.path <> s.file_path then 'moved' when abs(o.d - s.duration_seconds) > greatest(1e0, 0.005e0 * greatest(o.d, s.duration_seconds)) then 'changed' when e.last > s.duration_seconds + 1 then 'stale' else 'same' end as state from {_SCENES} s join old o using (scene_id) left join ext e using (scene_id)")
def _(t):
    """Current files against the first stored signature and the extent of the cached frames."""
    first = F.struct("created_at", "updated_at")
    old = t("scene").groupBy("scene_id").agg(F.min_by("file_path", first).alias("path"), F.min_by("duration_seconds", F.when(F.col("duration_seconds").isNotNull(), first)).alias("d"))
    ext = t("scene_face_embeddings").groupBy(F.col("stash_scene_id").cast("string").alias("scene_id")).agg(F.max("timestamp_sec").alias("last"), F.lit(True).alias("cached"))
    now = F.col("duration_seconds")
    state = F.when(F.col("cached").isNull(), "not_cached").when(F.col("path") != F.col("file_path"), "moved").when(F.abs(F.col("d") - now) > F.greatest(F.lit(1.0), 0.005 * F.greatest("d", now)), "changed").when(F.col("last") > now + 1, "stale").otherwise("same")
    return scenes(t).join(old, "scene_id").join(ext, "scene_id", "left").select("scene_id", state.alias("state"))


@q.add("pred15_compatible_caches", f"with {_SIDES}, p as (select scene_id, row_number() over (order by scene_id) n from old) select o.scene_id, coalesce(abs(o.d - s.duration_seconds) < 1e-6, o.d is null and s.duration_seconds is null) and o.path is not distinct from s.file_path as compatible from old o join {_SCENES} s using (scene_id)")
def _(t):
    """Whether stored and current settings agree: texts equal, numbers within a millionth."""
    first = F.struct("created_at", "updated_at")
    old = t("scene").groupBy("scene_id").agg(F.min_by("file_path", first).alias("path"), F.min_by("duration_seconds", F.when(F.col("duration_seconds").isNotNull(), first)).alias("d"))
    near = F.coalesce(F.abs(F.col("d") - F.col("duration_seconds")) < 1e-6, F.col("d").isNull() & F.col("duration_seconds").isNull())
    return old.join(scenes(t).select("scene_id", "file_path", "duration_seconds"), "scene_id").select("scene_id", (near & F.col("path").eqNullSafe(F.col("file_path"))).alias("compatible"))


def centroids(t) -> DataFrame:
    """``scene, mean``: the mean vector of every scene's usable faces.

    A scene's rows come sorted by id and in Arrow batches, so one sum a task is
    kept; an id that is repeated in a scene counts once.
    """
    dim = 128

    def fold(batches):
        now, total, n, before = None, np.zeros(dim), 0, None

        def told(scenes, means):
            return pa.RecordBatch.from_arrays([pa.array(scenes, pa.int64()), pa.array(means, pa.list_(pa.float64()))], names=["scene", "mean"])

        for batch in batches:
            rows, x = vectors.matrices(batch.column(2), scaled=False).get(dim, (np.empty(0, int), np.empty((0, dim))))
            rows, x = rows[(x != 0).any(1)], x[(x != 0).any(1)]
            scene, ids = (np.asarray(batch.column(k).take(pa.array(rows))) for k in (0, 1))
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (scene[1:] != scene[:-1]) | (ids[1:] != ids[:-1])
            if len(rows):
                fresh[0] = (scene[0], ids[0]) != before
                before = (scene[-1], ids[-1])
            scene, x = scene[fresh], x[fresh]
            if not len(scene):
                continue
            starts = np.nonzero(np.diff(scene, prepend=scene[0] - 1))[0]
            sums, counts = np.add.reduceat(x, starts, axis=0), np.diff(np.append(starts, len(scene)))
            out, means = [], []
            for s, more, m in zip(scene[starts].tolist(), sums, counts.tolist()):
                if n and s != now:
                    out.append(now)
                    means.append(total / n)
                    total, n = np.zeros(dim), 0
                now, total, n = s, total + more, n + m
            yield told(out, means)
        if n:
            yield told([now], [total / n])

    rows = t("scene_face_embeddings").where("id is not null and stash_scene_id is not null").select(F.col("stash_scene_id").cast("long").alias("scene"), F.col("id").cast("long"), "embedding")
    return rows.repartition("scene").sortWithinPartitions("scene", "id").mapInArrow(fold, "scene long, mean array<double>")


@q.add("j14_scenes_to_rematch", f"with us as {_USABLE}, r as (select distinct id, stash_scene_id from scene_face_embeddings where stash_scene_id is not null), ex as (select stash_scene_id s, k, avg(x) x from (select r.stash_scene_id, unnest(v::double[]) x, generate_subscripts(v::double[], 1) k from us join r using (id)) group by all), ce as (select s, list(x order by k)::double[128] m from ex group by 1), ch as (select distinct us.id, us.v from us join performer_match p on p.matched_face_id = us.id where p.matched_at >= timestamp '2024-12-15') select distinct s as scene from ce join ch on round(1 - array_cosine_similarity(ce.m, ch.v), 9) <= 0.42")
def _(t):
    """Scenes whose mean face lies within 0.42 of a face matched since; the changed side is searched in blocks."""
    new = t("performer_match").where(F.col("matched_at") >= F.lit("2024-12-15").cast("timestamp_ntz")).select(F.col("matched_face_id").alias("id")).distinct()
    faces = t("scene_face_embeddings").select("id", "embedding").join(F.broadcast(new), "id", "left_semi")  # ids only: else all vectors are shuffled
    changed = usable(lambda _: faces).select("id", F.col("embedding").cast("array<double>").alias("v"))
    means = materialise(centroids(t).select("scene", F.col("mean").alias("v")), "means")
    return vectors.near_any(changed, means, "id", "scene", "v", within=0.42).withColumnRenamed("index_id", "scene")


QUERIES, SQL = q.QUERIES, q.SQL
