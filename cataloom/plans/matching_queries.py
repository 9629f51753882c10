"""Face matching: search, fusion with local rows, link groups, votes of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.operators import state, vectors
from cataloom.plans.registry import Queries
from cataloom.plans.relational_queries import _LATEST, _SCENES, _VOTE, latest, scenes, votes

q = Queries()

#: Endpoints in the order in which their rows are preferred; others come after.
PRIORITY = ("boxnorth.example", "lumenbox.example")
_RANK = "case when endpoint like '%boxnorth.example%' then 0 when endpoint like '%lumenbox.example%' then 1 else 2 end"


def rank_of(endpoint):
    out = F.when(endpoint.contains(PRIORITY[0]), 0)
    for k, name in enumerate(PRIORITY[1:], 1):
        out = out.when(endpoint.contains(name), k)
    return out.otherwise(len(PRIORITY))


def url_links(t) -> DataFrame:
    """``a, b``: each performer with the first one that shares a plain URL (a star per URL, so a common URL makes no square)."""
    u = latest(t).select("stash_box_id", F.explode(F.array_distinct(F.transform("urls", lambda x: F.rtrim(F.lower(F.trim(x)), F.lit("/"))))).alias("url")).where("url <> ''")
    first = u.groupBy("url").agg(F.min("stash_box_id").alias("a"))
    return u.join(first, "url").where("a <> stash_box_id").select("a", F.col("stash_box_id").alias("b")).distinct()


def link_groups(t) -> DataFrame:
    """``stashdb_id, grp``: the smallest id of every performer's link group."""
    g = state.group_labels(url_links(t)).select(F.col("node").alias("stashdb_id"), F.col("label").alias("grp"))
    return latest(t).select(F.col("stash_box_id").alias("stashdb_id")).join(g, "stashdb_id", "left").select("stashdb_id", F.coalesce("grp", "stashdb_id").alias("grp"))


def local_ids(t) -> DataFrame:
    return t("search_performer").select(F.explode("stash_ids").alias("k")).select(F.col("k.stash_id").alias("stashdb_id")).distinct().withColumn("local", F.lit(True))


_GROUPS = f"""recursive l as (select stash_box_id, urls from {_LATEST}),
u as (select distinct stash_box_id, rtrim(lower(trim(x)), '/') url from (select stash_box_id, unnest(urls) x from l) where rtrim(lower(trim(x)), '/') <> ''),
fst as (select url, min(stash_box_id) a from u group by 1),
ed as (select distinct fst.a, u.stash_box_id b from u join fst using (url) where fst.a <> u.stash_box_id),
bw as (select a, b from ed union select b, a from ed),
reach as (select a n, a r from bw union select bw.b, reach.r from reach join bw on bw.a = reach.n),
grp as (select l.stash_box_id stashdb_id, coalesce(g.g, l.stash_box_id) grp from l left join (select n, min(r) g from reach group by 1) g on g.n = l.stash_box_id),
loc as (select distinct k.stash_id stashdb_id from (select unnest(stash_ids) k from search_performer))"""

_BEST = "best as (select face_id, stashdb_id, any_value(endpoint) endpoint, min(distance) d from performer_match where distance is not null group by face_id, stashdb_id)"


def best_matches(t) -> DataFrame:
    return t("performer_match").where("distance is not null").groupBy("face_id", "stashdb_id").agg(F.max("endpoint").alias("endpoint"), F.min("distance").alias("d"))


def collapsed(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per ``by`` and link group: a local one first, then the preferred endpoint, then the nearest."""
    key = F.struct((~F.col("local")).alias("l"), rank_of(F.col("endpoint")).alias("r"), "d", "stashdb_id")
    return rows.groupBy(*by, "grp").agg(F.min(key).alias("k")).select(*by, "grp", F.col("k.stashdb_id").alias("stashdb_id"), F.col("k.d").alias("d"))


@q.add("j27_linked_candidates", f"with {_GROUPS}, {_BEST} select face_id, grp, count(*) as members, min(d) as distance from best join grp using (stashdb_id) group by all")
def _(t):
    return best_matches(t).join(link_groups(t), "stashdb_id").groupBy("face_id", "grp").agg(F.count("*").alias("members"), F.min("d").alias("distance"))


@q.add("k5_priority_collapse", f"with {_GROUPS}, {_BEST} select face_id, stashdb_id, d as distance from (select b.*, grp, row_number() over (partition by face_id, grp order by loc.stashdb_id is null, {_RANK}, d, b.stashdb_id) r from best b join grp using (stashdb_id) left join loc on loc.stashdb_id = b.stashdb_id) where r = 1")
def _(t):
    rows = best_matches(t).join(link_groups(t), "stashdb_id").join(local_ids(t), "stashdb_id", "left").withColumn("local", F.coalesce("local", F.lit(False)))
    return collapsed(rows, ["face_id"]).select("face_id", "stashdb_id", F.col("d").alias("distance"))


@q.add("k4_merged_candidates", f"with {_GROUPS}, {_BEST}, every as (select face_id, stashdb_id, d, false lo from best union all select face_id, stashdb_id, round(d * 0.85, 9), true from best join loc using (stashdb_id)) select face_id, stashdb_id, d as distance, lo as from_local from (select e.*, row_number() over (partition by face_id, grp order by d, lo, stashdb_id) r from every e join grp using (stashdb_id)) where r = 1")
def _(t):
    b = best_matches(t)
    own = b.join(local_ids(t), "stashdb_id").select("face_id", "stashdb_id", F.round(F.col("d") * 0.85, 9).alias("d"), F.lit(True).alias("lo"))
    every = b.select("face_id", "stashdb_id", "d", F.lit(False).alias("lo")).unionByName(own).join(link_groups(t), "stashdb_id")
    kept = every.groupBy("face_id", "grp").agg(F.min(F.struct("d", "lo", "stashdb_id")).alias("k"))
    return kept.select("face_id", F.col("k.stashdb_id").alias("stashdb_id"), F.col("k.d").alias("distance"), F.col("k.lo").alias("from_local"))


@q.add("k6_sibling_maps", f"with s as (select distinct id, stash_ids from search_performer where len(stash_ids) > 0), e as (select id, k.stash_id s, pos from s, unnest(stash_ids) with ordinality as x(k, pos)) select e.id, arg_min(e.s, e.pos) filter (l.stash_box_id is not null) as primary_id, list_sort(list_distinct(list(e.s))) as siblings from e left join {_LATEST} l on l.stash_box_id = e.s group by e.id")
def _(t):
    e = t("search_performer").where("size(stash_ids) > 0").select("id", F.posexplode("stash_ids").alias("pos", "k")).select("id", "pos", F.col("k.stash_id").alias("s")).distinct()
    known = latest(t).select(F.col("stash_box_id").alias("s"), F.lit(True).alias("known"))
    return e.join(known, "s", "left").groupBy("id").agg(F.min_by("s", F.when(F.col("known"), F.col("pos"))).alias("primary_id"), F.array_sort(F.collect_set("s")).alias("siblings"))


_USABLE = "(select id, any_value(embedding)::double[128] v from scene_face_embeddings where len(embedding) = 128 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by id)"


def usable(t) -> DataFrame:
    e = t("scene_face_embeddings").where((F.size("embedding") == 128) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    return e.select("id", "embedding").dropDuplicates(["id"])


@q.add(
    "k1_face_search",
    f"""with {_GROUPS}, us as {_USABLE},
idx as (select distinct m.matched_face_id fid, e.v from performer_match m join us e on e.id = m.matched_face_id),
ids as (select matched_face_id fid, stashdb_id, max(endpoint) endpoint from performer_match group by all),
knn as (select us.id face_id, i.fid, greatest(round(1 - array_cosine_similarity(us.v, i.v), 9), 0) d from us join idx i on us.id % 100 = 0 qualify row_number() over (partition by us.id order by d, i.fid) <= 100),
best as (select face_id, stashdb_id, max(endpoint) endpoint, min(d) d from knn join ids using (fid) where d <= 0.8 group by face_id, stashdb_id qualify row_number() over (partition by face_id order by min(d), stashdb_id) <= 20),
fused as (select b.face_id, b.stashdb_id, b.endpoint, loc.stashdb_id is not null lo, case when loc.stashdb_id is not null then round(d * 0.85, 9) else d end d from best b left join loc on loc.stashdb_id = b.stashdb_id),
col as (select f.*, row_number() over (partition by face_id, grp order by not lo, {_RANK}, d, f.stashdb_id) r from fused f join grp using (stashdb_id) where d <= 0.8)
select face_id, stashdb_id, d as distance, row_number() over (partition by face_id order by d, stashdb_id) as rank from col where r = 1 qualify row_number() over (partition by face_id order by d, stashdb_id) <= 5""",
)
def _(t):
    """Every hundredth face against the faces of known identity: nearest, best per identity, cut, local fusion, links collapsed, cut again."""
    u, m = usable(t), t("performer_match")
    idx = u.join(m.select(F.col("matched_face_id").alias("id")).distinct(), "id", "left_semi")
    ids = m.groupBy(F.col("matched_face_id").alias("index_id"), "stashdb_id").agg(F.max("endpoint").alias("endpoint"))
    near = vectors.search(u.where(F.col("id") % 100 == 0), idx, "id", "id", "embedding", k=100).where("distance <= 0.8").join(ids, "index_id")
    best = near.groupBy(F.col("query_id").alias("face_id"), "stashdb_id").agg(F.max("endpoint").alias("endpoint"), F.min("distance").alias("d"))
    order = Window.partitionBy("face_id").orderBy("d", "stashdb_id")
    best = best.withColumn("r", F.row_number().over(order)).where("r <= 20").drop("r").join(local_ids(t), "stashdb_id", "left").withColumn("local", F.coalesce("local", F.lit(False)))
    fused = best.withColumn("d", F.when(F.col("local"), F.round(F.col("d") * 0.85, 9)).otherwise(F.col("d"))).where("d <= 0.8").join(link_groups(t), "stashdb_id")
    return collapsed(fused, ["face_id"]).withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("face_id", "stashdb_id", F.col("d").alias("distance"), "rank")


# ---- clusters of a scene's faces; the cluster is given by the frame here, so that SQL can follow

_CL = "cl as (select distinct e.id face_id, e.stash_scene_id scene, ((e.frame_index % 4) + 4) % 4 cluster, e.frame_index frame from scene_face_embeddings e), cm as (select distinct cl.*, m.stashdb_id, m.match_rank, m.match_id, m.distance d from cl join performer_match m using (face_id) where m.distance is not null)"


def clustered(t) -> DataFrame:
    return t("scene_face_embeddings").select(F.col("id").alias("face_id"), F.col("stash_scene_id").alias("scene"), F.pmod("frame_index", F.lit(4)).alias("cluster"), F.col("frame_index").alias("frame")).distinct()


def cluster_matches(t) -> DataFrame:
    m = t("performer_match").where("distance is not null").select("face_id", "stashdb_id", "match_rank", "match_id", F.col("distance").alias("d"))
    return clustered(t).join(m, "face_id").distinct()


@q.add("a12_cluster_votes", f"with {_CL} select scene, cluster, stashdb_id, count(*) as appearances, count(distinct frame) as frames, round((1 - min(d)) * (1 + 0.1 * (count(*) - 1)), 6) as score from cm where d <= 0.5 group by all")
def _(t):
    g = cluster_matches(t).where("d <= 0.5").groupBy("scene", "cluster", "stashdb_id").agg(F.count("*").alias("appearances"), F.countDistinct("frame").alias("frames"), F.min("d").alias("d"))
    return g.select("scene", "cluster", "stashdb_id", "appearances", "frames", F.round((1 - F.col("d")) * (1 + 0.1 * (F.col("appearances") - 1)), 6).alias("score"))


_MERGED = f"{_CL}, dom as (select scene, cluster, arg_max(stashdb_id, (n, -d, stashdb_id)) identity from (select scene, cluster, stashdb_id, count(*) n, min(d) d from cm where match_rank = 1 group by all) group by all), per as (select cl.scene, coalesce(dom.identity, 'cluster ' || cl.cluster) person, max(dom.identity) identity, count(distinct cl.face_id) faces, count(distinct cl.cluster) clusters from cl left join dom using (scene, cluster) group by 1, 2)"


def merged_persons(t) -> DataFrame:
    """Clusters of one dominant identity make one person; clusters without one stay apart."""
    top = cluster_matches(t).where("match_rank = 1").groupBy("scene", "cluster", "stashdb_id").agg(F.count("*").alias("n"), F.min("d").alias("d"))
    dom = top.groupBy("scene", "cluster").agg(F.max_by("stashdb_id", F.struct("n", -F.col("d"), "stashdb_id")).alias("identity"))
    j = clustered(t).join(dom, ["scene", "cluster"], "left").withColumn("person", F.coalesce("identity", F.concat(F.lit("cluster "), F.col("cluster").cast("string"))))
    return j.groupBy("scene", "person").agg(F.max("identity").alias("identity"), F.countDistinct("face_id").alias("faces"), F.countDistinct("cluster").alias("clusters"))


@q.add("k8_merged_clusters", f"with {_MERGED} select scene, identity, faces, clusters, row_number() over (partition by scene order by identity is null, faces desc, person) as place from per")
def _(t):
    order = Window.partitionBy("scene").orderBy(F.col("identity").isNull(), F.desc("faces"), "person")
    return merged_persons(t).select("scene", "identity", "faces", "clusters", F.row_number().over(order).alias("place"))


@q.add("a14_person_counts", f"with {_MERGED} select scene, count(*) filter (identity is not null) as identified, count(*) filter (identity is null) as unidentified from per group by 1")
def _(t):
    return merged_persons(t).groupBy("scene").agg(F.count_if(F.col("identity").isNotNull()).alias("identified"), F.count_if(F.col("identity").isNull()).alias("unidentified"))


@q.add("a9_matched_faces", f"with {_MERGED} select scene, sum(faces) as total_faces from per where identity is not null group by 1")
def _(t):
    return merged_persons(t).where("identity is not null").groupBy("scene").agg(F.sum("faces").alias("total_faces"))


_HYBRID = f"""{_VOTE}, {_CL},
fr as (select stash_scene_id scene, stashdb_id, 1 - min(distance) c, count(distinct frame_index) f from m group by all having count(*) >= 2 and count(distinct frame_index) >= 2 and 1 - min(distance) >= 0.35),
cv as (select scene, stashdb_id, 1 - min(d) c, count(distinct frame) f from cm where d <= 0.5 group by all),
nc as (select scene, count(distinct cluster) n from cl group by 1),
hy as (select coalesce(fr.scene, cv.scene) scene, coalesce(fr.stashdb_id, cv.stashdb_id) stashdb_id, fr.c is not null and cv.c is not null agreed,
  round(least(1, greatest(coalesce(fr.c, 0), coalesce(cv.c, 0)) + case when fr.c is not null and cv.c is not null then 0.25 else 0 end) * (1 + 0.05 * (greatest(coalesce(fr.f, 0), coalesce(cv.f, 0)) - 1)), 6) score,
  greatest(coalesce(fr.c, 0), coalesce(cv.c, 0)) c, greatest(coalesce(fr.f, 0), coalesce(cv.f, 0)) f
  from fr full join cv on fr.scene = cv.scene and fr.stashdb_id = cv.stashdb_id),
hr as (select hy.*, row_number() over (partition by scene order by score desc, stashdb_id) rank from hy where c >= 0.35 and f >= 2),
hk as (select hr.* from hr join nc using (scene) where rank <= greatest(2, least(5, nc.n)))"""


def hybrid(t) -> DataFrame:
    """Frequency and cluster votes joined on identity: 0.25 more where both agree, more for further frames, capped per scene."""
    k = ["scene", "stashdb_id"]
    f = votes(t).groupBy(F.col("stash_scene_id").alias("scene"), "stashdb_id").agg((1 - F.min("distance")).alias("ca"), F.countDistinct("frame_index").alias("fa"), F.count("*").alias("n")).where("n >= 2 and fa >= 2 and ca >= 0.35").drop("n")
    c = cluster_matches(t).where("d <= 0.5").groupBy(*k).agg((1 - F.min("d")).alias("cb"), F.countDistinct("frame").alias("fb"))
    n = clustered(t).groupBy("scene").agg(F.countDistinct("cluster").alias("clusters"))
    both = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    j = f.join(c, k, "full").select(*k, both.alias("agreed"), F.greatest(F.coalesce("ca", F.lit(0.0)), F.coalesce("cb", F.lit(0.0))).alias("c"), F.greatest(F.coalesce("fa", F.lit(0)), F.coalesce("fb", F.lit(0))).alias("f"))
    j = j.withColumn("score", F.round(F.least(F.lit(1.0), F.col("c") + F.when(F.col("agreed"), 0.25).otherwise(0.0)) * (1 + 0.05 * (F.col("f") - 1)), 6)).where("c >= 0.35 and f >= 2")
    order = Window.partitionBy("scene").orderBy(F.desc("score"), "stashdb_id")
    return j.withColumn("rank", F.row_number().over(order)).join(n, "scene").where(F.col("rank") <= F.greatest(F.lit(2), F.least(F.lit(5), F.col("clusters"))))


@q.add("k11_hybrid_scores", f"{_HYBRID} select scene, stashdb_id, agreed, score, rank from hk")
def _(t):
    return hybrid(t).select("scene", "stashdb_id", "agreed", "score", "rank")


@q.add("k12_modes", f"{_HYBRID} select 'hybrid' as mode, count(*) as persons from hk union all select 'frequency', count(*) from (select scene, cluster from cm where d <= 0.5 group by all) union all select 'cluster', count(*) from (select scene, cluster from cm where match_rank = 1 group by all)")
def _(t):
    """What each mode works on: hybrid votes, votes per cluster (the mode named frequency), dominant identities of clusters."""
    cm = cluster_matches(t)
    modes = {"hybrid": hybrid(t), "frequency": cm.where("d <= 0.5").select("scene", "cluster").distinct(), "cluster": cm.where("match_rank = 1").select("scene", "cluster").distinct()}
    out = None
    for name, df in modes.items():
        part = df.groupBy().agg(F.count("*").alias("persons")).select(F.lit(name).alias("mode"), "persons")
        out = part if out is None else out.unionByName(part)
    return out


@q.add("x7_linked_substitutes", f"with {_GROUPS}, {_BEST}, pr as (select stash_box_id stashdb_id, {_RANK} r from {_LATEST}), bp as (select b.face_id, b.stashdb_id, g.grp, pr.r from best b join grp g using (stashdb_id) join pr using (stashdb_id)) select bp.face_id, bp.stashdb_id, arg_min(g.stashdb_id, (o.r, g.stashdb_id)) as substitute from bp join grp g using (grp) join pr o on o.stashdb_id = g.stashdb_id where o.r < bp.r and not exists (select 1 from bp c where c.face_id = bp.face_id and c.stashdb_id = g.stashdb_id) group by 1, 2")
def _(t):
    """Better-ranked members of a candidate's link group that are no candidates of the face themselves."""
    pr = latest(t).select(F.col("stash_box_id").alias("stashdb_id"), rank_of(F.col("endpoint")).alias("r"))
    member = link_groups(t).join(pr, "stashdb_id")
    bp = best_matches(t).select("face_id", "stashdb_id").join(member, "stashdb_id")
    other = member.select("grp", F.col("stashdb_id").alias("o"), F.col("r").alias("ro"))
    cand = bp.select("face_id", F.col("stashdb_id").alias("o"))
    return bp.join(other, "grp").where("ro < r").join(cand, ["face_id", "o"], "left_anti").groupBy("face_id", "stashdb_id").agg(F.min_by("o", F.struct("ro", "o")).alias("substitute"))


@q.add("x6_linked_tagged", f"with {_GROUPS}, {_BEST}, own as (select b.face_id, b.stashdb_id, p.performer_id from best b join grp g using (stashdb_id) join grp o using (grp) join {_LATEST} p on p.stash_box_id = o.stashdb_id), e as (select distinct id, cast(stash_scene_id as varchar) scene_id from scene_face_embeddings) select o.face_id, o.stashdb_id, bool_or(list_contains(s.performer_ids, cast(o.performer_id as varchar))) as tagged from own o join e on e.id = o.face_id join {_SCENES} s on s.scene_id = e.scene_id group by 1, 2")
def _(t):
    """Whether a candidate or any performer linked to it is named by the scene."""
    g = link_groups(t)
    p = latest(t).select(F.col("stash_box_id").alias("o"), F.col("performer_id").cast("string").alias("p"))
    own = best_matches(t).select("face_id", "stashdb_id").join(g, "stashdb_id").join(g.withColumnRenamed("stashdb_id", "o"), "grp").join(p, "o")
    e = t("scene_face_embeddings").select(F.col("id").alias("face_id"), F.col("stash_scene_id").cast("string").alias("scene_id")).distinct()
    return own.join(e, "face_id").join(scenes(t).select("scene_id", "performer_ids"), "scene_id").groupBy("face_id", "stashdb_id").agg(F.bool_or(F.expr("array_contains(performer_ids, p)")).alias("tagged"))


@q.add("x33_primary_keys", f"with {_GROUPS}, s as (select distinct id, stash_ids from search_performer where len(stash_ids) > 0) select s.id, coalesce(min(g.grp), min(k.stash_id)) as canonical, arg_min(k.stash_id, (pos)) as first_uid from (select id, k, pos from s, unnest(stash_ids) with ordinality as x(k, pos)) s left join grp g on g.stashdb_id = s.k.stash_id group by 1")
def _(t):
    """Library rows with the canonical key of their link group and their first identity."""
    e = t("search_performer").where("size(stash_ids) > 0").select("id", F.posexplode("stash_ids").alias("pos", "k")).select("id", "pos", F.col("k.stash_id").alias("stashdb_id")).distinct()
    return e.join(link_groups(t), "stashdb_id", "left").groupBy("id").agg(F.coalesce(F.min("grp"), F.min("stashdb_id")).alias("canonical"), F.min_by("stashdb_id", "pos").alias("first_uid"))


QUERIES, SQL = q.QUERIES, q.SQL
