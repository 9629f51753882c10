"""Further operators over the catalogue: settings, scoped updates, votes and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cataloom.functions import scalars as S
from cataloom.operators import changes, state
from cataloom.plans.registry import Queries
from cataloom.plans.relational_queries import _LATEST, _REC, _SCENES, _SURE, _VOTE, latest, recs, scenes, sure, votes

q = Queries()


@q.add("f8_unescaped_texts", "select doc_id, length(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) as chars from documents where text like '%&%'")
def _(t):
    return t("documents").where(F.col("text").contains("&")).select("doc_id", F.length(S.unescaped(F.col("text"))).cast("long").alias("chars"))


@q.add("f4_url_paths", "select distinct u as url, regexp_replace(u, '^[a-z]+://[^/]+', '') as path from (select unnest(urls) u from performer_snapshot) where regexp_full_match(u, '[a-z]+://[^/?#]+/[^#?]*')")
def _(t):
    u = t("performer_snapshot").select(F.explode("urls").alias("url")).distinct().where(F.col("url").rlike(r"^[a-z]+://[^/?#]+/[^#?]*$"))
    return u.select("url", S.url_path(F.col("url")).alias("path"))


@q.add("f37_progress", f"select type, cast(floor(100 * count(*) filter (status <> 'pending') / count(*)) as int) as percent from {_REC} group by type")
def _(t):
    return recs(t).groupBy("type").agg(S.percent(F.count_if(F.col("status") != "pending"), F.count("*")).alias("percent"))


@q.add("f38_settings", "select distinct id, greatest(0.2e0, least(0.9e0, coalesce(quality_score, case when gender = 'female' then 0.6e0 end, 0.1e0))) as value from faces")
def _(t):
    return t("faces").select("id", S.setting(F.col("quality_score"), F.when(F.col("gender") == "female", 0.6), F.lit(0.1), 0.2, 0.9).alias("value")).distinct()


@q.add("j5_shared_identities", "with b as (select distinct e.stash_scene_id s, m.stashdb_id p from performer_match m join (select distinct id, stash_scene_id from scene_face_embeddings) e on e.id = m.face_id where m.match_rank = 1) select distinct x.s as a, y.s as b from b x join b y on x.p = y.p and x.s < y.s")
def _(t):
    e = t("scene_face_embeddings").select(F.col("id").alias("face_id"), F.col("stash_scene_id").alias("s")).distinct()
    b = t("performer_match").where("match_rank = 1").join(e, "face_id").select("s", F.col("stashdb_id").alias("p")).distinct()
    return b.toDF("a", "p").join(b.toDF("b", "p"), "p").where("a < b").select("a", "b").distinct()


@q.add("j12_orphan_prune", f"select distinct stash_scene_id from scene_face_embeddings where cast(stash_scene_id as varchar) not in (select scene_id from {_SCENES} where deleted_at is null)")
def _(t):
    live = scenes(t).where("deleted_at is null").select(F.col("scene_id").cast("long").alias("stash_scene_id"))
    return t("scene_face_embeddings").where("stash_scene_id is not null").select("stash_scene_id").distinct().join(live, "stash_scene_id", "left_anti")


@q.add("j19_linked_by_endpoint", f"select distinct s.id, p.stash_box_id from (select distinct id, unnest(stash_ids) k from search_performer) s join {_LATEST} p on rtrim(lower(p.endpoint), '/') = rtrim(lower(s.k.endpoint), '/') and p.stash_box_id = s.k.stash_id")
def _(t):
    s = t("search_performer").select("id", F.explode("stash_ids").alias("k")).select("id", S.endpoint_key(F.col("k.endpoint")).alias("e"), F.col("k.stash_id").alias("stash_box_id"))
    return s.join(latest(t).select(S.endpoint_key(F.col("endpoint")).alias("e"), "stash_box_id"), ["e", "stash_box_id"]).select("id", "stash_box_id").distinct()


@q.add("a13_dominant_identity", "with b as (select e.stash_scene_id s, m.stashdb_id p, count(distinct m.match_id) n, min(m.distance) d from performer_match m join (select distinct id, stash_scene_id from scene_face_embeddings) e on e.id = m.face_id where m.match_rank = 1 and m.distance is not null group by all) select s as stash_scene_id, p as stashdb_id from b qualify row_number() over (partition by s order by n desc, d, p desc) = 1")
def _(t):
    e = t("scene_face_embeddings").select(F.col("id").alias("face_id"), "stash_scene_id").distinct()
    b = t("performer_match").where("match_rank = 1 and distance is not null").join(e, "face_id").groupBy("stash_scene_id", "stashdb_id").agg(F.countDistinct("match_id").alias("n"), F.min("distance").alias("d"))
    return b.groupBy("stash_scene_id").agg(F.max_by("stashdb_id", F.struct("n", -F.col("d"), "stashdb_id")).alias("stashdb_id"))


@q.add("a29_rows_with_changes", f"select type, count(*) as total, count(*) filter (json_array_length(details, '$.changes') > 0) as with_changes from {_REC} group by type")
def _(t):
    n = F.json_array_length(F.get_json_object("details", "$.changes"))
    return recs(t).groupBy("type").agg(F.count("*").alias("total"), F.count_if(n > 0).alias("with_changes"))


@q.add("pred27_first_alias", f"select stash_box_id, alias_list[1] as first_alias from {_LATEST}")
def _(t):
    return latest(t).select("stash_box_id", F.get("alias_list", F.lit(0)).alias("first_alias"))


@q.add("o8_ordered_persons", f"{_VOTE}, g as (select stash_scene_id, stashdb_id, count(distinct frame_index) f, min(distance) d from m group by all) select stash_scene_id, stashdb_id, row_number() over (partition by stash_scene_id order by f desc, d, stashdb_id) - 1 as person from g")
def _(t):
    g = votes(t).groupBy("stash_scene_id", "stashdb_id").agg(F.countDistinct("frame_index").alias("f"), F.min("distance").alias("d"))
    return g.select("stash_scene_id", "stashdb_id", (F.row_number().over(Window.partitionBy("stash_scene_id").orderBy(F.desc("f"), "d", "stashdb_id")) - 1).alias("person"))


@q.add("u6_cancelled_changes", "select id from (select distinct id, change_seq, lower(trim(op)) in ('delete', 'deleted', 'd', 'del', 'remove', 'removed') gone from face_change where id is not null) qualify row_number() over (partition by id order by change_seq desc) = 1 and gone")
def _(t):
    return t("face_change").where("id is not null").groupBy("id").agg(F.max_by(changes.is_delete(F.col("op")), "change_seq").alias("gone")).where("gone").select("id")


@q.add("k11_hybrid_votes", f"{_VOTE}, a as (select stash_scene_id, stashdb_id, 1 - min(distance) c from m group by all having count(*) >= 2), b as (select stash_scene_id, stashdb_id, 1 - min(distance) c from m where distance <= 0.25 group by all) select coalesce(a.stash_scene_id, b.stash_scene_id) as stash_scene_id, coalesce(a.stashdb_id, b.stashdb_id) as stashdb_id, a.c is not null and b.c is not null as agreed from a full join b on a.stash_scene_id = b.stash_scene_id and a.stashdb_id = b.stashdb_id")
def _(t):
    m, k = votes(t), ["stash_scene_id", "stashdb_id"]
    a = m.groupBy(*k).agg((1 - F.min("distance")).alias("ca"), F.count("*").alias("n")).where("n >= 2").drop("n")
    b = m.where("distance <= 0.25").groupBy(*k).agg((1 - F.min("distance")).alias("cb"))
    return a.join(b, k, "full").select(*k, (F.col("ca").isNotNull() & F.col("cb").isNotNull()).alias("agreed"))


@q.add("x6_tagged_members", f"with m as (select distinct face_id, stashdb_id from performer_match) select m.face_id, bool_or(list_contains(s.performer_ids, cast(p.performer_id as varchar))) as tagged from m join {_LATEST} p on p.stash_box_id = m.stashdb_id join (select distinct id, stash_scene_id from scene_face_embeddings) e on e.id = m.face_id join {_SCENES} s on s.scene_id = cast(e.stash_scene_id as varchar) group by 1")
def _(t):
    m = t("performer_match").select("face_id", F.col("stashdb_id").alias("stash_box_id")).distinct().join(latest(t).select("stash_box_id", "performer_id"), "stash_box_id")
    e = t("scene_face_embeddings").select(F.col("id").alias("face_id"), F.col("stash_scene_id").cast("string").alias("scene_id")).distinct()
    return m.join(e, "face_id").join(scenes(t).select("scene_id", "performer_ids"), "scene_id").groupBy("face_id").agg(F.bool_or(F.expr("array_contains(performer_ids, cast(performer_id as string))")).alias("tagged"))


@q.add("x14_yield_test", f"select r.id from {_REC} r where r.status = 'resolved' and exists (select 1 from {_REC} w where w.status = 'pending' and w.type = r.type and w.created_at < r.created_at)")
def _(t):
    first = recs(t).where("status = 'pending'").groupBy("type").agg(F.min("created_at").alias("first"))
    return recs(t).where("status = 'resolved'").join(first, "type").where("first < created_at").select("id")


@q.add("x18_preselected", f"{_VOTE} select stash_scene_id, stashdb_id from m group by all having count(distinct frame_index) > 2 and 1 - min(distance) >= 0.1")
def _(t):
    return votes(t).groupBy("stash_scene_id", "stashdb_id").agg(F.countDistinct("frame_index").alias("f"), F.min("distance").alias("d")).where("f > 2 and 1 - d >= 0.1").select("stash_scene_id", "stashdb_id")


@q.add("x19_name_conflicts", "with s as (select distinct id, lower(trim(name)) n, coalesce(lower(trim(disambiguation)), '') d from search_performer where deleted_at is null) select distinct a.id as a, b.id as b from s a join s b on a.n = b.n and a.d = b.d and a.id < b.id")
def _(t):
    s = t("search_performer").where("deleted_at is null").select("id", F.lower(F.trim("name")).alias("n"), F.coalesce(F.lower(F.trim("disambiguation")), F.lit("")).alias("d")).distinct()
    return s.toDF("a", "n", "d").join(s.toDF("b", "n", "d"), ["n", "d"]).where("a < b").select("a", "b").distinct()


@q.add("x21_scene_scoped", f"select id, case when status = 'pending' and trim(split_part(target_id, '|', 1)) = '1000' and type <> 'duplicate_scenes' then 'dismissed' else status end as status from {_REC}")
def _(t):
    hit = (F.col("status") == "pending") & (F.trim(F.substring_index("target_id", "|", 1)) == "1000") & (F.col("type") != "duplicate_scenes")
    return state.update_where(recs(t), hit, status=F.lit("dismissed")).select("id", "status")


@q.add("x26_invalidated", f"select stash_box_id from {_LATEST} where not (endpoint = 'https://tidebox.example/graphql' and snapshot_no <= 3)")
def _(t):
    return latest(t).where(~((F.col("endpoint") == "https://tidebox.example/graphql") & (F.col("snapshot_no") <= 3))).select("stash_box_id")


@q.add("x31_children", "select performer_id, list_sort(list(distinct id)) as face_ids from faces where performer_id is not null group by 1")
def _(t):
    return t("faces").where("performer_id is not null").groupBy("performer_id").agg(F.array_sort(F.collect_set("id")).alias("face_ids"))


@q.add("x34_pooled_names", f"select performer_id, arg_min(name, stash_box_id) as display_name, count(distinct stash_box_id) as entries from {_LATEST} group by 1")
def _(t):
    return latest(t).groupBy("performer_id").agg(F.min_by("name", "stash_box_id").alias("display_name"), F.countDistinct("stash_box_id").alias("entries"))


QUERIES, SQL = q.QUERIES, q.SQL
