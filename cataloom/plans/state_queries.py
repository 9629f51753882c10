"""Record-state operators, resolution cascades and accuracy metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cataloom.functions import scalars as S
from cataloom.operators import changes, state
from cataloom.plans.registry import Queries
from cataloom.plans.relational_queries import _LATEST, _REC, _SCENES, _SURE, _UID, _VOTE, latest, recs, scenes, sure, uid, votes

q = Queries()
_FACES = "(select distinct * from faces)"


@q.add("w1_insert_ignore", "select type, target_id from (select distinct type, trim(target_id) target_id from recommendations) union select 'face_match', cast(face_id as varchar) from performer_match")
def _(t):
    held = t("recommendations").select("type", F.trim("target_id").alias("target_id")).distinct()
    new = t("performer_match").select(F.lit("face_match").alias("type"), F.col("face_id").cast("string").alias("target_id"))
    return state.insert_ignore(held, new, ["type", "target_id"])


@q.add("w2_upserted_faces", f"with n as (select id, performer_id, image_sha256 from face_change where lower(trim(op)) not in ('delete', 'deleted', 'd', 'del', 'remove', 'removed') qualify row_number() over (partition by id order by change_seq desc) = 1) select coalesce(n.id, f.id) as id, case when n.id is null then f.performer_id else n.performer_id end as performer_id, f.gender from {_FACES} f full join n on n.id = f.id")
def _(t):
    order = Window.partitionBy("id").orderBy(F.desc("change_seq"))
    n = t("face_change").where(~changes.is_delete(F.col("op"))).withColumn("r", F.row_number().over(order)).where("r = 1").select("id", "performer_id", F.lit(None).cast("string").alias("gender"))
    return state.upsert(t("faces").distinct().select("id", "performer_id", "gender"), n, ["id"], keep=["gender"])


@q.add("w3_forward_marks", "select id, max(s) as seq from (select id, last_change_seq s from faces union all select id, change_seq from face_change) group by id")
def _(t):
    return state.push_forward(t("faces").select("id", F.col("last_change_seq").alias("seq")), t("face_change").select("id", F.col("change_seq").alias("seq")), ["id"], "seq")


@q.add("w4_replaced_matches", "select face_id, match_id, stashdb_id from performer_match where face_id not in (select face_id from performer_match where matched_at >= timestamp '2024-10-01') union select face_id, match_id, stashdb_id from performer_match where matched_at >= timestamp '2024-10-01'")
def _(t):
    m = t("performer_match").select("face_id", "match_id", "stashdb_id", "matched_at").distinct()
    new = m.where(F.col("matched_at") >= F.lit("2024-10-01").cast("timestamp_ntz")).drop("matched_at")
    return state.replace_keys(m.drop("matched_at"), new, "face_id").distinct()


@q.add("w5_dismissed_low", f"select id, case when status = 'pending' and {_SURE} < 0.5 then 'dismissed' else status end as status from {_REC}")
def _(t):
    return state.update_where(recs(t), (F.col("status") == "pending") & (sure() < 0.5), status=F.lit("dismissed")).select("id", "status")


@q.add("w6_purged_scenes", f"select distinct id from scene_face_embeddings where stash_scene_id not in (select cast(scene_id as bigint) from {_SCENES} where deleted_at is not null)")
def _(t):
    gone = scenes(t).where("deleted_at is not null").select(F.col("scene_id").cast("long").alias("stash_scene_id"))
    return state.delete_keys(t("scene_face_embeddings").select("id", "stash_scene_id").distinct(), gone, "stash_scene_id").select("id").distinct()


@q.add("w7_backup_counts", "select count(*) as n from performer_match")
def _(t):
    kept, n = state.backup(t("performer_match"), "backup")
    return kept.agg(F.count("*").alias("n"))


@q.add("w8_positional_faces", "select g.i as embedding_index, f.performer_id from (select unnest(generate_series(0, (select max(embedding_index) from faces))) i) g left join (select distinct embedding_index, performer_id from faces) f on f.embedding_index = g.i")
def _(t):
    return state.positional(t("faces"), "embedding_index", "performer_id")


@q.add("pred14_needs_work", f"select s.scene_id, case when e.n is null then 'missing' when e.last < s.updated_at then 'stale' else 'done' end as work from {_SCENES} s left join (select cast(stash_scene_id as varchar) k, count(*) n, max(created_at) last from scene_face_embeddings group by 1) e on e.k = s.scene_id")
def _(t):
    e = t("scene_face_embeddings").groupBy(F.col("stash_scene_id").cast("string").alias("scene_id")).agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    return scenes(t).select("scene_id", "updated_at").join(e, "scene_id", "left").select("scene_id", F.when(F.col("n").isNull(), "missing").when(F.col("last") < F.col("updated_at"), "stale").otherwise("done").alias("work"))


@q.add("pred17_stale_caches", f"with m as (select stash_scene_id, max(timestamp_sec) last from scene_face_embeddings group by 1) select s.scene_id, m.last > s.duration_seconds + 1 or s.duration_seconds > 2 * m.last / 0.95 as stale from {_SCENES} s join m on cast(m.stash_scene_id as varchar) = s.scene_id where m.last is not null and s.duration_seconds is not null")
def _(t):
    m = t("scene_face_embeddings").groupBy(F.col("stash_scene_id").cast("string").alias("scene_id")).agg(F.max("timestamp_sec").alias("last"))
    d, last = F.col("duration_seconds"), F.col("last")
    return scenes(t).join(m, "scene_id").where("last is not null and duration_seconds is not null").select("scene_id", ((last > d + 1) | (d > 2 * last / 0.95)).alias("stale"))


_TWO = "with s as (select * from performer_snapshot qualify row_number() over (partition by snapshot_no, stash_box_id order by loaded_at desc) = 1), c as (select n.stash_box_id, coalesce(lower(trim(n.hair_color)), '') <> coalesce(lower(trim(o.hair_color)), '') h, coalesce(lower(trim(n.country)), '') <> coalesce(lower(trim(o.country)), '') c, coalesce(list_sort(list_distinct(list_transform(n.urls, lambda u: lower(trim(u))))), []) <> coalesce(list_sort(list_distinct(list_transform(o.urls, lambda u: lower(trim(u))))), []) u from s n join s o on n.stash_box_id = o.stash_box_id where n.snapshot_no = 4 and o.snapshot_no = 1)"


def _field_changes(t):
    order = Window.partitionBy("snapshot_no", "stash_box_id").orderBy(F.desc("loaded_at"))
    s = t("performer_snapshot").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    low = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    p = s.select("snapshot_no", "stash_box_id", low("hair_color").alias("h"), low("country").alias("c"), F.coalesce(F.array_sort(F.array_distinct(F.transform("urls", lambda u: F.lower(F.trim(u))))), F.array().cast("array<string>")).alias("u"))
    n, o = (p.where(F.col("snapshot_no") == k).select("stash_box_id", F.struct("h", "c", "u").alias(a)) for k, a in ((4, "n"), (1, "o")))
    return n.join(o, "stash_box_id").select("stash_box_id", *[(F.col(f"n.{c}") != F.col(f"o.{c}")).alias(c) for c in "hcu"])


@q.add("pred18_real_changes", f"{_TWO} select stash_box_id from c where h or c or u")
def _(t):
    return _field_changes(t).where("h or c or u").select("stash_box_id")


@q.add("pred20_only_urls_changed", f"{_TWO} select stash_box_id from c where u and not h and not c")
def _(t):
    return _field_changes(t).where("u and not h and not c").select("stash_box_id")


@q.add("pred23_valid_scenes", f"with k as (select scene_id, unnest(performer_ids) p from {_SCENES} where len(performer_ids) >= 2) select scene_id from k group by 1 having bool_and(p in (select cast(performer_id as varchar) from performer_snapshot))")
def _(t):
    known = t("performer_snapshot").select(F.col("performer_id").cast("string").alias("p")).distinct().withColumn("known", F.lit(True))
    k = scenes(t).where("size(performer_ids) >= 2").select("scene_id", F.explode("performer_ids").alias("p"))
    return k.join(known, "p", "left").groupBy("scene_id").agg(F.bool_and(F.col("known").isNotNull()).alias("ok")).where("ok").select("scene_id")


@q.add("j16_first_linked", f"with l as (select scene_id, p, pos from (select scene_id, performer_ids from {_SCENES}) s, unnest(performer_ids) with ordinality as u(p, pos)), k as (select distinct cast(performer_id as varchar) p, name from {_LATEST}) select l.scene_id, arg_min(k.name, l.pos) as first_name from l join k using (p) group by 1")
def _(t):
    l = scenes(t).select("scene_id", F.posexplode("performer_ids").alias("pos", "p"))
    k = latest(t).select(F.col("performer_id").cast("string").alias("p"), "name").distinct()
    return l.join(k, "p").groupBy("scene_id").agg(F.min_by("name", "pos").alias("first_name"))


@q.add("j20_identity_cascade", f"with s as (select distinct id, name, stash_ids from search_performer), by_id as (select distinct s.id from (select id, unnest(stash_ids) k from s) s join {_LATEST} p on p.stash_box_id = s.k.stash_id), names as (select lower(trim(name)) k, stash_box_id from {_LATEST} union select lower(trim(x)), stash_box_id from (select stash_box_id, unnest(alias_list) x from {_LATEST})), by_name as (select s.id, count(distinct n.stash_box_id) n from s join names n on n.k = lower(trim(s.name)) group by 1) select s.id, case when i.id is not null then 'hard' when b.n = 1 then 'name' when b.n > 1 then 'ambiguous' else 'none' end as resolution from (select distinct id from s) s left join by_id i on i.id = s.id left join by_name b on b.id = s.id")
def _(t):
    s, p = t("search_performer"), latest(t)
    by_id = s.select("id", F.explode("stash_ids").alias("k")).select("id", F.col("k.stash_id").alias("stash_box_id")).join(p.select("stash_box_id"), "stash_box_id").select("id").distinct().withColumn("hard", F.lit(True))
    names = p.select(F.lower(F.trim("name")).alias("k"), "stash_box_id").union(p.select(F.explode("alias_list").alias("x"), "stash_box_id").select(F.lower(F.trim("x")), "stash_box_id")).distinct()
    by_name = s.select("id", F.lower(F.trim("name")).alias("k")).distinct().join(names, "k").groupBy("id").agg(F.countDistinct("stash_box_id").alias("n"))
    every = s.select("id").distinct().join(by_id, "id", "left").join(by_name, "id", "left")
    return every.select("id", F.when(F.col("hard"), "hard").when(F.col("n") == 1, "name").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("resolution"))


@q.add("a18_match_scores", "select face_id, stashdb_id, count(*) as matched, bool_or(match_rank = 1) as any_first, count(*) filter (distance <= 0.2) as near from (select distinct match_id, face_id, stashdb_id, match_rank, distance from performer_match) group by all")
def _(t):
    m = t("performer_match").select("match_id", "face_id", "stashdb_id", "match_rank", "distance").distinct()
    return m.groupBy("face_id", "stashdb_id").agg(F.count("*").alias("matched"), F.bool_or(F.col("match_rank") == 1).alias("any_first"), F.count_if(F.col("distance") <= 0.2).alias("near"))


_SIG = f"{_VOTE}, g as (select stash_scene_id s, stashdb_id p, count(*) n from m group by all), f as (select s, p, n / sum(n) over (partition by s) r, count(*) over (partition by s) c from g)"


@q.add("k15_face_signatures", f"{_SIG} select a.s as a, b.s as b, count(*) as shared, round(least(75, 60 * count(*) / (max(a.c) + max(b.c) - count(*)) + greatest(0, 15 * (1 - 4 * avg(abs(a.r - b.r))))), 3) as score from f a join f b on a.p = b.p and a.s < b.s group by all")
def _(t):
    from cataloom.operators.scoring import face_score

    g = votes(t).groupBy(F.col("stash_scene_id").alias("s"), F.col("stashdb_id").alias("p")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("s")
    f = g.select("s", "p", (F.col("n") / F.sum("n").over(w)).alias("r"), F.count("*").over(w).alias("c"))
    j = f.toDF("a", "p", "ra", "ca").join(f.toDF("b", "p", "rb", "cb"), "p").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("ca").alias("ca"), F.max("cb").alias("cb"), F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("d"))
    return j.select("a", "b", "shared", F.round(face_score(F.col("shared") / (F.col("ca") + F.col("cb") - F.col("shared")), F.col("d")), 3).alias("score"))


_MAJ = "with v as (select doc_id, rater, max(toxic) t from labels group by all), m as (select doc_id, avg(t) p from v group by 1 having avg(t) <> 0.5)"


@q.add("a24_rater_accuracy", f"{_MAJ} select rater, count(*) filter (t = 1 and p > 0.5) as tp, count(*) filter (t = 1 and p < 0.5) as fp, count(*) filter (t = 0 and p > 0.5) as fn, round(count(*) filter ((t = 1) = (p > 0.5)) / count(*), 6) as accuracy from v join m using (doc_id) group by 1")
def _(t):
    v = t("labels").groupBy("doc_id", "rater").agg(F.max("toxic").alias("t"))
    m = v.groupBy("doc_id").agg(F.avg("t").alias("p")).where("p <> 0.5")
    j = v.join(m, "doc_id")
    c = lambda e: F.count_if(F.expr(e))
    return j.groupBy("rater").agg(c("t = 1 and p > 0.5").alias("tp"), c("t = 1 and p < 0.5").alias("fp"), c("t = 0 and p > 0.5").alias("fn"), F.round(c("(t = 1) = (p > 0.5)") / F.count("*"), 6).alias("accuracy"))


@q.add("a25_accuracy_by_language", f"{_MAJ} select coalesce(lower(d.lang), 'none') as lang, count(*) as votes, round(count(*) filter ((t = 1) = (p > 0.5)) / count(*), 6) as accuracy from v join m using (doc_id) join documents d using (doc_id) group by 1")
def _(t):
    v = t("labels").groupBy("doc_id", "rater").agg(F.max("toxic").alias("t"))
    m = v.groupBy("doc_id").agg(F.avg("t").alias("p")).where("p <> 0.5")
    j = v.join(m, "doc_id").join(t("documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy(F.coalesce(F.lower("lang"), F.lit("none")).alias("lang")).agg(F.count("*").alias("votes"), F.round(F.count_if(F.expr("(t = 1) = (p > 0.5)")) / F.count("*"), 6).alias("accuracy"))


@q.add("a39_hits_in_top", "with m as (select distinct face_id, stashdb_id, match_rank from performer_match), b as (select face_id, arg_min(stashdb_id, (distance, match_id)) best from performer_match where distance is not null group by 1) select count(*) filter (match_rank <= 1) as top1, count(*) filter (match_rank <= 3) as top3, count(*) as listed from m join b on b.face_id = m.face_id and b.best = m.stashdb_id")
def _(t):
    m = t("performer_match").select("face_id", "stashdb_id", "match_rank").distinct()
    b = t("performer_match").where("distance is not null").groupBy("face_id").agg(F.min_by("stashdb_id", F.struct("distance", "match_id")).alias("stashdb_id"))
    return m.join(b, ["face_id", "stashdb_id"]).agg(F.count_if(F.col("match_rank") <= 1).alias("top1"), F.count_if(F.col("match_rank") <= 3).alias("top3"), F.count("*").alias("listed"))


_DIS = "select distinct try_cast(split_part(trim(target_id), ':', 1) as bigint) a, try_cast(split_part(trim(target_id), ':', 2) as bigint) b from recommendations where type = 'duplicate_scenes' and status = 'dismissed' and regexp_full_match(trim(target_id), '[0-9]+:[0-9]+')"


def _dismissed(t):
    r = t("recommendations").where((F.col("type") == "duplicate_scenes") & (F.col("status") == "dismissed") & F.trim("target_id").rlike("^[0-9]+:[0-9]+$"))
    return r.select(F.split(F.trim("target_id"), ":").alias("s")).select(F.col("s")[0].cast("long").alias("a"), F.col("s")[1].cast("long").alias("b")).distinct()


@q.add("a32_dismissed_closure", f"with recursive d as ({_DIS}), e as (select a, b from d union select b, a from d), reach as (select a n, b r from e union select q.n, e.b from reach q join e on e.a = q.r) select distinct n as a, r as b from reach where n < r")
def _(t):
    return state.closure_pairs(_dismissed(t))


@q.add("a33_neighbour_closure", f"with d as ({_DIS}), e as (select a, b from d union select b, a from d), p as (select distinct x.b a, y.b b from e x join e y on x.a = y.a and x.b < y.b) select a, b from p where not exists (select 1 from e where e.a = p.a and e.b = p.b)")
def _(t):
    d = _dismissed(t)
    e = d.union(d.select("b", "a")).distinct()
    p = e.toDF("hub", "a").join(e.toDF("hub", "b"), "hub").where("a < b").select("a", "b").distinct()
    return p.join(e, ["a", "b"], "left_anti")


@q.add("a35_adjacency", f"with d as ({_DIS}), l as (select s.id a, p.performer_id b from (select id, unnest(stash_ids) k from search_performer) s join {_LATEST} p on p.stash_box_id = s.k.stash_id) select a, b from d union select b, a from d union select a, b from l union select b, a from l")
def _(t):
    d = _dismissed(t)
    s = t("search_performer").select("id", F.explode("stash_ids").alias("k")).select(F.col("id").alias("a"), F.col("k.stash_id").alias("stash_box_id"))
    l = s.join(latest(t).select("stash_box_id", F.col("performer_id").alias("b")), "stash_box_id").select("a", "b")
    return d.unionByName(l).union(d.select("b", "a")).union(l.select("b", "a")).distinct()


@q.add("k24_version_chain", "with recursive c as (select 1 as step, 1 as version union all select step + 1, version + 1 from c where version < (select max(snapshot_no) from performer_snapshot)) select version from c where version > 1")
def _(t):
    n = t("performer_snapshot").select("snapshot_no").distinct().where("snapshot_no > 1").select((F.col("snapshot_no") - 1).cast("string").alias("source"), F.col("snapshot_no").cast("string").alias("version"))
    goal = t("performer_snapshot").agg(F.max("snapshot_no")).first()[0]
    chain = state.version_chain(n, "1", str(goal)) or []
    return n.sparkSession.createDataFrame([(int(v),) for v in chain], "version int")


@q.add("k25_dirty_performers", f"with o as (select distinct id, performer_id from faces), n as (select id, performer_id from face_change where performer_id is not null) select performer_id from n union select o.performer_id from o where id in (select id from face_change)")
def _(t):
    c = t("face_change")
    old = t("faces").join(c.select("id").distinct(), "id", "left_semi").select("performer_id")
    return c.where("performer_id is not null").select("performer_id").union(old).distinct()


@q.add("k27_quality_scores", "select id, cast(greatest(bbox.w * bbox.h, 0) // 1000 + cast(floor(confidence * 100) as bigint) + case when is_sprite then 0 else 50 end as bigint) as score from (select distinct id, bbox, confidence, is_sprite from scene_face_embeddings)")
def _(t):
    f = t("scene_face_embeddings").select("id", "bbox", "confidence", "is_sprite").distinct()
    return f.select("id", (F.expr("greatest(bbox.w * bbox.h, 0) div 1000") + F.floor(F.col("confidence") * 100) + F.when(F.col("is_sprite"), 0).otherwise(50)).cast("long").alias("score"))


@q.add("k29_merged_aliases", f"select performer_id, list_sort(list_distinct(list_filter(flatten(list(list_append(alias_list, name))), lambda x: x is not null))) as names from {_LATEST} group by 1")
def _(t):
    p = latest(t)
    return p.groupBy("performer_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.concat("alias_list", F.array("name"))))))).alias("names"))


@q.add("k30_face_counts", f"select p.performer_id, count(distinct f.id) as faces from (select distinct performer_id from {_LATEST}) p left join faces f using (performer_id) group by 1")
def _(t):
    return latest(t).select("performer_id").distinct().join(t("faces").select("id", "performer_id"), "performer_id", "left").groupBy("performer_id").agg(F.countDistinct("id").alias("faces"))


@q.add("k36_pending_scenes", f"select s.scene_id, case when e.k is null then 'new' else 'refresh' end as kind from {_SCENES} s left join (select distinct cast(stash_scene_id as varchar) k from scene_face_embeddings) e on e.k = s.scene_id where s.deleted_at is null")
def _(t):
    e = t("scene_face_embeddings").select(F.col("stash_scene_id").cast("string").alias("scene_id")).distinct().withColumn("k", F.lit(1))
    return scenes(t).where("deleted_at is null").select("scene_id").join(e, "scene_id", "left").select("scene_id", F.when(F.col("k").isNull(), "new").otherwise("refresh").alias("kind"))


@q.add("x1_coverage_buckets", f"with n as (select p.performer_id, count(distinct f.id) c from (select distinct performer_id from {_LATEST}) p left join faces f using (performer_id) group by 1) select case when c = 0 then 'none' when c < 5 then 'few' else 'many' end as bucket, count(*) as performers from n group by 1")
def _(t):
    n = latest(t).select("performer_id").distinct().join(t("faces").select("id", "performer_id"), "performer_id", "left").groupBy("performer_id").agg(F.countDistinct("id").alias("c"))
    return n.groupBy(F.when(F.col("c") == 0, "none").when(F.col("c") < 5, "few").otherwise("many").alias("bucket")).agg(F.count("*").alias("performers"))


@q.add("x2_presence_overlap", f"select count(*) filter (len(urls) > 0 and len(alias_list) > 0) as both_there, count(*) filter (len(urls) > 0 and coalesce(len(alias_list), 0) = 0) as urls_only, count(*) filter (coalesce(len(urls), 0) = 0 and len(alias_list) > 0) as aliases_only from {_LATEST}")
def _(t):
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    u, a = n("urls"), n("alias_list")
    return latest(t).agg(F.count_if(u & a).alias("both_there"), F.count_if(u & ~a).alias("urls_only"), F.count_if(~u & a).alias("aliases_only"))


@q.add("x8_picked_faces", "with f as (select distinct id, stash_scene_id, bbox.w * bbox.h area, confidence c from scene_face_embeddings), l as (select stash_scene_id, arg_max(id, (area, -id)) big, arg_max(c, (area, -id)) bc, arg_max(id, (c, -id)) best, max(c) mc from f group by 1) select stash_scene_id, case when mc >= bc + 0.3 then best else big end as id from l")
def _(t):
    f = t("scene_face_embeddings").select("id", "stash_scene_id", (F.col("bbox.w") * F.col("bbox.h")).alias("area"), F.col("confidence").alias("c")).distinct()
    by_area, by_c = F.struct("area", -F.col("id")), F.struct("c", -F.col("id"))
    l = f.groupBy("stash_scene_id").agg(F.max_by("id", by_area).alias("big"), F.max_by("c", by_area).alias("bc"), F.max_by("id", by_c).alias("best"), F.max("c").alias("mc"))
    return l.select("stash_scene_id", F.when(F.col("mc") >= F.col("bc") + 0.3, F.col("best")).otherwise(F.col("big")).alias("id"))


@q.add("x9_disambiguations", f"select distinct m.stashdb_id, coalesce(p.disambiguation, '') as disambiguation from performer_match m left join {_LATEST} p on p.stash_box_id = m.stashdb_id")
def _(t):
    m = t("performer_match").select(F.col("stashdb_id").alias("stash_box_id")).distinct()
    return m.join(latest(t).select("stash_box_id", "disambiguation"), "stash_box_id", "left").select(F.col("stash_box_id").alias("stashdb_id"), F.coalesce("disambiguation", F.lit("")).alias("disambiguation"))


@q.add("x12_cleanup_of_scene", f"select id from {_REC} where len(list_filter(list_transform(string_split_regex(coalesce(target_id, ''), '[:|]'), lambda x: trim(x)), lambda x: x = '1000')) > 0")
def _(t):
    return recs(t).where(F.array_contains(F.transform(F.split(F.coalesce("target_id", F.lit("")), "[:|]"), lambda x: F.trim(x)), "1000")).select("id")


@q.add("x13_rebuilt_results", "select face_id, list(stashdb_id order by match_rank, match_id) as ranked from (select distinct face_id, match_id, match_rank, stashdb_id from performer_match) group by 1")
def _(t):
    m = t("performer_match").select("face_id", "match_id", "match_rank", "stashdb_id").distinct()
    return m.groupBy("face_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("match_rank", "match_id", "stashdb_id"))), lambda s: s["stashdb_id"]).alias("ranked"))


@q.add("x16_retention", "select distinct match_id from performer_match where match_id not in (select match_id from (select distinct match_id, face_id, matched_at from performer_match) qualify row_number() over (partition by face_id order by matched_at desc, match_id desc) <= 2)")
def _(t):
    m = t("performer_match").select("match_id", "face_id", "matched_at").distinct()
    kept = m.withColumn("r", F.row_number().over(Window.partitionBy("face_id").orderBy(F.desc("matched_at"), F.desc("match_id")))).where("r <= 2").select("match_id")
    return m.select("match_id").distinct().join(kept, "match_id", "left_anti")


@q.add("x20_dismissed_types", f"select id, case when type = 'duplicate_scene_files' and status = 'pending' then 'dismissed' else status end as status from {_REC}")
def _(t):
    return state.update_where(recs(t), (F.col("type") == "duplicate_scene_files") & (F.col("status") == "pending"), status=F.lit("dismissed")).select("id", "status")


@q.add("x22_reopened", f"select id, case when status = 'dismissed' and {_SURE} >= 0.8 then 'pending' else status end as status from {_REC}")
def _(t):
    return state.update_where(recs(t), (F.col("status") == "dismissed") & (sure() >= 0.8), status=F.lit("pending")).select("id", "status")


@q.add("x23_scene_pairs", f"select id, try_cast(trim(split_part(target_id, ':', 1)) as bigint) as a, try_cast(trim(split_part(target_id, ':', 2)) as bigint) as b from {_REC} where type = 'duplicate_scenes' and regexp_full_match(trim(split_part(target_id, ':', 1)), '[0-9]+') and regexp_full_match(trim(split_part(target_id, ':', 2)), '[0-9]+') and len(string_split(target_id, ':')) = 2")
def _(t):
    s = F.split("target_id", ":")
    r = recs(t).where((F.col("type") == "duplicate_scenes") & (F.size(s) == 2) & F.trim(s[0]).rlike("^[0-9]+$") & F.trim(s[1]).rlike("^[0-9]+$"))
    return r.select("id", F.trim(s[0]).cast("long").alias("a"), F.trim(s[1]).cast("long").alias("b"))


@q.add("x24_run_log", f"select source_analysis_id, min(created_at) as started, max(updated_at) as last, count(*) as made, count(*) filter (status = 'resolved') as resolved from {_REC} group by 1")
def _(t):
    return recs(t).groupBy("source_analysis_id").agg(F.min("created_at").alias("started"), F.max("updated_at").alias("last"), F.count("*").alias("made"), F.count_if(F.col("status") == "resolved").alias("resolved"))


@q.add("x27_frames_by_kind", "select stash_scene_id, count(distinct id) filter (is_sprite) as sprites, count(distinct id) filter (not is_sprite) as frames from scene_face_embeddings group by 1")
def _(t):
    return t("scene_face_embeddings").groupBy("stash_scene_id").agg(F.countDistinct(F.when(F.col("is_sprite"), F.col("id"))).alias("sprites"), F.countDistinct(F.when(~F.col("is_sprite"), F.col("id"))).alias("frames"))


@q.add("x33_identity_keys", "select face_id, min(stashdb_id) as identity_key, count(distinct stashdb_id) as members from performer_match group by 1")
def _(t):
    return t("performer_match").groupBy("face_id").agg(F.min("stashdb_id").alias("identity_key"), F.countDistinct("stashdb_id").alias("members"))


@q.add("x37_identity_veto", "with s as (select distinct id, unnest(stash_ids) k from search_performer) select distinct a.id as a, b.id as b, bool_or(a.k.stash_id = b.k.stash_id) as same, bool_or(a.k.stash_id <> b.k.stash_id) and not bool_or(a.k.stash_id = b.k.stash_id) as veto from s a join s b on a.id + 1 = b.id and a.k.endpoint = b.k.endpoint group by all")
def _(t):
    s = t("search_performer").select("id", F.explode("stash_ids").alias("k")).distinct().select("id", F.col("k.endpoint").alias("e"), F.col("k.stash_id").alias("s"))
    j = s.toDF("a", "e", "sa").join(s.toDF("b", "e", "sb"), "e").where("a + 1 = b").groupBy("a", "b").agg(F.bool_or(F.col("sa") == F.col("sb")).alias("same"), F.bool_or(F.col("sa") != F.col("sb")).alias("other"))
    return j.select("a", "b", "same", (F.col("other") & ~F.col("same")).alias("veto"))


QUERIES, SQL = q.QUERIES, q.SQL
