"""Relational operators over the recommendation log, the catalogue and the faces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cataloom.functions import scalars as S
from cataloom.plans.registry import Queries

q = Queries()

_REC = "(select distinct * from recommendations)"
_UID = "json_extract_string(details, '$.universal_id')"
_SURE = "coalesce(case when confidence > 1 then confidence / 100 else confidence end, try_cast(json_extract_string(details, '$.confidence') as double) / 100)"


def recs(t):
    return t("recommendations").distinct()


def uid():
    return F.get_json_object("details", "$.universal_id")


def sure():
    told = F.get_json_object("details", "$.confidence").try_cast("double") / 100
    return F.coalesce(F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence")), told)


def scenes(t):
    """One row per scene id: a live one before a deleted one, then the latest."""
    order = Window.partitionBy("scene_id").orderBy(F.col("deleted_at").isNotNull(), F.col("updated_at").desc(), F.col("created_at").desc())
    return t("scene").distinct().withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


_SCENES = "(select * from (select distinct * from scene) qualify row_number() over (partition by scene_id order by deleted_at is not null, updated_at desc, created_at desc) = 1)"


def latest(t):
    """The latest snapshot row of every performer."""
    order = Window.partitionBy("stash_box_id").orderBy(F.desc("snapshot_no"), F.desc("loaded_at"))
    return t("performer_snapshot").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


_LATEST = "(select * from performer_snapshot qualify row_number() over (partition by stash_box_id order by snapshot_no desc, loaded_at desc) = 1)"


# ---- scans and predicates


@q.add("s3_ordered_scan", "select distinct id, name from search_performer")
def _(t):
    return t("search_performer").select("id", "name").distinct().orderBy("id")


@q.add("s4_with_faces", "select performer_id, count(distinct id) as faces from faces group by 1 having count(distinct id) > 0")
def _(t):
    return t("faces").groupBy("performer_id").agg(F.countDistinct("id").alias("faces")).where("faces > 0")


@q.add("s5_point_lookup", "select distinct id, name from search_performer where id = 320")
def _(t):
    return t("search_performer").where("id = 320").select("id", "name").distinct()


@q.add("s9_changed_since", "select distinct scene_id, updated_at from scene where updated_at > timestamp '2024-06-01'")
def _(t):
    return t("scene").where(F.col("updated_at") > F.lit("2024-06-01").cast("timestamp_ntz")).select("scene_id", "updated_at").distinct()


@q.add("s10_no_performers", "select distinct scene_id from scene where len(performer_ids) = 0")
def _(t):
    return t("scene").where(F.size("performer_ids") == 0).select("scene_id").distinct()


@q.add("s11_on_endpoint", "select distinct id from search_performer where len(list_filter(stash_ids, lambda s: s.endpoint = 'https://boxnorth.example/graphql')) > 0")
def _(t):
    return t("search_performer").where(F.exists("stash_ids", lambda s: s["endpoint"] == "https://boxnorth.example/graphql")).select("id").distinct()


@q.add("pred1_filters", f"select id, target_id from {_REC} where status = 'pending' and type = 'duplicate_scenes'")
def _(t):
    out = recs(t)
    for column, wanted in (("status", "pending"), ("type", "duplicate_scenes"), ("target_type", None)):
        out = out.where(F.col(column) == wanted) if wanted is not None else out
    return out.select("id", "target_id")


@q.add("pred2_null_safe_difference", "select distinct id from search_performer where disambiguation is distinct from 'Ysterby'")
def _(t):
    return t("search_performer").where(~F.col("disambiguation").eqNullSafe("Ysterby")).select("id").distinct()


@q.add("pred3_in_list", f"select type, count(*) as n from {_REC} where status in ('dismissed', 'resolved') group by type")
def _(t):
    return recs(t).where(F.col("status").isin("dismissed", "resolved")).groupBy("type").agg(F.count("*").alias("n"))


@q.add("pred4_not_in_list", f"select id from {_REC} where type not in ('duplicate_scenes', 'scene_face_match')")
def _(t):
    return recs(t).where(~F.col("type").isin("duplicate_scenes", "scene_face_match")).select("id")


@q.add("pred5_target_prefix", f"select id from {_REC} where trim(split_part(target_id, '|', 1)) = '1000'")
def _(t):
    return recs(t).where(F.trim(F.substring_index("target_id", "|", 1)) == "1000").select("id")


@q.add("pred6_name_contains", "select distinct id, name from search_performer where name ilike '%el%'")
def _(t):
    return t("search_performer").where(F.col("name").ilike("%el%")).select("id", "name").distinct()


@q.add("pred7_alias_equals", "with a as (select distinct stash_box_id, unnest(alias_list) x from performer_snapshot), s as (select distinct id, name from search_performer) select distinct s.id, a.stash_box_id from s join a on lower(s.name) = lower(a.x)")
def _(t):
    a = t("performer_snapshot").select("stash_box_id", F.explode("alias_list").alias("x")).select("stash_box_id", F.lower("x").alias("k")).distinct()
    return t("search_performer").select("id", F.lower("name").alias("k")).distinct().join(a, "k").select("id", "stash_box_id").distinct()


@q.add("pred8_json_path", f"select id, {_UID} as universal_id from {_REC} where {_UID} is not null")
def _(t):
    return recs(t).where(uid().isNotNull()).select("id", uid().alias("universal_id"))


@q.add("pred9_orphan_performers", "select distinct performer_id from faces f where not exists (select 1 from performer_snapshot p where p.performer_id = f.performer_id)")
def _(t):
    return t("faces").select("performer_id").distinct().join(t("performer_snapshot"), "performer_id", "left_anti")


@q.add("pred10_counts_per_key", "select p.performer_id, (select count(distinct id) from faces f where f.performer_id = p.performer_id) as faces from (select distinct performer_id from performer_snapshot) p")
def _(t):
    n = t("faces").groupBy("performer_id").agg(F.countDistinct("id").alias("faces"))
    return t("performer_snapshot").select("performer_id").distinct().join(n, "performer_id", "left").na.fill(0, ["faces"])


@q.add("pred12_created_on", f"select id from {_REC} where cast(created_at as date) = date '2024-05-01'")
def _(t):
    return recs(t).where(F.to_date("created_at") == F.lit("2024-05-01").cast("date")).select("id")


@q.add("pred13_due", f"select id from {_REC} where status = 'pending' and (resolved_at is null or resolved_at <= timestamp '2024-09-01')")
def _(t):
    return recs(t).where((F.col("status") == "pending") & (F.col("resolved_at").isNull() | (F.col("resolved_at") <= F.lit("2024-09-01").cast("timestamp_ntz")))).select("id")


@q.add("pred16_length_matches", f"select a.scene_id as a, b.scene_id as b, a.duration_seconds is null or b.duration_seconds is null or abs(a.duration_seconds - b.duration_seconds) <= greatest(1.0, 0.005 * greatest(a.duration_seconds, b.duration_seconds)) as same from {_SCENES} a join {_SCENES} b on a.studio_id = b.studio_id and a.date = b.date and a.scene_id < b.scene_id")
def _(t):
    s = scenes(t).select("scene_id", "studio_id", "date", "duration_seconds")
    a, b = s.alias("x"), s.alias("y")
    j = a.join(b, (F.col("x.studio_id") == F.col("y.studio_id")) & (F.col("x.date") == F.col("y.date")) & (F.col("x.scene_id") < F.col("y.scene_id")))
    da, db = F.col("x.duration_seconds"), F.col("y.duration_seconds")
    same = da.isNull() | db.isNull() | (F.abs(da - db) <= F.greatest(F.lit(1.0), 0.005 * F.greatest(da, db)))
    return j.select(F.col("x.scene_id").alias("a"), F.col("y.scene_id").alias("b"), same.alias("same"))


@q.add("pred21_high_confidence", f"select id, {_SURE} >= 0.66 and coalesce(try_cast(json_extract_string(details, '$.match_count') as int), 0) >= 2 as high from {_REC} where type = 'scene_fingerprint_match' and {_SURE} is not null")
def _(t):
    r = recs(t).where((F.col("type") == "scene_fingerprint_match") & sure().isNotNull())
    return r.select("id", ((sure() >= 0.66) & (F.coalesce(F.get_json_object("details", "$.match_count").try_cast("int"), F.lit(0)) >= 2)).alias("high"))


@q.add("pred22_wanted_genders", f"select stash_box_id from {_LATEST} where upper(coalesce(gender, 'UNKNOWN')) in ('FEMALE', 'UNKNOWN')")
def _(t):
    return latest(t).where(S.gender_key(F.col("gender")).isin("FEMALE", "UNKNOWN")).select("stash_box_id")


@q.add("pred24_large_boxes", "select distinct id from scene_face_embeddings where bbox.w >= 300 and bbox.h >= 300")
def _(t):
    return t("scene_face_embeddings").where("bbox.w >= 300 and bbox.h >= 300").select("id").distinct()


@q.add("pred28_scene_of_row", f"select id, coalesce(nullif(trim(json_extract_string(details, '$.scene_id')), ''), trim(split_part(target_id, '|', 1))) as scene from {_REC} where type in ('scene_face_match', 'scene_fingerprint_match')")
def _(t):
    return recs(t).where(F.col("type").isin("scene_face_match", "scene_fingerprint_match")).select("id", F.coalesce(S.blank_to_null(F.get_json_object("details", "$.scene_id")), F.trim(F.substring_index("target_id", "|", 1))).alias("scene"))


# ---- joins


@q.add("j1_by_stash_id", f"select distinct s.id, p.performer_id from (select distinct id, unnest(stash_ids) k from search_performer) s join {_LATEST} p on p.endpoint = s.k.endpoint and p.stash_box_id = s.k.stash_id")
def _(t):
    s = t("search_performer").select("id", F.explode("stash_ids").alias("k")).select("id", F.col("k.endpoint").alias("endpoint"), F.col("k.stash_id").alias("stash_box_id"))
    return s.join(latest(t), ["endpoint", "stash_box_id"]).select("id", "performer_id").distinct()


@q.add("j2_faces_of_performers", f"select f.id, p.name, f.quality_score from (select distinct * from faces) f join {_LATEST} p using (performer_id)")
def _(t):
    return t("faces").distinct().join(latest(t), "performer_id").select("id", "name", "quality_score")


@q.add("j4_left_with_residual", f"select s.scene_id, count(distinct e.id) as still_frames from {_SCENES} s left join scene_face_embeddings e on cast(s.scene_id as bigint) = e.stash_scene_id and not e.is_sprite and e.confidence >= 0.9 group by 1")
def _(t):
    e = t("scene_face_embeddings").where("not is_sprite and confidence >= 0.9").select("id", F.col("stash_scene_id").cast("string").alias("scene_id"))
    return scenes(t).select("scene_id").join(e, "scene_id", "left").groupBy("scene_id").agg(F.countDistinct("id").alias("still_frames"))


@q.add("j6_same_identity_pairs", "with k as (select distinct id, s.endpoint, s.stash_id from (select id, unnest(stash_ids) s from search_performer)) select distinct a.id as id_a, b.id as id_b from k a join k b on a.endpoint = b.endpoint and a.stash_id = b.stash_id and a.id < b.id")
def _(t):
    k = t("search_performer").select("id", F.explode("stash_ids").alias("k")).distinct()
    return k.withColumnRenamed("id", "id_a").join(k.withColumnRenamed("id", "id_b"), "k").where("id_a < id_b").select("id_a", "id_b").distinct()


@q.add("j7_shared_hashes", "with k as (select distinct id, lower(trim(image_sha256)) h from faces), c as (select distinct id, lower(trim(image_sha256)) h from face_change) select k.id as face_id, c.id as change_id from k join c using (h)")
def _(t):
    h = lambda n, a: t(n).select(F.col("id").alias(a), F.lower(F.trim("image_sha256")).alias("h")).where("h is not null").distinct()
    return h("faces", "face_id").join(h("face_change", "change_id"), "h").select("face_id", "change_id")


@q.add("j8_studio_performer_pairs", f"with k as (select scene_id, studio_id, unnest(list_distinct(performer_ids)) p from {_SCENES} where studio_id is not null) select a.scene_id as a, b.scene_id as b, count(*) as shared from k a join k b on a.studio_id = b.studio_id and a.p = b.p and a.scene_id < b.scene_id group by all")
def _(t):
    k = scenes(t).where("studio_id is not null").select("scene_id", "studio_id", F.explode(F.array_distinct("performer_ids")).alias("p"))
    return k.withColumnRenamed("scene_id", "a").join(k.withColumnRenamed("scene_id", "b"), ["studio_id", "p"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@q.add("j10_touched_scenes", "select distinct stash_scene_id from scene_face_embeddings e where exists (select 1 from performer_match m where m.matched_face_id = e.id)")
def _(t):
    m = t("performer_match").select(F.col("matched_face_id").alias("id"))
    return t("scene_face_embeddings").join(m, "id", "left_semi").select("stash_scene_id").distinct()


@q.add("j11_scenes_without_faces", f"select scene_id from {_SCENES} s where not exists (select 1 from scene_face_embeddings e where cast(e.stash_scene_id as varchar) = s.scene_id)")
def _(t):
    return scenes(t).select("scene_id").join(t("scene_face_embeddings").select(F.col("stash_scene_id").cast("string").alias("scene_id")), "scene_id", "left_anti")


@q.add("j13_not_dismissed", f"select id from {_REC} r where status = 'pending' and not exists (select 1 from recommendations d where d.status = 'dismissed' and d.type = r.type and d.target_type = r.target_type and trim(d.target_id) = trim(r.target_id))")
def _(t):
    d = recs(t).where("status = 'dismissed'").select("type", "target_type", F.trim("target_id").alias("k"))
    return recs(t).where("status = 'pending'").withColumn("k", F.trim("target_id")).join(d, ["type", "target_type", "k"], "left_anti").select("id")


@q.add("j15_matched_performers", f"select m.match_id, m.face_id, coalesce(p.name, 'Unknown') as name from (select distinct match_id, face_id, stashdb_id from performer_match) m left join {_LATEST} p on p.stash_box_id = m.stashdb_id")
def _(t):
    m = t("performer_match").select("match_id", "face_id", F.col("stashdb_id").alias("stash_box_id")).distinct()
    return m.join(latest(t).select("stash_box_id", "name"), "stash_box_id", "left").select("match_id", "face_id", F.coalesce("name", F.lit("Unknown")).alias("name"))


_UK = "regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), '/+$', ''), '^https?://', ''), '^www\\.', '')"


@q.add("j17_url_overlap", f"with u as (select distinct stash_box_id, {_UK} k from (select stash_box_id, unnest(urls) x from {_LATEST})) select a.stash_box_id as a, b.stash_box_id as b, count(*) as shared from u a join u b on a.k = b.k and a.stash_box_id < b.stash_box_id where a.k <> '' group by all")
def _(t):
    u = latest(t).select("stash_box_id", F.explode("urls").alias("x")).select("stash_box_id", S.url_key(F.col("x")).alias("k")).where("k <> ''").distinct()
    return u.withColumnRenamed("stash_box_id", "a").join(u.withColumnRenamed("stash_box_id", "b"), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@q.add("j18_name_or_alias", f"with n as (select lower(trim(name)) k, stash_box_id, 0 pri from {_LATEST} union all select lower(trim(x)), stash_box_id, 1 from (select stash_box_id, unnest(alias_list) x from {_LATEST})), best as (select k, stash_box_id from n qualify row_number() over (partition by k order by pri, stash_box_id) = 1) select distinct s.id, b.stash_box_id from search_performer s join best b on b.k = lower(trim(s.name))")
def _(t):
    p = latest(t)
    n = p.select(F.lower(F.trim("name")).alias("k"), F.struct(F.lit(0).alias("pri"), "stash_box_id").alias("s")).unionByName(p.select(F.explode("alias_list").alias("x"), "stash_box_id").select(F.lower(F.trim("x")).alias("k"), F.struct(F.lit(1).alias("pri"), "stash_box_id").alias("s")))
    best = n.groupBy("k").agg(F.min("s").alias("s"))
    return t("search_performer").select("id", F.lower(F.trim("name")).alias("k")).join(best, "k").select("id", F.col("s.stash_box_id").alias("stash_box_id")).distinct()


@q.add("j21_three_way", "with s as (select * from performer_snapshot qualify row_number() over (partition by snapshot_no, stash_box_id order by loaded_at desc) = 1) select n.stash_box_id, n.hair_color as local, o.hair_color as before from s n left join s o on o.stash_box_id = n.stash_box_id and o.snapshot_no = 3 where n.snapshot_no = 4 and n.hair_color is distinct from o.hair_color")
def _(t):
    order = Window.partitionBy("snapshot_no", "stash_box_id").orderBy(F.desc("loaded_at"))
    s = t("performer_snapshot").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("snapshot_no", "stash_box_id", "hair_color")
    n = s.where("snapshot_no = 4").select("stash_box_id", F.col("hair_color").alias("local"))
    o = s.where("snapshot_no = 3").select("stash_box_id", F.col("hair_color").alias("before"))
    return n.join(o, "stash_box_id", "left").where(~F.col("local").eqNullSafe(F.col("before"))).select("stash_box_id", "local", "before")


@q.add("j22_list_differences", "with s as (select * from performer_snapshot qualify row_number() over (partition by snapshot_no, stash_box_id order by loaded_at desc) = 1), n as (select distinct stash_box_id, unnest(alias_list) x from s where snapshot_no = 4), o as (select distinct stash_box_id, unnest(alias_list) x from s where snapshot_no = 1) select coalesce(n.stash_box_id, o.stash_box_id) as stash_box_id, coalesce(n.x, o.x) as alias, case when o.x is null then 'added' else 'removed' end as kind from n full join o on n.stash_box_id = o.stash_box_id and n.x = o.x where n.x is null or o.x is null")
def _(t):
    order = Window.partitionBy("snapshot_no", "stash_box_id").orderBy(F.desc("loaded_at"))
    s = t("performer_snapshot").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    part = lambda k, flag: s.where(F.col("snapshot_no") == k).select("stash_box_id", F.explode("alias_list").alias("alias")).distinct().withColumn(flag, F.lit(True))
    both = part(4, "n").join(part(1, "o"), ["stash_box_id", "alias"], "full")
    return both.where("n is null or o is null").select("stash_box_id", "alias", F.when(F.col("o").isNull(), "added").otherwise("removed").alias("kind"))


@q.add("j23_last_frame_times", f"select s.scene_id, max(e.timestamp_sec) as last_seen from {_SCENES} s join scene_face_embeddings e on e.stash_scene_id = cast(s.scene_id as bigint) group by 1")
def _(t):
    e = t("scene_face_embeddings").groupBy(F.col("stash_scene_id").cast("string").alias("scene_id")).agg(F.max("timestamp_sec").alias("last_seen"))
    return scenes(t).select("scene_id").join(e, "scene_id")


@q.add("j25_truth_against_answers", "with e as (select distinct f.id, f.stash_scene_id from scene_face_embeddings f), a as (select distinct face_id, stashdb_id from performer_match where match_rank = 1), b as (select distinct face_id, stashdb_id from performer_match where match_rank = 2) select count(*) filter (a.face_id is not null and b.face_id is not null) as both_sides, count(*) filter (a.face_id is null) as only_second, count(*) filter (b.face_id is null) as only_first from a full join b on a.face_id = b.face_id and a.stashdb_id = b.stashdb_id")
def _(t):
    m = t("performer_match")
    a = m.where("match_rank = 1").select("face_id", "stashdb_id").distinct().withColumn("a", F.lit(1))
    b = m.where("match_rank = 2").select("face_id", "stashdb_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, ["face_id", "stashdb_id"], "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.col("b").isNull()).alias("only_first"))


@q.add("j26_endpoint_ranks", f"select stash_box_id, coalesce(list_position(['https://boxnorth.example/graphql', 'https://lumenbox.example/graphql'], endpoint) - 1, 2) as rank from {_LATEST}")
def _(t):
    listed = F.array(F.lit("https://boxnorth.example/graphql"), F.lit("https://lumenbox.example/graphql"))
    at = F.array_position(listed, F.col("endpoint"))
    return latest(t).select("stash_box_id", F.when(at == 0, F.lit(2)).otherwise(at - 1).cast("int").alias("rank"))


# ---- aggregations


@q.add("a2_counts_by_status", f"select type, status, count(*) as n from {_REC} group by all")
def _(t):
    return recs(t).groupBy("type", "status").agg(F.count("*").alias("n"))


@q.add("a3_counts_by_identity", f"select {_UID} as universal_id, count(*) as n, count(*) filter (status = 'pending') as pending from {_REC} where {_UID} is not null group by 1")
def _(t):
    return recs(t).where(uid().isNotNull()).groupBy(uid().alias("universal_id")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("pending"))


@q.add("a4_distinct_identities", f"select type, count(distinct {_UID}) as identities from {_REC} group by type")
def _(t):
    return recs(t).groupBy("type").agg(F.countDistinct(uid()).alias("identities"))


@q.add("a5_status_breakdown", f"select count(*) as total, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'dismissed') as dismissed, count(*) filter (status = 'resolved') as resolved, count(*) filter (details is null) as bare from {_REC}")
def _(t):
    s = F.col("status")
    return recs(t).agg(F.count("*").alias("total"), *[F.count_if(s == k).alias(k) for k in ("pending", "dismissed", "resolved")], F.count_if(F.col("details").isNull()).alias("bare"))


@q.add("a6_counts_by_endpoint", "select endpoint, count(distinct stash_box_id) as performers from performer_snapshot group by endpoint")
def _(t):
    return t("performer_snapshot").groupBy("endpoint").agg(F.countDistinct("stash_box_id").alias("performers"))


@q.add("a7_next_index", "select coalesce(max(embedding_index), 0) + 1 as next_index, min(embedding_index) as first_index from faces")
def _(t):
    return t("faces").agg((F.coalesce(F.max("embedding_index"), F.lit(0)) + 1).alias("next_index"), F.min("embedding_index").alias("first_index"))


@q.add("a8_face_appearance", "with f as (select distinct id, stash_scene_id, is_sprite, confidence from scene_face_embeddings), g as (select stash_scene_id, is_sprite, count(*) n, sum(round(coalesce(confidence, 0) * 1000)::bigint) / 1000e0 / count(*) c from f group by all) select stash_scene_id, is_sprite, n as frames, round(c, 5) as mean_confidence, round(n / sum(n) over (partition by stash_scene_id), 6) as proportion from g")
def _(t):
    f = t("scene_face_embeddings").select("id", "stash_scene_id", "is_sprite", "confidence").distinct()
    g = f.groupBy("stash_scene_id", "is_sprite").agg(F.count("*").alias("frames"), F.round(F.sum(F.round(F.coalesce("confidence", F.lit(0.0)) * 1000).cast("long")) / F.lit(1000.0) / F.count("*"), 5).alias("mean_confidence"))
    return g.withColumn("proportion", F.round(F.col("frames") / F.sum("frames").over(Window.partitionBy("stash_scene_id")), 6))


@q.add("a10_best_per_face", "select face_id, stashdb_id, min(distance) as distance from performer_match where distance is not null group by all")
def _(t):
    return t("performer_match").where("distance is not null").groupBy("face_id", "stashdb_id").agg(F.min("distance").alias("distance"))


_VOTE = "with m as (select distinct e.stash_scene_id, e.frame_index, m.stashdb_id, m.match_id, m.distance from performer_match m join (select distinct id, stash_scene_id, frame_index from scene_face_embeddings) e on e.id = m.face_id where m.distance <= 0.5)"


def votes(t):
    e = t("scene_face_embeddings").select(F.col("id").alias("face_id"), "stash_scene_id", "frame_index").distinct()
    return t("performer_match").where("distance <= 0.5").select("face_id", "stashdb_id", "match_id", "distance").distinct().join(e, "face_id").drop("face_id").distinct()


@q.add("a11_identity_votes", f"{_VOTE} select stash_scene_id, stashdb_id, count(*) as appearances, count(distinct frame_index) as frames, min(distance) as best, round((1 - min(distance)) * (1 + 0.1 * (count(distinct frame_index) - 1)), 6) as score from m group by all")
def _(t):
    g = votes(t).groupBy("stash_scene_id", "stashdb_id").agg(F.count("*").alias("appearances"), F.countDistinct("frame_index").alias("frames"), F.min("distance").alias("best"))
    return g.withColumn("score", F.round((1 - F.col("best")) * (1 + 0.1 * (F.col("frames") - 1)), 6))


@q.add("k9_frequency_vote", f"{_VOTE}, g as (select stash_scene_id, stashdb_id, count(*) n, count(distinct frame_index) f, min(distance) d from m group by all having count(*) >= 2 and count(distinct frame_index) >= 2 and 1 - min(distance) >= 0.35) select stash_scene_id, stashdb_id, row_number() over (partition by stash_scene_id order by (1 - d) * (1 + 0.1 * (f - 1)) desc, stashdb_id) as rank from g")
def _(t):
    g = votes(t).groupBy("stash_scene_id", "stashdb_id").agg(F.count("*").alias("n"), F.countDistinct("frame_index").alias("f"), F.min("distance").alias("d")).where("n >= 2 and f >= 2 and 1 - d >= 0.35")
    order = Window.partitionBy("stash_scene_id").orderBy(((1 - F.col("d")) * (1 + 0.1 * (F.col("f") - 1))).desc(), "stashdb_id")
    return g.select("stash_scene_id", "stashdb_id", F.row_number().over(order).alias("rank"))


@q.add("a15_gallery_identities", f"{_VOTE} select stashdb_id, count(distinct stash_scene_id) as scenes, min(distance) as best, round(avg(distance), 6) as mean from m group by 1 having count(distinct stash_scene_id) >= 2 or min(distance) < 0.4")
def _(t):
    g = votes(t).groupBy("stashdb_id").agg(F.countDistinct("stash_scene_id").alias("scenes"), F.min("distance").alias("best"), F.round(F.avg("distance"), 6).alias("mean"))
    return g.where("scenes >= 2 or best < 0.4")


@q.add("a16_duplicate_identities", "select endpoint, stash_id, count(distinct id) as n, min(id) as first_id from (select id, s.endpoint, s.stash_id from (select id, unnest(stash_ids) s from search_performer)) group by all having count(distinct id) >= 2")
def _(t):
    k = t("search_performer").select("id", F.explode("stash_ids").alias("s")).select("id", "s.endpoint", "s.stash_id")
    return k.groupBy("endpoint", "stash_id").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first_id")).where("n >= 2")


@q.add("a17_savings", "with f as (select distinct o_custkey, o_orderkey, o_totalprice from orders) select o_custkey, sum(round(o_totalprice * 100)::bigint) as total, sum(round(o_totalprice * 100)::bigint) - max(round(o_totalprice * 100)::bigint) as savings from f group by 1 having count(*) > 1")
def _(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return t("orders").select("o_custkey", "o_orderkey", cents.alias("c")).distinct().groupBy("o_custkey").agg(F.sum("c").alias("total"), (F.sum("c") - F.max("c")).alias("savings"), F.count("*").alias("n")).where("n > 1").drop("n")


@q.add("a19_cast_overlap", f"with s as (select scene_id, studio_id, list_distinct(performer_ids) p from {_SCENES} where studio_id is not null) select a.scene_id as a, b.scene_id as b, round(case when len(list_distinct(list_concat(a.p, b.p))) = 0 then 0 else len(list_intersect(a.p, b.p)) / len(list_distinct(list_concat(a.p, b.p))) end, 6) as jaccard from s a join s b on a.studio_id = b.studio_id and a.scene_id < b.scene_id and len(list_intersect(a.p, b.p)) > 0")
def _(t):
    s = scenes(t).where("studio_id is not null").select("scene_id", "studio_id", F.array_distinct("performer_ids").alias("p"))
    k = s.select("scene_id", "studio_id", F.explode("p").alias("m"))
    pairs = k.withColumnRenamed("scene_id", "a").join(k.withColumnRenamed("scene_id", "b"), ["studio_id", "m"]).where("a < b").select("a", "b").distinct()
    named = pairs.join(s.select(F.col("scene_id").alias("a"), F.col("p").alias("pa")), "a").join(s.select(F.col("scene_id").alias("b"), F.col("p").alias("pb")), "b")
    return named.select("a", "b", F.round(S.jaccard(F.col("pa"), F.col("pb")), 6).alias("jaccard"))


@q.add("a21_first_by_priority", f"select performer_id, arg_min(stash_box_id, coalesce(list_position(['https://lumenbox.example/graphql', 'https://tidebox.example/graphql'], endpoint), 9) || stash_box_id) as stash_box_id from {_LATEST} group by 1")
def _(t):
    listed = F.array(F.lit("https://lumenbox.example/graphql"), F.lit("https://tidebox.example/graphql"))
    at = F.array_position(listed, F.col("endpoint"))
    return latest(t).groupBy("performer_id").agg(F.min_by("stash_box_id", F.struct(F.when(at == 0, 9).otherwise(at), "stash_box_id")).alias("stash_box_id"))


@q.add("a22_kind_pivot", f"select source_analysis_id, count(*) filter (type = 'duplicate_scenes') as duplicate_scenes, count(*) filter (type = 'scene_face_match') as scene_face_match from {_REC} group by 1")
def _(t):
    return recs(t).groupBy("source_analysis_id").pivot("type", ["duplicate_scenes", "scene_face_match"]).agg(F.count(F.lit(1))).na.fill(0)


@q.add("a23_joined_urls", f"select stash_box_id, array_to_string(list_sort(list_distinct(urls)), '|') as urls from {_LATEST} where len(urls) > 0")
def _(t):
    return latest(t).where("size(urls) > 0").select("stash_box_id", F.array_join(F.array_sort(F.array_distinct("urls")), "|").alias("urls"))


@q.add("a27_latency_quantiles", f"with d as (select duration_seconds x from {_SCENES} where duration_seconds is not null), o as (select x, row_number() over (order by x) r, count(*) over () n from d), h as (select max(n) n, (max(n) + 1) * 0.95 p from o) select n, case when n >= 20 then round((select x from o where r = floor(p)) + (p - floor(p)) * ((select x from o where r = floor(p) + 1) - (select x from o where r = floor(p))), 6) end as p95 from h")
def _(t):
    from cataloom.operators.quantiles import exclusive_quantile

    return exclusive_quantile(scenes(t), "duration_seconds", 0.95, least=20).select("n", F.round("q", 6).alias("p95"))


@q.add("a30_pairs_by_scene", f"select status, split_part(trim(target_id), ':', 1) as scene, count(*) as n, max({_SURE}) as top from {_REC} where type = 'duplicate_scenes' and regexp_full_match(trim(target_id), '[0-9]+:[0-9]+') group by all")
def _(t):
    r = recs(t).where((F.col("type") == "duplicate_scenes") & F.trim("target_id").rlike("^[0-9]+:[0-9]+$"))
    return r.groupBy("status", F.substring_index(F.trim("target_id"), ":", 1).alias("scene")).agg(F.count("*").alias("n"), F.max(sure()).alias("top"))


@q.add("a31_candidates_by_scene", f"select status, trim(split_part(target_id, '|', 1)) as scene, list_sort(list(distinct {_UID})) as identities from {_REC} where type = 'scene_face_match' and {_UID} is not null group by all")
def _(t):
    r = recs(t).where((F.col("type") == "scene_face_match") & uid().isNotNull())
    return r.groupBy("status", F.trim(F.substring_index("target_id", "|", 1)).alias("scene")).agg(F.array_sort(F.collect_set(uid())).alias("identities"))


@q.add("a34_centroids", "select label, k - 1 as k, round(avg(x), 5) as x from (select label, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) k from embeddings) group by all")
def _(t):
    return t("embeddings").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("x"))


@q.add("a36_reasons", f"select case when {_SURE} is null then 'not_scored' when {_SURE} < 0.5 then 'low' when status = 'dismissed' then 'rejected' else 'kept' end as reason, count(*) as n from {_REC} group by 1")
def _(t):
    return recs(t).groupBy(F.when(sure().isNull(), "not_scored").when(sure() < 0.5, "low").when(F.col("status") == "dismissed", "rejected").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


@q.add("a37_score_gap", "select round(coalesce(avg(confidence) filter (match_rank = 1), 0) - coalesce(avg(confidence) filter (match_rank > 1), 0), 6) as gap from (select distinct match_id, match_rank, confidence from performer_match)")
def _(t):
    m = t("performer_match").select("match_id", "match_rank", "confidence").distinct()
    return m.agg(F.round(F.coalesce(F.avg(F.when(F.col("match_rank") == 1, F.col("confidence"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(F.col("match_rank") > 1, F.col("confidence"))), F.lit(0.0)), 6).alias("gap"))


@q.add("a40_coverage", f"select round(count(*) filter (scene_id in (select cast(stash_scene_id as varchar) from scene_face_embeddings)) / count(*) * 100, 1) as coverage from {_SCENES}")
def _(t):
    has = t("scene_face_embeddings").select(F.col("stash_scene_id").cast("string").alias("scene_id")).distinct().withColumn("has", F.lit(1))
    return scenes(t).select("scene_id").join(has, "scene_id", "left").agg(F.round(F.count("has") / F.count("*") * 100, 1).alias("coverage"))


# ---- windows, order, sets


@q.add("n1_index_gaps", "select embedding_index - p as gap, p as after from (select embedding_index, lag(embedding_index) over (order by embedding_index) p from (select distinct embedding_index from faces)) where embedding_index - p > 1 order by gap desc, after limit 5")
def _(t):
    from cataloom.operators.ordered import gaps

    return gaps(t("faces").select("embedding_index").distinct(), "embedding_index").orderBy(F.desc("gap"), "after").limit(5)


@q.add("n2_sprite_ordinals", "select id, -1 - row_number() over (partition by stash_scene_id order by id) as ordinal from (select distinct id, stash_scene_id from scene_face_embeddings where is_sprite)")
def _(t):
    s = t("scene_face_embeddings").where("is_sprite").select("id", "stash_scene_id").distinct()
    return s.select("id", (-1 - F.row_number().over(Window.partitionBy("stash_scene_id").orderBy("id"))).alias("ordinal"))


@q.add("n3_match_ranks", "select match_id, row_number() over (partition by face_id order by distance, match_id) - 1 as rank from (select distinct match_id, face_id, distance from performer_match where distance is not null)")
def _(t):
    m = t("performer_match").where("distance is not null").select("match_id", "face_id", "distance").distinct()
    return m.select("match_id", (F.row_number().over(Window.partitionBy("face_id").orderBy("distance", "match_id")) - 1).alias("rank"))


@q.add("n5_keepers", "select id, row_number() over (partition by performer_id order by coalesce(quality_score, 0) desc, id) = 1 as keeper from (select distinct id, performer_id, quality_score from faces)")
def _(t):
    f = t("faces").select("id", "performer_id", "quality_score").distinct()
    return f.select("id", (F.row_number().over(Window.partitionBy("performer_id").orderBy(F.coalesce("quality_score", F.lit(0.0)).desc(), "id")) == 1).alias("keeper"))


@q.add("n6_top_frames", "with t as (select * from (select distinct id, stash_scene_id, timestamp_sec, confidence from scene_face_embeddings where timestamp_sec is not null) qualify row_number() over (partition by stash_scene_id order by confidence desc, id) <= 4) select stash_scene_id, list_sort(list(distinct timestamp_sec)) as times from t group by 1")
def _(t):
    f = t("scene_face_embeddings").where("timestamp_sec is not null").select("id", "stash_scene_id", "timestamp_sec", "confidence").distinct()
    top = f.withColumn("r", F.row_number().over(Window.partitionBy("stash_scene_id").orderBy(F.desc("confidence"), "id"))).where("r <= 4")
    return top.groupBy("stash_scene_id").agg(F.array_sort(F.collect_set("timestamp_sec")).alias("times"))


@q.add("o1_listing", f"select id from {_REC} where type = 'duplicate_scenes' order by coalesce({_SURE}, 0) desc, id desc limit 50 offset 10")
def _(t):
    return recs(t).where("type = 'duplicate_scenes'").orderBy(F.coalesce(sure(), F.lit(0.0)).desc(), F.desc("id")).offset(10).limit(50).select("id")


@q.add("o2_keyset_page", f"select id from {_REC} where id > 1500 order by id limit 100")
def _(t):
    return recs(t).where("id > 1500").orderBy("id").limit(100).select("id")


@q.add("o4_latest_runs", f"select source_analysis_id, max(created_at) as started from {_REC} group by 1 order by started desc, source_analysis_id limit 20")
def _(t):
    return recs(t).groupBy("source_analysis_id").agg(F.max("created_at").alias("started")).orderBy(F.desc("started"), "source_analysis_id").limit(20)


@q.add("o7_capped_ranks", f"{_VOTE}, g as (select stash_scene_id, stashdb_id, min(distance) d from m group by all), c as (select *, count(*) over (partition by stash_scene_id) n, row_number() over (partition by stash_scene_id order by d, stashdb_id) r from g) select stash_scene_id, stashdb_id from c where r <= greatest(2, least(3, n))")
def _(t):
    g = votes(t).groupBy("stash_scene_id", "stashdb_id").agg(F.min("distance").alias("d"))
    w = Window.partitionBy("stash_scene_id")
    c = g.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("d", "stashdb_id")))
    return c.where(F.col("r") <= F.greatest(F.lit(2), F.least(F.lit(3), F.col("n")))).select("stash_scene_id", "stashdb_id")


@q.add("u1_either_id", "select a as scene_id from (select split_part(target_id, ':', 1) a from recommendations where type = 'duplicate_scenes' and regexp_full_match(target_id, '[0-9]+:[0-9]+') union select split_part(target_id, ':', 2) from recommendations where type = 'duplicate_scenes' and regexp_full_match(target_id, '[0-9]+:[0-9]+'))")
def _(t):
    p = t("recommendations").where((F.col("type") == "duplicate_scenes") & F.col("target_id").rlike("^[0-9]+:[0-9]+$")).select(F.split("target_id", ":").alias("s"))
    return p.select(F.explode("s").alias("scene_id")).distinct()


@q.add("u2_new_ids", "select id from face_change except select id from faces")
def _(t):
    return t("face_change").select("id").subtract(t("faces").select("id"))


@q.add("u3_changed_sets", "with s as (select * from performer_snapshot qualify row_number() over (partition by snapshot_no, stash_box_id order by loaded_at desc) = 1), g as (select snapshot_no, list_sort(list_distinct(alias_list)) a from s where len(alias_list) > 0), d as ((select a from g where snapshot_no = 1 except select a from g where snapshot_no = 2) union (select a from g where snapshot_no = 2 except select a from g where snapshot_no = 1)) select distinct unnest(a) as member from d")
def _(t):
    order = Window.partitionBy("snapshot_no", "stash_box_id").orderBy(F.desc("loaded_at"))
    s = t("performer_snapshot").withColumn("_r", F.row_number().over(order)).where("_r = 1 and size(alias_list) > 0")
    part = lambda k: s.where(F.col("snapshot_no") == k).select(F.array_sort(F.array_distinct("alias_list")).alias("a"))
    return part(1).subtract(part(2)).union(part(2).subtract(part(1))).select(F.explode("a").alias("member")).distinct()


@q.add("u5_source_precedence", f"with p as (select least(a, b) a, greatest(a, b) b, pri, src from (select try_cast(split_part(trim(target_id), ':', 1) as bigint) a, try_cast(split_part(trim(target_id), ':', 2) as bigint) b, 0 pri, 'match' src from recommendations where type = 'duplicate_scenes' and regexp_full_match(trim(target_id), '[0-9]+:[0-9]+') union all select a.scene_id::bigint, b.scene_id::bigint, 1, 'metadata' from {_SCENES} a join {_SCENES} b on a.studio_id = b.studio_id and a.date = b.date and a.scene_id < b.scene_id)) select a, b, arg_min(src, pri) as source from p where a <> b group by all")
def _(t):
    r = t("recommendations").where((F.col("type") == "duplicate_scenes") & F.trim("target_id").rlike("^[0-9]+:[0-9]+$")).select(F.split(F.trim("target_id"), ":").alias("s"))
    one = r.select(F.col("s")[0].cast("long").alias("x"), F.col("s")[1].cast("long").alias("y"), F.lit(0).alias("pri"), F.lit("match").alias("source"))
    s = scenes(t).select("scene_id", "studio_id", "date")
    two = s.withColumnRenamed("scene_id", "x").join(s.withColumnRenamed("scene_id", "y"), ["studio_id", "date"]).where("x < y").select(F.col("x").cast("long"), F.col("y").cast("long"), F.lit(1).alias("pri"), F.lit("metadata").alias("source"))
    return one.unionByName(two).where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min_by("source", "pri").alias("source"))


QUERIES, SQL = q.QUERIES, q.SQL
