"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cataloom.functions import scalars as S
from cataloom.plans.registry import Queries

q = Queries()

_URL = "regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '/+$', ''), '^https?://', ''), '^www\\.', '')"
_END = "regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '/+$', ''), '^https?://', ''), '/graphql$', '')"
_HOST = "regexp_replace(lower(regexp_extract({0}, '://([^/:?#]+)', 1)), '^www\\.', '')"


@q.add("f1_url_keys", f"select distinct u as url, {_URL.format('u')} as url_key from (select unnest(urls) u from performer_snapshot)")
def _(t):
    return t("performer_snapshot").select(F.explode("urls").alias("url")).distinct().select("url", S.url_key(F.col("url")).alias("url_key"))


@q.add("f2_endpoint_keys", f"select endpoint, {_END.format('endpoint')} as endpoint_key, {_HOST.format('endpoint')} as domain, count(*) as n from performer_snapshot group by endpoint")
def _(t):
    return t("performer_snapshot").groupBy("endpoint").agg(F.count("*").alias("n")).select("endpoint", S.endpoint_key(F.col("endpoint")).alias("endpoint_key"), S.endpoint_domain(F.col("endpoint")).alias("domain"), "n")


@q.add("f5_universal_ids", f"select distinct stash_box_id, {_HOST.format('endpoint')} || ':' || stash_box_id as universal_id, 'stashbox' as kind from performer_snapshot")
def _(t):
    return t("performer_snapshot").select("stash_box_id", S.universal_id(F.col("endpoint"), F.col("stash_box_id")).alias("universal_id")).distinct().withColumn("kind", S.universal_kind(F.col("universal_id")))


@q.add("f5_identity_kinds", "select case when u is null or not contains(u, ':') then 'unknown' when split_part(u, ':', 1) = 'local' then 'local' when contains(split_part(u, ':', 1), '.') then 'stashbox' else 'catalogue' end as kind, count(*) as n from (select json_extract_string(details, '$.universal_id') u from recommendations) group by 1")
def _(t):
    return t("recommendations").groupBy(S.universal_kind(F.get_json_object("details", "$.universal_id")).alias("kind")).agg(F.count("*").alias("n"))


@q.add("f6_latin_names", "select id, len(regexp_extract_all(name, '[A-Za-zÀ-ÖØ-öø-ʯḀ-ỿ]')) * 2 > len(regexp_extract_all(name, '\\p{L}')) as latin from (select distinct id, name from search_performer)")
def _(t):
    return t("search_performer").select("id", "name").distinct().select("id", S.mostly_latin(F.col("name")).alias("latin"))


@q.add("f7_display_names", "select distinct id, name as display_name from search_performer where len(regexp_extract_all(name, '[A-Za-zÀ-ÖØ-öø-ʯḀ-ỿ]')) * 2 > len(regexp_extract_all(name, '\\p{L}'))")
def _(t):
    s = t("search_performer").where(S.mostly_latin(F.col("name")))
    return s.select("id", S.display_name(F.col("name"), F.col("alias_list")).alias("display_name")).distinct()


@q.add("f9_durations", "select scene_id, case when duration_seconds is null or duration_seconds = 0 then 'Unknown' when duration_seconds >= 3600 then printf('%d:%02d:%02d', cast(floor(duration_seconds) as bigint) // 3600, cast(floor(duration_seconds) as bigint) % 3600 // 60, cast(floor(duration_seconds) as bigint) % 60) else printf('%d:%02d', cast(floor(duration_seconds) as bigint) // 60, cast(floor(duration_seconds) as bigint) % 60) end as duration from (select distinct scene_id, duration_seconds from scene)")
def _(t):
    return t("scene").select("scene_id", "duration_seconds").distinct().select("scene_id", S.duration_text(F.col("duration_seconds")).alias("duration"))


@q.add("f9_sizes", "select o_orderkey, case when b < 1024 then printf('%.1f B', b) when b < 1048576 then printf('%.1f KB', b / 1024) when b < 1073741824 then printf('%.1f MB', b / 1048576) else printf('%.1f GB', b / 1073741824) end as size from (select o_orderkey, o_orderkey * 65521.0 as b from orders)")
def _(t):
    return t("orders").select("o_orderkey", S.size_text(F.col("o_orderkey") * F.lit(65521.0)).alias("size"))


_DATE = "case when regexp_full_match(d, '\\d{4}') then d || '-01-01' when regexp_full_match(d, '\\d{4}-\\d{2}') then d || '-01' else nullif(d, '') end"


@q.add("f12_padded_dates", f"select scene_id, {_DATE} as day from (select distinct scene_id, split_part(split_part(trim(date), 'T', 1), ' ', 1) d from scene)")
def _(t):
    return t("scene").select("scene_id", F.col("date").alias("d")).select("scene_id", S.padded_date(F.col("d")).alias("day")).distinct()


@q.add("f13_days_apart", "select studio_id, max(abs(date_diff('day', try_cast(a as date), try_cast(b as date)))) as days from (select studio_id, min(date) a, max(date) b from scene where regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') group by studio_id) group by studio_id")
def _(t):
    s = t("scene").where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")).groupBy("studio_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return s.select("studio_id", S.days_between(F.col("a"), F.col("b")).alias("days"))


@q.add("f15_nullish_texts", "select case when disambiguation is null or lower(trim(disambiguation)) in ('', 'null', 'none') then '' else disambiguation end as disambiguation, count(*) as n from search_performer group by 1")
def _(t):
    return t("search_performer").groupBy(S.nullish_text(F.col("disambiguation")).alias("disambiguation")).agg(F.count("*").alias("n"))


@q.add("f17_hash_distances", "with h as (select distinct id, cast(('0x' || substr(image_sha256, 1, 15)) as bigint) p from faces) select a.id as id_a, b.id as id_b, bit_count(xor(a.p, b.p)) as bits from h a join h b on a.id + 1 = b.id")
def _(t):
    h = t("faces").select("id", S.phash_bits(F.substring("image_sha256", 1, 15)).alias("p")).distinct()
    a, b = h.toDF("id_a", "pa"), h.toDF("id_b", "pb")
    return a.join(b, F.col("id_a") + 1 == F.col("id_b")).select("id_a", "id_b", S.hamming(F.col("pa"), F.col("pb")).alias("bits"))


@q.add("f18_cosine_distances", "with e as (select vec_id, embedding::double[] v from embeddings) select a.vec_id as id_a, b.vec_id as id_b, round(1 - list_cosine_similarity(a.v, b.v), 6) as distance from e a join e b on a.vec_id + 1 = b.vec_id")
def _(t):
    e = t("embeddings").select("vec_id", "embedding")
    a, b = e.toDF("id_a", "va"), e.toDF("id_b", "vb")
    return a.join(b, F.col("id_a") + 1 == F.col("id_b")).select("id_a", "id_b", F.round(S.cosine_distance(F.col("va"), F.col("vb")), 6).alias("distance"))


@q.add("k2_yaw_penalty", "select id, case when yaw is null or abs(yaw) <= 45 then 1000 else cast(floor(1000 - (least(abs(yaw), 90) - 45) / 45 * 500 + 1e-6) as bigint) end as permille from (select distinct id, yaw from scene_face_embeddings)")
def _(t):
    f = t("scene_face_embeddings").select("id", "yaw").distinct()
    return f.select("id", F.floor(S.yaw_factor(F.col("yaw")) * 1000 + 1e-6).cast("long").alias("permille"))


@q.add("f19_confidences", "select match_id, greatest(0, least(1, 1 - distance)) as confidence from (select distinct match_id, distance from performer_match where distance is not null)")
def _(t):
    return t("performer_match").where("distance is not null").select("match_id", "distance").distinct().select("match_id", S.confidence_of(F.col("distance")).alias("confidence"))


@q.add("f20_content_hashes", "select distinct id, substr(sha256(coalesce(name, '') || '|' || coalesce(disambiguation, '')), 1, 16) as content_hash from search_performer")
def _(t):
    return t("search_performer").select("id", F.substring(F.sha2(F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce("disambiguation", F.lit(""))), 256), 1, 16).alias("content_hash")).distinct()


@q.add("f21_url_ids", "select distinct u as url, regexp_extract(u, '/(p|u|model)/([^/?#]+)', 2) as handle from (select unnest(urls) u from performer_snapshot)")
def _(t):
    return t("performer_snapshot").select(F.explode("urls").alias("url")).distinct().select("url", F.regexp_extract("url", r"/(p|u|model)/([^/?#]+)", 2).alias("handle"))


@q.add("f22_version_order", "select k, k2, case when list_transform(string_split(a, '.'), lambda x: cast(x as int)) < list_transform(string_split(b, '.'), lambda x: cast(x as int)) then -1 when a = b then 0 else 1 end as cmp from (select n_nationkey k, n_nationkey + 1 k2, (n_nationkey // 10) || '.' || (n_nationkey % 7) || '.0' a, ((n_nationkey + 1) // 10) || '.' || ((n_nationkey + 1) % 7) || '.0' b from nation)")
def _(t):
    n = t("nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") + 1).alias("k2"))
    ver = lambda c: F.concat_ws(".", F.floor(c / 10).cast("string"), F.pmod(c, F.lit(7)).cast("string"), F.lit("0"))
    a, b = S.version_parts(ver(F.col("k"))), S.version_parts(ver(F.col("k2")))
    return n.select("k", "k2", F.when(a < b, -1).when(a == b, 0).otherwise(1).alias("cmp"))


@q.add("f23_cue_seconds", "select distinct id, round(coalesce(timestamp_sec, 0), 3) as seconds from scene_face_embeddings")
def _(t):
    f = t("scene_face_embeddings").select("id", F.coalesce("timestamp_sec", F.lit(0.0)).alias("s")).distinct()
    cue = F.format_string("%02d:%02d:%06.3f", F.floor(F.col("s") / 3600).cast("int"), F.floor(F.pmod("s", F.lit(3600.0)) / 60).cast("int"), F.pmod("s", F.lit(60.0)))
    return f.select("id", F.round(S.cue_seconds(cue), 3).alias("seconds"))


@q.add("f24_sampling_grids", "select scene_id, list_transform(range(0, 5), lambda i: duration_seconds * 0.05e0 + ((duration_seconds * 0.05e0 + duration_seconds * 0.9e0) - duration_seconds * 0.05e0) * i / 4) as times from (select distinct scene_id, duration_seconds from scene where duration_seconds is not null)")
def _(t):
    s = t("scene").where("duration_seconds is not null").select("scene_id", "duration_seconds").distinct()
    d = F.col("duration_seconds")
    return s.select("scene_id", S.even_grid(d * 0.05, d * 0.05 + d * 0.9, 5).alias("times"))


@q.add("f25_frame_scores", "select stash_scene_id, frame_index, round(sum(confidence * sqrt(bbox.w * bbox.h)), 4) as score from (select distinct id, stash_scene_id, frame_index, confidence, bbox from scene_face_embeddings) group by all")
def _(t):
    f = t("scene_face_embeddings").select("id", "stash_scene_id", "frame_index", "confidence", "bbox").distinct()
    return f.groupBy("stash_scene_id", "frame_index").agg(F.round(F.sum(F.col("confidence") * F.sqrt((F.col("bbox.w") * F.col("bbox.h")).cast("double"))), 4).alias("score"))


@q.add("f26_roll_angles", "select id, round(degrees(atan2(bbox.h, bbox.w)), 6) as degrees from (select distinct id, bbox from scene_face_embeddings)")
def _(t):
    return t("scene_face_embeddings").select("id", "bbox").distinct().select("id", F.round(F.degrees(F.atan2(F.col("bbox.h").cast("double"), F.col("bbox.w").cast("double"))), 6).alias("degrees"))


@q.add("f27_derotated_boxes", "select id, round(w * cos(radians(10)) + h * sin(radians(10)), 2) as width, round(w * sin(radians(10)) + h * cos(radians(10)), 2) as height from (select distinct id, bbox.w w, bbox.h h from scene_face_embeddings)")
def _(t):
    f = t("scene_face_embeddings").select("id", "bbox").distinct()
    x, y, w, h = (F.col(f"bbox.{c}").cast("double") for c in "xywh")
    box = S.derotated_box(x, y, w, h, F.lit(10.0), x + w / 2, y + h / 2)
    return f.select("id", box.alias("b")).select("id", F.round(F.col("b.x1") - F.col("b.x0"), 2).alias("width"), F.round(F.col("b.y1") - F.col("b.y0"), 2).alias("height"))


@q.add("f28_boxes_of_frame", "select distinct id, bbox.x / 1920e0 as x, bbox.y / 1080e0 as y, bbox.w / 1920e0 as w, bbox.h / 1080e0 as h from scene_face_embeddings")
def _(t):
    side = {"x": 1920.0, "y": 1080.0, "w": 1920.0, "h": 1080.0}
    return t("scene_face_embeddings").select("id", *[(F.col(f"bbox.{c}") / F.lit(s)).alias(c) for c, s in side.items()]).distinct()


@q.add("f29_strides", "select distinct id, cast(ceil(bbox.w / 32.0) * 32 as int) as w, cast(ceil(bbox.h / 32.0) * 32 as int) as h from scene_face_embeddings")
def _(t):
    return t("scene_face_embeddings").select("id", S.stride(F.col("bbox.w")).alias("w"), S.stride(F.col("bbox.h")).alias("h")).distinct()


@q.add("f30_box_tiers", "select case when greatest(bbox.x + bbox.w, bbox.y + bbox.h) >= 2160 then '4k' when greatest(bbox.x + bbox.w, bbox.y + bbox.h) >= 1080 then '1080p' when greatest(bbox.x + bbox.w, bbox.y + bbox.h) >= 720 then '720p' else '480p' end as tier, count(*) as n from scene_face_embeddings group by 1")
def _(t):
    b = F.col
    return t("scene_face_embeddings").groupBy(S.resolution_tier(b("bbox.x") + b("bbox.w"), b("bbox.y") + b("bbox.h")).alias("tier")).agg(F.count("*").alias("n"))


@q.add("f31_genders", "select upper(regexp_replace(trim(coalesce(gender, 'UNKNOWN')), '[ -]+', '_', 'g')) as gender, count(*) as n from performer_snapshot group by 1")
def _(t):
    return t("performer_snapshot").groupBy(S.gender_key(F.col("gender")).alias("gender")).agg(F.count("*").alias("n"))


@q.add("f35_json_fields", "select distinct id, try_cast(json_extract_string(details, '$.scene_a') as bigint) as scene_a, try_cast(json_extract_string(details, '$.scene_b') as bigint) as scene_b, try_cast(json_extract_string(details, '$.confidence') as double) as confidence from recommendations where type = 'duplicate_scenes'")
def _(t):
    j = F.from_json("details", "scene_a bigint, scene_b bigint, confidence double").alias("j")
    return t("recommendations").where("type = 'duplicate_scenes'").select("id", j).select("id", "j.scene_a", "j.scene_b", "j.confidence").distinct()


@q.add("f36_next_runs", "select distinct id, created_at + interval 36 hour as next_run from recommendations")
def _(t):
    return t("recommendations").select("id", (F.col("created_at") + F.expr("interval 36 hours")).alias("next_run")).distinct()


@q.add("k28_unique_aliases", """
with a as (select stash_box_id, snapshot_no, name, trim(x) x, pos from (select distinct stash_box_id, snapshot_no, name, alias_list from performer_snapshot) s, unnest(alias_list) with ordinality as u(x, pos)),
f as (select stash_box_id, snapshot_no, name, lower(x) l, min(pos) pos, arg_min(x, pos) x from a where x <> '' and lower(x) <> lower(trim(name)) group by all)
select stash_box_id, snapshot_no, count(distinct l) as aliases from f group by all""")
def _(t):
    s = t("performer_snapshot").select("stash_box_id", "snapshot_no", "name", "alias_list").distinct()
    kept = s.select("stash_box_id", "snapshot_no", F.explode(S.first_occurrences(F.col("alias_list"), F.col("name"))).alias("x"))
    return kept.groupBy("stash_box_id", "snapshot_no").agg(F.countDistinct(F.lower("x")).alias("aliases"))


@q.add("f32_endpoint_ids", "select distinct id, list_sort(list_transform(stash_ids, lambda s: s.endpoint || '|' || s.stash_id)) as links from search_performer where len(stash_ids) > 0")
def _(t):
    return t("search_performer").where("size(stash_ids) > 0").select("id", F.array_sort(F.transform("stash_ids", lambda s: F.concat_ws("|", s["endpoint"], s["stash_id"]))).alias("links")).distinct()


@q.add("f33_relinked_ids", "select distinct id, list_transform(stash_ids, lambda s: case when s.endpoint = 'https://boxnorth.example/graphql' then 'new' else s.stash_id end) as ids from search_performer where len(stash_ids) > 0")
def _(t):
    return t("search_performer").where("size(stash_ids) > 0").select("id", F.transform("stash_ids", lambda s: F.when(s["endpoint"] == "https://boxnorth.example/graphql", "new").otherwise(s["stash_id"])).alias("ids")).distinct()


QUERIES, SQL = q.QUERIES, q.SQL
