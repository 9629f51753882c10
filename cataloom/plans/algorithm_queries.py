"""Composite algorithms over the catalogue, and streams over the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cataloom.functions import scalars as S
from cataloom.operators import scoring, vectors
from cataloom.plans.registry import Queries
from cataloom.plans.relational_queries import _LATEST, _REC, _SCENES, _SURE, latest, recs, scenes, sure, votes
from cataloom.streaming import events as stream

q = Queries()

_COS = "round(1 - list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9)"


@q.add("jv_nearest_vectors", f"select q.vec_id as query_id, e.vec_id as index_id from embeddings q join embeddings e on true where q.vec_id % 100 = 0 qualify row_number() over (partition by q.vec_id order by {_COS}, e.vec_id) <= 10")
def _(t):
    e = t("embeddings")
    return vectors.search(e.where(F.col("vec_id") % 100 == 0), e, "vec_id", "vec_id", "embedding", k=10).select("query_id", "index_id")


@q.add("j14_vectors_in_range", f"select distinct e.vec_id as index_id from embeddings q join embeddings e on true where q.vec_id % 100 = 0 and {_COS} <= 0.7")
def _(t):
    e = t("embeddings")
    return vectors.search(e.where(F.col("vec_id") % 100 == 0), e, "vec_id", "vec_id", "embedding", within=0.7).select("index_id").distinct()


@q.add("jv_nearest_faces", "with u as (select id, any_value(embedding)::double[128] v from scene_face_embeddings where len(embedding) = 128 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by id), d as (select q.id as query_id, e.id as index_id, greatest(round(1 - array_cosine_similarity(q.v, e.v), 9), 0) as distance from u q join u e on q.id % 100 = 0) select *, row_number() over (partition by query_id order by distance, index_id) as rank from d qualify row_number() over (partition by query_id order by distance, index_id) <= 4")
def _(t):
    """The three nearest faces of every hundredth face id, against all faces."""
    f = t("scene_face_embeddings").where(F.size("embedding") == 128)
    return vectors.search(f.where(F.col("id") % 100 == 0), f, "id", "id", "embedding", k=4)


@q.add("j9_near_hashes", "with h as (select distinct id, cast(('0x' || substr(image_sha256, 1, 16)) as ubigint) p from faces where image_sha256 is not null) select least(a.id, b.id) as a, greatest(a.id, b.id) as b, bit_count(xor(a.p, b.p)) as bits from h a join h b on a.id < b.id and bit_count(xor(a.p, b.p)) <= 10")
def _(t):
    return vectors.hamming_pairs(t("faces").select("id", S.phash_bits(F.substring("image_sha256", 1, 16)).alias("p")), "id", "p", 10)


_K13 = f"""
with s as (select scene_id, studio_id, duration_seconds l, list_distinct(performer_ids) c, case when regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast(date as date) end d from {_SCENES}),
k as (select scene_id, studio_id, unnest(c) p from s where studio_id is not null),
pairs as (select distinct a.scene_id a, b.scene_id b from k a join k b on a.studio_id = b.studio_id and a.p = b.p and a.scene_id < b.scene_id),
f as (select a, b, abs(date_diff('day', x.d, y.d)) dd, len(list_intersect(x.c, y.c)) / len(list_distinct(list_concat(x.c, y.c))) j, x.studio_id = y.studio_id st,
  case when x.l > 0 and y.l > 0 then least(x.l, y.l) / greatest(x.l, y.l) end r from pairs join s x on x.scene_id = a join s y on y.scene_id = b),
m as (select a, b, greatest(0, least(60, case when dd = 0 and j = 1 then 45 when dd = 0 and j >= 0.5 then 35 when dd <= 7 and j = 1 then 35 when j = 1 then 25 when dd = 0 then 20 when j >= 0.5 then 15 else 0 end
  + case when st and dd <= 7 then 10 else 0 end + case when r < 0.15 then -20 when r < 0.30 then -10 else 0 end)) c from f)
select a, b, c as confidence, case when c >= 80 then 'high' when c >= 50 then 'medium' else 'low' end as label from m where c > 0"""


@q.add("k13_scored_scene_pairs", _K13)
def _(t):
    return scoring.scored_pairs(scenes(t)).where("confidence > 0")


@q.add("k14_metadata_best", f"select a, max(confidence) as best from ({_K13}) group by a")
def _(t):
    return scoring.scored_pairs(scenes(t)).where("confidence > 0").groupBy("a").agg(F.max("confidence").alias("best"))


@q.add("k5_collapsed_links", "with m as (select distinct m.face_id, m.stashdb_id, m.distance, p.performer_id from performer_match m join (select distinct stash_box_id, performer_id from performer_snapshot) p on p.stash_box_id = m.stashdb_id where m.distance is not null) select face_id, performer_id, min(distance) as distance, arg_min(stashdb_id, (distance, stashdb_id)) as stashdb_id from m group by all")
def _(t):
    p = t("performer_snapshot").select(F.col("stash_box_id").alias("stashdb_id"), "performer_id").distinct()
    m = t("performer_match").where("distance is not null").select("face_id", "stashdb_id", "distance").distinct().join(p, "stashdb_id")
    return m.groupBy("face_id", "performer_id").agg(F.min("distance").alias("distance"), F.min_by("stashdb_id", F.struct("distance", "stashdb_id")).alias("stashdb_id"))


@q.add("k1_matched_faces", f"with m as (select face_id, stashdb_id, min(distance) d from performer_match where distance <= 0.35 group by all), r as (select *, row_number() over (partition by face_id order by d, stashdb_id) r from m) select r.face_id, r.stashdb_id, coalesce(p.name, 'Unknown') as name, r.r as rank from r left join {_LATEST} p on p.stash_box_id = r.stashdb_id where r.r <= 5")
def _(t):
    m = t("performer_match").where("distance <= 0.35").groupBy("face_id", "stashdb_id").agg(F.min("distance").alias("d"))
    top = m.withColumn("rank", F.row_number().over(Window.partitionBy("face_id").orderBy("d", "stashdb_id"))).where("rank <= 5")
    p = latest(t).select(F.col("stash_box_id").alias("stashdb_id"), "name")
    return top.join(p, "stashdb_id", "left").select("face_id", "stashdb_id", F.coalesce("name", F.lit("Unknown")).alias("name"), "rank")


@q.add("k3_local_boost", "select match_id, greatest(0e0, least(1e0, 1e0 - distance * 0.85e0)) as confidence from (select distinct match_id, distance from performer_match where distance is not null)")
def _(t):
    return t("performer_match").where("distance is not null").select("match_id", "distance").distinct().select("match_id", S.confidence_of(F.col("distance") * 0.85).alias("confidence"))


@q.add("k7_scene_clusters")
def _(t):
    """Faces of every scene clustered in the order of frames and ids; rows repeated whole count once."""
    return scoring.online_clusters(t("scene_face_embeddings"), "stash_scene_id", ["frame_index", "id"], "id", "embedding")


@q.add("k10_cluster_identities")
def _(t):
    """Clusters of every scene with the identity that votes and size give them."""
    c = scoring.online_clusters(t("scene_face_embeddings"), "stash_scene_id", ["frame_index", "id"], "id", "embedding")
    size = Window.partitionBy("stash_scene_id", "cluster")
    m = t("performer_match").where("distance <= 0.5").groupBy(F.col("face_id").alias("id"), "stashdb_id").agg(F.min("distance").alias("d"))
    v = c.withColumn("size", F.count("*").over(size)).join(m, "id").groupBy("stash_scene_id", "cluster", "size", "stashdb_id").agg(F.count("*").alias("n"), F.min("d").alias("d"))
    return scoring.greedy_identities(v.withColumn("score", (1 - F.col("d")) * (1 + 0.1 * (F.col("n") - 1))), "stash_scene_id", "cluster", "size", "stashdb_id", "score")


_TRI = "with s as (select * from performer_snapshot qualify row_number() over (partition by snapshot_no, stash_box_id order by loaded_at desc) = 1), u as (select stash_box_id, snapshot_no n, unnest(['hair_color', 'eye_color', 'country', 'gender']) field, lower(trim(unnest([hair_color, eye_color, country, gender]))) v from s), v as (select stash_box_id, n, field, coalesce(v, '') v from u)"


@q.add("k17_three_way_changes", f"{_TRI} select l.stash_box_id, l.field, l.v as local, r.v as upstream from v l join v r using (stash_box_id, field) left join v o on o.stash_box_id = l.stash_box_id and o.field = l.field and o.n = 3 where l.n = 2 and r.n = 4 and l.v <> r.v and (o.v is null or o.v <> r.v)")
def _(t):
    order = Window.partitionBy("snapshot_no", "stash_box_id").orderBy(F.desc("loaded_at"))
    s = t("performer_snapshot").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    fields = ["hair_color", "eye_color", "country", "gender"]
    long = s.select("stash_box_id", "snapshot_no", *[F.coalesce(F.lower(F.trim(c)), F.lit("")).alias(c) for c in fields]).unpivot(["stash_box_id", "snapshot_no"], fields, "field", "v")
    part = lambda n, name: long.where(F.col("snapshot_no") == n).select("stash_box_id", "field", F.col("v").alias(name))
    three = part(2, "local").join(part(4, "upstream"), ["stash_box_id", "field"]).join(part(3, "seen"), ["stash_box_id", "field"], "left")
    return three.where("local <> upstream and (seen is null or seen <> upstream)").select("stash_box_id", "field", "local", "upstream")


@q.add("k26_rematch_split", "with d as (select distinct matched_face_id id from performer_match where matched_at >= timestamp '2024-09-01'), e as (select distinct id, stash_scene_id from scene_face_embeddings) select stash_scene_id, bool_or(d.id is not null) as must_rematch from e left join d using (id) group by 1")
def _(t):
    d = t("performer_match").where(F.col("matched_at") >= F.lit("2024-09-01").cast("timestamp_ntz")).select(F.col("matched_face_id").alias("id")).distinct().withColumn("dirty", F.lit(True))
    e = t("scene_face_embeddings").select("id", "stash_scene_id").distinct()
    return e.join(d, "id", "left").groupBy("stash_scene_id").agg(F.max(F.col("dirty").isNotNull()).alias("must_rematch"))


@q.add("k31_stratified_sample", f"select scene_id from {_SCENES} where studio_id is not null qualify row_number() over (partition by studio_id order by md5(scene_id || '|7'), scene_id) <= 3")
def _(t):
    order = Window.partitionBy("studio_id").orderBy(F.md5(F.concat("scene_id", F.lit("|7"))), "scene_id")
    return scenes(t).where("studio_id is not null").withColumn("r", F.row_number().over(order)).where("r <= 3").select("scene_id")


@q.add("k32_threshold_sweep", f"select th as threshold, count(*) filter ({_SURE} >= th) as kept, count(*) filter ({_SURE} >= th and status = 'dismissed') as rejected from {_REC}, (select unnest([0.3, 0.5, 0.7, 0.8, 0.9]) th) where {_SURE} is not null group by th")
def _(t):
    r = recs(t).select("status", sure().alias("s")).where("s is not null")
    long = r.select("status", "s", F.explode(F.array(*[F.lit(x) for x in (0.3, 0.5, 0.7, 0.8, 0.9)])).alias("threshold"))
    return long.groupBy("threshold").agg(F.count_if(F.col("s") >= F.col("threshold")).alias("kept"), F.count_if((F.col("s") >= F.col("threshold")) & (F.col("status") == "dismissed")).alias("rejected"))


@q.add("k33_dispatch", f"select id from {_REC} where status = 'pending' qualify row_number() over (partition by type order by created_at, id) <= 4")
def _(t):
    return recs(t).where("status = 'pending'").withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("created_at", "id"))).where("r <= 4").select("id")


@q.add("k35_contiguous_prefix", "with i as (select distinct embedding_index x from faces), m as (select min(x) lo from i) select coalesce((select min(x) from i where x + 1 not in (select x from i)), 0) as cursor from m")
def _(t):
    i = t("faces").select(F.col("embedding_index").alias("x")).distinct()
    nxt = i.select((F.col("x") - 1).alias("x"))
    return i.join(nxt, "x", "left_anti").agg(F.coalesce(F.min("x"), F.lit(0)).alias("cursor"))


@q.add("t1_since_watermark", f"with w as (select type, max(created_at) m from {_REC} where status = 'dismissed' group by type) select r.id from {_REC} r left join w using (type) where w.m is null or r.created_at > w.m")
def _(t):
    from cataloom.streaming import incremental

    r = recs(t)
    return incremental.changed_since(r, incremental.watermarks(r.where("status = 'dismissed'"), "type", "created_at"), "type", "created_at").select("id")


@q.add("t2_merged_watermarks", f"select type, greatest(max(created_at), max(updated_at)) as watermark from {_REC} group by type")
def _(t):
    from cataloom.streaming import incremental

    r = recs(t)
    return incremental.merge_watermarks(incremental.watermarks(r, "type", "created_at"), incremental.watermarks(r, "type", "updated_at"), "type")


@q.add("t9_tumbling_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, sum(round(value * 100)::bigint) as cents from events group by all")
def _(t):
    return stream.windowed(t("events"))


QUERIES, SQL = q.QUERIES, q.SQL


def t9_streamed_windows(spark, sf_dir):
    """The same windows by a streaming run to the end of the source."""
    return stream.streamed_windows(spark, sf_dir)


def t7_streamed_upserts(spark, sf_dir):
    """Latest event of each user by a streaming upsert in batches."""
    return stream.streamed_latest(spark, sf_dir)


QUERIES |= {"t9_streamed_windows": t9_streamed_windows, "t7_streamed_upserts": t7_streamed_upserts}
SQL |= {
    "t9_streamed_windows": SQL["t9_tumbling_windows"],
    "t7_streamed_upserts": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
}
