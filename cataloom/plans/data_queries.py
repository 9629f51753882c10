"""Queries of the core's data operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators import changes, references, snapshots
from cataloom.workspace import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, sf_dir, "performer_snapshot"), "stash_box_id", "snapshot_no", "loaded_at", ["hair_color", "country"], ["urls"])


def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("performers"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.apply_changes(table(spark, sf_dir, "faces"), table(spark, sf_dir, "face_change"), "id", "change_seq", "last_change_seq", "op", ["performer_id", "embedding_index", "image_sha256"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.catalogue_orphans(*[table(spark, sf_dir, t) for t in ("scene_face_embeddings", "recommendations", "scene", "search_performer")])


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(p6_found(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p2_found, p2_summary, p4_found, p6_found, p6_report)}

_P2 = """
with plain as (
  select snapshot_no, stash_box_id, loaded_at, coalesce(lower(trim(hair_color)), '') h, coalesce(lower(trim(country)), '') c,
    coalesce(list_sort(list_distinct(list_filter(list_transform(urls, lambda u: regexp_replace(lower(trim(u)), '[/\\s]+$', '')), lambda u: u <> ''))), []) u
  from performer_snapshot where stash_box_id is not null),
latest as (select * from plain qualify row_number() over (partition by snapshot_no, stash_box_id order by loaded_at desc) = 1),
steps as (select distinct snapshot_no from latest where snapshot_no > (select min(snapshot_no) from latest)),
both_sides as (
  select s.snapshot_no, coalesce(n.stash_box_id, o.stash_box_id) stash_box_id,
    case when o.stash_box_id is null then 'added' when n.stash_box_id is null then 'removed'
         when n.h <> o.h or n.c <> o.c or n.u <> o.u then 'changed' end change_kind
  from steps s join (select distinct stash_box_id from latest) k on true
  left join latest n on n.snapshot_no = s.snapshot_no and n.stash_box_id = k.stash_box_id
  left join latest o on o.snapshot_no = s.snapshot_no - 1 and o.stash_box_id = k.stash_box_id
  where n.stash_box_id is not null or o.stash_box_id is not null),
found as (select * from both_sides where change_kind is not null)
"""
_P6 = """
with refs as (
  select 'scene_face_embeddings' ref_table, id ref_id, 'scene' dom, cast(stash_scene_id as bigint) k, created_at made from scene_face_embeddings where stash_scene_id is not null
  union
  select 'recommendations', id, case when type = 'upstream_performer_changes' then 'performer' else 'scene' end, try_cast(trim(piece) as bigint), created_at
  from (select id, type, created_at, unnest(case when type = 'duplicate_scenes' then string_split(target_id, ':') else string_split(target_id, '|')[1:1] end) piece from recommendations)
  where regexp_full_match(trim(piece), '[0-9]+') and try_cast(trim(piece) as bigint) is not null),
par as (
  select 'scene' dom, try_cast(trim(scene_id) as bigint) k, bool_or(deleted_at is null) live, min(created_at) filter (deleted_at is null) since
  from scene where regexp_full_match(trim(scene_id), '[0-9]+') and try_cast(trim(scene_id) as bigint) is not null group by 2
  union all
  select 'performer', id, bool_or(deleted_at is null), min(created_at) filter (deleted_at is null) from search_performer group by 2),
found as (
  select ref_table, ref_id, cast(r.k as varchar) ref_key,
    case when p.k is null then 'missing' when not p.live then 'deleted' when p.since > r.made then 'late' end reason, strftime(made, '%Y-%m') as period
  from refs r left join par p on p.dom = r.dom and p.k = r.k)
"""
SQL = {
    "p2_found": _P2 + "select snapshot_no, stash_box_id, change_kind from found",
    "p2_summary": _P2 + "select snapshot_no, change_kind, count(*) as performers from found group by all",
    "p4_found": """
with every as (
  select id, last_change_seq seq, 0 feed, true live, performer_id, embedding_index, image_sha256 from faces
  union all
  select id, change_seq, 1, lower(trim(op)) not in ('delete', 'deleted', 'd', 'del', 'remove', 'removed'), performer_id, embedding_index, image_sha256 from face_change),
last as (select * from every qualify row_number() over (partition by id order by seq desc nulls last, feed desc, live desc) = 1)
select id, performer_id, embedding_index, image_sha256 from last where live and id is not null""",
    "p6_found": _P6 + "select distinct ref_table, ref_id, ref_key, reason, period from found where reason is not null",
    "p6_report": _P6 + "select ref_table, period, reason, count(*) as orphans, count(distinct ref_key) as lost_keys from (select distinct ref_table, ref_id, ref_key, reason, period from found where reason is not null) group by all",
}
