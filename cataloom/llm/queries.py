"""Queries of the operators in this subpackage, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.workspace import table
from cataloom.llm import clusters, leakage, mixing, names, neighbours, pairs, toxic


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.shared_clusters(table(spark, sf_dir, "scene_face_embeddings"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.describe_clusters(table(spark, sf_dir, "scene_face_embeddings"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "scene_face_embeddings"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "scene_face_embeddings"), limit=None)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_person_pairs(table(spark, sf_dir, "search_performer"), table(spark, sf_dir, "performer_snapshot"))


def p5_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_person(table(spark, sf_dir, "search_performer"), table(spark, sf_dir, "performer_snapshot"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.scene_groups(table(spark, sf_dir, "recommendations"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxic_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxic_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p3_found, p3_neighbours, p5_found, p5_persons, p7_found, p8_found, p8_items, p9_found, p9_shares, p9_plan, p10_found, p10_rates)}

_USABLE = """with u as (select id, any_value(embedding)::double[128] v from scene_face_embeddings where len(embedding) = 128 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by id),
d as (select a.id a, b.id b, greatest(round(1 - array_cosine_similarity(a.v, b.v), 9), 0) d from u a join u b on a.id < b.id where array_cosine_similarity(a.v, b.v) >= 0.649999),
near as (select a, b, d from d where d <= 0.35 union all select b, a, d from d where d <= 0.35)
"""

SQL = {
    # characters stand for tokens; the margins hold for any tokenizer
    "p9_found": "with d as (select lower(trim(source)) s, sum(length(text)) n from documents group by 1), t as (select sum(n) total from d) select m.source from mix_targets m join t on true left join d on d.s = lower(trim(m.source)) where m.max_repeats * coalesce(d.n, 0) < m.target_share * t.total",
    "p1_found": _USABLE + "select a as id, least(a, min(b)) as cluster_id from near group by a",
    "p3_found": _USABLE + ", r as (select a, b, row_number() over (partition by a order by d, b) r from near) select distinct least(a, b) as id_a, greatest(a, b) as id_b from r where r <= 3",
    "p7_found": """
with recursive rec as (
  select trim(split_part(trim(target_id), ':', 1)) x, trim(split_part(trim(target_id), ':', 2)) y
  from recommendations
  where type = 'duplicate_scenes' and coalesce(status, '') <> 'dismissed' and len(string_split(target_id, ':')) = 2
    and coalesce(case when confidence > 1 then confidence / 100 else confidence end,
                 try_cast(json_extract_string(details, '$.confidence') as double) / 100) >= 0.8),
e as (
  select distinct cast(x as bigint) a, cast(y as bigint) b from rec
  where regexp_full_match(x, '[0-9]+') and regexp_full_match(y, '[0-9]+') and cast(x as bigint) <> cast(y as bigint)),
both_ways as (select a, b from e union select b, a from e),
reach as (select a as n, a as r from both_ways union select q.b, reach.r from reach join both_ways q on q.a = reach.n)
select n as scene_id, min(r) as group_id from reach group by n""",
}
