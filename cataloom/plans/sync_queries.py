"""Upstream differences by kind of value, delta application and catalogue upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.operators import changes
from cataloom.plans.matching_queries import _GROUPS, link_groups
from cataloom.plans.registry import Queries
from cataloom.plans.relational_queries import _LATEST, _REC, _SCENES, latest, recs, scenes

q = Queries()

#: Fields by the way in which their values are compared.
TEXTS, DATES, LISTS, NUMBERS = ("hair_color", "eye_color", "country", "gender", "disambiguation", "name"), ("birthdate",), ("alias_list", "urls"), ("height_cm",)


def snapshot(t, n: int) -> DataFrame:
    """The latest delivered row of every performer in snapshot ``n``."""
    order = Window.partitionBy("stash_box_id").orderBy(F.desc("loaded_at"))
    return t("performer_snapshot").where(F.col("snapshot_no") == n).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def long_fields(df: DataFrame) -> DataFrame:
    """``stash_box_id, field, v``: every field in the form in which it is compared.

    Texts without case, dates padded, lists as sorted distinct plain members
    without the own name, numbers as text; null, blank, zero and empty are one.
    """
    text = [F.when(F.trim(F.col(c)) == "", "").otherwise(F.coalesce(F.lower(F.col(c)), F.lit(""))).alias(c) for c in TEXTS]
    date = [F.when(F.length("birthdate") == 4, F.concat("birthdate", F.lit("-01-01"))).when(F.length("birthdate") == 7, F.concat("birthdate", F.lit("-01"))).otherwise(F.coalesce("birthdate", F.lit(""))).alias("birthdate")]
    plain = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.rtrim(F.lower(x), F.lit("/"))), lambda x: (x != "") & (x != F.coalesce(F.lower("name"), F.lit("")))))), "|").alias(c)
    number = [F.when(F.coalesce("height_cm", F.lit(0)) == 0, "").otherwise(F.col("height_cm").cast("string")).alias("height_cm")]
    wide = df.select("stash_box_id", *text, *date, *[plain(c) for c in LISTS], *number)
    return wide.unpivot(["stash_box_id"], [*TEXTS, *DATES, *LISTS, *NUMBERS], "field", "v")


_PLAIN = "array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: rtrim(lower(x), '/')), lambda x: x <> '' and x <> coalesce(lower(name), '')))), '|')"
_LONG = (
    "w as (select snapshot_no n, stash_box_id, "
    + ", ".join(f"case when trim({c}) = '' then '' else coalesce(lower({c}), '') end {c}" for c in TEXTS)
    + ", case when length(birthdate) = 4 then birthdate || '-01-01' when length(birthdate) = 7 then birthdate || '-01' else coalesce(birthdate, '') end birthdate, "
    + ", ".join(f"{_PLAIN.format(c=c)} {c}" for c in LISTS)
    + ", case when coalesce(height_cm, 0) = 0 then '' else cast(height_cm as varchar) end height_cm from performer_snapshot qualify row_number() over (partition by snapshot_no, stash_box_id order by loaded_at desc) = 1), "
    + "v as ("
    + " union all ".join(f"select n, stash_box_id, '{c}' field, {c} v from w" for c in (*TEXTS, *DATES, *LISTS, *NUMBERS))
    + "), diff as (select l.stash_box_id, l.field, l.v as local, r.v as upstream from v l join v r using (stash_box_id, field) left join v o on o.stash_box_id = l.stash_box_id and o.field = l.field and o.n = 3 where l.n = 2 and r.n = 4 and l.v <> r.v and (o.v is null or o.v <> r.v))"
)


def typed_diff(t) -> DataFrame:
    """``stash_box_id, field, local, upstream``: the upstream values that differ from the local ones and were not seen before."""
    local, up, seen = (long_fields(snapshot(t, n)).withColumnRenamed("v", name) for n, name in ((2, "local"), (4, "upstream"), (3, "seen")))
    j = local.join(up, ["stash_box_id", "field"]).join(seen, ["stash_box_id", "field"], "left")
    return j.where("local <> upstream and (seen is null or seen <> upstream)").drop("seen")


@q.add("k18_typed_differences", f"with {_LONG} select stash_box_id, field, local, upstream from diff")
def _(t):
    return typed_diff(t)


@q.add("x35_changed_entities", f"with {_LONG} select stash_box_id, count(*) as fields, string_agg(field, ',' order by field) as names from diff group by 1")
def _(t):
    return typed_diff(t).groupBy("stash_box_id").agg(F.count("*").alias("fields"), F.array_join(F.array_sort(F.collect_list("field")), ",").alias("names"))


@q.add("pred19_minor_changes", f"with {_LONG} select stash_box_id, bool_and(field in ('urls', 'alias_list', 'disambiguation')) as minor from diff group by 1")
def _(t):
    return typed_diff(t).groupBy("stash_box_id").agg(F.bool_and(F.col("field").isin("urls", "alias_list", "disambiguation")).alias("minor"))


_ENABLED = "en as (select 'boxnorth' e, unnest(['hair_color', 'country', 'urls']) field union all select 'tidebox', unnest(['birthdate', 'name']))"


@q.add("pred25_enabled_fields", f"with {_LONG}, {_ENABLED}, ep as (select stash_box_id, regexp_extract(endpoint, '//([a-z]+)', 1) e from {_LATEST}) select diff.stash_box_id, diff.field from diff join ep using (stash_box_id) left join en on en.e = ep.e and en.field = diff.field where en.field is not null or ep.e not in (select e from en)")
def _(t):
    """Differences in the fields enabled for the endpoint; an endpoint without settings has all."""
    d = typed_diff(t)
    en = d.sparkSession.createDataFrame([("boxnorth", f) for f in ("hair_color", "country", "urls")] + [("tidebox", f) for f in ("birthdate", "name")], "e string, field string")
    ep = latest(t).select("stash_box_id", F.regexp_extract("endpoint", "//([a-z]+)", 1).alias("e"))
    j = d.join(ep, "stash_box_id")
    chosen = j.join(F.broadcast(en), ["e", "field"], "left_semi")  # settings, a few rows
    return chosen.select("stash_box_id", "field").unionByName(j.join(F.broadcast(en.select("e").distinct()), "e", "left_anti").select("stash_box_id", "field"))


@q.add("pred26_summaries", f"select scene_id, title, studio_name as studio, coalesce(len(performer_ids), 0) as members, round(duration_seconds, 1) as seconds from {_SCENES}")
def _(t):
    return scenes(t).select(F.struct("scene_id", "title", F.col("studio_name").alias("studio"), F.coalesce(F.when(F.col("performer_ids").isNotNull(), F.size("performer_ids")), F.lit(0)).alias("members"), F.round("duration_seconds", 1).alias("seconds")).alias("s")).select("s.*")


@q.add("k21_status_changes", "with s as (select snapshot_no n, stash_box_id, performer_id from performer_snapshot qualify row_number() over (partition by snapshot_no, stash_box_id order by loaded_at desc) = 1), l as (select * from s where n = 3), u as (select * from s where n = 4) select l.stash_box_id, '_upstream_status' as field, case when o.performer_id is not null then 'merged' else 'deleted' end as upstream, o.stash_box_id as other from l left join u on u.stash_box_id = l.stash_box_id left join (select performer_id, min(stash_box_id) stash_box_id from u group by 1) o on o.performer_id = l.performer_id where u.stash_box_id is null")
def _(t):
    """Performers gone upstream: merged into the entry that now carries their record, or deleted."""
    old, new = snapshot(t, 3).select("stash_box_id", "performer_id"), snapshot(t, 4).select("stash_box_id", "performer_id")
    kept = new.groupBy("performer_id").agg(F.min("stash_box_id").alias("other"))
    gone = old.join(new, "stash_box_id", "left_anti").join(kept, "performer_id", "left")
    return gone.select("stash_box_id", F.lit("_upstream_status").alias("field"), F.when(F.col("other").isNotNull(), "merged").otherwise("deleted").alias("upstream"), "other")


_OPEN = f"ac as (select distinct trim(target_id) target, status from {_REC} where type = 'upstream_performer_changes'), lk as (select distinct id, k.stash_id sid from (select id, unnest(stash_ids) k from search_performer))"


@q.add("k20_upstream_states", f"with {_LONG}, {_OPEN}, ch as (select stash_box_id, count(*) n from diff group by 1), j as (select lk.id, lk.sid, coalesce(ch.n, 0) n, bool_or(ac.status = 'pending') pending, bool_or(ac.status = 'dismissed') dismissed from lk join (select distinct stash_box_id from v where n = 4) u on u.stash_box_id = lk.sid left join ch on ch.stash_box_id = lk.sid left join ac on ac.target = cast(lk.id as varchar) group by all) select id, sid as stash_box_id, case when dismissed then 'skip' when n = 0 and pending then 'resolve' when n = 0 then 'snapshot' when pending then 'refresh' else 'create' end as action from j")
def _(t):
    """What the incremental run does with each linked library row: skip, resolve, take the snapshot, refresh or create."""
    ch = typed_diff(t).groupBy("stash_box_id").agg(F.count("*").alias("n"))
    ac = recs(t).where("type = 'upstream_performer_changes'").groupBy(F.trim("target_id").alias("target")).agg(F.bool_or(F.col("status") == "pending").alias("pending"), F.bool_or(F.col("status") == "dismissed").alias("dismissed"))
    lk = t("search_performer").select("id", F.explode("stash_ids").alias("k")).select("id", F.col("k.stash_id").alias("stash_box_id")).distinct()
    j = lk.join(snapshot(t, 4).select("stash_box_id"), "stash_box_id", "left_semi").join(ch, "stash_box_id", "left").join(ac, F.col("id").cast("string") == F.col("target"), "left")
    some = F.coalesce("n", F.lit(0)) > 0
    return j.select("id", "stash_box_id", F.when(F.col("dismissed"), "skip").when(~some & F.col("pending"), "resolve").when(~some, "snapshot").when(F.col("pending"), "refresh").otherwise("create").alias("action"))


@q.add("k19_scene_members", f"with x as (select scene_id, unnest(performer_ids) p from {_SCENES}), g as (select cast(performer_id as varchar) p, max(lower(trim(gender))) g from {_LATEST} group by 1), o as (select scene_id, unnest(performer_ids) p from (select scene_id, arg_min(performer_ids, (created_at, updated_at)) performer_ids from (select distinct * from scene) group by 1)) select x.scene_id, coalesce(list_sort(list_distinct(list(x.p) filter (o.p is null and g.g in ('female', 'f')))), []) as added from (select distinct * from x) x left join (select distinct * from o) o on o.scene_id = x.scene_id and o.p = x.p left join g on g.p = x.p group by 1")
def _(t):
    """Members of the current scene that its first delivery lacks, of the wanted gender, without those already there."""
    x = scenes(t).select("scene_id", F.explode("performer_ids").alias("p")).distinct()
    g = latest(t).groupBy(F.col("performer_id").cast("string").alias("p")).agg(F.max(F.lower(F.trim("gender"))).alias("g"))
    first = t("scene").distinct().groupBy("scene_id").agg(F.min_by("performer_ids", F.struct("created_at", "updated_at")).alias("ids"))
    o = first.select("scene_id", F.explode("ids").alias("p"), F.lit(True).alias("there")).distinct()
    j = x.join(o, ["scene_id", "p"], "left").join(g, "p", "left")
    return j.groupBy("scene_id").agg(F.array_sort(F.collect_set(F.when(F.col("there").isNull() & F.col("g").isin("female", "f"), F.col("p")))).alias("added"))


# ---- deltas: the steps are snapshots 1 to 4

_S = "s as (select * from performer_snapshot qualify row_number() over (partition by snapshot_no, stash_box_id order by loaded_at desc) = 1)"
_FEED = "lower(trim(op)) in ('delete', 'deleted', 'd', 'del', 'remove', 'removed')"
_STATE = f"st as (select id, performer_id from (select id, last_change_seq q, false gone, performer_id from faces union all select id, change_seq, {_FEED}, performer_id from face_change) qualify row_number() over (partition by id order by q desc nulls last, not gone desc, performer_id desc nulls last) = 1 and not gone)"


@q.add("k22_delta_applied", f"with {_S}, {_STATE}, cat as (select performer_id, name from s where snapshot_no = 4 qualify row_number() over (partition by performer_id order by stash_box_id) = 1) select c.performer_id, c.name, count(distinct st.id) as face_count from cat c left join st on st.performer_id = c.performer_id group by 1, 2")
def _(t):
    """The catalogue after a delta: performers as delivered last, faces after the feed, face counts brought in line."""
    order = Window.partitionBy("performer_id").orderBy("stash_box_id")
    cat = snapshot(t, 4).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("performer_id", "name")
    st = changes.apply_changes(t("faces"), t("face_change"), "id", "change_seq", "last_change_seq", "op", ["performer_id"])
    counts = st.groupBy("performer_id").agg(F.countDistinct("id").alias("n"))
    return cat.join(counts, "performer_id", "left").select("performer_id", "name", F.coalesce("n", F.lit(0)).alias("face_count"))


@q.add("k23_relocated_ids", f"with {_LATEST.replace('(select', 'l as (select', 1)}, f as (select distinct id, performer_id from faces), ks as (select distinct id k from search_performer), hit as (select distinct performer_id from l where performer_id in (select k from ks)), mv as (select performer_id, row_number() over (order by performer_id) + (select max(m) from (select max(performer_id) m from l union all select max(k) from ks)) as moved from hit) select f.id, coalesce(mv.moved, f.performer_id) as performer_id from f left join mv using (performer_id)")
def _(t):
    """Performers whose id collides with a library id move above all ids; the faces follow."""
    from cataloom.operators import state

    ids = t("search_performer").select("id").distinct()
    taken = latest(t).select(F.col("performer_id").alias("id")).distinct().join(ids, "id", "left_semi")
    top = latest(t).select(F.col("performer_id").alias("id")).union(ids).agg(F.max("id")).first()[0] or 0
    return state.relocate({"faces": (t("faces").select("id", "performer_id").distinct(), "performer_id")}, taken, int(top))["faces"].select("id", "performer_id")


@q.add("x32_removed_performers", f"with {_S}, g as (select distinct o.performer_id from s o where o.snapshot_no = 3 and not exists (select 1 from s n where n.snapshot_no = 4 and n.stash_box_id = o.stash_box_id)) select g.performer_id, not exists (select 1 from s n where n.snapshot_no = 4 and n.performer_id = g.performer_id) as removed, (select count(distinct f.id) from faces f where f.performer_id = g.performer_id) as faces from g")
def _(t):
    """A performer goes only with its last link; what goes with it is counted."""
    old, new = snapshot(t, 3), snapshot(t, 4)
    g = old.join(new.select("stash_box_id"), "stash_box_id", "left_anti").select("performer_id").distinct()
    left = new.select("performer_id", F.lit(True).alias("kept")).distinct()
    faces = t("faces").groupBy("performer_id").agg(F.countDistinct("id").alias("n"))
    return g.join(left, "performer_id", "left").join(faces, "performer_id", "left").select("performer_id", F.col("kept").isNull().alias("removed"), F.coalesce("n", F.lit(0)).alias("faces"))


@q.add("k25_dirty_records", "with c as (select distinct id, performer_id, image_sha256 from face_change), f as (select distinct id, performer_id, image_sha256 from faces), j as (select f.id, f.performer_id o, c.performer_id n, f.image_sha256 is distinct from c.image_sha256 as face_changed from c join f using (id)), a as (select o p, face_changed from j union all select n, face_changed from j) select p as performer_id, not bool_or(face_changed) as metadata_only from a where p is not null group by 1")
def _(t):
    """Old and new performer of every changed face; metadata only where no picture changed."""
    c = t("face_change").select("id", F.col("performer_id").alias("n"), F.col("image_sha256").alias("h")).distinct()
    f = t("faces").select("id", F.col("performer_id").alias("o"), F.col("image_sha256").alias("g")).distinct()
    j = c.join(f, "id").withColumn("changed", ~F.col("g").eqNullSafe(F.col("h")))
    both = j.select(F.col("o").alias("performer_id"), "changed").unionAll(j.select("n", "changed")).where("performer_id is not null")
    return both.groupBy("performer_id").agg((~F.bool_or("changed")).alias("metadata_only"))


@q.add("x11_scenes_of_changed_links", f"with {_GROUPS}, ch as (select grp from grp group by 1 having count(*) > 1), e as (select distinct id, stash_scene_id from scene_face_embeddings) select distinct e.stash_scene_id from performer_match m join grp on grp.stashdb_id = m.stashdb_id join ch using (grp) join e on e.id = m.face_id")
def _(t):
    """Scenes that match a performer whose link group has several members."""
    g = link_groups(t)
    big = g.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    m = t("performer_match").select("stashdb_id", F.col("face_id").alias("id")).distinct().join(g.join(big, "grp", "left_semi"), "stashdb_id", "left_semi")
    return t("scene_face_embeddings").join(m, "id", "left_semi").select("stash_scene_id").distinct()


@q.add("j21_three_way_fields", f"with {_LONG} select l.stash_box_id, count(*) as fields, count(o.v) as seen, count(*) filter (l.v = r.v) as equal from v l join v r using (stash_box_id, field) left join v o on o.stash_box_id = l.stash_box_id and o.field = l.field and o.n = 3 where l.n = 2 and r.n = 4 group by 1")
def _(t):
    local, up, seen = (long_fields(snapshot(t, n)).withColumnRenamed("v", name) for n, name in ((2, "l"), (4, "r"), (3, "o")))
    j = local.join(up, ["stash_box_id", "field"]).join(seen, ["stash_box_id", "field"], "left")
    return j.groupBy("stash_box_id").agg(F.count("*").alias("fields"), F.count("o").alias("seen"), F.count_if(F.col("l") == F.col("r")).alias("equal"))


@q.add("k29_rewritten_references", f"with c as (select name, min(performer_id) keep from (select lower(trim(name)) name, performer_id from {_LATEST}) group by 1), m as (select p.performer_id, c.keep from {_LATEST} p join c on c.name = lower(trim(p.name)) where p.performer_id <> c.keep) select f.id, coalesce(m.keep, f.performer_id) as performer_id from (select distinct id, performer_id from faces) f left join (select distinct * from m) m using (performer_id)")
def _(t):
    """Performers of one name are merged into the smallest id; faces that name the others follow."""
    p = latest(t).select("performer_id", F.lower(F.trim("name")).alias("name"))
    keep = p.groupBy("name").agg(F.min("performer_id").alias("keep"))
    m = p.join(keep, "name").where("performer_id <> keep").select("performer_id", "keep").distinct()
    return t("faces").select("id", "performer_id").distinct().join(m, "performer_id", "left").select("id", F.coalesce("keep", "performer_id").alias("performer_id"))


QUERIES, SQL = q.QUERIES, q.SQL
