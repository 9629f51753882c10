"""Record-state operators, listings, metrics and scalar rules that complete the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cataloom.plans.registry import Queries
from cataloom.plans.relational_queries import _LATEST, _REC, _SCENES, _SURE, latest, recs, scenes, sure

q = Queries()
_EMB = "(select distinct id, stash_scene_id, frame_index, confidence, is_sprite, timestamp_sec from scene_face_embeddings)"


def faces_of(t):
    return t("scene_face_embeddings").select("id", "stash_scene_id", "frame_index", "confidence", "is_sprite", "timestamp_sec").distinct()


def first_of(df, by, order):
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


# ---- counts and grouped lists


@q.add("a1_filtered_counts", f"select count(*) as n, count(*) filter (status = 'pending') as pending, count(*) filter (type = 'duplicate_scenes' and status = 'pending') as pending_duplicates from {_REC}")
def _(t):
    return recs(t).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if((F.col("type") == "duplicate_scenes") & (F.col("status") == "pending")).alias("pending_duplicates"))


@q.add("a3_identity_page", f"select json_extract_string(details, '$.universal_id') as uid, count(*) as n, min(target_id) as name from {_REC} where json_extract_string(details, '$.universal_id') is not null group by 1 order by n desc, name, uid limit 20 offset 5")
def _(t):
    g = recs(t).select(F.get_json_object("details", "$.universal_id").alias("uid"), "target_id").where("uid is not null").groupBy("uid").agg(F.count("*").alias("n"), F.min("target_id").alias("name"))
    return g.orderBy(F.desc("n"), "name", "uid").offset(5).limit(20)


_APP = f"ap as (select e.stash_scene_id s, m.stashdb_id i, count(distinct e.frame_index) fc, avg(m.confidence) c from {_EMB} e join (select distinct face_id, stashdb_id, confidence from performer_match) m on m.face_id = e.id group by all)"


def appearances(t):
    m = t("performer_match").select(F.col("face_id").alias("id"), "stashdb_id", F.col("confidence").alias("c")).distinct()
    return faces_of(t).join(m, "id").groupBy(F.col("stash_scene_id").alias("s"), F.col("stashdb_id").alias("i")).agg(F.countDistinct("frame_index").alias("fc"), F.avg("c").alias("c"))


@q.add("a8_weighted_appearances", f"with {_APP}, tot as (select s, sum(fc) total from ap group by 1) select s as scene, i as identity, fc as frames, round(coalesce(fc / nullif(total, 0), 0), 6) as share, round(sum(coalesce(c, 0) * fc) over (partition by i) / nullif(sum(fc) over (partition by i), 0), 6) as weighted from ap join tot using (s)")
def _(t):
    a, total, by = appearances(t), Window.partitionBy("s"), Window.partitionBy("i")
    return a.select(F.col("s").alias("scene"), F.col("i").alias("identity"), F.col("fc").alias("frames"), F.round(F.coalesce(F.col("fc") / F.nullif(F.sum("fc").over(total), F.lit(0)), F.lit(0.0)), 6).alias("share"), F.round(F.sum(F.coalesce("c", F.lit(0.0)) * F.col("fc")).over(by) / F.nullif(F.sum("fc").over(by), F.lit(0)), 6).alias("weighted"))


_PAIR = f"pr as (select id, status, trim(split_part(target_id, ':', 1)) a, trim(split_part(target_id, ':', 2)) b, {_SURE} c from {_REC} where type = 'duplicate_scenes' and len(string_split(target_id, ':')) = 2)"


def duplicate_rows(t):
    p = F.split("target_id", ":")
    return recs(t).where((F.col("type") == "duplicate_scenes") & (F.size(p) == 2)).select("id", "status", F.trim(p[0]).alias("a"), F.trim(p[1]).alias("b"), sure().alias("c"))


@q.add("a30_grouped_duplicates", f"with {_PAIR} select status, a, count(*) as n, arg_max(id, (coalesce(c, 0), id)) as top_id, list(b order by coalesce(c, 0) desc, id desc) as matches from pr group by 1, 2")
def _(t):
    d = duplicate_rows(t).withColumn("c", F.coalesce("c", F.lit(0.0)))
    g = d.groupBy("status", "a").agg(F.count("*").alias("n"), F.max_by("id", F.struct("c", "id")).alias("top_id"), F.sort_array(F.collect_list(F.struct("c", "id", "b")), asc=False).alias("k"))
    return g.select("status", "a", "n", "top_id", F.col("k.b").alias("matches"))


@q.add("a28_group_counts", f"with {_PAIR} select status, count(distinct a) as groups, count(*) as rows_in from pr group by 1")
def _(t):
    return duplicate_rows(t).groupBy("status").agg(F.countDistinct("a").alias("groups"), F.count("*").alias("rows_in"))


@q.add("o5_group_page", f"with {_PAIR} select a, count(*) as n from pr where status = 'pending' group by 1 order by n desc, a limit 10 offset 10")
def _(t):
    return duplicate_rows(t).where("status = 'pending'").groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").offset(10).limit(10)


@q.add("a31_nested_persons", "with c as (select e.stash_scene_id scene, m.face_id, m.stashdb_id, min(m.distance) d from performer_match m join (select distinct id, stash_scene_id from scene_face_embeddings) e on e.id = m.face_id where m.distance is not null group by all), f as (select scene, face_id, list(stashdb_id order by d, stashdb_id) ids from c group by all) select scene, count(*) as persons, list(ids order by face_id) as candidates from f group by 1")
def _(t):
    """Scenes with their faces and each face's candidates, nearest first."""
    e = t("scene_face_embeddings").select(F.col("id").alias("face_id"), F.col("stash_scene_id").alias("scene")).distinct()
    c = t("performer_match").where("distance is not null").join(e, "face_id").groupBy("scene", "face_id", "stashdb_id").agg(F.min("distance").alias("d"))
    f = c.groupBy("scene", "face_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "stashdb_id"))), lambda x: x["stashdb_id"]).alias("ids"))
    return f.groupBy("scene").agg(F.count("*").alias("persons"), F.transform(F.array_sort(F.collect_list(F.struct("face_id", "ids"))), lambda x: x["ids"]).alias("candidates"))


@q.add("a21_first_ids", f"with p as (select performer_id, stash_box_id, 0 src, case when endpoint like '%boxnorth%' then 0 when endpoint like '%lumenbox%' then 1 else 2 end r from {_LATEST}), f as (select distinct performer_id, source_endpoint id, 2 src, 0 r from faces), u as (select performer_id, urls[1] id, 1 src, 0 r from {_LATEST} where len(urls) > 0), a as (select performer_id, stash_box_id id, src, r from p union all select performer_id, id, src, r from f union all select performer_id, id, src, r from u) select performer_id, arg_min(id, (src, r, id)) as first_id from a where id is not null group by 1")
def _(t):
    """Per performer: the id at the preferred endpoint, else a catalogue address, else any source of a face."""
    from cataloom.plans.matching_queries import rank_of

    l = latest(t)
    a = l.select("performer_id", F.col("stash_box_id").alias("id"), F.lit(0).alias("src"), rank_of(F.col("endpoint")).alias("r"))
    a = a.unionByName(t("faces").select("performer_id", F.col("source_endpoint").alias("id"), F.lit(2).alias("src"), F.lit(0).alias("r")).distinct()).unionByName(l.where("size(urls) > 0").select("performer_id", F.col("urls")[0].alias("id"), F.lit(1).alias("src"), F.lit(0).alias("r")))
    return a.where("id is not null").groupBy("performer_id").agg(F.min_by("id", F.struct("src", "r", "id")).alias("first_id"))


@q.add("a22_address_columns", f"with u as (select stash_box_id, pos, x, regexp_extract(lower(trim(x)), '^https?://(?:www\\.)?([a-z]+)\\.', 1) k from {_LATEST}, unnest(urls) with ordinality as y(x, pos)) select stash_box_id, arg_max(x, pos) filter (k = 'fanroom') as fanroom, arg_max(x, pos) filter (k = 'starfolk') as starfolk, arg_max(x, pos) filter (k = 'clipdesk') as clipdesk from u group by 1 having count(*) filter (k in ('fanroom', 'starfolk', 'clipdesk')) > 0")
def _(t):
    """Addresses by site in columns, the last of a site counting."""
    u = latest(t).select("stash_box_id", F.posexplode("urls").alias("pos", "x")).withColumn("k", F.regexp_extract(F.lower(F.trim("x")), r"^https?://(?:www\.)?([a-z]+)\.", 1))
    kinds = ["fanroom", "starfolk", "clipdesk"]
    return u.where(F.col("k").isin(kinds)).groupBy("stash_box_id").agg(*[F.max_by("x", F.when(F.col("k") == k, F.col("pos"))).alias(k) for k in kinds])


_TRUTH = f"tr as (select scene_id, unnest(list_distinct(performer_ids)) p from {_SCENES}), an as (select distinct cast(e.stash_scene_id as varchar) scene_id, cast(l.performer_id as varchar) p, min(m.distance) over (partition by e.stash_scene_id, l.performer_id) d from performer_match m join (select distinct id, stash_scene_id from scene_face_embeddings) e on e.id = m.face_id join {_LATEST} l on l.stash_box_id = m.stashdb_id where m.distance is not null), cmp as (select coalesce(tr.scene_id, an.scene_id) scene_id, coalesce(tr.p, an.p) p, tr.p is not null expected, an.p is not null answered, an.d from tr full join an on an.scene_id = tr.scene_id and an.p = tr.p where coalesce(tr.scene_id, an.scene_id) in (select scene_id from an))"


def compared(t):
    """Named members against answers, for scenes with answers: ``scene_id, p, expected, answered, d``."""
    truth = scenes(t).select("scene_id", F.explode(F.array_distinct("performer_ids")).alias("p"), F.lit(True).alias("x"))
    e = t("scene_face_embeddings").select(F.col("id").alias("face_id"), F.col("stash_scene_id").cast("string").alias("scene_id")).distinct()
    l = latest(t).select(F.col("stash_box_id").alias("stashdb_id"), F.col("performer_id").cast("string").alias("p"))
    answers = t("performer_match").where("distance is not null").join(e, "face_id").join(l, "stashdb_id").groupBy("scene_id", "p").agg(F.min("distance").alias("d"))
    j = truth.join(answers, ["scene_id", "p"], "full").join(answers.select("scene_id").distinct(), "scene_id", "left_semi")
    return j.select("scene_id", "p", F.col("x").isNotNull().alias("expected"), F.col("d").isNotNull().alias("answered"), "d")


@q.add("j25_truth_comparison", f"with {_TRUTH} select scene_id, count(*) filter (expected and answered) as hits, count(*) filter (answered and not expected) as extra, count(*) filter (expected and not answered) as missed from cmp group by 1")
def _(t):
    e, a = F.col("expected"), F.col("answered")
    return compared(t).groupBy("scene_id").agg(F.count_if(e & a).alias("hits"), F.count_if(a & ~e).alias("extra"), F.count_if(e & ~a).alias("missed"))


_CONFIGS = "cf as (select unnest([0.15, 0.2, 0.25, 0.3])::double most)"
_RATES = f"{_TRUTH}, {_CONFIGS}, rt as (select most, count(*) filter (expected and d <= most) tp, count(*) filter (answered and d <= most and not expected) fp, count(*) filter (expected) n from cmp, cf group by 1)"


def rates(t):
    """Hits, false answers and expected members at each distance limit."""
    c = compared(t).withColumn("most", F.explode(F.array(*[F.lit(x) for x in (0.15, 0.2, 0.25, 0.3)])))
    near = F.coalesce(F.col("d") <= F.col("most"), F.lit(False))
    return c.groupBy("most").agg(F.count_if(F.col("expected") & near).alias("tp"), F.count_if(~F.col("expected") & near).alias("fp"), F.count_if("expected").alias("n"))


@q.add("a24_micro_averages", f"with {_RATES} select most, round(coalesce(tp / nullif(n, 0), 0), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(n, 0), 0), 6) as recall from rt")
def _(t):
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    tp, fp, n = F.col("tp"), F.col("fp"), F.col("n")
    return rates(t).select("most", ratio(tp, n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, n).alias("recall"))


@q.add("o10_best_setting", f"with {_RATES} select arg_max(most, (coalesce(tp / nullif(n, 0), 0), coalesce(tp / nullif(tp + fp, 0), 0), -most)) as most from rt")
def _(t):
    tp, fp, n = F.col("tp"), F.col("fp"), F.col("n")
    key = F.struct(F.coalesce(tp / F.nullif(n, F.lit(0)), F.lit(0.0)), F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0)), -F.col("most"))
    return rates(t).agg(F.max_by("most", key).alias("most"))


@q.add("x4_compared_settings", f"with {_RATES} select most, tp, fp, n - tp as fn, tp - lag(tp) over (order by most) as gained from rt")
def _(t):
    w = Window.orderBy("most")  # four settings
    return rates(t).select("most", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn"), (F.col("tp") - F.lag("tp").over(w)).alias("gained"))


@q.add("x5_expected_ranks", f"with {_TRUTH}, r as (select *, row_number() over (partition by scene_id order by d, p) k from cmp where answered) select c.scene_id, c.p, r.k as rank, case when r.k is null then (select list(x.p order by x.k) from r x where x.scene_id = c.scene_id and x.k <= 3) end as beaten_by from cmp c left join r on r.scene_id = c.scene_id and r.p = c.p where c.expected")
def _(t):
    """Each expected member with its rank among the answers, or the three best that stand instead."""
    c = compared(t)
    r = c.where("answered").select("scene_id", "p", F.row_number().over(Window.partitionBy("scene_id").orderBy("d", "p")).alias("rank"))
    top = r.where("rank <= 3").groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p"))), lambda x: x["p"]).alias("top"))
    return c.where("expected").select("scene_id", "p").join(r, ["scene_id", "p"], "left").join(top, "scene_id", "left").select("scene_id", "p", "rank", F.when(F.col("rank").isNull(), F.col("top")).alias("beaten_by"))


@q.add("x3_short_scenes", f"with {_TRUTH} select s.scene_id, round(s.duration_seconds / 60) as minutes, count(*) filter (expected and answered) as hits, count(*) filter (expected) as expected from cmp join {_SCENES} s using (scene_id) where s.duration_seconds < 900 group by 1, 2")
def _(t):
    s = scenes(t).where("duration_seconds < 900").select("scene_id", F.round(F.col("duration_seconds") / 60).alias("minutes"))
    return compared(t).join(s, "scene_id").groupBy("scene_id", "minutes").agg(F.count_if(F.col("expected") & F.col("answered")).alias("hits"), F.count_if("expected").alias("expected"))


@q.add("a26_strategy_means", f"select is_sprite, count(*) as n, round(avg(confidence), 5) as confidence, round(avg(timestamp_sec), 5) as seconds from {_EMB} group by 1")
def _(t):
    return faces_of(t).groupBy("is_sprite").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 5).alias("confidence"), F.round(F.avg("timestamp_sec"), 5).alias("seconds"))


@q.add("a27_latency_summary", "with v as (select event_type, value x, row_number() over (partition by event_type order by value) i, count(*) over (partition by event_type) n from events where value is not null), p as (select event_type, n, max(x) filter (i = greatest(1, least(n - 1, floor((n + 1) * 0.95)))) lo, max(x) filter (i = greatest(1, least(n - 1, floor((n + 1) * 0.95))) + 1) hi, avg(x) mean, median(x) med from v group by all) select event_type, round(mean, 6) as mean, round(med, 6) as median, case when n >= 20 then round(lo + (hi - lo) * ((n + 1) * 0.95 - greatest(1, least(n - 1, floor((n + 1) * 0.95)))), 6) end as p95 from p")
def _(t):
    """Mean, median and the 95th percentile by the exclusive method; none of fewer than 20 values."""
    by = Window.partitionBy("event_type")
    v = t("events").where("value is not null").select("event_type", F.col("value").alias("x"), F.row_number().over(by.orderBy("value")).alias("i"), F.count("*").over(by).alias("n"))
    j = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor((F.col("n") + 1) * 0.95)))
    p = v.withColumn("j", j).groupBy("event_type", "n", "j").agg(F.max(F.when(F.col("i") == F.col("j"), F.col("x"))).alias("lo"), F.max(F.when(F.col("i") == F.col("j") + 1, F.col("x"))).alias("hi"), F.avg("x").alias("mean"), F.median("x").alias("med"))
    p95 = F.col("lo") + (F.col("hi") - F.col("lo")) * ((F.col("n") + 1) * 0.95 - F.col("j"))
    return p.select("event_type", F.round("mean", 6).alias("mean"), F.round("med", 6).alias("median"), F.when(F.col("n") >= 20, F.round(p95, 6)).alias("p95"))


@q.add("a15_gallery_details", "with g as (select distinct m.stashdb_id, m.name, m.face_id, m.distance from performer_match m where m.distance is not null) select stashdb_id, count(distinct face_id) as images, min(distance) as best, round(avg(distance), 4) as mean, arg_min(name, (distance, face_id, name)) as name, list_sort(list_distinct(list(face_id))) as ids from g group by 1 having count(distinct face_id) >= 2 or min(distance) < 0.4 order by images desc, best, stashdb_id")
def _(t):
    g = t("performer_match").where("distance is not null").select("stashdb_id", "name", "face_id", "distance").distinct()
    out = g.groupBy("stashdb_id").agg(F.countDistinct("face_id").alias("images"), F.min("distance").alias("best"), F.round(F.avg("distance"), 4).alias("mean"), F.min_by("name", F.struct("distance", "face_id", "name")).alias("name"), F.array_sort(F.collect_set("face_id")).alias("ids"))
    return out.where("images >= 2 or best < 0.4").orderBy(F.desc("images"), "best", "stashdb_id")


# ---- ranks and orders


@q.add("n3_best_flags", "with m as (select face_id, stashdb_id, min(distance) d from performer_match where distance is not null group by all) select face_id, stashdb_id, row_number() over (partition by face_id order by d, stashdb_id) - 1 as place, row_number() over (partition by face_id order by d, stashdb_id) = 1 as is_best from m")
def _(t):
    m = t("performer_match").where("distance is not null").groupBy("face_id", "stashdb_id").agg(F.min("distance").alias("d"))
    r = F.row_number().over(Window.partitionBy("face_id").orderBy("d", "stashdb_id"))
    return m.select("face_id", "stashdb_id", (r - 1).alias("place"), (r == 1).alias("is_best"))


@q.add("n4_candidate_ranks", f"select id, row_number() over (partition by type order by coalesce({_SURE}, 0) desc, id) as rank from {_REC}")
def _(t):
    return recs(t).select("id", F.row_number().over(Window.partitionBy("type").orderBy(F.coalesce(sure(), F.lit(0.0)).desc(), "id")).alias("rank"))


@q.add("n9_even_samples", f"with e as (select stash_scene_id s, frame_index f, row_number() over (partition by stash_scene_id order by frame_index, id) - 1 i, count(*) over (partition by stash_scene_id) n from {_EMB}) select s as scene, list(f order by i) as frames from e where n <= 8 or floor(i * 8e0 / n) <> floor((i - 1) * 8e0 / n) group by 1")
def _(t):
    """At most eight faces of a scene, at even intervals of their order."""
    w = Window.partitionBy("stash_scene_id")
    e = faces_of(t).select("stash_scene_id", "frame_index", (F.row_number().over(w.orderBy("frame_index", "id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    kept = e.where((F.col("n") <= 8) | (F.floor(F.col("i") * 8.0 / F.col("n")) != F.floor((F.col("i") - 1) * 8.0 / F.col("n"))))
    return kept.groupBy(F.col("stash_scene_id").alias("scene")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "frame_index"))), lambda x: x["frame_index"]).alias("frames"))


@q.add("o1_status_orders", f"select id, status, row_number() over (partition by status order by case when status in ('dismissed', 'resolved') then coalesce(resolved_at, updated_at) end desc nulls last, case when status = 'pending' then coalesce({_SURE}, 0) end desc nulls last, created_at desc, id desc) as place from {_REC} where type = 'duplicate_scenes'")
def _(t):
    done = F.when(F.col("status").isin("dismissed", "resolved"), F.coalesce("resolved_at", "updated_at")).desc_nulls_last()
    open_ = F.when(F.col("status") == "pending", F.coalesce(sure(), F.lit(0.0))).desc_nulls_last()
    return recs(t).where("type = 'duplicate_scenes'").select("id", "status", F.row_number().over(Window.partitionBy("status").orderBy(done, open_, F.desc("created_at"), F.desc("id"))).alias("place"))


@q.add("o3_queue_order", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority, o_orderdate, o_orderkey) as place from orders where o_orderstatus = 'O'")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    return t("orders").where("o_orderstatus = 'O'").select("o_orderkey", F.row_number().over(w).alias("place"))


@q.add("k33_free_slots", "with r as (select event_type kind, user_id, event_id, ts, row_number() over (partition by event_type order by user_id, ts, event_id) k from (select * from events qualify row_number() over (partition by event_type, user_id order by ts, event_id) = 1)) select event_id, kind from r where k <= case kind when 'click' then 3 when 'error' then 1 else 2 end")
def _(t):
    """The next jobs of each resource within its slots, no type twice."""
    once = first_of(t("events"), ["event_type", "user_id"], ["ts", "event_id"])
    slots = F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "error", 1).otherwise(2)
    r = once.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy("user_id", "ts", "event_id")))
    return r.where(F.col("k") <= slots).select("event_id", F.col("event_type").alias("kind"))


@q.add("k31_strata", f"with s as (select scene_id, case when duration_seconds is null then 'none' when duration_seconds < 900 then 'short' when duration_seconds < 1800 then 'middle' else 'long' end tier from {_SCENES}), r as (select *, row_number() over (partition by tier order by md5(scene_id), scene_id) k, dense_rank() over (order by tier) g, (select count(distinct tier) from s) m from s) select tier, scene_id from r where k <= 50 // m + case when g <= 50 % m then 1 else 0 end")
def _(t):
    """Fifty scenes, as many of each length class, the remainder to the first classes."""
    d = F.col("duration_seconds")
    s = scenes(t).select("scene_id", F.when(d.isNull(), "none").when(d < 900, "short").when(d < 1800, "middle").otherwise("long").alias("tier"))
    tiers = s.select("tier").distinct()
    numbered = tiers.withColumn("g", F.row_number().over(Window.orderBy("tier"))).crossJoin(F.broadcast(tiers.agg(F.count("*").alias("m"))))  # four classes
    r = s.withColumn("k", F.row_number().over(Window.partitionBy("tier").orderBy(F.md5("scene_id"), "scene_id"))).join(F.broadcast(numbered), "tier")
    return r.where("k <= 50 div m + case when g <= 50 % m then 1 else 0 end").select("tier", "scene_id")


# ---- predicates and scalars


@q.add("pred6_names_by_count", f"select p.stash_box_id, p.name, count(distinct f.id) as n from {_LATEST} p left join faces f using (performer_id) where contains(lower(p.name), 'an') group by 1, 2 order by n desc, name, stash_box_id")
def _(t):
    p = latest(t).where(F.lower("name").contains("an")).select("stash_box_id", "name", "performer_id")
    return p.join(t("faces").select("id", "performer_id"), "performer_id", "left").groupBy("stash_box_id", "name").agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), "name", "stash_box_id")


@q.add("pred11_several_links", "select distinct id, name from search_performer where id in (select id from (select distinct id, unnest(stash_ids) k from search_performer) group by id having count(*) > 1)")
def _(t):
    many = t("search_performer").select("id", F.explode("stash_ids").alias("k")).distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return t("search_performer").select("id", "name").distinct().join(many, "id", "left_semi")


@q.add("f3_domains", f"select distinct endpoint, regexp_replace(regexp_extract(lower(trim(endpoint)), '^(?:https?://)?([^/:]+)', 1), '^www\\.', '') as domain from {_LATEST}")
def _(t):
    return latest(t).select("endpoint").distinct().select("endpoint", F.regexp_replace(F.regexp_extract(F.lower(F.trim("endpoint")), "^(?:https?://)?([^/:]+)", 1), r"^www\.", "").alias("domain"))


@q.add("f16_empty_fields", f"select stash_box_id, coalesce(trim(disambiguation), '') = '' as no_disambiguation, coalesce(len(list_filter(alias_list, lambda x: trim(x) <> '')), 0) = 0 as no_aliases, coalesce(height_cm, 0) = 0 as no_height from {_LATEST}")
def _(t):
    aliases = F.size(F.filter(F.coalesce("alias_list", F.array().cast("array<string>")), lambda x: F.trim(x) != "")) == 0
    return latest(t).select("stash_box_id", (F.coalesce(F.trim("disambiguation"), F.lit("")) == "").alias("no_disambiguation"), aliases.alias("no_aliases"), (F.coalesce("height_cm", F.lit(0)) == 0).alias("no_height"))


@q.add("f34_first_wins", "with s as (select distinct id, stash_ids from search_performer where len(stash_ids) > 0), e as (select id, k.endpoint e, k.stash_id v, pos from s, unnest(stash_ids) with ordinality as x(k, pos)) select id, e as endpoint, arg_min(v, pos) as stash_id from e group by 1, 2")
def _(t):
    """The first id per endpoint of each array, as a map that keeps what it has would hold it."""
    e = t("search_performer").where("size(stash_ids) > 0").select("id", F.posexplode("stash_ids").alias("pos", "k")).distinct()
    return e.groupBy("id", F.col("k.endpoint").alias("endpoint")).agg(F.min_by(F.col("k.stash_id"), "pos").alias("stash_id"))


@q.add("f33_appended_ids", "select distinct id, case when list_contains(list_transform(stash_ids, lambda s: s.endpoint), 'https://boxnorth.example/graphql') then list_transform(stash_ids, lambda s: case when s.endpoint = 'https://boxnorth.example/graphql' then 'new' else s.stash_id end) else list_append(list_transform(coalesce(stash_ids, []), lambda s: s.stash_id), 'new') end as ids from search_performer")
def _(t):
    """The id at one endpoint replaced, or appended where the array has none there."""
    box = F.lit("https://boxnorth.example/graphql")
    old = F.coalesce("stash_ids", F.expr("cast(array() as array<struct<endpoint:string,stash_id:string>>)"))
    new = F.when(F.exists(old, lambda s: s["endpoint"] == box), F.transform(old, lambda s: F.when(s["endpoint"] == box, F.lit("new")).otherwise(s["stash_id"]))).otherwise(F.concat(F.transform(old, lambda s: s["stash_id"]), F.array(F.lit("new"))))
    return t("search_performer").select("id", new.alias("ids")).distinct()


@q.add("f24_zone_grids", f"with s as (select scene_id, duration_seconds d from {_SCENES} where duration_seconds > 0) select scene_id, round(d * (0.05 + 0.9 * i / 9), 6) as uniform, round(case when i < 2 then d * 0.1 * (i + 1) / 2 when i < 8 then d * (0.1 + 0.8 * (i - 1) / 6) else d * (0.9 + 0.1 * (i - 7) / 2) end, 6) as zones, i from s, (select unnest(range(10)) i)")
def _(t):
    """Ten moments of a scene, evenly spread, and weighted by three zones."""
    d, i = F.col("d"), F.col("i")
    s = scenes(t).where("duration_seconds > 0").select("scene_id", F.col("duration_seconds").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    zones = F.when(i < 2, d * 0.1 * (i + 1) / 2).when(i < 8, d * (0.1 + 0.8 * (i - 1) / 6)).otherwise(d * (0.9 + 0.1 * (i - 7) / 2))
    return s.select("scene_id", F.round(d * (0.05 + 0.9 * i / 9), 6).alias("uniform"), F.round(zones, 6).alias("zones"), "i")


@q.add("f37_progress_texts", f"select scene_id, round(least(1, coalesce(n, 0) / 20e0) * 100, 1) as pct, case when n > 0 then greatest(0, 20 - n) * 3 end as eta_seconds, repeat('#', cast(floor(least(1, coalesce(n, 0) / 20e0) * 10) as integer)) as bar from {_SCENES} s left join (select cast(stash_scene_id as varchar) k, count(distinct id) n from scene_face_embeddings group by 1) e on e.k = s.scene_id")
def _(t):
    e = t("scene_face_embeddings").groupBy(F.col("stash_scene_id").cast("string").alias("scene_id")).agg(F.countDistinct("id").alias("n"))
    share = F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 20.0)
    return scenes(t).select("scene_id").join(e, "scene_id", "left").select("scene_id", F.round(share * 100, 1).alias("pct"), F.when(F.col("n") > 0, F.greatest(F.lit(0), 20 - F.col("n")) * 3).alias("eta_seconds"), F.repeat(F.lit("#"), F.floor(share * 10).cast("int")).alias("bar"))


# ---- record state


@q.add("k34_schedules", "with n as (select user_id k, max(ts) due from events group by 1), o as (select user_id k, min(ts) due, bool_or(event_type = 'click') enabled from events group by 1) select n.k as id, case when o.enabled then o.due else n.due end as next_run from n join o using (k)")
def _(t):
    """Schedules set anew: the next run stays where one was already enabled."""
    g = t("events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("new"), F.min("ts").alias("old"), F.bool_or(F.col("event_type") == "click").alias("enabled"))
    return g.select("id", F.when(F.col("enabled"), F.col("old")).otherwise(F.col("new")).alias("next_run"))


@q.add("x25_merged_settings", "with o as (select distinct performer_id k, hair_color h, eye_color e from performer_snapshot where snapshot_no = 1 qualify row_number() over (partition by performer_id order by stash_box_id, loaded_at desc) = 1), n as (select performer_id k, hair_color h, eye_color e from performer_snapshot where snapshot_no = 4 qualify row_number() over (partition by performer_id order by stash_box_id, loaded_at desc) = 1) select coalesce(o.k, n.k) as k, coalesce(n.h, o.h) as h, coalesce(n.e, o.e) as e from o full join n on o.k = n.k")
def _(t):
    """Only the fields given anew replace the old ones."""
    p = t("performer_snapshot")
    o, n = (first_of(p.where(F.col("snapshot_no") == k), ["performer_id"], ["stash_box_id", F.desc("loaded_at")]).select(F.col("performer_id").alias("k"), F.col("hair_color").alias(f"h{k}"), F.col("eye_color").alias(f"e{k}")) for k in (1, 4))
    return o.join(n, "k", "full").select("k", F.coalesce("h4", "h1").alias("h"), F.coalesce("e4", "e1").alias("e"))


@q.add("x28_bumped_versions", f"with c as (select distinct performer_id from {_LATEST} where snapshot_no = 4) select f.id, case when c.performer_id is not null then 4 else 0 end as version from (select distinct id, performer_id from faces) f left join c using (performer_id)")
def _(t):
    c = latest(t).where("snapshot_no = 4").select("performer_id", F.lit(4).alias("v")).distinct()
    return t("faces").select("id", "performer_id").distinct().join(c, "performer_id", "left").select("id", F.coalesce("v", F.lit(0)).alias("version"))


@q.add("x29_cleared_candidates", f"select id from {_REC} where source_analysis_id is not null and source_analysis_id <> (select max(source_analysis_id) from {_REC})")
def _(t):
    """What is left after clearing the latest run and rows of no run."""
    last = recs(t).agg(F.max("source_analysis_id").alias("last"))
    return recs(t).where("source_analysis_id is not null").join(F.broadcast(last), F.col("source_analysis_id") != F.col("last")).select("id")  # one row


@q.add("x30_job_transitions", "with j as (select user_id k, list(event_type order by ts, event_id) s, max(ts) filter (event_type = 'error') failed, max(ts) last from events group by 1) select k as job, case when s[-1] = 'error' then 'failed' when failed is not null then 'retried' else 'done' end as state, len(s) as steps from j")
def _(t):
    """Where each job stands after its transitions, the last one counting."""
    j = t("events").groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.count("*").alias("steps"))
    return j.select("job", F.when(F.col("last") == "error", "failed").when(F.col("failed"), "retried").otherwise("done").alias("state"), "steps")


@q.add("x15_backfilled_times", f"with g as (select stash_scene_id s, min(timestamp_sec) filter (frame_index >= 0) a, (max(timestamp_sec) filter (frame_index >= 0) - min(timestamp_sec) filter (frame_index >= 0)) / nullif(max(frame_index) - min(frame_index) filter (frame_index >= 0), 0) step from {_EMB} where timestamp_sec is not null group by 1) select e.id, round(g.a + e.frame_index * g.step, 4) as seconds from {_EMB} e join g on g.s = e.stash_scene_id where e.timestamp_sec is null and e.frame_index >= 0 and g.step is not null")
def _(t):
    """Missing times as start and frame times interval, for frames of videos only."""
    e = faces_of(t)
    video = F.when(F.col("frame_index") >= 0, F.col("timestamp_sec"))
    g = e.where("timestamp_sec is not null").groupBy("stash_scene_id").agg(F.min(video).alias("a"), ((F.max(video) - F.min(video)) / F.nullif(F.max("frame_index") - F.min(F.when(F.col("frame_index") >= 0, F.col("frame_index"))), F.lit(0))).alias("step"))
    return e.where("timestamp_sec is null and frame_index >= 0").join(g, "stash_scene_id").where("step is not null").select("id", F.round(F.col("a") + F.col("frame_index") * F.col("step"), 4).alias("seconds"))


@q.add("x38_index_metadata", f"with s as (select distinct id, name, disambiguation, alias_list, deleted_at from search_performer qualify row_number() over (partition by id order by deleted_at is not null, created_at desc, name) = 1) select id, name, coalesce(len(alias_list), 0) as aliases, coalesce(trim(disambiguation), '') as disambiguation from s where deleted_at is null")
def _(t):
    """The index of library rows: the live row of each id; deleted ones are taken out."""
    s = first_of(t("search_performer").distinct(), ["id"], [F.col("deleted_at").isNotNull(), F.desc("created_at"), "name"]).where("deleted_at is null")
    return s.select("id", "name", F.coalesce(F.when(F.col("alias_list").isNotNull(), F.size("alias_list")), F.lit(0)).alias("aliases"), F.coalesce(F.trim("disambiguation"), F.lit("")).alias("disambiguation"))


@q.add("x39_stale_hashes", "with f as (select id, max(image_sha256) h from faces group by 1), c as (select id, image_sha256 h from face_change where image_sha256 is not null qualify row_number() over (partition by id order by change_seq desc) = 1) select c.id, f.id is null as missing, f.h is distinct from c.h as stale from c left join f using (id)")
def _(t):
    """Stored checksums against the latest delivered ones."""
    f = t("faces").groupBy("id").agg(F.max("image_sha256").alias("g"), F.lit(True).alias("there"))
    c = first_of(t("face_change").where("image_sha256 is not null").select("id", "image_sha256", "change_seq").distinct(), ["id"], [F.desc("change_seq")])
    return c.join(f, "id", "left").select("id", F.col("there").isNull().alias("missing"), (~F.col("g").eqNullSafe(F.col("image_sha256"))).alias("stale"))


@q.add("x9_disambiguation_classes", f"with u as (select distinct m.stashdb_id from performer_match m), d as (select k.stash_id s, max(nullif(trim(disambiguation), '')) x from (select disambiguation, unnest(stash_ids) k from search_performer) group by 1) select u.stashdb_id, coalesce(d.x, nullif(trim(l.disambiguation), '')) as disambiguation from u left join d on d.s = u.stashdb_id left join {_LATEST} l on l.stash_box_id = u.stashdb_id")
def _(t):
    """A library row linked to the identity speaks first, then the catalogue's own entry."""
    u = t("performer_match").select("stashdb_id").distinct()
    d = t("search_performer").select(F.explode("stash_ids").alias("k"), F.nullif(F.trim("disambiguation"), F.lit("")).alias("x")).groupBy(F.col("k.stash_id").alias("stashdb_id")).agg(F.max("x").alias("x"))
    l = latest(t).select(F.col("stash_box_id").alias("stashdb_id"), F.nullif(F.trim("disambiguation"), F.lit("")).alias("y"))
    return u.join(d, "stashdb_id", "left").join(l, "stashdb_id", "left").select("stashdb_id", F.coalesce("x", "y").alias("disambiguation"))


@q.add("t9_sliding_windows", "select w as start, event_type, count(*) as n from (select event_type, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) w from events) group by all")
def _(t):
    """Windows of an hour that start every half hour."""
    g = t("events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@q.add("t9_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end f from events), s as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def _(t):
    """Sessions of a user's events less than six hours apart."""
    g = t("events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# ---- scans, sinks and incremental runs


@q.add("s8_full_counts", "select 'scene' as entity, count(distinct scene_id) as n from scene union all select 'performer', count(distinct stash_box_id) from performer_snapshot union all select 'library', count(distinct id) from search_performer")
def _(t):
    parts = [t(n).agg(F.countDistinct(k).alias("n")).select(F.lit(e).alias("entity"), "n") for e, n, k in (("scene", "scene", "scene_id"), ("performer", "performer_snapshot", "stash_box_id"), ("library", "search_performer", "id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@q.add("s9_changed_page", f"select scene_id, count(*) over () as total from {_SCENES} where updated_at > timestamp '2024-06-01' order by updated_at, scene_id limit 25 offset 25")
def _(t):
    """The second page of the scenes changed since, with the number of all of them."""
    s = scenes(t).where(F.col("updated_at") > F.lit("2024-06-01").cast("timestamp_ntz")).select("scene_id", "updated_at")
    page = s.orderBy("updated_at", "scene_id").offset(25).limit(25)
    return page.join(F.broadcast(s.agg(F.count("*").alias("total")))).select("scene_id", "total")  # one row


@q.add("s12_hash_lookups", "select f.id, count(distinct c.id) as matches from (select distinct id, lower(trim(image_sha256)) h from faces) f join (select distinct id, lower(trim(image_sha256)) h from face_change where image_sha256 is not null) c using (h) group by 1")
def _(t):
    """Stored hashes looked up among the delivered ones, all at once instead of forty a request."""
    h = lambda df: df.select("id", F.lower(F.trim("image_sha256")).alias("h")).where("h is not null").distinct()
    return h(t("faces")).join(h(t("face_change")).withColumnRenamed("id", "other"), "h").groupBy("id").agg(F.countDistinct("other").alias("matches"))


@q.add("s13_remote_records", f"select distinct s.id, k.stash_id, l.name, l.country from (select id, unnest(stash_ids) k from search_performer) s join {_LATEST} l on l.stash_box_id = s.k.stash_id")
def _(t):
    e = t("search_performer").select("id", F.explode("stash_ids").alias("k")).select("id", F.col("k.stash_id").alias("stash_id"))
    return e.join(latest(t).select(F.col("stash_box_id").alias("stash_id"), "name", "country"), "stash_id").select("id", "stash_id", "name", "country").distinct()


@q.add("w8_exported_faces", f"with g as (select unnest(generate_series(0, (select max(embedding_index) from faces))) i), f as (select embedding_index i, min(id) id, min(performer_id) p from faces group by 1), l as (select performer_id p, min(name) name from {_LATEST} group by 1) select g.i as embedding_index, f.id, l.name from g left join f using (i) left join l on l.p = f.p")
def _(t):
    """The export by place, gaps filled with nulls, written and read as JSON."""
    from cataloom.workspace import shared_folder

    import uuid

    top = t("faces").agg(F.max("embedding_index")).first()[0]
    f = t("faces").groupBy("embedding_index").agg(F.min("id").alias("id"), F.min("performer_id").alias("performer_id"))
    l = latest(t).groupBy("performer_id").agg(F.min("name").alias("name"))
    spark = f.sparkSession
    places = spark.range(int(top if top is not None else -1) + 1).withColumnRenamed("id", "embedding_index")
    out = places.join(f, "embedding_index", "left").join(l, "performer_id", "left").select("embedding_index", "id", "name")
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    out.write.option("ignoreNullFields", "false").json(path)
    return spark.read.schema("embedding_index long, id long, name string").json(path)


_MARKS = "m as (select event_type, max(ts) filter (event_id % 2 = 0) mark, count(*) filter (value is null or value < 0) skipped from events group by 1)"


@q.add("t4_withheld_marks", f"with {_MARKS}, n as (select event_type, max(ts) newest from events group by 1) select event_type, case when skipped > 0 then mark else newest end as watermark from m join n using (event_type)")
def _(t):
    """A mark moves only where nothing was skipped."""
    return t("events").groupBy("event_type").agg(F.when(F.count_if(F.col("value").isNull() | (F.col("value") < 0)) > 0, F.max(F.when(F.col("event_id") % 2 == 0, F.col("ts")))).otherwise(F.max("ts")).alias("watermark"))


@q.add("t5_advanced_marks", "select event_type, max(ts) as watermark from events group by 1")
def _(t):
    """The upstream run's mark moves whatever failed."""
    return t("events").groupBy("event_type").agg(F.max("ts").alias("watermark"))


@q.add("t3_kept_snapshots", "select stash_box_id, snapshot_no from (select distinct stash_box_id, snapshot_no, endpoint from performer_snapshot) where snapshot_no = case when endpoint like '%boxnorth%' then 4 else 3 end")
def _(t):
    """Snapshots taken under the logic version in force at their endpoint; the others ask for a full run."""
    p = t("performer_snapshot").select("stash_box_id", "snapshot_no", "endpoint").distinct()
    return p.where(F.col("snapshot_no") == F.when(F.col("endpoint").contains("boxnorth"), 4).otherwise(3)).select("stash_box_id", "snapshot_no")


@q.add("t6_resumed_jobs", "with j as (select user_id k, count(*) n, max(event_id) filter (event_type <> 'error') pos from events group by 1) select k as job, coalesce(pos, -1) + 1 as resume_from, (select count(*) from events e where e.user_id = j.k and e.event_id > coalesce(j.pos, -1)) as left_over from j")
def _(t):
    """Where each interrupted job goes on: behind the last step that ended well."""
    ok = F.when(F.col("event_type") != "error", F.col("event_id"))
    w = Window.partitionBy("user_id")
    e = t("events").select("user_id", "event_id", F.max(ok).over(w).alias("at"))
    return e.groupBy(F.col("user_id").alias("job")).agg((F.coalesce(F.max("at"), F.lit(-1)) + 1).alias("resume_from"), F.count_if(F.col("event_id") > F.coalesce("at", F.lit(-1))).alias("left_over"))


QUERIES, SQL = q.QUERIES, q.SQL
