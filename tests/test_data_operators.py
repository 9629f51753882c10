"""Core data operators: nulls, empty tables, ties, repeats and clashing columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cataloom.operators import changes, references, snapshots

SNAP = "snapshot_no int, stash_box_id string, loaded_at timestamp_ntz, hair_color string, country string, urls array<string>, _hash string"


def at(day, hour=0):
    return dt.datetime(2025, 1, day, hour)


def diff(spark, rows):
    df = spark.createDataFrame(rows, SNAP)
    out = snapshots.snapshot_changes(df, "stash_box_id", "snapshot_no", "loaded_at", ["hair_color", "country"], ["urls"])
    return sorted(tuple(r) for r in out.collect())


def test_snapshot_changes_cases(spark):
    rows = [
        (1, "a", at(1), "Red", None, ["https://x/1/", "https://x/2"], "z"),
        (2, "a", at(2), " red ", "", ["https://X/2", "https://x/1", "https://x/1"], "y"),  # only written differently
        (3, "a", at(3), "Blue", None, [], None),
        (1, "b", at(1), "Red", None, None, None),
        (3, "b", at(3), "Red", None, None, None),  # away in 2
        (2, "c", at(2), "Red", None, None, None),
        (2, "c", at(2, 5), "Grey", None, None, None),  # delivered again
        (3, "c", at(3), "grey", None, None, None),
        (3, "c", at(3), "grey", None, None, None),
        (3, None, at(3), "grey", None, None, None),
        (None, "d", at(3), "grey", None, None, None),
        (3, "e", None, None, None, [None], None),
    ]
    assert diff(spark, rows) == [(2, "b", "removed"), (2, "c", "added"), (3, "a", "changed"), (3, "b", "added"), (3, "e", "added")]


def test_snapshot_changes_empty_and_single(spark):
    assert diff(spark, []) == []
    assert diff(spark, [(1, "a", at(1), "Red", None, None, None)]) == []


def test_validity_intervals(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 5, "y")], "k string, n int, h string")
    got = sorted((r["h"], r["first"], r["last"]) for r in snapshots.validity_intervals(df, "k", "n", "h").collect())
    assert got == [("x", 1, 2), ("y", 3, 3), ("y", 5, 5)]


BASE = "id long, v string, seq long, op string"
FEED = "n long, op string, id long, v string, junk string"


def apply(spark, base, feed):
    out = changes.apply_changes(spark.createDataFrame(base, BASE), spark.createDataFrame(feed, FEED), "id", "n", "seq", "op", ["v"])
    return sorted(tuple(r) for r in out.collect())


def test_changes_cases(spark):
    base = [(1, "a", 5, None), (1, "a", 5, None), (2, "b", 9, None), (3, "c", None, None), (6, None, 1, None)]
    feed = [
        (4, "update", 1, "old", None),  # already contained
        (7, " Update ", 1, "new", None),
        (7, "update", 1, "new", None),
        (6, "D", 1, None, None),  # late
        (10, "Removed", 2, None, None),
        (1, "U", 3, "c2", None),
        (3, "update", 4, "fresh", None),
        (8, "insert", 5, "x", None),
        (9, "delete", 5, None, None),
        (11, "insert", None, "nobody", None),
        (None, "delete", 6, None, None),
        (12, None, 7, "no op", None),
    ]
    assert apply(spark, base, feed) == [(1, "new"), (3, "c2"), (4, "fresh"), (6, None)]  # a change without operation changes nothing


def test_changes_empty_sides(spark):
    assert apply(spark, [], []) == []
    assert apply(spark, [(1, "a", 5, None)], []) == [(1, "a")]
    assert apply(spark, [], [(1, "insert", 1, "a", None)]) == [(1, "a")]


def test_changes_hot_key_is_cut_before_the_shuffle(spark):
    df = changes.apply_changes(spark.createDataFrame([], BASE), spark.range(1000).selectExpr("id n", "'update' op", "cast(1 as long) id", "cast(id as string) v", "'x' junk"), "id", "n", "seq", "op", ["v"])
    assert [tuple(r) for r in df.collect()] == [(1, "999")]
    plan = df._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


REFS = "domain string, key long, made timestamp_ntz, tag string"


def orphans(spark, refs, parents, **kw):
    held = spark.createDataFrame(parents, "domain string, key long, live boolean, since timestamp_ntz")
    return sorted((r["tag"], r["reason"]) for r in references.orphan_references(spark.createDataFrame(refs, REFS), held, **kw).collect())


def test_orphan_references_cases(spark):
    parents = [("s", 1, True, at(1)), ("s", 2, False, None), ("s", 3, True, at(20)), ("s", 4, True, None), ("p", 5, True, at(1))]
    refs = [("s", 1, at(5), "ok"), ("s", 2, at(5), "gone"), ("s", 3, at(5), "early"), ("s", 3, None, "timeless"), ("s", 4, at(5), "always"), ("s", 5, at(5), "other domain"), ("s", None, at(5), "null"), ("x", 1, at(5), "no domain"), ("s", 9, at(5), "none"), ("s", 9, at(5), "none")]
    want = [("early", "late"), ("gone", "deleted"), ("no domain", "missing"), ("none", "missing"), ("none", "missing"), ("other domain", "missing")]
    assert orphans(spark, refs, parents) == want
    assert orphans(spark, refs, parents, task_rows=2) == want
    assert orphans(spark, [], parents) == []
    assert orphans(spark, refs[:1], []) == [("ok", "missing")]


def test_orphan_references_hot_key_is_salted(spark):
    refs = spark.range(3000).select(F.lit("s").alias("domain"), F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).cast("long").alias("key"), F.lit(at(1)).cast("timestamp_ntz").alias("made"), F.col("id").cast("string").alias("tag"))
    held = spark.range(0, 3000, 2).select(F.lit("s").alias("domain"), F.col("id").alias("key"), F.lit(True).alias("live"), F.lit(at(1)).cast("timestamp_ntz").alias("since"))
    out = references.orphan_references(refs, held, task_rows=200)
    assert out.count() == 1500 + 750
    assert out.select("tag").distinct().count() == 2250


def test_catalogue_orphans(spark):
    emb = spark.createDataFrame([(1, 10, at(5)), (1, 10, at(5)), (2, 99, at(5)), (3, None, at(5))], "id long, stash_scene_id long, created_at timestamp_ntz")
    rec = spark.createDataFrame([(1, "duplicate_scenes", " 10: 98 ", at(6)), (2, "duplicate_scenes", "97:", at(6)), (3, "duplicate_scenes", "x1;2", at(6)), (4, "scene_face_match", " 96|a|b", at(6)), (5, "upstream_performer_changes", "7", at(6)), (6, None, None, at(6))], "id long, type string, target_id string, created_at timestamp_ntz")
    scene = spark.createDataFrame([("10", at(1), None), ("x", at(1), None), (None, at(1), None), ("97", at(1), at(2))], "scene_id string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    people = spark.createDataFrame([(7, at(1), at(2)), (7, at(9), None)], "id long, created_at timestamp_ntz, deleted_at timestamp_ntz")
    got = sorted(tuple(r) for r in references.catalogue_orphans(emb, rec, scene, people).collect())
    assert got == [("recommendations", 1, "98", "missing", "2025-01"), ("recommendations", 2, "97", "deleted", "2025-01"), ("recommendations", 4, "96", "missing", "2025-01"), ("recommendations", 5, "7", "late", "2025-01"), ("scene_face_embeddings", 2, "99", "missing", "2025-01")]
    report = references.orphan_report(references.catalogue_orphans(emb, rec, scene, people)).collect()
    assert sum(r["orphans"] for r in report) == 5


@pytest.mark.parametrize("op, gone", [("delete", True), (" Removed", True), ("D", True), ("update", False), ("upsert", False)])
def test_delete_words(spark, op, gone):
    assert spark.range(1).select(changes.is_delete(F.lit(op))).first()[0] is gone


def test_unknown_operations_change_nothing(spark):
    base = spark.createDataFrame([(1, 5, "a")], "id long, s long, v string")
    feed = spark.createDataFrame([(1, 9, "truncate", "b"), (1, 8, None, "c"), (2, 3, " Upsert ", "d")], "id long, c long, op string, v string")
    got = changes.apply_changes(base, feed, "id", "c", "s", "op", ["v"])
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (2, "d")}
    assert changes.unreadable_changes(feed, "op").count() == 2
