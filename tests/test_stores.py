"""Stores: swapped tables, checkpoints, vector indexes and SQLite files."""

import sqlite3

from cataloom.sources import stores


def test_swap_keeps_the_former_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    stores.swap_table(spark.range(3), path)
    stores.swap_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(path + ".prev").count() == 3


def test_checkpoint_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    assert stores.load_checkpoint(spark, path) is None
    stores.save_checkpoint(spark, path, {"at": 7, "done": ["a"]})
    stores.save_checkpoint(spark, path, {"at": 9, "done": []})
    assert stores.load_checkpoint(spark, path) == {"at": 9, "done": []}


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (None, [1.0])], "k long, v array<double>")
    stores.save_index(df, f"file://{tmp_path}/i", "k", "v")
    assert [(r["id"], r["v"]) for r in stores.load_index(spark, f"file://{tmp_path}/i").collect()] == [(1, [1.0, 2.0])]


def test_sqlite_in_ranges(spark, tmp_path):
    path = f"{tmp_path}/x.db"
    with sqlite3.connect(path) as held:
        held.execute("create table p (id integer primary key, name text, score real)")
        held.executemany("insert into p values (?, ?, ?)", [(i, f"n{i}" if i % 2 else None, i / 2) for i in range(1, 26)])
        held.execute("create table empty (id integer)")
    got = stores.read_sqlite(spark, path, "p", "id", "id long, name string, score double", rows=10)
    assert {tuple(r) for r in got.collect()} == {(i, f"n{i}" if i % 2 else None, i / 2) for i in range(1, 26)}
    assert stores.read_sqlite(spark, path, "empty", "id", "id long").count() == 0


def test_pages(spark):
    page, total = stores.pages(spark.range(25), ["id"], 10, 3)
    assert total == 25 and [r["id"] for r in page.collect()] == [20, 21, 22, 23, 24]
