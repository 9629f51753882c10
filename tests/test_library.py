"""Scalar functions, state, sources, vectors and scoring on small cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cataloom.functions import scalars as S
from cataloom.operators import scoring, state, vectors
from cataloom.operators.ordered import gaps, with_positions
from cataloom.operators.quantiles import exclusive_quantile
from cataloom.plans import duplicate_queries
from cataloom.sources import files
from cataloom.streaming import incremental


@pytest.mark.parametrize(
    "expr, want",
    [
        (lambda: S.url_key(F.lit(" HTTPS://www.X.com/A// ")), "x.com/a"),
        (lambda: S.url_key(F.lit(None).cast("string")), ""),
        (lambda: S.endpoint_key(F.lit("https://Box.org/graphql/")), "box.org"),
        (lambda: S.endpoint_domain(F.lit("www.box.org/graphql")), "box.org"),
        (lambda: S.universal_kind(F.lit("box.org:1")), "stashbox"),
        (lambda: S.universal_kind(F.lit("local:1")), "local"),
        (lambda: S.universal_kind(F.lit("cat:1")), "catalogue"),
        (lambda: S.universal_kind(F.lit("1")), "unknown"),
        (lambda: S.mostly_latin(F.lit("Анна")), False),
        (lambda: S.display_name(F.lit("Анна"), F.array(F.lit("Аня"), F.lit("Anna"))), "Anna"),
        (lambda: S.duration_text(F.lit(3725.9)), "1:02:05"),
        (lambda: S.duration_text(F.lit(65.0)), "1:05"),
        (lambda: S.duration_text(F.lit(None).cast("double")), "Unknown"),
        (lambda: S.size_text(F.lit(1536.0)), "1.5 KB"),
        (lambda: S.padded_date(F.lit("2014")), "2014-01-01"),
        (lambda: S.padded_date(F.lit("2014-08")), "2014-08-01"),
        (lambda: S.padded_date(F.lit("2014-08-09T10:00")), "2014-08-09"),
        (lambda: S.days_between(F.lit("2014-08-09"), F.lit("2014-08-01")), 8),
        (lambda: S.days_between(F.lit("2014-08"), F.lit("2014-08-01")), None),
        (lambda: S.nullish_text(F.lit("NULL")), ""),
        (lambda: S.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), 1.0),
        (lambda: S.yaw_factor(F.lit(67.5)), 0.75),
        (lambda: S.yaw_factor(F.lit(-120.0)), 0.5),
        (lambda: S.yaw_factor(F.lit(None).cast("double")), 1.0),
        (lambda: S.version_parts(F.lit("v1.x.10")), [1, 0, 10]),
        (lambda: S.cue_seconds(F.lit("01:02:03.500")), 3723.5),
        (lambda: S.cue_seconds(F.lit("02:03.5")), 123.5),
        (lambda: S.even_grid(F.lit(0.0), F.lit(10.0), 1), [5.0]),
        (lambda: S.even_grid(F.lit(0.0), F.lit(10.0), 3), [0.0, 5.0, 10.0]),
        (lambda: S.stride(F.lit(33)), 64),
        (lambda: S.resolution_tier(F.lit(1920), F.lit(1080)), "1080p"),
        (lambda: S.gender_key(F.lit("transgender female")), "TRANSGENDER_FEMALE"),
        (lambda: S.phash_bits(F.lit("0xFFFFFFFFFFFFFFFF")), -1),
        (lambda: S.phash_bits(F.lit("xyz")), None),
        (lambda: S.hamming(F.lit(0b1011), F.lit(0b0001)), 2),
        (lambda: S.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")), 0.0),
        (lambda: S.first_occurrences(F.array(F.lit(" Bo "), F.lit("bo"), F.lit("Al"), F.lit("")), F.lit("al")), ["Bo"]),
        (lambda: S.url_path(F.lit("https://x.org/a/b?c=1")), "/a/b?c=1"),
        (lambda: F.to_json(S.measurements(F.lit("34c-24-36"))), '{"band":34,"cup":"C","waist":24,"hip":36}'),
        (lambda: F.to_json(S.career_years(F.lit("2010-"))), '{"start":2010}'),
        (lambda: S.unescaped(F.lit("&amp;lt; &lt;")), "&lt; <"),
        (lambda: S.percent(F.lit(1), F.lit(0)), 0),
        (lambda: S.setting(F.lit(None).cast("double"), F.lit(5.0), F.lit(1.0), 0.0, 2.0), 2.0),
        (lambda: scoring.hash_score(F.lit(4)), 59.0),
        (lambda: scoring.hash_score(F.lit(11)), 0.0),
        (lambda: scoring.pair_confidence(F.lit(0), F.lit(60.0), F.lit(75.0)), 95.0),
        (lambda: scoring.pair_confidence(F.lit(8), F.lit(0.0), F.lit(0.0)), 19.8),
        (lambda: scoring.pair_confidence(F.lit(None).cast("int"), F.lit(45.0), F.lit(30.0)), 54.0),
        (lambda: scoring.pair_confidence(F.lit(None).cast("int"), F.lit(0.0), F.lit(0.0)), None),
    ],
)
def test_scalars(spark, expr, want):
    got = spark.range(1).select(expr()).first()[0]
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def pair_score(spark, a, b):
    schema = "scene_id string, studio_id string, date string, performer_ids array<string>, duration_seconds double"
    rows = scoring.scored_pairs(spark.createDataFrame([("1", *a), ("2", *b)], schema)).collect()
    return rows[0]["confidence"] if rows else None


def test_pair_scoring(spark):
    assert pair_score(spark, ("s", "2020-01-01", ["p", "q"], 600.0), ("s", "2020-01-01", ["q", "p"], 600.0)) == 55
    assert pair_score(spark, ("s", None, ["p"], None), ("s", "2020-01-01", ["p"], 600.0)) == 25
    assert pair_score(spark, ("s", "2020-01-01", ["p"], 360.0), ("s", "2020-01-01", ["p"], 3600.0)) == 35
    assert pair_score(spark, ("s", "2020-01-01", [], 360.0), ("s", "2020-01-01", [], 360.0)) is None


def test_state(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, None, 7)], "k int, v string, n int")
    n = spark.createDataFrame([(2, "b", None), (3, "c", 1), (3, "c", 1)], "k int, v string, n int")
    assert sorted((r["k"], r["v"]) for r in state.insert_ignore(t, n, ["k"]).collect()) == [(1, "a"), (2, None), (3, "c")]
    assert sorted(tuple(r) for r in state.upsert(t, n.distinct(), ["k"], keep=["n"]).collect()) == [(1, "a", 5), (2, "b", 7), (3, "c", 1)]
    assert sorted(tuple(r) for r in state.push_forward(t, n, ["k"], "n").collect()) == [(1, 5), (2, 7), (3, 1)]
    assert sorted(r["k"] for r in state.replace_keys(t, n, "k").collect()) == [1, 2, 3, 3]
    assert [r["k"] for r in state.delete_keys(t, n, "k").collect()] == [1]
    assert sorted((r["embedding"], r["v"]) for r in state.positional(spark.createDataFrame([(0, "a"), (3, "d")], "embedding long, v string"), "embedding", "v").collect()) == [(0, "a"), (1, None), (2, None), (3, "d")]
    moved = state.relocate({"t": (t, "k")}, spark.createDataFrame([(2,)], "id int"), 10)["t"]
    assert sorted(r["k"] for r in moved.collect()) == [1, 11]


def test_version_chain(spark):
    steps = spark.createDataFrame([("1", "2"), ("2", "3"), ("9", "8"), ("8", "9")], "source string, version string")
    assert state.version_chain(steps, "1", "3") == ["2", "3"]
    assert state.version_chain(steps, "0", "3") is None
    assert state.version_chain(steps, "1", "9") is None


def test_closure(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (None, 5)], "a long, b long")
    assert sorted(tuple(r) for r in state.closure_pairs(e).collect()) == [(1, 2), (1, 3), (2, 3), (7, 8)]


def test_order_without_one_task(spark):
    df = spark.createDataFrame([(i * i,) for i in range(1, 30)], "x int")
    assert [r["position"] for r in with_positions(df, "x").orderBy("x").collect()] == list(range(1, 30))
    assert sorted(tuple(r) for r in gaps(df, "x").collect())[0] == (3, 1) and gaps(df, "x").count() == 28
    assert exclusive_quantile(df, "x", 0.5).first()["q"] == 225
    assert exclusive_quantile(df, "x", 0.5, least=50).first()["q"] is None


def test_vector_search(spark):
    rng = np.random.RandomState(0)
    m = rng.randn(40, 5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(90, None), (91, [0.0] * 5), (92, [1.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["query_id"], r["index_id"]) for r in vectors.search(df.where("id < 3"), df, "id", "id", "v", k=4).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for q in range(3):
        d = [(round(1 - u[q] @ u[i], 9), i) for i in range(40)] + [(1.0, 91)]
        want |= {(q, i) for _, i in sorted(d)[:4]}
    assert got == want
    assert vectors.search(df.limit(0), df, "id", "id", "v", k=2).count() == 0


def test_vector_search_counts_repeated_ids_once(spark):
    m = [[1.0, 0.01 * i] for i in range(30)]
    rows = [(i, v) for i, v in enumerate(m) for _ in range(6 if i < 3 else 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    got = vectors.search(df.where("id = 0"), df, "id", "id", "v", k=4).collect()
    assert {(r["index_id"], r["rank"]) for r in got} == {(0, 1), (1, 2), (2, 3), (3, 4)}
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.2]), (2, [1.0, 0.3])], "id long, v array<double>").coalesce(1)
    assert {(r["index_id"], r["rank"]) for r in vectors.search(two.where("id = 0"), two, "id", "id", "v", k=3).collect()} == {(0, 1), (1, 2), (2, 3)}


@pytest.mark.parametrize("most", [0, 3, 10])
def test_hamming_pairs(spark, most):
    rng = np.random.RandomState(1)
    h = [int(x) for x in rng.randint(-(2**62), 2**62, 12)]
    h += [h[0] ^ 0b111, h[1] ^ (1 << 63) - 2**64 if h[1] >= 0 else h[1] ^ 1, h[2] ^ 0b1111111111, h[3]]
    rows = [(i, x) for i, x in enumerate(h)] + [(99, None)]
    got = {tuple(r) for r in vectors.hamming_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", most).collect()}
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == {(i, j, bits(h[i], h[j])) for i in range(len(h)) for j in range(i + 1, len(h)) if bits(h[i], h[j]) <= most}


def test_hamming_pieces_lie_in_the_bits_used(spark):
    assert vectors.pieces_of(24, 3) == [(0, 8), (8, 8), (16, 8)]
    assert sorted(vectors.masks_of(3, 1)) == [0, 1, 2, 4]
    rng = np.random.RandomState(2)
    h = [int(x) for x in rng.randint(0, 2**24, 60)]
    h += [h[0] ^ 0b11, h[1] ^ (1 << 23), h[2] ^ (1 << 23 | 1 << 8), h[3] ^ 0b111]
    df = spark.createDataFrame(list(enumerate(h)), "id long, h long")
    got = {tuple(r) for r in vectors.hamming_pairs(df, "id", "h", 2, size=24).collect()}
    assert got == {(i, j, (h[i] ^ h[j]).bit_count()) for i in range(len(h)) for j in range(i + 1, len(h)) if (h[i] ^ h[j]).bit_count() <= 2}


def test_rows_near_any_query(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ANY_BLOCK", 40)
    monkeypatch.setattr(vectors, "ANY_ROWS", 16)
    rng = np.random.RandomState(6)
    x, y = rng.randn(90, 8), np.concatenate([rng.randn(200, 8), np.zeros((1, 8))])
    a, b = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None), (998, [1.0]), (997, [float("nan")] * 8)], "id long, v array<double>") for m in (x, y))
    d = np.round(1 - (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y[:200] / np.linalg.norm(y[:200], axis=1, keepdims=True)).T, 9)
    for within in (0.2, float(np.sort(d.ravel())[60])):
        got = [r["index_id"] for r in vectors.near_any(a, b.union(b), "id", "id", "v", within).collect()]
        assert sorted(got) == sorted(np.nonzero((d <= within).any(0))[0].tolist() + [998])


def test_mean_faces_without_a_row_for_each_number(spark):
    v = lambda *x: [float(i) for i in x] + [0.0] * (128 - len(x))
    rows = [(1, 5, v(1)), (1, 5, v(1)), (2, 5, v(0, 3)), (2, 6, v(0, 3)), (3, 6, None), (4, 6, v(0)), (5, 7, [1.0]), (6, None, v(1)), (7, 6, [None] + v(1)[1:])]
    df = spark.createDataFrame(rows, "id long, stash_scene_id long, embedding array<float>")
    out = duplicate_queries.centroids(lambda _: df)
    assert {r["scene"]: r["mean"][:2] for r in out.collect()} == {5: [0.5, 1.5], 6: [0.0, 3.0]}
    assert "Generate" not in out._jdf.queryExecution().toString()  # a row for each number filled the disk


def test_online_clusters(spark):
    rows = [(1, 2, 0, [1.0, 0.0]), (1, 1, 1, [0.9, 0.1]), (1, 3, 2, [0.0, 1.0]), (1, 4, 3, None), (2, 9, 0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "g long, id long, f int, v array<double>")
    got = {r["id"]: r["cluster"] for r in scoring.online_clusters(df, "g", ["f", "id"], "id", "v").collect()}
    assert got == {2: 0, 1: 0, 3: 1, 4: 2, 9: 0}


def test_online_clusters_with_many_means(spark):
    rng = np.random.RandomState(5)
    x = np.concatenate([rng.randn(900, 100), rng.randn(300, 100)[rng.randint(300, size=900)] + 0.4 * rng.randn(900, 100)])
    bad = [[], None, [0.0] * 100, [float("nan")] * 100, [1.0, 2.0], [2.0, 4.0]]
    vectors_ = [*x.tolist(), *bad]
    rows = [(g, i, i // 2, v) for g in (1, None) for i, v in enumerate(vectors_) if g or i % 3 == 0]
    means, want, count = [], {}, 0
    for i, v in enumerate(x):
        m = np.array(means).reshape(-1, 100)
        d = 1 - m @ v / (np.linalg.norm(m, axis=1) * np.linalg.norm(v))
        if len(d) and d.min() < 0.6:
            want[i] = int(np.argmin(d))
            means[want[i]] = means[want[i]] + v
        else:
            want[i], count = count, count + 1
            means.append(v)
    assert len(means) > scoring.FEW_MEANS + scoring.FOLD_ROWS
    want |= {1800: count, 1801: count + 1, 1802: count + 2, 1803: count + 3, 1804: count + 4, 1805: count + 4}
    df = spark.createDataFrame(rows + rows[:40], "g long, id long, f int, v array<double>")
    found = scoring.online_clusters(df, "g", ["f", "id"], "id", "v").collect()
    got = {r["id"]: r["cluster"] for r in found if r["g"] == 1}
    assert got == want and len(found) == len(rows)


def test_greedy_identities_of_many_groups_in_few_tasks(spark):
    rows = [(g, c, 9 - c, i, s) for g in range(3000) for c, i, s in ((0, "a", 0.9), (0, "b", 0.5), (1, "a", 0.95), (1, "b", 0.4), (2, "a", 1.0))]
    out = scoring.greedy_identities(spark.createDataFrame(rows, "g long, c int, n int, i string, s double"), "g", "c", "n", "i", "s")
    assert sorted((r["g"], r["c"], r["i"]) for r in out.collect()) == [(g, c, i) for g in range(3000) for c, i in ((0, "a"), (1, "b"))]
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # one call a group took as long as all else


def test_greedy_identities(spark):
    rows = [(1, 0, 9, "a", 0.9), (1, 0, 9, "b", 0.5), (1, 1, 4, "a", 0.95), (1, 1, 4, "b", 0.4), (1, 2, 2, "a", 1.0)]
    out = scoring.greedy_identities(spark.createDataFrame(rows, "g long, c int, n int, i string, s double"), "g", "c", "n", "i", "s")
    assert sorted((r["c"], r["i"]) for r in out.collect()) == [(0, "a"), (1, "b")]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.12345, "a")], "id long, x double, s string")
    files.write_csv(df, str(tmp_path / "c"))
    assert tuple(files.read_csv(spark, str(tmp_path / "c"), "id long, x double, s string").first()) == (1, 0.123, "a")
    files.write_json(df, str(tmp_path / "j"))
    assert tuple(files.read_json(spark, str(tmp_path / "j"), "id long, x double, s string", lines=True).first()) == (1, 0.12345, "a")
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:00.000 --> 00:05.000\ns.jpg#xywh=0,0,160,90\n\n01:00:05.000 --> 01:00:10.000\ns.jpg#xywh=160,0,160,90\n")
    assert [(r["start"], r["middle"], r["x"], r["h"]) for r in files.read_cues(spark, str(tmp_path / "a.vtt")).orderBy("start").collect()] == [(0.0, 2.5, 0, 90), (3605.0, 3607.5, 160, 90)]
    names = spark.createDataFrame([("delta-2026.01.01-to-2026.01.08.zip",), ("full.zip",)], "name string")
    assert [tuple(r) for r in files.delta_steps(names).collect()] == [("2026.01.01", "2026.01.08")]
    packs = spark.createDataFrame([("a", b"xy"), ("b", b"z")], "path string, content binary")
    sums = packs.limit(1).select("path", F.sha2("content", 256).alias("sha256"))
    assert files.verified(packs, sums).count() == 1


def test_watermarks(spark):
    at = lambda d: dt.datetime(2025, 1, d)
    df = spark.createDataFrame([("a", at(1)), ("a", at(3)), ("b", at(2)), ("c", None)], "k string, t timestamp_ntz")
    marks = spark.createDataFrame([("a", at(2)), ("b", None)], "k string, watermark timestamp_ntz")
    assert sorted(r["k"] for r in incremental.changed_since(df, marks, "k", "t").collect()) == ["a", "b", "c"]
    merged = {r["k"]: r["watermark"] for r in incremental.merge_watermarks(marks, incremental.watermarks(df, "k", "t"), "k").collect()}
    assert merged == {"a": at(3), "b": at(2), "c": None}
    assert incremental.merge_watermarks(marks, marks, "k", clean=False) is marks
    assert not incremental.same_logic(None, 2) and incremental.same_logic(2, 2)


def test_entry_lists_agree():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
