"""Leaked passages, toxic passages and source mixing on small tables."""

import os

import pytest

from cataloom.llm import leakage, mixing, toxic

DOC = "doc_id long, text string, source string, item_id long, toks string, p double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 0.5) for i, t, s in rows], DOC)


WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
ITEM = " ".join(WORDS)


def leaks(spark, texts, items=((1, ITEM),), **kw):
    df = docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    tests = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id long")
    return {(r["doc_id"], r["item_id"]): r for r in leakage.leaked_passages(df, tests, **kw).collect()}


def test_leaks_exact_edges(spark):
    got = leaks(spark, [" ".join(WORDS[5:25]), " ".join(WORDS[5:22]), None, "", ITEM, "noise " * 3000 + " ".join(WORDS[30:55]) + " more" * 3000])
    assert {k[0] for k in got} == {0, 4, 5}
    assert (got[(0, 1)]["item_first"], got[(0, 1)]["item_last"]) == (5, 24)


def test_leaks_in_disguise_and_offsets(spark):
    told = WORDS[10:34]
    told[3], told[11] = "other", "thing"
    del told[18]
    text = "Before. <b>" + " — ".join(told[:12]).upper() + "</b>\n&amp; " + ",  ".join(told[12:]) + "! After it"
    wrong = list(WORDS[10:34])
    for k in range(2, 24, 4):
        wrong[k] = "zz"
    got = leaks(spark, [text, " ".join(wrong)])
    assert set(got) == {(0, 1)}
    r = got[(0, 1)]
    assert text[r["first_char"] : r["end_char"]] == r["passage"] and r["passage"].lower().startswith(WORDS[10])
    assert r["differing"] == 3


def test_leaks_of_items_that_are_short_null_or_repeated(spark):
    got = leaks(spark, [ITEM], items=[(1, " ".join(WORDS[:19])), (2, None), (3, ITEM), (4, ITEM), (None, ITEM), (5, "")])
    assert set(got) == {(0, 3), (0, 4)}
    assert leaks(spark, [ITEM], items=[]) == {} and leaks(spark, []) == {}


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 30)
    other = " ".join(w[::-1] + "q" for w in WORDS)
    assert set(leaks(spark, [ITEM + " " + other, other], items=[(1, ITEM), (2, other)])) == {(0, 1), (0, 2), (1, 2)}


def test_leaked_items(spark):
    df = docs(spark, [(1, ITEM, None), (2, " ".join(WORDS[:30]), None)])
    tests = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in leakage.leaked_items(leakage.leaked_passages(df, tests)).collect()] == [(1, 2, 60)]


def test_seeds_are_guaranteed():
    assert leakage.fewest_seeds(20, 8) == 5


def test_plain_words():
    words, starts, ends = leakage.words_of("The ﬁlm’s “NOISE”&nbsp;naïve co­op")
    assert words == ["the", "films", "noise", "naive", "coop"]
    assert starts[1] == 4


NICE = ["The harbour opens the quiet index.", "A borrowed lens records the reel.", "Credits name the director twice.", "He visits the library slowly.", "The scene follows the kiosk."]
BAD = ["You are a worthless idiot and nobody wants you.", "Get lost, you pathetic scumbag.", "I will break your fingers, bastard."]


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, " ".join(NICE[(i + k) % 5] for k in range(4)), " Forum" if i % 2 else None) for i in range(120)]
    for i in range(0, 120, 6):
        rows[i] = (i, rows[i][1] + " " + BAD[(i // 6) % 3], "forum")
    rows += [(500, None, "forum"), (501, "  ", None), (502, "You w0rthless i*iot. " + NICE[0] * 2000, "x"), (503, "GET LOST you pathetic s-c-u-m-b-a-g!!!", "x"), (504, NICE[1], "x")]
    return rows


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, rater string")


def test_toxic_texts(spark, corpus):
    told = [(i, int(i % 6 == 0), "a") for i in range(90)] + [(i, int(i % 6 == 0), "b") for i in range(40)] + [(1, 1, "c"), (None, 1, "a"), (2, None, "a")]
    got = {r["doc_id"] for r in toxic.toxic_texts(docs(spark, corpus + corpus[:3]), labels(spark, told)).collect()}
    assert got == {i for i in range(0, 120, 6)} | {502, 503}
    rates = {r["source"]: r for r in toxic.toxic_rates(docs(spark, corpus), labels(spark, told)).collect()}
    assert rates["x"]["texts"] == 3 and rates["x"]["flagged"] == 2 and rates["(none)"]["flagged"] == 0


def test_toxic_without_labels_or_texts(spark, corpus):
    assert toxic.score_texts(docs(spark, []), labels(spark, [])).count() == 0
    scored = {r["doc_id"]: r for r in toxic.score_texts(docs(spark, corpus), labels(spark, [])).collect()}
    assert scored[500]["score"] == 0 and not scored[500]["flagged"] and not scored[504]["flagged"]


def brute_best(scores):
    return max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])


def test_maximal_segments_against_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randint(-4, 4) for _ in range(rng.randint(0, 14))]
        found = toxic.maximal_segments(s)
        assert max((x[2] for x in found), default=0.0) == brute_best(s)
        assert all(sum(s[a:b]) == v > 0 for a, b, v in found)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:]))


def test_toxic_tokens():
    assert toxic.tokens_of("St00pid STUPIDDD s t u p i d <b>12</b> idiot's.")[0] == ["stoopid", "stupid", "stupid", "0", "idiots", "."]


needs_tokenizer = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer file")


@needs_tokenizer
def test_mixture(spark):
    rows = [(i, f"forum talk about scene number {i} and its match", "forum") for i in range(60)] + [(100 + i, "the actor was born and began a career", " BIO ") for i in range(20)] + [(200, "the actor was born in a town", None), (201, None, "forum"), (202, "", "bio"), (203, "about scene match talk", "elsewhere")]
    targets = spark.createDataFrame([("forum", 0.3, 2), ("bio", 0.6, 1), ("guide", 0.1, 5), ("forum", 0.3, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    plan, report = mixing.mixture(docs(spark, rows), targets)
    told = {r["source"]: r for r in report.collect()}
    assert set(told) == {"forum", "bio", "guide"}
    assert told["bio"]["falls_short"] and told["bio"]["unmet"] and told["guide"]["falls_short"] and not told["forum"]["falls_short"]
    assert abs(told["forum"]["fitted_share"] - 0.3) < 0.01 and told["guide"]["actual_share"] == 0
    assert {r["source"] for r in mixing.short_sources(docs(spark, rows), targets).collect()} == {"bio", "guide"}
    used = plan.collect()
    assert len(used) == len(rows) and all(r["copies"] <= 2 for r in used)
    assert {r["doc_id"]: r["domain"] for r in used}[200] == "bio"


@needs_tokenizer
def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("forum", 0.5, 2)], "source string, target_share double, max_repeats int")
    assert [tuple(r)[:4] for r in mixing.mixture(docs(spark, []), targets)[1].collect()] == [("forum", 0.5, 2, 0)]
    assert mixing.mixture(docs(spark, [(1, "a b", "forum")]), targets.limit(0))[1].count() == 0


@needs_tokenizer
def test_short_sources_count_their_own_tokens_only(spark):
    rows = [(i, "forum talk about the scene and its match", "forum") for i in range(60)] + [(100 + i, "the actor was born and began a career", "bio") for i in range(8)] + [(200 + i, "the actor was born and began a career", None) for i in range(40)]
    targets = spark.createDataFrame([("forum", 0.7, 2), ("bio", 0.3, 2)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.mixture(docs(spark, rows), targets)[1].collect()}
    assert not report["bio"]["unmet"] and report["bio"]["falls_short"]
    assert [r["source"] for r in mixing.short_sources(docs(spark, rows), targets).collect()] == ["bio"]
