"""Evaluation passages that leak into training texts."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a seed. In 20 words of which one in eight may differ, some 5 in a row are always equal.
SEED_WORDS = 5
#: Words of test items that one automaton holds; a larger test set is worked on in several blocks.
BLOCK_WORDS = 1_000_000
#: Cost of a differing word against one equal word, and how far an alignment may stray from its seed.
EDIT, BAND = 1, 8

_MARKUP = re.compile(r"<[^<>]{0,300}>|&#?\w{1,10};|\[/?\w{1,30}\]|[­​-‍﻿]")
_SPACE = re.compile(r"[^\W_]+(?:['’ʼ][^\W_]+)*")
_APOSTROPHE = re.compile(r"['’ʼ]")


def _blank(m: re.Match) -> str:
    return ("\u0001" if m.group(0)[0] in "­​‌‍﻿" else " ") * len(m.group(0))


def words_of(text: str | None) -> tuple[list[str], list[int], list[int]]:
    """Normalised words with their start and end offsets in the original text.

    Case, punctuation, blanks, line breaks, markup, ligatures, accents and
    typographic characters do not count. Offsets stay those of the original:
    markup is blanked out at its own length and every word is normalised apart.
    """
    if not text:
        return [], [], []
    bare = _MARKUP.sub(_blank, text)
    words, starts, ends = [], [], []
    hidden = "\u0001" in bare
    for m in (re.finditer(r"[^\W_]+(?:['’ʼ\u0001]+[^\W_]+)*", bare) if hidden else _SPACE.finditer(bare)):
        w = m.group(0)
        if w.isascii():
            w = w.lower().replace("'", "").replace("\u0001", "")
        else:
            w = unicodedata.normalize("NFKD", _APOSTROPHE.sub("", w.replace("\u0001", ""))).lower()
            w = "".join(c for c in w if not unicodedata.combining(c))
        words.append(w)
        starts.append(m.start())
        ends.append(m.end())
    return words, starts, ends


def automaton_of(items: list[tuple[int, list[str]]]) -> ahocorasick.Automaton:
    """Automaton over every seed of the items; a seed's value lists (item, word) places."""
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, (_, words) in enumerate(items):
        for i in range(len(words) - SEED_WORDS + 1):
            places[" " + " ".join(words[i : i + SEED_WORDS]) + " "].append((k, i))
    auto = ahocorasick.Automaton()
    for seed, where in places.items():
        auto.add_word(seed, where)
    if places:
        auto.make_automaton()
    return auto


def align(item: list[str], doc: list[str], at_item: int, at_doc: int) -> list[tuple[int, int]]:
    """Places (item word, text word) of equal words in the best local alignment near a seed."""
    lead = min(at_item + BAND, at_doc)
    lo, hi = at_doc - lead, min(len(doc), at_doc + len(item) - at_item + BAND)
    shift = at_doc - lo - at_item
    n, m = len(item), hi - lo
    prev = {}
    score: list[dict[int, tuple[int, int]]] = []
    best = (0, -1, -1)
    for i in range(n):
        row = {}
        word = item[i]
        for j in range(max(0, i + shift - BAND), min(m, i + shift + BAND + 1)):
            d = prev.get(j - 1, (0, 0))[0] + (1 if word == doc[lo + j] else -EDIT)
            u, left = prev.get(j, (0, 0))[0] - EDIT, row.get(j - 1, (0, 0))[0] - EDIT
            v, step = max((d, 3), (u, 2), (left, 1))
            if v > 0:
                row[j] = (v, step)
                if v > best[0]:
                    best = (v, i, j)
        score.append(row)
        prev = row
    _, i, j = best
    out = []
    while i >= 0 and j in score[i]:
        step = score[i][j][1]
        if step == 3:
            if item[i] == doc[lo + j]:
                out.append((i, lo + j))
            i, j = i - 1, j - 1
        elif step == 2:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def longest_repeat(equal: list[tuple[int, int]], length: int, least: int, tolerance: int) -> tuple[int, int, int] | None:
    """Longest run of item words ``(first, last, differing)`` with at most one in ``tolerance`` differing.

    Words of the item without an equal partner count as differing, and so do
    text words put in between. A run starts and ends at an equal word unless it
    must reach beyond to hold ``least`` words.
    """
    best = None
    for a in range(len(equal)):
        for b in range(len(equal) - 1, a, -1):
            (i, p), (k, q) = equal[a], equal[b]
            span = k - i + 1
            if best and span <= best[1] - best[0] + 1:
                break
            missing = span - (b - a + 1)
            extra = max(0, (q - p + 1) - span)
            more = max(0, least - span)
            if span + more <= length and missing + extra + more <= (span + more) // tolerance:
                best = (i, k, missing + extra)
                break
    return best


LEAKS = "doc_id long, item_id long, item_first int, item_last int, differing int, first_char int, end_char int, passage string"


def leaked_passages(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 20, tolerance: int = 8) -> DataFrame:
    """One row per text and item that it repeats: the run of item words, and the passage with its offsets in the original text.

    The test set is read in blocks of a bounded number of words, each becoming
    one Aho-Corasick automaton over its seeds; a text is scanned once per block
    and each item it touches is checked by a banded word alignment around its
    seeds. Texts are neither shuffled nor collected.

    Null and blank texts and items match nothing, and neither do items of
    fewer than ``least`` words; texts of any length are scanned whole; repeated
    items each give a row, as do repeated texts; empty tables give an empty
    result; further columns are ignored.
    """
    spark = documents.sparkSession
    tests = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    held = tests.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] / 6
    blocks = int(held // BLOCK_WORDS) + 1
    found = None
    for k in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).distinct().orderBy("i").collect()  # one block: bounded by BLOCK_WORDS
        block = [(r["i"], w) for r in part if len(w := words_of(r["t"])[0]) >= least]
        shared = spark.sparkContext.broadcast(block)
        one = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scanner(shared, least, tolerance), LEAKS)
        found = one if found is None else found.unionByName(one)
    return found


def fewest_seeds(least: int, tolerance: int) -> int:
    """Seeds that any run of ``least`` words or more with one in ``tolerance`` differing must hold."""
    runs = range(least, least + 3 * tolerance)
    return max(1, min(n - n // tolerance - (SEED_WORDS - 1) * (n // tolerance + 1) for n in runs))


def _scanner(shared, least: int, tolerance: int):
    def op(batches):
        block = shared.value
        auto = automaton_of(block)
        for batch in batches:
            rows = []
            if len(auto):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows += [(doc, *r) for r in leaks_of(text, block, auto, least, tolerance)]
            cols = list(zip(*rows)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[p.split(" ")[0] for p in LEAKS.split(", ")])

    return op


def leaks_of(text: str | None, block: list[tuple[int, list[str]]], auto, least: int = 20, tolerance: int = 8) -> list[tuple]:
    """Leaks of one text: ``item_id, item_first, item_last, differing, first_char, end_char, passage``."""
    words, starts, ends = words_of(text)
    if len(words) < least - least // tolerance:
        return []
    line = " " + " ".join(words) + " "
    stops, at = [], 0
    for w in words:
        at += len(w) + 1
        stops.append(at)
    seeds: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for stop, places in auto.iter(line):
        j = bisect_left(stops, stop) - SEED_WORDS + 1
        for k, i in places:
            seeds[k].add((i, j))
    out = []
    few = fewest_seeds(least, tolerance)
    for k, hits in seeds.items():
        if len({i for i, _ in hits}) < few:
            continue
        item_id, item = block[k]
        best = None
        used: set[tuple[int, int]] = set()
        for i, j in sorted(hits):
            if (i, j) in used:
                continue
            equal = align(item, words, i, j)
            used.update(equal)
            if len(equal) < least - least // tolerance - 1:
                continue
            run = longest_repeat(equal, len(item), least, tolerance)
            if run and (best is None or run[1] - run[0] > best[0][1] - best[0][0]):
                to = dict(equal)
                best = (run, to[run[0]], to[run[1]])
        if best:
            (a, b, differing), p, q = best
            out.append((item_id, a, b, differing, starts[p], ends[q], text[starts[p] : ends[q]]))
    return out


def leaked_items(leaks: DataFrame) -> DataFrame:
    """Leaked items with the number of texts that repeat them and the longest run of words."""
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("texts"), F.max(F.col("item_last") - F.col("item_first") + 1).alias("longest_run"))
