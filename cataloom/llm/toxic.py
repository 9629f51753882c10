"""Abusive, hateful or sexual passages by maximum-scoring segment search."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.workspace import materialise

#: Labelled documents that the scorer is fitted on at most (by smallest hash of the id).
MOST_LABELLED = 20_000
#: A token must stand in one of so many toxic texts at least to count; so the model's size is bounded by
#: this number times the tokens of a passage, however large the corpus is.
RARE = 20_000
#: Weight of the corpus-wide token shares as Dirichlet prior, in documents (no more than are labelled).
PRIOR = 300.0
#: Standard errors by which a positive log-odds is drawn towards zero.
SHRINK = 0.7
#: Score from which a segment teaches the next round.
CONFIDENT = 3.0
#: Log-odds of a token at most; a token that clean texts hold too stays below it.
MOST_ODDS = 7.0
#: Score from which a segment enters the extreme-value law, and the weight of the law's prior (scale 1) in segments.
TAIL, TAIL_PRIOR = 0.25, 10
#: Chance segments that a flagged text may be expected to hold at most.
SIGNIFICANT = 0.05
#: Score of every token besides its log-odds, and of a sentence end.
DRIFT, SENTENCE_END = -0.6, -2.5

_TAG = re.compile(r"<[^<>]{0,200}>|\[[^\[\]]{0,40}\]")
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-_])(?:[^\W\d_]\1)+[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_]+(?:[*@$'][^\W_]+)*|[.!?\n]")
_LEET = str.maketrans("013457@$", "oieastas")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_END = frozenset(".!?\n")


def _join(m: re.Match) -> str:
    return m.group(0).replace(m.group(1), "")


def tokens_of(text: str | None) -> tuple[list[str], list[int], list[int]]:
    """Plain tokens of a whole text, with the start and end of each in the plain text.

    Markup goes, letters are lower-cased and stripped of marks, numbers become
    ``0``, letters set apart by one sign each are joined, runs of three or more
    of a letter become one, digits inside a word become the letters they stand
    for. Sentence ends are tokens of their own.
    """
    if not text:
        return [], [], []
    plain = text if text.isascii() else unicodedata.normalize("NFKC", text)
    if "&" in plain:
        plain = html.unescape(plain)
    if "<" in plain or "[" in plain:
        plain = _TAG.sub(" ", plain)
    plain = plain.lower().replace("’", "'")
    plain = _SPELLED.sub(_join, plain)
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c))
    words, starts, ends = [], [], []
    for m in _TOKEN.finditer(plain):
        w = m.group(0)
        if w not in _END and not w.isalpha():
            if w.isdigit():
                w = "0"
            else:
                w = w.replace("'", "") if "'" in w else w
                if not w.isalpha() and any(c.isalpha() for c in w):
                    w = w.translate(_LEET)
        if w.isalpha() and len(w) > 3:
            w = _LONG.sub(r"\1", w)
        words.append(w)
        starts.append(m.start())
        ends.append(m.end())
    return words, starts, ends


def grams_of(words: list[str]) -> list[str]:
    """The bigram that ends at each token; none across sentence ends."""
    return ["" if a in _END or b in _END else f"{a} {b}" for a, b in zip(["."] + words[:-1], words)]


@dataclass
class Scorer:
    """Token log-odds and the extreme-value law of the best segment in clean texts."""

    odds: dict[str, float]
    masked: dict[str, str] = field(default_factory=dict)
    scale: float = 1.0
    floor: float = 0.0
    rate: float = 1.0
    most_expected: float = 1e-3

    def known(self, w: str) -> str:
        """The word of the model that an unusual spelling stands for."""
        if w in self.odds or w in _END:
            return w
        if "*" in w:
            return self.masked.get(w, w)
        if len(w) > 4 and w[1:] in self.odds and w[0] in "ai" and self.odds[w[1:]] > 0:
            return w[1:]
        if len(w) > 3 and w[-1] == w[-2] and w[:-1] in self.odds:
            return w[:-1]
        return w

    def scores(self, words: list[str]) -> list[float]:
        words = [self.known(w) for w in words]
        get = self.odds.get
        return [SENTENCE_END if w in _END else get(w, 0.0) + get(g, 0.0) + DRIFT for w, g in zip(words, grams_of(words))]

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        return maximal_segments(self.scores(words))

    def expected(self, best: float, n: int) -> float:
        """Segments at least as good that a clean text of ``n`` tokens would hold by chance."""
        return self.rate * n * math.exp(-self.scale * (best - self.floor)) if best > 0 else math.inf

    def together(self, scores: list[float], n: int) -> float:
        """The same for the best one, two or three segments of a text taken together, whichever is rarest."""
        least, total = math.inf, 0.0
        for r, x in enumerate(sorted(scores, reverse=True)[:3], 1):
            total -= math.log(max(self.expected(x, n), 1e-300))
            if total > 0:
                least = min(least, math.exp(-total) * total ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)))
            elif r == 1:
                least = math.exp(-total)
        return least


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(start, end, score)`` in linear time."""
    total, kept = 0.0, []
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        left, a, right = before, i, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((a, i + 1, left, right, j))
                break
            left, a = kept[j][2], kept[j][0]
            del kept[j:]
    return [(a, b, r - left) for a, b, left, r, _ in kept]


def _with_masks(odds: dict[str, float]) -> Scorer:
    masked: dict[str, str] = {}
    for w, d in sorted(odds.items()):
        if d > 0 and " " not in w and len(w) > 2:
            for k in range(1, len(w)):
                masked.setdefault(w[:k] + "*" + w[k + 1 :], w)
    return Scorer(odds, masked)


def log_odds(pos: dict[str, float], neg: dict[str, float], n_pos: float, n_neg: float, prior: dict[str, float], weight: float, shrink: float, least: float = 0.05) -> dict[str, float]:
    """Shrunken log-odds of each token under a Dirichlet prior; a bigram counts less than a word."""
    odds = {}
    for f in pos.keys() | neg.keys():
        a = prior.get(f, 0.0) + least
        x, y = pos.get(f, 0.0), neg.get(f, 0.0)
        d = math.log((x + a) / (n_pos + weight)) - math.log((y + a) / (n_neg + weight))
        if d > 0:
            d = max(0.0, d - shrink * math.sqrt(1 / (x + a + 0.5) + 1 / (y + a + 0.5)))
        d = max(-3.0, min(d, MOST_ODDS)) * (1.0 if " " not in f else 0.7)
        if abs(d) > 0.05:
            odds[f] = d
    return odds


def features(words: list[str]) -> set[str]:
    return {w for w in words if w not in _END} | {g for g in grams_of(words) if g}


def fit_labelled(docs: list[tuple[list[str], float]], corpus: dict[str, float], size: float) -> Scorer:
    """First scorer: labelled texts against each other, corpus shares as prior.

    Only one passage of a toxic text is toxic, so after a first fit the tokens
    inside its best segment count as toxic and those outside as clean.
    """
    weight = min(PRIOR, len(docs)) + 1.0
    prior = {f: weight * c / max(size, 1.0) for f, c in corpus.items()}
    scorer = _with_masks({})
    for r in range(3):
        pos, neg, n_pos, n_neg = Counter(), Counter(), 0, 0
        for words, p in docs:
            known = [scorer.known(w) for w in words]
            own = features(known)
            if p < 0.5:
                n_neg += 1
                neg.update(own)
            elif p > 0.5 and r == 0:
                n_pos += 1
                pos.update(own)
            elif p > 0.5:
                best = max(scorer.segments(words), key=lambda s: s[2], default=None)
                if best is not None and best[2] >= 2.0:
                    inside = features(known[best[0] : best[1]])
                    n_pos += 1
                    n_neg += 1
                    pos.update(inside)
                    neg.update(own - inside)
        scorer = _with_masks(log_odds(pos, neg, n_pos, n_neg, prior, weight, SHRINK))
    return scorer


def refit(inside: dict[str, float], every: dict[str, float], n_inside: float, size: float) -> Scorer:
    """Scorer from the whole corpus: tokens inside significant segments against all others."""
    neg = {f: max(0.0, c - inside.get(f, 0.0)) for f, c in every.items()}
    neg = {f: c for f, c in neg.items() if f in inside or c >= 20}
    return _with_masks(log_odds(inside, neg, n_inside, size, {}, 1.0, 2.0, 0.5))  # a name that stands in a few passages only is no evidence


def settle(scorer: Scorer, docs: list[tuple[list[str], float]], clean_weight: float = 3.0) -> Scorer:
    """Extreme-value law of the segments of clean texts, and the cut that suits the labelled texts best.

    Chance segments above TAIL fall off as exp(-scale * S); scale and rate per
    token are fitted to the segments of the labelled clean texts. The cut is
    the largest number of expected chance segments, SIGNIFICANT at most, with the best F1 over the labelled
    texts, their segments taken together.
    """
    found = [([x[2] for x in scorer.segments(w)], max(1, len(w)), p) for w, p in docs]
    clean = [x for x in found if x[2] < 0.5]
    if not clean:
        return scorer
    tail = [x for scores, _, _ in clean for x in scores if x > TAIL]
    prior = [-math.log(1 - (k + 0.5) / TAIL_PRIOR) for k in range(TAIL_PRIOR)]  # scores are log-likelihood ratios: scale 1
    scorer.scale = math.log(2) / float(np.median([x - TAIL for x in tail] + prior))  # wrongly rated texts hardly move it
    scorer.floor = TAIL
    scorer.rate = max(1.0, len(tail)) / sum(n for _, n, _ in clean)
    rows = sorted((scorer.together(scores, n), p) for scores, n, p in found if p != 0.5 and scores)
    total, hit, false = sum(p > 0.5 for _, _, p in found), 0.0, 0.0
    top, scorer.most_expected = -1.0, 1e-3
    for k, (e, p) in enumerate(rows):
        hit, false = hit + (p > 0.5), false + clean_weight * (p < 0.5)
        f1 = 2 * hit / (hit + false + total)
        if f1 > top:
            after = rows[k + 1][0] if k + 1 < len(rows) else math.inf
            top, scorer.most_expected = f1, min(max(e, after * (1 - 1e-9)), SIGNIFICANT)
    return scorer


def token_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, toks``: every text as plain tokens set apart by blanks, written once."""

    def op(batches):
        for b in batches:
            out = [" ".join(w if w != "\n" else "." for w in tokens_of(t)[0]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "toks"])

    return materialise(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(op, "doc_id long, toks string"), "tokens")


def _lists(batch) -> list[list[str]]:
    return [t.split(" ") if t else [] for t in batch.column(1).to_pylist()]


def _counts(tokens: DataFrame, of) -> DataFrame:
    """``f, n``: sums of the counters that ``of`` makes of each batch of texts, combined per task, then by token."""

    def op(batches):
        count = of()
        total: Counter = Counter()
        for b in batches:
            count(_lists(b), total)
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array([float(v) for v in total.values()])], names=["f", "n"])
                total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array([float(v) for v in total.values()])], names=["f", "n"])

    return tokens.mapInArrow(op, "f string, n double").groupBy("f").agg(F.sum("n").alias("n"))


def _told(counts: DataFrame) -> Counter:
    got = counts.toArrow()
    return Counter(dict(zip(got["f"].to_pylist(), got["n"].to_pylist())))


def _texts_with(tokens: DataFrame, wanted: frozenset[str]) -> Counter:
    """Number of texts that hold each of the ``wanted`` tokens and bigrams; the result is no larger than these."""
    shared = tokens.sparkSession.sparkContext.broadcast(wanted)

    def of():
        held = shared.value
        words = {w for f in held for w in f.split(" ")}
        place = {w: k for k, w in enumerate(sorted(words))}
        names = sorted(place)
        size = len(place) + 1
        pairs = {place[f.split(" ")[0]] * size + place[f.split(" ")[1]]: f for f in held if " " in f}
        keys = np.array(sorted(pairs) + [np.iinfo(np.int64).max])
        single = np.array([n in held for n in names] + [False])

        def count(lists, total):
            get = place.get
            other = size - 1
            ids = np.array([get(w, other) for words in lists for w in words], np.int64)
            sizes = np.array([len(w) for w in lists], np.int64)
            if not len(ids):
                return
            text = np.repeat(np.arange(len(lists)), sizes)
            w = single[ids]
            seen = np.unique(text[w] * size + ids[w]) % size
            for k, n in zip(*np.unique(seen, return_counts=True)):
                total[names[k]] += int(n)
            same = text[1:] == text[:-1]
            pair = (ids[:-1] * size + ids[1:])[same]
            at = np.searchsorted(keys, pair)
            hit = keys[at] == pair
            seen = np.unique(text[1:][same][hit] * len(keys) + at[hit]) % len(keys)
            for k, n in zip(*np.unique(seen, return_counts=True)):
                total[pairs[int(keys[k])]] += int(n)

        return count

    return _told(_counts(tokens, of))


def train(tokens: DataFrame, labels: DataFrame, rounds: int = 4, most_labelled: int = MOST_LABELLED) -> Scorer:
    """Scorer fitted on a bounded number of labelled texts, then on the whole corpus.

    Each round scans every text, counts the tokens inside significant segments
    over the corpus, and fits the log-odds again against all other tokens.
    Raters are averaged; a rater counts once per text. Texts on which raters
    are even are passed over.
    """
    votes = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id", "rater").agg(F.max("toxic").alias("t")).groupBy("doc_id").agg(F.avg("t").alias("p"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = tokens.join(chosen, "doc_id").select("toks", "p").toArrow()
    docs = [(t.split(" ") if t else [], p) for t, p in zip(rows["toks"].to_pylist(), rows["p"].to_pylist())]
    size = float(tokens.count())
    vocabulary: set[str] = set()
    for words, _ in docs:
        vocabulary |= features(words)
    spark = tokens.sparkSession
    every = _texts_with(tokens, frozenset(vocabulary))  # bounded by MOST_LABELLED
    scorer = fit_labelled(docs, every, size)
    for _ in range(rounds):
        told = spark.sparkContext.broadcast(scorer)

        def of(told=told):
            s = told.value
            batch = Batch(s)

            def count(lists, total):
                for k in np.nonzero(batch.best(lists) >= CONFIDENT - 1e-6)[0]:
                    known = [s.known(w) for w in lists[k]]
                    own: set[str] = {"\n"}  # counts the texts
                    for a, b, score in s.segments(lists[k]):
                        if score >= CONFIDENT / 2:
                            own |= features(known[a:b])
                    total.update(own)

            return count

        found = materialise(_counts(tokens, of), "inside")
        n_inside = found.where(F.col("f") == "\n").agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]
        if not n_inside:
            break
        held = _told(found.where((F.col("f") != "\n") & (F.col("n") >= n_inside / RARE)))
        fresh = frozenset(f for f in held if f not in every)
        if fresh:
            every.update(_texts_with(tokens, fresh))
        scorer = refit(held, every, n_inside, size)
    return settle(scorer, docs)


class Batch:
    """Scores of whole batches of texts at once, with the arrays of a scorer."""

    def __init__(self, scorer: Scorer):
        self.scorer = scorer
        words = sorted({w for f in scorer.odds for w in f.split(" ")})
        self.place = {w: k + 2 for k, w in enumerate(words)} | {w: 1 for w in _END}  # 0: unknown, 1: sentence end
        self.odds = np.zeros(len(words) + 2)
        pairs = []
        for f, d in scorer.odds.items():
            if " " in f:
                a, b = f.split(" ")
                pairs.append((self.place[a] * len(self.odds) + self.place[b], d))
            else:
                self.odds[self.place[f]] = d
        pairs.sort()
        self.keys, self.pair_odds = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max]), np.array([d for _, d in pairs] + [0.0])
        self.memo: dict[str, int] = {}

    def ids(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words, and the number of words of each text."""
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        out: list[int] = []
        for words in lists:
            try:
                out += [memo[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in memo:
                        memo[w] = self.place.get(self.scorer.known(w), 0)
                out += [memo[w] for w in words]
        return np.array(out, np.int64), np.array([len(w) for w in lists], np.int64)

    def best(self, lists: list[list[str]]) -> np.ndarray:
        """Score of each text's best segment."""
        ids, sizes = self.ids(lists)
        out = np.zeros(len(lists))
        if not len(ids):
            return out
        starts = np.cumsum(sizes) - sizes
        score = self.odds[ids] + DRIFT
        pair = np.empty(len(ids), np.int64)
        pair[0], pair[1:] = -1, ids[:-1] * len(self.odds) + ids[1:]
        at = np.searchsorted(self.keys, pair)
        hit = self.keys[at] == pair
        hit[starts[sizes > 0]] = False  # no pair across texts
        score[hit] += self.pair_odds[at[hit]]
        score[ids == 1] = SENTENCE_END
        after = np.cumsum(score)
        before = after - score
        text = np.repeat(np.arange(len(lists)), sizes)
        fall = 2 * (np.abs(after).max() + 1) * text  # each text starts below the one before
        low = np.minimum.accumulate(before - fall) + fall
        some = sizes > 0
        out[some] = np.maximum(np.maximum.reduceat(after - low, starts[some]), 0.0)
        return out


PASSAGES = "doc_id long, tokens int, score double, expected double, flagged boolean, passages array<struct<first:int,last:int,score:double,text:string>>"


def score_texts(documents: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Every text with its best segment's score, the expected number of chance
    segments as good, the flag, and its significant passages (plain tokens).

    Null and blank texts score 0 and are never flagged; very long texts are
    scanned whole in linear time; repeated rows are scored each; without any
    labels nothing is flagged; further columns are ignored.
    """
    tokens = token_table(documents)
    scorer = tokens.sparkSession.sparkContext.broadcast(train(tokens, labels, **kw))

    def op(batches):
        s = scorer.value
        batch = Batch(s)
        for b in batches:
            rows = []
            lists = _lists(b)
            for words, best in zip(lists, batch.best(lists).tolist()):
                e, kept, flagged = s.expected(best, len(words)), [], False
                if best > TAIL:
                    found = s.segments(words)
                    e = s.together([x[2] for x in found], max(1, len(words)))
                    flagged = e <= s.most_expected
                    kept = [{"first": a, "last": z - 1, "score": sc, "text": " ".join(words[a:z])} for a, z, sc in found if flagged and sc > TAIL]
                rows.append((len(words), best, min(e, 1e9), flagged, kept))
            cols = list(zip(*rows)) or [[]] * 5
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], kind)], names=["doc_id", "tokens", "score", "expected", "flagged", "passages"])

    return tokens.mapInArrow(op, PASSAGES)


def toxic_texts(documents: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """``doc_id`` of every flagged text, once."""
    return score_texts(documents, labels, **kw).where("flagged").select("doc_id").distinct()


def toxic_rates(documents: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Texts, flagged texts and their rate per source (case and outer blanks apart)."""
    scored = score_texts(documents, labels, **kw).select("doc_id", "flagged").distinct()
    source = documents.select("doc_id", F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("(none)")).alias("source"))
    return source.join(scored, "doc_id").groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("flagged").cast("long")).alias("flagged")).withColumn("rate", F.round(F.col("flagged") / F.col("texts"), 6))
