"""Mixing sources to target weights."""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.workspace import materialise

#: Vocabulary file of a public tokenizer, unless the session names another in SETTING: ranks
#: (``.tiktoken``) or the tokenizers library's JSON. The driver's copy is sent to the executors.
TOKENIZER, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.cataloom.tokenizer"
#: How rank files' texts are split before merging (fixed value, published with the vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Share of source names that are taken to be wrong: a text named after a source is in part what it resembles.
NOISE = 0.02
#: Memberships are told apart in steps of one GRID-th, so that texts of equal membership share a rate.
GRID = 16
#: Rounds of the fit at most, and the change of all rates that ends it.
ROUNDS, SETTLED = 5_000, 1e-9
#: Relative miss from which a target counts as unmet.
UNMET = 1e-3
#: Target sources at most; more are an error, as the classifier's weights are broadcast.
MOST_SOURCES = 500

_loaded: dict[str, object] = {}


def tokenizer_of(path: str):
    """``encode(texts) -> lists of ids`` of a vocabulary file."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            made = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = lambda texts: [made.encode_ordinary(t) for t in texts]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.encode_special_tokens = True
            _loaded[path] = lambda texts: [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def plain_source(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def token_table(documents: DataFrame, names: list[str], tokenizer: str | None = None) -> DataFrame:
    """``doc_id, source, known, tokens, ids``: each text's size and distinct token ids; ``known`` is the place of its source in ``names``."""
    spark = documents.sparkSession
    path = tokenizer or spark.conf.get(SETTING, TOKENIZER)
    spark.sparkContext.addFile(path)
    file = os.path.basename(path)
    known = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))])[F.col("source")] if names else F.lit(None).cast("int")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), plain_source(F.col("source")).alias("source"), F.col("text").cast("string").alias("text")).withColumn("known", known.cast("int"))

    def op(batches):
        encode = tokenizer_of(SparkFiles.get(file))
        for batch in batches:
            texts = batch.column(2)
            sizes, kept = [], []
            for s in range(0, len(texts), 256):
                for ids in encode([t or "" for t in texts.slice(s, 256).to_pylist()]):
                    sizes.append(len(ids))
                    kept.append(np.unique(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()), pa.array(kept, pa.list_(pa.int32()))], names=["doc_id", "source", "known", "tokens", "ids"])

    return materialise(docs.select("doc_id", "source", "text", "known").mapInArrow(op, "doc_id long, source string, known int, tokens long, ids array<int>"), "token-ids")


def fit_domains(tokens: DataFrame, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of the texts of a domain that hold a token, and log priors (smoothed naive Bayes).

    All texts with a known source count; they are summed where they lie, so
    what reaches the driver is bounded by the vocabulary and the domains.
    """

    def op(batches):
        held: dict[int, np.ndarray] = {}
        texts = np.zeros(domains, np.int64)
        for b in batches:
            known = np.asarray(b.column(0))
            texts += np.bincount(known, minlength=domains)
            ids, ends = b.column(1).values.to_numpy(zero_copy_only=False), np.asarray(b.column(1).offsets)
            each = np.repeat(known, np.diff(ends))
            own = ids[ends[0] : ends[-1]]
            for k in np.unique(known):
                n = np.bincount(own[each == k])
                if k in held and len(held[k]) >= len(n):
                    held[k][: len(n)] += n
                else:
                    held[k] = n + np.pad(held[k], (0, len(n) - len(held[k]))) if k in held else n
        for k, n in held.items():
            w = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w) + 1, k, np.int32)), pa.array(np.append(w, -1).astype(np.int32)), pa.array(np.append(n[w], texts[k]).astype(np.int64))], names=["domain", "token", "n"])

    got = tokens.where("known is not null").select("known", "ids").mapInArrow(op, "domain int, token int, n long").groupBy("domain", "token").agg(F.sum("n").alias("n")).toArrow()
    domain, token, n = (np.asarray(got[c]) for c in ("domain", "token", "n"))
    counts, held = np.full((domains, max(1, int(token.max(initial=0)) + 1)), 0.1), np.full(domains, 0.2)
    words = token >= 0
    counts[domain[words], token[words]] += n[words]
    held[domain[~words]] += n[~words]
    prior = np.log(held / held.sum())
    seen = held > 0.2
    if seen.any():
        prior[~seen] = -np.inf  # nothing can be told to resemble a domain without texts
    return np.log(counts / held[:, None]).astype(np.float32), prior


def posterior(ids: np.ndarray, weights: np.ndarray, prior: np.ndarray) -> np.ndarray:
    ids = ids[ids < weights.shape[1]]
    score = prior + weights[:, ids].sum(1) / np.sqrt(max(len(ids), 1))
    p = np.exp(score - score.max())
    return p / p.sum()


def on_grid(p: np.ndarray) -> np.ndarray:
    """Shares in whole GRID-ths that add up, by largest remainders."""
    parts = np.floor(p * GRID).astype(np.int64)
    rest = p * GRID - parts
    order = np.argsort(-rest, axis=1, kind="stable")
    lack = GRID - parts.sum(1)
    np.put_along_axis(parts, order, np.take_along_axis(parts, order, 1) + (np.arange(p.shape[1]) < lack[:, None]), 1)
    return parts


def memberships(documents: DataFrame, names: list[str], tokenizer: str | None = None) -> DataFrame:
    """``doc_id, source, known, tokens, p``: each text's size and its membership in every domain, in GRID-ths.

    A classifier fitted on all texts whose source is one of ``names`` (case and
    outer blanks apart) gives every text its posteriors; a known source is
    evidence besides, of which NOISE is taken to be wrong. Sizes cover whole
    texts.
    """
    tokens = token_table(documents, names, tokenizer)
    model = documents.sparkSession.sparkContext.broadcast(fit_domains(tokens, max(1, len(names))))

    def op(batches):
        w, b = model.value
        for batch in batches:
            if not len(batch):
                continue
            ids, ends = batch.column(4).values.to_numpy(zero_copy_only=False), np.asarray(batch.column(4).offsets)
            p = np.stack([posterior(ids[s:e], w, b) for s, e in zip(ends[:-1], ends[1:])])
            known = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
            told = np.nonzero(known >= 0)[0]
            if len(names) > 1:
                p[told] *= NOISE / (len(names) - 1)
                p[told, known[told]] *= (1 - NOISE) / (NOISE / (len(names) - 1))
                p[told] /= p[told].sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(on_grid(p).astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["doc_id", "source", "known", "tokens", "p"])

    return materialise(tokens.mapInArrow(op, "doc_id long, source string, known int, tokens long, p array<int>"), "memberships")


def fit_rates(p: np.ndarray, tokens: np.ndarray, shares: np.ndarray, caps: np.ndarray, total: float) -> tuple[np.ndarray, int]:
    """Nonnegative rates of the classes of texts of one membership, and the rounds taken.

    Projected gradient descent on the squared misses of the domains: every text
    steps against the misses of its domains, scaled by what the domains have on
    hand, and is then drawn back between 0 and what its domains allow.
    """
    most = p @ caps
    r = np.minimum(1.0, most)
    on_hand = np.maximum(tokens @ p, 1e-9)
    for n in range(1, ROUNDS + 1):
        miss = np.clip(((r * tokens) @ p - shares * total) / on_hand, -caps, caps)
        new = np.clip(r - p @ miss, 0.0, most)
        if np.abs(new - r).max(initial=0.0) <= SETTLED:
            return new, n
        r = new
    return r, ROUNDS + 1


def _targets(targets: DataFrame) -> dict[str, tuple[str, float, float]]:
    rows = targets.where("source is not null").groupBy(plain_source(F.col("source")).alias("s"), F.col("source")).agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("c")).where("s is not null").orderBy("s", "source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    seen: dict[str, tuple[str, float, float]] = {}
    for r in rows:
        old = seen.get(r["s"])
        seen[r["s"]] = (old[0] if old else r["source"], max(old[1] if old else 0.0, r["w"] or 0.0), max(old[2] if old else 0.0, float(r["c"] or 0)))
    return seen


def _fitted(members: DataFrame, seen: dict, own: bool) -> tuple[pd.DataFrame, np.ndarray, float, bool]:
    """Classes of texts (``known, p, tokens``) with their rates, the memberships, all tokens, and whether the fit settled.

    Classes are as many as the grid has places at most, whatever the number of
    texts. With ``own``, texts of no target source take no part in the fit.
    """
    classes = members.groupBy("known", "p").agg(F.sum("tokens").alias("tokens")).toPandas()
    total = float(classes["tokens"].sum())
    shares, caps = np.array([v[1] for v in seen.values()]), np.array([v[2] for v in seen.values()])
    p = np.stack(classes["p"].to_numpy()).astype(np.float64) / GRID if len(classes) else np.zeros((0, len(seen)))
    used = classes["known"].notna().to_numpy() if own else np.ones(len(classes), bool)
    rate = np.zeros(len(classes))
    rate[used], rounds = fit_rates(p[used], classes["tokens"].to_numpy(np.float64)[used], shares, caps, total)
    return classes.assign(rate=rate), p, total, rounds <= ROUNDS


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan (``doc_id, source, tokens, known, domain, rate, copies``) and the report per target source.

    Nonnegative rates are fitted so that the domains' expected token totals
    match the targets' shares of all tokens, no text being used more often than
    its domains allow. ``copies`` are whole: the rate's fraction is settled by
    a hash of the id. The report holds the tokens on hand, the fitted and
    actual shares, whether the target is ``unmet`` and the fit ``settled``, and
    whether the source falls short: ``max_repeats`` times its tokens are less
    than its share of all tokens.

    Null and blank texts have no tokens; repeated target rows count once, of
    different ones for a source the largest share and repeats; null shares and
    repeats count as 0; sources that are no target give up their texts to the
    domains they resemble; empty documents give shares of 0; more than
    MOST_SOURCES targets are an error; further columns are ignored.
    """
    seen = _targets(targets)
    names = list(seen)
    spark = documents.sparkSession
    members = memberships(documents, names, tokenizer)
    if not names:
        plan = members.select("doc_id", "source", "tokens", F.lit(False).alias("known"), F.lit(None).cast("string").alias("domain"), F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"))
        return plan, spark.createDataFrame([], "source string, target_share double, max_repeats int, tokens long, fitted_share double, actual_share double, unmet boolean, settled boolean, falls_short boolean")
    caps = np.array([v[2] for v in seen.values()])
    classes, p, total, settled = _fitted(members, seen, own=False)
    rates = spark.createDataFrame([(None if pd.isna(k) else int(k), [int(x) for x in g], float(r), float(m)) for k, g, r, m in zip(classes["known"], classes["p"], classes["rate"], p @ caps)], "k int, g array<int>, rate double, most double")
    domain = F.element_at(F.array(*[F.lit(n) for n in names]), F.coalesce(F.col("known") + 1, F.array_position("p", F.array_max("p"))).cast("int"))
    plan = members.join(rates, F.col("known").eqNullSafe(F.col("k")) & (F.col("p") == F.col("g")))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.least(F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long"), F.ceil("most")).cast("long")
    plan = plan.select("doc_id", "source", "tokens", F.col("known").isNotNull().alias("known"), domain.alias("domain"), "rate", copies.alias("copies"))
    used = plan.groupBy("domain").agg(F.sum(F.when(F.col("known"), F.col("tokens")).otherwise(0)).alias("tokens"), F.sum(F.col("copies") * F.col("tokens")).alias("used"))
    fitted = (classes["rate"].to_numpy() * classes["tokens"].to_numpy(np.float64)) @ p
    wanted = spark.createDataFrame([(n, *seen[n], float(f)) for n, f in zip(names, fitted)], "domain string, source string, target_share double, max_repeats double, fitted double")
    report = wanted.join(used, "domain", "left").na.fill(0, ["tokens", "used"])
    report = report.join(F.broadcast(report.agg(F.sum("used").alias("all_used"))))  # one row
    report = report.select(
        "source",
        "target_share",
        F.col("max_repeats").cast("int").alias("max_repeats"),
        "tokens",
        F.round(F.col("fitted") / F.lit(max(total, 1.0)), 6).alias("fitted_share"),
        F.round(F.coalesce(F.col("used") / F.nullif(F.col("all_used"), F.lit(0)), F.lit(0.0)), 6).alias("actual_share"),
        (F.col("fitted") < F.col("target_share") * F.lit(total) * (1 - UNMET)).alias("unmet"),
        F.lit(settled).alias("settled"),
        (F.col("max_repeats") * F.col("tokens") < F.col("target_share") * F.lit(total)).alias("falls_short"),
    )
    return plan, report


def short_sources(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``source``: targets that their own texts cannot meet.

    Rates are fitted to all texts of target sources; a source falls short where
    its own texts, at these rates, yield less than its share, which is then
    checked exactly: ``max_repeats`` times its tokens are less than that. Texts
    of other or no sources could fill the gap; that does not matter here.
    """
    seen = _targets(targets)
    if not seen:
        return targets.select("source").limit(0)
    classes, _, total, _ = _fitted(memberships(documents, list(seen), tokenizer), seen, own=True)
    out = []
    for k, (source, share, cap) in enumerate(seen.values()):
        own = classes[classes["known"] == k]
        tokens = float(own["tokens"].sum())
        if float((own["rate"] * own["tokens"]).sum()) < share * total * (1 + UNMET) and cap * tokens < share * total:
            out.append((source,))
    return documents.sparkSession.createDataFrame(out, "source string")
