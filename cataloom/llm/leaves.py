"""A bisecting k-means tree over vectors, built across the cluster.

Cells: a bounded sample is bisected, the node of largest dispersion first. All
rows are then counted per cell, and a cell that holds far more than its share
is bisected again on a sample of its own rows, round by round. Leaves: every
cell is bisected on all of its rows until no leaf is wider than the limit,
which is proven for each leaf. A cut may run through a set of similar rows, so
leaves inside a cell are reunited where their union keeps the limit, and leaves
of different cells are linked: each leaf opens the cells in the order of a
priority queue over the tree's nodes, as long as they are not less alike to it
than its own cell by more than a slack, which is calibrated on sampled leaves
against all leaves.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.workspace import materialise
from cataloom.llm.packing import pack, unit, unpack, vectors_of

#: Rows of a sample that fits cells.
SAMPLE_ROWS = 16_384
#: Rows that a cell should hold; one of more than OVERFULL times as many is bisected again.
CELL_ROWS, OVERFULL = 24_000, 3
#: Dispersion a row (1 - cosine to the centre) below which a cell counts as copies and is cut into blocks only.
COPIES = 1e-3
#: Rounds after which no further cells are made.
MOST_ROUNDS = 12
#: Share of the links of sampled leaves that the opened cells must contain, in each class of sizes.
RECALL = 0.99
#: Links of the sample that a class of sizes holds at least; smaller classes are told together.
LEAST_LINKS = 200
#: The same for leaves of at least LARGE rows, which lose more with a link and are few.
LARGE, LARGE_RECALL = 32, 0.9998
#: Leaves of either kind sampled for the calibration, and steps of slack told apart.
CALIBRATION_LEAVES, STEPS = 1_536, 1_024
#: Room for the error of float32 products.
ROOM = 1e-6


@dataclass(frozen=True)
class Tree:
    """Cells and the nodes above them. ``nodes``: centre, radius (angle to the
    furthest cell below), children, and the cell of a bin (else -1)."""

    centres: np.ndarray
    blocks: np.ndarray
    middle: np.ndarray
    radius: np.ndarray
    children: list[tuple[int, ...]]
    cell: np.ndarray


def two_means(x: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Side (bool) of each row in a split seeded by two far apart rows."""
    centre = x.mean(0)
    a = x[np.argmin(x @ centre)]
    b = x[np.argmin(x @ a)]
    side = x @ (b - a) > 0
    for _ in range(rounds):
        n = int(side.sum())
        if n in (0, len(x)):
            break
        right = x[side].sum(0)
        left = x.sum(0) - right
        left /= max(np.linalg.norm(left), 1e-12)
        right /= max(np.linalg.norm(right), 1e-12)
        new = x @ (right - left) > 0
        if (new == side).all():
            break
        side = new
    return side


def bisect_cells(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of ``cells`` nodes, always splitting the one of largest dispersion."""
    heap = [(-(len(x) - float(np.linalg.norm(x.sum(0)))), 0, x)]
    done, made = [], 1
    while heap and len(heap) + len(done) < cells:
        spread, _, node = heapq.heappop(heap)
        side = two_means(node) if spread < 0 and len(node) > 1 else np.zeros(len(node), bool)
        if side.all() or not side.any():
            done.append(node)
            continue
        for part in (node[side], node[~side]):
            heapq.heappush(heap, (-(len(part) - float(np.linalg.norm(part.sum(0)))), made, part))
            made += 1
    centres = np.stack([n.sum(0) for n in done + [h[2] for h in heap]])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    for _ in range(2):
        home = (x @ centres.T).argmax(1)
        for k in range(len(centres)):
            total = x[home == k].sum(0)
            size = np.linalg.norm(total)
            if size > 1e-9:
                centres[k] = total / size
    return centres.astype(np.float32)


def tree_of(centres: np.ndarray, blocks: np.ndarray) -> Tree:
    """The nodes above the cells: the cells' centres bisected down to single cells."""
    middle, radius, children, cell = [], [], [], []

    def add(rows: np.ndarray) -> int:
        c = centres[rows].sum(0)
        c = c / max(np.linalg.norm(c), 1e-12)
        me = len(middle)
        middle.append(c)
        radius.append(float(np.arccos(np.clip(centres[rows] @ c, -1, 1)).max()) if len(rows) > 1 else 0.0)
        children.append(())
        cell.append(int(rows[0]) if len(rows) == 1 else -1)
        return me

    stack = [(add(np.arange(len(centres))), np.arange(len(centres)))]
    while stack:
        me, rows = stack.pop()
        if len(rows) == 1:
            continue
        side = two_means(centres[rows])
        if side.all() or not side.any():
            side = np.arange(len(rows)) % 2 == 0
        parts = [(add(p), p) for p in (rows[side], rows[~side])]
        children[me] = tuple(p[0] for p in parts)
        stack += parts
    return Tree(centres, blocks, np.stack(middle).astype(np.float32), np.array(radius), children, np.array(cell))


def home_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    home = np.empty(len(x), np.int64)
    for s in range(0, len(x), 4096):
        home[s : s + 4096] = (x[s : s + 4096] @ centres.T).argmax(1)
    return home


def best_bins(tree: Tree, x: np.ndarray, home: np.ndarray, slack: np.ndarray | float, wanted: np.ndarray | None = None):
    """``(cell, rows of x)`` in the order of a priority queue over the tree's nodes, of the ``wanted`` cells or all.

    A node's priority is the most that any row still gains there: the likeness
    that a cell below it can reach at best, less the likeness of the row's own
    cell and plus the slack. The queue ends when nothing is left to gain, so
    every cell within the slack is opened.
    """
    least = np.einsum("ij,ij->i", x, tree.centres[home]) - np.asarray(slack, np.float32)
    useful = np.ones(len(tree.cell), bool)
    if wanted is not None:
        for node in range(len(tree.cell) - 1, -1, -1):  # children come after their parent
            useful[node] = wanted[tree.cell[node]] if tree.cell[node] >= 0 else any(useful[c] for c in tree.children[node])
    heap, made = [(-math.inf, 0, 0, np.arange(len(x)))], 1
    while heap:
        _, _, node, rows = heapq.heappop(heap)
        if tree.cell[node] >= 0:
            if useful[node]:
                yield int(tree.cell[node]), rows
            continue
        for child in tree.children[node]:
            if not useful[child]:
                continue
            like = x[rows] @ tree.middle[child]
            if tree.cell[child] < 0:
                like = np.cos(np.maximum(np.arccos(np.clip(like, -1, 1)) - tree.radius[child], 0)) + np.float32(1e-6)
            gain = like - least[rows]
            if (keep := gain >= 0).any():
                heapq.heappush(heap, (-float(gain.max()), made, child, rows[keep]))
                made += 1


def _collected(df: DataFrame, dim: int, most: int) -> np.ndarray:
    _, raw = vectors_of(df.toArrow()["v"], dim)
    return unit(raw[:most])


def fit_tree(df: DataFrame, id_col: str, vec_col: str, dim: int, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS) -> Tree:
    """Cells from bounded samples, chosen by a hash of the id, and counts of all rows."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    total = rows.count()
    mixed = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 30))
    x = _collected(rows.where(mixed < int(min(1.0, sample_rows / max(total, 1)) * (1 << 30))).select("v"), dim, 2 * sample_rows)
    centres = bisect_cells(x if len(x) else np.eye(1, dim, dtype=np.float32), max(1, math.ceil(total / cell_rows)))
    for _ in range(MOST_ROUNDS):
        n, spread = _measure(rows, dim, centres)
        over = np.nonzero((n > OVERFULL * cell_rows) & (spread > COPIES))[0]
        if not len(over):
            break
        picked = _cell_sample(rows, dim, centres, over, n, sample_rows)
        fresh = [bisect_cells(picked[c], math.ceil(n[c] / cell_rows)) for c in over if len(picked[c]) > 1]
        if not any(len(f) > 1 for f in fresh):
            break
        split = [c for c in over if len(picked[c]) > 1]
        centres = np.concatenate([np.delete(centres, split, 0), *fresh])
    return tree_of(centres, np.maximum(1, np.ceil(n / (1.5 * cell_rows))).astype(np.int64))


def _measure(rows: DataFrame, dim: int, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each cell and their mean distance from its centre, over all rows."""

    def op(batches):
        n, away = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for b in batches:
            _, raw = vectors_of(b.column(0), dim)
            for s in range(0, len(raw), 4096):
                like = unit(raw[s : s + 4096]) @ centres.T
                home = like.argmax(1)
                n += np.bincount(home, minlength=len(n))
                away += np.bincount(home, 1 - like.max(1), minlength=len(n))
        held = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), pa.array(away[held])], names=["cell", "n", "away"])

    out, far = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    got = rows.select("v").mapInArrow(op, "cell long, n long, away double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("away").alias("away")).toArrow()
    at = np.asarray(got["cell"])
    out[at], far[at] = np.asarray(got["n"]), np.asarray(got["away"])
    return out, far / np.maximum(out, 1)


def _cell_sample(rows: DataFrame, dim: int, centres: np.ndarray, over: np.ndarray, n: np.ndarray, sample_rows: int) -> dict[int, np.ndarray]:
    """Unit vectors of a sample of the rows of the cells ``over``, bounded in all by ``sample_rows`` twice."""
    share = min(1.0, sample_rows / max(int(n[over].sum()), 1))

    def op(batches):
        for b in batches:
            _, raw = vectors_of(b.column(0), dim)
            if len(raw):
                home = home_of(unit(raw), centres)
                w = np.isin(home, over)
                yield pa.RecordBatch.from_arrays([pa.array(home[w]), pa.array(list(raw[w]), pa.list_(pa.float32()))], names=["cell", "v"])

    mixed = F.pmod(F.xxhash64(F.col("id"), F.lit(29)), F.lit(1 << 30))
    got = rows.where(mixed < int(share * (1 << 30))).select("v").mapInArrow(op, "cell long, v array<float>").toArrow()
    cell, raw = np.asarray(got["cell"]), vectors_of(got["v"], dim)[1]
    return {int(c): unit(raw[cell == c][: 2 * sample_rows]) if (cell == c).any() else np.empty((0, dim), np.float32) for c in over}


def _block_of(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)).astype(np.int64)) % blocks


def route(df: DataFrame, id_col: str, vec_col: str, dim: int, tree: Tree) -> DataFrame:
    """Packed rows of each (cell, block): ``n, ids, vecs``."""
    centres, blocks = tree.centres, tree.blocks

    def flush(ids: list, vecs: list):
        i, raw = np.concatenate(ids), np.concatenate(vecs)
        cell = np.concatenate([home_of(unit(raw[s : s + 4096]), centres) for s in range(0, len(raw), 4096)])
        block = _block_of(i, blocks[cell])
        key = cell * (int(blocks.max()) + 1) + block
        order = np.argsort(key, kind="stable")
        bounds = np.nonzero(np.diff(key[order], prepend=-1))[0].tolist() + [len(order)]
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            w = order[a:b]
            out.append((int(cell[w[0]]), int(block[w[0]]), len(w), pack(i[w]), pack(raw[w])))
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["cell", "block", "n", "ids", "vecs"])

    def op(batches):
        ids, vecs, held = [], [], 0
        for batch in batches:
            rows, raw = vectors_of(batch.column(1), dim)
            known = np.asarray(batch.column(0).is_valid())[rows]
            rows, raw = rows[known], raw[known]
            if len(rows):
                ids.append(np.asarray(batch.column(0).take(pa.array(rows))).astype(np.int64))
                vecs.append(raw)
                held += len(rows)
            if held >= 32_768:
                yield flush(ids, vecs)
                ids, vecs, held = [], [], 0
        if held:
            yield flush(ids, vecs)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(op, "cell int, block int, n int, ids binary, vecs binary")


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' connected part under the edges ``a, b``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def near_pairs(x: np.ndarray, y: np.ndarray, least: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``x`` and ``y`` (float32, unit) whose cosine is at least ``least``.

    ``least`` is one number, or a pair ``(p, q, c)`` of weights: the pair (i, j) needs ``c * p[i] * q[j]``.
    """
    p, q, c = least if isinstance(least, tuple) else (np.ones(len(x)), np.ones(len(y)), least)
    p, q = p.astype(np.float32), q.astype(np.float32)
    low = np.float32(c * (p.min() if len(p) else 1) * (q.min() if len(q) else 1) - 1e-5)
    left, right = [], []
    for s in range(0, len(x), 1024):
        for t in range(s if y is x else 0, len(y), 4096):  # of one set with itself, only the pairs above the diagonal and its blocks
            like = x[s : s + 1024] @ y[t : t + 4096].T
            i, j = np.divmod(np.flatnonzero(like >= low), like.shape[1])  # faster than nonzero in two dimensions
            left.append(i + s)
            right.append(j + t)
    a, b = np.concatenate(left or [np.empty(0, int)]), np.concatenate(right or [np.empty(0, int)])
    keep = np.empty(len(a), bool)
    for s in range(0, len(a), 65_536):
        i, j = a[s : s + 65_536], b[s : s + 65_536]
        keep[s : s + 65_536] = np.einsum("ij,ij->i", x[i].astype(np.float64), y[j].astype(np.float64)) >= c * p[i] * q[j] - 1e-7
    return a[keep], b[keep]


def compact(x: np.ndarray, limit: float) -> bool:
    """Whether no two rows are further apart than ``limit``, proven.

    Two rows are at most as far apart (as angles) as both are from the centre
    together, so only rows far enough out can break the limit; those are
    compared, all with all and in blocks.
    """
    centre = x.sum(0)
    centre = centre / max(np.linalg.norm(centre), 1e-12)
    like = x @ centre
    if like.min() < 1 - limit - ROOM or (x @ x[like.argmin()]).min() < 1 - limit - ROOM:
        return False
    away = np.arccos(np.clip(like, -1, 1))
    out = x[away + away.max() > math.acos(max(-1.0, 1 - limit)) - 1e-4]
    for s in range(0, len(out), 1024):
        if (out[s : s + 1024] @ out[s:].T).min() < 1 - limit - ROOM:
            return False
    return True


#: Rows up to which a node's products are kept as one matrix; it changes the time, not the leaves' bound.
GRAM_ROWS = 512


def _bisect_gram(g: np.ndarray, least: np.float32) -> np.ndarray:
    """Leaf number of each row of a node whose products are ``g``."""
    leaf = np.empty(len(g), np.int64)
    lone = (g >= least).sum(1) == 1  # shares a leaf with nobody, however the node is split
    count = int(lone.sum())
    leaf[lone] = np.arange(count)
    rows = np.nonzero(~lone)[0]
    stack = [(rows, g[np.ix_(rows, rows)])] if len(rows) else []
    while stack:
        rows, g = stack.pop()
        if g.min() >= least:
            leaf[rows] = count
            count += 1
            continue
        whole = g.sum(1)
        a = int(whole.argmin())
        side = g[int(g[a].argmin())] > g[a]
        first = side
        for _ in range(3):
            right = g @ side.astype(np.float32)
            left = whole - right
            new = right * np.sqrt(max(left[~side].sum(), 1e-12)) > left * np.sqrt(max(right[side].sum(), 1e-12))
            if (new == side).all():
                break
            side = new
        if side.all() or not side.any():
            side = first if first.any() and not first.all() else np.arange(len(rows)) > 0
        for w in (side, ~side):
            w = np.nonzero(w)[0]
            stack.append((rows[w], g[np.ix_(w, w)]))
    return leaf


def bisect_leaves(x: np.ndarray, limit: float) -> np.ndarray:
    """Leaf number of each row: nodes are bisected until none is wider than ``limit``.

    Every node that breaks the limit has to be split, so the order in which
    nodes are taken does not change the leaves.
    """
    least = np.float32(1 - limit - ROOM)
    leaf, count = np.empty(len(x), np.int64), 0
    stack = [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        y = x[rows]
        if len(rows) <= GRAM_ROWS:
            own = _bisect_gram(y @ y.T, least)
        elif compact(y, limit):
            own = np.zeros(len(rows), np.int64)
        else:
            side = two_means(y)
            if side.all() or not side.any():
                side = np.arange(len(rows)) % 2 == 0
            stack += [rows[side], rows[~side]]
            continue
        leaf[rows] = own + count
        count += int(own.max()) + 1
    return leaf


def medoids(x: np.ndarray, label: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row nearest to each centre, the unit centres, and the least likeness of a row to its centre."""
    order = np.argsort(label, kind="stable")
    starts = np.searchsorted(label[order], np.arange(count))
    centres = np.add.reduceat(x[order], starts, axis=0)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    like = np.einsum("ij,ij->i", x[order], centres[label[order]])
    best = np.lexsort((-like, label[order]))
    return order[best[starts]], centres, np.minimum.reduceat(like, starts)


def split_cell(x: np.ndarray, limit: float) -> np.ndarray:
    """Fragment number of each row: bisection until compact, then reunion inside the cell.

    Leaves whose medoids lie within the limit are reunited where their union
    keeps the limit; of a set of linked leaves that does not, each leaf, the
    largest first, joins the first larger one with which it does.
    """
    leaf = bisect_leaves(x, limit)
    count = int(leaf.max()) + 1
    medoid, _, _ = medoids(x, leaf, count)
    m = x[medoid]
    a, b = near_pairs(m, m, 1 - limit)
    a, b = a[a < b], b[a < b]
    part = components_of(count, a, b)
    order = np.argsort(leaf, kind="stable")
    ends = np.searchsorted(leaf[order], np.arange(count + 1))
    rows = [order[ends[k] : ends[k + 1]] for k in range(count)]
    by = np.argsort(part, kind="stable")
    for own in np.split(by, np.nonzero(np.diff(part[by]))[0] + 1):
        if len(own) < 2 or compact(x[np.concatenate([rows[k] for k in own])], limit):
            continue
        inside = np.isin(a, own)
        linked = set(zip(a[inside].tolist(), b[inside].tolist()))
        hubs: list[int] = []
        for k in sorted(own.tolist(), key=lambda k: (-len(rows[k]), k)):
            for h in hubs:
                if (min(h, k), max(h, k)) in linked and compact(x[np.concatenate([rows[h], rows[k]])], limit):
                    rows[h] = np.concatenate([rows[h], rows[k]])
                    part[k] = h
                    break
            else:
                hubs.append(k)
                part[k] = k
    _, merged = np.unique(part, return_inverse=True)
    return merged[leaf]


#: One row of the leaf table. ``leaf``: one leaf, its size, its members' ids, those nearest to its
#: centre first, and the distances of the first TYPICAL (``more``). ``home``: of all leaves of a
#: block their names, medoids, sizes (``ids``), mean likeness of the rows to the medoid and least
#: likeness to the centre (``more``), and the centres of the leaves of several rows (``mids``).
#: ``rows``: ids, leaf and vector of all rows of a block. ``near``: what ``search`` made of a block.
LEAVES = "kind string, cell int, block int, n int, frag long, ids binary, frags binary, vecs binary, more binary, mids binary"
#: Members of a leaf whose distances are kept.
TYPICAL = 16


def leaf_table(packed: DataFrame, dim: int, limit: float, tree: Tree, keep_rows: bool = False, search=None, typical: bool = False) -> DataFrame:
    """Compact leaves of every cell. A leaf is named by its smallest id.

    ``search(x, raw, ids, label, medoid, tight)`` may give four arrays of further
    results of a block: ids, ids, distances, and the leaf number of the first.
    """

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, block = int(key[0]), int(key[1])
        ids = np.concatenate([unpack(i, np.int64, n) for n, i in zip(pdf["n"], pdf["ids"])])
        raw = np.concatenate([unpack(v, np.float32, n * dim).reshape(n, dim) for n, v in zip(pdf["n"], pdf["vecs"])])
        order = np.argsort(ids, kind="stable")
        ids, raw = ids[order], raw[order]
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == ids[:-1]) & (raw[1:] == raw[:-1]).all(1)
        ids, raw = ids[~again], raw[~again]
        x = unit(raw)
        label = split_cell(x, limit)
        count = int(label.max()) + 1
        name = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(name, label, ids)
        medoid, middle, worst = medoids(x, label, count)
        exact = unit(raw, np.float64) if typical else x
        centre = medoids(exact, label, count)[1] if typical else middle
        away = np.round(np.maximum(1 - np.einsum("ij,ij->i", exact, centre[label]), 0), 9)
        order = np.lexsort((ids, away, label))
        ends = np.searchsorted(label[order], np.arange(count + 1))
        tight = np.add.reduceat(np.einsum("ij,ij->i", x[order], x[medoid][label[order]]), ends[:-1]) / np.diff(ends)
        out = []
        for k in range(count):
            members, told = ids[order[ends[k] : ends[k + 1]]], away[order[ends[k] : ends[k + 1]]][:TYPICAL]
            out.append(("leaf", cell, block, len(members), int(name[k]), members.tobytes(), None, None, told.tobytes() if typical else None, None))
        several = np.diff(ends) > 1
        out.append(("home", cell, block, count, None, pack(np.diff(ends)), pack(name), pack(raw[medoid]), pack(np.stack([tight, worst]).astype(np.float32)), pack(middle[several].astype(np.float16))))
        if keep_rows:
            out.append(("rows", cell, block, len(ids), None, pack(ids[order]), pack(name[label[order]]), pack(raw[order]), None, None))
        if search is not None:
            a, b, d, own = search(x, raw, ids, label, medoid, tight)
            out.append(("near", cell, block, len(a), None, pack(a), pack(b), pack(d), pack(name[own]), None))
        return pd.DataFrame(out, columns=["kind", "cell", "block", "n", "frag", "ids", "frags", "vecs", "more", "mids"])

    blocks = int(tree.blocks.sum())
    return packed.repartition(max(2, blocks), "cell", "block").groupBy("cell", "block").applyInPandas(one, LEAVES)


def _read_home(n, ids, frags, vecs, more, dim):
    """Names, sizes, medoids (raw), tightness and least likeness to the centre of one ``home`` row."""
    tight, worst = unpack(more, np.float32, 2 * n).reshape(2, n)
    return unpack(frags, np.int64, n), unpack(ids, np.int64, n), unpack(vecs, np.float32, n * dim).reshape(n, dim), tight, worst


def homes(table: DataFrame) -> DataFrame:
    return table.where("kind = 'home'").select("cell", "block", "n", "ids", "frags", "vecs", "more")


def _weights(loose: bool, tight: np.ndarray) -> np.ndarray:
    return tight if loose else np.ones(len(tight), np.float32)


def calibrate(table: DataFrame, dim: int, limit: float, tree: Tree, loose: bool, recall: float) -> tuple[float, float]:
    """Slacks of small and of large leaves at which the wanted share of the links between cells is found.

    Sampled leaves are compared with all leaves. A link of a large leaf counts
    as found if the large leaf (of two, the larger) opens the other's cell; of
    two small leaves one must open the other's cell, so the smaller gap counts.
    For small leaves the share must hold in each class of sizes of both leaves
    together (2 to 3 rows, 4 to 7, and so on).
    """
    if len(tree.centres) == 1:
        return 0.0, 0.0
    packs = homes(table)

    def count(frames):
        for pdf in frames:
            sizes = [unpack(i, np.int64, n) for n, i in zip(pdf["n"], pdf["ids"])]
            yield pd.DataFrame({"n": [sum(len(s) for s in sizes)], "large": [int(sum((s >= LARGE).sum() for s in sizes))]})

    total = packs.select("n", "ids").mapInPandas(count, "n long, large long").agg(F.sum("n").alias("n"), F.sum("large").alias("large")).first()
    small_share, large_share = (min(1.0, CALIBRATION_LEAVES / max(x or 0, 1)) for x in (total["n"], total["large"]))

    def take(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                name, size, raw, tight, _ = _read_home(row.n, row.ids, row.frags, row.vecs, row.more, dim)
                w = _block_of(name, np.array([1 << 20])) < np.where(size >= LARGE, large_share, small_share) * (1 << 20)
                if w.any():
                    yield pd.DataFrame({"cell": [row.cell], "n": [int(w.sum())], "frags": [pack(name[w])], "sizes": [pack(size[w])], "vecs": [pack(raw[w])], "tight": [pack(tight[w])]})

    got = packs.mapInPandas(take, "cell int, n int, frags binary, sizes binary, vecs binary, tight binary").collect()
    if not got:
        return 0.0, 0.0
    size = np.concatenate([unpack(r["sizes"], np.int64, r["n"]) for r in got])
    tight = np.concatenate([unpack(r["tight"], np.float32, r["n"]) for r in got])
    home = np.repeat([r["cell"] for r in got], [r["n"] for r in got])
    x = unit(np.concatenate([unpack(r["vecs"], np.float32, r["n"] * dim).reshape(-1, dim) for r in got]))
    like = x @ tree.centres.T
    told = table.sparkSession.sparkContext.broadcast((size, x, tight, home, like))
    centres = tree.centres

    def op(frames):
        own, x, tight, home, like = told.value
        held = np.zeros((65, STEPS + 1), np.int64)
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                _, size, raw, t, _ = _read_home(row.n, row.ids, row.frags, row.vecs, row.more, dim)
                y = unit(raw)
                i, j = near_pairs(x, y, (_weights(loose, tight), _weights(loose, t), 1 - limit))
                w = (home[i] != row.cell) & ((own[i] >= size[j]) | (size[j] < LARGE))
                i, j = i[w], j[w]
                at_home = y[j] @ centres[row.cell] if len(j) else np.empty(0)
                out, back = like[i, home[i]] - like[i, row.cell], at_home - np.einsum("ij,ij->i", y[j], centres[home[i]])
                gap = np.where(own[i] >= LARGE, out, np.minimum(out, back))
                kind = np.where(own[i] >= LARGE, 64, np.floor(np.log2(own[i] + size[j]))).astype(np.int64)
                np.add.at(held, (kind, np.clip(np.ceil(gap * (STEPS / 2)), 0, STEPS).astype(np.int64)), 1)
        i, g = np.nonzero(held)
        yield pd.DataFrame({"i": i, "g": g, "n": held[i, g]})

    got = packs.mapInPandas(op, "i long, g long, n long").groupBy("i", "g").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros((65, STEPS + 1))
    held[got["i"], got["g"]] = got["n"]
    small = slack_of(held[:64], recall)
    return small, max(small, slack_of(held[64:], LARGE_RECALL))


def slack_of(held: np.ndarray, recall: float) -> float:
    """Slack from the number of links of each class of sizes (line) at each step of the gap (column)."""
    most, lines = 0, []
    for line in held:
        if lines and lines[-1].sum() < LEAST_LINKS:
            lines[-1] = lines[-1] + line
        elif line.any():
            lines.append(line)
    if len(lines) > 1 and lines[-1].sum() < LEAST_LINKS:
        lines[-2:] = [lines[-2] + lines[-1]]
    for line in lines:
        most = max(most, int(np.searchsorted(line.cumsum(), recall * line.sum() - 1e-9)))
    return most * 2 / STEPS


#: Medoids sent to cells in one round, as a multiple of all rows; so the disk that a round takes is
#: about that of as many rows, however many cells the leaves open in all. Fewer than LEAST_VISITS are one round.
ROUND_VISITS, LEAST_VISITS = 1.5, 100_000
#: Leaves sampled to tell how many open each cell, and rows of visiting leaves compared at once.
VISIT_SAMPLE, VISIT_ROWS = 65_536, 8_192


def rounds_of(table: DataFrame, dim: int, tree: Tree, slack: tuple[float, float]) -> list[np.ndarray]:
    """The cells (bool, one array a round) that are visited in each round of ``links``, by the visits of sampled leaves."""
    packs, centres, cells = homes(table), tree.centres, len(tree.centres)

    def sizes(frames):
        for pdf in frames:
            yield pd.DataFrame({"n": [int(pdf["n"].sum())], "rows": [int(sum(unpack(i, np.int64, n).sum() for n, i in zip(pdf["n"], pdf["ids"])))]})

    total = packs.select("n", "ids").mapInPandas(sizes, "n long, rows long").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).first()
    share = min(1.0, VISIT_SAMPLE / max(total["n"] or 0, 1))

    def count(frames):
        held = np.zeros(cells, np.int64)
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                name, size, raw, _, _ = _read_home(row.n, row.ids, row.frags, row.vecs, row.more, dim)
                w = _block_of(name, np.array([1 << 20])) < share * (1 << 20)
                if w.any():
                    like = unit(raw[w]) @ centres.T
                    held += (like >= (like[:, row.cell] - np.where(size[w] >= LARGE, slack[1], slack[0]))[:, None]).sum(0)
        opened = np.nonzero(held)[0]
        yield pd.DataFrame({"cell": opened, "n": held[opened]})

    got = packs.mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    visits = np.zeros(cells)
    visits[got["cell"]] = got["n"] / share * tree.blocks[got["cell"]]
    most = max(ROUND_VISITS * (total["rows"] or 0), LEAST_VISITS)
    no = (np.cumsum(visits) - visits / 2) // most if visits.sum() > most else np.zeros(cells)
    return [no == r for r in np.unique(no)]


def links(table: DataFrame, dim: int, limit: float, tree: Tree, slack: tuple[float, float], loose: bool = False) -> DataFrame:
    """``a, b, size_a, size_b``: leaves of different blocks whose medoids are linked, ``a < b``.

    Linked: within ``limit``, or, if ``loose``, so near that rows as far from
    their medoids as the leaves' rows are on average could be. Leaves of a cell
    cut into blocks open all blocks of the cell. Cells are visited in rounds,
    each written and its shuffle removed before the next one.
    """
    found = [materialise(_visited(table, dim, limit, tree, slack, loose, wanted), "links") for wanted in rounds_of(table, dim, tree, slack)]
    return reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"))


#: Visiting leaves of one cell from which on the leaves that visit it in turn are left out, and room for the error of float32 products there.
LEAST_TURN, TURN_ROOM = 64, 1e-4


def _turns(cell: int, other: int) -> bool:
    """Whether leaves that open each other's cells are compared in ``cell``, and not in ``other``."""
    return (cell < other) == ((cell + other) % 2 == 0)


def _meetings(cell: int, own: tuple, visits: pd.DataFrame, read, tree: Tree, slack: tuple[float, float]):
    """Pairs of sets of leaves to compare in ``cell``, of visitors and of the cell's own leaves.

    Where many leaves of one cell visit, those own leaves that surely open
    that cell as well are left out of one of the two cells: they meet in the other.
    """
    _, hs, h, _ = own
    least = np.einsum("ij,j->i", h, tree.centres[cell]) - np.where(hs >= LARGE, slack[1], slack[0])
    many = visits.groupby("home")["n"].transform("sum") >= LEAST_TURN
    turned = many & np.array([o != cell and not _turns(cell, int(o)) for o in visits["home"]], bool)
    for source, part in visits.groupby(visits["home"].where(turned, -1), sort=False):
        stay = own
        if source >= 0:
            w = h @ tree.centres[source] < least + TURN_ROOM
            if not w.any():
                continue
            stay = tuple(c[w] for c in own)
        for _, some in part.groupby(part["n"].cumsum() // VISIT_ROWS, sort=False):  # a part at a time is unpacked
            yield read(some), stay


def _visited(table: DataFrame, dim: int, limit: float, tree: Tree, slack: tuple[float, float], loose: bool, wanted: np.ndarray) -> DataFrame:
    """``a, b, size_a, size_b`` of the links that leaves find in the ``wanted`` cells."""
    blocks = tree.blocks

    def visit(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                name, size, raw, tight, _ = _read_home(row.n, row.ids, row.frags, row.vecs, row.more, dim)
                if wanted[row.cell]:
                    yield pd.DataFrame([("home", row.cell, row.block, row.cell, row.n, row.ids, row.frags, row.vecs, pack(tight))], columns=columns)
                x = unit(raw)
                out = []
                for cell, w in best_bins(tree, x, np.full(len(x), row.cell), np.where(size >= LARGE, slack[1], slack[0]), wanted):
                    for block in range(int(blocks[cell])):
                        if cell != row.cell or block > row.block:
                            out.append(("visit", cell, block, row.cell, len(w), pack(size[w]), pack(name[w]), pack(raw[w]), pack(tight[w])))
                if out:
                    yield pd.DataFrame(out, columns=columns)

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        def read(rows):
            got = [(unpack(f, np.int64, n), unpack(i, np.int64, n), unpack(v, np.float32, n * dim).reshape(n, dim), unpack(m, np.float32, n)) for n, i, f, v, m in zip(rows["n"], rows["ids"], rows["frags"], rows["vecs"], rows["more"])]
            name, size, raw, tight = (np.concatenate(g) for g in zip(*got))
            return name, size, unit(raw), tight

        own, visits = pdf[pdf["kind"] == "home"], pdf[pdf["kind"] == "visit"]
        found = [pd.DataFrame({c: np.empty(0, np.int64) for c in ("a", "b", "size_a", "size_b")})]
        if len(own) and len(visits):
            for (other, vs, v, vt), (home, hs, h, ht) in _meetings(int(key[0]), read(own), visits, read, tree, slack):
                i, j = near_pairs(v, h, (_weights(loose, vt), _weights(loose, ht), 1 - limit))
                first = other[i] < home[j]
                part = pd.DataFrame({"a": np.minimum(other[i], home[j]), "b": np.maximum(other[i], home[j]), "size_a": np.where(first, vs[i], hs[j]), "size_b": np.where(first, hs[j], vs[i])})
                found.append(part[part["a"] < part["b"]])
        return pd.concat(found)

    columns = ["kind", "cell", "block", "home", "n", "ids", "frags", "vecs", "more"]
    schema = "kind string, cell int, block int, home int, n int, ids binary, frags binary, vecs binary, more binary"
    sent = homes(table).mapInPandas(visit, schema)
    return sent.repartition(max(2, int(blocks[wanted].sum())), "cell", "block").groupBy("cell", "block").applyInPandas(one, "a long, b long, size_a long, size_b long")


#: Bits of the filter that tells linked leaves from others (a prime, fixed); it is broadcast and never larger.
FILTER_BITS = 4_194_301


def marks_of(names: DataFrame, column: str) -> np.ndarray:
    """Bit per remainder of a leaf's name; further leaves may share a bit, so a join has to follow."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = names.select(F.shiftright(bit, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, {FILTER_BITS}) % 32 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(FILTER_BITS // 32 + 1, np.uint32)
    held[np.asarray(words["word"])] = np.asarray(words["bits"]).astype(np.uint32)
    return np.unpackbits(held.view(np.uint8), bitorder="little").astype(bool)


def marked(marks: np.ndarray, names: np.ndarray) -> np.ndarray:
    return marks[np.mod(names, FILTER_BITS)]


def grow(df: DataFrame, id_col: str, vec_col: str, dim: int, limit: float, keep_rows: bool = False, search=None, typical: bool = False, loose: bool = False, recall: float = RECALL, **sizes) -> tuple[DataFrame, DataFrame, Tree]:
    """The written leaf table, the links between leaves of different blocks, and the tree."""
    tree = fit_tree(df, id_col, vec_col, dim, **sizes)
    table = materialise(leaf_table(route(df, id_col, vec_col, dim, tree), dim, limit, tree, keep_rows, search, typical), "leaves")
    slack = calibrate(table, dim, limit, tree, loose, recall)
    return table, materialise(links(table, dim, limit, tree, slack, loose), "links"), tree
