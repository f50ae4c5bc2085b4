"""Second-order gradient boosting by Spark aggregates: L2 penalty, columns drawn for each tree, learnt directions for missing values, true gain.

Rows are binned once (at most ``BINS`` bins a feature, one for missing values) and packed in blocks of ``BLOCK_ROWS``. Features of few bins
share a byte, and sums are taken by byte: those of a feature are sums of these. A level of a tree is one job: tasks give sums of
gradients by (byte, node, value), these are added up by a shuffle on the byte, and the tasks that add them find the best split of each
node in the byte's features. The driver sees a split for each node and feature, never rows or histograms. Up to ``ALONE_BLOCKS`` blocks
are one task for each model, which grows ``ALONE_TREES`` trees a job. Gradients are rounded to fixed point, so sums are exact and a model
does not depend on how rows are dealt out, nor on tasks that run twice.

A level takes some tens of milliseconds of work, so these jobs are RDD jobs over cached blocks: planning a DataFrame each time would take
longer than the sums. Predictions so far are a function of a block and the trees; a Python worker keeps them and adds the trees that are
new, or all of them where another worker had the block.

Several models can be trained in the same jobs, each on the rows outside its own fold: that is cross-validation.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import no_nan
from driftline.session import ship
from driftline.tables import cut

#: Bins of a feature, beside that of missing values; rows of a block; trees that each job carries itself.
BINS, BLOCK_ROWS, RECENT = 255, 1 << 16, 16
#: Blocks that one task takes by itself (two million rows, some 80 to 200 MB; more go level by level over all tasks), and trees that it grows in a job.
ALONE_BLOCKS, ALONE_TREES = 32, 50
#: Gradients in fixed point, and the least gain of a split.
UNIT, LEAST_GAIN = float(1 << 24), 1e-6
_MISSING = 255


@dataclass(frozen=True)
class Settings:
    trees: int = 600
    depth: int = 5
    step: float = 0.04
    rows: float = 0.9
    columns: float = 0.9
    min_weight: float = 6.0
    l2: float = 1.0
    seed: int = 42
    logistic: bool = False


@dataclass
class Tree:
    """Nodes as a heap: the children of i are 2i + 1 and 2i + 2; feature -1 is a leaf. Up to ``threshold`` goes left."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def leaves(self, left_of) -> np.ndarray:
        """The node that each row ends in; left_of(rows, nodes) says who goes left."""
        node = left_of(None, None)
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            rows = np.flatnonzero(self.feature[node] >= 0)
            if not len(rows):
                break
            at = node[rows]
            node[rows] = 2 * at + 2 - left_of(rows, at)
        return node

    def coded(self, rows: np.ndarray, codes: "Codes", node: np.ndarray | None = None) -> np.ndarray:
        """The node that each row (a column of bytes) ends in, from the root or from ``node`` on."""
        n = rows.shape[1]
        node = np.zeros(n, np.intp) if node is None else node
        split = np.flatnonzero(self.feature >= 0)
        byte, left = np.zeros(len(self.feature), np.intp), np.zeros((len(self.feature), 256), np.intp)
        for i in split:
            byte[i], left[i] = codes.place[self.feature[i]][0], codes.left(self.feature[i], self.bin[i], self.missing_left[i])
        one = len(set(byte[split].tolist())) == 1
        flat, left = rows.reshape(-1), left.reshape(-1)
        goes_on = self.feature >= 0
        at = np.flatnonzero(goes_on.take(node))
        while len(at):
            every = len(at) == n
            own = node if every else node.take(at)
            value = (rows[byte[split[0]]] if every else rows[byte[split[0]]].take(at)) if one else flat.take(byte.take(own) * n + at)
            own = 2 * own + 2 - left.take(own * 256 + value)
            if every:
                node = own
            else:
                node[at] = own
            at = at[goes_on.take(own)]
        return node

    def raw(self, x: np.ndarray) -> np.ndarray:
        def left(rows, at):
            if rows is None:
                return np.zeros(len(x), np.int64)
            v = x[rows, self.feature[at]]
            return np.where(np.isnan(v), self.missing_left[at], v <= self.threshold[at])

        return self.leaves(left)


@dataclass
class Forest:
    """Trees over named features; the margin is ``base`` and the values of the leaves."""

    features: list[str]
    base: float
    logistic: bool = False
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.value[tree.raw(x)]
        return out

    def gains(self) -> dict[str, float]:
        """The mean gain of the splits of each feature; 0 for one that is not used."""
        total, n = np.zeros(len(self.features)), np.zeros(len(self.features))
        for tree in self.trees:
            used = tree.feature >= 0
            np.add.at(total, tree.feature[used], tree.gain[used])
            np.add.at(n, tree.feature[used], 1)
        return {f: float(t / max(k, 1)) for f, t, k in zip(self.features, total, n)}

    def to_dict(self) -> dict:
        rows = [{k: getattr(t, k).tolist() for k in ("feature", "bin", "threshold", "missing_left", "value", "gain")} for t in self.trees]
        return {"features": self.features, "base": self.base, "logistic": self.logistic, "trees": rows}

    @classmethod
    def from_dict(cls, d: dict) -> "Forest":
        kinds = {"feature": np.int32, "bin": np.int32, "threshold": float, "missing_left": bool, "value": float, "gain": float}
        return cls(d["features"], d["base"], d["logistic"], [Tree(**{k: np.array(t[k], dtype=kind) for k, kind in kinds.items()}) for t in d["trees"]])


def edges_of(data: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Thresholds of each feature: its values where they are few, else quantiles of a sketch; the largest value parts nothing."""
    shares = [i / bins for i in range(1, bins)]
    wide = data.agg(*[F.percentile_approx(f"x{i}", shares, 10_000).alias(f"q{i}") for i in range(len(features))], *[F.max(f"x{i}").alias(f"m{i}") for i in range(len(features))]).first()
    out = []
    for i in range(len(features)):
        found = np.unique(np.array(wide[f"q{i}"] or [], dtype=float))
        out.append(found[found < wide[f"m{i}"]] if len(found) else found)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many thresholds lie below it."""
    out = np.full(x.shape, _MISSING, dtype=np.uint8)
    for i, e in enumerate(edges):
        have = ~np.isnan(x[:, i])
        out[have, i] = np.searchsorted(e, x[have, i], side="left")
    return out


@dataclass(frozen=True)
class Codes:
    """How bins are kept: features of few bins share a byte, as digits. place: byte, stride and radix of each feature; cells: values of each byte."""

    place: list[tuple[int, int, int]]
    cells: list[int]
    bins: list[int]

    @classmethod
    def of(cls, edges: list[np.ndarray], have: list[int], rows: int) -> "Codes":
        """``have``: values of each feature that are not missing. A feature that parts nothing has one digit, 0."""
        place, cells, bins = [], [1], []
        for e, k in zip(edges, have):
            bins.append(len(e) + 1)
            radix = len(e) + 1 + (k < rows) if k else 1
            byte = next((i for i, c in enumerate(cells) if c * radix <= 256), len(cells))
            if byte == len(cells):
                cells.append(1)
            place.append((byte, cells[byte], radix))
            cells[byte] *= radix
        return cls(place, cells, bins)

    def encode(self, bins: np.ndarray) -> np.ndarray:
        """A row of bytes for each byte."""
        out = np.zeros((len(self.cells), len(bins)), np.uint8)
        for f, (byte, stride, radix) in enumerate(self.place):
            if radix > 1:
                out[byte] += (np.minimum(bins[:, f], radix - 1) * stride).astype(np.uint8)  # missing values are the last digit
        return out

    def left(self, f: int, b: int, missing_left: bool) -> np.ndarray:
        """Which values of the feature's byte go left."""
        _, stride, radix = self.place[f]
        digit = np.arange(256) // stride % radix
        return np.where(digit == self.bins[f], missing_left, digit <= b)

    def sums(self, f: int, both: np.ndarray) -> np.ndarray:
        """Of sums by node and value of the feature's byte, those by its bins and, last, missing values."""
        _, stride, radix = self.place[f]
        two, nodes, cells = both.shape
        own = both.reshape(two, nodes, cells // (stride * radix), radix, stride).sum(axis=(2, 4))
        return own if radix > self.bins[f] else np.concatenate([own, np.zeros((two, nodes, 1), own.dtype)], axis=2)

    def asked(self, columns: list[int]) -> list[int]:
        """The columns that can part rows; one, for the sums, where none can."""
        return [f for f in columns if self.place[f][2] > 1] or columns[:1]


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h


def drawn(key: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """The rows of a tree, by a hash of row and tree."""
    salt = mixed(np.array([settings.seed * 1_000_003 + tree + 1], dtype=np.uint64))
    return (mixed(key ^ salt) >> np.uint64(11)).astype(np.float64) / float(1 << 53) < settings.rows


def columns_of(tree: int, n: int, settings: Settings) -> list[int]:
    """The columns of a tree."""
    return sorted(np.random.default_rng([settings.seed, tree]).permutation(n)[: max(1, int(settings.columns * n))].tolist())


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, in fixed point."""
    if logistic:
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = (p - y) * w, np.maximum(p * (1.0 - p), 1e-16) * w
    else:
        g, h = (margin - y) * w, w
    return np.rint(g * UNIT), np.rint(h * UNIT)


def best_splits(g: np.ndarray, h: np.ndarray, settings: Settings) -> list[tuple]:
    """Of each node (rows: bins, the last for missing values): gain, bin, missing_left, and sums on the left; and all sums."""
    lam, n = settings.l2, len(g)
    total_g, total_h = g.sum(axis=1), h.sum(axis=1)
    cg, ch = np.cumsum(g[:, :-1], axis=1), np.cumsum(h[:, :-1], axis=1)
    gl, hl = np.stack([cg, cg + g[:, -1:]], axis=2), np.stack([ch, ch + h[:, -1:]], axis=2)  # missing right, missing left
    lg, lh, tg, th = gl / UNIT, hl / UNIT, (total_g / UNIT)[:, None, None], (total_h / UNIT)[:, None, None]
    rg, rh = tg - lg, th - lh
    fit = (lh >= settings.min_weight) & (rh >= settings.min_weight)
    gain = np.where(fit, lg**2 / (lh + lam) + rg**2 / (rh + lam) - tg**2 / (th + lam), -np.inf).reshape(n, -1)
    at, node = np.argmax(gain, axis=1), np.arange(n)  # the first bin, and missing to the right, on ties
    own = (gain[node, at], at // 2, at % 2 == 1, gl.reshape(n, -1)[node, at], hl.reshape(n, -1)[node, at], total_g, total_h)
    return list(zip(*(c.tolist() for c in own)))


_state: dict = {"run": None}


def _margin(run: str, model: int, block: int, rows: np.ndarray, codes: Codes, base: float, old, recent: list[Tree], n_old: int) -> np.ndarray:
    """Predictions so far for a block; ``old`` gives the trees before the recent ones."""
    if _state["run"] != run:
        _state.clear()
        _state["run"] = run
    n, margin = _state.get((model, block), (0, None))
    if margin is None:
        margin = np.full(rows.shape[1], base)
    todo = (old.value[model][n:n_old] if n < n_old else []) + recent[max(0, n - n_old) :]
    for tree in todo:
        margin = margin + tree.value[tree.coded(rows, codes)]
    _state[model, block] = n + len(todo), margin
    return margin


def pack(data: DataFrame, edges: list[np.ndarray], n: int, codes: Codes) -> DataFrame:
    """Blocks of binned rows: bins (as bytes), y, w, fold and key (a hash of the row), packed."""
    ship(data.sparkSession)
    rows = data.select(F.array(*[F.coalesce(f"x{i}", F.lit(float("nan"))) for i in range(n)]).alias("x"), "y", "w", "fold", F.xxhash64(*[f"x{i}" for i in range(n)], "y", "fold").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            held.append((codes.encode(binned(x, edges)).T, *(b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))))
            size += len(x)
            if size >= BLOCK_ROWS:
                yield _block(held)
                held, size = [], 0
        if size:
            yield _block(held)

    return rows.mapInArrow(run, "rows int, bins binary, y binary, w binary, fold binary, key binary")


def _block(held: list[tuple]) -> pa.RecordBatch:
    bins, y, w, fold, key = (np.concatenate(c) for c in zip(*held))
    parts = [np.ascontiguousarray(bins.T), y.astype(np.float64), w.astype(np.float64), fold.astype(np.int32), key.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["rows", "bins", "y", "w", "fold", "key"])


def train(prepared: DataFrame, features: dict[str, Column], y: Column, settings: Settings, weight: Column | None = None, fold: Column | None = None, held_out: list[int | None] = (None,)) -> list[Forest]:
    """A forest for each of ``held_out``: trained on all rows (None) or on those whose fold is another one.

    Rows without y take no part; no rows give a forest without trees.
    """
    names = list(features)
    rows = prepared.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(features.values())], y.cast("double").alias("y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), (F.lit(-1) if fold is None else F.coalesce(fold.cast("int"), F.lit(-1))).alias("fold"))
    data = cut(rows.where("y is not null"), "training-rows")
    edges = edges_of(data, names)
    rows_in, *have = data.agg(F.count(F.lit(1)), *[F.count(no_nan(F.col(f"x{i}"))) for i in range(len(names))]).first()
    codes = Codes.of(edges, have, rows_in)
    fewer = data.coalesce(max(1, -(-rows_in // BLOCK_ROWS)))  # small tables are few tasks: there are five jobs a tree
    stored = cut(pack(fewer, edges, len(names), codes), "training-blocks")
    context = stored.sparkSession.sparkContext
    n = len(names)

    def load(pair):
        r, block = pair
        take = lambda c, kind: np.frombuffer(r[c], dtype=kind)
        return block, take("bins", np.uint8).reshape(-1, r["rows"]), take("y", np.float64), take("w", np.float64), take("fold", np.int32), take("key", np.uint64)

    blocks = stored.rdd.zipWithUniqueId().map(load).persist(StorageLevel.MEMORY_AND_DISK)
    sums = blocks.flatMap(lambda b: [(m, _outside(b, k)) for m, k in enumerate(held_out)]).reduceByKey(lambda a, b: [a[0] + b[0], a[1] + b[1]], 1).collectAsMap()
    forests = [Forest(names, _base(sums.get(m), settings), settings.logistic) for m in range(len(held_out))]
    live = [m for m in range(len(held_out)) if sums.get(m) is not None and sums[m][0] > 0]
    if not live:
        return forests
    if rows_in <= ALONE_BLOCKS * BLOCK_ROWS:
        _alone(blocks, forests, live, held_out, codes, edges, settings)
        blocks.unpersist()
        return forests
    run, parts = uuid.uuid4().hex, max(1, min(-(-len(codes.cells) * len(live) // 4), blocks.getNumPartitions()))
    old, n_old = context.broadcast({m: [] for m in live}), 0
    bases = {m: forests[m].base for m in live}
    for t in range(settings.trees):
        if t - n_old >= RECENT:
            old.unpersist()
            old, n_old = context.broadcast({m: list(forests[m].trees) for m in live}), t
        recent = {m: forests[m].trees[n_old:] for m in live}
        columns = codes.asked(columns_of(t, n, settings))
        growing = {m: Tree.empty(settings.depth) for m in live}
        split = lambda kv: _splits(*kv, columns, codes, settings)  # noqa: B023, E731
        level = lambda ask: _level(run, t, settings, columns, codes, growing, ask, held_out, bases, old, recent, n_old)  # noqa: B023, E731
        _levels(growing, edges, settings, lambda ask: blocks.mapPartitions(level(ask)).reduceByKey(np.add, parts).flatMap(split).collect())  # noqa: B023
        for m in live:
            forests[m].trees.append(growing[m])
    old.unpersist()
    blocks.unpersist()
    return forests


def _levels(growing: dict[int, Tree], edges: list[np.ndarray], settings: Settings, splits) -> None:
    """Grow a tree of each model, level by level; splits(nodes asked by model) gives those of each (model, feature)."""
    open_ = {m: [0] for m in growing}
    for _ in range(settings.depth):
        ask = {m: nodes for m, nodes in open_.items() if nodes}
        if not ask:
            return
        found = splits(ask)
        open_ = {m: _grow(growing[m], nodes, {f: s for (k, f), s in found if k == m}, edges, settings) for m, nodes in ask.items()}


def _splits(key: tuple[int, int], both: np.ndarray, columns: list[int], codes: Codes, settings: Settings) -> list[tuple]:
    """Of the sums of a byte: ((model, feature), best splits) for each of its columns."""
    m, byte = key
    return [((m, f), best_splits(*codes.sums(f, both), settings)) for f in columns if codes.place[f][0] == byte]


def _alone(blocks, forests: list[Forest], live: list[int], held_out, codes: Codes, edges: list[np.ndarray], settings: Settings) -> None:
    """Grow all trees with a task for each model; blocks and predictions so far go on from job to job."""
    pairs = blocks.flatMap(lambda b: [(m, b) for m in live])
    pairs = pairs.partitionBy(len(live), live.index) if len(live) > 1 else pairs.coalesce(1)
    n, bases = len(forests[0].features), {m: forests[m].base for m in live}

    def start(own: Iterator[tuple]) -> Iterator[tuple]:
        found: dict[int, list[tuple]] = {}
        for m, block in own:
            found.setdefault(m, []).append(block)
        return ((m, [(b, np.full(len(b[2]), bases[m])) for b in mine], []) for m, mine in found.items())

    def more(first: int, last: int):
        def run(own: Iterator[tuple]) -> Iterator[tuple]:
            for m, mine, _ in own:
                made = []
                for t in range(first, last):
                    columns, tree = codes.asked(columns_of(t, n, settings)), Tree.empty(settings.depth)
                    rows = [_Rows(b, held_out[m], drawn(b[5], t, settings), margin, settings) for b, margin in mine]
                    bytes_, before = sorted({codes.place[f][0] for f in columns}), {}

                    def splits(ask: dict[int, list[int]]) -> list[tuple]:
                        sums = _halved(rows, tree, ask[m], bytes_, codes, before)  # noqa: B023
                        return [s for byte, both in zip(bytes_, sums) for s in _splits((m, byte), both, columns, codes, settings)]  # noqa: B023

                    _levels({m: tree}, edges, settings, splits)
                    mine = [(b, margin + tree.value[r.ends(tree, b[1], codes)]) for r, (b, margin) in zip(rows, mine)]
                    made.append(tree)
                yield m, mine, made

        return run

    state, before = pairs.mapPartitions(start), None
    for first in range(0, settings.trees, ALONE_TREES):
        state = state.mapPartitions(more(first, min(first + ALONE_TREES, settings.trees))).persist(StorageLevel.MEMORY_AND_DISK)
        for m, made in state.map(lambda s: (s[0], s[2])).collect():
            forests[m].trees += made
        if before is not None:
            before.unpersist()
        before = state
    if before is not None:
        before.unpersist()


def _halved(rows: list["_Rows"], tree: Tree, nodes: list[int], bytes_: list[int], codes: Codes, before: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of all blocks by node and value, for each byte. Of two children the one of fewer rows is summed; the other has the rest of what their
    parent has. ``before`` holds the parents' sums (node -> byte -> sums) and gets those of ``nodes``; sums are exact, and so are differences."""
    often = sum(r.move(tree, codes) for r in rows)
    parent = lambda node: (node - 1) // 2
    beside = lambda node: node + 1 if node % 2 else node - 1
    less = {node for node in nodes if parent(node) not in before or (often[node], node) < (often[beside(node)], beside(node))}
    some = [node for node in nodes if node in less]
    found = [sum(each) for each in zip(*(r.sums(some, bytes_, codes) for r in rows))]
    own = {node: [both[:, i] for both in found] for i, node in enumerate(some)}
    for node in nodes:
        if node not in less:
            own[node] = [whole - part for whole, part in zip(before[parent(node)], own[beside(node)])]
    before.clear()
    before.update(own)
    return [np.stack([own[node][k] for node in nodes], axis=1) for k in range(len(bytes_))]


class _Rows:
    """The rows of a block that a tree of a model draws: bytes, gradients, and the node that each has come to."""

    def __init__(self, block: tuple, out: int | None, drawn: np.ndarray, margin: np.ndarray, settings: Settings):
        _, codes, y, w, fold, _ = block
        self.own = own = np.flatnonzero(drawn if out is None else drawn & (fold != out))
        self.codes, self.node = codes.take(own, axis=1), np.zeros(len(own), np.intp)
        self.g, self.h = gradients(margin[own], y[own], w[own], settings.logistic)
        self.alike = len(own) > 0 and bool((self.h == self.h[0]).all())  # then counts tell their sums

    def move(self, tree: Tree, codes: Codes) -> np.ndarray:
        """Rows go on to the nodes that the tree has by now; how many are in each."""
        self.node = tree.coded(self.codes, codes, self.node)
        return np.bincount(self.node, minlength=len(tree.feature))

    def ends(self, tree: Tree, rows: np.ndarray, codes: Codes) -> np.ndarray:
        """The node that each row of the block ends in, drawn or not."""
        self.move(tree, codes)
        node = np.empty(rows.shape[1], np.intp)
        rest = np.ones(len(node), bool)
        rest[self.own] = False
        rest = np.flatnonzero(rest)
        node[self.own] = self.node
        node[rest] = tree.coded(rows.take(rest, axis=1), codes)
        return node

    def sums(self, nodes: list[int], bytes_: list[int], codes: Codes) -> list[np.ndarray]:
        """Sums of gradients by node and value, for each byte."""
        place = np.full(max(int(self.node.max(initial=0)), max(nodes)) + 1, -1)
        place[nodes] = np.arange(len(nodes)) * 256
        at = place.take(self.node)
        some = np.flatnonzero(at >= 0)
        every = len(some) == len(at)  # no row has stopped yet
        at, g, h = (at, self.g, self.h) if every else (at.take(some), self.g.take(some), self.h if self.alike else self.h.take(some))
        out, size = [], len(nodes) * 256
        for byte in bytes_:
            cell = at + (self.codes[byte] if every else self.codes[byte].take(some))
            both = np.empty((2, size), np.int64)
            both[0] = np.bincount(cell, g, size)
            both[1] = np.bincount(cell, minlength=size) * int(self.h[0]) if self.alike else np.bincount(cell, h, size)
            out.append(both.reshape(2, len(nodes), 256)[:, :, : codes.cells[byte]])
        return out


def _outside(block: tuple, k: int | None) -> list[int]:
    _, _, y, w, fold, _ = block
    own = slice(None) if k is None else fold != k
    return [int(np.rint(v * 2.0**32).astype(np.int64).sum()) for v in (w[own], w[own] * y[own])]  # exact, so in any order


def _base(sums: list[int] | None, settings: Settings) -> float:
    if sums is None or not sums[0]:
        return 0.0
    mean = sums[1] / sums[0]
    return math.log(max(mean, 1e-6) / max(1 - mean, 1e-6)) if settings.logistic else mean


def _level(run: str, t: int, settings: Settings, columns: list[int], codes: Codes, growing: dict[int, Tree], ask: dict[int, list[int]], held_out, bases: dict[int, float], old, recent: dict[int, list[Tree]], n_old: int):
    """Of the blocks of a task: ((model, byte), sums of gradients by node and value)."""
    bytes_ = sorted({codes.place[f][0] for f in columns})

    def count(blocks: Iterator[tuple]) -> Iterator[tuple]:
        total: dict = {}
        for block in blocks:
            rows = drawn(block[5], t, settings)
            for m, nodes in ask.items():
                margin = _margin(run, m, block[0], block[1], codes, bases[m], old, recent[m], n_old)
                own = _Rows(block, held_out[m], rows, margin, settings)
                own.move(growing[m], codes)
                for byte, both in zip(bytes_, own.sums(nodes, bytes_, codes)):
                    total[m, byte] = total[m, byte] + both if (m, byte) in total else both
        yield from total.items()

    return count


def _grow(tree: Tree, nodes: list[int], found: dict[int, list[tuple]], edges: list[np.ndarray], settings: Settings) -> list[int]:
    """Split the nodes that gain by it; the next nodes to ask. Values are set on the way down, so a node that stays is a leaf."""
    more = []
    value = lambda g, h: -settings.step * (g / UNIT) / (h / UNIT + settings.l2)
    for i, node in enumerate(nodes):
        splits = [(s[i], f) for f, s in sorted(found.items())]
        if not splits:
            continue
        (gain, b, left, gl, hl, g, h), f = max(splits, key=lambda x: x[0][0])  # the first feature on ties
        tree.value[node] = value(g, h)
        if not gain > LEAST_GAIN:
            continue
        tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = f, b, left, gain
        tree.threshold[node] = edges[f][b] if b < len(edges[f]) else np.inf  # beyond the last one: values from missing values
        for child, cg, ch in ((2 * node + 1, gl, hl), (2 * node + 2, g - gl, h - hl)):
            tree.value[child] = value(cg, ch)
            more.append(child)
    return more


def predict(df: DataFrame, forests: list[Forest], features: dict[str, Column], out: str, which: Column | None = None) -> DataFrame:
    """Add the margin of every row, by the forest that ``which`` names (default: the only one); null where it names none."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(forests)

    @F.pandas_udf("double")
    def margin(which: pd.Series, *columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        own, made = which.to_numpy(), np.full(len(x), np.nan)
        for k in np.unique(own[(own >= 0) & (own < len(held.value))]):
            made[own == k] = held.value[k].margin(x[own == k])
        return pd.Series(made)

    name = F.lit(0) if which is None else F.coalesce(which.cast("int"), F.lit(-1))
    return df.withColumn(out, no_nan(margin(name, *[c.cast("double") for c in features.values()])))
