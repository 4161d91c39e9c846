"""Boosted trees by histograms: all models and all folds of a training run in one job.

Features are binned once.  Spark then sums the rows into cells, one for each (model, fold, bins of
all features): trees over bins cannot tell rows of one cell apart, so the sums stand for every row.  The
cells of a model go, once per fold left out and once for the model itself, to tasks that grow the
trees round by round from gradient sums per (node, feature, bin), a block of cells at a time.  A task holds
all cells of its model, some 60 bytes each, and the grid of bins is the same however many there are.

Targets are summed in millionths and weights as counts per label, so that cells, and with them the
trees, are equal under any partitioning.  A trained tree is a row: (model, held, round) with the feature,
threshold, cover and leaf arrays of a complete binary tree.  ``held`` is the fold left out, -1 for none.

A missing feature value (null or NaN) goes left at every split.  Rows without a target take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import factorial, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.scratch import materialise

#: Steps of the first, even grid from which quantile edges are read.
FINE = 4096
MICRO = 1e6
ALL = -1

TREES = "model string, held int, round int, feature array<int>, threshold array<double>, cover array<double>, leaf array<double>, base double"


@dataclass(frozen=True)
class BoostParams:
    """Boosting settings; tests and quick runs lower ``rounds``."""

    rounds: int = 300
    rate: float = 0.05
    depth: int = 6
    seed: int = 42
    folds: int = 5
    bins: int = 64
    shrink: float = 1.0
    least_weight: float = 1.0
    max_cells: int = 1 << 18


def feature_matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Feature columns as doubles, NaN where missing."""
    if not len(names):
        return np.zeros((batch.num_rows, 0))
    columns = [batch.column(batch.schema.get_field_index(n)).cast(pa.float64()) for n in names]
    return np.stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in columns], 1)


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Lower edges of the second and later bins of each feature: quantiles of an even grid over its range.

    Two aggregations; at most ``FINE`` counts per feature reach the driver.
    """
    value = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    ends = rows.agg(*[g(value[f]).alias(f"{f}_{n}") for f in features for n, g in (("low", F.min), ("high", F.max))]).first()
    ranges = [(ends[f"{f}_low"], ends[f"{f}_high"]) for f in features]
    fine = [
        F.when(value[f].isNotNull(), F.struct(F.lit(i).alias("i"), F.least(F.floor((value[f] - lo) / (hi - lo) * FINE), F.lit(FINE - 1)).cast("int").alias("at")))
        for i, (f, (lo, hi)) in enumerate(zip(features, ranges, strict=True)) if lo is not None and hi > lo
    ]
    edges = [np.zeros(0) for _ in features]
    if not fine:
        return edges
    counts = rows.select(F.explode(F.array_compact(F.array(*fine))).alias("x")).groupBy("x.i", "x.at").agg(F.count("*").alias("n")).toPandas()
    for i, part in counts.groupby("i"):
        part = part.sort_values("at")
        upto = part["n"].cumsum().to_numpy()
        at = part["at"].to_numpy()
        wanted = upto[-1] * np.arange(1, bins) / bins
        first = np.unique(np.searchsorted(upto, wanted, "left"))
        lo, hi = ranges[int(i)]
        starts = np.unique(at[np.minimum(first + 1, len(at) - 1)])
        if len(at) <= bins:
            starts = at[1:]
        edges[int(i)] = lo + (hi - lo) * starts / FINE
    return edges


def _binned(rows: DataFrame, features: Sequence[str], edges: list[np.ndarray], rest: Sequence[str]) -> DataFrame:
    names = [f"b{i}" for i in range(len(features))]
    schema = ", ".join([*[f"{n} smallint" for n in names], *[f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*rest).schema]])

    def place(batches):
        for batch in batches:
            x = feature_matrix(batch, features)
            # A missing value is below every edge.
            bins = [np.where(np.isnan(x[:, i]), 0, np.searchsorted(edges[i], x[:, i], "right")).astype(np.int16) for i in range(len(features))]
            others = [batch.column(batch.schema.get_field_index(r)) for r in rest]
            yield pa.RecordBatch.from_arrays([*map(pa.array, bins), *others], [*names, *rest])

    return rows.select(*features, *rest).mapInArrow(place, schema)


def cells(rows: DataFrame, features: Sequence[str], params: BoostParams, whole: bool = False) -> tuple[DataFrame, list[np.ndarray]]:
    """Sums of (model, fold, target, weight_) rows by model, fold and bins, and the bins' edges.

    ``weight`` counts rows, ``target`` sums the target (in millionths) or the positive rows.  ``whole`` keeps
    all bins, as training does; else neighbouring bins are merged until no model has over ``max_cells`` cells.
    """
    edges = bin_edges(rows, features, params.bins)
    names = [f"b{i}" for i in range(len(features))]
    while True:
        summed = materialise(
            _binned(rows, features, edges, ["model", "fold", "target"]).groupBy("model", "fold", *names).agg(
                F.count("*").alias("weight"), F.sum(F.round(F.col("target") * MICRO).cast("bigint")).alias("target")
            ), "cells",
        )
        if whole:
            return summed, edges
        most = summed.groupBy("model").count().agg(F.max("count")).first()[0] or 0
        if most <= params.max_cells or all(len(e) < 2 for e in edges):
            return summed, edges
        edges = [e[1::2] for e in edges]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


#: Cells summed at once, and the most combinations of bins that features summed together have.
BLOCK_CELLS, JOINT_BINS = 1 << 18, 1 << 12


def _joint(sizes: Sequence[int], n: int) -> list[list[int]]:
    """Features in groups, each summed once by the combinations of its bins.

    Up to one block of cells each feature is summed by itself: it takes little time, and equal gains, which
    rounding decides, stay decided as they are.
    """
    most, groups = JOINT_BINS if n > BLOCK_CELLS else 0, []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        for group in groups:
            if prod(sizes[g] for g in group) * sizes[f] <= most:
                group.append(f)
                break
        else:
            groups.append([f])
    return groups


def grow(bins: np.ndarray, weight: np.ndarray, target: np.ndarray, width: int, params: BoostParams, heavy: float | None = None):
    """Trees of one model from its cells: (base, [(feature, first right bin, cover, leaf), ...]).

    With ``heavy`` the target is the number of positive rows, each of that weight, and the loss is
    logistic; without, it is squared.
    """
    n, count = bins.shape
    if heavy is None:
        base = float(target.sum() / weight.sum())
        total = weight
    else:
        positive = target * heavy
        total = positive + (weight - target)
        share = min(max(float(positive.sum() / total.sum()), 1e-6), 1 - 1e-6)
        base = float(np.log(share / (1 - share)))
    value = np.full(n, base)
    size = [int(bins[:, f].max()) + 1 for f in range(count)]
    joint = []
    for group in _joint(size, n):
        shape = [size[f] for f in group]
        at = bins[:, group[0]].astype(np.int32)
        for f in group[1:]:
            at = at * size[f] + bins[:, f]
        joint.append((group, shape, prod(shape), at.astype(np.min_scalar_type(prod(shape)))))
    flat = np.ascontiguousarray(bins).ravel()
    blocks = [slice(a, min(a + BLOCK_CELLS, n)) for a in range(0, n, BLOCK_CELLS)]
    row_at = np.arange(min(n, BLOCK_CELLS)) * count
    inner = (1 << params.depth) - 1
    trees = []
    for _ in range(params.rounds):
        if heavy is None:
            grad, hess = target - weight * value, total
        else:
            p = _logistic(value)
            grad, hess = positive - total * p, total * p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        cover = np.zeros(2 * inner + 1)
        node = np.zeros(n, np.int32)
        for depth in range(params.depth):
            nodes = 1 << depth
            sums = [np.zeros((nodes, count, width)) for _ in range(2)]
            for group, shape, most, column in joint:
                held = [0.0, 0.0]
                for block in blocks:
                    key = node[block].astype(np.int64) * most + column[block]
                    held = [h + np.bincount(key, x[block], nodes * most) for h, x in zip(held, (grad, hess), strict=True)]
                for out, h in zip(sums, held, strict=True):
                    cube = h.reshape(nodes, *shape)
                    for k, f in enumerate(group):
                        out[:, f, : size[f]] = cube.sum(tuple(a + 1 for a in range(len(group)) if a != k))
            left_g, left_h = (np.cumsum(x, 2)[:, :, :-1] for x in sums)
            all_g, all_h = (x[:, 0, :].sum(1)[:, None, None] for x in sums)
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + params.shrink) + right_g**2 / (right_h + params.shrink) - all_g**2 / (all_h + params.shrink)
            gain = np.where((left_h >= params.least_weight) & (right_h >= params.least_weight), gain, -np.inf).reshape(nodes, -1)
            best = gain.argmax(1)
            good = gain[np.arange(nodes), best] > 1e-9
            here = nodes - 1 + np.flatnonzero(good)
            feature[here] = best[good] // (width - 1)
            cut[here] = best[good] % (width - 1) + 1
            cover[nodes - 1 : 2 * nodes - 1] = all_h[:, 0, 0]
            for block in blocks:
                at = node[block] + (nodes - 1)
                own = flat[block.start * count : block.stop * count][row_at[: len(at)] + feature[at]]
                node[block] = 2 * node[block] + (own >= cut[at])
        leaf_g, leaf_h = (np.bincount(node, x, inner + 1) for x in (grad, hess))
        cover[inner:] = leaf_h
        leaf = params.rate * leaf_g / (leaf_h + params.shrink)
        value += leaf[node]
        trees.append((feature, cut, cover, leaf))
    return base, trees


def fit(rows: DataFrame, features: Sequence[str], params: BoostParams, heavy: bool = False) -> DataFrame:
    """Trees of every model, and of every model without each of its folds.

    ``rows`` has model, fold (null or -1: in no fold), target and the features.  With ``heavy`` the
    target is 0 or 1, and a positive row weighs as much as (1 - p) / p others, p being the model's
    share of positive rows.
    """
    features = list(features)
    good = rows.where(F.col("model").isNotNull() & F.col("target").isNotNull() & ~F.isnan("target"))
    summed, edges = cells(good.select("model", F.coalesce("fold", F.lit(ALL)).cast("int").alias("fold"), "target", *features), features, params, whole=True)
    names = [f"b{i}" for i in range(len(features))]
    facts = summed.groupBy("model").agg(
        F.count("*").alias("cells"), F.collect_set(F.when(F.col("fold") >= 0, F.col("fold"))).alias("folds"),
        (F.sum("target") / F.sum("weight") / MICRO).alias("share"),
    ).collect()
    # The model itself and one without each of its folds; a task grows one of them, the largest first.
    grown = [(r["model"], h, r["share"]) for r in sorted(facts, key=lambda r: (-r["cells"], r["model"])) for h in [ALL, *(sorted(r["folds"]) if len(r["folds"]) > 1 else [])]]
    grown.sort(key=lambda g: g[1] != ALL)
    if not grown:
        return materialise(summed.sparkSession.createDataFrame([], TREES), "trees")
    wanted = summed.sparkSession.createDataFrame([(k, m, h) for k, (m, h, _) in enumerate(grown)], "at int, model string, held int")
    parts = summed.join(F.broadcast(wanted), "model").where(f"held = {ALL} or fold <> held")
    width = max((len(e) for e in edges), default=0) + 2
    small = np.min_scalar_type(width)

    def train(batches):
        kept: dict = {}
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            of = column("at")
            held = [np.stack([column(n) for n in names], 1).astype(small), column("fold"), column("weight").astype(np.float64), column("target") / MICRO]
            for k in np.unique(of).tolist():
                kept.setdefault(k, []).append([x[of == k] for x in held])
        for k in sorted(kept):
            bins, fold, weight, target = (np.concatenate(x) for x in zip(*kept.pop(k), strict=True))
            order = np.lexsort([*bins.T[::-1], fold])
            bins, weight, target = bins[order], weight[order], target[order]
            del order, fold
            model, held, p = grown[k]
            factor = ((1 - p) / p if p > 0 else 1.0) if heavy else None
            base, trees = grow(bins, weight, target, width, params, factor)
            # A cut beyond the last edge sends every row left.
            reach = [np.concatenate([[-np.inf], e, np.full(width + 1 - len(e), np.inf)]) for e in edges]
            yield pa.RecordBatch.from_pydict({
                "model": pa.array([model] * len(trees), pa.string()), "held": pa.array([held] * len(trees), pa.int32()),
                "round": pa.array(range(len(trees)), pa.int32()),
                "feature": pa.array([t[0].tolist() for t in trees], pa.list_(pa.int32())),
                "threshold": pa.array([[float(reach[f][c]) for f, c in zip(t[0], t[1], strict=True)] for t in trees], pa.list_(pa.float64())),
                "cover": pa.array([t[2].tolist() for t in trees], pa.list_(pa.float64())),
                "leaf": pa.array([t[3].tolist() for t in trees], pa.list_(pa.float64())),
                "base": pa.array([base] * len(trees), pa.float64()),
            })

    dealt = parts.repartitionById(len(grown), "at").select("at", "fold", "weight", "target", *names)
    return materialise(dealt.mapInArrow(train, TREES), "trees")


#: Rows scored at once, and the bytes of their batches; features with more patterns than this are explained row by row.
SCORE_ROWS, SCORE_BYTES, PATTERN_FEATURES = 1 << 17, 1 << 26, 8


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches to be scored at once: rows of equal bins are then scored once; the bounds bound the memory."""
    some, rows, size = [], 0, 0
    for batch in batches:
        some.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= SCORE_ROWS or size >= SCORE_BYTES:
            yield some
            some, rows, size = [], 0, 0
    if some:
        yield some


def name_codes(names: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """Distinct names and which of them each row has, -1 for none."""
    coded = pa.concat_arrays(names.chunks).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)


_DEBRUIJN = np.uint64(0x03F79D71B4CB0A89)


def _leaf_slots() -> np.ndarray:
    """The bit that stands at each product of a power of two with the de Bruijn number."""
    out = np.zeros(64, np.int64)
    out[((np.uint64(1) << np.arange(64, dtype=np.uint64)) * _DEBRUIJN >> np.uint64(58)).astype(np.int64)] = np.arange(64)
    return out


_SLOTS = _leaf_slots()


class LeafTables:
    """Leaves a row can reach, by feature and bin: trees of at most 64 leaves without walking them.

    A row's bin of a feature is the number of the model's thresholds it is not below, so rows of
    equal bins go the same way at every split.  ``reach[t, f, b]`` has a bit for every leaf of tree ``t``
    whose splits on feature ``f`` all send bin ``b`` its way; one bit is left by all features.
    """

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, count: int):
        trees, inner = feature.shape
        self.edges = [np.unique(threshold[feature == f]) for f in range(count)]
        width = max(len(e) for e in self.edges) + 1
        self.reach = np.full((trees, count, width), np.uint64(2 ** (inner + 1) - 1), np.uint64)
        rank = np.zeros(feature.shape, np.int64)
        for f, e in enumerate(self.edges):
            rank[feature == f] = np.searchsorted(e, threshold[feature == f])
        bins, tree = np.arange(width), np.arange(trees)
        for node in range(inner):
            depth = (node + 1).bit_length() - 1
            leaves = (inner + 1) >> depth  # below this node
            first = (node + 1 - (1 << depth)) * leaves
            left, right = (sum(1 << k for k in range(a, a + leaves // 2)) for a in (first, first + leaves // 2))
            both = 2**64 - 1
            self.reach[tree, feature[:, node]] &= np.where(bins > rank[:, node, None], np.uint64(both - left), np.uint64(both - right))
        self.leaf = leaf[:, _SLOTS % (inner + 1)]  # by the slot of the bit

    def bins(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray | slice]:
        """Bins of the distinct rows by feature, and which of them each row is.  A missing value is below every edge."""
        out = [np.where(np.isnan(x[:, f]), 0, np.searchsorted(e, x[:, f], "right")) for f, e in enumerate(self.edges)]
        key, most = np.zeros(len(x), np.int64), 1
        for b, e in zip(out, self.edges, strict=True):
            key, most = key * (len(e) + 1) + b, most * (len(e) + 1)
        if most >= 1 << 62:
            return out, slice(None)
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        return [b[first] for b in out], of

    def reached(self, t: int, bins: list[np.ndarray]) -> np.ndarray:
        out = self.reach[t, 0].take(bins[0])
        for f in range(1, len(bins)):
            if len(self.edges[f]):
                out &= self.reach[t, f].take(bins[f])
        return out


@dataclass(frozen=True)
class Forest:
    """Trees of one or more models, ready to score; the arrays are bounded by rounds, depth and number of models."""

    features: tuple[str, ...]
    models: dict = field(repr=False)
    tables: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"features": self.features, "models": self.models, "tables": {}}

    @classmethod
    def of(cls, trees: DataFrame, features: Sequence[str]) -> Forest:
        held = trees.toArrow().sort_by([("model", "ascending"), ("held", "ascending"), ("round", "ascending")]).to_pylist()
        groups: dict = {}
        for row in held:
            groups.setdefault((row["model"], row["held"]), []).append(row)
        stack = lambda rows, k: np.array([r[k] for r in rows])
        models = {k: (r[0]["base"], stack(r, "feature"), stack(r, "threshold"), stack(r, "cover"), stack(r, "leaf")) for k, r in groups.items()}
        return cls(tuple(features), models)

    def names(self) -> list[str]:
        return sorted({m for m, held in self.models if held == ALL})

    def predict(self, x: np.ndarray, model: str, held: int = ALL) -> np.ndarray:
        """Sum of the trees for rows of feature values; a missing value goes left."""
        base, feature, threshold, _, leaf = self.models[model, held]
        inner = feature.shape[1] if feature.ndim == 2 else 0
        if 0 < inner < 64 and len(x):
            table = self._table(model, held)
            bins, of = table.bins(x)
            out = np.full(len(bins[0]), base)
            for k in range(len(feature)):
                out += table.leaf[k].take((table.reached(k, bins) * _DEBRUIJN >> np.uint64(58)).view(np.int64))
            return out[of]
        out = np.full(len(x), base)
        rows = np.arange(len(x))
        for k in range(len(feature)):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[k][node]] >= threshold[k][node])
            out += leaf[k][node - inner]
        return out

    def _table(self, model: str, held: int) -> LeafTables:
        """Made on first use, so a task makes those of its own models only."""
        if (model, held) not in self.tables:
            _, feature, threshold, _, leaf = self.models[model, held]
            self.tables[model, held] = LeafTables(feature, threshold, leaf, len(self.features))
        return self.tables[model, held]

    def contributions(self, x: np.ndarray, model: str, held: int = ALL) -> tuple[float, np.ndarray]:
        """The mean prediction by covers, and Shapley values of every feature for every row.

        A leaf counts for a feature set by the part of its path that the set decides (the row goes
        there or not) times the covers' shares along the rest.  Its Shapley values follow from
        the symmetric sums of those two numbers over the other features.
        """
        base, feature, threshold, cover, leaf = self.models[model, held]
        n, count = x.shape
        inner = feature.shape[1]
        depth = inner.bit_length()
        weight = [factorial(k) * factorial(count - 1 - k) / factorial(count) for k in range(count)]
        if 0 < inner < 64 and n and count <= PATTERN_FEATURES:
            return self._by_patterns(x, model, held, weight)
        if n > 64:  # bounds the memory
            parts = [self.contributions(x[k : k + 64], model, held) for k in range(0, n, 64)]
            return parts[0][0], np.concatenate([p for _, p in parts])
        out, mean = np.zeros((n, count)), base
        right = x[:, feature] >= threshold[None] if inner else None
        for t in range(len(feature)):
            share = np.ones((inner + 1, count))
            inside = np.ones((n, inner + 1, count), bool)
            for leaf_at in range(inner + 1):
                node = 0
                for d in range(depth - 1, -1, -1):
                    turn = leaf_at >> d & 1
                    child = 2 * node + 1 + turn
                    f = feature[t, node]
                    share[leaf_at, f] *= cover[t, child] / cover[t, node] if cover[t, node] > 0 else 1 - turn
                    inside[:, leaf_at, f] &= right[:, t, node] == turn
                    node = child
            used = np.flatnonzero((leaf[t] != 0) & (share > 0).all(1))
            share, inside, value = share[used], inside[:, used].astype(np.float64), leaf[t][used]
            mean += float((share.prod(1) * value).sum())
            for i in range(count):
                sums = np.zeros((count, n, len(used)))
                sums[0] = 1
                for j in range(count):
                    if j != i:
                        sums[1:] = sums[1:] * share[:, j] + sums[:-1] * inside[:, :, j]
                        sums[0] = sums[0] * share[:, j]
                out[:, i] += ((inside[:, :, i] - share[:, i]) * np.tensordot(weight, sums, 1) * value).sum(1)
        return float(mean), out

    def _by_patterns(self, x: np.ndarray, model: str, held: int, weight: list[float]) -> tuple[float, np.ndarray]:
        """As ``contributions``, with a leaf's values taken once for each pattern of deciding features and looked up by row."""
        base, feature, _, cover, leaf = self.models[model, held]
        table, count, inner = self._table(model, held), x.shape[1], feature.shape[1]
        bins, of = table.bins(x)
        n, leaves, depth = len(bins[0]), inner + 1, inner.bit_length()
        inside = (np.arange(1 << count)[:, None] >> np.arange(count) & 1).astype(np.float64)[:, None]  # pattern, leaf, feature
        out, mean = np.zeros((n, count)), base
        at = np.arange(leaves)
        for t in range(len(feature)):
            share = np.ones((leaves, count))
            node = np.zeros(leaves, np.int64)
            for d in range(depth - 1, -1, -1):
                turn = at >> d & 1
                child = 2 * node + 1 + turn
                whole = cover[t, node]
                share[at, feature[t, node]] *= np.where(whole > 0, cover[t, child] / np.where(whole > 0, whole, 1), 1 - turn)
                node = child
            used = np.flatnonzero((leaf[t] != 0) & (share > 0).all(1))
            value, part = leaf[t][used], share[used]
            mean += float((part.prod(1) * value).sum())
            worth = np.zeros((len(used), 1 << count, count))
            for i in range(count):
                sums = np.zeros((count, 1 << count, len(used)))
                sums[0] = 1
                for j in range(count):
                    if j != i:
                        sums[1:] = sums[1:] * part[:, j] + sums[:-1] * inside[:, :, j]
                        sums[0] = sums[0] * part[:, j]
                worth[:, :, i] = ((inside[:, :, i] - part[:, i]) * np.tensordot(weight, sums, 1) * value).T
            ways = [table.reach[t, f].take(bins[f]) for f in range(count)]
            for k, bit in enumerate(used.tolist()):
                pattern = np.zeros(n, np.int64)
                for f, way in enumerate(ways):
                    pattern |= (way >> np.uint64(bit) & np.uint64(1)).view(np.int64) << f
                out += worth[k].take(pattern, 0)
        return float(mean), out[of]

    def _apply(self, df: DataFrame, route: str | None, held: str | None, default: float, link) -> DataFrame:
        models = df.sparkSession.sparkContext.broadcast(self)
        features, columns = self.features, df.columns
        schema = df.select("*", F.lit(0.0).alias("prediction")).schema

        def scored(forest, held_batches):
            x = np.concatenate([feature_matrix(b, features) for b in held_batches])
            get = lambda c: pa.chunked_array([b.column(b.schema.get_field_index(c)) for b in held_batches])
            names, of = name_codes(get(route)) if route else (forest.names()[:1], np.zeros(len(x), np.int32))
            folds = get(held).fill_null(ALL).to_numpy() if held else np.full(len(x), ALL)
            out = np.full(len(x), float(default))
            for fold in np.unique(folds).tolist():
                for k, model in enumerate(names):
                    at = np.flatnonzero((of == k) & (folds == fold)) if (model, fold) in forest.models else ()
                    if len(at):
                        out[at] = link(forest.predict(x[at], model, fold))
            upto = 0
            for batch in held_batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[upto : upto + batch.num_rows])], [*columns, "prediction"])
                upto += batch.num_rows

        def score(batches):
            forest = models.value
            for some in together(batches):
                yield from scored(forest, some)

        return df.mapInArrow(score, schema)

    def score(self, df: DataFrame, route: str | None = None, held: str | None = None, default: float = 0.0) -> DataFrame:
        """Adds ``prediction``: by the model named in ``route`` (default: the only one) and without the fold in ``held``."""
        return self._apply(df, route, held, default, lambda v: v)

    def probability(self, df: DataFrame, route: str | None = None, held: str | None = None) -> DataFrame:
        """As ``score``, with the chance of a positive row."""
        return self._apply(df, route, held, 0.0, _logistic)
