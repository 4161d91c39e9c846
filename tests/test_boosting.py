"""Histogram boosting against plain per-row versions, and Shapley values against enumeration."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.ml import boosting, explain
from paddock.ml.boosting import BoostParams, Forest
from paddock.operators.encode import model_folds

NAMES = ["a", "b", "c"]
PARAMS = BoostParams(rounds=6, rate=0.3, depth=3, bins=16)
SCHEMA = "model string, fold int, target double, a double, b double, c double"


def sample(seed=0, n=360):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 30, n), rng.normal(size=n), rng.integers(0, 3, n)]).astype(float)
    y = np.round(x[:, 0] * 0.1 + np.sin(3 * x[:, 1]) + (x[:, 2] == 1) * x[:, 1] + rng.normal(size=n) * 0.1, 6)
    return x, y


def frame(spark, x, y, models=2, folds=3):
    rows = [(str(i % models), i % folds, None if t is None else float(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def plain(x, edges, params, gradients, base):
    """Boosting row by row: every split tried on every edge, sums taken afresh."""
    value, trees = np.full(len(x), base), []

    def build(idx, g, h, depth):
        leaf = params.rate * g[idx].sum() / (h[idx].sum() + 1) if len(idx) else 0.0
        if depth == params.depth:
            return leaf
        score = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1)
        best, found = 1e-9, None
        for j, cuts in enumerate(edges):
            for e in cuts:
                left, right = idx[x[idx, j] < e], idx[x[idx, j] >= e]
                if h[left].sum() >= 1 and h[right].sum() >= 1 and (gain := score(left) + score(right) - score(idx)) > best + 1e-9:
                    best, found = gain, (j, e, left, right)
        if found is None:
            return leaf
        j, e, left, right = found
        return j, e, build(left, g, h, depth + 1), build(right, g, h, depth + 1)

    def go(tree, row):
        while isinstance(tree, tuple):
            tree = tree[3] if row[tree[0]] >= tree[1] else tree[2]
        return tree

    for _ in range(params.rounds):
        trees.append(build(np.arange(len(x)), *gradients(value), 0))
        value = value + np.array([go(trees[-1], row) for row in x])
    return lambda rows: base + np.array([sum(go(t, row) for t in trees) for row in rows])


def test_equals_a_plain_version(spark):
    x, y = sample()
    df = frame(spark, x, y)
    forest = Forest.of(boosting.fit(df, NAMES, PARAMS), NAMES)
    edges = boosting.bin_edges(df, NAMES, PARAMS.bins)
    assert set(forest.models) == {(m, f) for m in "01" for f in (-1, 0, 1, 2)}
    at = np.arange(len(x))
    for model, fold in forest.models:
        used = (at % 2 == int(model)) & (at % 3 != fold)
        yy = y[used]
        want = plain(x[used], edges, PARAMS, lambda v, yy=yy: (yy - v, np.ones(len(yy))), yy.mean())(x[at % 2 == int(model)])
        assert np.allclose(forest.predict(x[at % 2 == int(model)], model, fold), want, atol=1e-9)


def test_classifier_equals_a_plain_version(spark):
    x, y = sample(1, 300)
    hit = (y > np.quantile(y, 0.8)).astype(float)
    df = frame(spark, x, hit, models=1)
    forest = Forest.of(boosting.fit(df, NAMES, PARAMS, heavy=True), NAMES)
    p = hit.mean()
    for fold in (-1, 1):
        used = np.arange(len(x)) % 3 != fold
        w = np.where(hit[used] > 0, (1 - p) / p, 1.0)
        share = (w * hit[used]).sum() / w.sum()
        chance = lambda v: 1 / (1 + np.exp(-v))

        def grads(v, w=w, t=hit[used]):
            return w * (t - chance(v)), w * chance(v) * (1 - chance(v))

        want = plain(x[used], boosting.bin_edges(df, NAMES, PARAMS.bins), PARAMS, grads, np.log(share / (1 - share)))(x)
        assert np.allclose(forest.predict(x, "0", fold), want, atol=1e-9)
    got = np.array([r.prediction for r in forest.probability(df.withColumn("at", F.monotonically_increasing_id())).orderBy("at").collect()])
    assert got.min() >= 0 and got.max() <= 1 and got[hit > 0].mean() > got[hit == 0].mean()


def test_same_trees_under_any_partitioning(spark):
    x, y = sample(2, 200)
    df = frame(spark, x, y)
    one = Forest.of(boosting.fit(df.coalesce(1), NAMES, PARAMS), NAMES)
    many = Forest.of(boosting.fit(df.repartition(7, "b"), NAMES, PARAMS), NAMES)
    for key in one.models:
        assert (one.predict(x, *key) == many.predict(x, *key)).all()


def test_bins_are_merged_until_the_cells_fit(spark):
    x, y = sample(3, 300)
    df = frame(spark, x, y, models=1, folds=1)
    summed, edges = boosting.cells(df, NAMES, BoostParams(bins=16, max_cells=40))
    facts = summed.agg(F.count("*").alias("cells"), F.sum("weight").alias("rows"), F.sum("target").alias("target")).first()
    assert facts["cells"] <= 40 and facts["rows"] == 300 and facts["target"] == int(np.round(y * 1e6).sum()) and max(map(len, edges)) < 15


def test_missing_values_go_left(spark):
    x, y = sample(4, 200)
    x[::5, 1] = np.nan
    rows = [("0", -1, float(t), float(v[0]), None if np.isnan(v[1]) and i % 2 else float(v[1]), float(v[2])) for i, (t, v) in enumerate(zip(y, x, strict=True))]
    rows += [("0", -1, None, 1.0, 1.0, 1.0), (None, -1, 1.0, 1.0, 1.0, 1.0), ("0", -1, float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    forest = Forest.of(boosting.fit(df, NAMES, PARAMS), NAMES)
    low = np.where(np.isnan(x), -1e9, x)
    assert np.allclose(forest.predict(x, "0"), forest.predict(low, "0"))
    assert [r.prediction for r in forest.score(df.where("model is null"), "model", default=7.0).collect()] == [7.0]


def test_no_rows_and_one_value(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Forest.of(boosting.fit(empty, NAMES, PARAMS), NAMES).models == {}
    same = spark.createDataFrame([("0", -1, 2.5, 1.0, 1.0, 1.0)] * 5, SCHEMA)
    forest = Forest.of(boosting.fit(same, NAMES, PARAMS), NAMES)
    assert np.allclose(forest.predict(np.ones((2, 3)), "0"), 2.5)


def test_shapley_values_by_enumeration(spark):
    x, y = sample(5, 240)
    df = frame(spark, x, y, models=1, folds=1)
    forest = Forest.of(boosting.fit(df, NAMES, PARAMS), NAMES)
    start, feature, threshold, cover, leaf = forest.models["0", -1]
    inner = feature.shape[1]

    def given(row, known):
        """Mean prediction if only some features are known."""
        def walk(t, node):
            if node >= inner:
                return leaf[t][node - inner]
            l, r = 2 * node + 1, 2 * node + 2
            if feature[t][node] in known:
                return walk(t, r if row[feature[t][node]] >= threshold[t][node] else l)
            return (cover[t][l] * walk(t, l) + cover[t][r] * walk(t, r)) / cover[t][node] if cover[t][node] > 0 else walk(t, l)
        return start + sum(walk(t, 0) for t in range(len(feature)))

    base, phi = forest.contributions(x[:6], "0")
    assert np.allclose(base + phi.sum(1), forest.predict(x[:6], "0"))
    for row, values in zip(x[:6], phi, strict=True):
        assert given(row, ()) == pytest.approx(base)
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = sum(
                factorial(k) * factorial(2 - k) / 6 * (given(row, {*s, i}) - given(row, set(s))) for k in range(3) for s in combinations(others, k)
            )
            assert values[i] == pytest.approx(want, abs=1e-9)


def walked(forest, x, model):
    """Sum of the leaves found by walking every tree."""
    base, feature, threshold, _, leaf = forest.models[model, -1]
    out = []
    for row in x:
        total = base
        for t in range(len(feature)):
            node = 0
            while node < feature.shape[1]:
                node = 2 * node + 1 + bool(row[feature[t][node]] >= threshold[t][node])
            total += leaf[t][node - feature.shape[1]]
        out.append(total)
    return np.array(out)


@pytest.mark.parametrize("depth", [1, 3, 6, 7])
def test_leaf_tables_equal_walked_trees(depth):
    """Rows of equal bins are scored once, so the same rows many times over cost no more walks."""
    rng = np.random.default_rng(depth)
    inner = 2**depth - 1
    threshold = rng.choice([0.1, 0.25, 0.5, 0.75, np.inf], (9, inner))
    forest = Forest(("a", "b", "c"), {("0", -1): (0.5, rng.integers(0, 3, (9, inner)), threshold, np.ones((9, 2 * inner + 1)), rng.normal(size=(9, inner + 1)))})
    x = rng.choice([0.0, 0.1, 0.25, 0.3, 0.6, 0.75, 1.0, np.nan, np.inf, -np.inf], (300, 3))
    assert (forest.predict(x, "0") == walked(forest, x, "0")).all()
    if depth < 7:
        bins, of = forest._table("0", -1).bins(np.tile(x, (5, 1)))
        assert len(bins[0]) <= 6**3 and len(of) == 1500


def test_tree_contributions(spark):
    x, y = sample(6, 150)
    df = frame(spark, x, y).withColumn("id", F.monotonically_increasing_id())
    forest = Forest.of(boosting.fit(df, NAMES, PARAMS), NAMES)
    asked = df.unionByName(df.limit(1).withColumns({"model": F.lit("none"), "id": F.lit(-1)}))
    got = explain.tree_contributions(asked, ["id"], forest, "model", top=3).collect()
    for r in got:
        if r.id == -1:
            assert r.prediction is None and r.contributions is None
        else:
            assert r.base + sum(c.contribution for c in r.contributions) == pytest.approx(r.prediction)
            assert {c.direction == "+" for c in r.contributions if c.contribution > 0} <= {True}


def test_model_folds(spark):
    rows = [(m, f"s{s}", k) for m, sessions in (("x", 7), ("y", 2), ("z", 1)) for s in range(sessions) for k in range(s + 1)]
    got = model_folds(spark.createDataFrame(rows, "model string, session_id string, k int"), "model", "session_id", 5).collect()
    folds = {}
    for r in got:
        folds.setdefault(r.model, {}).setdefault(r.session_id, set()).add(r.fold)
    assert len(got) == len(rows) and all(len(f) == 1 for by in folds.values() for f in by.values())
    assert {m: len({next(iter(f)) for f in by.values()}) for m, by in folds.items()} == {"x": 5, "y": 2, "z": 1}


@pytest.mark.parametrize("heavy", [False, True])
def test_all_bins_of_a_model_are_kept(spark, heavy):
    """A model with more cells than any bound is grown from all of them, in blocks, on the whole grid of bins."""
    x, y = sample(7, 400)
    df = frame(spark, x, (y > 2).astype(float) if heavy else y, models=2, folds=3)
    want = Forest.of(boosting.fit(df, NAMES, PARAMS, heavy), NAMES)
    got = Forest.of(boosting.fit(df, NAMES, BoostParams(rounds=6, rate=0.3, depth=3, bins=16, max_cells=40), heavy), NAMES)
    assert set(got.models) == set(want.models) == {(m, f) for m in "01" for f in (-1, 0, 1, 2)}
    for key in want.models:
        assert all((a == b).all() for a, b in zip(got.models[key][1:], want.models[key][1:], strict=True))


@pytest.mark.parametrize("heavy", [None, 3.0])
def test_growth_by_blocks_and_joint_bins(monkeypatch, heavy):
    """Features summed together and cells summed by blocks give the trees of one sum per feature over all cells."""
    rng = np.random.default_rng(8)
    bins = np.column_stack([rng.integers(0, s, 3000) for s in (5, 1, 9, 3)]).astype(np.uint8)
    weight = rng.integers(1, 5, 3000).astype(float)
    target = np.floor(rng.random(3000) * (weight + 1)) if heavy else weight * (bins[:, 0] * 0.3 - (bins[:, 2] > 4)) + rng.normal(size=3000)
    monkeypatch.setattr(boosting, "JOINT_BINS", 0)
    base, want = boosting.grow(bins, weight, target, 12, PARAMS, heavy)
    monkeypatch.setattr(boosting, "JOINT_BINS", 45)
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 700)
    assert sorted(map(sorted, boosting._joint((5, 1, 9, 3), 3000))) == [[0, 1, 2], [3]]
    same, got = boosting.grow(bins, weight, target, 12, PARAMS, heavy)
    assert base == same
    for a, b in zip(want, got, strict=True):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and np.allclose(a[2], b[2]) and np.allclose(a[3], b[3])
