"""Trees on histograms: against a search over all splits, and the same wherever they are grown."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewright.models import attribution as at
from tidewright.models import trees
from tidewright.models.estimators import make_estimator
from tidewright.models.trees import Limits, Tree, Units


def table(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 6, n), rng.normal(0, 1, n).round(2), rng.integers(0, 2, n), rng.normal(0, 1, n)]).astype(float)
    y = 3 * x[:, 0] + 2 * np.sin(2 * x[:, 1]) * (x[:, 2] + 0.5) + rng.normal(0, 0.3, n)
    return x, y


def framed(spark, x, y, parts=3):
    rows = [(i, [float(v) for v in row], float(label)) for i, (row, label) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, label double").repartition(parts).select(
        "row_id", array_to_vector("x").alias("features"), "label")


def nested(tree, node=0):
    """A tree as nested tuples, whatever the numbers of its nodes."""
    if tree.feature[node] < 0:
        return tree.value[node], tree.count[node]
    return (tree.feature[node], tree.cut[node], tree.count[node], nested(tree, tree.left[node]), nested(tree, tree.right[node]))


def shapes(model):
    return [(t, w, nested(tree)) for t, w, tree in trees.collected(model.trees)]


def searched(x, y, limits, depth=0):
    """The tree by trying every place between two values of every feature."""
    n, penalty = len(y), limits.penalty
    leaf = (y.sum() / (n + penalty), n)
    if n < limits.min_samples_split or (limits.max_depth is not None and depth >= limits.max_depth):
        return leaf
    best, score = None, lambda v: v.sum() ** 2 / (len(v) + penalty)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            least = max(limits.min_samples_leaf, limits.min_child_weight)
            if min(low.sum(), (~low).sum()) < least:
                continue
            gain = score(y[low]) + score(y[~low]) - score(y)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, f, cut, low
    if best is None:
        return leaf
    _, f, cut, low = best
    return f, cut, n, searched(x[low], y[low], limits, depth + 1), searched(x[~low], y[~low], limits, depth + 1)


def same_tree(a, b, base=0.0):
    if len(a) == 2 or len(b) == 2:
        return len(a) == len(b) and a[1] == b[1] and a[0] + base == pytest.approx(b[0], abs=1e-7)
    # A place may lie anywhere between two values that occur in the node.
    return a[0] == b[0] and a[2] == b[2] and same_tree(a[3], b[3], base) and same_tree(a[4], b[4], base)


@pytest.mark.parametrize("limits", [
    Limits(), Limits(3), Limits(None, 40), Limits(6, 2, 7), Limits(4, penalty=2.0), Limits(5, min_child_weight=9.0), Limits(0)])
def test_grown_as_searched(spark, limits):
    x, y = table(200)
    packed = trees.pack(framed(spark, x, y))
    units = Units.of(packed.n, packed.reach, 1.0, whole=True)
    middle = packed.middle
    grown = trees.grow_trees(packed, [0], lambda own, _: (own.label - middle, own.weight), lambda _: range(4), limits, units)
    [(_, _, tree)] = trees.collected(grown)
    assert same_tree(nested(tree), searched(x, y - middle, limits))


def test_many_values_share_bins(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (2000, 1))
    packed = trees.pack(framed(spark, x, x[:, 0]), max_bins=16)
    assert len(packed.cuts[0]) == 15
    counts = np.bincount(np.searchsorted(packed.cuts[0], x[:, 0], "left"))
    assert counts.min() >= 120 and counts.max() <= 130
    with pytest.raises(ValueError):
        trees.pack(framed(spark, x, x[:, 0]), max_bins=300)


@pytest.mark.parametrize("name, params", [
    ("DecisionTree", {"max_depth": 7, "min_samples_split": 9}),
    ("RandomForest", {"n_estimators": 5, "max_depth": None, "min_samples_leaf": 2}),
    ("XGBoost", {"n_estimators": 19, "max_depth": 3, "subsample": 0.7, "colsample_bytree": 0.6, "min_child_weight": 3})])
@pytest.mark.parametrize("local", [0, 60])
def test_grown_together_or_in_one_task(spark, monkeypatch, name, params, local):
    """Levels over all tasks, the rest of a tree in one: no bit of a tree depends on it, nor on where rows lie."""
    x, y = table()
    whole = shapes(make_estimator(name, **params).fit(framed(spark, x, y, 1)))
    monkeypatch.setattr(trees, "LOCAL_ROWS", local)
    monkeypatch.setattr(trees, "LEVEL_NODES", 7)
    monkeypatch.setattr(trees, "PACK_ROWS", 50)
    monkeypatch.setattr(trees, "KEPT_ROUNDS", 4)
    if local == 0:  # every level takes a job
        params = {**params, "max_depth": 3} | ({"n_estimators": 5} if name == "XGBoost" else {})
        whole = None
    parts = shapes(make_estimator(name, **params).fit(framed(spark, x, y, 4)))
    if whole is None:
        monkeypatch.undo()
        whole = shapes(make_estimator(name, **params).fit(framed(spark, x, y, 1)))
    assert parts == whole


@pytest.mark.parametrize("times, jobs", [(10, False), (1, True)])
def test_boosted_in_one_task_or_by_jobs(spark, monkeypatch, times, jobs):
    """More rows than a task should grow a single tree over stay in one for all rounds, up to a bound; no bit of a tree depends on it."""
    x, y = table()
    params = {"n_estimators": 5, "max_depth": 3, "subsample": 0.7, "colsample_bytree": 0.6, "min_child_weight": 3}
    whole = shapes(make_estimator("XGBoost", **params).fit(framed(spark, x, y, 1)))
    for name, value in (("LOCAL_ROWS", 100), ("PACK_ROWS", 50), ("KEPT_ROUNDS", 4), ("BOOSTED_TIMES", times)):
        monkeypatch.setattr(trees, name, value)
    levels, honest = [], trees._grow_level
    monkeypatch.setattr(trees, "_grow_level", lambda *a: (levels.append(1), honest(*a)))
    assert shapes(make_estimator("XGBoost", **params).fit(framed(spark, x, y, 2))) == whole
    assert bool(levels) == jobs


@pytest.fixture
def plain(spark):
    """The session as others may set it up: tables of pandas are not taken by way of Arrow."""
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


@pytest.mark.parametrize("name, params", [
    ("DecisionTree", {"max_depth": 3}), ("RandomForest", {"n_estimators": 2, "max_depth": 2}), ("XGBoost", {"n_estimators": 2, "max_depth": 2}),
    ("AdaBoost", {"n_estimators": 2})])
def test_grown_together_in_any_session(plain, monkeypatch, name, params):
    """Trees over more rows than one task takes need no setting of the session."""
    x, y = table()
    frame = framed(plain, x, y)
    whole = make_estimator(name, **params).fit(frame)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 60)
    parts = make_estimator(name, **params).fit(frame)
    want = {r.row_id: r.prediction for r in whole.transform(frame).collect()}
    assert {r.row_id: r.prediction for r in parts.transform(frame).collect()} == pytest.approx(want)


def test_adaboost_grown_together(spark, monkeypatch):
    x, y = table()
    frame = framed(spark, x, y)
    whole = trees.collected(make_estimator("AdaBoost", n_estimators=6).fit(frame).model.trees)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 100)
    monkeypatch.setattr("tidewright.models.adaboost.KEPT_ROUNDS", 2)
    parts = trees.collected(make_estimator("AdaBoost", n_estimators=6).fit(frame).model.trees)
    assert [w for _, w, _ in parts] == pytest.approx([w for _, w, _ in whole])
    for (_, _, a), (_, _, b) in zip(whole, parts, strict=True):
        assert len(a.feature) == len(b.feature)


def test_boosting_by_hand(spark):
    """Every round fits what the rounds before left, with the penalty in the leaves."""
    x, y = table(150)
    model = make_estimator("XGBoost", n_estimators=4, max_depth=2, learning_rate=0.5, reg_lambda=3.0, min_child_weight=4).fit(framed(spark, x, y))
    assert model.base == pytest.approx(y.mean())
    left = y - y.mean()
    limits = Limits(2, penalty=3.0, min_child_weight=4.0)
    for _, weight, tree in trees.collected(model.trees):
        assert weight == 0.5 and same_tree(nested(tree), searched(x, left, limits))
        left = left - 0.5 * tree.value[tree.leaves(x)]
    got = {r.row_id: r.prediction for r in model.transform(framed(spark, x, y)).collect()}
    assert [got[i] for i in range(150)] == pytest.approx(y - left)


def test_columns_are_drawn_once_per_tree(spark):
    x, y = table()
    model = make_estimator("XGBoost", n_estimators=12, max_depth=4, colsample_bytree=0.5).fit(framed(spark, x, y))
    used = [set(tree.feature[tree.feature >= 0].tolist()) for _, _, tree in trees.collected(model.trees)]
    assert all(1 <= len(u) <= 2 for u in used) and len(set().union(*used)) == 4 and len(set(map(frozenset, used))) > 2


def test_deeper_than_thirty_levels(spark):
    """Labels that grow by the same factor from row to row: each split takes off the largest one."""
    x = np.arange(38.0)[:, None]
    model = make_estimator("DecisionTree").fit(framed(spark, x, 2.5 ** np.arange(38)))
    [(_, _, tree)] = trees.collected(model.trees)
    depth = np.zeros(len(tree.feature), int)
    for node in np.flatnonzero(tree.feature >= 0):
        depth[tree.left[node]] = depth[tree.right[node]] = depth[node] + 1
    assert depth.max() > 30


def test_samples_with_repeats(spark):
    x, y = table()
    model = make_estimator("RandomForest", n_estimators=30, max_depth=1).fit(framed(spark, x, y))
    grown = trees.collected(model.trees)
    rows, cover = [tree.count[0] for _, _, tree in grown], [tree.cover[0] for _, _, tree in grown]
    assert 170 < np.mean(rows) < 210 and 285 < np.mean(cover) < 315 and len(set(cover)) > 10


def test_constant_labels_and_single_rows(spark):
    x, _ = table(20)
    for name in ("DecisionTree", "RandomForest", "XGBoost"):
        for rows in (20, 1):
            flat = framed(spark, x[:rows], np.full(rows, 2.5))
            assert {r.prediction for r in make_estimator(name, **({} if name == "DecisionTree" else {"n_estimators": 3})).fit(flat).transform(flat).collect()} == {2.5}
    with pytest.raises(ValueError, match="no rows"):
        make_estimator("DecisionTree").fit(framed(spark, x, x[:, 0]).where("row_id < 0"))


# ---------------------------------------------------------------- attribution

def by_definition(tree, x):
    """Shapley values from the values of all coalitions."""
    m = len(x)

    def value(known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return value(known, left if x[f] <= tree.cut[node] else right)
        return sum(value(known, c) * tree.cover[c] / tree.cover[node] for c in (left, right))

    phi = np.zeros(m)
    for j in range(m):
        others = [i for i in range(m) if i != j]
        for size in range(m):
            for s in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(m - 1 - size) / math.factorial(m)
                phi[j] += w * (value({*s, j}) - value(set(s)))
    return phi


@pytest.mark.parametrize("name, params", [
    ("DecisionTree", {"max_depth": 8}), ("RandomForest", {"n_estimators": 3, "max_depth": 5}), ("XGBoost", {"n_estimators": 3, "max_depth": 3}),
    ("DecisionTree", {"max_depth": 0})])
def test_shapley_values_by_definition(spark, name, params):
    x, y = table()
    frame = framed(spark, x, y)
    model = make_estimator(name, **params).fit(frame)
    for _, _, tree in trees.collected(model.trees):
        np.testing.assert_allclose(at.tree_shapley(tree, x[:15]), [by_definition(tree, row) for row in x[:15]], atol=1e-9)
    values, base = at.shap_values(model, model.transform(frame), ["row_id", "prediction"])
    for r in values.collect():
        assert base + sum(r.phi) == pytest.approx(r.prediction)


@pytest.mark.parametrize("name, params, small", [
    ("XGBoost", {"n_estimators": 9, "max_depth": 3}, True), ("DecisionTree", {"max_depth": 0}, False), ("DecisionTree", {"max_depth": 9}, False)])
def test_small_trees_are_explained_by_cells(spark, monkeypatch, name, params, small):
    """Rows between the same cuts share their values, also those at a cut, behind all, or without a number."""
    x, y = table()
    held = trees.collected(make_estimator(name, **params).fit(framed(spark, x, y)).trees)
    cuts = np.concatenate([tree.cut[tree.feature >= 0] for _, _, tree in held] or [[]])
    rows = np.concatenate([x, np.repeat(cuts[:40, None], 4, axis=1), np.array([[np.inf] * 4, [-np.inf] * 4, [np.nan, 1, np.nan, 0]])])
    want = sum(weight * at.tree_shapley(tree, rows) for _, weight, tree in held)
    walks, honest = [], at.tree_shapley
    monkeypatch.setattr(at, "tree_shapley", lambda tree, x: (walks.append(len(x)), honest(tree, x))[1])
    for _ in range(3):
        np.testing.assert_allclose(at._shapley(held, rows), want, atol=1e-9)
    assert (len(walks) == len(held) and max(walks) < len(rows)) == small


def test_groups_of_trees_add_up(spark, monkeypatch):
    x, y = table()
    frame = framed(spark, x, y).withColumn("phi_0", F.lit("other column"))
    model = make_estimator("RandomForest", n_estimators=7, max_depth=4).fit(frame)
    whole, base = at.shap_values(model, frame)
    want, predicted = {r.row_id: r.phi for r in whole.collect()}, {r.row_id: r.prediction for r in model.transform(frame).collect()}
    monkeypatch.setattr(trees, "GROUP_NODES", 50)
    again = trees.TreeModel(model.trees, model.base, model.width)
    assert len(again.lots()) > 3 and again.expected() == pytest.approx(base)
    for r in at.shap_values(again, frame)[0].collect():
        assert r.phi == pytest.approx(want[r.row_id])
    out = again.transform(frame)
    assert out.columns == [*frame.columns, "prediction"]
    assert {r.row_id: r.prediction for r in out.collect()} == pytest.approx(predicted)


def test_importance_and_dependence_by_hand(spark):
    x, y = table()
    model = make_estimator("DecisionTree", max_depth=3).fit(framed(spark, x, y))
    [(_, _, tree)] = trees.collected(model.trees)
    gains = np.zeros(4)
    for f, g in zip(tree.feature, tree.gain, strict=True):
        if f >= 0:
            gains[f] += g
    assert model.feature_importances() == pytest.approx(gains / gains.sum())

    def mean(node, value):
        if tree.feature[node] < 0:
            return tree.value[node]
        sides = [tree.left[node], tree.right[node]]
        if tree.feature[node] == 0:
            return mean(sides[0 if value <= tree.cut[node] else 1], value)
        return sum(mean(c, value) * tree.cover[c] / tree.cover[node] for c in sides)

    grid = [0.0, 1.5, 3.0, 9.0]
    assert model.partial_dependence(0, grid) == pytest.approx([model.base + mean(0, v) for v in grid])


def test_parts_of_a_tree_are_put_together():
    def leafy(value):
        return Tree(*[np.array(v) for v in ([0, -1, -1], [1, 0, 0], [.5, 0, 0], [1, -1, -1], [2, -1, -1], [0., value, value + 1], [1., 0, 0],
                                            [2., 1, 1], [2, 1, 1])])

    top = leafy(10.0)
    both = top.joined({1: leafy(1.0), 2: leafy(3.0)})
    assert nested(both)[3:] == (nested(leafy(1.0)), nested(leafy(3.0)))
