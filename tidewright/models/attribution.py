"""Which features a fitted model relies on: permutation, Shapley values, partial dependence."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.models.trees import Tree, TreeModel
from tidewright.operators.metrics import metric_columns
from tidewright.operators.quantiles import quantiles


def _features(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def tree_importance(model, names: Sequence[str], spark, top: int = 15) -> DataFrame:
    """Importance by the gains of a tree model's splits, largest first."""
    rows = [(n, float(v)) for n, v in zip(names, model.feature_importances())]
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.col("importance").desc(), "feature").limit(top)


# ---------------------------------------------------------------- permutation

def _multipliers(n: int, repeats: int, seed: int) -> list[tuple[int, int]]:
    """(a, b) such that row -> (a * row + b) mod n is a permutation that scatters neighbours."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(repeats):
        a = max(1, int(n * rng.uniform(0.2, 0.8)))
        while math.gcd(a, n) != 1:
            a += 1
        out.append((a, int(rng.integers(n))))
    return out


def permutation_importance(model, frame: DataFrame, names: Sequence[str], repeats: int = 10,
                           seed: int = 42) -> DataFrame:
    """Mean loss of R2 when one feature's values are given to other rows, largest first.

    Features that no split of a tree model uses lose nothing and need no trial. Every trial has a
    ``row_id`` of its own, for models that ask for one.

    ``frame`` has row_id (positions from 0), features and label. Each repeat is one
    permutation of the rows, found by arithmetic on row_id and one equi-join on it, so
    no shuffle by random numbers and no sort of the rows takes place.
    """
    rows = frame.select("row_id", vector_to_array("features").alias("x"), "label")
    n = rows.count()
    used = list(range(len(names)))
    if isinstance(model, TreeModel):
        used = [i for i, v in enumerate(model.feature_importances()) if v > 0]
    big = lambda v: F.lit(v).cast("decimal(19,0)")
    donors = F.array(*[
        F.struct(F.lit(r).alias("repeat"),
                 F.pmod(F.col("row_id").cast("decimal(19,0)") * big(a) + big(b), big(n)).cast("long").alias("donor"))
        for r, (a, b) in enumerate(_multipliers(n, repeats, seed))])
    asked = rows.select("row_id", "x", "label", F.explode(donors).alias("d")).select("row_id", "x", "label", "d.*")
    paired = asked.join(rows.select(F.col("row_id").alias("donor"), F.col("x").alias("other")), "donor")
    swapped = F.transform(F.array(*map(F.lit, used)).cast("array<int>"), lambda f: F.struct(
        f.alias("feature"),
        F.transform("x", lambda v, i: F.when(i == f, F.get("other", f)).otherwise(v)).alias("x")))
    number = (F.col("row_id") * repeats + F.col("repeat")) * len(names) + F.col("feature")
    trials = paired.select("row_id", "repeat", "label", F.explode(swapped).alias("s")) \
        .select("row_id", "repeat", "label", "s.feature", array_to_vector("s.x").alias("features")) \
        .withColumn("row_id", number)
    scores = model.transform(trials).groupBy("feature", "repeat").agg(*metric_columns("label", "prediction"))
    base = model.transform(frame).agg(*metric_columns("label", "prediction")).first()["r2"]
    found = scores.groupBy("feature").agg(
        F.avg(F.lit(base) - F.col("r2")).alias("importance"),
        F.stddev_pop(F.lit(base) - F.col("r2")).alias("std"))
    unused = [(i, 0.0, 0.0) for i in range(len(names)) if i not in used]
    if unused:
        found = found.unionByName(frame.sparkSession.createDataFrame(unused, "feature int, importance double, std double"))
    return found \
        .select(F.element_at(_features(names), F.col("feature") + 1).alias("feature"), "importance", "std") \
        .orderBy(F.col("importance").desc(), "feature")


# ---------------------------------------------------------------- trees

def tree_shapley(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values of one tree, a row per row of ``x``.

    A coalition reaches a leaf with the product, over the features on the way, of one or nothing for members and the share of the
    rows that stays on the way for others. Divided by the shares, a feature's factor is q: 0, or 1 / share. Its
    Shapley value is (q - 1) times the integral from 0 to 1 of the product of 1 + (q - 1) t over the other features, since
    the weight of a coalition is a Beta integral; Gauss's rule makes it exact with half as many places as there are features
    on the way. The product is extended at every node by its feature's factor and, on the way back, divided by it; a
    feature met again takes its earlier factor back. So a node costs one pass over the rows, however many leaves lie below.
    """
    out = np.zeros(x.shape)
    depth = np.zeros(len(tree.feature), np.int64)
    for node in np.flatnonzero(tree.feature >= 0):  # children follow their parents
        depth[tree.left[node]] = depth[tree.right[node]] = depth[node] + 1
    most = min(int(depth.max()), x.shape[1])
    if not most:
        return out
    place, weight = np.polynomial.legendre.leggauss(-(-most // 2))
    place, weight = (place + 1) / 2, weight / 2
    share = tree.cover / tree.cover[0]
    # A frame of the walk: node, product so far, latest q of each feature on the way, sum over the leaves below, the edge
    # that led here (feature, q, the q it replaced), and the children yet to be seen.
    children = lambda node: [tree.left[node], tree.right[node]] if tree.feature[node] >= 0 else []
    frames = [[0, np.ones((len(x), len(place))), {}, 0.0, None, children(0)]]
    while True:
        node, product, known, below, edge, rest = frames[-1]
        if rest:
            child, f = rest.pop(), tree.feature[node]
            goes = (x[:, f] <= tree.cut[node]) == (child == tree.left[node])
            old = known.get(f)
            q = goes * (tree.cover[node] / tree.cover[child]) * (1.0 if old is None else old)
            extended = product * (1 + (q - 1)[:, None] * place)
            if old is not None:
                extended /= 1 + (old - 1)[:, None] * place
            frames.append([child, extended, {**known, f: q}, 0.0, (f, q, old), children(child)])
            continue
        frames.pop()
        if tree.feature[node] < 0:
            below = product * (tree.value[node] * share[node])
        if edge is None:
            return out
        f, q, old = edge
        out[:, f] += (q - 1) * ((below / (1 + (q - 1)[:, None] * place)) @ weight)
        if old is not None:
            out[:, f] -= (old - 1) * ((below / (1 + (old - 1)[:, None] * place)) @ weight)
        frames[-1][3] = frames[-1][3] + below


# Shapley values of a tree that are kept for all rows.
KEPT_VALUES = 1024


def _by_cell(tree: Tree, width: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray] | None:
    """The places at which a small tree cuts each feature, and the Shapley values of every cell between them; they are the same for all of its rows."""
    cuts = [(int(f), np.unique(tree.cut[tree.feature == f])) for f in np.unique(tree.feature[tree.feature >= 0])]
    shape = [len(c) + 1 for _, c in cuts]
    if not cuts or math.prod(shape) * width > KEPT_VALUES:
        return None
    x = np.zeros((math.prod(shape), width))
    for (f, c), at in zip(cuts, np.indices(shape).reshape(len(shape), -1), strict=True):
        x[:, f] = np.append(c, np.inf)[at]  # rows up to a cut go left
    return cuts, tree_shapley(tree, x)


def _shapley(trees: list[tuple[int, float, Tree]], x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape)
    for _, weight, tree in trees:
        if "cells" not in vars(tree):
            tree.cells = _by_cell(tree, x.shape[1])
        if tree.cells is None:
            out += weight * tree_shapley(tree, x)
            continue
        cuts, values = tree.cells
        cell = np.zeros(len(x), np.int64)
        for f, c in cuts:
            cell = cell * (len(c) + 1) + np.searchsorted(c, x[:, f], "left")
        out += weight * values[cell]
    return out


def shap_values(model: TreeModel, frame: DataFrame, keep: Sequence[str] = ("row_id",)) -> tuple[DataFrame, float]:
    """Path-dependent Shapley values of a tree model, as the array ``phi`` per row, and the base value.

    Base plus the sum of a row's values is the model's prediction for it.
    """
    if not isinstance(model, TreeModel):
        raise ValueError("tree models only; use shap_sampled for others")
    return model.per_row(frame.select(*keep, "features"), _shapley, model.width, "phi").drop("features"), model.expected()


def _mean_abs(values: DataFrame, names: Sequence[str]) -> DataFrame:
    row = values.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(f"p{i}") for i in range(len(names))])
    entries = [F.struct(F.lit(n).alias("feature"), F.col(f"p{i}").alias("importance"), F.lit(i).alias("ordinal"))
               for i, n in enumerate(names)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def shap_importance(model, frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean absolute Shapley value per feature, largest first."""
    values, _ = shap_values(model, frame, ())
    return _mean_abs(values, names).drop("ordinal").orderBy(F.col("importance").desc(), "feature")


def shap_selected(model, frame: DataFrame, names: Sequence[str], selected: Sequence[str]) -> DataFrame:
    """The same for chosen features, in the chosen order; unknown names are skipped."""
    known = [s for s in selected if s in names]
    values, _ = shap_values(model, frame, ())
    table = _mean_abs(values, names).drop("ordinal")
    place = F.array_position(_features(known), F.col("feature")).cast("long")
    return table.withColumn("place", place).where(F.col("place") > 0).orderBy("place")


def shap_sampled(model, frame: DataFrame, names: Sequence[str], rows: int | None = None,
                 permutations: int = 16, seed: int = 42, background: int = 100) -> DataFrame:
    """Mean absolute Shapley value per feature for any model.

    Each row is turned into a background row feature by feature, in orders drawn from a
    hash; the change of the prediction at each step is that feature's contribution. The
    background is the first rows by row_id, as many as asked for. All rows are explained, or the
    first ``rows``. Every step has a ``row_id`` of its own, for models that ask for one.
    """
    vectors = frame.select("row_id", vector_to_array("features").alias("x"))
    # As few rows as asked for, in one row.
    held = vectors.orderBy("row_id").limit(background).agg(F.array_sort(F.collect_list(F.struct("row_id", "x"))).alias("b")).first()["b"]
    if not held:
        return frame.sparkSession.createDataFrame([], "feature string, importance double")
    others = F.array(*[F.struct(F.array(*map(F.lit, map(float, h["x"]))).alias("x")) for h in held])
    few = vectors if rows is None else vectors.orderBy("row_id").limit(rows)
    count = len(names)
    trials = few.withColumn("b", others) \
        .withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    draw = F.transform(F.sequence(F.lit(0), F.lit(count - 1)),
                       lambda i: F.struct(F.xxhash64(F.lit(seed), "row_id", "perm", i).alias("h"), i.alias("i")))
    order = F.transform(F.array_sort(draw), lambda e: e["i"])
    other = F.element_at("b", (F.pmod(F.xxhash64("perm", "row_id", F.lit(seed)), F.size("b")) + 1).cast("int"))["x"]
    trials = trials.select("row_id", "perm", "x", order.alias("order"), other.alias("other"))
    steps = trials.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(count))))
    mixed = F.transform("x", lambda v, i: F.when(
        F.array_position("order", i) <= F.col("step"), v).otherwise(F.get("other", i)))
    own = (F.col("row_id") * permutations + F.col("perm")) * (count + 1) + F.col("step")
    scored = model.transform(steps.select(F.col("row_id").alias("of"), "perm", "step", "order", own.alias("row_id"),
                                          array_to_vector(mixed).alias("features")))
    walks = scored.groupBy(F.col("of").alias("row_id"), "perm").agg(
        F.first("order").alias("order"), F.array_sort(F.collect_list(F.struct("step", "prediction"))).alias("walk"))
    change = F.transform("order", lambda f, s: F.struct(
        f.alias("feature"), (F.get("walk", s + 1)["prediction"] - F.get("walk", s)["prediction"]).alias("delta")))
    parts = walks.select("row_id", F.explode(change).alias("c")).select("row_id", "c.*")
    per_row = parts.groupBy("row_id", "feature").agg(F.avg("delta").alias("phi"))
    return per_row.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")) \
        .select(F.element_at(_features(names), F.col("feature") + 1).alias("feature"), "importance") \
        .orderBy(F.col("importance").desc(), "feature")


# ---------------------------------------------------------------- partial dependence

def _grid(frame: DataFrame, index: int, points: int) -> list[float]:
    """Even grid from the 5 % to the 95 % quantile, or the distinct values if they are fewer."""
    values = frame.select(vector_to_array("features")[index].alias("v"))
    # The estimate is a few percent off at most; only a short list is worth collecting.
    if values.agg(F.approx_count_distinct("v")).first()[0] < 2 * points:
        distinct = [r["v"] for r in values.distinct().limit(points).collect()]
        if len(distinct) < points:
            return sorted(distinct)
    low, high = quantiles(values, ["v"], [0.05, 0.95])["v"]
    return list(np.linspace(low, high, points))


def partial_dependence(model, frame: DataFrame, names: Sequence[str], feature: str,
                       points: int = 100) -> DataFrame:
    """Average prediction as one feature takes each grid value.

    Trees, boosted or not, are averaged over their own node counts and need no pass over the
    rows. Other models score every row once per grid value, in one job.
    """
    spark = frame.sparkSession
    index = list(names).index(feature)
    grid = _grid(frame, index, points)
    if isinstance(model, TreeModel):
        average = model.partial_dependence(index, grid)
        return spark.createDataFrame([(float(g), float(v)) for g, v in zip(grid, average)], "value double, average double")
    x = vector_to_array("features")
    trials = frame.select("row_id", x.alias("x"), F.posexplode(F.array(*[F.lit(float(g)) for g in grid])).alias("at", "value"))
    fixed = F.transform("x", lambda v, i: F.when(i == index, F.col("value")).otherwise(v))
    trials = trials.select("value", array_to_vector(fixed).alias("features"),
                           (F.col("row_id") * len(grid) + F.col("at")).alias("row_id"))
    return model.transform(trials).groupBy("value").agg(F.avg("prediction").alias("average")).orderBy("value")

