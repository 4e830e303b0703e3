"""AdaBoost.R2 (Drucker 1997) with linear loss, on weighted regression trees."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.models import trees as grown
from tidewright.models.trees import KEPT_ROUNDS, MAX_BINS, Limits, Pack, Packed, Tree, TreeModel, Units, collected, grow, grow_trees, pack
from tidewright.session import materialize


@dataclass(frozen=True)
class _Round:
    """What a tree does to the weights of the rows: its largest error, their sum, and the base of the new weights."""

    tree: Tree
    worst: float
    mass: float
    beta: float


def _errors(own: Pack, tree: Tree, middle: float) -> np.ndarray:
    return np.abs(own.label - middle - tree.value[tree.leaves_of_codes(own.codes)])


def _reweighted(own: Pack, rounds: Sequence[_Round], middle: float, rate: float) -> Pack:
    """Dividing by the mass keeps the weights from fading away over many rounds."""
    weight = own.weight
    for r in rounds:
        weight = weight / r.mass * r.beta ** ((1 - _errors(own, r.tree, middle) / r.worst) * rate)
    return replace(own, weight=weight)


def _judged(tree: Tree, worst: float, mass: float, weighted: float, first: bool, rate: float) -> tuple[float | None, _Round | None]:
    """The weight of a tree (none: it is not taken) and how it changes the rows' weights (none: it is the last)."""
    if worst == 0:
        return 1.0, None
    loss = weighted / mass / worst
    if loss >= 0.5:
        return (1.0 if first else None), None
    beta = loss / (1 - loss)
    if beta == 0:
        return 1.0, None
    return rate * math.log(1 / beta), _Round(tree, worst, mass, beta)


@dataclass(frozen=True)
class AdaBoostRegressor:
    n_estimators: int = 50
    learning_rate: float = 1.0
    max_depth: int | None = 3
    max_bins: int = MAX_BINS
    seed: int = 42

    def fit(self, train: DataFrame) -> AdaBoostModel:
        """Trees are fitted with the row weights themselves instead of draws by weight."""
        packed = pack(train, max_bins=self.max_bins)
        units, limits = Units.of(1, packed.reach, 1.0, whole=False), Limits(self.max_depth)
        few = packed.n <= grown.LOCAL_ROWS
        trees = self._at_once(packed, units, limits) if few else self._on_spark(packed, units, limits)
        return AdaBoostModel(TreeModel(materialize(trees, "trees"), packed.middle, len(packed.cuts), "median"))

    def _at_once(self, packed: Packed, units: Units, limits: Limits) -> DataFrame:
        rate, middle, rounds, cuts, n = self.learning_rate, packed.middle, self.n_estimators, packed.cuts, packed.n

        def run(table: pa.Table) -> pa.Table:
            own, out = Pack.joined(list(grown._packs(table.to_batches()))), []
            own = replace(own, weight=own.weight / n)
            for number in range(rounds):
                tree = grow(own.codes, units.sums(own.label - middle, own.weight), cuts, range(len(cuts)), limits, units)
                error = _errors(own, tree, middle)
                weight, step = _judged(tree, float(error.max()), own.weight.sum(), (own.weight * error).sum(), not out, rate)
                if weight is not None:
                    out.append((number, weight, tree))
                if step is None:
                    break
                own = _reweighted(own, [step], middle, rate)
            return grown._tree_rows(out)

        return packed.rows.withColumn("lot", F.lit(0)).groupBy("lot").applyInArrow(lambda t: run(t), grown._TREE)

    def _on_spark(self, packed: Packed, units: Units, limits: Limits) -> DataFrame:
        rate, middle, width, n = self.learning_rate, packed.middle, len(packed.cuts), packed.n
        rows, pending, out = packed.rows, [], []
        start = 1.0 / n
        for number in range(self.n_estimators):
            seen, scale = list(pending), start

            def now(own: Pack, seen=seen, scale=scale) -> Pack:
                return _reweighted(replace(own, weight=own.weight * scale), seen, middle, rate)

            def drawn(own: Pack, _, now=now):
                own = now(own)
                return own.label - middle, own.weight

            [(_, _, tree)] = collected(grow_trees(replace(packed, rows=rows), [number], drawn, lambda _: range(width), limits, units))

            def told(batches, now=now, tree=tree):
                worst = mass = weighted = 0.0
                for own in map(now, grown._packs(batches)):
                    error = _errors(own, tree, middle)
                    worst, mass, weighted = max(worst, float(error.max())), mass + own.weight.sum(), weighted + (own.weight * error).sum()
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (worst, mass, weighted)], names=["worst", "mass", "weighted"])

            worst, mass, weighted = rows.mapInArrow(told, "worst double, mass double, weighted double").agg(
                F.max("worst"), F.sum("mass"), F.sum("weighted")).first()
            weight, step = _judged(tree, worst, mass, weighted, not out, rate)
            if weight is not None:
                out.append((number, weight, tree))
            if step is None:
                break
            pending.append(step)
            if len(pending) == KEPT_ROUNDS:
                def written(batches, steps=list(pending), scale=start):
                    for own in grown._packs(batches):
                        yield grown._pack_rows([_reweighted(replace(own, weight=own.weight * scale), steps, middle, rate)])

                rows, pending, start = materialize(rows.mapInArrow(written, grown._PACK), "reweighted"), [], 1.0
        return rows.sparkSession.createDataFrame(grown._tree_rows(out), grown._TREE)


@dataclass
class AdaBoostModel:
    """``model`` holds the trees and their weights."""

    model: TreeModel

    def transform(self, df: DataFrame) -> DataFrame:
        """The weighted median of the trees' predictions."""
        sent = df.sparkSession.sparkContext.broadcast(collected(self.model.trees))
        base = self.model.base

        def median(x: pa.Array) -> pa.Array:
            n = len(x)
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
            votes = np.stack([tree.value[tree.leaves(rows)] for _, _, tree in sent.value]) if n else np.zeros((1, 0))
            weight = np.array([w for _, w, _ in sent.value])
            order = np.argsort(votes, axis=0, kind="stable")
            reached = weight[order].cumsum(0) >= 0.5 * weight.sum()
            return pa.array(base + np.take_along_axis(votes, np.take_along_axis(order, reached.argmax(0)[None], 0), 0)[0])

        median.__annotations__ = {"x": pa.Array, "return": pa.Array}
        return df.withColumn("prediction", F.arrow_udf(median, "double")(vector_to_array("features")))

    def save(self, path: str) -> None:
        self.model.save(path)

    @staticmethod
    def load(path: str) -> AdaBoostModel:
        return AdaBoostModel(TreeModel.load(path))
