"""Multi-layer perceptron regression, trained in parallel on the partitions of the train rows.

In each epoch every partition runs mini-batch Adam from the current weights; the
partitions' weights are then averaged by their row counts, on Spark, in two steps. The
same job measures the validation loss of the weights it started from. A partition has about
``PART_ROWS`` rows, dealt by a hash of their number and in order, so the result follows from
the rows alone: up to that many rows it is plain mini-batch training, and beyond it every
part takes some hundreds of steps between two averages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Train rows of a partition, about.
PART_ROWS = 50_000
# Partial sums of weights pass through this many tasks before they reach the driver.
COMBINERS = 16


def _initial(sizes: Sequence[int], seed: int) -> list[np.ndarray]:
    """Glorot-uniform matrices and zero biases."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes, sizes[1:]):
        limit = np.sqrt(6 / (a + b))
        out += [rng.uniform(-limit, limit, (a, b)), np.zeros(b)]
    return out


def forward(params: list[np.ndarray], x: np.ndarray, masks: list[np.ndarray] | None = None):
    """Outputs, and the activations of each layer."""
    acts = [x]
    last = len(params) // 2 - 1
    for i in range(last + 1):
        z = acts[-1] @ params[2 * i] + params[2 * i + 1]
        if i < last:
            z = np.maximum(z, 0)
            if masks is not None:
                z = z * masks[i]
        acts.append(z)
    return acts[-1][:, 0], acts


def gradients(params, x, y, masks=None) -> list[np.ndarray]:
    """Gradient of the mean squared error."""
    out, acts = forward(params, x, masks)
    delta = (2 * (out - y) / len(y))[:, None]
    grads: list[np.ndarray] = [None] * len(params)
    for i in reversed(range(len(params) // 2)):
        grads[2 * i] = acts[i].T @ delta
        grads[2 * i + 1] = delta.sum(axis=0)
        if i:
            delta = (delta @ params[2 * i].T) * (acts[i] > 0)
            if masks is not None:
                delta = delta * masks[i - 1]
    return grads


def _flat(parts):
    return np.concatenate([p.ravel() for p in parts])


def _shaped(flat, sizes):
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out += [flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]]
        at += a * b + b
    return out


@dataclass(frozen=True)
class MlpRegressor:
    """``fit`` wants row_id, features and label; the last rows by row_id serve as validation.

    The label is brought to mean 0 and spread 1 for the fit, so the learning rate suits any unit.
    """

    hidden: tuple[int, ...] = (160, 120, 80, 40, 20)
    epochs: int = 200
    batch_size: int = 128
    learning_rate: float = 0.001
    patience: int = 20
    dropout: float = 0.0
    validation_share: float = 0.2
    seed: int = 42

    def fit(self, train: DataFrame) -> MlpModel:
        rows = train.select("row_id", vector_to_array("features").alias("x"), F.col("label").alias("y"))
        # row_id counts positions, so its value at the cut is known without sorting.
        first, count, width, mean, spread = rows.agg(
            F.min("row_id"), F.count(F.lit(1)), F.max(F.size("x")), F.avg("y"), F.stddev_pop("y")).first()
        spread = spread or 1.0
        cut = first + int(count * (1 - self.validation_share))
        # Random placement, so that every partition sees all parts of the series.
        rows = rows.repartition(max(1, -(-count // PART_ROWS)), F.xxhash64("row_id")).sortWithinPartitions("row_id") \
            .select("x", ((F.col("y") - F.lit(mean)) / F.lit(spread)).alias("y"),
                    (F.col("row_id") >= F.lit(cut)).alias("held")).persist()
        sizes = (width, *self.hidden, 1)
        weights = _flat(_initial(sizes, self.seed))
        # Weights, first and second moments, and the number of steps taken.
        state = np.concatenate([weights, np.zeros(2 * len(weights) + 1)])
        best, best_loss, waited, history = weights, np.inf, 0, []
        try:
            for epoch in range(self.epochs + 1):
                start = state[:len(weights)]
                loss, state = self._epoch(rows, state, sizes, epoch)
                if loss is not None:
                    history.append(loss)
                    if loss < best_loss:
                        best, best_loss, waited = start, loss, 0
                    else:
                        waited += 1
                        if waited >= self.patience:
                            break
                else:
                    best = state[:len(weights)]
        finally:
            rows.unpersist()
        return MlpModel(sizes, best, mean, spread, tuple(h * spread * spread for h in history))

    def _epoch(self, rows, state, sizes, epoch):
        """One pass over all partitions: (validation loss before it, averaged state after it)."""
        shared = rows.sparkSession.sparkContext.broadcast(state)
        params = self

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current = shared.value
            n = len(current) // 3
            weights, m, v, step = current[:n], current[n:2 * n], current[2 * n:3 * n], current[3 * n]
            frozen = _shaped(shared.value[:n], sizes)
            rng = np.random.default_rng(params.seed + epoch)
            seen = held = 0
            loss = 0.0
            for batch in batches:
                x, y = np.vstack(batch["x"]), batch["y"].to_numpy()
                out = batch["held"].to_numpy()
                if out.any():
                    loss += float(((forward(frozen, x[out])[0] - y[out]) ** 2).sum())
                    held += int(out.sum())
                x, y = x[~out], y[~out]
                seen += len(y)
                order = rng.permutation(len(y))
                for at in range(0, len(y), params.batch_size):
                    pick = order[at:at + params.batch_size]
                    masks = None
                    if params.dropout:
                        masks = [(rng.random((len(pick), h)) >= params.dropout) / (1 - params.dropout)
                                 for h in params.hidden]
                    g = _flat(gradients(_shaped(weights, sizes), x[pick], y[pick], masks))
                    step += 1
                    m = 0.9 * m + 0.1 * g
                    v = 0.999 * v + 0.001 * g * g
                    weights = weights - params.learning_rate * (m / (1 - 0.9 ** step)) \
                        / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
            total = np.concatenate([weights, m, v, [step]]) * seen
            yield pd.DataFrame({"seen": [seen], "held": [held], "loss": [loss], "state": [total.tobytes()]})

        def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = held = 0
            loss, total = 0.0, None
            for batch in batches:
                for row in batch.itertuples(index=False):
                    add = np.frombuffer(row.state)
                    total = add if total is None else total + add
                    seen, held, loss = seen + row.seen, held + row.held, loss + row.loss
            if total is not None:
                yield pd.DataFrame({"seen": [seen], "held": [held], "loss": [loss], "state": [total.tobytes()]})

        schema = "seen long, held long, loss double, state binary"
        parts = rows.mapInPandas(work, schema).repartition(COMBINERS, F.spark_partition_id()) \
            .mapInPandas(combine, schema).collect()
        shared.unpersist()
        seen = sum(r["seen"] for r in parts)
        held = sum(r["held"] for r in parts)
        if not seen:
            raise ValueError("no train rows")
        merged = sum(np.frombuffer(r["state"]) for r in parts) / seen
        return (sum(r["loss"] for r in parts) / held if held else None), merged


@dataclass(frozen=True)
class MlpModel:
    sizes: tuple[int, ...]
    weights: np.ndarray
    mean: float = 0.0
    spread: float = 1.0
    history: tuple[float, ...] = ()

    def save(self, path: str) -> None:
        row = (list(self.sizes), self.weights.tolist(), float(self.mean), float(self.spread), list(self.history))
        SparkSession.active().createDataFrame(
            [row], "sizes array<long>, weights array<double>, mean double, spread double, history array<double>") \
            .write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str) -> MlpModel:
        row = SparkSession.active().read.parquet(path).first()
        return MlpModel(tuple(row["sizes"]), np.array(row["weights"]), row["mean"], row["spread"], tuple(row["history"]))

    def transform(self, df: DataFrame) -> DataFrame:
        sizes, weights, mean, spread = self.sizes, self.weights, self.mean, self.spread

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            return pd.Series(mean + spread * forward(_shaped(weights, sizes), np.vstack(x))[0])

        return df.withColumn("prediction", predict(vector_to_array("features")))
