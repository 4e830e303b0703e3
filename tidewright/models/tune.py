"""Grid search with expanding-window folds."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.models.estimators import make_estimator
from tidewright.operators.metrics import metric_columns
from tidewright.operators.split import fold_bounds

# Rows a task of a fit should have at least; fewer would cost more to schedule than to read.
TASK_ROWS = 25_000


def grid_points(grid: dict[str, list]) -> list[dict]:
    """Every combination of the listed values, the last parameter changing fastest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


@dataclass(frozen=True)
class SearchResult:
    model: object
    best: dict
    scores: list[tuple[dict, list[float]]]


def score(model, frame: DataFrame, metric: str = "r2") -> float:
    row = model.transform(frame).agg(*metric_columns("label", "prediction")).first()
    return row[metric] if metric == "r2" else -row[metric]


def grid_search(train: DataFrame, name: str, grid: dict[str, list], folds: int, metric: str = "r2",
                augment: Callable[[DataFrame], DataFrame] | None = None, parallel: int = 8) -> SearchResult:
    """Fit every grid point on every fold, keep the best mean score, refit on all train rows.

    ``train`` has row_id (positions from 0), features and label. Fits run as concurrent
    Spark jobs over one persisted frame. ``augment`` multiplies the rows a model is
    fitted on, never those it is scored on. Only one grid point means no folds.
    """
    points = grid_points(grid)
    augment = augment or (lambda df: df)
    rows = train.count()
    # As many tasks as the rows need. They are placed by a hash of their number, so the early rows of a fold are spread too.
    train = train.repartition(max(1, -(-rows // TASK_ROWS)), "row_id").persist()
    try:
        scores: list[tuple[dict, list[float]]] = []
        best = points[0]
        if len(points) > 1:
            bounds = fold_bounds(rows, folds)

            def run(task):
                point, (first, end) = task
                model = make_estimator(name, **point).fit(augment(train.where(F.col("row_id") < first)))
                return score(model, train.where(F.col("row_id").between(first, end - 1)), metric)

            with ThreadPoolExecutor(parallel) as pool:
                values = list(pool.map(run, product(points, bounds)))
            scores = [(p, values[i * folds:(i + 1) * folds]) for i, p in enumerate(points)]
            best = max(scores, key=lambda s: sum(s[1]) / folds)[0]
        model = make_estimator(name, **best).fit(augment(train))
        return SearchResult(model, best, scores)
    finally:
        train.unpersist()
