"""Sinks: predictions, results, metric tables and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predictions_frame(scored: DataFrame, time: str, truth: str, prediction: str,
                      model: str, period: str | None = None) -> DataFrame:
    """The layout of saved predictions: time, true, prediction, model, period."""
    label = F.lit(period) if period is not None else F.col("period")
    return scored.select(
        F.col(time).alias("time"), F.col(truth).cast("double").alias("true"),
        F.col(prediction).cast("double").alias("prediction"),
        F.lit(model).alias("model"), label.alias("period"),
    )


def write_predictions(frame: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per model and period; writing a pair again replaces only that pair."""
    writer = frame.write.partitionBy("model", "period").mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def append_results(results: DataFrame, path: str, fmt: str = "csv") -> None:
    """Add rows to a results table; files are added, nothing is read or rewritten."""
    writer = results.write.mode("append").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Metric, importance and residual tables."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def model_path(folder: str, model: str, period: str) -> str:
    return f"{folder}/{model}_{period.replace(' ', '_')}"


def save_model(fitted, folder: str, model: str, period: str) -> str:
    """Save any model of this package or of Spark ML; one that cannot be saved is an error."""
    path = model_path(folder, model, period)
    if hasattr(fitted, "write"):
        fitted.write().overwrite().save(path)
    else:
        fitted.save(path)
    return path


def load_model(name: str, path: str):
    """The fitted model of the given name (as for ``make_estimator``) that ``save_model`` wrote."""
    from tidewright.models.adaboost import AdaBoostModel
    from tidewright.models.knn import KnnModel
    from tidewright.models.mlp import MlpModel
    from tidewright.models.trees import TreeModel

    kinds = {"RandomForest": TreeModel, "DecisionTree": TreeModel, "XGBoost": TreeModel,
             "AdaBoost": AdaBoostModel, "KNN": KnnModel, "DNN": MlpModel}
    if name not in kinds:
        raise ValueError(f"unknown model {name!r}")
    return kinds[name].load(path)
