"""Models by name, with the parameter names users of the pipeline know."""

from __future__ import annotations

from dataclasses import fields

from tidewright.models.adaboost import AdaBoostRegressor
from tidewright.models.knn import KnnRegressor
from tidewright.models.mlp import MlpRegressor
from tidewright.models.trees import BoostedRegressor, ForestRegressor, Limits

SEED = 42

# Grids used when none are configured.
DEFAULT_GRIDS = {
    "KNN": {"n_neighbors": [3, 5, 7]},
    "RandomForest": {"n_estimators": [100, 200], "max_depth": [10, 20]},
    "XGBoost": {"n_estimators": [100, 200], "learning_rate": [0.01, 0.1]},
    "AdaBoost": {"n_estimators": [50, 100], "learning_rate": [0.1, 1.0]},
    "DecisionTree": {"max_depth": [10, 20], "min_samples_split": [2, 5]},
    "DNN": {},
}

# Names that configurations of the network use for its settings.
NETWORK_NAMES = {"hidden_layers": "hidden", "dropout_rate": "dropout", "early_stopping_patience": "patience",
                 "validation_split": "validation_share"}


def _limits(params: dict, names: dict[str, object]) -> Limits:
    """The settings of ``params`` that limit a tree, by name and default, taken out of them."""
    return Limits(**{name: params.pop(name, default) for name, default in names.items()})


def _network(params: dict) -> dict:
    """Settings of the network under either of their names; layers may be a list of numbers or of {units: n}."""
    out = {NETWORK_NAMES.get(k, k): v for k, v in params.items()}
    if len(out) < len(params):
        raise ValueError(f"DNN: a setting is given under two names in {sorted(params)}")
    unknown = set(out) - {f.name for f in fields(MlpRegressor)}
    if unknown:
        raise ValueError(f"DNN does not know the parameters {sorted(unknown)}")
    if "hidden" in out:
        layers = [out["hidden"]] if isinstance(out["hidden"], int) else out["hidden"]
        out["hidden"] = tuple(h["units"] if isinstance(h, dict) else h for h in layers)
    return out


def make_estimator(name: str, **params):
    """An estimator with ``fit(frame)``; the fitted model has ``transform(frame)``."""
    params = dict(params)
    bins = {"max_bins": params.pop("max_bins")} if "max_bins" in params and name in ("RandomForest", "DecisionTree", "XGBoost") else {}
    if name in ("RandomForest", "DecisionTree"):
        limits = _limits(params, {"max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1})
        many = name == "RandomForest"
        made = ForestRegressor(params.pop("n_estimators", 100) if many else 1, limits, bootstrap=many, seed=SEED, **bins)
    elif name == "XGBoost":
        limits = _limits({**params, "penalty": params.pop("reg_lambda", 1.0)}, {"max_depth": 6, "min_child_weight": 1.0, "penalty": 1.0})
        for taken in ("max_depth", "min_child_weight"):
            params.pop(taken, None)
        made = BoostedRegressor(params.pop("n_estimators", 100), params.pop("learning_rate", 0.3), limits,
                                params.pop("subsample", 1.0), params.pop("colsample_bytree", 1.0), seed=SEED, **bins)
    elif name == "AdaBoost":
        return AdaBoostRegressor(**params)
    elif name == "KNN":
        return KnnRegressor(**params)
    elif name == "DNN":
        return MlpRegressor(**_network(params))
    else:
        raise ValueError(f"unknown model {name!r}")
    if params:
        raise ValueError(f"{name} does not know the parameters {sorted(params)}")
    return made
