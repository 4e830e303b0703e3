import pytest

from tidewright.catalog.series import _plan
from tidewright.operators.columns import numeric_columns, resolve_features
from tidewright.plans.steps import Registry, Step
from tidewright.spec import AUTO, FeaturePlan, Period, expand_auto, lookup_override


def test_plan_rejects_bad_steps():
    for bad in ({"lags": {"a": [0]}}, {"lags": {"a": 3}}, {"windows": {"a": [True]}}, {"statistics": ("mode",)}):
        with pytest.raises(ValueError):
            FeaturePlan(**bad)
    with pytest.raises(ValueError):
        Period("x", "13-01", "02-01")


def test_names_and_halo():
    plan = FeaturePlan(lags={"a": [1, 4], "gone": [9]}, windows={"a": [3]}, statistics=("std", "mean"))
    assert plan.names(["a"]) == ["hour_sin", "hour_cos", "doy_sin", "doy_cos",
                                 "a_lag1", "a_lag4", "a_roll3", "a_std3"]
    assert plan.halo == 9
    assert _plan().halo == 0


def test_auto_and_overrides():
    assert expand_auto({AUTO: [1, 2], "b": [4]}, ["a", "b"]) == {"a": [1, 2], "b": [4]}
    assert expand_auto({"b": [4]}, ["a"]) == {"b": [4]}
    assert lookup_override({"KNN": {"x": "30T"}}, "KNN", "x", None) == "30T"
    assert lookup_override({"KNN": {"x": "30T"}}, "KNN", "y", "1H") == "1H"


def test_columns(tiny):
    assert numeric_columns(tiny) == ["v", "w"]
    assert numeric_columns(tiny, include=["w", "zz"]) == ["w"]
    assert resolve_features(tiny, AUTO, "v", "ts") == ["w"]
    assert resolve_features(tiny, None, "v", "ts", exclude=["w"]) == []
    assert resolve_features(tiny, ["v"], "v", "ts") == ["v"]
    assert resolve_features(tiny, "other", "v", "ts") == []


def test_registry(tiny):
    registry = Registry()
    double = Step("double", lambda df: df.selectExpr("ts", "2 * w as w"), needs=("w",), names=lambda c: ["w"])
    registry.register(double)
    registry.register(Step("off", lambda df: df.limit(0), enabled=False))
    assert [r.w for r in registry.run_chain(["double", "off", "double"], tiny).collect()] == [4.0 * i for i in range(8)]
    assert registry.of_kind("features")[0] is double and registry.get("none") is None
    assert double.feature_names(["w"]) == ["w"]
    with pytest.raises(KeyError):
        registry.run("none", tiny)
    with pytest.raises(ValueError, match="needs"):
        registry.run("double", tiny.drop("w"))
    with pytest.warns(UserWarning):
        registry.register(double)
    with pytest.raises(TypeError):
        registry.register("double")

    def fails():
        raise ValueError("bad")

    registry.register(Step("broken", lambda df: df, check=fails))
    registry.register(Step("wrong", lambda df: df, check=lambda: False))
    assert registry.invalid() == ["broken", "wrong"]
