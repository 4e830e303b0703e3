import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewright.catalog.learning import SENSOR_PLAN
from tidewright.models import attribution as at
from tidewright.models import forecast as fc
from tidewright.models.adaboost import AdaBoostModel
from tidewright.models.estimators import make_estimator
from tidewright.models import knn
from tidewright.models.knn import KnnRegressor, split_cells
from tidewright.models.trees import collected
from tidewright.models.tune import grid_points, grid_search
from tidewright.operators.augment import add_noise
from tidewright.operators.columns import assemble
from tidewright.operators.metrics import metric_columns, regression_metrics
from tidewright import session
from tidewright.plans import experiment
from tidewright.plans.experiment import ExperimentConfig, run_experiment
from tidewright.sources import readers, writers
from tidewright.spec import DateRange, FeaturePlan, Period, SeriesSpec

NAMES = ["x1", "x2", "x3"]


def vectors(spark, pdf, columns):
    return spark.createDataFrame(pdf).select(
        "row_id", array_to_vector(F.array(*columns)).alias("features"), F.col("y").alias("label"))


@pytest.fixture(scope="module")
def planted(spark):
    """y = 3 x1 - 2 x2 and a little noise; x3 plays no part."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (800, 3))
    pdf = pd.DataFrame(x, columns=NAMES).assign(row_id=np.arange(800))
    pdf["y"] = 3 * x[:, 0] - 2 * x[:, 1] + 0.05 * rng.normal(0, 1, 800)
    return vectors(spark, pdf, NAMES).cache()


def r2(model, frame):
    return model.transform(frame).agg(*metric_columns("label", "prediction")).first().r2


def brute_force(train, query, k, p, weights):
    """Indices and prediction by comparing everything, ties by train id."""
    dist = np.zeros((len(query), len(train)))
    for c in NAMES[:2]:
        diff = query[c].to_numpy()[:, None] - train[c].to_numpy()[None, :]
        dist += diff * diff if p == 2 else abs(diff)
    out = []
    for row in dist:
        near = np.lexsort((train.row_id.to_numpy(), row))[:k]
        y, d = train.y.to_numpy()[near], row[near]
        if weights == "uniform":
            out.append(y.mean())
        elif (d == 0).any():
            out.append(y[d == 0].mean())
        else:
            d = d ** (1 / p)
            out.append((y / d).sum() / (1 / d).sum())
    return np.array(out)


@pytest.mark.parametrize("weights,metric,k,cells", [
    ("uniform", "euclidean", 5, 40), ("distance", "manhattan", 3, 15), ("uniform", "euclidean", 7, 10_000)])
def test_knn_equals_brute_force(spark, weights, metric, k, cells):
    rng = np.random.default_rng(6)
    n = 600
    pdf = pd.DataFrame({"x1": rng.integers(0, 12, n) / 2, "x2": rng.normal(0, 3, n).round(1),
                        "y": rng.normal(0, 1, n), "row_id": rng.permutation(n)})
    pdf.loc[: n // 3, ["x1", "x2"]] = [1.5, 0.2]  # a third of all rows are copies of one point
    query = pd.DataFrame({"x1": rng.integers(-2, 14, 150) / 2, "x2": rng.normal(0, 4, 150).round(1),
                          "y": 0.0, "row_id": np.arange(150)})
    query.loc[:50, ["x1", "x2"]] = [1.5, 0.2]
    for sent in (0, knn.BROADCAST_BYTES):  # searched by joins, and with all train rows at hand
        model = KnnRegressor(k, weights, metric, cell_rows=cells, broadcast_bytes=sent).fit(vectors(spark, pdf, NAMES[:2]))
        got = model.transform(vectors(spark, query, NAMES[:2])).orderBy("row_id").toPandas()["prediction"]
        np.testing.assert_allclose(got, brute_force(pdf, query, k, 1 if metric == "manhattan" else 2, weights), rtol=1e-9)


@pytest.mark.parametrize("p", [0.5, 1.0, 2.0, 3.0])
def test_blocks_are_passed_over_by_their_pivots(spark, monkeypatch, p):
    """Twelve features, many blocks in few cells: the neighbours of a comparison of all pairs, with few of them compared."""
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 20, (12, 12))
    x = (centers[rng.integers(0, 12, 900)] + rng.normal(0, 1, (900, 12))).round(2)
    x[:200] = x[0]
    asked = np.vstack([x[rng.integers(0, 900, 60)] + rng.normal(0, 1, (60, 12)).round(2), x[:3], rng.normal(0, 40, (5, 12))])
    frame = lambda x, y: spark.createDataFrame(
        [(i, [float(v) for v in row], float(i)) for i, row in enumerate(x)], "row_id long, x array<double>, label double").select(
        "row_id", array_to_vector("x").alias("features"), "label")
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    model = KnnRegressor(4, metric="minkowski", p=p, cell_rows=400, broadcast_bytes=0).fit(frame(x, 0))
    assert model.blocks.count() > 12
    got = model._search_cells(frame(asked, 0).select(vector_to_array("features").alias("x")).distinct()).collect()
    for r in got:
        dist = knn._distances(np.array(r.x)[None], x, p)[0]
        order = np.lexsort((np.arange(900), dist))[:4]
        assert [e.id for e in r.near] == order.tolist() and [e.d for e in r.near] == pytest.approx(dist[order])
    assert sum(r.compared for r in got) < 0.4 * len(got) * 900


def test_few_pairs_of_a_small_table_are_compared(spark):
    """Three cells exclude little, so the blocks in them have to."""
    rng = np.random.default_rng(8)
    x, asked = rng.random((1200, 4)), rng.random((300, 4))
    frame = lambda x: spark.createDataFrame(
        [(i, row.tolist(), float(i)) for i, row in enumerate(x)], "row_id long, x array<double>, label double")
    model = KnnRegressor(5, broadcast_bytes=0).fit(frame(x).withColumn("features", array_to_vector("x")))
    got = model._search_cells(frame(asked).select("x")).collect()
    for r in got:
        dist = knn._distances(np.array(r.x)[None], x, 2)[0]
        assert [e.id for e in r.near] == np.lexsort((np.arange(1200), dist))[:5].tolist()
    assert len(got) == 300 and sum(r.compared for r in got) < 0.2 * 300 * 1200


def test_knn_with_fewer_rows_than_neighbours(spark):
    pdf = pd.DataFrame({"x1": [0.0, 1.0], "x2": [0.0, 0.0], "y": [1.0, 3.0], "row_id": [0, 1]})
    model = KnnRegressor(5).fit(vectors(spark, pdf, NAMES[:2]))
    assert [r.prediction for r in model.transform(vectors(spark, pdf, NAMES[:2])).collect()] == [2.0, 2.0]
    with pytest.raises(ValueError):
        KnnRegressor(0)


def test_cells_cover_copies():
    x = np.array([[1.0, 1.0]] * 50 + [[2.0, 1.0], [3.0, 4.0]])
    cells = split_cells(x, 8)
    assert cells.count == 3 and len(set(cells.locate(x))) == 3


@pytest.mark.parametrize("name,params,least", [
    ("DecisionTree", {"max_depth": 6}, 0.85), ("RandomForest", {"n_estimators": 10, "max_depth": None}, 0.9),
    ("XGBoost", {"n_estimators": 15, "max_depth": 4, "learning_rate": 0.3}, 0.9),
    ("AdaBoost", {"n_estimators": 8}, 0.7), ("KNN", {"n_neighbors": 5}, 0.85),
    ("DNN", {"hidden": (24, 12), "epochs": 25, "batch_size": 16}, 0.95)])
def test_models_find_the_planted_rule(planted, name, params, least):
    train = planted.where("row_id < 640")
    assert r2(make_estimator(name, **params).fit(train), planted.where("row_id >= 640")) > least


def test_unknown_parameters():
    with pytest.raises(ValueError):
        make_estimator("RandomForest", depth=3)
    with pytest.raises(ValueError):
        make_estimator("SVM")
    forest = make_estimator("RandomForest", max_depth=50, min_samples_split=10, min_samples_leaf=2)
    assert (forest.limits.max_depth, forest.limits.min_samples_split, forest.limits.min_samples_leaf) == (50, 10, 2)
    boosted = make_estimator("XGBoost", min_child_weight=3, colsample_bytree=0.8, subsample=0.8, max_depth=6)
    assert boosted.limits.min_child_weight == 3 and boosted.limits.min_samples_leaf == 1 and boosted.colsample_bytree == 0.8


def test_adaboost_stops_and_round_trips(planted, tmp_path):
    model = make_estimator("AdaBoost", n_estimators=4, max_depth=2).fit(planted)
    model.save(str(tmp_path / "ada"))
    again = AdaBoostModel.load(str(tmp_path / "ada"))
    weights = [[w for _, w, _ in collected(m.model.trees)] for m in (again, model)]
    assert weights[0] == weights[1] and r2(again, planted) == pytest.approx(r2(model, planted))
    constant = planted.withColumn("label", F.lit(2.0))
    flat = make_estimator("AdaBoost").fit(constant)
    assert len(flat.model.sizes()) == 1 and flat.transform(constant).where("prediction = 2").count() == 800


def test_mlp_stops_early(planted):
    model = make_estimator("DNN", hidden=(8,), epochs=40, patience=2, learning_rate=0.05, batch_size=8).fit(planted)
    assert 0 < len(model.history) < 41
    dropped = make_estimator("DNN", hidden=(8,), epochs=2, dropout=0.5).fit(planted)
    assert dropped.transform(planted).where("prediction is null").count() == 0


def test_grid_search_equals_own_loop(planted):
    assert grid_points({"a": [1, 2], "b": ["x", "y"]})[1] == {"a": 1, "b": "y"}
    found = grid_search(planted, "DecisionTree", {"max_depth": [1, 5]}, folds=3)
    assert found.best == {"max_depth": 5} and [len(s) for _, s in found.scores] == [3, 3]
    one = make_estimator("DecisionTree", max_depth=1).fit(planted.where("row_id < 200"))
    assert found.scores[0][1][0] == pytest.approx(r2(one, planted.where("row_id between 200 and 399")))
    assert grid_search(planted, "DecisionTree", {}, folds=3).scores == []


def test_importances_rank_the_planted_features(spark, planted):
    model = make_estimator("RandomForest", n_estimators=8, max_depth=6).fit(planted)
    for table in (at.permutation_importance(model, planted, NAMES, repeats=3), at.shap_importance(model, planted, NAMES),
                  at.tree_importance(model, NAMES, spark), at.shap_sampled(model, planted, NAMES, 30, 8)):
        assert [r.feature for r in table.collect()] == NAMES
    chosen = at.shap_selected(model, planted, NAMES, ["x3", "none", "x1"])
    assert [r.feature for r in chosen.collect()] == ["x3", "x1"]


def test_permutations_are_permutations():
    for n in (2, 7, 12, 1000):
        for a, b in at._multipliers(n, 5, 1):
            assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_partial_dependence(planted):
    forest = make_estimator("RandomForest", n_estimators=8, max_depth=6).fit(planted)
    curve = at.partial_dependence(forest, planted, NAMES, "x1", 20).toPandas()
    assert len(curve) == 20 and np.corrcoef(curve["value"], curve["average"])[0, 1] > 0.95
    net = make_estimator("DNN", hidden=(16,), epochs=15, batch_size=16).fit(planted)
    scored = at.partial_dependence(net, planted, NAMES, "x2", 10).toPandas()
    assert np.corrcoef(scored["value"], scored["average"])[0, 1] < -0.95


def season(spark, mode):
    hours = np.arange(24 * 28)
    trend = 10 + 0.01 * hours
    wave = np.sin(2 * np.pi * hours / 24)
    y = trend + 3 * wave if mode == "additive" else trend * (1 + 0.3 * wave)
    pdf = pd.DataFrame({"ds": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h"), "y": y,
                        "r": np.cos(hours)})
    return spark.createDataFrame(pdf).withColumn("ds", F.col("ds").cast("timestamp_ntz"))


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_forecast_finds_trend_and_season(spark, mode):
    df = season(spark, mode)
    model = fc.fit_forecast(df.where("ds < '2024-01-22'"), "ds", "y", fc.ForecastConfig(seasonality_mode=mode, daily=True))
    assert "daily" in model.seasons and "yearly" not in model.seasons
    out = model.transform(df.where("ds >= '2024-01-22'"))
    assert regression_metrics(out, "y", "yhat").first().r2 > 0.95
    parts = model.components(df)
    total = F.col("trend") * (1 + sum(F.col(s) for s in model.seasons)) if mode == "multiplicative" \
        else F.col("trend") + sum(F.col(s) for s in model.seasons)
    assert parts.where(F.abs(total - F.col("yhat")) > 1e-6).count() == 0
    assert out.where("yhat_lower > yhat_upper").count() == 0


def test_forecast_regressor_and_periods(spark):
    df = season(spark, "additive").withColumn("y", F.col("y") + 5 * F.col("r"))
    model = fc.fit_forecast(df, "ds", "y", fc.ForecastConfig(daily=True, regressors=("r",)))
    assert regression_metrics(model.transform(df), "y", "yhat").first().r2 > 0.97
    ranges = [DateRange("1", "2024-01-01", "2024-01-20"), DateRange("2", "2025-01-01", "2025-01-20")]
    table = fc.forecast_periods(df, "ds", "y", ["ds"], ranges, [fc.ForecastConfig(), fc.ForecastConfig()])
    rows = {r.period: r for r in table.collect()}
    assert rows["1"].status == "ok" and rows["1"].test_r2 is not None
    assert rows["2"].status == "too few rows" and rows["2"].test_r2 is None
    none = fc.forecast_periods(df, "ds", "y", ["ds"], ranges[1:], [fc.ForecastConfig()])
    assert none.columns == table.columns and none.count() == 1


def readers_model(name, folder):
    return writers.load_model(name, writers.model_path(str(folder / "m"), name, "Jan A"))


def test_no_table_is_left_after_an_experiment(spark, monkeypatch):
    written = []
    monkeypatch.setattr(session, "_written", written)
    config = ExperimentConfig(SeriesSpec("ds", (), (), "y", ("r",)), [Period("Jan", "01-01", "01-20")], "KNN", {"n_neighbors": [3, 5]}, folds=2)
    assert run_experiment(season(spark, "additive"), config).first().Status == "ok" and written == []


def test_bad_settings_are_an_error_before_any_work():
    spec = SeriesSpec("ds", (), (), "y", ("r",))
    with pytest.raises(ValueError, match="does not know"):
        ExperimentConfig(spec, (), "DNN", {"hidden_layers": [[8]], "layers": [1]})
    with pytest.raises(ValueError, match="does not know"):
        ExperimentConfig(spec, (), "RandomForest", {"depth": [50]})
    assert ExperimentConfig(spec, (), "KNN").grid == {"n_neighbors": [3, 5, 7]}


def test_settings_of_the_network_have_two_names():
    a = make_estimator("DNN", hidden_layers=[{"units": 64}, 32], dropout_rate=0.2, early_stopping_patience=10, epochs=3)
    assert (a.hidden, a.dropout, a.patience, a.epochs) == ((64, 32), 0.2, 10, 3)
    with pytest.raises(ValueError, match="two names"):
        make_estimator("DNN", dropout=0.1, dropout_rate=0.2)


@pytest.mark.parametrize("name,params", [("KNN", {"n_neighbors": 4, "weights": "distance"}), ("DNN", {"hidden": (8,), "epochs": 3}),
                                         ("AdaBoost", {"n_estimators": 2}), ("XGBoost", {"n_estimators": 2, "max_depth": 3})])
def test_every_model_comes_back_from_its_folder(planted, tmp_path, name, params):
    model = make_estimator(name, **params).fit(planted)
    again = writers.load_model(name, writers.save_model(model, str(tmp_path), name, "all rows"))
    both = [{r.row_id: r.prediction for r in m.transform(planted).collect()} for m in (model, again)]
    assert both[0] == pytest.approx(both[1])


def test_attribution_of_neighbours(planted):
    """The label depends on x1 most, on x3 not at all; rows of equal number with other features must not mix."""
    model = make_estimator("KNN", n_neighbors=5).fit(planted)
    for table in (at.permutation_importance(model, planted, NAMES, repeats=2), at.shap_sampled(model, planted, NAMES, 40, 4)):
        rows = {r.feature: r.importance for r in table.collect()}
        assert rows["x1"] > rows["x2"] > 3 * abs(rows["x3"]) and rows["x2"] > 0.1
    twice = planted.where("row_id < 2").withColumn("row_id", F.lit(7))
    got = sorted(r.prediction for r in model.transform(twice).collect())
    assert got == pytest.approx(sorted(r.prediction for r in model.transform(planted.where("row_id < 2")).collect()))


@pytest.mark.parametrize("model,grid,extra", [
    ("DecisionTree", {"max_depth": [3, 6]}, {}), ("KNN", {"n_neighbors": [3]}, {"resampling": "1H"}),
    ("DecisionTree", {"max_depth": [3, 4]}, {"copies": 2, "noise": 0.01, "scaler": "minmax"})])
def test_experiment(spark, tmp_path, model, grid, extra):
    df = season(spark, "additive").withColumn("id", F.monotonically_increasing_id())
    config = ExperimentConfig(
        SeriesSpec("ds", ("id",), (), "y", ("r",)), [Period("Jan A", "01-01", "01-20"), Period("B", "01-10", "01-31"),
                                                     Period("empty", "06-01", "06-30")],
        model, grid, FeaturePlan(lags={"r": [1]}, windows={"r": [3]}), folds=3,
        predictions_path=str(tmp_path / "p"), models_path=str(tmp_path / "m"), **extra)
    rows = {r.Period: r for r in run_experiment(df, config).collect()}
    assert {n: r.Status for n, r in rows.items()} == {"Jan A": "ok", "B": "ok", "empty": "too few rows"}
    assert rows["empty"].Train_R2 is None and readers_model(model, tmp_path).transform is not None
    first = rows["Jan A"]
    hours = 24 * 20
    train = int(hours * 0.8)
    assert first.Features_Count == 1 + 4 + 1 + 2
    assert first.Test_Samples == hours - train - 1
    assert first.Train_Samples == (train - 1) * (1 + extra.get("copies", 0))
    assert first.Train_R2 > 0.5 and first.Resampling == extra.get("resampling", "None")
    saved = readers.read_csv(spark, str(tmp_path / "p"),
                             "time timestamp_ntz, true double, prediction double, model string, period string")
    assert saved.where("period = 'Jan A'").count() == first.Test_Samples


def test_experiment_with_features_first(spark):
    df = season(spark, "additive")
    config = ExperimentConfig(SeriesSpec("ds", (), (), "y", ("r",)), (), "DecisionTree", {"max_depth": [4]},
                              FeaturePlan(lags={"r": [1]}, windows={"r": [3]}), features_first=True)
    row = run_experiment(df, config).first()
    rows = 24 * 28 - 2
    assert (row.Period, row.Features_Count) == ("all", 1 + 4 + 1 + 2)
    assert (row.Train_Samples, row.Test_Samples) == (int(rows * 0.8), rows - int(rows * 0.8))


def test_sensor_plan_names():
    assert len(SENSOR_PLAN.names(["quantity", "lines"])) == 4 + 2 + 6


def test_noise_is_made_once(spark):
    """A fit reads its rows several times; their noise is in a table by then."""
    rows = spark.range(40).selectExpr("id AS row_id", "double(id) AS a", "double(id % 7) AS label")
    frame = assemble(rows, ["a"], "label", keep=["row_id", "a"])
    noisy = experiment._noisy(frame, ["a"], 2, lambda df: add_noise(df, ["a"], ["row_id"], 2, 0.1))
    assert "md5" not in noisy._jdf.queryExecution().toString()
    assert noisy.count() == 120 and noisy.select("row_id").distinct().count() == 120
