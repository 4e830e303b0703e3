"""Models, tuning, scores, forecasts and attribution."""

from __future__ import annotations

import math
import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewright.catalog.base import (
    KNOWN, MEASURES, ORDER_PERIODS, SENSORS, events, known_sensors, query, rounded, sensors, sql)
from tidewright.catalog.tables import RANGES
from tidewright.models import attribution as at
from tidewright.models import forecast as fc
from tidewright.models.estimators import make_estimator
from tidewright.models.tune import grid_search
from tidewright.operators.clean import CleaningOptions, clean
from tidewright.operators.columns import assemble
from tidewright.operators.metrics import regression_metrics
from tidewright.operators.periods import filter_dates
from tidewright.operators.reshape import top_k
from tidewright.operators.split import temporal_split
from tidewright.plans.experiment import ExperimentConfig, prepare, run_experiment
from tidewright.session import materialize, shared_folder
from tidewright.sources.writers import load_model, save_model
from tidewright.spec import FeaturePlan, Period, SeriesSpec

FEATURES = ["quantity", "discount", "tax", "lines"]


def _frame(spark, sf):
    """Vectors of all orders with lines, split in time; row_id is the position in the series.

    Fits read their rows several times, so the table is written once.
    """
    split = temporal_split(known_sensors(spark, sf), ["ts", "key"], 0.8).withColumn("row_id", F.col("pos"))
    return materialize(assemble(split, FEATURES, "amount", keep=["row_id", "key", "split"]), "vectors",
                       spread="row_id")


def _train(frame):
    return frame.where(F.col("split") == "train")


def _fit_query(name, model, **params):
    @query(name)
    def run(spark, sf):
        frame = _frame(spark, sf)
        fitted = make_estimator(model, **params).fit(_train(frame))
        return regression_metrics(fitted.transform(frame), by=["split"]).withColumn("model", F.lit(model))
    return run


_fit_query("fit_random_forest", "RandomForest", n_estimators=20, max_depth=6, min_samples_split=10, min_samples_leaf=2)
_fit_query("fit_decision_tree", "DecisionTree", max_depth=8, min_samples_split=10, min_samples_leaf=2)
_fit_query("fit_gbt", "XGBoost", n_estimators=20, max_depth=4, learning_rate=0.1, min_child_weight=3, subsample=0.8)
_fit_query("fit_adaboost", "AdaBoost", n_estimators=10)
_fit_query("fit_mlp", "DNN", hidden=(64, 32), epochs=6)
_fit_query("fit_mlp_dropout", "DNN", hidden=(32, 16), epochs=4, dropout=0.2, batch_size=32)


_VECTORS = """placed AS (
    SELECT key, amount, quantity, discount, tax, lines, row_number() OVER (ORDER BY ts, key) - 1 AS pos,
           count(*) OVER () AS n FROM known),
    train AS (SELECT * FROM placed WHERE pos < floor(n * 0.8)),
    test AS (SELECT * FROM placed WHERE pos >= floor(n * 0.8))"""


def _near_sql(k: int, distance: str, value: str) -> str:
    return sql(SENSORS, KNOWN, _VECTORS, f"""near AS (
        SELECT q.key, min({{'d': {distance}, 'id': t.pos, 'y': t.amount}}, {k}) AS list
        FROM test q, train t GROUP BY q.key)""", f"SELECT key, {value} AS prediction FROM near")


def _square(c):
    return f"(q.{c} - t.{c}) * (q.{c} - t.{c})"


_EUCLID = " + ".join(_square(c) for c in FEATURES)
_MANHATTAN = " + ".join(f"abs(q.{c} - t.{c})" for c in FEATURES)


def _knn(spark, sf, **params):
    frame = _frame(spark, sf)
    model = make_estimator("KNN", **params).fit(_train(frame))
    scored = model.transform(frame.where(F.col("split") == "test"))
    return scored.select("key", "prediction")


@query("knn_regress", _near_sql(5, _EUCLID, "(list[1].y + list[2].y + list[3].y + list[4].y + list[5].y) / 5"))
def knn_regress(spark, sf):
    return _knn(spark, sf, n_neighbors=5)


@query("knn_regress_distance", sql(SENSORS, KNOWN, _VECTORS, f"""near AS (
    SELECT q.key, min({{'d': {_MANHATTAN}, 'id': t.pos, 'y': t.amount}}, 3) AS list
    FROM test q, train t GROUP BY q.key),
    weighted AS (
    SELECT key, list_transform(list, lambda e: {{'y': e.y, 'w': CASE
        WHEN list_min(list_transform(list, lambda f: f.d)) = 0 THEN CAST(e.d = 0 AS DOUBLE) ELSE 1 / e.d END}}) AS list
    FROM near)""", """
    SELECT key, (list[1].w * list[1].y + list[2].w * list[2].y + list[3].w * list[3].y)
        / (list[1].w + list[2].w + list[3].w) AS prediction FROM weighted"""))
def knn_regress_distance(spark, sf):
    return _knn(spark, sf, n_neighbors=3, weights="distance", metric="manhattan")


_MEAN_OF_FIVE = "(list[1].y + list[2].y + list[3].y + list[4].y + list[5].y) / 5"

# A third of all queries ask for one and the same point.
_HOT = {"quantity": 100.0, "discount": 0.05, "tax": 0.03, "lines": 4.0}


def _hot_square(c):
    own = f"(CASE WHEN q.pos % 3 = 0 THEN CAST({_HOT[c]} AS DOUBLE) ELSE q.{c} END - t.{c})"
    return f"{own} * {own}"


@query("knn_regress_hot", _near_sql(5, " + ".join(_hot_square(c) for c in FEATURES), _MEAN_OF_FIVE))
def knn_regress_hot(spark, sf):
    """Also the search that moves queries to the train rows, as for models too large to be sent."""
    frame = _frame(spark, sf)
    model = make_estimator("KNN", n_neighbors=5, broadcast_bytes=0).fit(_train(frame))
    point = F.array(*[F.lit(v) for v in _HOT.values()])
    asked = frame.where(F.col("split") == "test").withColumn("features", array_to_vector(
        F.when(F.col("row_id") % 3 == 0, point).otherwise(vector_to_array("features"))))
    return model.transform(asked).select("key", "prediction")


# Ten features, as lags and rolling statistics would give.
_WIDE = {**{c: c for c in FEATURES}, "q2": "quantity * quantity / 100", "l2": "lines * lines", "ql": "quantity * lines / 50",
         "dq": "discount * quantity", "tq": "tax * quantity", "dl": "discount * lines"}


@query("knn_regress_wide", sql(SENSORS, f"known AS (SELECT ts, key, amount, {', '.join(f'{e} AS {n}' for n, e in _WIDE.items())} "
                               "FROM sensors WHERE amount IS NOT NULL)", _VECTORS.replace(
    "quantity, discount, tax, lines,", ", ".join(_WIDE) + ","), f"""near AS (
        SELECT q.key, min({{'d': {' + '.join(_square(c) for c in _WIDE)}, 'id': t.pos, 'y': t.amount}}, 5) AS list
        FROM test q, train t GROUP BY q.key)""", f"SELECT key, {_MEAN_OF_FIVE} AS prediction FROM near"))
def knn_regress_wide(spark, sf):
    """The search by joins, in which blocks around pivots are passed over."""
    frame = _wide_frame(spark, sf)
    model = make_estimator("KNN", n_neighbors=5, broadcast_bytes=0).fit(_train(frame))
    return model.transform(frame.where(F.col("split") == "test")).select("key", "prediction")


@query("knn_effort", sql(SENSORS, KNOWN, _VECTORS, "SELECT count(DISTINCT (quantity, discount, tax, lines)) AS queries, true AS under_a_tenth FROM test"))
def knn_effort(spark, sf):
    """Of all pairs of a different query and a train row, fewer than a tenth are compared."""
    frame = _wide_frame(spark, sf)
    model = make_estimator("KNN", n_neighbors=5, broadcast_bytes=0).fit(_train(frame))
    asked = frame.where(F.col("split") == "test").select(vector_to_array("features").alias("x")).distinct()
    return model._search_cells(asked).agg(F.count(F.lit(1)).alias("queries"), (
        F.sum("compared") * 10 < F.count(F.lit(1)) * F.lit(model.rows)).alias("under_a_tenth"))


def _wide_frame(spark, sf):
    wide = known_sensors(spark, sf).select("ts", "key", "amount", *[F.expr(e).alias(n) for n, e in _WIDE.items()])
    split = temporal_split(wide, ["ts", "key"], 0.8).withColumn("row_id", F.col("pos"))
    return materialize(assemble(split, list(_WIDE), "amount", keep=["row_id", "key", "split"]), "vectors", spread="row_id")


# A tree of one split over a column of few values: the best place can be found in SQL.
_STUMP = """parts AS (SELECT lines AS v, count(*) AS n, sum(amount) AS s, sum(amount * amount) AS q FROM train GROUP BY lines),
    sides AS (SELECT a.v, sum(b.n) FILTER (b.v <= a.v) AS nl, sum(b.s) FILTER (b.v <= a.v) AS sl, sum(b.q) FILTER (b.v <= a.v) AS ql,
                     sum(b.n) FILTER (b.v > a.v) AS nr, sum(b.s) FILTER (b.v > a.v) AS sr, sum(b.q) FILTER (b.v > a.v) AS qr
              FROM parts a, parts b GROUP BY a.v),
    stump AS (SELECT v, sl / nl AS low, sr / nr AS high, (sl + sr) / (nl + nr) AS mean FROM sides WHERE nr > 0
              ORDER BY ql - sl * sl / nl + qr - sr * sr / nr LIMIT 1),
    stumped AS (SELECT placed.*, CASE WHEN lines <= v THEN low ELSE high END AS p, mean FROM placed, stump)"""


def _stump(spark, sf):
    split = temporal_split(known_sensors(spark, sf), ["ts", "key"], 0.8).withColumn("row_id", F.col("pos"))
    frame = materialize(assemble(split, ["lines"], "amount", keep=["row_id", "key", "split"]), "stump", spread="row_id")
    return make_estimator("DecisionTree", max_depth=1).fit(_train(frame)), frame


@query("fit_stump", sql(SENSORS, KNOWN, _VECTORS, _STUMP, "SELECT key, round(p, 4) AS prediction FROM stumped"))
def fit_stump(spark, sf):
    model, frame = _stump(spark, sf)
    return rounded(model.transform(frame).select("key", "prediction"), 4, "prediction")


@query("stump_shap", sql(SENSORS, KNOWN, _VECTORS, _STUMP, "SELECT key, round(p - mean, 4) AS phi FROM stumped"))
def stump_shap(spark, sf):
    """With one feature its Shapley value is what the prediction differs from the mean of the train rows."""
    values, _ = at.shap_values(*_stump(spark, sf), ["key"])
    return values.select("key", F.round(F.col("phi")[0], 4).alias("phi"))


@query("stump_partial_dependence", sql(SENSORS, KNOWN, _VECTORS, _STUMP, """
    SELECT lines AS value, round(any_value(p), 4) AS average FROM stumped GROUP BY lines"""))
def stump_partial_dependence(spark, sf):
    return rounded(at.partial_dependence(*_stump(spark, sf), ["lines"], "lines"), 4, "average")


@query("stump_importance", sql(SENSORS, KNOWN, "SELECT 'lines' AS feature, CAST(1 AS DOUBLE) AS importance, count(*) AS rows FROM known"))
def stump_importance(spark, sf):
    model, frame = _stump(spark, sf)
    return at.tree_importance(model, ["lines"], spark).withColumn("rows", F.lit(frame.count()).cast("long"))


@query("stump_grid_search", sql(SENSORS, KNOWN, _VECTORS, """
    bounds AS (SELECT f, m - (3 - f) * (m // 4) AS first, m - (2 - f) * (m // 4) AS last
               FROM (SELECT count(*) AS m FROM train), (SELECT unnest(range(3)) AS f)),
    parts AS (SELECT f, lines AS v, count(*) AS n, sum(amount) AS s, sum(amount * amount) AS q FROM train, bounds WHERE pos < first GROUP BY ALL),
    sides AS (SELECT a.f, a.v, sum(b.n) FILTER (b.v <= a.v) AS nl, sum(b.s) FILTER (b.v <= a.v) AS sl, sum(b.q) FILTER (b.v <= a.v) AS ql,
                     sum(b.n) FILTER (b.v > a.v) AS nr, sum(b.s) FILTER (b.v > a.v) AS sr, sum(b.q) FILTER (b.v > a.v) AS qr
              FROM parts a JOIN parts b ON a.f = b.f GROUP BY a.f, a.v),
    stump AS (SELECT f, v, sl / nl AS low, sr / nr AS high, (sl + sr) / (nl + nr) AS mean FROM sides WHERE nr > 0
              QUALIFY row_number() OVER (PARTITION BY f ORDER BY ql - sl * sl / nl + qr - sr * sr / nr) = 1),
    tested AS (SELECT f, amount, mean, CASE WHEN lines <= v THEN low ELSE high END AS p
               FROM train JOIN bounds ON pos >= first AND pos < last JOIN stump USING (f)),
    scores AS (SELECT f, 1 - sum(pow(amount - mean, 2)) / (var_pop(amount) * count(*)) AS r0,
                      1 - sum(pow(amount - p, 2)) / (var_pop(amount) * count(*)) AS r1 FROM tested GROUP BY f)""", """
    SELECT max_depth, round(r2, 6) AS mean_r2, r2 >= best AS best FROM (
        SELECT unnest([0::BIGINT, 1::BIGINT]) AS max_depth, unnest([avg(r0), avg(r1)]) AS r2, greatest(avg(r0), avg(r1)) AS best FROM scores)"""))
def stump_grid_search(spark, sf):
    _, frame = _stump(spark, sf)
    found = grid_search(_train(frame).drop("key", "split"), "DecisionTree", {"max_depth": [0, 1]}, folds=3)
    rows = [(p["max_depth"], sum(s) / len(s), p == found.best) for p, s in found.scores]
    return rounded(spark.createDataFrame(rows, "max_depth long, mean_r2 double, best boolean"), 6, "mean_r2")


def _rounds_sql(rounds: int, rate: float, penalty: float, least: float) -> list[str]:
    """Boosting by stumps over ``lines``: what is left after each round, and what the rows' leaves are."""
    out = ["left0 AS (SELECT placed.*, pos < floor(n * 0.8) AS seen, amount - (SELECT avg(amount) FROM train) AS e FROM placed)"]
    for k in range(rounds):
        out.append(f"""sides{k} AS (SELECT a.v, sum(b.n) FILTER (b.v <= a.v) AS nl, sum(b.s) FILTER (b.v <= a.v) AS sl,
                            sum(b.n) FILTER (b.v > a.v) AS nr, sum(b.s) FILTER (b.v > a.v) AS sr
                     FROM (SELECT DISTINCT lines AS v FROM train) a, (SELECT lines AS v, count(*) AS n, sum(e) AS s FROM left{k} WHERE seen GROUP BY lines) b
                     GROUP BY a.v),
            leaf{k} AS (SELECT v, {rate} * sl / (nl + {penalty}) AS low, {rate} * sr / (nr + {penalty}) AS high FROM sides{k}
                     WHERE nl >= {least} AND nr >= {least}
                     ORDER BY sl * sl / (nl + {penalty}) + sr * sr / (nr + {penalty}) DESC LIMIT 1),
            left{k + 1} AS (SELECT left{k}.* EXCLUDE (e), e - CASE WHEN lines <= v THEN low ELSE high END AS e FROM left{k}, leaf{k})""")
    return out


@query("boost_one_round", sql(SENSORS, KNOWN, _VECTORS, *_rounds_sql(1, 0.3, 1.0, 3.0), """
    SELECT key, round(amount - e, 4) AS prediction FROM left1"""))
def boost_one_round(spark, sf):
    """Leaves of the first round are the sum of the residuals over their number and the penalty."""
    _, frame = _stump(spark, sf)
    model = make_estimator("XGBoost", n_estimators=1, max_depth=1, learning_rate=0.3, min_child_weight=3).fit(_train(frame))
    return rounded(model.transform(frame).select("key", "prediction"), 4, "prediction")


@query("boost_rounds", sql(SENSORS, KNOWN, _VECTORS, *_rounds_sql(6, 0.5, 2.0, 40.0), """
    SELECT key, round(amount - e, 4) AS prediction FROM left6"""))
def boost_rounds(spark, sf):
    _, frame = _stump(spark, sf)
    model = make_estimator("XGBoost", n_estimators=6, max_depth=1, learning_rate=0.5, min_child_weight=40, reg_lambda=2.0).fit(_train(frame))
    return rounded(model.transform(frame).select("key", "prediction"), 4, "prediction")


@query("tree_min_split", sql(SENSORS, KNOWN, _VECTORS, _STUMP, """
    halves AS (SELECT train.*, lines <= v AS low, count(*) OVER (PARTITION BY lines <= v) AS m FROM train, stump),
    again AS (SELECT low, lines AS v, any_value(m) AS m, count(*) AS n, sum(amount) AS s, sum(amount * amount) AS q FROM halves GROUP BY low, lines),
    cuts AS (SELECT a.low, a.m, a.v, sum(b.n) FILTER (b.v <= a.v) AS nl, sum(b.s) FILTER (b.v <= a.v) AS sl,
                    sum(b.n) FILTER (b.v > a.v) AS nr, sum(b.s) FILTER (b.v > a.v) AS sr
             FROM again a JOIN again b ON a.low = b.low GROUP BY a.low, a.m, a.v),
    second AS (SELECT low, v AS w, sl / nl AS below, sr / nr AS above FROM cuts
               WHERE nr > 0 AND m >= (SELECT count(*) // 2 FROM train)
               QUALIFY row_number() OVER (PARTITION BY low ORDER BY sl * sl / nl + sr * sr / nr DESC) = 1)""", """
    SELECT key, round(CASE WHEN w IS NULL THEN p WHEN lines <= w THEN below ELSE above END, 4) AS prediction
    FROM (SELECT stumped.*, lines <= v AS low FROM stumped, stump) LEFT JOIN second USING (low)"""))
def tree_min_split(spark, sf):
    """Two levels, but only nodes with half of the rows or more are split: the root and its larger side."""
    _, frame = _stump(spark, sf)
    train = _train(frame)
    model = make_estimator("DecisionTree", max_depth=2, min_samples_split=train.count() // 2).fit(train)
    return rounded(model.transform(frame).select("key", "prediction"), 4, "prediction")


@query("grid_search")
def grid_search_query(spark, sf):
    found = grid_search(_train(_frame(spark, sf)).drop("key", "split"), "DecisionTree",
                        {"max_depth": [3, 6], "min_samples_leaf": [1, 20]}, folds=3)
    rows = [(str(p), sum(s) / len(s), p == found.best) for p, s in found.scores]
    return spark.createDataFrame(rows, "params string, mean_r2 double, best boolean")


@query("score")
def score(spark, sf):
    frame = _frame(spark, sf)
    model = make_estimator("DecisionTree", max_depth=6).fit(_train(frame))
    return model.transform(frame).select("key", "split", "label", "prediction")


def _round_trip_query(suffix, name, **params):
    @query(f"model_round_trip{suffix}", sql(SENSORS, KNOWN, "SELECT count(*) AS n, count(*) AS same FROM known"))
    def run(spark, sf):
        """Predictions of a fitted model, and of the same model saved and loaded."""
        frame = _frame(spark, sf)
        model = make_estimator(name, **params).fit(_train(frame))
        folder = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
        loaded = load_model(name, save_model(model, folder, name, "all rows"))
        again = loaded.transform(frame).select("row_id", F.col("prediction").alias("again"))
        both = model.transform(frame).join(again, "row_id")
        return both.agg(F.count(F.lit(1)).alias("n"),
                        F.sum((F.col("again") == F.col("prediction")).cast("long")).alias("same"))
    return run


_round_trip_query("", "DecisionTree", max_depth=4)
_round_trip_query("_knn", "KNN", n_neighbors=3)
_round_trip_query("_adaboost", "AdaBoost", n_estimators=2)
_round_trip_query("_mlp", "DNN", hidden=(8,), epochs=2)


SENSOR_SERIES = SeriesSpec("ts", ("key",), (), "amount", tuple(FEATURES))
SENSOR_PLAN = FeaturePlan(lags={"quantity": [1, 2]}, windows={"quantity": [3, 6], "lines": [3]})


_SEASONS = ", ".join(f"('{p.name}', '{p.start}', '{p.end}')" for p in ORDER_PERIODS)

_SEASON_FEATURES = f"""assigned AS (
    SELECT period, known.* FROM known JOIN (VALUES {_SEASONS}) AS p(period, a, b)
    ON strftime(ts, '%m-%d') BETWEEN a AND b),
    placed AS (
    SELECT *, row_number() OVER (PARTITION BY period ORDER BY ts, key) - 1 AS pos,
           count(*) OVER (PARTITION BY period) AS n FROM assigned),
    split AS (SELECT *, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM placed),
    features AS (
    SELECT *, lag(quantity, 1) OVER w AS lag1, lag(quantity, 2) OVER w AS lag2, avg(quantity) OVER w3 AS roll3,
           stddev_samp(quantity) OVER w6 AS std6, avg(lines) OVER w3 AS lines3, cos(2 * pi() * dayofyear(ts) / 365) AS doy
    FROM split WINDOW w AS (PARTITION BY period, split ORDER BY ts, key),
        w3 AS (PARTITION BY period, split ORDER BY ts, key ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
        w6 AS (PARTITION BY period, split ORDER BY ts, key ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""


@query("experiment_features", sql(SENSORS, KNOWN, _SEASON_FEATURES, """
    SELECT period, split, count(*) AS rows, round(avg(amount), 4) AS amount, round(avg(lag1), 6) AS lag1,
        round(avg(lag2), 6) AS lag2, round(avg(roll3), 6) AS roll3, round(avg(std6), 6) AS std6,
        round(avg(lines3), 6) AS lines3, round(avg(doy), 6) AS doy
    FROM features WHERE lag2 IS NOT NULL GROUP BY period, split"""))
def experiment_features(spark, sf):
    """The feature table of the experiment, summed up per season and split."""
    config = ExperimentConfig(SENSOR_SERIES, ORDER_PERIODS, "DecisionTree", {}, SENSOR_PLAN)
    table = prepare(known_sensors(spark, sf), config)
    means = {"amount": "amount", "quantity_lag1": "lag1", "quantity_lag2": "lag2", "quantity_roll3": "roll3",
             "quantity_std6": "std6", "lines_roll3": "lines3", "doy_cos": "doy"}
    return table.groupBy("period", "split").agg(F.count(F.lit(1)).alias("rows"), *[
        F.round(F.avg(c), 4 if c == "amount" else 6).alias(name) for c, name in means.items()])


@query("experiment")
def experiment(spark, sf):
    """Clean the wide series, then run every season: the whole pipeline with a tuned tree."""
    cleaned = clean(sensors(spark, sf), MEASURES, CleaningOptions(negative=False, outliers="iqr"))
    config = ExperimentConfig(
        SENSOR_SERIES, ORDER_PERIODS, "DecisionTree", {"max_depth": [4, 8]}, SENSOR_PLAN,
        resampling_overrides={"DecisionTree": {"März–Mitte Mai": "1D"}}, folds=3)
    return run_experiment(cleaned, config)


@query("experiment_status", sql(SENSORS, KNOWN, _SEASON_FEATURES, """
    sizes AS (SELECT period, count(*) AS n FROM assigned GROUP BY period)""", """
    SELECT status, count(*) AS periods FROM (
        SELECT CASE WHEN n >= 50 THEN 'ok' ELSE 'too few rows' END AS status FROM sizes
        UNION ALL SELECT 'too few rows') GROUP BY status"""))
def experiment_status(spark, sf):
    """What became of every season, one of which is a single day that no order can fall on."""
    config = ExperimentConfig(SENSOR_SERIES, [*ORDER_PERIODS, Period("no day", "02-30", "02-30")], "DecisionTree",
                              {"max_depth": [2]}, SENSOR_PLAN)
    return run_experiment(known_sensors(spark, sf), config).groupBy(F.col("Status").alias("status")).agg(
        F.count(F.lit(1)).alias("periods"))


@query("experiment_forest_augmented")
def experiment_forest_augmented(spark, sf):
    cleaned = clean(sensors(spark, sf), MEASURES, CleaningOptions(negative=False, outliers=None))
    config = ExperimentConfig(
        SENSOR_SERIES, ORDER_PERIODS, "RandomForest", {"n_estimators": [10], "max_depth": [6]}, SENSOR_PLAN,
        copies=2, noise=0.05, scaler="robust")
    return run_experiment(cleaned, config)


@query("experiment_features_first")
def experiment_features_first(spark, sf):
    """The interactive variant: one period, features before the split, full windows, three folds."""
    cleaned = clean(sensors(spark, sf), MEASURES, CleaningOptions(negative=False, outliers="iqr"))
    config = ExperimentConfig(SENSOR_SERIES, (), "DecisionTree", {"max_depth": [10, 20]}, SENSOR_PLAN,
                              folds=3, features_first=True)
    return run_experiment(cleaned, config)


# ---------------------------------------------------------------- forecasts

_DAYS = "(epoch_us(ts) / CAST(86400000000 AS DOUBLE))"

_WAVES = [(name, period, k, f) for name, period, waves in (("weekly", 7, 3), ("daily", 1, 4))
          for k in range(1, waves + 1) for f in ("sin", "cos")]


@query("fourier_features", "SELECT event_id, " + ", ".join(
    f"round({f}(CAST({2 * k} AS DOUBLE) * pi() * {_DAYS} / CAST({p} AS DOUBLE)), 6) + 0 AS {n}_{f}{k}"
    for n, p, k, f in _WAVES) + " FROM events")
def fourier_features(spark, sf):
    waves = {**fc.fourier_columns("ts", "weekly"), **fc.fourier_columns("ts", "daily")}
    return events(spark, sf).select("event_id", *[(F.round(c, 6) + 0).alias(n) for n, c in waves.items()])


@query("changepoint_features", sql(
    f"days AS (SELECT event_id, {_DAYS} AS d FROM events)",
    "cuts AS (SELECT " + ", ".join(f"quantile_cont(d, {0.8 * j / 5}) AS s{j - 1}" for j in range(1, 6)) + " FROM days)",
    "SELECT event_id, " + ", ".join(f"round(greatest(d - s{j}, 0), 6) AS hinge{j}" for j in range(5)) + " FROM days, cuts"))
def changepoint_features(spark, sf):
    df = events(spark, sf)
    cuts = fc.changepoint_days(df, "ts", 0.8, 5)
    hinges = fc.hinge_columns(fc.days_since_epoch("ts"), cuts)
    return df.select("event_id", *[F.round(c, 6).alias(n) for n, c in hinges.items()])


# Forecast settings of the three periods.
FORECASTS = [
    fc.ForecastConfig(0.009, 20.0, "multiplicative", yearly="auto", weekly="auto", daily=True),
    fc.ForecastConfig(0.001, 30.0, "additive", yearly=False, weekly=False, daily=True),
    fc.ForecastConfig(0.002050001, 50.0, "multiplicative", yearly=True, weekly=True, daily=True)]


def _forecast(spark, sf, config):
    split = temporal_split(events(spark, sf), ["ts", "event_id"], 0.8)
    return split, fc.fit_forecast(_train(split), "ts", "value", config)


@query("fit_trend_season")
def fit_trend_season(spark, sf):
    _, model = _forecast(spark, sf, FORECASTS[1])
    weights = {**model.trend_weights, **model.season_weights}
    return spark.createDataFrame(list(weights.items()), "term string, weight double")


@query("forecast")
def forecast(spark, sf):
    split, model = _forecast(spark, sf, FORECASTS[1])
    return model.transform(split).select("event_id", "split", "value", "yhat", "yhat_lower", "yhat_upper")


@query("forecast_components")
def forecast_components(spark, sf):
    split, model = _forecast(spark, sf, FORECASTS[0])
    return model.components(split).select("event_id", "trend", *model.seasons, "yhat")


@query("forecast_adds_up", "SELECT count(*) AS n, count(*) AS additive, count(*) AS ordered FROM events")
def forecast_adds_up(spark, sf):
    """Trend and seasons make up the forecast, which lies within its interval."""
    split, model = _forecast(spark, sf, FORECASTS[1])
    total = sum((F.col(s) for s in model.seasons), F.col("trend"))
    parts = model.components(split).select("event_id", "yhat", (F.abs(total - F.col("yhat")) < 1e-6).alias("additive"))
    bands = model.transform(split).select("event_id", F.col("yhat").between(F.col("yhat_lower"), F.col("yhat_upper")).alias("ordered"))
    both = parts.join(bands, "event_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("additive").cast("long")).alias("additive"),
                    F.sum(F.col("ordered").cast("long")).alias("ordered"))


@query("forecast_trend_optimal", """SELECT 25::BIGINT AS changes, 25::BIGINT AS optimal, count(*)::BIGINT AS rows
    FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n, value FROM events)
    WHERE pos < floor(n * 0.8) AND value IS NOT NULL""")
def forecast_trend_optimal(spark, sf):
    """Changes of the trend that meet the conditions of the most likely fit, from another pass over the rows.

    The slope of the squared error is sign / prior width at a change, and at most that where there is none.
    """
    split, model = _forecast(spark, sf, FORECASTS[1])
    rows = model.components(_train(split).where("value IS NOT NULL"))
    error = (F.col("value") - F.col("yhat")) / F.lit(model.scale)
    hinges = {n: c for n, c in model.trend_columns().items() if n.startswith("hinge")}
    row = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c * error).alias(n) for n, c in hinges.items()],
                   *[F.sum(F.abs(c * error)).alias(f"{n}_size") for n, c in hinges.items()]).first()
    optimal = 0
    for name in hinges:
        slope, weight = row[name] / model.noise ** 2, model.trend_weights[name]
        close = 1e-6 * row[f"{name}_size"] / model.noise ** 2
        bound = 1 / model.config.changepoint_prior_scale
        optimal += abs(slope) <= bound + close if weight == 0 else abs(slope - math.copysign(bound, weight)) <= close
    return spark.createDataFrame([(len(hinges), int(optimal), row["n"])], "changes long, optimal long, rows long")


@query("forecast_width", """SELECT count(*) FILTER (pos < floor(n * 0.8)) AS steady, count(*) FILTER (pos >= floor(n * 0.8)) AS wider
    FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)""")
def forecast_width(spark, sf):
    """Rows of the fit have the interval of the noise, those behind it one that is as wide or wider."""
    split, model = _forecast(spark, sf, FORECASTS[1])
    rows = model.transform(split).select("split", (F.col("yhat_upper") - F.col("yhat_lower")).alias("w"))
    noise = 2 * 1.2815515655446004 * model.noise * model.scale  # four fifths of a normal spread
    return rows.agg(F.sum(((F.col("split") == "train") & (F.abs(F.col("w") / F.lit(noise) - 1) < 0.01)).cast("long")).alias("steady"),
                    F.sum(((F.col("split") == "test") & (F.col("w") >= F.lit(noise * 0.99))).cast("long")).alias("wider"))


@query("forecast_metrics")
def forecast_metrics(spark, sf):
    return fc.forecast_periods(events(spark, sf), "ts", "value", ["ts", "event_id"], RANGES, FORECASTS)


@query("forecast_regressors")
def forecast_regressors(spark, sf):
    df = filter_dates(known_sensors(spark, sf), "ts", "1995-01-01", "2001-08-01")
    split = temporal_split(df, ["ts", "key"], 0.8)
    config = fc.ForecastConfig(yearly=True, weekly=True, daily=False, regressors=("quantity", "lines"))
    model = fc.fit_forecast(_train(split), "ts", "amount", config)
    return regression_metrics(model.transform(split), "amount", "yhat", ["split"])


# ---------------------------------------------------------------- attribution

def _explained(spark, sf, name="RandomForest", **params):
    frame = _frame(spark, sf)
    model = make_estimator(name, **(params or {"n_estimators": 10, "max_depth": 5})).fit(_train(frame))
    return model, frame


@query("permutation_importance")
def permutation_importance(spark, sf):
    model, frame = _explained(spark, sf)
    test = frame.where(F.col("split") == "test")
    first = test.agg(F.min("row_id")).first()[0]
    return at.permutation_importance(model, test.withColumn("row_id", F.col("row_id") - F.lit(first)), FEATURES)


@query("top_k_importance")
def top_k_importance(spark, sf):
    model, frame = _explained(spark, sf, "DecisionTree", max_depth=5)
    test = frame.where(F.col("split") == "test")
    first = test.agg(F.min("row_id")).first()[0]
    ranked = at.permutation_importance(model, test.withColumn("row_id", F.col("row_id") - F.lit(first)), FEATURES)
    return top_k(ranked, "importance", 20, tie="feature")


@query("shap_importance")
def shap_importance(spark, sf):
    return at.shap_importance(*_explained(spark, sf), FEATURES)


@query("shap_importance_boosted")
def shap_importance_boosted(spark, sf):
    return at.shap_importance(*_explained(spark, sf, "XGBoost", n_estimators=5, max_depth=3), FEATURES)


@query("shap_additivity", sql(SENSORS, KNOWN, "SELECT count(*) AS n, count(*) AS additive FROM known"))
def shap_additivity(spark, sf):
    """Base plus Shapley values gives the prediction, row by row."""
    model, frame = _explained(spark, sf)
    values, base = at.shap_values(model, model.transform(frame), ["prediction"])
    total = F.aggregate("phi", F.lit(float(base)), lambda a, v: a + v)
    close = F.abs(total - F.col("prediction")) < 1e-6 * F.greatest(F.abs("prediction"), F.lit(1.0))
    return values.agg(F.count(F.lit(1)).alias("n"), F.sum(close.cast("long")).alias("additive"))


@query("shap_additivity_boosted", sql(SENSORS, KNOWN, "SELECT count(*) AS n, count(*) AS additive FROM known"))
def shap_additivity_boosted(spark, sf):
    """As many trees as a production run has; they are explained group by group."""
    model, frame = _explained(spark, sf, "XGBoost", n_estimators=1200, max_depth=3, learning_rate=0.01, min_child_weight=3,
                              subsample=0.8, colsample_bytree=0.8)
    values, base = at.shap_values(model, model.transform(frame), ["prediction"])
    total = F.aggregate("phi", F.lit(float(base)), lambda a, v: a + v)
    close = F.abs(total - F.col("prediction")) < 1e-6 * F.greatest(F.abs("prediction"), F.lit(1.0))
    return values.agg(F.count(F.lit(1)).alias("n"), F.sum(close.cast("long")).alias("additive"))


@query("permutation_importance_knn")
def permutation_importance_knn(spark, sf):
    model, frame = _explained(spark, sf, "KNN", n_neighbors=5)
    test = frame.where(F.col("split") == "test")
    first = test.agg(F.min("row_id")).first()[0]
    return at.permutation_importance(model, test.withColumn("row_id", F.col("row_id") - F.lit(first)), FEATURES, repeats=2)


@query("shap_sampled_knn")
def shap_sampled_knn(spark, sf):
    model, frame = _explained(spark, sf, "KNN", n_neighbors=5)
    return at.shap_sampled(model, frame, FEATURES, rows=100, permutations=4)


@query("shap_selected")
def shap_selected(spark, sf):
    return at.shap_selected(*_explained(spark, sf), FEATURES, ["tax", "no_such_feature", "quantity"])


@query("shap_sampled")
def shap_sampled(spark, sf):
    model, frame = _explained(spark, sf, "AdaBoost", n_estimators=3)
    return at.shap_sampled(model, frame, FEATURES, rows=100)


@query("partial_dependence")
def partial_dependence(spark, sf):
    return at.partial_dependence(*_explained(spark, sf), FEATURES, "quantity")


@query("partial_dependence_scored")
def partial_dependence_scored(spark, sf):
    return at.partial_dependence(*_explained(spark, sf, "XGBoost", n_estimators=5, max_depth=3), FEATURES, "lines")


@query("tree_importance")
def tree_importance(spark, sf):
    model, _ = _explained(spark, sf)
    return at.tree_importance(model, FEATURES, spark)
