import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions.chi2 import chi2_quantile
from tidewright.operators import clean as cl
from tidewright.operators import stats
from tidewright.operators import quantiles as quantiles_module
from tidewright.operators.quantiles import order_statistics, quantiles
from tidewright.sources.readers import nan_to_null


def test_missing_and_negative(tiny):
    assert cl.drop_missing(tiny).count() == 6
    assert cl.drop_missing(tiny, ["w"]).count() == 8
    assert sorted(r.w for r in cl.non_negative(tiny, ["v"]).collect()) == [0, 2, 5, 6, 7]
    assert nan_to_null(tiny).where("v is null").count() == 2
    assert [(r.variable, r.value) for r in cl.negative_examples(tiny, ["v", "w"], ["ts"]).collect()] == [("v", -5.0)]


def test_iqr_is_sequential(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": np.r_[rng.normal(0, 1, 200), [50, 60]], "b": np.r_[rng.normal(0, 1, 200), [4.0, 300]]})
    want = pdf
    for c in ("a", "b"):
        q1, q3 = want[c].quantile([0.25, 0.75])
        want = want[want[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    got = cl.remove_outliers_iqr(spark.createDataFrame(pdf), ["a", "b"]).toPandas()
    assert sorted(got["a"]) == sorted(want["a"])
    assert cl.remove_outliers_iqr(spark.createDataFrame(pdf).limit(0), ["a"]).count() == 0


def test_mahalanobis(spark):
    rng = np.random.default_rng(2)
    x = rng.multivariate_normal([1, 2, 3], [[2, 1, 0], [1, 2, .5], [0, .5, 1]], 500)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(k=7.0))
    d = x - x.mean(axis=0)
    dist = np.sqrt((d @ np.linalg.inv(np.cov(x, rowvar=False)) * d).sum(axis=1))
    kept = cl.remove_outliers_mahalanobis(df, ["a", "b", "c"])
    assert kept.count() == (dist <= np.quantile(dist, 0.99)).sum()
    flagged = cl.flag_mahalanobis(df, ["a", "b", "c", "k"])
    assert flagged.where("outlier").count() == (dist > np.sqrt(11.344866730144373)).sum()
    np.testing.assert_allclose(sorted(r.distance for r in flagged.collect()), sorted(dist))
    with pytest.raises(ValueError, match="inverted"):
        cl.remove_outliers_mahalanobis(df.withColumn("z", F.lit(1.0)), ["a", "z"])
    twice = cl.flag_mahalanobis(df.withColumn("d", F.col("a") * 2), ["a", "d"])
    assert twice.where("distance is null").count() == 0


def test_chi2_quantile():
    assert chi2_quantile(0.99, 2) == pytest.approx(9.210340371976182)
    assert chi2_quantile(0.99, 3) == pytest.approx(11.344866730144373)
    assert chi2_quantile(0.95, 10) == pytest.approx(18.307038053275146)


def test_audit_counts(tiny):
    rows = cl.cleaning_audit(tiny, ["v", "w"], cl.CleaningOptions(outliers="iqr")).collect()
    assert [(r.name, r.rows) for r in rows] == [("input", 8), ("missing", 6), ("negative", 5), ("iqr", 5)]
    assert cl.clean(tiny, ["v", "w"], cl.CleaningOptions(outliers="iqr")).count() == 5
    assert cl.drop_constant_columns(tiny.withColumn("k", F.lit(1.0)), ["w", "k"]).columns == ["ts", "v", "w"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.floats(-1e6, 1e6), st.just(5.0)), min_size=3, max_size=80),
       copies=st.integers(0, 60))
def test_narrowed_quantiles_equal_numpy(spark, values, copies):
    values = values + [5.0] * copies
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = quantiles(df, ["v"], [0.0, 0.1, 0.5, 0.99, 1.0], exact_rows=4)["v"]
    np.testing.assert_allclose(got, np.quantile(values, [0, 0.1, 0.5, 0.99, 1.0]), rtol=1e-12, atol=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles(df, ["v"], [0.5])["v"] == [None]
    assert quantiles(df, ["v"], [0.5], at_most=1)["v"] == [None]


def test_summary_equals_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.exponential(2, 300), "b": rng.normal(0, 1, 300)})
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r for r in stats.summary(df, ["a", "b"]).collect()}
    for c in pdf:
        assert got[c].kurtosis == pytest.approx(pdf[c].kurt(), abs=1e-3)
        assert got[c]["std"] == pytest.approx(pdf[c].std(), abs=1e-3)
    box = stats.boxplot_stats(df, ["a"]).first()
    q1, q3 = pdf.a.quantile([.25, .75])
    inside = pdf.a[pdf.a.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    assert (box.whisker_high, box.outliers) == (inside.max(), 300 - len(inside))
    bins = [r["count"] for r in stats.histogram(df, "b", 10).orderBy("bin").collect()]
    assert bins == list(np.histogram(pdf.b, 10)[0])
    density = stats.kernel_density(df, "b").orderBy("point").toPandas()
    assert np.trapezoid(density.density, density.x) == pytest.approx(1, abs=0.01)
    assert stats.kernel_density(df.withColumn("k", F.lit(1.0)), "k").count() == 0


def test_profile_of_tiny(tiny):
    got = {r["column"]: r for r in stats.profile_columns(tiny).collect()}
    assert got["v"].null_count == 2 and got["ts"].unique_count == 8 and got["ts"]["mean"] is None
    assert stats.overview(tiny).first().missing_cells == 2
    assert stats.duplicate_count(tiny.select("ts").unionAll(tiny.select("ts").limit(3))).first().duplicates == 3
    one = stats.target_stats(tiny.where("w = 7"), "w").first()
    assert one["std"] is None and one.q50 == 7


def test_many_ranks_of_skewed_values(spark, monkeypatch):
    """Ranks in every kind of stretch: copies that fill a third, outliers, infinities; and a sketch that misses."""
    rng = np.random.default_rng(4)
    values = np.concatenate([np.full(1000, 2.0), rng.normal(0, 1, 1500), rng.pareto(0.5, 500), [np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    monkeypatch.setattr("tidewright.operators.quantiles.SKETCH_ACCURACY", 100)
    ranks = [0, 1, 2, 700, 1500, 1501, 2400, 2999, 3000, 3001]
    found = order_statistics(df, 3002, ranks, 50)
    assert [found[r] for r in ranks] == np.sort(values)[ranks].tolist()
    honest, calls = quantiles_module._stretches, []

    def missing(values, n, ranks, slack):
        calls.append(slack)
        return honest(values, n, ranks, slack) if len(calls) > 1 else np.array([1e6, 2e6])

    monkeypatch.setattr(quantiles_module, "_stretches", missing)
    assert order_statistics(df, 3002, [10, 2000], 50) == {r: np.sort(values)[r] for r in (10, 2000)} and len(calls) == 2


def test_long_columns_are_ranked_at_once(spark, monkeypatch):
    """Columns of one frame share two passes: copies, infinities, not-a-number, missing values, a column of nothing."""
    rng = np.random.default_rng(5)
    n = 6000
    columns = {"a": rng.normal(0, 1, n), "b": np.where(rng.random(n) < 0.4, 2.0, rng.pareto(0.5, n)), "c": rng.integers(0, 3, n).astype(float),
               "d": np.where(rng.random(n) < 0.1, np.inf, rng.normal(0, 1, n)), "e": np.where(rng.random(n) < 0.3, np.nan, rng.normal(0, 1, n))}
    rows = [(*(float(v[i]) for v in columns.values()), None if i % 3 else float(i), None) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "f", "g"])).repartition(3)
    monkeypatch.setattr(quantiles_module, "CHUNK_VALUES", 500)
    monkeypatch.setattr(quantiles_module, "CHUNK_POINTS", 50)
    probs = [0.0, 0.001, *[j / 40 for j in range(1, 40)], 0.9995, 1.0]
    monkeypatch.setattr(F, "percentile", None)
    monkeypatch.setattr(quantiles_module, "order_statistics", None)  # which reads the rows anew for each column
    got = quantiles(df, [*columns, "f", "g"], probs, exact_rows=100)
    known = {**columns, "f": np.arange(0.0, n, 3)}
    for c, v in known.items():
        v = np.sort(v)
        at = np.array(probs) * (len(v) - 1)
        low, high = v[np.floor(at).astype(int)], v[np.ceil(at).astype(int)]
        with np.errstate(invalid="ignore"):
            want = np.where((low == high) | (np.isnan(low) & np.isnan(high)), low, (np.ceil(at) - at) * low + (at - np.floor(at)) * high)
        np.testing.assert_array_equal(got[c], want, c)
    assert got["g"] == [None] * len(probs)
