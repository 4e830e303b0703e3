import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright import session
from tidewright.session import materialize, shared_folder
from tidewright.sources import readers, writers


def test_csv_round_trip(spark, tiny, tmp_path):
    path = str(tmp_path / "series")
    tiny.write.option("header", True).csv(path)
    loaded = readers.load_series(spark, path, "ts", "ts timestamp_ntz, v double, w double")
    rows = {r.ts: r for r in loaded.collect()}
    assert loaded.columns[0] == "ts" and len(rows) == 8
    assert rows[dt.datetime(2016, 1, 1, 0, 45)].v is None


def test_time_text_and_missing_column(spark):
    df = spark.createDataFrame([("2016-01-01 00:15:00",), ("no time",)], "t string")
    assert [r.t for r in readers.parse_time(df, "t").collect()] == [dt.datetime(2016, 1, 1, 0, 15), None]
    with pytest.raises(ValueError, match="not found"):
        readers.parse_time(df, "ts")


def test_many_files_with_other_columns(spark, tmp_path):
    for name, df in (("a", spark.range(2).selectExpr("id", "1 as model")), ("b", spark.range(3).selectExpr("'x' as model"))):
        df.write.option("header", True).csv(str(tmp_path / name))
    out = readers.read_many(spark, [str(tmp_path / "a"), str(tmp_path / "b")], as_text=("model",))
    assert out.count() == 5 and dict(out.dtypes)["model"] == "string"


def test_patterns_unite_files_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("model,periode,r2\nRF,p1,0.5\n")
    (tmp_path / "b.csv").write_text("model,r2,periode\n7,0.7,p2\n")
    (tmp_path / "c.csv").write_text("r2,model\n1,KNN\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("x\n1\n")
    for schema in (None, "model string, periode string, r2 double"):
        out = readers.read_many(spark, [str(tmp_path / "*.csv")], as_text=("model",), schema=schema)
        assert sorted((r.model, r.periode or "", r.r2) for r in out.collect()) == [("7", "p2", 0.7), ("KNN", "", 1.0), ("RF", "p1", 0.5)]
    with pytest.raises(FileNotFoundError):
        readers.read_many(spark, [str(tmp_path / "none*.csv")])


def test_types_come_from_every_value(spark, tmp_path):
    (tmp_path / "x.csv").write_text("x\n" + "1\n" * 2000 + "1.5\n")
    (tmp_path / "y.csv").write_text("x\n1\n")
    assert readers.read_csv(spark, str(tmp_path / "x.csv")).agg(F.max("x")).first()[0] == 1.5
    assert dict(readers.read_csv(spark, str(tmp_path / "y.csv")).dtypes) == {"x": "int"}
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.read_csv(spark, str(tmp_path / "x.csv"), "x int", strict=True).collect()


def test_sinks(spark, tiny, tmp_path):
    path = str(tmp_path / "predictions")
    scored = tiny.withColumn("prediction", F.col("w") + 1)
    for period, rows in (("a b", 8), ("c", 8), ("c", 2)):
        writers.write_predictions(writers.predictions_frame(scored.limit(rows), "ts", "w", "prediction", "KNN", period), path)
    counts = {r.period: r["count"] for r in spark.read.option("header", True).csv(path).groupBy("period").count().collect()}
    assert counts == {"a b": 8, "c": 2}
    results = str(tmp_path / "results")
    for _ in range(2):
        writers.append_results(spark.createDataFrame([("a", 1.0)], "period string, r2 double"), results)
    assert readers.read_csv(spark, results, "period string, r2 double").count() == 2
    writers.write_table(spark.range(3).toDF("n"), str(tmp_path / "table"))
    assert readers.read_table(spark, str(tmp_path / "table"), "n long").count() == 3
    assert writers.model_path("m", "KNN", "a b c") == "m/KNN_a_b_c"


def test_materialize_reads_back(spark, tiny):
    out = materialize(tiny, "t", spread="w")
    assert out.schema.fieldNames() == tiny.schema.fieldNames() and out.count() == 8
    assert shared_folder(spark) == shared_folder(spark)


def test_own_tables_can_be_dropped(spark, tiny, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    out = materialize(tiny, "gone")
    session.drop_materialized(spark)
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FileNotFound"):
        spark.read.parquet(*out.inputFiles()).count()


def test_stateless_steps_accept_a_stream(spark, tiny, tmp_path):
    from tidewright.operators.clean import drop_missing, non_negative
    from tidewright.operators.features import add_time_features
    from tidewright.operators.scale import standard_scaler

    path = str(tmp_path / "in")
    tiny.write.parquet(path)
    scaler = standard_scaler(tiny, ["w"])
    stream = spark.readStream.schema(tiny.schema).parquet(path)
    out = scaler.transform(add_time_features(non_negative(drop_missing(stream), ["v"]), "ts"))
    running = out.writeStream.format("memory").queryName("stateless").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert spark.table("stateless").count() == 5
