"""Feature table and tree classifiers."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stationmine.operators import clean, ml
from stationmine.plans import queries as q
from stationmine.scale import cut
from stationmine.sources.fixture import Fixture
from tests.conftest import status_frame, tuples


@pytest.fixture(scope="module")
def table(spark):
    fx = Fixture(spark, "/root/testdata/sf0.01")
    rows = cut(q.features(fx).withColumn("time", F.timestamp_seconds("bin")))
    return clean.before(rows, q.SPLIT), clean.since(rows, q.SPLIT)


def test_feature_table_by_hand(spark):
    rows = [
        (s, 10 * s + h, h, f"2024-01-01 {h:02d}:00:00") for s in (1, 2) for h in range(5) if (s, h) != (2, 1)
    ] + [(3, 1, 1, "2024-01-01 00:00:00")]
    station = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "id long, city string")
    got = ml.feature_table(status_frame(spark, rows), station, 60, 2, limit=3).orderBy("bin", "station_id").collect()
    # station 2 has no bin 1, so only bin 3 has both lags of both stations and a bin after it
    assert [(r.station_id, r.status) for r in got] == [(1, "N"), (2, "N")]
    assert got[0].features == [2.0, 12.0, 3.0, 13.0, 2.0, 22.0, 3.0, 23.0]
    assert got[1].own == [2.0, 22.0, 3.0, 23.0]
    wide = ml.network_features(spark.createDataFrame(got), 2).orderBy("station_id").first()
    assert wide.features == [2.0, 12.0, 3.0, 13.0, 2.0, 17.0, 3.0, 18.0]


def test_class_weights(spark):
    df = spark.createDataFrame([(1, "QP")] + [(1, "N")] * 3, "station_id long, status string")
    assert tuples(ml.class_weights(df), "status", "weight") == [("N", pytest.approx(2 / 3)), ("QP", 2.0)]
    assert tuples(ml.class_weights(df, by=()), "status", "weight") == [("N", pytest.approx(2 / 3)), ("QP", 2.0)]
    assert ml.with_weights(df).agg(F.sum("weight")).first()[0] == pytest.approx(4.0)


@pytest.mark.parametrize("kind,params", [("dt", {"maxDepth": 3}), ("rf", {"numTrees": 5}), ("gbt", {"maxIter": 2})])
def test_fit_save_and_load(spark, table, tmp_path, kind, params):
    train, test = (ml.network_features(x, q.WIDTH) for x in table)
    model = ml.fit(train, kind, **params)
    model.write().overwrite().save(str(tmp_path / kind))
    again = PipelineModel.load(str(tmp_path / kind))
    cols = ("station_id", "bin", "y_pred", "y_true")
    assert tuples(ml.predictions(again, test), *cols) == tuples(ml.predictions(model, test), *cols)
    overall = ml.micro_average(ml.station_confusion(ml.predictions(model, test))).first()
    assert overall.tp + overall.tn + overall.fp + overall.fn == test.count()


def test_one_model_per_station(table):
    train, test = table
    ids = [r.station_id for r in train.groupBy("station_id").count().orderBy(F.desc("count"), "station_id").head(3)]
    models = ml.fit_stations(train, ids, "dt", maxDepth=2)
    assert set(models) == set(ids)
    for s, model in models.items():
        mine = test.filter(F.col("station_id") == s)
        assert ml.predictions(model, mine).count() == mine.count()


@pytest.mark.parametrize("scorer", ["recall", "precision", "f1"])
def test_tuning(table, scorer):
    train = ml.with_weights(ml.network_features(table[0], q.WIDTH), by=())
    found = ml.tune(train, "dt", scorer, {"maxDepth": [2, 3], "impurity": ["gini"]})
    assert len(found.avgMetrics) == 2 and all(0 <= m <= 1 for m in found.avgMetrics)
    assert found.bestModel.transform(ml.to_vectors(train)).select("y_pred").count() == train.count()


def test_counts_of_station_models(table):
    train, test = table
    ids = [r.station_id for r in train.select("station_id").distinct().orderBy("station_id").head(2)]
    got = {r.station_id: r for r in ml.stations_confusion(ml.fit_stations(train, [*ids, -5], "dt", maxDepth=3), test).collect()}
    assert set(got) == set(ids)
    for s in ids:
        mine = test.filter(F.col("station_id") == s)
        assert sum(got[s][c] for c in ("tp", "tn", "fp", "fn")) == mine.count()
        assert got[s].tp + got[s].fn == mine.filter("status = 'QP'").count()


def test_tuned_comparison(table):
    train, test = table
    ids = [r.station_id for r in train.select("station_id").distinct().orderBy("station_id").head(1)]
    grids = {"dt": {"maxDepth": [2], "impurity": ["gini", "entropy"]}}
    got = ml.tuned_comparison(train, test, ids, {"DecisionTree": "dt"}, grids).collect()
    assert sorted((r.scorer, r.classifier) for r in got) == [(s, "DecisionTree") for s in sorted(ml.SCORERS)]
    n = clean.skip_first(test.filter(F.col("station_id").isin(ids)), 3, order="bin").count()
    assert all(r.tp + r.tn + r.fp + r.fn == n for r in got)


def test_skip_first(spark):
    df = spark.createDataFrame([(s, b) for s in (1, 2) for b in range(5)], "station_id long, bin long")
    assert tuples(clean.skip_first(df), "station_id", "bin") == [(1, 3), (1, 4), (2, 3), (2, 4)]


def test_unknown_kind():
    with pytest.raises(ValueError):
        ml.classifier("svm")


def test_comparison(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0)], "tp long, tn long, fp long, fn long")
    assert tuples(ml.comparison({"a": rows, "b": rows}), "classifier") == [("a",), ("b",)]
