"""Lag features and tree classifiers for the next state of a station."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationmine.operators.classify import confusion, metrics
from stationmine.operators.clean import skip_first
from stationmine.operators.series import VALUES, lags, next_label, resample
from stationmine.scale import cut, fresh_path, join_small

# The two labels.
POSITIVE, NEGATIVE = "QP", "N"
# The tuned grids. Split sizes start at 2, since smaller ones are invalid.
GRIDS = {
    "dt": {"maxDepth": [2, 3, 4, 5], "minInstancesPerNode": [1, 2, 3], "impurity": ["gini", "entropy"]},
    "rf": {
        "numTrees": [10, 100, 1000],
        "maxDepth": [2, 3, 4, 5],
        "minInstancesPerNode": [1, 2],
        "impurity": ["gini", "entropy"],
    },
    "gbt": {"maxIter": [10, 100, 1000], "maxDepth": [2, 3, 4, 5]},
}
SCORERS = {"recall": "recallByLabel", "precision": "precisionByLabel", "f1": "fMeasureByLabel"}


def station_rows(status: DataFrame, station: DataFrame, minutes: int, width: int, limit: int = 2) -> DataFrame:
    """(station_id, city, bin, own, status) for all bins whose lags are known.

    ``own`` holds mean docks and bikes from the oldest lag to the newest; the label may be null.
    """
    city = station.select(F.col("id").alias("station_id"), "city")
    labelled = next_label(resample(status, minutes, "mean"), limit)
    ordered = [f"{c}_T{i}" for i in reversed(range(width)) for c in reversed(VALUES)]
    rows = lags(labelled, VALUES, width).select(
        "station_id", "bin", "status", F.array(*[F.col(c) for c in ordered]).alias("own")
    )
    return join_small(rows.filter(F.forall("own", lambda x: x.isNotNull())), city, ["station_id"])


def city_vectors(rows: DataFrame, station: DataFrame) -> DataFrame:
    """(city, bin, features): what all stations of a city hold, in order of their ids; bins that miss one are left out."""
    size = station.groupBy("city").agg(F.count(F.lit(1)).alias("n_stations"))
    return (
        rows.groupBy("city", "bin")
        .agg(F.array_sort(F.collect_list(F.struct("station_id", "own"))).alias("members"))
        .join(size, "city")
        .filter(F.size("members") == F.col("n_stations"))
        .select("city", "bin", F.flatten(F.transform("members", lambda m: m["own"])).alias("features"))
    )


def feature_table(
    status: DataFrame, station: DataFrame, minutes: int, width: int, limit: int = 2, only: list[int] | None = None
) -> DataFrame:
    """(station_id, city, bin, own, features, status) for every station as the one to predict.

    ``features`` is the vector of the station's city. It does not depend on the station to predict, so
    it is built once per city and bin, and joined to the labels of the stations asked for (``only``; else all).
    """
    rows = station_rows(status, station, minutes, width, limit)
    asked = rows if only is None else rows.filter(F.col("station_id").isin(only))
    return (
        asked.filter(F.col("status").isNotNull())
        .join(city_vectors(rows, station), ["city", "bin"])
        .select("station_id", "city", "bin", "own", "features", "status")
    )


def network_features(table: DataFrame, width: int) -> DataFrame:
    """Features of fixed width for one model over all stations: the station's own values and
    the mean over its city for each of them, from one grouped mean per city and bin."""
    n = width * len(VALUES)
    means = table.groupBy("city", "bin").agg(F.array(*[F.avg(F.col("own")[i]) for i in range(n)]).alias("city_mean"))
    return table.join(means, ["city", "bin"]).withColumn("features", F.concat("own", "city_mean")).drop("city_mean")


def class_weights(table: DataFrame, by: tuple = ("station_id",)) -> DataFrame:
    """Balanced weight per class: n / (2 * n of the class)."""
    counts = table.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n_class"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row per class
    return counts.withColumn("n_rows", F.sum("n_class").over(whole)).withColumn(
        "weight", F.col("n_rows") / (2.0 * F.col("n_class"))
    )


def with_weights(table: DataFrame, by: tuple = ("station_id",)) -> DataFrame:
    # weights are cut before their rows are counted, so that the table behind them is not run for that again
    return join_small(table, cut(class_weights(table, by).select(*by, "status", "weight")), [*by, "status"])


def to_vectors(table: DataFrame) -> DataFrame:
    """Vector features and a 0/1 label, 1 for QP."""
    return table.withColumn("features", array_to_vector("features")).withColumn(
        "label", (F.col("status") == POSITIVE).cast("double")
    )


def classifier(kind: str, weighted: bool = False, seed: int = 42, **params):
    if kind == "dt":
        model = DecisionTreeClassifier(seed=seed)
    elif kind == "rf":
        model = RandomForestClassifier(seed=seed, featureSubsetStrategy="sqrt")
    elif kind == "gbt":
        model = GBTClassifier(seed=seed)
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    if weighted:
        model = model.setWeightCol("weight")
    return model.setParams(**params) if params else model


def _named() -> SQLTransformer:
    return SQLTransformer(
        statement=f"SELECT *, IF(prediction = 1.0, '{POSITIVE}', '{NEGATIVE}') AS y_pred, "
        "status AS y_true FROM __THIS__"
    )


def fit(train: DataFrame, kind: str, weighted: bool = False, **params) -> PipelineModel:
    """A pipeline from vectors to named predictions; save and load it as any Spark pipeline."""
    return Pipeline(stages=[classifier(kind, weighted, **params), _named()]).fit(to_vectors(train))


class Constant:
    """Stands for a model where training rows have one label only."""

    def __init__(self, label: str):
        self.label = label

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("y_pred", F.lit(self.label)).withColumn("y_true", F.col("status"))


def fit_stations(
    train: DataFrame, stations: list[int], kind: str, parallelism: int = 4, **params
) -> dict[int, PipelineModel | Constant]:
    """One model per station of ``stations``; fits run side by side as Spark jobs.

    Rows are written once, in a folder per station, so a fit reads its own rows only. Stations without rows have no model.
    """
    path = fresh_path(train.sparkSession)
    train.filter(F.col("station_id").isin(stations)).repartition("station_id").write.partitionBy("station_id").parquet(path)
    parted = train.sparkSession.read.schema(train.schema).parquet(path)
    labels = {
        r["station_id"]: r["labels"]
        for r in parted.groupBy("station_id").agg(F.collect_set("status").alias("labels")).collect()
    }

    def one(s: int) -> PipelineModel | Constant:
        if len(labels[s]) == 1:
            return Constant(labels[s][0])
        return fit(parted.filter(F.col("station_id") == s), kind, **params)

    known = [s for s in stations if s in labels]
    with ThreadPool(parallelism) as pool:
        return dict(zip(known, pool.map(one, known)))


def stations_confusion(models: dict[int, PipelineModel | Constant], test: DataFrame) -> DataFrame:
    """Counts per station, each predicted by its own model; a station without model or rows has no row."""
    if not models:
        return station_confusion(persistence(test.limit(0)))
    found = [predictions(m, test.filter(F.col("station_id") == s)) for s, m in models.items()]
    return station_confusion(reduce(DataFrame.unionByName, found))


def predictions(model: PipelineModel, test: DataFrame) -> DataFrame:
    return model.transform(to_vectors(test)).select("station_id", "bin", "y_pred", "y_true")


def persistence(table: DataFrame, limit: int = 2) -> DataFrame:
    """Predict that the coming state is the current one. Newest docks are next to last in ``own``."""
    docks = F.element_at("own", -2)
    return table.select(
        "station_id",
        "bin",
        F.when(docks <= limit, POSITIVE).otherwise(NEGATIVE).alias("y_pred"),
        F.col("status").alias("y_true"),
    )


def station_confusion(preds: DataFrame) -> DataFrame:
    return confusion(preds, POSITIVE, by=("station_id",))


def micro_average(per_station: DataFrame) -> DataFrame:
    """Metrics of the counts summed over all stations."""
    return metrics(per_station.agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")]))


def tune(
    train: DataFrame,
    kind: str,
    scorer: str,
    grid: dict | None = None,
    class_weight: tuple[bool, ...] | None = None,
    folds: int = 3,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Grid search by cross validation on recall, precision or f1 of QP.

    ``class_weight`` is an axis of the grid: without and with balanced weights (column ``weight``) for
    single trees and forests, without for boosting, unless given. The best search of the axis is returned.
    """
    axis = class_weight if class_weight is not None else (False,) if kind == "gbt" else (False, True)
    rows = to_vectors(with_weights(train, ()) if True in axis and "weight" not in train.columns else train)
    evaluator = MulticlassClassificationEvaluator(metricName=SCORERS[scorer], metricLabel=1.0)
    found = []
    for weighted in axis:
        model = classifier(kind, weighted)
        builder = ParamGridBuilder()
        for name, values in (grid or GRIDS[kind]).items():
            builder = builder.addGrid(model.getParam(name), values)
        search = CrossValidator(
            estimator=Pipeline(stages=[model, _named()]),
            estimatorParamMaps=builder.build(),
            evaluator=evaluator,
            numFolds=folds,
            seed=42,
            parallelism=parallelism,
        )
        found.append(search.fit(rows))
    return max(found, key=lambda m: max(m.avgMetrics))


def tuned_comparison(
    train: DataFrame, test: DataFrame, stations: list[int], kinds: dict[str, str], grids: dict | None = None, **options
) -> DataFrame:
    """Overall metrics per scorer and classifier: one tuned model per station, tested without its first three rows."""
    rest = skip_first(test, 3, order="bin")
    out = []
    for scorer in SCORERS:
        results = {}
        for name, kind in kinds.items():
            models = {}
            for s in stations:
                own = train.filter(F.col("station_id") == s)
                labels = [r["status"] for r in own.select("status").distinct().collect()]
                if len(labels) == 1:
                    models[s] = Constant(labels[0])
                elif labels:
                    models[s] = tune(own, kind, scorer, (grids or {}).get(kind), **options).bestModel
            results[name] = micro_average(stations_confusion(models, rest))
        out.append(comparison(results).withColumn("scorer", F.lit(scorer)))
    return reduce(DataFrame.unionByName, out)


def comparison(results: dict[str, DataFrame]) -> DataFrame:
    """Overall metrics of several classifiers in one table."""
    tagged = [df.withColumn("classifier", F.lit(name)) for name, df in results.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out
