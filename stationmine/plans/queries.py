"""Query key → callable over a folder of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationmine.functions.columns import bin_time, pattern_key, register_sql_functions
from stationmine.operators import classify as cl
from stationmine.operators import clean, correlation, grid, inspect, ml, series, states, trees, trips, windows
from stationmine.operators import neighbors as nb
from stationmine.operators import patterns as pt
from stationmine.operators import sequences as sq
from stationmine.params import EXTRACTION_TYPES, MineParams
from stationmine.scale import cut, fresh_path, join_small, spread
from stationmine.sources import readers
from stationmine.sources.fixture import Fixture
from stationmine.sources.sinks import append_metrics, rules_to_line, stamp, write_csv, write_neighborhoods, write_rules_text

Query = Callable[[SparkSession, str], DataFrame]

# Parameters on the driver's tables; the oracle uses the same values.
P = MineParams(interval=720, window_size=3, ct=3, thr=1, n_neighbors=3, base_time="2024-01-01 00:00:00")
SPLIT = "2024-01-20 00:00:00"
SUPPORT = 0.1
MINUTES = 360
WIDTH = 3
LAGS = 5
PIVOT_CENTER, PIVOT_STATIONS = 1, [1, 2, 3, 4, 5]
TARGET = "AlmostFull"
CONF = 0.3
CONFS = [0.2, 0.3, 0.4]
KS = [1, 5]

_registry: dict[str, Query] = {}


def _tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, doubles to 6 digits, timestamps without zone."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "double":
            c = F.round(c, 6)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(name))
    return df.select(*cols)


def query(name: str):
    def keep(f: Callable[[Fixture], DataFrame]):
        _registry[name] = lambda spark, root: _tidy(f(Fixture(spark, root)))
        return f

    return keep


def edges(fx: Fixture) -> DataFrame:
    return trips.od_weights(fx.trip)


def small_edges(fx: Fixture) -> DataFrame:
    """Edges written once, for queries that read them several times."""
    return cut(edges(fx))


# --- sources -----------------------------------------------------------------------------

query("scan_status")(lambda fx: fx.status)
query("scan_station")(lambda fx: fx.station)
query("scan_trip")(lambda fx: fx.trip)
query("trip_page")(lambda fx: inspect.page(fx.trip, ["start_date", "id"], 55, 5))
query("profile")(lambda fx: inspect.profile(fx.status))


@query("status_file")
def _(fx: Fixture) -> DataFrame:
    """All readings written as CSV to the shared folder and read back."""
    path = fresh_path(fx.spark)
    write_csv(fx.status, path)
    return readers.read_status(fx.spark, path)


@query("edge_file")
def _(fx: Fixture) -> DataFrame:
    """Degrees of the trip graph from an edge file."""
    path = fresh_path(fx.spark)
    write_csv(edges(fx), path)
    return degrees_of(readers.read_edges(fx.spark, path), fx)


# --- cleaning ----------------------------------------------------------------------------

query("valid_readings")(lambda fx: clean.valid_readings(fx.status))
query("hour_zone")(lambda fx: clean.hour_zone(fx.status, 17, 18))
query("day_slot_counts")(
    lambda fx: clean.day_slots(fx.status).groupBy("day_slot").agg(F.count(F.lit(1)).alias("n"))
)
query("clean_status")(lambda fx: clean.drop_oscillating(fx.status, fx.station))
query("city_status")(lambda fx: clean.stations_in(fx.status, fx.station.filter(F.col("city").startswith("City"))))
query("time_split")(lambda fx: clean.time_split(fx.status, SPLIT))
query("day_slice")(lambda fx: clean.on_day(fx.status, "2024-01-12"))
query("critical_share")(lambda fx: clean.critical_share(fx.status))


@query("skip_first")
def _(fx: Fixture) -> DataFrame:
    bins = clean.since(stamp(series.resample(fx.status, MINUTES)), SPLIT)
    return clean.skip_first(bins, 3, order="time")


# --- states ------------------------------------------------------------------------------


def _states(fx: Fixture, **changes) -> DataFrame:
    return states.slot_states(fx.status, P.but(**changes))


for _side in ("Full", "Empty"):
    _kind = "Full-AlmostFull" if _side == "Full" else "Empty-AlmostEmpty"
    query(f"state_{_side.lower()}")(
        lambda fx, kind=_kind: states.per_reading(fx.status, P.but(extraction_type=kind)).select(
            "station_id", "time", "slot", "state"
        )
    )

query("slot_state_full")(lambda fx: _states(fx))
query("dense_slots")(lambda fx: states.dense_slots(clean.valid_readings(fx.status), 30))
query("slot_trend")(lambda fx: states.slot_trends(fx.status, P))
query("slot_level")(lambda fx: states.slot_levels(fx.status, P.but(extraction_type="Empty-Increase")))
query("slot_state_change")(lambda fx: _states(fx, extraction_type="Full-Decrease", state_change=True))
query("slot_negatives")(lambda fx: _states(fx, extraction_type="Empty-Increase", no_increase=True))
query("slot_states_test")(
    lambda fx: _states(fx, extraction_type="Full-Increase", for_test=True, wrap_states=True)
)


@query("minute_states")
def _(fx: Fixture) -> DataFrame:
    """The SQL form: temporary view, SQL function and GROUP BY as distinct."""
    register_sql_functions(fx.spark, P.ct)
    clean.valid_readings(fx.status).createOrReplaceTempView("readings")
    return fx.spark.sql(
        """
        SELECT station_id, year(time) AS year, month(time) AS month, day(time) AS day,
               hour(time) AS hour, minute(time) AS minute,
               state_full(docks_available, bikes_available) AS status
        FROM readings
        WHERE state_full(docks_available, bikes_available) < 2
        GROUP BY ALL
        """
    )


# --- windows, neighbours, sequences ------------------------------------------------------

query("slot_itemsets")(lambda fx: states.slot_items(_states(fx)))
query("complete_slots")(lambda fx: _states(fx, for_test=True, drop_nulls=True, tot_stations=79))


@query("window_expand")
def _(fx: Fixture) -> DataFrame:
    rows = windows.expand_windows(cut(_states(fx)), P.window_size)
    return rows.groupBy("win").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("slot").alias("n_slots"))


query("window_t")(lambda fx: windows.expand_windows(cut(_states(fx)), P.window_size))
query("station_distance")(lambda fx: nb.station_pairs(fx.station, 3.0))
query("neighbors_distance")(lambda fx: nb.distance_neighbors(fx.station, P.th, P.max_delta))
query("neighbors_trips")(lambda fx: nb.trip_neighbors(edges(fx), fx.station, P.n_neighbors, "Full", P.th))


@query("labels")
def _(fx: Fixture) -> DataFrame:
    found = cut(_states(fx))
    # a state meets all its neighbours and windows: spread before it does, over as many tasks as that needs
    parts = -(-found.count() // sq.STATES)
    near = spread(nb.neighbors(fx.station, P), "station_id", parts=parts)
    seen = sq.labelled_items(spread(found, "slot", "station_id", parts=parts), near)
    # a slot has one place in a window, so what is distinct per slot is so in each of its windows
    once = seen.select("slot", "center", "state", "delta").distinct()
    timed = join_small(once, windows.window_map(found, P.window_size), ["slot"])
    label = F.concat(F.col("state"), F.lit("_T"), F.col("t"), F.lit("_"), F.col("delta"))
    return timed.select("win", "center", "t", label.alias("label"))


def sequences(fx: Fixture, p: MineParams, status: DataFrame | None = None) -> DataFrame:
    graph = edges(fx) if p.neighborhood == "indegree" else None
    return sq.extract(fx.status if status is None else status, fx.station, p, graph)


# one query per extraction type; the trip neighbourhood serves one type of each side
_SEQUENCES = {
    "Full-AlmostFull": {},
    "Empty-AlmostEmpty": {"wrap_states": True, "for_test": True},
    "Full-Decrease": {"no_increase": True},
    "Empty-Increase": {"neighborhood": "indegree"},
    "Full-Increase": {"neighborhood": "indegree", "no_decrease": True},
    "Empty-Decrease": {"state_change": True},
}


def sequence_params(kind: str) -> MineParams:
    return P.but(extraction_type=kind, **_SEQUENCES[kind])


for _kind in EXTRACTION_TYPES:
    query("sequences_" + _kind.lower().replace("-", "_"))(
        lambda fx, kind=_kind: sq.sequence_text(sequences(fx, sequence_params(kind)))
    )


@query("sequences_v1")
def _(fx: Fixture) -> DataFrame:
    found = cut(states.dense_slot_states(fx.status, P.but(interval=30)))
    near = nb.distance_neighbors(fx.station, P.th, P.max_delta)
    return sq.sequence_text(sq.build_sequences(found, near, P, dedup=False, base=1))


# --- patterns and rules ------------------------------------------------------------------


def mined(fx: Fixture, p: MineParams = P, max_items: int = 5, status: DataFrame | None = None) -> DataFrame:
    return pt.frequent_patterns(sequences(fx, p, status), SUPPORT, max_items)


def mined_rules(fx: Fixture, p: MineParams = P, status: DataFrame | None = None) -> DataFrame:
    return pt.rules(mined(fx, p, status=status))


_RULE = ["key", "antecedent_key", "consequent_key", "conf", "sup"]

query("patterns")(lambda fx: mined(fx).select("key", "freq"))
query("patterns_focal")(lambda fx: pt.focal(mined(fx)).select("key", "freq"))
query("rules")(lambda fx: mined_rules(fx).select(*_RULE))
query("rules_by_conf")(lambda fx: pt.rank_rules(mined_rules(fx), "conf").select("rank", "key", "conf", "sup"))
query("rules_by_sup")(lambda fx: pt.rank_rules(mined_rules(fx), "sup").select("rank", "key", "conf", "sup"))
query("pattern_stats")(lambda fx: pt.pattern_stats(mined(fx)))
query("rules_mixed")(lambda fx: pt.mixed_state(mined_rules(fx), P.extraction_type).select(*_RULE))
query("rules_influence")(lambda fx: pt.influence(mined_rules(fx)).select(*_RULE))
query("conf_hist_whole")(lambda fx: pt.conf_hist(mined_rules(fx), whole=True))
query("conf_hist")(lambda fx: pt.conf_hist(mined_rules(fx)))
query("conf_curve")(lambda fx: pt.conf_curve(mined_rules(fx), CONF))
query("support_sweep")(lambda fx: pt.support_sweep(sequences(fx, P), [0.1, 0.2, 0.3]))
query("rule_lines")(lambda fx: rules_to_line(mined_rules(fx)).select("key", "sup", "line"))


@query("mine_grid")
def _(fx: Fixture) -> DataFrame:
    both = [P, P.but(extraction_type="Empty-AlmostEmpty", n_neighbors=2, neighborhood="indegree")]
    return grid.mine_grid(fx.status, fx.station, both, SUPPORT, small_edges(fx)).select(
        "extraction", "neighborhood", *_RULE
    )


@query("rules_text_roundtrip")
def _(fx: Fixture) -> DataFrame:
    """Rules written as text to the shared folder and read back."""
    path = fresh_path(fx.spark)
    write_rules_text(mined_rules(fx), path)
    return readers.read_rules_text(fx.spark, path).select("key", "conf", "sup")


# --- associative classifier --------------------------------------------------------------

TRAIN = P.but(wrap_states=True)
TEST = TRAIN.but(for_test=True)


def split_status(fx: Fixture, part: str) -> DataFrame:
    return clean.before(fx.status, SPLIT) if part == "train" else clean.since(fx.status, SPLIT)


def labelled_test(fx: Fixture) -> DataFrame:
    found = sequences(fx, TEST, split_status(fx, "test"))
    return cl.label_sequences(found, TARGET, P.window_size)


def several_slots(fx: Fixture) -> DataFrame:
    """Test sequences of two slots or more, with a label or without."""
    return sequences(fx, TEST, split_status(fx, "test")).filter(F.size("sequence") > 1)


def train_rules(fx: Fixture) -> DataFrame:
    return mined_rules(fx, TRAIN, split_status(fx, "train"))


def aimed(fx: Fixture, conf: float = CONF) -> DataFrame:
    return cl.target_rules(train_rules(fx), TARGET, conf)


query("rules_target")(lambda fx: aimed(fx).select("key", "conf", "sup"))
query("seq_labels")(
    lambda fx: labelled_test(fx).select("win", "center", pattern_key("sequence").alias("sequence"), "y_true")
)
query("rule_matches")(lambda fx: cl.rule_matches(labelled_test(fx), aimed(fx)))
query("predictions")(lambda fx: cl.predict(labelled_test(fx), aimed(fx), TARGET))
query("confusion")(lambda fx: cl.confusion(cl.predict(labelled_test(fx), aimed(fx), TARGET), TARGET))
query("metrics")(lambda fx: cl.metrics(cl.confusion(cl.predict(labelled_test(fx), aimed(fx), TARGET), TARGET)))
query("match_log")(lambda fx: cl.explain_matches(several_slots(fx), aimed(fx), 2))
query("baseline_persistence")(
    lambda fx: cl.metrics(
        cl.confusion(cl.predict(labelled_test(fx), cl.persistence_rule(fx.spark, TARGET), TARGET), TARGET)
    )
)
query("classifier_grid")(lambda fx: cl.evaluate_grid(labelled_test(fx), train_rules(fx), TARGET, CONFS, KS))

#: The sweep: neighbourhood, its size, extraction type, for two critical thresholds. Fixed values.
_SWEPT = [
    ("indegree", 10, "Empty-AlmostEmpty"),
    ("distance", 10, "Empty-AlmostEmpty"),
    ("indegree", 10, "Empty-Increase"),
    ("distance", 10, "Empty-Increase"),
    ("indegree", 10, "Empty-Decrease"),
    ("indegree", 0, "Empty-Decrease"),
    ("distance", 10, "Empty-Decrease"),
]
SWEEP = [
    P.but(neighborhood=n, n_neighbors=size, extraction_type=kind, ct=ct, wrap_states=True)
    for ct in (1, 2)
    for n, size, kind in _SWEPT
]
SWEEP_TARGET, SWEEP_SUPPORT, SWEEP_CONFS = "AlmostEmpty", 0.05, [0.1, 0.2, 0.3, 0.4]


@query("classifier_sweep")
def _(fx: Fixture) -> DataFrame:
    found = grid.evaluate_configs(
        split_status(fx, "train"), split_status(fx, "test"), fx.station, SWEEP, SWEEP_TARGET, SWEEP_SUPPORT, SWEEP_CONFS, KS,
        small_edges(fx),
    )
    return found.drop("interval", "thr")


@query("metrics_roundtrip")
def _(fx: Fixture) -> DataFrame:
    """The grid's metrics appended as CSV to the shared folder and read back."""
    path = fresh_path(fx.spark)
    append_metrics(cl.evaluate_grid(labelled_test(fx), train_rules(fx), TARGET, CONFS, KS, grid.tags(TEST)), path)
    return readers.read_metrics(fx.spark, path)


# --- series ------------------------------------------------------------------------------


def mean_series(fx: Fixture) -> DataFrame:
    return series.resample(fx.status, MINUTES)


query("resample_mean")(lambda fx: stamp(mean_series(fx)))
query("resample_sum")(lambda fx: stamp(series.resample(fx.status, MINUTES, "sum")))
query("resample_count")(lambda fx: stamp(series.resample(fx.status, MINUTES, "count")))
query("lag_features")(lambda fx: stamp(series.lags(mean_series(fx), series.VALUES, WIDTH)))
query("next_label")(lambda fx: stamp(series.next_label(mean_series(fx))).select("station_id", "time", "status"))


def profile(fx: Fixture) -> DataFrame:
    return series.daily_profile(series.deltas(series.resample(fx.status, MINUTES, "sum")))


query("bike_deltas")(lambda fx: stamp(series.deltas(mean_series(fx))))
query("daily_profile")(profile)
query("profile_long")(lambda fx: series.profile_long(profile(fx)))
query("occupancy")(lambda fx: series.occupancy(fx.status))
query("window_flags")(lambda fx: stamp(series.window_flags(fx.status, P.interval)))
query("transition_rate")(
    lambda fx: series.transition_rate(series.window_flags(fx.status, P.interval), P.interval)
)
query("busy_departures")(lambda fx: series.busy_intervals(fx.trip, "start", MINUTES))
query("busy_arrivals")(lambda fx: series.busy_intervals(fx.trip, "end", MINUTES))
query("busy_totals")(lambda fx: series.busy_totals(series.busy_intervals(fx.trip, "end", MINUTES)))
query("net_flow")(lambda fx: stamp(series.net_flow(fx.trip, MINUTES)))
query("rebuild_status")(lambda fx: stamp(series.rebuild_status(fx.status, fx.trip, MINUTES)))
query("rebuild_reset")(lambda fx: stamp(series.rebuild_status(fx.status, fx.trip, MINUTES, reset=True)))
query("null_audit")(lambda fx: series.null_audit(fx.status, MINUTES, SPLIT))
query("null_totals")(lambda fx: series.null_totals(series.null_audit(fx.status, MINUTES, SPLIT)))
query("span")(lambda fx: series.span(fx.trip, "start_date", "end_date"))

# --- correlation -------------------------------------------------------------------------

query("nbrs_in")(lambda fx: nb.graph_neighbors(edges(fx), "in"))
query("nbrs_both")(lambda fx: nb.graph_neighbors(small_edges(fx), "both"))
query("neighborhood_wide")(
    lambda fx: stamp(
        correlation.neighborhood_wide(fx.status, nb.graph_neighbors(small_edges(fx), "in"), MINUTES, WIDTH)
    )
)
query("lag_corr")(
    lambda fx: correlation.lag_correlation(fx.status, nb.graph_neighbors(edges(fx), "in"), MINUTES, LAGS)
)
query("lag_corr_slot")(
    lambda fx: correlation.lag_correlation(
        fx.status, nb.graph_neighbors(small_edges(fx), "both"), 1440, LAGS, by_day_slot=True
    )
)


@query("neighborhood_tables")
def _(fx: Fixture) -> DataFrame:
    """The wide tables of all centres, written by centre and read back."""
    long = correlation.neighborhood_wide(fx.status, nb.graph_neighbors(small_edges(fx), "in"), MINUTES, WIDTH)
    tables, path = correlation.neighborhood_tables(long, WIDTH), fresh_path(fx.spark)
    write_neighborhoods(tables, path)
    number = lambda x: F.coalesce(F.round(x * 1000).cast("bigint").cast("string"), F.lit("-"))
    values = lambda k: F.concat(k.cast("string"), F.lit(":"), F.concat_ws(",", F.transform(F.col("lags")[k], number)))
    text = F.concat_ws(";", F.transform(F.array_sort(F.map_keys("lags")), values))
    return stamp(fx.spark.read.schema(tables.schema).parquet(path)).select("center", "time", text.alias("stations"))


@query("neighborhood_pivot")
def _(fx: Fixture) -> DataFrame:
    """The wide table of one centre."""
    near = nb.graph_neighbors(small_edges(fx), "in").filter(F.col("center") == PIVOT_CENTER)
    long = correlation.neighborhood_wide(fx.status, near, MINUTES, WIDTH)
    return stamp(correlation.pivot_neighborhood(long, PIVOT_CENTER, PIVOT_STATIONS, WIDTH))


# --- trips and graph ---------------------------------------------------------------------

query("graph_size")(lambda fx: trips.graph_size(fx.trip))
query("od_weights")(edges)
query("edge_importance")(lambda fx: trips.edge_importance(edges(fx)))
query("weight_stats")(lambda fx: trips.weight_stats(edges(fx)))
query("duration_box")(
    lambda fx: trips.box_stats(
        fx.trip.select((F.col("duration") / 60).alias("minutes"), "subscription_type"), "minutes", "subscription_type"
    )
)
query("weight_box")(lambda fx: trips.box_stats(edges(fx), "weight"))
query("components")(lambda fx: trips.component_sizes(trips.components(small_edges(fx), 12)))


def degrees_of(weights: DataFrame, fx: Fixture) -> DataFrame:
    return trips.degrees_city(trips.degrees(weights), fx.station)


def degree_table(fx: Fixture) -> DataFrame:
    return degrees_of(edges(fx), fx)


query("degrees")(degree_table)
query("top_stations")(lambda fx: trips.top_stations(degree_table(fx)))
query("bottom_stations")(lambda fx: trips.top_stations(degree_table(fx), bottom=True))
query("top_per_city")(lambda fx: trips.top_per_group(degree_table(fx)))
query("self_loops")(lambda fx: trips.self_loops(edges(fx)))
query("hourly_share")(lambda fx: trips.hourly_share(fx.trip))


def speeds(fx: Fixture) -> DataFrame:
    return trips.trip_speed(fx.trip, fx.station).select(
        "id", "start_station_id", "end_station_id", "duration", "distance", "avg_speed"
    )


query("trip_speed")(speeds)
query("far_trips")(lambda fx: speeds(fx).filter(F.col("distance") >= 2.5))
query("fast_trips")(lambda fx: speeds(fx).filter(F.col("avg_speed") >= 60))

# --- comparison classifiers --------------------------------------------------------------

DAY = 1440


def features(fx: Fixture) -> DataFrame:
    return ml.feature_table(fx.status, fx.station, DAY, WIDTH)


CITY = "San Francisco"
#: Sizes of the models: a tree as deep as Spark allows, a hundred such trees, a hundred rounds of depth six.
MODELS = {
    "DecisionTree": ("dt", {"maxDepth": 30}),
    "RandomForest": ("rf", {"numTrees": 100, "maxDepth": 30}),
    "BoostedTrees": ("gbt", {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3}),
}


def city_stations(fx: Fixture) -> list[int]:
    """Stations of one city, each to get a model of its own."""
    return [r["id"] for r in fx.station.filter(F.col("city") == CITY).select("id").orderBy("id").collect()]


def station_splits(fx: Fixture) -> tuple[DataFrame, DataFrame, list[int]]:
    ids = city_stations(fx)
    # models read their rows many times: written once
    rows = cut(ml.feature_table(fx.status, fx.station, DAY, WIDTH, only=ids).withColumn("time", bin_time("bin")))
    return clean.before(rows, SPLIT), clean.since(rows, SPLIT), ids


@query("feature_table")
def _(fx: Fixture) -> DataFrame:
    text = F.concat_ws(",", F.transform("features", lambda x: F.round(x * 1000).cast("bigint").cast("string")))
    return stamp(features(fx)).select("station_id", "city", "time", text.alias("features"), "status")


def scored(splits: tuple[DataFrame, DataFrame, list[int]], name: str) -> DataFrame:
    train, test, ids = splits
    kind, params = MODELS[name]
    return ml.stations_confusion(ml.fit_stations(train, ids, kind, **params), test)


def support_of(confusion: DataFrame, *by: str) -> DataFrame:
    """Rows tested and those that were positive, which do not depend on a model's choices."""
    return confusion.groupBy(*by).agg(
        F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n_rows"),
        F.sum(F.col("tp") + F.col("fn")).alias("n_positive"),
    )


for _name, _key in zip(MODELS, ("dt", "rf", "gbt")):
    query(f"{_key}_confusion")(lambda fx, name=_name: support_of(scored(station_splits(fx), name), "station_id"))
query("station_metrics")(lambda fx: cl.metrics(ml.station_confusion(ml.persistence(features(fx)))))
query("micro_metrics")(lambda fx: ml.micro_average(ml.station_confusion(ml.persistence(features(fx)))))
query("class_weights")(lambda fx: ml.class_weights(features(fx)))


@query("classifier_comparison")
def _(fx: Fixture) -> DataFrame:
    splits = station_splits(fx)
    found = ml.comparison({name: scored(splits, name) for name in MODELS})
    return support_of(found, "classifier")


# --- one tree per station, all of them at once ---------------------------------------------

#: Limits of single trees and of forests; the grid that is searched; folds.
TREE_DEPTH, FOREST, FOREST_DEPTH, FOLDS = 5, 100, 10, 3
POINTS = ([2, 3, 4, 5], [1, 2, 3], [False, True])


def tree_rows(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of all stations of every city, binned by whole docks and bikes."""
    x = trees.cells(F.transform("features", lambda v: F.round(v, 6)))
    y = (F.col("status") == ml.POSITIVE).cast("int")
    rows = cut(table.select("station_id", bin_time("bin").alias("time"), x.alias("x"), y.alias("y"), F.lit(1).alias("w")))
    return clean.before(rows, SPLIT), clean.since(rows, SPLIT)


def limited(rows: DataFrame, depth: int) -> DataFrame:
    return rows.select("*", F.lit(depth).alias("depth"), F.lit(1).alias("least"), F.lit(False).alias("entropy"))


def hits(routed: DataFrame, hit: Column, *by: str) -> DataFrame:
    """Counts per ``by`` of rows whose prediction is ``hit`` and whose truth is y."""
    cells_ = cl._cells(hit, F.col("y") == 1)
    return routed.groupBy(*by).agg(*[c.alias(n) for n, c in cells_.items()])


def majority() -> Column:
    return 2 * F.col("p") > F.col("n")


@query("tree_confusion")
def _(fx: Fixture) -> DataFrame:
    """A tree per station of every city, saved, loaded and applied to what came later."""
    train, test = tree_rows(features(fx))
    path = fresh_path(fx.spark)
    trees.save(trees.grow(limited(train, TREE_DEPTH), ["station_id"]), path)
    return hits(trees.route(test, trees.load(fx.spark, path)), majority(), "station_id")


@query("network_tree_confusion")
def _(fx: Fixture) -> DataFrame:
    """One tree for the whole network, on each station's values and its city's means."""
    train, test = tree_rows(ml.network_features(features(fx), WIDTH))
    whole = F.lit(0).alias("network")
    model = trees.grow(limited(train, TREE_DEPTH).select("*", whole), ["network"])
    return hits(trees.route(test.select("*", whole), model), majority(), "station_id")


@query("forest_confusion")
def _(fx: Fixture) -> DataFrame:
    """A forest per station, all trees of all stations grown together."""
    train, test = tree_rows(features(fx))
    n = F.size("x")
    width = train.select(F.max(F.ceil(F.sqrt(n)))).first()[0] or 1
    model = trees.grow(limited(trees.drawn(train, FOREST, ["station_id", "time"]), FOREST_DEPTH), ["station_id", "tree"], width)
    many = test.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(FOREST - 1))))
    voted = trees.vote(trees.route(many, model), ["station_id", "time", "y"])
    return hits(voted, F.col("positive"), "station_id")


@query("tuned_trees")
def _(fx: Fixture) -> DataFrame:
    """Per scorer: overall metrics of trees whose limits were chosen per station by cross validation."""
    train, test = tree_rows(features(fx))
    counts = cl._cells(F.col("hit"), F.col("y") == 1)
    points = trees.grid_points(train, *POINTS)
    folds = cl.metrics(trees.cross_validated(points, ["station_id", "point"], ["station_id", "time"], FOLDS, counts))
    scorers = F.explode(F.array(*[F.struct(F.lit(s).alias("scorer"), F.coalesce(F.col(s), F.lit(0.0)).alias("value")) for s in ml.SCORERS]))
    means = folds.select("station_id", "point", scorers.alias("s")).groupBy("station_id", "s.scorer", "point").agg(F.round(F.avg("s.value"), 9).alias("mean"))
    best = means.groupBy("station_id", "scorer").agg(F.max(F.struct("mean", (-F.col("point")).alias("p")))["p"].alias("p"))
    chosen = cut(best.select("station_id", "scorer", (-F.col("p")).alias("point")))
    model = trees.grow(points.join(chosen.select("station_id", "point").distinct(), ["station_id", "point"], "left_semi"), ["station_id", "point"])
    rest = clean.skip_first(test, 3, order="time").join(chosen, "station_id")
    return cl.metrics(hits(trees.route(rest, model), majority(), "scorer"))


def queries() -> dict[str, Query]:
    return dict(_registry)


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Which neighbouring states lead a station to be almost full? Rules, best first."""
    fx = Fixture(spark, root)
    return _tidy(pt.rank_rules(mined_rules(fx)).select("rank", *_RULE))
