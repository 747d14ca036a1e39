"""Trip graph operators against plain loops and numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationmine.operators import trips
from tests.conftest import tuples

EDGE = "start_id long, end_id long, weight long"


def random_edges(seed, nodes=40, n=45):
    rng = random.Random(seed)
    found = {(rng.randrange(nodes), rng.randrange(nodes)): rng.randint(1, 20) for _ in range(n)}
    return [(*k, w) for k, w in found.items()]


def plain_components(edges, limit):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, w in edges:
        if w > limit:
            root.setdefault(a, a), root.setdefault(b, b)
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return sorted((x, find(x)) for x in root)


@pytest.mark.parametrize(
    "edges",
    [
        random_edges(1),
        [(i, i + 1, 9) for i in range(200)],
        [(i + 1, i, 9) if i % 3 else (i, i + 1, 9) for i in range(60)],
        [(0, i, 9) for i in range(1, 100)] + [(500, 500, 9), (600, 601, 9)],
        [(5, 5, 1)],
    ],
    ids=["random", "path", "zigzag", "hub", "light"],
)
def test_components(spark, edges):
    got = trips.components(spark.createDataFrame(edges, EDGE), 5)
    assert tuples(got, "id", "component") == plain_components(edges, 5)


@pytest.mark.parametrize("seed", range(6))
def test_spanning_stars(seed):
    edges = random_edges(seed, 30, 10 + 10 * seed)
    u, v, _ = (np.array(x) for x in zip(*edges))
    ids, roots = trips.spanning_stars(u, v)
    assert list(zip(ids, roots)) == plain_components(edges, 0)


def test_forests_hold_few_nodes(spark, monkeypatch):
    edges = random_edges(9, 300, 900)
    monkeypatch.setattr(trips, "FOLD_EDGES", 20)
    monkeypatch.setattr(trips, "FOREST_NODES", 50)
    batches = spark.createDataFrame(edges, EDGE).select("start_id", "end_id").toArrow().to_batches(max_chunksize=16)
    made = [(u, v, 1) for b in trips._forests(iter(batches)) for u, v in zip(*(c.to_pylist() for c in b.columns))]
    assert plain_components(made, 0) == plain_components(edges, 0)


def test_rows_of_a_hub_are_dealt(spark):
    """A node with a third of all rows: the least neighbours are the same, and no key holds more than about its share."""
    rows = [(0, i) for i in range(1, 1001)] + [(1000 + i % 500, 5000 + i) for i in range(2000)]
    df = spark.createDataFrame(rows, "u long, v long")
    least = df.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
    got = trips._least_around(df, least, len(rows))
    want = {u: min(b for a, b in rows if a == u) for u in {a for a, _ in rows}}
    assert tuples(got, "u", "v", "m") == sorted((u, v, want[u]) for u, v in rows)
    share = len(rows) // (trips.HUB_SHARES * 8)
    dealt, _ = trips._dealt(df, least, len(rows))
    assert dealt.groupBy("u", "part").count().agg(F.max("count")).first()[0] < 2 * share


def test_component_sizes(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, component long")
    assert tuples(trips.component_sizes(df), "id", "size") == [(1, 2), (2, 2), (3, 1)]


def test_box_stats(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1.0, 2.5, 3.0, 50.0, rng.random() * 9]), rng.choice("ab")) for _ in range(200)]
    got = {r.kind: r for r in trips.box_stats(spark.createDataFrame(rows, "v double, k string"), "v", "k").collect()}
    for kind in ("all", "a", "b"):
        v = np.array([x for x, k in rows if kind in ("all", k)])
        q1, q2, q3 = np.percentile(v, [25, 50, 75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        r = got[kind]
        assert (r.n_rows, r.n_outliers) == (len(v), len(v) - len(inside))
        np.testing.assert_allclose(
            [r.q1, r["median"], r.q3, r.whisker_low, r.whisker_high], [q1, q2, q3, inside.min(), inside.max()]
        )


def test_degrees(spark):
    edges = spark.createDataFrame([(1, 2, 5), (1, 1, 3), (3, 1, 2)], EDGE)
    cols = ("station", "in_deg", "out_deg", "w_in", "w_out")
    assert tuples(trips.degrees(edges), *cols) == [(1, 2, 2, 5, 8), (2, 1, 0, 5, 0), (3, 0, 1, 0, 2)]
    assert tuples(trips.degrees(edges, compat=True), *cols)[0] == (1, 2, 2, 8, 5)
    assert tuple(trips.self_loops(edges).first()) == (1, 2)
    assert tuple(trips.weight_stats(edges).first()) == (3, pytest.approx(10 / 3))


def test_tops(spark):
    rows = [(i, i % 3, "ab"[i % 2]) for i in range(10)]
    deg = spark.createDataFrame(rows, "station long, w_in long, city string")
    assert [r.station for r in trips.top_stations(deg, 3).collect()] == [2, 5, 8]
    assert [r.station for r in trips.top_stations(deg, 2, bottom=True).collect()] == [0, 3]
    got = tuples(trips.top_per_group(deg, 2), "city", "rank", "station")
    assert got == [("a", 1, 2), ("a", 2, 8), ("b", 1, 5), ("b", 2, 1)]


def test_graph_and_hours(spark):
    df = spark.createDataFrame(
        [(1, 1, 2, "2024-01-01 05:10:00"), (2, 1, 2, "2024-01-01 05:59:59"), (3, 2, 2, "2024-01-01 06:00:00")],
        "id long, start_station_id long, end_station_id long, t string",
    ).selectExpr("*", "cast(t as timestamp) start_date")
    assert tuple(trips.graph_size(df).first()) == (2, 2)
    assert tuples(trips.od_weights(df), "start_id", "end_id", "weight") == [(1, 2, 2), (2, 2, 1)]
    shares = tuples(trips.hourly_share(df), "hour", "n_trips", "percent")
    assert len(shares) == 24 and shares[5] == (5, 2, pytest.approx(200 / 3)) and shares[0] == (0, 0, 0.0)


def test_trip_speed(spark):
    station = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0)], "id long, lat double, long double")
    df = spark.createDataFrame(
        [(1, 1, 2, 3600), (2, 1, 1, 60), (3, 1, 9, 60), (4, 1, 2, 0)],
        "id long, start_station_id long, end_station_id long, duration long",
    )
    got = {r.id: r for r in trips.trip_speed(df, station).collect()}
    degree = 6373.0 * np.pi / 180
    assert got[1].distance == pytest.approx(degree) and got[1].avg_speed == pytest.approx(degree)
    assert (got[1].duration, got[2].distance, got[3].distance, got[4].avg_speed) == (60.0, 0.0, None, None)
