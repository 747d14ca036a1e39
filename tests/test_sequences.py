"""Windows, neighbours and sequences against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stationmine.operators import neighbors as nb
from stationmine.operators import sequences as sq
from stationmine.operators import windows
from stationmine.params import EXTRACTION_TYPES, MineParams
from stationmine.functions.columns import delta_of
from tests.conftest import tuples


def states_frame(spark, rows):
    return spark.createDataFrame(rows, "slot long, station_id long, state string")


def test_gap_and_positional_index(spark):
    ss = states_frame(spark, [(5, 1, "Full"), (7, 1, "Full")])
    got = tuples(windows.expand_windows(ss, 3), "win", "slot", "t")
    assert got == [(3, 5, 0), (4, 5, 0), (5, 5, 0), (5, 7, 1), (6, 7, 0), (7, 7, 0)]
    clock = tuples(windows.expand_windows(ss, 3, t_index="clock"), "win", "slot", "t")
    assert clock == [(3, 5, 2), (4, 5, 1), (5, 5, 0), (5, 7, 2), (6, 7, 1), (7, 7, 0)]


def test_number_of_windows(spark):
    ss = states_frame(spark, [(s, 1, "Full") for s in range(-2, 9)])
    assert windows.expand_windows(ss, 4).count() == sum(min(4, s + 1) for s in range(9))
    assert windows.expand_windows(ss, 4, base=1).count() == sum(min(4, s) for s in range(1, 9))


def km(a, b):
    (la, oa), (lb, ob) = (tuple(map(math.radians, x)) for x in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
    return 6373.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("center,radius", [((37.7, -122.4), 2.0), ((89.99, 10.0), 3.0), ((0.0, 179.995), 1.5)])
def test_grid_join_finds_every_close_pair(spark, center, radius):
    rng = random.Random(1)
    points = []
    for i in range(120):
        lat = min(90.0, center[0] + rng.uniform(-0.04, 0.04))
        lon = center[1] + rng.uniform(-0.04, 0.04) * (1 if center[0] < 80 else 4000)
        points.append((i, lat, (lon + 180) % 360 - 180))
    station = spark.createDataFrame(points, "id long, lat double, long double")
    want = {
        (a, b)
        for a, la, oa in points
        for b, lb, ob in points
        if a < b and km((la, oa), (lb, ob)) <= radius
    }
    assert set(tuples(nb.station_pairs(station, radius), "id_a", "id_b")) == want
    assert want


def test_a_crowded_cell_is_shared(spark):
    """Half of the stations at one point: the same pairs, and no key with more than a block of either side."""
    rng = random.Random(5)
    points = [(i, 37.0, -122.0) if i % 2 else (i, 37 + rng.random() / 10, -122 + rng.random() / 10) for i in range(240)]
    station = spark.createDataFrame(points, "id long, lat double, long double")
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and km(a[1:], b[1:]) <= 2}
    assert set(tuples(nb.station_pairs(station, 2.0, block=16), "id_a", "id_b")) == want
    cells = nb._on_grid(station, 2.0).withColumnRenamed("id", "id_b")
    crowded = nb._blocks(cells, 16)
    assert not crowded.isEmpty()
    for own, other, rows in (("b", "a", cells), ("a", "b", nb._around(cells.withColumnRenamed("id_b", "id_a")))):
        dealt = nb._dealt(rows, crowded, own, other).join(cells.select(*nb.CELL).distinct(), nb.CELL)
        assert dealt.groupBy(*nb.CELL, "part_a", "part_b").count().agg(F.max("count")).first()[0] <= 32


def test_delta_steps(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.50001,), (1.5,), (1.5000001,)], "d double")
    assert [r[0] for r in df.select(delta_of(df.d, 0.5)).collect()] == [1, 1, 2, 3, 4]


def test_self_loop_takes_a_place(spark):
    edges = spark.createDataFrame(
        [(1, 1, 9), (2, 1, 5), (3, 1, 5), (4, 1, 1)], "start_id long, end_id long, weight long"
    )
    assert tuples(nb.top_partners(edges, 3, "Full"), "center", "station_id") == [(1, 1), (1, 2), (1, 3)]
    assert tuples(nb.top_partners(edges, 0, "Full"), "center") == []
    assert tuples(nb.top_partners(edges, 1, "Empty"), "center", "station_id") == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert tuples(nb.graph_neighbors(edges, "both"), "center", "station_id") == [
        (1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (3, 1), (4, 1),
    ]


def counts(state, own, kind):
    second = kind.split("-")[1]
    if kind == "Full-Increase":
        return state not in ("Decrease", "NoIncrease")
    if kind == "Empty-Decrease":
        return state != "Increase"
    if kind in ("Full-Decrease", "Empty-Increase"):
        if not own:
            return state in (second, "NoIncrease")
        return state != second and not (kind == "Full-Decrease" and state == "NoIncrease")
    return True


def plain_sequences(rows, nbrs, size, kind, dedup=True, base=0):
    by_slot = {}
    for slot, station, state in rows:
        if slot >= base:
            by_slot.setdefault(slot, []).append((station, state))
    out = []
    for win in range(base, max(by_slot, default=-1) + 1):
        filled = [by_slot[s] for s in range(win, win + size) if s in by_slot]
        if not filled:
            continue
        heads = [c for c, _ in filled[0]]
        for center in sorted(set(heads)) if dedup else sorted(heads):
            seq = []
            for t, items in enumerate(filled):
                labels = []
                for station, state in items:
                    delta = 0 if station == center else nbrs.get((center, station))
                    if delta is not None and counts(state, station == center, kind):
                        labels.append(f"{state}_T{t}_{delta}")
                labels = sorted(set(labels) if dedup else labels)
                if labels:
                    seq.append(",".join(labels))
            if seq:
                out.append((win, center, "-".join(seq)))
    return sorted(out)


@pytest.mark.parametrize("neighborhood,far", [("distance", 3), ("indegree", 12)], ids=["bits", "sets"])
@pytest.mark.parametrize("kind", EXTRACTION_TYPES)
def test_random_sequences(spark, kind, neighborhood, far):
    rng = random.Random(kind)
    side, second = kind.split("-")
    names = {side, "Almost" + side, "Normal"}
    if not second.startswith("Almost"):
        names |= {"Increase", "Decrease", "NoIncrease", "NoDecrease"}
    names = sorted(names)
    rows = sorted({(rng.randint(0, 14), rng.randint(1, 6), rng.choice(names)) for _ in range(60)})
    nbrs = {(a, b): rng.randint(1, far) for a in range(1, 7) for b in range(1, 7) if a != b and rng.random() < 0.5}
    near = spark.createDataFrame([(*k, v) for k, v in nbrs.items()], "center long, station_id long, delta int")
    p = MineParams(extraction_type=kind, window_size=3, neighborhood=neighborhood)
    got = sq.sequence_text(sq.build_sequences(states_frame(spark, rows), near, p))
    assert tuples(got, "win", "center", "sequence") == plain_sequences(rows, nbrs, 3, kind)


def test_first_version_keeps_repeats(spark):
    rng = random.Random(3)
    rows = sorted({(rng.randint(1, 9), rng.randint(1, 4), rng.choice(["Full", "AlmostFull"])) for _ in range(40)})
    nbrs = {(a, b): 1 + (a + b) % 2 for a in range(1, 5) for b in range(1, 5) if a != b}
    near = spark.createDataFrame([(*k, v) for k, v in nbrs.items()], "center long, station_id long, delta int")
    got = sq.build_sequences(states_frame(spark, rows), near, MineParams(), dedup=False, base=1)
    want = plain_sequences(rows, nbrs, 3, "Full-AlmostFull", dedup=False, base=1)
    assert tuples(sq.sequence_text(got), "win", "center", "sequence") == want


def test_indegree_needs_edges(spark):
    with pytest.raises(ValueError):
        nb.neighbors(spark.range(1), MineParams(neighborhood="indegree"))


def test_labels_that_do_not_fit_a_long_are_kept_as_sets():
    assert sq.label_bits(MineParams(max_delta=2)) == {"Full": 0, "AlmostFull": 3, "Normal": 6}
    assert len(sq.label_bits(MineParams(extraction_type="Full-Decrease"))) == 7
    assert sq.label_bits(MineParams(extraction_type="Full-Decrease", max_delta=9)) == {}
    assert sq.label_bits(MineParams(neighborhood="indegree")) == {}


def test_two_digit_distances_sort_as_text(spark):
    rows = [(0, 1, "Full"), (0, 2, "Full"), (0, 3, "Full")]
    near = spark.createDataFrame([(1, 2, 2), (1, 3, 10)], "center long, station_id long, delta int")
    p = MineParams(max_delta=12, window_size=1)
    got = sq.sequence_text(sq.build_sequences(states_frame(spark, rows), near, p)).filter("center = 1")
    assert tuples(got, "sequence") == [("Full_T0_0,Full_T0_10,Full_T0_2",)]


def test_tasks_grow_with_the_states(spark, monkeypatch):
    """States that meet their neighbours are dealt over more tasks as they become more."""
    monkeypatch.setattr(sq, "STATES", 2)
    rows = [(s, c, "Full") for s in range(10) for c in range(4)]
    found = spark.createDataFrame(rows, "slot long, station_id long, state string")
    near = spark.createDataFrame([(0, 1, 1), (1, 0, 1)], "center long, station_id long, delta int")
    built = sq.build_sequences(found, near, MineParams(interval=720))
    assert "hashpartitioning(slot#" in (text := built._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in text
    assert built.select("win", "center").distinct().count() == built.count() > 0


def test_only_what_makes_a_sequence_is_gathered(spark):
    """A centre without an item of its own in T0 of any window makes no sequence, whatever its neighbours show."""
    found = spark.createDataFrame([(0, 1, "Full"), (1, 2, "Full"), (9, 2, "Full"), (1, None, "Full")], "slot long, station_id long, state string")
    near = spark.createDataFrame([(1, 2, 1), (5, 2, 1)], "center long, station_id long, delta int")
    items, win = sq.labelled_items(found, near), windows.window_map(found, 3)
    kept = {tuple(r) for r in sq._of_heads(items, win).select("slot", "center", "delta").collect()}
    assert kept == {(0, 1, 0), (1, 1, 1), (1, 2, 0), (9, 2, 0), (1, None, 0)}
    built = sq.build_sequences(found, near, MineParams(interval=720), dedup=False)
    assert {r.center for r in built.collect()} == {1, 2, None}


def test_stations_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    """Each station is 27 rows on one side of the join, which the size of its file does not show."""
    station = spark.range(60).selectExpr("id", "37D + id div 8 * 0.005D AS lat", "-122D + id % 8 * 0.005D AS long")
    want = tuples(nb.station_pairs(station, 1.0), "id_a", "id_b")
    monkeypatch.setattr(nb, "fits", lambda df: False, raising=False)
    pairs = nb.station_pairs(station, 1.0)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert want and tuples(pairs, "id_a", "id_b") == want
