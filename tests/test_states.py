"""States against a plain statement of their definition, on chosen and random readings."""

import random
from itertools import product

import pytest

from stationmine.functions.columns import register_sql_functions
from stationmine.operators import clean, states
from stationmine.params import EXTRACTION_TYPES, MineParams
from tests.conftest import status_frame, tuples

BASE = "2024-01-01 00:00:00"


def expected(readings, p):
    """States of one slot from readings (bikes, docks) in time order."""
    bikes = [b for b, _ in readings]
    level = [d if p.side == "Full" else b for b, d in readings]
    n = range(len(readings))
    rise = max(bikes[j] - bikes[i] for i in n for j in n if i <= j)
    fall = max(bikes[i] - bikes[j] for i in n for j in n if i <= j)
    scope = [k for k in n if k > 0 or not p.state_change]
    held_zero = p.state_change and level[0] == 0
    held_low = p.state_change and level[0] < p.ct
    zeros = [k for k in scope if level[k] == 0]
    critical = bool(zeros) and not p.wrap_states and not held_zero
    lows = [k for k in scope if level[k] < p.ct and not (critical and k == zeros[0])]
    almost = bool(lows) and not held_low
    out = set()
    if critical:
        out.add(p.side)
    if almost:
        out.add("Almost" + p.side)
    if rise > p.thr:
        out.add("Increase")
    if fall > p.thr:
        out.add("Decrease")
    if p.negatives:
        out |= {"No" + s for s in ("Increase", "Decrease")} - {"No" + s for s in out}
    if p.for_test and not almost and not held_low:
        out.add("Normal")
    return out


@pytest.mark.parametrize("kind", [k for k in EXTRACTION_TYPES if "Almost" not in k])
def test_random_slots_match_the_definition(spark, kind):
    rng = random.Random(kind)
    slots, rows = {}, []
    for station, slot in product(range(12), range(12)):
        readings = [(rng.choice([0, 0, 1, 2, 3, 5]), rng.choice([0, 1, 2, 3, 6])) for _ in range(rng.randint(1, 6))]
        readings = [r if r != (0, 0) else (1, 0) for r in readings]
        slots[station, slot] = readings
        for k, (b, d) in enumerate(readings):
            rows.append((station, b, d, f"2024-01-01 {slot:02d}:{k * 7:02d}:00"))
    rng.shuffle(rows)
    status = status_frame(spark, rows)
    for wrap, change, test, negative in product([False, True], repeat=4):
        p = MineParams(
            extraction_type=kind, interval=60, base_time=BASE, wrap_states=wrap, state_change=change,
            for_test=test, no_increase=negative,
        )
        got = {}
        for station, slot, state in tuples(states.slot_states(status, p), "station_id", "slot", "state"):
            got.setdefault((station, slot), set()).add(state)
        want = {k: expected(v, p) for k, v in slots.items()}
        assert got == {k: v for k, v in want.items() if v}, p


def test_readings_of_one_second_are_ordered_by_bikes(spark):
    rows = [(1, 9, 1, "2024-01-01 00:00:00"), (1, 2, 8, "2024-01-01 00:00:00")]
    p = MineParams(extraction_type="Full-Increase", interval=60, base_time=BASE)
    assert tuples(states.slot_trends(status_frame(spark, rows), p), "increase", "decrease") == [(True, False)]


def test_second_zero_also_counts_as_almost(spark):
    p = MineParams(extraction_type="Empty-Increase", interval=60, base_time=BASE, for_test=True)
    one = status_frame(spark, [(1, 0, 9, "2024-01-01 00:00:00"), (1, 9, 1, "2024-01-01 00:01:00")])
    two = status_frame(spark, [(1, 0, 9, "2024-01-01 00:00:00"), (1, 0, 9, "2024-01-01 00:01:00")])
    assert tuples(states.slot_states(one, p), "state") == [("Empty",), ("Increase",), ("Normal",)]
    assert tuples(states.slot_states(two, p), "state") == [("AlmostEmpty",), ("Empty",)]


def test_reading_states(spark):
    rows = [(i, 5, d, "2024-01-01 00:00:00") for i, d in enumerate([0, 1, 2, 3])]
    status = status_frame(spark, rows)
    p = MineParams(interval=60, base_time=BASE)
    assert [s for _, s in tuples(states.slot_states(status, p), "station_id", "state")] == [
        "Full", "AlmostFull", "AlmostFull",
    ]
    wrapped = states.slot_states(status, p.but(wrap_states=True, for_test=True))
    assert [s for _, s in tuples(wrapped, "station_id", "state")] == ["AlmostFull"] * 3 + ["Normal"]


def test_empty_input(spark):
    status = status_frame(spark, [(1, None, 3, "2024-01-01 00:00:00"), (1, 0, 0, "2024-01-01 00:00:00")])
    for kind in EXTRACTION_TYPES:
        assert states.slot_states(status, MineParams(extraction_type=kind, base_time=BASE)).isEmpty()


def test_complete_slots(spark):
    ss = spark.createDataFrame(
        [(0, 1, "A"), (0, 1, "B"), (0, 2, "A"), (1, 1, "A")], "slot long, station_id long, state string"
    )
    assert tuples(states.complete_slots(ss, 2), "slot", "station_id", "state") == [(0, 1, "A"), (0, 1, "B"), (0, 2, "A")]


def test_dense_slots_skip_gaps(spark):
    times = ["2024-01-01 00:05:00", "2024-01-01 00:50:00", "2024-01-01 07:00:00", "2024-01-03 00:01:00"]
    status = status_frame(spark, [(1, 1, 1, t) for t in times + times[:1]])
    assert [r[0] for r in tuples(states.dense_slots(status, 30), "slot")] == [1, 2, 3, 4]


def test_day_slots_overlap_and_wrap(spark):
    times = [f"2024-01-01 {h:02d}:30:00" for h in (4, 5, 14, 21, 23)]
    got = tuples(clean.day_slots(status_frame(spark, [(1, 1, 1, t) for t in times])), "time", "day_slot")
    assert [(t.hour, s) for t, s in got] == [
        (4, "21-5"), (5, "5-10"), (14, "10-15"), (21, "15-21"), (21, "21-5"), (23, "21-5"),
    ]


def test_oscillating_readings(spark):
    status = status_frame(spark, [(1, 5, 5, BASE), (1, 9, 9, BASE), (1, None, 3, BASE), (7, 1, 1, BASE)])
    station = spark.createDataFrame([(1, 10), (2, 10)], "id long, dock_count int")
    got = [r[:2] for r in clean.drop_oscillating(status, station).select("station_id", "bikes_available").collect()]
    assert sorted(got, key=str) == [(1, 5), (1, None), (2, None), (7, 1)]


def test_subsets_and_splits(spark):
    status = status_frame(spark, [(i, 1, 1, f"2024-01-0{i} 00:00:00") for i in range(1, 5)])
    station = spark.createDataFrame([(2,), (3,)], "id long")
    assert tuples(clean.stations_in(status, station), "station_id") == [(2,), (3,)]
    assert tuples(clean.stations_in(status, ids=[1]), "station_id") == [(1,)]
    assert tuples(clean.on_day(status, "2024-01-02"), "station_id") == [(2,)]
    assert [r[1] for r in tuples(clean.time_split(status, "2024-01-03"), "station_id", "split")] == [
        "train", "train", "test", "test",
    ]
    assert clean.before(status, "2024-01-03").count() == clean.since(status, "2024-01-03").count() == 2


def test_state_as_sql_function(spark):
    register_sql_functions(spark)
    row = spark.sql("SELECT state_full(0, 5) a, state_full(2, 5) b, state_full(3, 5) c, state_empty(5, 0) d").first()
    assert tuple(row) == (1, 0, 2, 1)
