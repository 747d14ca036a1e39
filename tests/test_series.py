"""Series operators against pandas on random readings."""

import collections
import random
import re

import numpy as np
import pandas as pd
import pytest

from stationmine.operators import correlation, series
from stationmine.sources.sinks import stamp
from tests.conftest import status_frame


def random_status(seed, stations=4, n=150, hours=96):
    rng = random.Random(seed)
    start = pd.Timestamp("2024-01-01")
    return [
        (
            rng.randrange(stations),
            rng.choice([None, 0, 1, 2, 5, 9]),
            rng.choice([0, 1, 3, 8]),
            str(start + pd.Timedelta(seconds=rng.randrange(hours * 3600))),
        )
        for _ in range(n)
    ]


def random_trips(spark, seed, stations=4, n=200, hours=96):
    rng = random.Random(seed)
    start = pd.Timestamp("2024-01-01")
    rows = []
    for i in range(n):
        a = start + pd.Timedelta(seconds=rng.randrange(hours * 3600))
        rows.append((i, rng.randrange(stations), rng.randrange(stations), str(a), str(a + pd.Timedelta(minutes=rng.randrange(300)))))
    df = spark.createDataFrame(rows, "id long, start_station_id long, end_station_id long, s string, e string")
    return df.selectExpr(
        "id", "start_station_id", "end_station_id", "cast(s as timestamp) start_date", "cast(e as timestamp) end_date"
    )


def as_pandas(rows):
    pdf = pd.DataFrame(rows, columns=["station_id", "bikes_available", "docks_available", "time"])
    pdf["time"] = pd.to_datetime(pdf["time"])
    return pdf.astype({"bikes_available": float, "docks_available": float})


def check(df, want, keys):
    got = df.toPandas().sort_values(keys).reset_index(drop=True)
    want = want.sort_values(keys).reset_index(drop=True)[list(got.columns)]
    for c in got.columns:
        if c == "time":
            assert (pd.to_datetime(got[c]).astype("datetime64[ns]") == want[c].astype("datetime64[ns]")).all()
        elif got[c].dtype == object:
            assert got[c].tolist() == want[c].tolist()
        else:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)


def resampled(pdf, how):
    parts = []
    for s, g in pdf.groupby("station_id"):
        r = getattr(g.set_index("time")[["bikes_available", "docks_available"]].resample("120min"), how)()
        parts.append(r.reset_index().assign(station_id=s))
    return pd.concat(parts)


@pytest.mark.parametrize("how", ["mean", "sum", "count"])
def test_resample(spark, how):
    rows = random_status(1)
    check(stamp(series.resample(status_frame(spark, rows), 120, how)), resampled(as_pandas(rows), how), ["station_id", "time"])


def test_lags_labels_and_changes(spark):
    rows = random_status(2, n=400)
    mean = series.resample(status_frame(spark, rows), 120)
    want = resampled(as_pandas(rows), "mean").sort_values(["station_id", "time"])
    g = want.groupby("station_id")
    lagged = want[["station_id", "time"]].copy()
    for c in series.VALUES:
        for i in range(3):
            lagged[f"{c}_T{i}"] = g[c].shift(i)
    check(stamp(series.lags(mean, series.VALUES, 3)), lagged, ["station_id", "time"])
    labelled = want.assign(status=np.where(want.docks_available <= 2, "QP", "N"))
    labelled["status"] = labelled.groupby("station_id")["status"].shift(-1)
    got = stamp(series.next_label(mean)).orderBy("station_id", "time").toPandas()["status"]
    assert [x if isinstance(x, str) else None for x in got] == [x if isinstance(x, str) else None for x in labelled["status"]]
    change = pd.DataFrame(
        {"station_id": want.station_id, "time": g["time"].shift(-1), "delta_bikes": g["bikes_available"].shift(-1) - want.bikes_available}
    ).dropna()
    check(stamp(series.deltas(mean)), change, ["station_id", "time"])
    day = change.assign(day_time=change.time.dt.strftime("%H:%M:%S"))
    prof = day.groupby(["station_id", "day_time"])["delta_bikes"].mean().reset_index()
    prof["sum_deltas"] = prof.groupby("station_id")["delta_bikes"].cumsum()
    check(series.daily_profile(series.deltas(mean)), prof, ["station_id", "day_time"])
    long = prof.melt(["station_id", "day_time"])
    check(series.profile_long(series.daily_profile(series.deltas(mean))), long, ["station_id", "day_time", "variable"])


def plain_flow(trips, minutes):
    pdf = trips.toPandas()
    parts = []
    for s in sorted(set(pdf.start_station_id) | set(pdf.end_station_id)):
        out = pdf[pdf.start_station_id == s].resample(f"{minutes}min", on="start_date")["id"].count().rename("bikes_out")
        into = pdf[pdf.end_station_id == s].resample(f"{minutes}min", on="end_date")["id"].count().rename("bikes_in")
        both = pd.concat([out, into], axis=1).sort_index().fillna(0)
        both["bikes_out"] = -both["bikes_out"]
        both["delta_bikes"] = both.bikes_in + both.bikes_out
        both["sum_delta"] = both.delta_bikes.cumsum()
        parts.append(both.rename_axis("time").reset_index().assign(station_id=s))
    return pd.concat(parts)


def test_net_flow(spark):
    trips = random_trips(spark, 3)
    check(stamp(series.net_flow(trips, 60)), plain_flow(trips, 60), ["station_id", "time"])


def test_net_flow_with_a_gap_between_departures_and_arrivals(spark):
    rows = [(0, 1, 2, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (1, 2, 1, "2024-01-03 00:00:00", "2024-01-03 05:00:00")]
    df = spark.createDataFrame(rows, "id long, start_station_id long, end_station_id long, s string, e string")
    trips = df.selectExpr("id", "start_station_id", "end_station_id", "cast(s as timestamp) start_date", "cast(e as timestamp) end_date")
    got = stamp(series.net_flow(trips, 60)).filter("station_id = 1").count()
    assert got == 2


@pytest.mark.parametrize("reset", [False, True])
def test_rebuilt_status(spark, reset):
    rows = [r for r in random_status(5, n=900) if r[1] is not None]
    trips = random_trips(spark, 6, n=600)
    both = resampled(as_pandas(rows), "mean").merge(plain_flow(trips, 120), on=["station_id", "time"])
    parts = []
    for _, g in both.sort_values("time").groupby("station_id"):
        level, values = g.bikes_available.iloc[0], []
        for t, b, d in zip(g.time, g.bikes_available, g.delta_bikes):
            values.append(level)
            level = b if reset and t.hour == 0 and t.minute == 0 else level + d
        parts.append(g.assign(trips_bikes_available=values))
    got = stamp(series.rebuild_status(status_frame(spark, rows), trips, 120, reset))
    check(got, pd.concat(parts), ["station_id", "time"])


def test_busy_intervals(spark):
    trips = random_trips(spark, 7, stations=3, n=400, hours=30)
    pdf = trips.toPandas()
    want = []
    for s, g in pdf.groupby("end_station_id"):
        row = {"station_id": s}
        for m in (1, 2, 4):
            n = g.groupby(g.end_date.dt.floor(f"{60 * m}min")).size()
            for t in (2, 3, 5):
                row[f"count_trsh{t * m}_intrv{60 * m}"] = int((n >= t * m).sum())
        want.append(row)
    check(series.busy_intervals(trips, "end", 60), pd.DataFrame(want), ["station_id"])


def test_occupancy(spark):
    rows = random_status(9)
    pdf = as_pandas(rows)
    pdf["day"] = pdf.time.dt.date
    d, b = pdf.docks_available, pdf.bikes_available
    pdf = pdf.assign(full=d == 0, almost_full=d <= 3, normal=~((d <= 3) | (b <= 3)), almost_empty=b <= 3, empty=b == 0)
    kinds = ["full", "almost_full", "normal", "almost_empty", "empty"]
    want = (pdf.groupby(["station_id", "day"])[kinds].mean() * 100).groupby("station_id").mean().reset_index()
    check(series.occupancy(status_frame(spark, rows)), want, ["station_id"])


def test_transition_rate(spark):
    rows = [
        (1, 3, 0, "2024-01-01 00:00:00"), (1, 5, 0, "2024-01-01 00:05:00"), (1, 5, 2, "2024-01-01 00:16:00"),
        (1, 1, 0, "2024-01-01 00:31:00"), (1, 2, 0, "2024-01-01 00:32:00"), (1, 2, 2, "2024-01-01 01:01:00"),
        (2, 1, 0, "2024-01-01 00:01:00"), (2, 2, 0, "2024-01-01 00:02:00"), (2, 2, 5, "2024-01-01 00:20:00"),
        (2, 9, 9, "2024-01-01 00:40:00"),
    ]
    row = series.transition_rate(series.window_flags(status_frame(spark, rows))).first()
    assert (row.n_antecedent, row.n_hit, row.rate) == (2, 1, 0.5)
    assert row.rate_ref == pytest.approx(1 / 3)


def test_null_audit_and_span(spark):
    rows = [(1, 1, 1, "2024-01-01 00:00:00"), (1, None, 1, "2024-01-01 02:00:00"), (1, 1, 1, "2024-01-01 06:00:00")]
    status = status_frame(spark, rows)
    assert series.null_audit(status, 120, "2024-01-01 02:00:00").collect()[0].asDict() == {
        "station_id": 1, "n_bins": 3, "n_null": 2,
    }
    assert [str(x) for x in series.span(status).first()] == ["2024-01-01 00:00:00", "2024-01-01 06:00:00"]


def plain_corr(pdf, nbrs, minutes, width):
    """Merge the lagged series of each neighbourhood and take the correlation matrix."""
    out = {}
    lagged = {}
    for s, g in pdf.groupby("station_id"):
        r = g.set_index("time")["bikes_available"].resample(f"{minutes}min").mean()
        lagged[s] = pd.DataFrame({(s, i): r.shift(i) for i in range(width)})
    for center, members in nbrs.items():
        wide = pd.concat([lagged[m] for m in members if m in lagged], axis=1)
        corr = wide.corr()
        for a in wide:
            for b in wide:
                if a[0] <= b[0] and (wide[a].notna() & wide[b].notna()).any():
                    out[center, *a, *b] = corr.loc[[a], [b]].iloc[0, 0]
    return out


@pytest.mark.parametrize("tile", [1, 2, 64])
def test_lag_correlation(spark, monkeypatch, tile):
    monkeypatch.setattr(correlation, "CHUNK", 16)
    monkeypatch.setattr(correlation, "TILE", tile)
    rows = random_status(11, stations=5, n=900, hours=200)
    pairs = [(1, 1), (1, 2), (1, 0), (3, 4), (3, 1), (3, 3)]
    nbrs = spark.createDataFrame(pairs, "center long, station_id long")
    got = correlation.lag_correlation(status_frame(spark, rows), nbrs, 60, 3).collect()
    want = plain_corr(as_pandas(rows), {1: [0, 1, 2], 3: [1, 3, 4]}, 60, 3)
    got = {(r.center, r.a, r.lag_a, r.b, r.lag_b): r.r for r in got}
    assert set(got) == set(want)
    for k, r in got.items():
        assert (r is None and np.isnan(want[k])) or r == pytest.approx(want[k], abs=1e-9), k


def test_tiles_hold_each_station_once(spark):
    nbrs = spark.createDataFrame([(c, s) for c in (1, 2) for s in range(400)] + [(3, 900)], "center long, station_id long")
    got = [tuple(r) for r in correlation._tiles(nbrs).collect()]
    sizes = collections.Counter(t for _, t in got)
    assert len(got) == 401 and len(sizes) == 7 and max(sizes.values()) == correlation.TILE


def test_constant_series_has_no_correlation(spark):
    rows = [(s, 3, 1, f"2024-01-01 {h:02d}:00:00") for s in (1, 2) for h in range(20)]
    nbrs = spark.createDataFrame([(1, 1), (1, 2)], "center long, station_id long")
    got = correlation.lag_correlation(status_frame(spark, rows), nbrs, 60, 2)
    assert got.count() == 12 and got.filter("r is not null").isEmpty()


def test_large_neighborhoods_are_paired_in_blocks(spark):
    nbrs = spark.createDataFrame([(c, s) for c in (1, 2) for s in range(40 * c)], "center long, station_id long")
    got = correlation.co_neighbors(nbrs, block=16)
    assert got.count() == got.distinct().count() == 40 * 41 // 2 + 80 * 81 // 2


def test_neighborhood_wide(spark):
    rows = random_status(12, stations=3)
    nbrs = spark.createDataFrame([(1, 1), (1, 2)], "center long, station_id long")
    long = correlation.neighborhood_wide(status_frame(spark, rows), nbrs, 120, 2)
    wide = correlation.pivot_neighborhood(long, 1, [1, 2], 2)
    assert wide.columns == ["bin", "1_T1", "1_T0", "2_T1", "2_T0"]
    assert wide.count() == long.select("bin").distinct().count()


def test_pairs_of_tiles_are_dealt_over_tasks(spark, monkeypatch):
    """Chunks are small next to the sums made of them, so by their size a single task would get them all."""
    monkeypatch.setattr(correlation, "PAIRS", 1)
    rows = random_status(13, stations=6)
    nbrs = spark.createDataFrame([(1, s) for s in range(6)], "center long, station_id long")
    found = correlation.lag_correlation(status_frame(spark, rows), nbrs, 60, 2)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    plan = [re.sub(r"#\d+L?", "", x) for x in plan]
    below = [next(x for x in plan[i + 1 :] if "Exchange" in x) for i, x in enumerate(plan) if "MapInArrow" in x]
    assert len(below) == 1 and "hashpartitioning(tile_a, tile_b, 21), REPARTITION_BY_NUM" in below[0]
