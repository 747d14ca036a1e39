"""Both ways of each checked join give the same rows; ranks and checkpoints hold."""

import re
import time

import pytest
from pyspark.sql import functions as F

from stationmine import scale
from stationmine.operators import ml, states
from stationmine.operators import sequences as sq
from stationmine.operators import trips
from stationmine.params import MineParams
from stationmine.plans import queries as q
from stationmine.sources.fixture import Fixture
from tests.conftest import tuples

ROOT = "/root/testdata/sf0.001"


@pytest.fixture
def skewed(spark):
    big = spark.range(0, 3000, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_broadcast(skewed, how):
    big, small = skewed
    want = scale.join_small(big, small, ["k"], how)
    got = scale.join_small(big, small, ["k"], how, max_rows=5, salts=4)
    cols = want.columns
    assert got.columns == cols
    assert tuples(got.fillna(-1), *cols) == tuples(want.fillna(-1), *cols)
    assert "Broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_with_condition(skewed, how):
    big, small = skewed
    cond = F.col("l.id") > F.col("r.v")
    want = scale.join_small(big, small, ["k"], how, condition=cond).fillna(-1)
    got = scale.join_small(big, small, ["k"], how, condition=cond, max_rows=5, salts=4).fillna(-1)
    assert tuples(got, *want.columns) == tuples(want, *want.columns)


def test_global_rank(spark):
    df = spark.range(0, 500, 1, 6).select((F.col("id") * 7919 % 503).alias("x"), "id")
    got = scale.global_rank(df, [F.desc("x"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [r.x for r in got] == sorted((r.x for r in got), reverse=True)


def test_cut_writes_to_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert scale.shared_dir(spark) == named
    df = scale.cut(spark.range(3))
    assert sorted(r.id for r in df.collect()) == [0, 1, 2]
    assert all(named in f for f in df.inputFiles())



def test_sequences_without_any_broadcast(spark, monkeypatch):
    fx = Fixture(spark, ROOT)
    want = tuples(sq.sequence_text(q.sequences(fx, q.P)), "win", "center", "sequence")
    monkeypatch.setattr(scale.join_small, "__defaults__", ("inner", None, 2, 4))
    assert tuples(sq.sequence_text(q.sequences(Fixture(spark, ROOT), q.P)), "win", "center", "sequence") == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_core_plans_stay_in_the_jvm(spark):
    fx = Fixture(spark, ROOT)
    frames = [
        states.slot_states(fx.status, MineParams(extraction_type="Full-Decrease", interval=720)),
        q.sequences(fx, q.P),
        q.mean_series(fx),
        trips.degrees(q.edges(fx)),
        ml.feature_table(fx.status, fx.station, 1440, 3),
    ]
    for df in frames:
        assert "Python" not in plan(df) and "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_time_filter_reaches_the_scan(spark):
    text = plan(q.split_status(Fixture(spark, ROOT), "train"))
    assert "LessThan(ts," in text


def test_folds_hash_their_readings(spark):
    p = MineParams(extraction_type="Full-Decrease", interval=720, state_change=True)
    text = plan(states.slot_states(Fixture(spark, ROOT).status, p))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


@pytest.mark.parametrize("salts", [1, 4])
def test_beyond_the_bound_nothing_is_broadcast(skewed, salts):
    big, small = skewed
    got = scale.join_small(big, small, ["k"], max_rows=5, salts=salts)
    assert "BroadcastHashJoin" not in plan(got) and "SortMergeJoin" in plan(got)
    want = scale.join_small(big, small, ["k"])
    assert tuples(got, *want.columns) == tuples(want, *want.columns)


def test_labels_are_distinct_before_windows_repeat_them(spark):
    got = q.queries()["labels"](spark, ROOT)
    text = plan(got)
    assert "hashpartitioning(slot" in text and "REPARTITION_BY_NUM" in text
    # the aggregation lies below the join with windows
    assert text.index("Join") < text.index("HashAggregate")
    assert got.count() == got.distinct().count()


def test_neighbors_are_not_repeated(spark, monkeypatch):
    """A station has few rows per slot or bin, so its neighbours need no salts."""
    monkeypatch.setattr(scale, "fits", lambda df, max_rows=0: False)
    states_ = spark.createDataFrame([(0, 1, "Full"), (0, 2, "AlmostFull"), (1, 2, "Full")], "slot long, station_id long, state string")
    near = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "center long, station_id long, delta int")
    assert "_salt" not in plan(sq.labelled_items(states_, near))
    assert sq.labelled_items(states_, near).count() == 6


def test_shuffle_files_go_when_their_rows_are_written(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(",")))
    before, kept, left = files(), spark.conf.get(scale.RELEASE, None), []

    def each():
        for i in range(3):
            yield spark.range(1000).groupBy((F.col("id") % 7 + i).alias("k")).count()
            until = time.time() + 5
            while files() - before and time.time() < until:
                time.sleep(0.1)
            left.append(files() - before)

    got = scale.cut_each(each())
    assert left == [set()] * 3 and spark.conf.get(scale.RELEASE, None) == kept
    assert tuples(got.groupBy("k").agg(F.sum("count").alias("n")), "k")[-1] == (8,) and got.count() == 21
    with pytest.raises(ValueError):
        scale.cut_each([])


def test_configurations_are_written_one_by_one(spark, monkeypatch):
    from stationmine.operators import grid

    fx, sizes = Fixture(spark, ROOT), []

    def counted(frames):
        frames = list(frames)
        sizes.append(len(frames))
        return scale.cut_each(frames)

    monkeypatch.setattr(grid, "cut_each", counted)
    configs = [q.P, q.P.but(extraction_type="Empty-AlmostEmpty"), q.P.but(ct=1)]
    found = grid.sequences(fx.status, fx.station, configs)
    assert sizes == [3]
    for i, p in enumerate(configs):
        alone = tuples(q.sequences(fx, p), "win", "center", "sequence")
        assert tuples(found.filter(F.col("tag") == i), "win", "center", "sequence") == alone
