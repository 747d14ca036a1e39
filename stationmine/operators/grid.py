"""Runs over several configurations, as one tagged table each."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationmine.operators import classify, patterns
from stationmine.operators.clean import valid_readings
from stationmine.operators.mining import mine
from stationmine.operators.neighbors import neighbors
from stationmine.operators.sequences import build_sequences
from stationmine.operators.states import slot_states
from stationmine.operators.windows import window_map
from stationmine.params import MineParams
from stationmine.scale import cut, cut_each


def tags(p: MineParams) -> dict:
    """The columns that tell configurations apart."""
    return {
        "extraction": p.extraction_type + ("_wrapped" if p.wrap_states else "") + ("_stateChange" if p.state_change else ""),
        "neighborhood": str(p.n_neighbors) if p.neighborhood == "indegree" else "Dist",
        "interval": p.interval,
        "ct": p.ct,
        "thr": p.thr,
    }


#: Parameters that shape neighbourhoods and windows only: states do not depend on them.
_NOT_OF_STATES = {"th": 0.5, "max_delta": 3, "neighborhood": "distance", "n_neighbors": 5, "window_size": 3}


def tag_table(spark: SparkSession, configs: list[MineParams]) -> DataFrame:
    """tag (place in ``configs``) and the columns that tell configurations apart."""
    rows = [(i, *tags(p).values()) for i, p in enumerate(configs)]
    return spark.createDataFrame(rows, "tag int, extraction string, neighborhood string, interval int, ct int, thr int")


def sequences(
    status: DataFrame, station: DataFrame, configs: list[MineParams], edges: DataFrame | None = None
) -> DataFrame:
    """(tag, win, center, sequence) of all configurations, written one configuration after the other.

    Readings are scanned once, for the valid ones; configurations that differ in neighbourhood share their states, and
    those that differ in states share their neighbours.
    """
    readings = cut(valid_readings(status).select("station_id", "bikes_available", "docks_available", "time"))
    states: dict[MineParams, DataFrame] = {}
    windows: dict[tuple[MineParams, int], DataFrame] = {}
    near: dict[tuple, DataFrame] = {}

    def each() -> Iterator[DataFrame]:
        for i, p in enumerate(configs):
            of_states = p.but(**_NOT_OF_STATES)
            if of_states not in states:
                states[of_states] = cut(slot_states(readings, p))
            of_windows = (of_states, p.window_size)
            if of_windows not in windows:
                windows[of_windows] = cut(window_map(states[of_states], p.window_size))
            of_near = (p.neighborhood, p.th, p.max_delta, p.n_neighbors, p.side)
            if of_near not in near:
                near[of_near] = cut(neighbors(station, p, edges))
            built = build_sequences(states[of_states], near[of_near], p, windows=windows[of_windows])
            yield built.select(F.lit(i).alias("tag"), "win", "center", "sequence")

    return cut_each(each())


def mined_rules(found: DataFrame, support: float, max_items: int = 5) -> DataFrame:
    """Rules with their tag, all configurations mined side by side."""
    return patterns.rules(cut(patterns.named(mine(found, support, max_items, F.col("tag")))), ("tag",))


def mine_grid(
    status: DataFrame,
    station: DataFrame,
    configs: list[MineParams],
    support: float,
    edges: DataFrame | None = None,
    max_items: int = 5,
) -> DataFrame:
    """Rules of every configuration with the columns that tell it apart."""
    rules = mined_rules(sequences(status, station, configs, edges), support, max_items)
    named = F.broadcast(tag_table(status.sparkSession, configs))  # one row per configuration
    return rules.join(named, "tag").drop("tag")


def evaluate_configs(
    train: DataFrame,
    test: DataFrame,
    station: DataFrame,
    configs: list[MineParams],
    target: str,
    support: float,
    confs: list[float],
    ks: list[int],
    edges: DataFrame | None = None,
    max_items: int = 5,
) -> DataFrame:
    """Metrics rows of every configuration, confidence and match threshold: rules are mined
    on ``train`` and scored on the sequences of ``test``. Configurations are a key of each step. All share one window size."""
    window = {p.window_size for p in configs}
    if len(window) != 1:
        raise ValueError("configurations must have one window size")
    rules = cut(mined_rules(sequences(train, station, configs, edges), support, max_items))
    held = sequences(test, station, [p.but(for_test=True) for p in configs], edges)
    labelled = classify.label_sequences(held, target, window.pop())
    scored = classify.evaluate_grid(labelled, rules, target, confs, ks, by=("tag",))
    return scored.join(F.broadcast(tag_table(train.sparkSession, configs)), "tag").drop("tag")
