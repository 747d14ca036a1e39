"""Filters and cleaning of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationmine.functions.columns import level_column, reading_state
from stationmine.scale import join_small

# The default day slots. (name, first hour, end hour); the end is exclusive,
# and a slot that ends before it starts runs over midnight.
DAY_SLOTS = (("21-5", 21, 5), ("5-10", 5, 10), ("10-15", 10, 15), ("15-21", 15, 22))


def moment(df: DataFrame, at: str, time: str = "time") -> Column:
    """A point in time as a literal of the column's own type, so that filters can be pushed down."""
    return F.lit(at).cast(df.schema[time].dataType)


def valid_readings(status: DataFrame, strict: bool = True) -> DataFrame:
    """Drop readings without bikes and dead readings (no bikes and no docks)."""
    kept = status.filter(F.col("bikes_available").isNotNull()).filter(
        (F.col("docks_available") != 0) | (F.col("bikes_available") != 0)
    )
    return kept.filter(F.col("docks_available").isNotNull()) if strict else kept


def hour_zone(df: DataFrame, start: int, end: int, time: str = "time") -> DataFrame:
    return df.filter((F.hour(time) >= start) & (F.hour(time) < end))


def parse_zone(zone: str) -> tuple[int, int]:
    start, end = zone.split("-")
    return int(start), int(end)


def day_slots(df: DataFrame, spec=DAY_SLOTS, time: str = "time") -> DataFrame:
    """One row per reading and slot it falls in, named in column ``day_slot``."""
    hour = F.hour(time)
    inside = []
    for name, start, end in spec:
        hit = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
        inside.append(F.when(hit, F.lit(name)))
    return df.withColumn("day_slot", F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())))


def drop_oscillating(status: DataFrame, station: DataFrame, tol: int = 5) -> DataFrame:
    """Drop readings whose bikes plus docks differ from the capacity by more than ``tol``.

    An unknown difference is kept, and so is a station without readings (one row of
    nulls).  The outer join is split into a left join, which can leave the readings
    unshuffled, and an anti join against the distinct station ids.
    """
    capacity = station.select(F.col("id").alias("station_id"), "dock_count")
    gap = F.abs(F.col("bikes_available") + F.col("docks_available") - F.col("dock_count"))
    kept = join_small(status, capacity, ["station_id"], "left").filter(~F.coalesce(gap > tol, F.lit(False)))
    seen = status.select("station_id").distinct()
    silent = capacity.join(seen, "station_id", "left_anti").select(
        "station_id",
        F.lit(None).cast("int").alias("bikes_available"),
        F.lit(None).cast("int").alias("docks_available"),
        F.lit(None).cast(status.schema["time"].dataType).alias("time"),
    )
    return kept.select("station_id", "bikes_available", "docks_available", "time").unionByName(silent)


def stations_in(df: DataFrame, stations: DataFrame | None = None, ids=None, key: str = "station_id") -> DataFrame:
    """Rows of the given stations: a DataFrame with column ``id``, or a list of ids."""
    if ids is not None:
        df = df.filter(F.col(key).isin(list(ids)))
    if stations is not None:
        df = join_small(df, stations.select(F.col("id").alias(key)).distinct(), [key], "left_semi")
    return df


def time_split(df: DataFrame, at: str, time: str = "time") -> DataFrame:
    """Add column ``split``: train before ``at``, test from ``at`` on."""
    return df.withColumn("split", F.when(F.col(time) < moment(df, at, time), "train").otherwise("test"))


def before(df: DataFrame, at: str, time: str = "time") -> DataFrame:
    """The train part of a split, as a filter that reaches the scan."""
    return df.filter(F.col(time) < moment(df, at, time))


def since(df: DataFrame, at: str, time: str = "time") -> DataFrame:
    """The test part of a split, as a filter that reaches the scan."""
    return df.filter(F.col(time) >= moment(df, at, time))


def on_day(df: DataFrame, day: str, time: str = "time") -> DataFrame:
    start = moment(df, day, time)
    return df.filter((F.col(time) >= start) & (F.col(time) < start + F.expr("INTERVAL 1 DAY")))


def skip_first(df: DataFrame, k: int = 3, key: str = "station_id", order: str = "bin") -> DataFrame:
    """Drop the first ``k`` rows per station. Meant for binned rows, whose number the calendar bounds."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") > k).drop("_rank")


def critical_share(status: DataFrame, side: str = "Full", ct: int = 3) -> DataFrame:
    state = reading_state(level_column(side), side, ct, wrap=False)
    critical = F.count_if(state != "Normal")
    return valid_readings(status).agg(
        F.count(F.lit(1)).alias("n_readings"),
        critical.alias("n_critical"),
        F.try_divide(critical * 100.0, F.count(F.lit(1))).alias("percent"),
    )
