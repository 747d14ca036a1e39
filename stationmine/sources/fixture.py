"""Views of the driver's tables in the shape of the bike-share inputs.

Every supplier is a station and every event is both a reading and a trip, so the
work of each query grows with the tables.  Stations lie on a lattice that widens
with their number, which keeps the number of close neighbours constant.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from stationmine.scale import join_small

SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
    "supplier": "s_suppkey long, s_name string",
}


@dataclass(frozen=True)
class Fixture:
    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def station(self) -> DataFrame:
        rows = self.table("supplier").selectExpr(
            "s_suppkey AS id", "s_name AS name", "CAST(floor(sqrt(CAST(s_suppkey AS DOUBLE))) AS BIGINT) AS r"
        )
        return rows.selectExpr(
            "id",
            "name",
            "37.0D + CAST(r * 5 AS DOUBLE) / 1000 AS lat",
            "-122.4D + CAST((id - r * r - r) * 5 AS DOUBLE) / 1000 AS long",
            "CAST(9 + id % 4 * 2 AS INT) AS dock_count",
            "CASE WHEN id < 5 THEN 'San Francisco' WHEN id < 10 THEN 'San Jose'"
            " ELSE concat('City ', id div 5) END AS city",
            "date_add(DATE '2013-08-01', CAST(id % 100 AS INT)) AS installation_date",
        )

    @cached_property
    def status(self) -> DataFrame:
        events = self.table("events").selectExpr(
            "user_id * 2 div 3 AS station_id", "event_id AS e", "floor(value) AS v", "ts AS time"
        )
        docks = self.station.selectExpr("id AS station_id", "dock_count AS n")
        return join_small(events, docks, ["station_id"]).selectExpr(
            "station_id",
            "CAST(CASE WHEN e % 97 = 0 THEN NULL WHEN e % 89 = 0 THEN 0 ELSE v % (n + 1) END AS INT)"
            " AS bikes_available",
            "CAST(IF(e % 89 = 0, 0, n - v % (n + 1) + IF(e % 53 = 0, 7, 0)) AS INT) AS docks_available",
            "time",
        )

    @cached_property
    def trip(self) -> DataFrame:
        rows = self.table("events").selectExpr(
            "*",
            "CAST(60 + floor(value * 60) AS BIGINT) AS duration",
            "user_id - user_id % 15 + (user_id % 15 * 4 + (event_id * 7 % 15) * (event_id % 4) div 3) % 15"
            " - IF(event_id % 40 = 0 AND user_id >= 15, 15, 0) AS rider",
        )
        return rows.selectExpr(
            "event_id AS id",
            "duration",
            "ts AS start_date",
            "ts + make_dt_interval(0, 0, 0, duration) AS end_date",
            "user_id * 2 div 3 AS start_station_id",
            "rider * 2 div 3 AS end_station_id",
            "user_id AS bike_id",
            "IF(event_type IN ('click', 'view'), 'Subscriber', 'Customer') AS subscription_type",
        )
