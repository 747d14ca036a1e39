"""Column expressions shared by the operators. All stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from stationmine.params import EARTH_RADIUS_KM


def epoch(time: str | Column) -> Column:
    return F.unix_timestamp(F.col(time) if isinstance(time, str) else time)


def base_slot(base_time: str, interval: int) -> Column:
    return F.floor(F.unix_timestamp(F.lit(base_time).cast("timestamp")) / (interval * 60))


def slot_of(time: str | Column, interval: int, base_time: str) -> Column:
    """Number of whole intervals since the interval holding ``base_time``."""
    return (F.floor(epoch(time) / (interval * 60)) - base_slot(base_time, interval)).cast("long")


def time_bin(time: str | Column, minutes: int) -> Column:
    """Start of the ``minutes`` long bin as epoch seconds; bins count from the epoch."""
    step = minutes * 60
    return (F.floor(epoch(time) / step) * step).cast("long")


def bin_time(bin_: str | Column) -> Column:
    return F.timestamp_seconds(F.col(bin_) if isinstance(bin_, str) else bin_)


def reading_state(level: Column, side: str, ct: int, wrap: bool) -> Column:
    """State of one reading from its level: docks for Full, bikes for Empty."""
    almost = F.when(level < ct, F.lit(f"Almost{side}")).otherwise(F.lit("Normal"))
    if wrap:
        return almost
    return F.when(level == 0, F.lit(side)).otherwise(almost)


def level_column(side: str) -> Column:
    return F.col("docks_available" if side == "Full" else "bikes_available")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres, degrees in."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), 2
    )
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def delta_of(dist: Column, th: float) -> Column:
    """Least whole number of steps d >= 1 with d * th >= dist."""
    return F.greatest(F.lit(1), F.ceil(F.round(dist / F.lit(float(th)), 9))).cast("int")


def pattern_key(sequence: str | Column) -> Column:
    """Text form: items sorted and joined by ',', slots joined by '-'."""
    col = F.col(sequence) if isinstance(sequence, str) else sequence
    return F.concat_ws("-", F.transform(col, lambda s: F.concat_ws(",", F.array_sort(s))))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when den is zero or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def register_sql_functions(spark: SparkSession, ct: int = 3) -> None:
    """Offer the reading state to SQL text: 1 critical, 0 almost, 2 normal."""
    for side, level in (("full", "docks"), ("empty", "bikes")):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION state_{side}(docks INT, bikes INT) RETURNS INT "
            f"RETURN CASE WHEN {level} = 0 THEN 1 WHEN {level} < {ct} THEN 0 ELSE 2 END"
        )
