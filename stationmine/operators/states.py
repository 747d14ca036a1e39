"""States of a station in a clock slot.

Readings are first folded to one row per station and second.  That fold combines
on the map side, and afterwards a (station, slot) group has at most
``interval * 60`` rows whatever the number of readings, so the running minimum
and maximum never see an unbounded group.  Readings of the same second count as
ordered by bikes, then docks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationmine.functions.columns import epoch, level_column, reading_state, slot_of
from stationmine.operators.clean import hour_zone, parse_zone, valid_readings
from stationmine.params import MineParams
from stationmine.scale import cut, join_small


def prepared(status: DataFrame, p: MineParams) -> DataFrame:
    """Valid readings of the chosen hours with their slot number."""
    if p.time_zone:
        status = hour_zone(status, *parse_zone(p.time_zone))
    return valid_readings(status).withColumn("slot", slot_of("time", p.interval, p.base_time))


def per_reading(status: DataFrame, p: MineParams) -> DataFrame:
    """Each valid reading with its state."""
    state = reading_state(level_column(p.side), p.side, p.ct, p.wrap_states)
    return prepared(status, p).withColumn("state", state)


def fold_seconds(readings: DataFrame, keys: list[str], ct: int, level: Column) -> DataFrame:
    """One row per key and second: extremes of bikes, low and zero counts, first reading.

    The first reading is packed into one long (bikes, then docks), since an aggregate
    over structs would have to sort all readings instead of hashing them.  Docks are
    shifted to be positive, so that they never borrow from the bikes above them.
    """
    head = F.shiftleft(F.col("bikes_available").cast("long"), 32) + F.col("docks_available") + F.lit(2**31)
    return (
        readings.withColumn("sec", epoch("time"))
        .groupBy(*keys, "sec")
        .agg(
            F.min("bikes_available").alias("b_min"),
            F.max("bikes_available").alias("b_max"),
            F.count_if(level == 0).alias("n_zero"),
            F.count_if(level < ct).alias("n_low"),
            F.min(head).alias("head"),
        )
    )


def with_swings(seconds: DataFrame, keys: list[str]) -> DataFrame:
    """Rise over the running minimum and fall under the running maximum, per second."""
    upto = Window.partitionBy(*keys).orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
    return seconds.withColumn("rise", F.col("b_max") - F.min("b_min").over(upto)).withColumn(
        "fall", F.coalesce(F.max("b_max").over(before) - F.col("b_min"), F.lit(0))
    )


def slot_profile(status: DataFrame, p: MineParams) -> DataFrame:
    """Trend and level flags per (station, slot): increase, decrease, critical, almost, normal."""
    keys = ["station_id", "slot"]
    seconds = with_swings(fold_seconds(prepared(status, p), keys, p.ct, level_column(p.side)), keys)
    first = F.min_by("head", "sec")
    b0 = first.bitwiseAND(F.lit(2**32 - 1)) - 2**31 if p.side == "Full" else F.shiftright(first, 32)
    sums = seconds.groupBy(*keys).agg(
        F.max("rise").alias("rise"),
        F.max("fall").alias("fall"),
        F.sum("n_zero").alias("n_zero"),
        F.sum("n_low").alias("n_low"),
        b0.alias("b0"),
    )
    zero, low = F.col("n_zero"), F.col("n_low")
    critical, almost_ok = zero >= 1, F.lit(True)
    if p.state_change:
        # the first reading is out of scope, and the level it holds is suppressed
        zero = zero - (F.col("b0") == 0).cast("int")
        low = low - (F.col("b0") < p.ct).cast("int")
        critical = (zero >= 1) & (F.col("b0") != 0)
        almost_ok = F.col("b0") >= p.ct
    if p.wrap_states:
        critical = F.lit(False)
    return sums.select(
        *keys,
        (F.col("rise") > p.thr).alias("increase"),
        (F.col("fall") > p.thr).alias("decrease"),
        critical.alias("critical"),
        (almost_ok & (low - critical.cast("int") >= 1)).alias("almost"),
        almost_ok.alias("almost_ok"),
    )


def slot_trends(status: DataFrame, p: MineParams) -> DataFrame:
    return slot_profile(status, p).select("station_id", "slot", "increase", "decrease")


def slot_levels(status: DataFrame, p: MineParams) -> DataFrame:
    return slot_profile(status, p).select("station_id", "slot", "critical", "almost")


def slot_states(status: DataFrame, p: MineParams) -> DataFrame:
    """Distinct (slot, station_id, state) rows for any of the six extraction types."""
    if p.by_reading:
        rows = per_reading(status, p)
        if not p.for_test:
            rows = rows.filter(F.col("state") != "Normal")
        states = rows.select("slot", "station_id", "state").distinct()
    else:
        flags = [
            F.when(F.col("critical"), F.lit(p.side)),
            F.when(F.col("almost"), F.lit(f"Almost{p.side}")),
            F.when(F.col("increase"), F.lit("Increase")),
            F.when(F.col("decrease"), F.lit("Decrease")),
        ]
        if p.negatives:
            flags += [
                F.when(~F.col("increase"), F.lit("NoIncrease")),
                F.when(~F.col("decrease"), F.lit("NoDecrease")),
            ]
        if p.for_test:
            flags.append(F.when(F.col("almost_ok") & ~F.col("almost"), F.lit("Normal")))
        present = F.filter(F.array(*flags), lambda s: s.isNotNull())
        states = slot_profile(status, p).select("slot", "station_id", F.explode(present).alias("state"))
    return complete_slots(states, p.tot_stations) if p.drop_nulls else states


def complete_slots(states: DataFrame, n: int) -> DataFrame:
    """Keep slots in which exactly ``n`` stations have a state."""
    states = cut(states)  # read twice below; the readings behind it only once
    full = states.groupBy("slot").agg(F.count_distinct("station_id").alias("n")).filter(F.col("n") == n)
    return join_small(states, full.select("slot"), ["slot"], "left_semi")


def slot_items(states: DataFrame) -> DataFrame:
    """The itemset of a slot as (slot, item) rows; item text is ``station_state``."""
    return states.select("slot", F.concat_ws("_", "station_id", "state").alias("item"))


def dense_slots(status: DataFrame, interval: int, time: str = "time") -> DataFrame:
    """Number the distinct (day, hour, minute // interval) slots that hold a reading, from 1.

    Numbers come from per-day counts and their running sum: no window sees more than
    one day of slots or one row per day.
    """
    part = F.floor(F.minute(time) / interval).cast("int")
    slots = status.select(
        F.to_date(time).alias("day"), F.hour(time).alias("hour"), part.alias("part")
    ).distinct()
    in_day = F.row_number().over(Window.partitionBy("day").orderBy("hour", "part"))
    slots = cut(slots)  # a handful of rows per day, read twice below
    ranked = slots.withColumn("in_day", in_day)
    days = slots.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return join_small(ranked, days, ["day"]).select(
        "day", "hour", "part", (F.col("offset") + F.col("in_day")).cast("long").alias("slot")
    )


def dense_slot_states(status: DataFrame, p: MineParams) -> DataFrame:
    """First-version states: slots numbered without gaps among the critical readings."""
    state = reading_state(level_column(p.side), p.side, p.ct, wrap=False)
    critical = valid_readings(status).withColumn("state", state).filter(F.col("state") != "Normal")
    part = F.floor(F.minute("time") / p.interval).cast("int")
    items = critical.select(
        F.to_date("time").alias("day"), F.hour("time").alias("hour"), part.alias("part"), "station_id", "state"
    ).distinct()
    numbered = join_small(items, dense_slots(critical, p.interval), ["day", "hour", "part"])
    return numbered.select("slot", "station_id", "state")
