"""Overlapping windows over slots and the positional time index.

Everything here works on the distinct non-empty slots, whose number the calendar
bounds, and is joined back to the items by slot.  No window function ever sees
the items of a slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationmine.scale import join_small


def window_map(slots: DataFrame, size: int, base: int = 0) -> DataFrame:
    """(win, slot, t) for every window a non-empty slot belongs to.

    Slot s is in windows s-size+1 … s, none below ``base``.  ``t`` counts non-empty
    slots, so T0 is the first non-empty slot of the window; an empty one leaves no gap.
    """
    expanded = (
        slots.select("slot")
        .distinct()
        .filter(F.col("slot") >= base)
        .select(
            F.explode(
                F.sequence(F.greatest(F.col("slot") - (size - 1), F.lit(base)), F.col("slot"))
            ).alias("win"),
            "slot",
        )
    )
    order = Window.partitionBy("win").orderBy("slot")
    return expanded.withColumn("t", (F.row_number().over(order) - 1).cast("int"))


def expand_windows(states: DataFrame, size: int, base: int = 0, t_index: str = "position") -> DataFrame:
    """(win, t, slot, station_id, state) rows; ``t_index='clock'`` counts empty slots too."""
    windows = window_map(states, size, base)
    if t_index == "clock":
        windows = windows.withColumn("t", (F.col("slot") - F.col("win")).cast("int"))
    return join_small(states, windows, ["slot"]).select("win", "t", "slot", "station_id", "state")
