"""Sequences of spatially labelled states around each centre station.

Labels are gathered per (slot, centre) before windows are expanded, so a reading's
state meets its neighbours once, not once per window, and the rows that are then
repeated ``window_size`` times already are compact sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationmine.functions.columns import pattern_key
from stationmine.operators.neighbors import neighbors
from stationmine.operators.states import slot_states
from stationmine.operators.windows import window_map
from stationmine.params import MineParams
from stationmine.scale import cut, join_small, spread


#: States of a task that meet their neighbours there.
STATES = 50_000


def role_filter(p: MineParams, own: Column) -> Column:
    """Whether an item counts, given its ``state`` and whether it is the centre's own."""
    state = F.col("state")
    if p.extraction_type == "Full-Increase":
        return ~state.isin("Decrease", "NoIncrease")
    if p.extraction_type == "Empty-Decrease":
        return state != "Increase"
    if p.extraction_type in ("Full-Decrease", "Empty-Increase"):
        hidden = [p.second] + (["NoIncrease"] if p.side == "Full" else [])
        return F.when(own, ~state.isin(*hidden)).otherwise(state.isin(p.second, "NoIncrease"))
    return F.lit(True)


def labelled_items(states: DataFrame, nbrs: DataFrame) -> DataFrame:
    """(slot, center, state, delta, own): each item as seen from its own and every other centre."""
    own = states.select(
        "slot", F.col("station_id").alias("center"), "state", F.lit(0).alias("delta"), F.lit(True).alias("own")
    )
    # a station has a few states per slot: no salts
    seen = join_small(states, nbrs, ["station_id"], salts=1).select(
        "slot", "center", "state", "delta", F.lit(False).alias("own")
    )
    return own.unionByName(seen)


def _labels(items: Column, t: Column, repeat: bool) -> Column:
    def text(i):
        return F.concat(i["state"], F.lit("_T"), t, F.lit("_"), i["delta"])

    if repeat:
        return F.array_sort(F.flatten(F.transform(items, lambda i: F.array_repeat(text(i), i["n"].cast("int")))))
    return F.array_sort(F.transform(items, text))


def label_bits(p: MineParams) -> dict[str, int]:
    """First bit of each state a sequence can hold; the distance counts bits up from there.
    Empty if they are too many for a long, or if distances have no limit."""
    if p.neighborhood != "distance":
        return {}
    states = [p.side, f"Almost{p.side}", "Normal"]
    if not p.by_reading:
        states += ["Increase", "Decrease", "NoIncrease", "NoDecrease"]
    width = p.max_delta + 1
    return {s: i * width for i, s in enumerate(states)} if len(states) * width <= 62 else {}


def _gather_bits(
    states: DataFrame, nbrs: DataFrame, windows: DataFrame, p: MineParams, bits: dict[str, int]
) -> DataFrame:
    """Label sets as bits of a long.

    The states of a station in a slot become one mask before they meet the neighbours, a
    distance shifts the mask, and all aggregations hash fixed-width rows.  Labels are spelled
    out only for the centres that have a state in T0.
    """
    cases = " ".join(f"WHEN '{s}' THEN {1 << i}L" for s, i in bits.items())
    # a state without a bit must not vanish: the other path would keep it
    unknown = "IF(state IS NULL, NULL, raise_error(concat('unknown state ', state)))"
    bit = F.expr(f"CASE state {cases} ELSE {unknown} END")
    masks = states.groupBy("slot", "station_id").agg(
        F.coalesce(F.bit_or(F.when(role_filter(p, F.lit(True)), bit)), F.lit(0)).alias("own"),
        F.bit_or(F.when(role_filter(p, F.lit(False)), bit)).alias("seen"),
    )
    own = masks.select("slot", F.col("station_id").alias("center"), F.col("own").alias("mask"), F.lit(True).alias("here"))
    # a station has one mask per slot: no salts
    seen = join_small(masks.filter(F.col("seen").isNotNull()), nbrs, ["station_id"], salts=1).select(
        "slot", "center", F.expr("shiftleft(seen, delta)").alias("mask"), F.lit(False).alias("here")
    )
    per_slot = own.unionByName(seen).groupBy("slot", "center").agg(
        F.bit_or("mask").alias("mask"), F.max("here").alias("here")
    )
    steps = range(p.window_size)
    wide = (
        join_small(per_slot, windows, ["slot"])
        .groupBy("win", "center")
        .agg(
            *[F.max(F.when(F.col("t") == t, F.col("mask"))).alias(f"m{t}") for t in steps],
            F.max(F.when(F.col("t") == 0, F.col("here"))).alias("head"),
        )
        .filter(F.col("head") & (F.coalesce(*[F.when(F.col(f"m{t}") != 0, True) for t in steps])))
    )

    def spelled(t: int) -> str:
        labels = sorted((f"{s}_T{t}_{d}", 1 << i + d) for s, i in bits.items() for d in range(p.max_delta + 1))
        has = ", ".join(f"IF(m{t} & {b}L <> 0, '{text}', NULL)" for text, b in labels)
        return f"IF(m{t} <> 0, array_compact(array({has})), NULL)"

    slots = F.expr(f"array_compact(array({', '.join(spelled(t) for t in steps)}))")
    return wide.select("win", "center", slots.alias("sequence"))


def _of_heads(items: DataFrame, windows: DataFrame) -> DataFrame:
    """Items seen by a centre in a slot of some window in whose T0 it has an item of its own; no other makes a sequence."""
    own = items.filter("own").select("slot", "center").distinct()
    heads = join_small(own, windows.filter("t = 0").select("slot", "win"), ["slot"]).select("win", "center")
    needed = join_small(heads, windows.select("win", F.col("slot").alias("_slot")), ["win"])
    needed = needed.select("_slot", F.col("center").alias("_center")).distinct().hint("merge")
    same = (F.col("slot") == F.col("_slot")) & F.col("center").eqNullSafe(F.col("_center"))
    return items.join(needed, same, "left_semi")


def _gather_sets(items: DataFrame, windows: DataFrame, p: MineParams, dedup: bool) -> DataFrame:
    """Label sets as arrays, for distances without a limit and for repeated labels."""
    windows = cut(windows)
    items = _of_heads(items, windows)
    if dedup:
        items, label = items.withColumn("n", F.lit(1)), F.struct("state", "delta")
    else:
        # counts per label combine on the map side; a group then holds each distinct label once
        items = items.groupBy("slot", "center", "state", "delta", "own").agg(F.count(F.lit(1)).alias("n"))
        label = F.struct("state", "delta", "n")
    per_slot = items.groupBy("slot", "center").agg(
        F.collect_set(F.when(role_filter(p, F.col("own")), label)).alias("items"),
        F.sum(F.when(F.col("own"), F.col("n"))).alias("records"),
    )
    gathered = (
        join_small(per_slot, windows, ["slot"])
        .groupBy("win", "center")
        .agg(
            F.collect_list(F.when(F.size("items") > 0, F.struct("t", "items"))).alias("steps"),
            F.max(F.when(F.col("t") == 0, F.col("records"))).alias("records"),
        )
        .filter(F.col("records").isNotNull() & (F.size("steps") > 0))
        .withColumn(
            "sequence",
            F.transform(F.array_sort("steps"), lambda s: _labels(s["items"], s["t"], repeat=not dedup)),
        )
    )
    if not dedup:
        gathered = gathered.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("records").cast("int"))))
    return gathered.select("win", "center", "sequence")


def build_sequences(
    states: DataFrame,
    nbrs: DataFrame,
    p: MineParams,
    dedup: bool = True,
    base: int = 0,
    windows: DataFrame | None = None,
) -> DataFrame:
    """(win, center, sequence): one sequence per window and centre with a state in T0.

    With ``dedup=False`` (first version) labels keep their multiplicity and a centre
    yields one sequence per record it has in T0. ``windows`` is the map of the states' slots, if it is known.
    """
    windows = window_map(states, p.window_size, base) if windows is None else windows
    # as many tasks as the states need, on either side of their meeting, so that none grows with the table
    parts = -(-states.count() // STATES)
    states, nbrs = spread(states, "slot", "station_id", parts=parts), spread(nbrs, "station_id", parts=parts)
    bits = label_bits(p) if dedup else {}
    if bits:
        return _gather_bits(states, nbrs, windows, p, bits)
    return _gather_sets(labelled_items(states, nbrs), windows, p, dedup)


def extract(
    status: DataFrame, station: DataFrame, p: MineParams, edges: DataFrame | None = None
) -> DataFrame:
    """Readings to sequences. The states are written once; raw readings are scanned once."""
    states = cut(slot_states(status, p))
    return build_sequences(states, neighbors(station, p, edges), p)


def sequence_text(sequences: DataFrame) -> DataFrame:
    return sequences.select("win", "center", pattern_key("sequence").alias("sequence"))
