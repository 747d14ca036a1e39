"""Which stations count as neighbours of a centre, and how far away they are."""

from __future__ import annotations

from math import pi, sin

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationmine.functions.columns import delta_of, haversine_km
from stationmine.params import EARTH_RADIUS_KM, MineParams
from stationmine.scale import cut, fits, join_small

#: A cell of the grid.
CELL = ["cx", "cy", "cz"]
#: Stations of a block of a crowded cell.
BLOCK = 256


def _on_grid(station: DataFrame, radius_km: float) -> DataFrame:
    """Cell of each station in a cubic grid around the globe.

    Two stations within ``radius_km`` along the surface are no further apart than the
    chord of that arc, so they lie in the same or in adjacent cells of that size.  The
    cube grid needs no special case at the poles or the date line.
    """
    arc = min(radius_km / EARTH_RADIUS_KM, pi)
    cell = max(2 * sin(arc / 2), 1e-9) * (1 + 1e-9)
    lat, lon = F.radians("lat"), F.radians("long")
    xyz = {"cx": F.cos(lat) * F.cos(lon), "cy": F.cos(lat) * F.sin(lon), "cz": F.sin(lat)}
    return station.select("id", "lat", "long", *[F.floor(v / cell).alias(k) for k, v in xyz.items()])


def _around(cells: DataFrame) -> DataFrame:
    """Each row once for every cell within one step of its own."""
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    for axis in CELL:
        cells = cells.withColumn("_d", F.explode(near)).withColumn(axis, F.col(axis) + F.col("_d")).drop("_d")
    return cells


def _blocks(cells: DataFrame, block: int) -> DataFrame:
    """Cells that more than ``block`` stations meet: into how many parts those that come and those that are there are cut."""
    there = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    come = _around(there).groupBy(*CELL).agg(F.sum("n").alias("n_come"))
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    # both sides are grouped by cell already: nothing is moved again
    return there.join(come.hint("merge"), CELL).filter(F.col("n_come") > block).select(
        *CELL, parts("n_come").alias("parts_a"), parts("n").alias("parts_b")
    )


def _dealt(rows: DataFrame, crowded: DataFrame, own: str, other: str) -> DataFrame:
    """Each row in one part of its side of its cell, once for every part of the other side. Cells not in ``crowded`` are one part."""
    parts = lambda side: F.coalesce(f"parts_{side}", F.lit(1))
    every = F.sequence(F.lit(0), parts(other) - 1)
    return (
        join_small(rows, crowded, CELL, "left")
        .withColumn(f"part_{own}", F.pmod(F.xxhash64(f"id_{own}"), parts(own)).cast("int"))
        .withColumn(f"part_{other}", F.explode(every))
        .drop("parts_a", "parts_b")
    )


def station_pairs(station: DataFrame, radius_km: float, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, dist) with id_a < id_b for stations at most ``radius_km`` apart.

    An equi join on grid cells: a station meets only the stations of the 27 cells
    around it, never the whole table.  A cell that more than ``block`` stations meet is
    cut into blocks of that many, which are paired under keys of their own, so that a
    crowded place, or stations all at one point, are shared by many tasks.
    """
    cells = _on_grid(station, radius_km)
    crowded = cut(_blocks(cells, block))
    side = lambda df, tag: df.select(*CELL, *[F.col(c).alias(f"{c}_{tag}") for c in ("id", "lat", "long")])
    a, b, key = side(_around(cells), "a"), side(cells, "b"), CELL
    # files of stations are small and do not show the 27 rows each is made into: only stations that were counted are broadcast
    if crowded.isEmpty():
        b = F.broadcast(b) if fits(cells) else b.hint("merge")
    else:
        a, b, key = _dealt(a, crowded, "a", "b"), _dealt(b, crowded, "b", "a"), [*CELL, "part_a", "part_b"]
        b = b.hint("merge")
    dist = haversine_km(F.col("lat_a"), F.col("long_a"), F.col("lat_b"), F.col("long_b"))
    return (
        a.join(b, key)
        .filter(F.col("id_a") < F.col("id_b"))
        .select("id_a", "id_b", dist.alias("dist"))
        .filter(F.col("dist") <= radius_km)
    )


def with_distance(pairs: DataFrame, station: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``dist`` between the stations named in columns ``a`` and ``b``; null when unknown."""
    out = pairs
    for key, tag in ((a, "a"), (b, "b")):
        point = station.select(
            F.col("id").alias(key), F.col("lat").alias(f"_lat_{tag}"), F.col("long").alias(f"_long_{tag}")
        )
        out = join_small(out, point, [key], "left")
    dist = haversine_km(F.col("_lat_a"), F.col("_long_a"), F.col("_lat_b"), F.col("_long_b"))
    return out.withColumn("dist", dist).select(*pairs.columns, "dist")


def distance_neighbors(station: DataFrame, th: float, max_delta: int) -> DataFrame:
    """(center, station_id, delta) both ways for stations within ``max_delta`` steps of ``th`` km."""
    pairs = station_pairs(station, th * max_delta).withColumn("delta", delta_of(F.col("dist"), th))
    both = F.array(
        F.struct(F.col("id_a").alias("center"), F.col("id_b").alias("station_id")),
        F.struct(F.col("id_b").alias("center"), F.col("id_a").alias("station_id")),
    )
    return pairs.select(F.explode(both).alias("p"), "delta").select("p.center", "p.station_id", "delta")


def top_partners(edges: DataFrame, n: int, side: str) -> DataFrame:
    """(center, station_id): top ``n`` sources of trips into the centre for Full, top
    ``n`` destinations out of it for Empty. A self loop takes one of the places."""
    center, partner = ("end_id", "start_id") if side == "Full" else ("start_id", "end_id")
    rank = F.row_number().over(Window.partitionBy(center).orderBy(F.desc("weight"), F.col(partner)))
    return (
        edges.withColumn("_rank", rank)
        .filter(F.col("_rank") <= n)
        .select(F.col(center).alias("center"), F.col(partner).alias("station_id"))
    )


def trip_neighbors(edges: DataFrame, station: DataFrame, n: int, side: str, th: float) -> DataFrame:
    """(center, station_id, delta) for the top partners by trips; delta has no upper limit."""
    top = top_partners(edges, n, side).filter(F.col("center") != F.col("station_id"))
    return with_distance(top, station, "center", "station_id").select(
        "center", "station_id", delta_of(F.col("dist"), th).alias("delta")
    ).filter(F.col("delta").isNotNull())


def neighbors(station: DataFrame, p: MineParams, edges: DataFrame | None = None) -> DataFrame:
    if p.neighborhood == "distance":
        return distance_neighbors(station, p.th, p.max_delta)
    if edges is None:
        raise ValueError("the indegree neighborhood needs edges")
    # the edges come from all trips: materialise the few rows kept before they are reused
    return cut(trip_neighbors(edges, station, p.n_neighbors, p.side, p.th))


def graph_neighbors(edges: DataFrame, kind: str = "in") -> DataFrame:
    """(center, station_id): sources of trips into the centre, or with 'both' also destinations."""
    into = edges.select(F.col("end_id").alias("center"), F.col("start_id").alias("station_id"))
    if kind == "in":
        return into.distinct()
    out = edges.select(F.col("start_id").alias("center"), F.col("end_id").alias("station_id"))
    return into.unionByName(out).distinct()
