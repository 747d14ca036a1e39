"""Trips and the weighted trip graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationmine.functions.columns import ratio
from stationmine.operators.neighbors import with_distance
from stationmine.scale import cut, global_sum, join_small

#: Edges a task gathers before it folds them into stars; nodes whose stars it holds.
FOLD_EDGES, FOREST_NODES = 1 << 18, 1 << 22
#: Nodes per task that may have more than their share of rows.
HUB_SHARES = 8


def od_weights(trips: DataFrame) -> DataFrame:
    """(start_id, end_id, weight): number of trips per origin and destination."""
    return trips.groupBy(
        F.col("start_station_id").alias("start_id"), F.col("end_station_id").alias("end_id")
    ).agg(F.count(F.lit(1)).alias("weight"))


def edge_importance(edges: DataFrame) -> DataFrame:
    """Edges ordered by destination, busiest first."""
    return edges.withColumnRenamed("weight", "count").orderBy("end_id", F.desc("count"), "start_id")


def graph_size(trips: DataFrame) -> DataFrame:
    edges = od_weights(trips)
    ends = edges.select(
        F.explode(F.array("start_id", "end_id")).alias("id"), F.lit(None).cast("long").alias("to_id")
    )
    # nodes and edges counted from one pass: a node is an edge without an end
    return (
        edges.select(F.col("start_id").alias("id"), F.coalesce("end_id").alias("to_id"))
        .unionByName(ends)
        .distinct()
        .agg(F.count_if(F.col("to_id").isNull()).alias("n_nodes"), F.count("to_id").alias("n_edges"))
    )


def weight_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("n_edges"), F.avg("weight").alias("mean_weight"))


def box_stats(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR and number of outliers, for all rows and per ``by``.

    Rows are counted per distinct value, and the counts summed up in order over ranges of values, so a
    quartile is found where the running total passes it and no task holds all values of a kind.
    """
    kinds = F.array(F.lit("all"), F.col(by)) if by else F.array(F.lit("all"))
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*([by] if by else []), F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.explode(kinds).alias("kind"), "v", "n")
        .filter(F.col("kind").isNotNull())
        .groupBy("kind", "v")
        .agg(F.sum("n").alias("n"))
    )
    summed = cut(global_sum(counts, ["kind", "v"], F.col("n"), "upto"))
    sizes = cut(summed.groupBy("kind").agg(F.sum("n").alias("n_rows"), F.min(F.col("upto") - F.col("n")).alias("ahead")))
    first, last = F.col("upto") - F.col("n") - F.col("ahead"), F.col("upto") - F.col("ahead")

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place < last), F.col("v").cast("double")))

    def quartile(q: float) -> Column:
        place = (F.col("n_rows") - 1) * q
        low, high = F.floor(place), F.ceil(place)
        share = F.max(place - low)
        return at(low) * (1 - share) + at(high) * share

    quartiles = cut(
        join_small(summed, sizes, ["kind"])
        .groupBy("kind", "n_rows")
        .agg(quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"))
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    return (
        join_small(summed, quartiles, ["kind"])
        .groupBy("kind", "n_rows", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("n_outliers"),
        )
    )


def degrees(edges: DataFrame, compat: bool = False) -> DataFrame:
    """In and out degree and weighted degrees per node, from one aggregation over edge ends.

    ``compat`` swaps the weighted columns, as the first tables had them.
    """
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("end_id").alias("station"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.col("start_id").alias("station"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        ).alias("e"),
        "weight",
    )
    w_in, w_out = ("w_out", "w_in") if compat else ("w_in", "w_out")
    return ends.groupBy(F.col("e.station").alias("station")).agg(
        F.sum("e.i").alias("in_deg"),
        F.sum("e.o").alias("out_deg"),
        F.sum(F.col("weight") * F.col("e.i")).alias(w_in),
        F.sum(F.col("weight") * F.col("e.o")).alias(w_out),
    )


def degrees_city(deg: DataFrame, station: DataFrame) -> DataFrame:
    city = station.select(F.col("id").alias("station"), "city")
    return deg.join(city, "station", "left")


def top_stations(deg: DataFrame, k: int = 25, bottom: bool = False) -> DataFrame:
    order = F.asc("w_in") if bottom else F.desc("w_in")
    return deg.orderBy(order, "station").limit(k)


def top_per_group(deg: DataFrame, k: int = 5, by: str = "city") -> DataFrame:
    """Top ``k`` per group; Spark keeps only ``k`` rows per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("w_in"), "station"))
    return deg.withColumn("rank", rank).filter(F.col("rank") <= k)


def self_loops(edges: DataFrame) -> DataFrame:
    """Number of self loops and of distinct start nodes."""
    return edges.agg(
        F.count_if(F.col("start_id") == F.col("end_id")).alias("n_loops"),
        F.count_distinct("start_id").alias("n_nodes"),
    )


def hourly_share(trips: DataFrame) -> DataFrame:
    """Trips and percentage of all trips per start hour, all 24 hours."""
    counts = trips.groupBy(F.hour("start_date").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    spine = trips.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    n = F.coalesce("n", F.lit(0))
    return spine.join(counts, "hour", "left").select(
        "hour", n.alias("n_trips"), ratio(n * 100, F.sum(n).over(Window.partitionBy(F.lit(0)))).alias("percent")
    )


def trip_speed(trips: DataFrame, station: DataFrame) -> DataFrame:
    """Each trip with great-circle distance, mean speed in km/h and duration in minutes."""
    out = with_distance(trips, station, "start_station_id", "end_station_id").withColumnRenamed("dist", "distance")
    return out.withColumn("avg_speed", ratio(3600 * F.col("distance"), F.col("duration"))).withColumn(
        "duration", F.col("duration") / 60
    )


def _is_star_forest(links: DataFrame) -> bool:
    """Every node points at one other node at most, and nothing points at a node that points on."""
    roles = links.select(
        F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out")),
                          F.struct(F.col("v").alias("id"), F.lit(0).alias("out")))).alias("e")
    ).groupBy("e.id").agg(F.sum("e.out").alias("n_out"), F.count(F.lit(1)).alias("n"))
    return roles.filter((F.col("n_out") > 1) | ((F.col("n_out") > 0) & (F.col("n") > F.col("n_out")))).isEmpty()


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (u, v), and for each the least node that these edges connect it with."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(place, 2)
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        # the roots of both ends are tied to the lesser one, then every path is followed to its end
        for end in (a, b):
            np.minimum.at(new, root[end], least)
            np.minimum.at(new, end, least)
        while not (new[new] == new).all():
            new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars (u, v), v the least node, at most one row per node; no more than FOREST_NODES are held."""
    ids, roots = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def folded() -> tuple[np.ndarray, np.ndarray]:
        return spanning_stars(*(np.concatenate(x) for x in zip((ids, roots), *waiting)))

    for batch in batches:
        waiting.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        # edges are folded when they are as many as the stars, so each is looked at a few times only
        if sum(len(x) for x, _ in waiting) > max(len(ids), FOLD_EDGES):
            ids, roots = folded()
            waiting = []
            if len(ids) > FOREST_NODES:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], ["u", "v"])
                ids, roots = ids[:0], roots[:0]
    if waiting:
        ids, roots = folded()
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], ["u", "v"])


def _dealt(rows: DataFrame, least: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (u, v) and ``least`` (u, n, m), n at least the number of rows of u, with the ``part`` of u they meet in.

    Rows of a node with more than its share of ``total`` are dealt over several parts, to which its least
    neighbour is repeated. There are no more such nodes than HUB_SHARES per task.
    """
    share = max(1, total // (HUB_SHARES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.ceil(F.col("n") / share).cast("int")
    hubs = least.filter(F.col("n") > share).select("u", parts.alias("parts"))
    dealt = rows.join(F.broadcast(hubs), "u", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0)).cast("int")
    )
    every = F.when(F.col("n") > share, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    return dealt, least.select("u", "m", F.explode(every).alias("part"))


def _least_around(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    dealt, repeated = _dealt(rows, least, total)
    return dealt.join(repeated, ["u", "part"]).select("u", "v", "m")


def components(edges: DataFrame, min_weight: float) -> DataFrame:
    """(id, component): connected components of the undirected graph with weight > ``min_weight``.

    A component is named by its least id.  Each task first reduces its edges to stars, so
    what is exchanged does not grow with parallel ways between the same nodes.  Rounds
    then alternate between linking larger neighbours and linking smaller neighbours to the least id around a node, so
    paths shrink by a factor and not by one step per round.  Both are grouped minima, never
    collected neighbour lists, the rows of hubs are dealt over several keys, and each round is cut off in the checkpoint folder.
    """
    heavy = edges.filter(F.col("weight") > min_weight).select(*[F.col(c).cast("long") for c in ("start_id", "end_id")]).dropna()
    stars = cut(heavy.mapInArrow(_forests, "u long, v long"))
    nodes = stars.select(F.col("u").alias("id")).distinct()
    links = cut(stars.filter("u != v").distinct())
    while not _is_star_forest(links):
        both = links.union(links.select("v", "u"))
        around = cut(both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(
            _least_around(both.filter("v > u"), around, 2 * links.count())
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        )
        low = cut(large.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m")))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _least_around(large, low, large.count()).select(F.explode(ends).alias("e")).select("e.*")
        links = cut(small.filter("u != v").distinct())
    return nodes.join(links.select(F.col("u").alias("id"), "v"), "id", "left").select(
        "id", F.coalesce("v", "id").alias("component")
    )


def component_sizes(comp: DataFrame) -> DataFrame:
    """Each node with its component and the size of it."""
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return join_small(comp, sizes, ["component"]).select("id", "component", "size")
