"""Lagged correlations between the series of a neighbourhood.

A correlation does not depend on the centre, so each pair of stations that share a
centre is computed once and joined to its centres afterwards.  Stations are dealt into
tiles.  The series of a tile travel together, ``CHUNK`` bins at a time with the earlier bins
the lags need, so two tiles meet once per chunk instead of two stations once per bin and
lag, and the moment sums of all their pairs and lags are six matrix products. The chunks of
two tiles are added up where they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationmine.operators.clean import day_slots
from stationmine.operators.series import lags, resample
from stationmine.scale import cut, global_rank, join_small, spread

CHUNK = 256
BLOCK = 256
#: Stations of a tile.
TILE = 64
#: Pairs of stations of a task.
PAIRS = 20_000
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def co_neighbors(nbrs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(center, a, b) with a <= b for every two stations of a neighbourhood.

    A correlation matrix holds all of them.  Neighbourhoods larger than ``block`` are cut
    into blocks and paired block by block, so no task holds a whole large neighbourhood.
    """
    sizes = nbrs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    members = join_small(nbrs, sizes, ["center"]).withColumn("part", F.pmod(F.xxhash64("station_id"), F.col("parts")))
    # of each two blocks one order only
    left = members.select(
        "center", F.col("station_id").alias("x"), F.col("part").alias("pa"),
        F.explode(F.sequence(F.col("part"), (F.col("parts") - 1).cast("long"))).alias("pb"),
    )
    right = members.select(
        "center", F.col("station_id").alias("y"), F.col("part").alias("pb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("part"))).alias("pa"),
    )
    return (
        left.join(right, ["center", "pa", "pb"])
        .filter((F.col("pa") < F.col("pb")) | (F.col("x") <= F.col("y")))
        .select("center", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )


def _tiles(nbrs: DataFrame) -> DataFrame:
    """(station_id, tile): TILE stations each, in the order of their least centre, so neighbours meet in few pairs of tiles."""
    home = nbrs.groupBy("station_id").agg(F.min("center").alias("home"))
    tile = F.floor((F.col("rank") - 1) / TILE)
    return global_rank(home, ["home", "station_id"]).select("station_id", tile.alias("tile"))


def _chunks(series: DataFrame, tiles: DataFrame, width: int, step: int, by: list[str]) -> DataFrame:
    """Arrays per tile and chunk: station, place and value of each bin, and of the width-1 bins before the chunk.

    A bin near the end of a chunk is copied into the next one. Places without an entry are padding: a lag
    reaches a bin only where the series has a row for T0.
    """
    pos = F.floor(F.col("bin") / step)
    at = pos % CHUNK
    own = F.struct(F.floor(pos / CHUNK).alias("chunk"), (at + (width - 1)).cast("int").alias("i"))
    ahead = F.struct((F.floor(pos / CHUNK) + 1).alias("chunk"), (at - CHUNK + (width - 1)).cast("int").alias("i"))
    copies = F.filter(F.array(own, F.when(at > CHUNK - width, ahead)), lambda c: c.isNotNull())
    entry = F.struct("station_id", F.col("c.i").alias("i"), F.coalesce("bikes_available", F.lit(float("nan"))).alias("value"))
    return (
        join_small(series, tiles, ["station_id"])
        .select(*by, "tile", "station_id", "bikes_available", F.explode(copies).alias("c"))
        .groupBy(*by, "tile", F.col("c.chunk").alias("chunk"))
        .agg(F.collect_list(entry).alias("m"))
        .select(*by, "tile", "chunk", F.col("m.station_id").alias("station"), F.col("m.i").alias("at"), F.col("m.value").alias("value"))
    )


def _coefficients(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, r and whether either side varies, from a row of moment sums per pair."""
    n, sx, sy, sxx, syy, sxy = np.split(sums, len(SUMS), axis=1)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    # variances are differences of large sums: tell a constant series from rounding noise
    varies = (vx > 1e-11 * n * sxx) & (vy > 1e-11 * n * syy)
    return n, np.divide(n * sxy - sx * sy, np.sqrt(np.where(varies, vx * vy, 1.0))), varies


def _tile_table(width: int, by: list[str]):
    """n and r of all lag pairs for the wanted pairs of stations of two tiles, r null where either side is constant.

    Rows are a pair of tiles and a chunk each, the chunks of a pair of tiles one after the other; their moment sums are added up.
    """
    length = CHUNK + width - 1
    keys = [*by, "tile_a", "tile_b"]

    def lagged(station: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Station ids, and a row per station and lag: its values (0 where unknown), and where they are known."""
        ids, row = np.unique(station, return_inverse=True)
        values, present = np.full((len(ids), length), np.nan), np.zeros((len(ids), length), bool)
        values[row, at], present[row, at] = value, True
        x = np.stack([values[:, width - 1 - i : length - i] for i in range(width)], axis=1)
        known = present[:, None, width - 1 :] & ~np.isnan(x)
        rows = len(ids) * width
        return ids, np.where(known, x, 0.0).reshape(rows, -1), known.reshape(rows, -1)

    def add(total: np.ndarray, a: np.ndarray, b: np.ndarray, left, x, kx, right, y, ky) -> None:
        there = np.isin(a, left) & np.isin(b, right)
        ia, ib = np.searchsorted(left, a[there]), np.searchsorted(right, b[there])
        # bins in which a side knows nothing add nothing
        used = kx.any(axis=0) & ky.any(axis=0)
        x, kx, y, ky = (m[:, used].astype(float) for m in (x, kx, y, ky))

        def sums(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            every = (u @ v.T).reshape(len(left), width, len(right), width)
            return every[ia, :, ib, :].reshape(len(ia), width**2)

        total[there] += np.hstack([sums(kx, ky), sums(x, ky), sums(kx, y), sums(x * x, ky), sums(kx, y * y), sums(x, y)])

    def rows(group: tuple, a: np.ndarray, b: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        met = total[:, : width**2].any(axis=1)
        n, r, varies = _coefficients(total[met])
        offsets = pa.array(np.arange(len(n) + 1) * width**2, pa.int32())
        lists = [pa.array(n.ravel().astype(np.int64)), pa.array(r.ravel(), mask=~varies.ravel())]
        return pa.RecordBatch.from_arrays(
            [*(pa.repeat(pa.scalar(v, pa.string()), len(n)) for v in group[: len(by)]), pa.array(a[met]), pa.array(b[met]),
             *(pa.ListArray.from_arrays(offsets, x) for x in lists)],
            [*by, "a", "b", "n", "r"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, a, b, total = None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                own = tuple(batch.column(k)[r].as_py() for k in keys)
                if own != group:
                    if group is not None:
                        yield rows(group, a, b, total)
                    group, a, b = own, get("a").copy(), get("b").copy()
                    total = np.zeros((len(a), len(SUMS) * width**2))
                sides = [lagged(*(get(f"{c}_{side}") for c in ("station", "at", "value"))) for side in "ab"]
                add(total, a, b, *sides[0], *sides[1])
        if group is not None:
            yield rows(group, a, b, total)

    return run


def lag_correlation(
    status: DataFrame, nbrs: DataFrame, minutes: int, width: int, by_day_slot: bool = False
) -> DataFrame:
    """(center, a, lag_a, b, lag_b, r, n) over the neighbours of each centre, a <= b.

    Pearson correlation of the mean bikes per bin over the bins where both lagged values
    are known; null when either is constant.  With ``by_day_slot`` readings are first split
    by day slot and each slot is resampled on its own.
    """
    by = ["day_slot"] if by_day_slot else []
    rows = day_slots(status) if by_day_slot else status
    keys = [*by, "station_id"]
    # chunks are small arrays read twice by the pair join; the readings behind them once
    series = resample(rows, minutes, "mean", ["bikes_available"], keys)
    # a correlation is the same for centred values, and their sums lose no digits to a large level
    mean = F.avg("bikes_available").over(Window.partitionBy(*keys))
    series = series.withColumn("bikes_available", F.col("bikes_available") - mean)
    nbrs = cut(nbrs)
    tiles = cut(_tiles(nbrs))
    chunks = cut(_chunks(series, tiles, width, minutes * 60, by))
    pairs = cut(co_neighbors(nbrs))
    side = lambda c: tiles.select(F.col("station_id").alias(c), F.col("tile").alias(f"tile_{c}"))
    wanted = (
        join_small(join_small(pairs.select("a", "b").distinct(), side("a"), ["a"]), side("b"), ["b"])
        .groupBy("tile_a", "tile_b")
        .agg(F.collect_list(F.struct("a", "b")).alias("p"))
        .select("tile_a", "tile_b", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    )
    part = lambda c: chunks.select(
        *by, "chunk", F.col("tile").alias(f"tile_{c}"), *[F.col(x).alias(f"{x}_{c}") for x in ("station", "at", "value")]
    )
    joined = wanted.join(part("a"), "tile_a").join(part("b"), [*by, "tile_b", "chunk"])
    # chunks are small next to what is made of them: dealt out before, as many tasks as the pairs need. The chunks of two
    # tiles, as many as the calendar has, stay together, so that no sums have to be moved
    together = [*by, "tile_a", "tile_b"]
    joined = spread(joined, *together, parts=-(-pairs.count() // PAIRS)).sortWithinPartitions(*together, "chunk")
    schema = "".join(f"{k} string, " for k in by) + "a long, b long, n array<long>, r array<double>"
    # a row of the exchange holds all lags of a pair; they become rows when nothing moves them any more
    table = joined.mapInArrow(_tile_table(width, by), schema)
    lag = F.posexplode(F.arrays_zip("n", "r")).alias("i", "v")
    return (
        pairs.join(table, ["a", "b"]).select(*by, "center", "a", "b", lag).filter("v.n > 0")
        .select(*by, "center", "a", F.expr(f"cast(i div {width} as int)").alias("lag_a"), "b",
                (F.col("i") % width).alias("lag_b"), "v.r", "v.n")
    )


def neighborhood_wide(status: DataFrame, nbrs: DataFrame, minutes: int, width: int) -> DataFrame:
    """Lagged series of each centre's neighbours, one row per (center, neighbour, bin).

    The long form of the merged table of a neighbourhood; ``pivot_neighborhood`` widens it.
    """
    series = lags(resample(status, minutes, "mean", ["bikes_available"]), ["bikes_available"], width)
    # a station has a row per bin: no salts
    return join_small(series, nbrs, ["station_id"], salts=1).select(
        "center", "station_id", "bin", *[f"bikes_available_T{i}" for i in reversed(range(width))]
    )


def neighborhood_tables(long: DataFrame, width: int) -> DataFrame:
    """The wide tables of all centres, one row per (center, bin).

    ``lags`` maps every neighbour with a row in the bin to its values, oldest first. Neighbours differ
    from centre to centre, so they are keys and not columns; one without a row is not in the map.
    """
    values = F.array(*[f"bikes_available_T{i}" for i in reversed(range(width))])
    entries = F.array_sort(F.collect_list(F.struct("station_id", values.alias("values"))))
    return long.groupBy("center", "bin").agg(F.map_from_entries(entries).alias("lags"))


def pivot_neighborhood(long: DataFrame, center: int, stations: list[int], width: int) -> DataFrame:
    """One wide row per bin for one centre: columns ``{station}_T{i}``, outer merged on the bin."""
    lag_cols = [F.max(f"bikes_available_T{i}").alias(f"T{i}") for i in reversed(range(width))]
    return long.filter(F.col("center") == center).groupBy("bin").pivot("station_id", stations).agg(*lag_cols)
