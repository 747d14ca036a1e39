"""Regular series from irregular readings and trips.

After binning a station has at most one row per bin, so the windows over a station's
series are bounded by the calendar and not by the number of readings.  Bins are epoch
seconds of their start; ``stamp`` in the sinks turns them into timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationmine.functions.columns import bin_time, ratio, time_bin
from stationmine.operators.states import fold_seconds, with_swings

VALUES = ["bikes_available", "docks_available"]


def _by_bin(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("bin")


def fill_bins(binned: DataFrame, minutes: int, keys: list[str]) -> DataFrame:
    """Every bin between the first and the last one of each key; new rows hold nulls.

    Each row fills the gap up to the next one, so the series is neither read again nor
    joined, and stays partitioned by key for the windows that follow.
    """
    step = F.lit(minutes * 60).cast("long")
    following = F.lead("bin").over(_by_bin(keys))
    rows = binned.withColumn("_bins", F.sequence("bin", F.coalesce(following - step, F.col("bin")), step))
    rows = rows.withColumn("_bin", F.explode("_bins"))
    values = [c for c in binned.columns if c not in (*keys, "bin")]
    return rows.select(
        *keys, F.col("_bin").alias("bin"), *[F.when(F.col("_bin") == F.col("bin"), F.col(c)).alias(c) for c in values]
    )


def resample(
    df: DataFrame,
    minutes: int,
    how: str = "mean",
    cols: list[str] | None = None,
    keys: list[str] | None = None,
    time: str = "time",
    fill: bool = True,
) -> DataFrame:
    """Mean, sum or count of ``cols`` per key and bin. Empty bins: mean null, sum and count 0."""
    cols, keys = cols or VALUES, keys or ["station_id"]
    agg = {"mean": F.avg, "sum": F.sum, "count": F.count}[how]
    rows = df.filter(F.col(time).isNotNull()).withColumn("bin", time_bin(time, minutes))
    binned = rows.groupBy(*keys, "bin").agg(*[agg(c).alias(c) for c in cols])
    if fill:
        binned = fill_bins(binned, minutes, keys)
    return binned if how == "mean" else binned.fillna(0, subset=cols)


def lags(series: DataFrame, cols: list[str], width: int, keys: list[str] | None = None) -> DataFrame:
    """Columns ``{col}_T{i}`` for i = width-1 … 0, the value i bins earlier."""
    over = _by_bin(keys or ["station_id"])
    wide = [F.lag(c, i).over(over).alias(f"{c}_T{i}") for c in cols for i in reversed(range(width))]
    return series.select("*", *wide).drop(*cols)


def next_label(series: DataFrame, limit: int = 2) -> DataFrame:
    """Label of the following bin: QP when mean docks are at most ``limit``, else N; the last is null."""
    label = F.when(F.col("docks_available") <= limit, "QP").otherwise("N")
    return series.withColumn("status", F.lead(label).over(_by_bin(["station_id"])))


def deltas(series: DataFrame, col: str = "bikes_available") -> DataFrame:
    """Change to the next bin, stamped with that bin; nulls are dropped."""
    over = _by_bin(["station_id"])
    return series.select(
        "station_id",
        F.lead("bin").over(over).alias("bin"),
        (F.lead(col).over(over) - F.col(col)).alias("delta_bikes"),
    ).dropna()


def daily_profile(changes: DataFrame) -> DataFrame:
    """Mean change per time of day with its running sum over the day."""
    day_time = F.date_format(bin_time("bin"), "HH:mm:ss")
    means = changes.groupBy("station_id", day_time.alias("day_time")).agg(
        F.avg("delta_bikes").alias("delta_bikes")
    )
    upto = Window.partitionBy("station_id").orderBy("day_time").rowsBetween(Window.unboundedPreceding, 0)
    return means.withColumn("sum_deltas", F.sum("delta_bikes").over(upto))


def profile_long(profile: DataFrame) -> DataFrame:
    return profile.unpivot(["station_id", "day_time"], ["delta_bikes", "sum_deltas"], "variable", "value")


def occupancy(status: DataFrame, low: int = 3) -> DataFrame:
    """Percent of readings per kind of occupancy: per station and day, then the mean over days."""
    docks, bikes = F.col("docks_available"), F.col("bikes_available")
    near_full = F.coalesce(docks <= low, F.lit(False))
    near_empty = F.coalesce(bikes <= low, F.lit(False))
    kinds = {
        "full": docks == 0,
        "almost_full": near_full,
        "normal": ~(near_full | near_empty),
        "almost_empty": near_empty,
        "empty": bikes == 0,
    }
    daily = status.groupBy("station_id", F.to_date("time").alias("day")).agg(
        *[(F.count_if(c) * 100.0 / F.count(F.lit(1))).alias(k) for k, c in kinds.items()]
    )
    return daily.groupBy("station_id").agg(*[F.avg(k).alias(k) for k in kinds])


def window_flags(status: DataFrame, minutes: int = 15, docks_below: int = 7, thr: int = 0) -> DataFrame:
    """Per station and bin: has a rise in bikes, an almost full and a full reading.

    Full and almost full go by docks alone; readings without bikes take no part in a rise.
    """
    near = status.filter(F.col("docks_available") < docks_below).withColumn("bin", time_bin("time", minutes))
    keys = ["station_id", "bin"]
    seconds = with_swings(fold_seconds(near, keys, 3, F.col("docks_available")), keys)
    return seconds.groupBy(*keys).agg(
        F.coalesce(F.max("rise") > thr, F.lit(False)).alias("has_increase"),
        (F.sum(F.col("n_low") - F.col("n_zero")) > 0).alias("has_almost_full"),
        (F.sum("n_zero") > 0).alias("has_full"),
    )


def transition_rate(flags: DataFrame, minutes: int = 15) -> DataFrame:
    """How often [full and rising] is followed by almost full in the adjacent bin."""
    over = _by_bin(["station_id"])
    follows = F.lead("bin").over(over) == F.col("bin") + minutes * 60
    starts = F.col("has_increase") & F.col("has_full") & follows
    hit = starts & F.lead("has_almost_full").over(over)
    counts = flags.select(starts.alias("starts"), hit.alias("hit")).agg(
        F.count_if("starts").alias("n_antecedent"), F.count_if("hit").alias("n_hit")
    )
    n, hits = F.col("n_antecedent"), F.col("n_hit")
    return counts.withColumn("rate", ratio(hits, n)).withColumn("rate_ref", ratio(hits, hits + n))


def busy_intervals(
    trips: DataFrame, kind: str = "start", minutes: int = 5, multiples=(1, 2, 4), thresholds=(2, 3, 5)
) -> DataFrame:
    """Per station: number of bins with at least threshold * n trips, for bins of n * minutes.

    Trips are counted once in the finest bins; wider bins add those counts up.
    """
    key = F.col(f"{kind}_station_id").alias("station_id")
    fine = (
        trips.select(key, time_bin(f"{kind}_date", minutes).alias("bin"))
        .groupBy("station_id", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    wide = fine.withColumn("m", F.explode(F.array(*[F.lit(m) for m in multiples])))
    step = F.col("m") * (minutes * 60)
    coarse = wide.groupBy("station_id", "m", F.floor(F.col("bin") / step).alias("b")).agg(F.sum("n").alias("n"))
    # fixed value: the format of the column names
    counts = [
        F.count_if((F.col("m") == m) & (F.col("n") >= t * m)).alias(f"count_trsh{t * m}_intrv{m * minutes}")
        for m in multiples
        for t in thresholds
    ]
    return coarse.groupBy("station_id").agg(*counts)


def busy_totals(busy: DataFrame) -> DataFrame:
    return busy.agg(*[F.sum(c).alias(c) for c in busy.columns if c != "station_id"])


def net_flow(trips: DataFrame, minutes: int) -> DataFrame:
    """Departures (negative), arrivals, their sum and the running sum per station and bin.

    Bins cover the span of departures and the span of arrivals of each station.
    """
    sides = []
    for kind, out, into in (("start", 1, 0), ("end", 0, 1)):
        sides.append(
            trips.select(
                F.col(f"{kind}_station_id").alias("station_id"),
                time_bin(f"{kind}_date", minutes).alias("bin"),
                F.lit(out).alias("o"),
                F.lit(into).alias("i"),
            )
        )
    counted = (
        sides[0].unionByName(sides[1]).groupBy("station_id", "bin").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    )
    whole = Window.partitionBy("station_id")
    # one select, so that Spark evaluates the four ends in one pass
    ends = [
        f(F.when(F.col(c) > 0, F.col("bin"))).over(whole).alias(f"{name}_{c}")
        for c in ("o", "i")
        for name, f in (("lo", F.min), ("hi", F.max))
    ]
    counted = counted.select("*", *ends)
    spans = ("lo_o", "hi_o", "lo_i", "hi_i")
    inside = F.col("bin").between(F.col("lo_o"), F.col("hi_o")) | F.col("bin").between(F.col("lo_i"), F.col("hi_i"))
    flows = (
        fill_bins(counted, minutes, ["station_id", *spans])
        .filter(inside)
        .select(
            "station_id",
            "bin",
            (-F.coalesce("o", F.lit(0))).alias("bikes_out"),
            F.coalesce("i", F.lit(0)).alias("bikes_in"),
        )
    )
    upto = _by_bin(["station_id"]).rowsBetween(Window.unboundedPreceding, 0)
    change = F.col("bikes_in") + F.col("bikes_out")
    return flows.withColumn("delta_bikes", change).withColumn("sum_delta", F.sum("delta_bikes").over(upto))


def rebuild_status(status: DataFrame, trips: DataFrame, minutes: int, reset: bool = False) -> DataFrame:
    """Bikes as they should be according to the trips, next to the mean reading of each bin.

    Starts from the first reading; with ``reset`` it restarts from the reading of every
    bin at midnight, whose own change is dropped.
    """
    mean = resample(status, minutes, "mean", ["bikes_available"])
    both = mean.join(net_flow(trips, minutes).select("station_id", "bin", "delta_bikes"), ["station_id", "bin"])
    part = F.lit(0)
    if reset:
        midnight = (F.col("bin") % 86400 == 0).cast("int")
        earlier = _by_bin(["station_id"]).rowsBetween(Window.unboundedPreceding, -1)
        part = F.coalesce(F.sum(midnight).over(earlier), F.lit(0))
    # a part opens with the reading of the midnight row before it, the first one with its own
    previous = F.lag("bikes_available").over(_by_bin(["station_id"]))
    both = both.withColumn("part", part).withColumn(
        "opening", F.when(F.col("part") == 0, F.col("bikes_available")).otherwise(previous)
    )
    over = _by_bin(["station_id", "part"])
    offset = F.first("opening").over(over.rowsBetween(Window.unboundedPreceding, 0))
    moved = F.sum("delta_bikes").over(over.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("trips_bikes_available", offset + F.coalesce(moved, F.lit(0))).drop("part", "opening")


def null_audit(status: DataFrame, minutes: int, at: str) -> DataFrame:
    """Bins from ``at`` on per station, and those with a null value."""
    bins = resample(status, minutes, "mean").filter(F.col("bin") >= F.unix_timestamp(F.lit(at).cast("timestamp")))
    missing = F.col("bikes_available").isNull() | F.col("docks_available").isNull()
    return bins.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_bins"), F.count_if(missing).alias("n_null")
    )


def null_totals(audit: DataFrame) -> DataFrame:
    """One row over all stations of an audit: bins, those with a null value, those without."""
    total, null = F.coalesce(F.sum("n_bins"), F.lit(0)), F.coalesce(F.sum("n_null"), F.lit(0))
    return audit.agg(total.alias("n_bins"), null.alias("n_null"), (total - null).alias("n_known"))


def span(df: DataFrame, first: str = "time", last: str | None = None) -> DataFrame:
    return df.agg(F.min(first).alias("first"), F.max(last or first).alias("last"))

