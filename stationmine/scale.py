"""Helpers that keep plans safe at scale: checked broadcasts, salting, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 64
#: Whether Spark removes the shuffle files of a query at its end, instead of whenever the driver collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse.

    The same rule for every master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nobody has written to."""
    return f"{shared_dir(spark).rstrip('/')}/stationmine/{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> None:
    """Add ``df`` to the Parquet files at ``path``. Its shuffle files, which nobody reads again, go at once."""
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, None)
    conf.set(RELEASE, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        if before is None:
            conf.unset(RELEASE)
        else:
            conf.set(RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from there.

    What is read several times, or must survive lost executors, is computed once; later reads
    prune columns and push filters. The folder is the cluster's to clear.
    """
    return cut_each([df])


def cut_each(frames: Iterable[DataFrame]) -> DataFrame:
    """Like ``cut`` of the union of ``frames``, of one schema, but written one after the other.

    Disk holds the shuffle files of one frame at a time, not of all.
    """
    path = first = None
    for df in frames:
        if first is None:
            first, path = df, fresh_path(df.sparkSession)
        _write(df, path)
    if first is None:
        raise ValueError("no frames")
    return first.sparkSession.read.schema(first.schema).parquet(path)


def spread(df: DataFrame, *keys: str, parts: int = 0) -> DataFrame:
    """Hash ``df`` into the session's full number of shuffle partitions, or ``parts`` if that is more.

    For compact tables that a join is about to multiply: left alone, adaptive execution
    sizes their partitions by what they hold now, not by what they grow to.
    """
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows. A plain count, combined on the map side."""
    return df.count() <= max_rows


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    condition=None,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join a possibly skewed ``big`` with ``small`` (inner, left or left_semi).

    The small side is broadcast only after its row count has been checked.
    Beyond the bound the join is salted: the big side is spread over ``salts``
    sub-keys by input partition (stable when a task is retried) and the small
    side is repeated once per sub-key, so a key holding a third of the rows is
    still shared by many tasks.  ``salts=1`` is for a big side whose rows per key are
    bounded, by the calendar for instance: nothing is repeated.  A hint keeps the
    optimizer from broadcasting what did not fit: it goes by the size of compressed
    files and does not see the repeats.
    """
    if fits(small, max_rows):
        small, keys = F.broadcast(small), list(on)
    elif salts == 1:
        small, keys = small.hint("merge"), list(on)
    else:
        big = big.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
        keys = list(on) + ["_salt"]
    if condition is None:
        return big.join(small, keys, how).drop("_salt")
    left, right = big.alias("l"), small.alias("r")
    match = condition
    for k in keys:
        match = match & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    joined = left.join(right, match, how)
    kept = [F.col(f"l.{c}") for c in big.columns if c != "_salt"]
    if how != "left_semi":
        kept += [F.col(f"r.{c}") for c in small.columns if c not in keys]
    return joined.select(*kept)


def global_sum(df: DataFrame, order: list, weight: Column, name: str) -> DataFrame:
    """Running total of ``weight`` in a total order, without sorting all rows in one task.

    Rows are range partitioned and written with their partition number; each part is
    summed up on its own and shifted by the totals of the parts before it.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weighed = df.withColumn("_weight", weight)
    parts = cut(weighed.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.sum("_weight").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.withColumn("_in", F.sum("_weight").over(upto))
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, (F.col("_ahead") + F.col("_in")).cast("long"))
        .drop("_part", "_ahead", "_in", "_weight")
    )


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Number all rows from 1 in a total order."""
    return global_sum(df, order, F.lit(1), name)
