"""Looking at a table: column summary and pages of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationmine.scale import global_rank


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, values, nulls, least and greatest value as text. One pass."""
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.count(name).alias("n_values"),
            F.count_if(F.col(name).isNull()).alias("n_nulls"),
            F.min(name).cast("string").alias("least"),
            F.max(name).cast("string").alias("greatest"),
        )
        for name, kind in df.dtypes
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("row")).select("row.*")


def page(df: DataFrame, order: list, offset: int, n: int) -> DataFrame:
    """``n`` rows after the first ``offset`` in the given order, which has to be total.

    Rows are ranked in their ranges, so a deep page goes through no single task.
    """
    rank = F.col("_rank")
    return global_rank(df, order, "_rank").filter((rank > offset) & (rank <= offset + n)).drop("_rank")
