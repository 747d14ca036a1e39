"""Sinks. Parquet is the native form; the rule text form is kept for exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationmine.functions.columns import bin_time
from stationmine.scale import spread
from stationmine.sources.readers import METRICS_SCHEMA

# The two header lines of the rule text form.
RULE_HEADER = "Pattern, Confidence-Frequence"
RULE_COUNT = "Total number of input patterns: "
#: How times are written as text.
TIME_OUT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def rule_line() -> Column:
    """``[[[['a,b'], ['c']]], ['0.5 - 12']]`` from columns sequence, conf and sup."""
    slots = F.concat_ws(
        ", ",
        F.transform(
            "sequence",
            lambda s: F.concat(F.lit("['"), F.concat_ws(",", F.array_sort(s)), F.lit("']")),
        ),
    )
    tail = F.concat(F.col("conf").cast("string"), F.lit(" - "), F.col("sup").cast("string"))
    return F.concat(F.lit("[[["), slots, F.lit("]], ['"), tail, F.lit("']]"))


def rules_to_line(rules: DataFrame) -> DataFrame:
    return rules.select("key", "conf", "sup", rule_line().alias("line"))


def write_rules_text(rules: DataFrame, path: str, by: str = "conf", mode: str = "overwrite") -> None:
    """Header, count line and one rule per line, best rule first.

    The order is global: the sort is range partitioned, and part files keep the
    order of their ranges.
    """
    first, second = ("conf", "sup") if by == "conf" else ("sup", "conf")
    head = (
        rules.agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("o"), F.lit(RULE_HEADER).alias("line")),
                    F.struct(
                        F.lit(1).alias("o"),
                        F.concat(F.lit(RULE_COUNT), F.col("n")).alias("line"),
                    ),
                )
            ).alias("h")
        )
        .select("h.o", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"),
                F.lit("").alias("key"), "h.line")
    )
    body = rules.select(
        F.lit(2).alias("o"),
        F.col(first).cast("double").alias("a"),
        F.col(second).cast("double").alias("b"),
        "key",
        rule_line().alias("line"),
    )
    ordered = head.unionByName(body).orderBy("o", F.desc("a"), F.desc("b"), "key")
    ordered.select("line").write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple = ()) -> None:
    """With a header, and times to the microsecond in a form the readers know."""
    times = {"timestampFormat": TIME_OUT, "timestampNTZFormat": TIME_OUT}
    df.write.mode(mode).partitionBy(*partition_by).option("header", True).options(**times).csv(path)


def write_neighborhoods(tables: DataFrame, path: str, days: int = 365, mode: str = "overwrite", groups: int = 256) -> None:
    """Wide tables of all centres: ``groups`` folders by a hash of the centre, a file per ``days`` in each, in order of centre and bin.

    The number of files, which the driver lists, does not grow with the centres. Those of one centre lie
    in the folder ``center_group(center, groups)``, next to each other.
    """
    rows = tables.withColumn("part", center_group("center", groups))
    dealt = spread(rows, "part", F.floor(F.col("bin") / (days * 86400))).sortWithinPartitions("part", "center", "bin")
    dealt.write.mode(mode).partitionBy("part").parquet(path)


def center_group(center: str, groups: int = 256) -> Column:
    """Folder of a centre's wide table."""
    return F.pmod(F.xxhash64(center), F.lit(groups)).cast("int")


def write_status(status: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cleaned readings by date, so that later day and split filters prune files."""
    (
        status.withColumn("day", F.to_date("time"))
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Appends the columns of METRICS_SCHEMA in its order; a missing one is an error, others are left out."""
    kinds = [x.split() for x in METRICS_SCHEMA.split(", ")]
    missing = {name for name, _ in kinds} - set(metrics.columns)
    if missing:
        raise ValueError(f"metrics without {', '.join(sorted(missing))}")
    metrics.select(*[F.col(name).cast(kind) for name, kind in kinds]).write.mode("append").option("header", True).csv(path)


def stamp(df: DataFrame, bin_col: str = "bin") -> DataFrame:
    """Replace an epoch-second bin by a ``time`` column for export."""
    return df.withColumn("time", bin_time(bin_col)).drop(bin_col)
