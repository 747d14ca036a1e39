"""Readers with explicit schemas: no inference pass, and only needed columns are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS_SCHEMA = "station_id long, bikes_available int, docks_available int, time timestamp"
STATION_SCHEMA = (
    "id long, name string, lat double, long double, dock_count int, city string, "
    "installation_date string"
)
TRIP_SCHEMA = (
    "id long, duration long, start_date timestamp, start_station_name string, "
    "start_station_id long, end_date timestamp, end_station_name string, end_station_id long, "
    "bike_id long, subscription_type string, zip_code string"
)
EDGE_SCHEMA = "start_id long, end_id long, weight long"
METRICS_SCHEMA = (
    "extraction string, neighborhood string, confidence_threshold double, match_threshold int, "
    "accuracy double, precision double, recall double, f1 double, tp long, tn long, fp long, fn long"
)


#: Time formats tried in this order when CSV is read.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd HH:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
)


def parse_time(text: Column, formats: tuple[str, ...] = TIME_FORMATS, strict: bool = True) -> Column:
    """Text as a timestamp by the first format that fits. Text that fits none fails the job, or is null unless ``strict``."""
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    if not strict:
        return parsed
    unknown = F.raise_error(F.concat(F.lit("time in no known format: "), text)).cast("timestamp")
    return F.when(parsed.isNull() & text.isNotNull(), unknown).otherwise(parsed)


def read_table(
    spark: SparkSession, path: str, schema: str, fmt: str = "csv", strict_times: bool = True, **options
) -> DataFrame:
    """A table with a known schema; CSV by default, any Spark format on request.

    CSV columns are held against the names in the header, so a file with another order fails. Times may
    come in any of TIME_FORMATS, or in the one named by ``timestampFormat``.
    """
    if fmt != "csv":
        return spark.read.schema(schema).options(**options).format(fmt).load(path)
    formats = (options.pop("timestampFormat"),) if "timestampFormat" in options else TIME_FORMATS
    kinds = [x.split() for x in schema.split(", ")]
    plain = ", ".join(f"{n} {'string' if k == 'timestamp' else k}" for n, k in kinds)
    rows = spark.read.schema(plain).option("header", True).option("enforceSchema", False).options(**options).csv(path)
    return rows.select(
        *[parse_time(F.col(n), formats, strict_times).alias(n) if k == "timestamp" else F.col(n) for n, k in kinds]
    )


def read_status(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    return read_table(spark, path, STATUS_SCHEMA, fmt, **options)


def read_stations(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    return read_table(spark, path, STATION_SCHEMA, fmt, **options)


def read_trips(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    return read_table(spark, path, TRIP_SCHEMA, fmt, **options)


def read_edges(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    return read_table(spark, path, EDGE_SCHEMA, fmt, **options)


def read_metrics(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    return read_table(spark, path, METRICS_SCHEMA, fmt, **options)


def read_rules_text(spark: SparkSession, path: str) -> DataFrame:
    """Rules from the text form: header lines are told apart by shape, not by line number.

    A line reads ``[[[['a,b'], ['c']]], ['0.5 - 12']]``: slots, then confidence and support.
    """
    quoted = F.regexp_extract_all(F.col("value"), F.lit("'([^']*)'"), F.lit(1))
    parts = (
        spark.read.text(path)
        .filter(F.col("value").startswith("[["))
        .select(quoted.alias("q"))
        .select(
            F.slice("q", F.lit(1), F.size("q") - 1).alias("slots"),
            F.split(F.element_at("q", -1), " - ").alias("cs"),
        )
    )
    sequence = F.transform("slots", lambda s: F.array_sort(F.split(s, ",")))
    return parts.select(
        sequence.alias("sequence"),
        F.concat_ws("-", F.transform(sequence, lambda s: F.concat_ws(",", s))).alias("key"),
        F.element_at("cs", 1).cast("double").alias("conf"),
        F.element_at("cs", 2).cast("long").alias("sup"),
    )
