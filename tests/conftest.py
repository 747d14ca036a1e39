import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("stationmine-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def status_frame(spark, rows):
    """Rows (station, bikes, docks, 'yyyy-mm-dd hh:mm:ss')."""
    df = spark.createDataFrame(rows, "station_id long, bikes_available int, docks_available int, t string")
    return df.selectExpr("station_id", "bikes_available", "docks_available", "cast(t as timestamp) as time")


def tuples(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
