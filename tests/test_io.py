"""Readers and sinks on small files."""

import pytest

from pyspark.sql import functions as F

from stationmine.operators import classify as cl
from stationmine.sources import readers, sinks
from tests.conftest import status_frame, tuples

CSV = {
    "status": "station_id,bikes_available,docks_available,time\n2,2,25,2013-08-29 12:06:01\n2,,25,2013-08-29 12:07:01\n",
    "station": "id,name,lat,long,dock_count,city,installation_date\n2,A Street,37.3,-121.9,27,San Jose,8/6/2013\n",
    "trip": "id,duration,start_date,start_station_name,start_station_id,end_date,end_station_name,end_station_id,"
    "bike_id,subscription_type,zip_code\n7,63,2013-08-29 14:13:00,A,66,2013-08-29 14:14:00,B,67,520,Subscriber,94127\n",
}


def test_csv_schemas(spark, tmp_path):
    for name, text in CSV.items():
        (tmp_path / f"{name}.csv").write_text(text)
    status = readers.read_status(spark, str(tmp_path / "status.csv"))
    assert status.dtypes == [
        ("station_id", "bigint"), ("bikes_available", "int"), ("docks_available", "int"), ("time", "timestamp"),
    ]
    assert [r.bikes_available for r in status.orderBy("time").collect()] == [2, None]
    assert readers.read_stations(spark, str(tmp_path / "station.csv")).first().city == "San Jose"
    trip = readers.read_trips(spark, str(tmp_path / "trip.csv"), timestampFormat="yyyy-MM-dd HH:mm:ss").first()
    assert (trip.end_station_id, trip.duration, trip.start_date.hour) == (67, 63, 14)


def test_tables_written_and_read_back(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 3)], readers.EDGE_SCHEMA)
    sinks.write_csv(edges, str(tmp_path / "edges"))
    assert tuples(readers.read_edges(spark, str(tmp_path / "edges")), "start_id", "end_id", "weight") == [(1, 2, 3)]
    status = status_frame(spark, [(1, 2, 3, "2024-01-01 00:00:00"), (1, 2, 3, "2024-01-02 00:00:00")])
    path = str(tmp_path / "clean")
    sinks.write_status(status, path)
    back = spark.read.parquet(path)
    assert tuples(back, "station_id", "time") == tuples(status, "station_id", "time")
    assert "PartitionFilters: [isnotnull(day" in back.filter("day = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()


def test_metrics_rows_are_appended(spark, tmp_path):
    conf = spark.createDataFrame([(1, 2, 3, 4)], "tp long, tn long, fp long, fn long")
    row = cl.metrics(conf).selectExpr(
        "'Full-Decrease' extraction", "'Dist' neighborhood", "0.5D confidence_threshold", "1 match_threshold",
        "accuracy", "precision", "recall", "f1", "tp", "tn", "fp", "fn",
    )
    path = str(tmp_path / "results")
    for _ in range(2):
        sinks.append_metrics(row, path)
    got = tuples(readers.read_metrics(spark, path), "extraction", "accuracy", "tp")
    assert got == [("Full-Decrease", 0.3, 1)] * 2


def test_times_in_several_formats(spark, tmp_path):
    head = "station_id,bikes_available,docks_available,time\n"
    times = ["2013/08/29 12:06:01", "8/29/2013 14:13", "2013-08-29 12:06:01", ""]
    (tmp_path / "good.csv").write_text(head + "".join(f"2,2,25,{t}\n" for t in times))
    got = readers.read_status(spark, str(tmp_path / "good.csv")).select("time").collect()
    assert sorted(str(r.time) for r in got) == ["2013-08-29 12:06:01", "2013-08-29 12:06:01", "2013-08-29 14:13:00", "None"]
    (tmp_path / "bad.csv").write_text(head + "2,2,25,yesterday\n")
    with pytest.raises(Exception, match="no known format"):
        readers.read_status(spark, str(tmp_path / "bad.csv")).collect()
    assert readers.read_status(spark, str(tmp_path / "bad.csv"), strict_times=False).first().time is None


def test_columns_in_another_order_fail(spark, tmp_path):
    (tmp_path / "edges.csv").write_text("weight,start_id,end_id\n1,2,3\n")
    with pytest.raises(Exception):
        readers.read_edges(spark, str(tmp_path / "edges.csv")).collect()


def test_grid_output_comes_back(spark, tmp_path):
    conf = spark.createDataFrame([(1, 2, 3, 4)], "fn long, fp long, tn long, tp long")
    rows = cl.metrics(conf).selectExpr("*", "7 n_rules", "30 interval", "1 match_threshold", "0.5D confidence_threshold",
                                       "'Dist' neighborhood", "'Full-Decrease' extraction")
    sinks.append_metrics(rows, str(tmp_path / "grid"))
    assert tuples(readers.read_metrics(spark, str(tmp_path / "grid")), "extraction", "accuracy", "tp", "fn") == [
        ("Full-Decrease", 0.7, 4, 1)
    ]
    with pytest.raises(ValueError):
        sinks.append_metrics(conf, str(tmp_path / "grid"))


def test_wide_tables_lie_in_few_folders(spark, tmp_path):
    """The driver lists every folder, so their number must not grow with the centres."""
    lags = F.create_map(F.col("id"), F.array(F.lit(1.0), F.lit(None).cast("double")))
    tables = spark.range(400).select(F.col("id").alias("center"), F.explode(F.array(F.lit(0).cast("long"), F.lit(900).cast("long"))).alias("bin"), lags.alias("lags"))
    path = str(tmp_path / "wide")
    sinks.write_neighborhoods(tables, path, groups=8)
    assert len(list((tmp_path / "wide").glob("part=*"))) == 8
    back = spark.read.schema(tables.schema).parquet(path)
    seen = lambda df: sorted((r.center, r.bin, tuple((k, tuple(v)) for k, v in r.lags.items())) for r in df.collect())
    assert seen(back) == seen(tables)
    assert back.filter((F.col("center") == 7) & (F.col("part") == sinks.center_group("center", 8))).count() == 2
