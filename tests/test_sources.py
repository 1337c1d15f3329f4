from __future__ import annotations

import os
from pathlib import Path
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stratawork.schemas import CLIMATE_HOURLY
from stratawork.sources import (
    NoRowsError,
    chunk_coverage,
    date_chunks,
    land,
    landing_files,
    load_window,
    read_landing,
    read_seed,
    read_source,
    require_rows,
    stamp_load,
    window_bounds,
)

START = datetime(2026, 1, 1)


def test_window_never_starts_before_the_start_date():
    assert window_bounds(datetime(2026, 1, 10), 30, START) == (date(2026, 1, 1), date(2026, 1, 10))
    assert window_bounds(datetime(2026, 9, 24), 30, START) == (date(2026, 8, 25), date(2026, 9, 24))


def test_empty_window_is_refused():
    with pytest.raises(ValueError, match="empty load window"):
        window_bounds(datetime(2025, 12, 31), 30, START)


def test_window_includes_both_ends_and_reaches_the_scan(spark, tmp_path):
    days = spark.sql("SELECT explode(sequence(date'2026-01-01', date'2026-02-28')) AS day")
    rows = days.select(F.col("day").cast("timestamp_ntz").alias("ts"), "day")
    rows.write.partitionBy("day").parquet(str(tmp_path / "t"))
    table = read_source(spark, str(tmp_path / "t"))
    by_day = load_window(table, "day", date(2026, 2, 10), 5, date(2026, 1, 1))
    assert [r.day.isoformat() for r in by_day.select(F.min("day").alias("day")).union(by_day.select(F.max("day"))).collect()] == [
        "2026-02-05",
        "2026-02-10",
    ]
    assert "PartitionFilters: [isnotnull(day" in by_day._jdf.queryExecution().toString()
    by_ts = load_window(table, "ts", datetime(2026, 2, 10, 12), 5, date(2026, 1, 1))
    assert by_ts.count() == 6
    assert "GreaterThanOrEqual(ts" in by_ts._jdf.queryExecution().toString()


def test_chunks_cover_the_window_and_the_last_is_short(spark):
    chunks = date_chunks(spark, date(2024, 1, 1), date(2024, 1, 25), 10).orderBy("chunk_nr").collect()
    assert [(c.chunk_start.isoformat(), c.chunk_end.isoformat()) for c in chunks] == [
        ("2024-01-01", "2024-01-10"),
        ("2024-01-11", "2024-01-20"),
        ("2024-01-21", "2024-01-25"),
    ]
    assert date_chunks(spark, date(2024, 1, 2), date(2024, 1, 1), 10).count() == 0
    assert date_chunks(spark, date(2024, 1, 1), date(2024, 1, 1), 10).count() == 1


def test_coverage_flags_empty_chunks_and_ignores_rows_outside(spark):
    start, end = date(2024, 1, 1), date(2024, 1, 8)
    days = ["2023-12-31", "2024-01-01", "2024-01-01", "2024-01-08", "2024-01-09"]
    rows = spark.createDataFrame([(d,) for d in days], "day string").select(F.col("day").cast("date"))
    found = chunk_coverage(rows, "day", date_chunks(spark, start, end, 3), start, 3).orderBy("chunk_nr").collect()
    assert [(c.rows, c.is_empty) for c in found] == [(2, False), (0, True), (1, False)]


def test_a_load_without_rows_fails(spark):
    with pytest.raises(NoRowsError, match="weather has no rows"):
        require_rows(spark.range(0), "weather")
    assert require_rows(spark.range(1)).count() == 1


def test_landing_archive(spark, tmp_path):
    root = str(tmp_path / "landing")
    rows = spark.createDataFrame(
        [(260, "2024-01-01", 1, 57, None, None, None)],
        "station_code bigint, date string, hour bigint, t bigint, rh bigint, ww bigint, ix bigint",
    )
    for load_id in ("1758700000.123456", "1758786400.5"):
        path = land(stamp_load(rows, load_id), root, "weather", load_id)
        assert path.endswith(f"weather__{load_id}")
    with pytest.raises(Exception, match="already exists"):
        land(stamp_load(rows, load_id), root, "weather", load_id)
    read = read_landing(spark, f"{root}/weather__*", CLIMATE_HOURLY)
    assert dict(read.dtypes)["ww"] == "bigint"
    first = read.filter("_load_id = '1758700000.123456'").first()
    assert (first.station_code, first.t, first.ww, first.q) == (260, 57, None, None)
    empty = tmp_path / "landing" / "weather__1758700000.123456" / "empty.json"
    empty.touch()
    files = {Path(f.path).name: f for f in landing_files(spark, root, read).collect()}
    assert files["empty.json"].rows == files["empty.json"].size == 0
    full = sorted((f.load_id, f.rows) for f in files.values() if f.rows)
    assert full == [("1758700000.123456", 1), ("1758786400.5", 1)]
    for file in landing_files(spark, root).collect():
        facts = os.stat(file.path.removeprefix("file:"))
        assert (file.size, int(file.modified_at.timestamp())) == (facts.st_size, int(facts.st_mtime))


def test_a_line_that_does_not_parse_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"station_code": "x"}\n')
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        read_landing(spark, str(tmp_path), CLIMATE_HOURLY).collect()


def test_seed_types_and_blanks(spark, tmp_path):
    (tmp_path / "seed.csv").write_text('code,name,sort,height\n"260","De Bilt","1","1.90"\n"270",,,\n')
    rows = read_seed(spark, str(tmp_path / "seed.csv"), "code string, name string, sort int, height decimal(6,2)").collect()
    assert tuple(rows[0]) == ("260", "De Bilt", 1, Decimal("1.90"))
    assert tuple(rows[1]) == ("270", None, None, None)
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        read_seed(spark, str(tmp_path / "seed.csv"), "code int, name int, sort int, height int").collect()


def test_source_by_catalog_name(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert read_source(spark, "three").count() == 3
