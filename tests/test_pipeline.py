"""From landed JSON lines to the exposed product, its tests, its freshness and an incremental rebuild."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from stratawork import fixed_values
from stratawork.functions import loaded_at
from stratawork.operators import (
    affected_partitions,
    changed_sources,
    freshness,
    merge_into,
    observations,
    run_suite,
    store_failures,
)
from stratawork.plans import build_weather, weather_suite
from stratawork.schemas import CLIMATE_HOURLY
from stratawork.sources import date_chunks, chunk_coverage, load_window, read_landing, require_rows

FIRST, SECOND = "1736035200.5731854", "1736121600.25"
NOW = datetime(2025, 1, 6, 6)


def _land(root, load_id, first, last, t, stations=(260, 270, 380)):
    """Hours 1 and 24 of every day; the 3rd of January is missing at the source."""
    folder = root / f"weather__{load_id}"
    folder.mkdir(parents=True)
    with open(folder / "part-0.json", "w") as out:
        day = first
        while day <= last:
            for station in stations if day != date(2025, 1, 3) else ():
                for hour in (1, 24):
                    row = {
                        "station_code": station, "date": f"{day}T00:00:00.000Z" if hour == 24 else str(day), "hour": hour,
                        "t": t, "fh": 35, "rh": -1 if hour == 1 else None, "q": 7, "u": 88, "ww": None, "_load_id": load_id,
                    }
                    out.write(json.dumps(row) + "\n")
            day += timedelta(days=1)


def test_pipeline(spark, tmp_path):
    landing, table, warehouse = tmp_path / "landing", str(tmp_path / "_SRC" / "hourly"), str(tmp_path / "warehouse")
    _land(landing, FIRST, date(2024, 12, 29), date(2025, 1, 4), 57)
    _land(landing, SECOND, date(2025, 1, 1), date(2025, 1, 5), 60, (260, 270, 380, 999))  # 999 is not a known station

    for load_id in (FIRST, SECOND, SECOND):
        landed = read_landing(spark, str(landing / f"weather__{load_id}"), CLIMATE_HOURLY)
        landed = landed.withColumn("date", F.col("date").cast("date"))
        batch = require_rows(load_window(landed, "date", NOW, 30, date(2024, 12, 30)), "weather")
        merge_into(spark, table, batch, ["station_code", "date", "hour"], ["_load_id"], ["date"])

    source = spark.read.schema(CLIMATE_HOURLY.replace("date string", "date date")).parquet(table)
    # 30th and 31st from the first load, then 1st, 2nd, 4th and 5th with the fourth station.
    assert source.count() == 2 * 3 * 2 + 4 * 4 * 2
    assert source.filter("date >= '2025-01-01'").select("t").distinct().count() == 1
    chunks = date_chunks(spark, date(2024, 12, 30), date(2025, 1, 5), 2)
    empty = chunk_coverage(source, "date", chunks, date(2024, 12, 30), 2).filter("is_empty")
    assert empty.count() == 0
    single = date_chunks(spark, date(2025, 1, 1), date(2025, 1, 5), 1)
    missing = chunk_coverage(source, "date", single, date(2025, 1, 1), 1).filter("is_empty").collect()
    assert [m.chunk_start for m in missing] == [date(2025, 1, 3)]

    built = build_weather(
        spark, source, warehouse, fixed_values.stations(spark), fixed_values.measurement_types(spark), 2020, 2026
    )
    staged, flat = built["stg__knmi__climate_hourly"], built["exp__weather__station_weather"]
    assert staged.count() == source.count()
    assert flat.count() == built["fct__weather__knmi_measurement"].count() == 44 * 4 + 22
    rain = flat.filter("measurement_type_code = 'RH'").select("measurement_value").distinct().collect()
    assert [r[0] for r in rain] == [Decimal("0.05")]
    assert flat.filter("station_code = -2").count() == 4 * (2 * 4 + 1)
    assert spark.table("_EXP__exp__weather__station_weather").count() == flat.count()
    assert (tmp_path / "warehouse" / "_MRT" / "dim__common__calendar").exists()

    results = {r.test: r for r in run_suite(weather_suite(built)).collect()}
    assert {r.status for name, r in results.items() if "exp__" not in name} == {"pass"}
    # One unknown station: the flat product shows it as -2, still one row per hour and type.
    assert results["exp__weather__station_weather__station_code__observed_at__measurement_type_code__unique"].failures == 0
    assert store_failures(weather_suite(built), str(tmp_path / "failures")) and not (tmp_path / "failures").exists()

    checked = freshness({"weather.hourly": (source, loaded_at("_load_id"))}, NOW)
    row = checked.first()
    assert (row.max_loaded_at, row.status) == (datetime(2025, 1, 6, 0, 0, 0, 250000), "pass")
    runs = spark.createDataFrame([("build", "SUCCESS")], "job string, status string").withColumn(
        "start_time", F.lit("2025-01-05 07:00:00").cast("timestamp_ntz")
    )
    assert changed_sources(observations(checked), runs, "build").first().source == "weather.hourly"
    days = affected_partitions(source.withColumn("at", loaded_at("_load_id")), "at", datetime(2025, 1, 5, 12), ["date"])
    assert days.count() == 4
