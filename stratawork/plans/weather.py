"""The hourly weather chain: landed rows, staging, long measurements, star and flat product."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import date_simple, hour_ending, replace_sentinel, scaled, shift_hours, time_simple
from ..operators.joins import build_fact, flatten_star
from ..operators.members import dimension, with_unknown_members
from ..operators.reshape import code_list, unpivot_by_codes
from ..operators.staging import typed

# Which staged column holds the measure of a code.
MEASURES = {
    "T": "temperature_celsius",
    "FH": "wind_speed_ms",
    "RH": "precipitation_mm",
    "Q": "global_radiation_jcm2",
    "U": "relative_humidity_pct",
}


def stage_observations(landed: DataFrame) -> DataFrame:
    """Typed and unit-converted hours. A rainfall of -1 means less than 0.05 mm."""
    return landed.select(
        F.col("station_code").cast("int").alias("station_code"),
        hour_ending("date", "hour").alias("observed_at"),
        scaled("t", "10.0").alias("temperature_celsius"),
        scaled("fh", "10.0").alias("wind_speed_ms"),
        replace_sentinel(F.col("rh").cast("int"), -1, Decimal("0.05"), scaled("rh", "10.0")).alias("precipitation_mm"),
        F.col("q").cast("int").alias("global_radiation_jcm2"),
        F.col("u").cast("int").alias("relative_humidity_pct"),
        "_load_id",
    )


def stage_stations(seed: DataFrame) -> DataFrame:
    return typed(
        seed,
        [
            ("station_code", "station_code", "int"),
            ("station_name", "station_name", "varchar(50)"),
            ("longitude", "longitude", "decimal(6,3)"),
            ("latitude", "latitude", "decimal(6,3)"),
            ("elevation_m", "elevation_m", "decimal(6,2)"),
        ],
    )


def stage_measurement_types(seed: DataFrame) -> DataFrame:
    return typed(
        seed,
        [
            ("measurement_type_code", "measurement_type_code", "varchar(10)"),
            ("measurement_type_name", "measurement_type_name", "varchar(50)"),
            ("measurement_type_desc", "measurement_type_desc", "varchar(200)"),
            ("unit", "unit", "varchar(10)"),
            ("measurement_type_sort", "measurement_type_sort", "int"),
        ],
    )


def stage_environments(seed: DataFrame) -> DataFrame:
    return typed(
        seed,
        [
            ("environment_code", "environment_code", "varchar(20)"),
            ("environment_name", "environment_name", "varchar(100)"),
            ("environment_alias", "environment_alias", "varchar(100)"),
            ("environment_desc", "environment_desc", "varchar(400)"),
            ("environment_sort", "environment_sort", "int"),
        ],
    )


def measurements(staged: DataFrame, types: DataFrame) -> DataFrame:
    """One row per station, hour and measurement type that has a value."""
    return unpivot_by_codes(
        staged,
        ["station_code", "observed_at"],
        MEASURES,
        code_list(types, "measurement_type_code", MEASURES),
        "measurement_type_code",
        "measurement_value",
    )


def station_dimension(stations: DataFrame, unknown: DataFrame) -> DataFrame:
    key = "id_dim__weather__knmi_station"
    return with_unknown_members(
        dimension(stations, key, "station_code"),
        unknown,
        key,
        {"station_code": F.col("unknown_id"), "station_name": F.col("unknown_name")},
    )


def measurement_type_dimension(types: DataFrame, unknown: DataFrame) -> DataFrame:
    key = "id_dim__weather__knmi_measurement_type"
    return with_unknown_members(
        dimension(types, key, "measurement_type_code"),
        unknown,
        key,
        {
            "measurement_type_code": F.substring("unknown_code", 1, 10),
            "measurement_type_name": F.col("unknown_name"),
            "measurement_type_desc": F.col("unknown_desc"),
            "unit": F.lit(""),
            "measurement_type_sort": F.lit(-1),
        },
    )


def environment_dimension(environments: DataFrame, unknown: DataFrame) -> DataFrame:
    key = "id_dim__common__environment"
    return with_unknown_members(
        dimension(environments, key, "environment_code"),
        unknown,
        key,
        {
            "environment_code": F.col("unknown_code"),
            "environment_name": F.col("unknown_name"),
            "environment_alias": F.col("unknown_name"),
            "environment_desc": F.lit(""),
            "environment_sort": F.lit(-1),
        },
    )


def measurement_fact(long: DataFrame, stations: DataFrame, types: DataFrame, **join_options) -> DataFrame:
    """One row per measurement. The calendar and time keys point at the start of the hour that ended."""
    start = shift_hours("observed_at", -1)
    return build_fact(
        long,
        "id_fct__weather__knmi_measurement",
        ["station_code", "observed_at", "measurement_type_code"],
        [
            (stations, "station_code", "id_dim__weather__knmi_station"),
            (types, "measurement_type_code", "id_dim__weather__knmi_measurement_type"),
        ],
        [
            date_simple(start).alias("id_dim__common__calendar"),
            time_simple(start).alias("id_dim__common__time"),
            "observed_at",
            "measurement_value",
        ],
        **join_options,
    )


def station_weather(fact: DataFrame, stations: DataFrame, types: DataFrame, **join_options) -> DataFrame:
    """The exposed product: one flat row per measurement with station and type attributes."""
    flat = flatten_star(
        fact,
        [
            (stations, "id_dim__weather__knmi_station", ["station_code", "station_name", "latitude", "longitude"]),
            (
                types,
                "id_dim__weather__knmi_measurement_type",
                ["measurement_type_code", "measurement_type_name", "unit"],
            ),
        ],
        **join_options,
    )
    return flat.select(
        "station_code", "station_name", "latitude", "longitude", "observed_at", "measurement_type_code",
        "measurement_type_name", "unit", "measurement_value",
    )
