"""The whole weather build: every layer from the source table to the exposed product, and its tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixed_values
from ..operators.quality import Check, declare, require_passed
from ..operators.write import materialise
from . import weather
from .calendar import calendar, calendar_dimension, date_spine
from .holidays import holidays
from .time_of_day import time_dimension, time_of_day


def build_weather(
    spark: SparkSession,
    source: DataFrame,
    root: str,
    stations: DataFrame,
    types: DataFrame,
    start_year: int = 2000,
    end_year: int | None = None,
    checked: bool = True,
) -> dict[str, DataFrame]:
    """Build all models below `source`, a merged table of landed hours (write).

    Each layer reads only the one below it. Tables that grow with the source are written once and
    read by the layers above; the exposed product is a view. It is exposed only if the tests of the
    models below it pass, unless `checked` is off. Returns the models by name.
    """
    unknown = fixed_values.unknown_members(spark)
    built: dict[str, DataFrame] = {}

    def model(layer: str, name: str, df: DataFrame) -> DataFrame:
        built[name] = materialise(df, root, layer, name)
        return built[name]

    stations = model("stg", "stg__seed__knmi_station", weather.stage_stations(stations))
    types = model("stg", "stg__seed__knmi_measurement_type", weather.stage_measurement_types(types))
    environments = model(
        "stg", "stg__seed__environment", weather.stage_environments(fixed_values.environments(spark))
    )
    staged = model("stg", "stg__knmi__climate_hourly", weather.stage_observations(source))

    long = model("int", "int__weather__knmi_measurement", weather.measurements(staged, types))
    spine = model("int", "int__common__date", date_spine(spark, start_year, end_year))
    named = model("int", "int__common__holiday", holidays(spine, fixed_values.nl_holidays(spark)))
    days = model(
        "int",
        "int__common__calendar",
        calendar(spine, fixed_values.months(spark), fixed_values.weekdays(spark), named),
    )
    times = model("int", "int__common__time", time_of_day(spark))

    station_dim = model("mrt", "dim__weather__knmi_station", weather.station_dimension(stations, unknown))
    type_dim = model("mrt", "dim__weather__knmi_measurement_type", weather.measurement_type_dimension(types, unknown))
    model("mrt", "dim__common__environment", weather.environment_dimension(environments, unknown))
    model("mrt", "dim__common__calendar", calendar_dimension(days))
    model("mrt", "dim__common__time", time_dimension(times))
    fact = model("mrt", "fct__weather__knmi_measurement", weather.measurement_fact(long, station_dim, type_dim))

    if checked:
        require_passed(weather_suite(built))
    model("exp", "exp__weather__station_weather", weather.station_weather(fact, station_dim, type_dim))
    return built


def weather_suite(built: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, list[Check]]]:
    """The tests of the weather models that are built, ready for `run_suite` or `store_failures`."""
    grain = ["station_code", "observed_at", "measurement_type_code"]
    station, kind = "id_dim__weather__knmi_station", "id_dim__weather__knmi_measurement_type"
    day, time = "id_dim__common__calendar", "id_dim__common__time"
    fact_key = "id_fct__weather__knmi_measurement"
    environment = "id_dim__common__environment"
    sorts = ["iso_year_sort", "year_sort", "quarter_sort", "month_sort", "day_sort", "week_sort"]
    checks = {
        "stg__seed__knmi_station": declare(
            rows=7, not_null=["station_code", "station_name"], unique=["station_code", "station_name"]
        ),
        "stg__seed__knmi_measurement_type": declare(
            rows=5,
            not_null=["measurement_type_code", "measurement_type_name"],
            unique=["measurement_type_code", "measurement_type_name"],
        ),
        "stg__seed__environment": declare(
            rows=5,
            not_null=["environment_code", "environment_name"],
            unique=["environment_code", "environment_name"],
            not_empty=["environment_code", "environment_name"],
            not_negative=["environment_sort"],
        ),
        "stg__knmi__climate_hourly": declare(
            combination=["station_code", "observed_at"],
            not_null=["station_code", "observed_at"],
            not_negative=["precipitation_mm"],
        ),
        "int__weather__knmi_measurement": declare(combination=grain, not_null=[*grain, "measurement_value"]),
        "int__common__date": declare(
            not_null=["day", "date", "date_time"], unique=["day", "date", "date_time"]
        ),
        "int__common__holiday": declare(not_null=["date", "holiday_name"], unique=["date"]),
        "int__common__calendar": declare(not_null=["date"], unique=["date"], not_negative=["year_nr", "base_year", *sorts]),
        "int__common__time": declare(
            not_null=["time"], unique=["time"], not_negative=["time_simple", "hour_sort", "minute_sort", "second_sort"]
        ),
        "dim__weather__knmi_station": declare(
            not_null=[station, "station_code", "station_name"], unique=[station, "station_code"]
        ),
        "dim__weather__knmi_measurement_type": declare(
            not_null=[kind, "measurement_type_code", "measurement_type_name"], unique=[kind, "measurement_type_code"]
        ),
        "dim__common__environment": declare(
            not_null=[environment, "environment_code", "environment_name", "environment_sort"],
            unique=[environment, "environment_code"],
            not_empty=["environment_code", "environment_name"],
        ),
        "dim__common__calendar": declare(not_null=[day, "date", "month_name", "is_holiday"], unique=[day, "date"]),
        "dim__common__time": declare(not_null=[time, "time", "day_part"], unique=[time, "time"]),
        "fct__weather__knmi_measurement": declare(
            not_null=[fact_key, station, kind, day, time, "observed_at", "measurement_value"],
            unique=[fact_key],
            parents={
                station: (built["dim__weather__knmi_station"], station),
                kind: (built["dim__weather__knmi_measurement_type"], kind),
                day: (built["dim__common__calendar"], day),
                time: (built["dim__common__time"], time),
            },
        ),
        "exp__weather__station_weather": declare(combination=grain),
    }
    return {name: (built[name], declared) for name, declared in checks.items() if name in built}
