"""Curated code tables that must hold exactly these rows.

Fixed values: labels, codes and sentinels that results are compared on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MONTHS = [
    (1, "Jan", "January"),
    (2, "Feb", "February"),
    (3, "Mar", "March"),
    (4, "Apr", "April"),
    (5, "May", "May"),
    (6, "Jun", "June"),
    (7, "Jul", "July"),
    (8, "Aug", "August"),
    (9, "Sep", "September"),
    (10, "Oct", "October"),
    (11, "Nov", "November"),
    (12, "Dec", "December"),
]

WEEKDAYS = [
    (1, "Mon", "Monday"),
    (2, "Tue", "Tuesday"),
    (3, "Wed", "Wednesday"),
    (4, "Thu", "Thursday"),
    (5, "Fri", "Friday"),
    (6, "Sat", "Saturday"),
    (7, "Sun", "Sunday"),
]

UNKNOWN_MEMBERS = [
    ("-1", "<< emp >>", "<< empty >>", "<< empty record >>", "9999-12-31", "-1"),
    ("-2", "<< unk >>", "<< unknown >>", "<< unknown record >>", "9999-12-31", "-2"),
    ("-3", "<< n/a >>", "<< not applicable >>", "<< not applicable record>>", "9999-12-31", "-3"),
]

ENVIRONMENTS = [
    ("all", "All", None, "all environment", "0"),
    ("dev", "Development", None, "development environment", "1"),
    ("tst", "Test", None, "test environment", "2"),
    ("acc", "Acceptance", None, "acceptance environment", "3"),
    ("prd", "Production", None, "production environment", "4"),
]

STATIONS = [
    ("260", "De Bilt", "5.180", "52.100", "1.90"),
    ("270", "Leeuwarden Airport", "5.752", "53.224", "1.20"),
    ("280", "Groningen Airport Eelde", "6.585", "53.125", "5.20"),
    ("290", "Twenthe Airport", "6.891", "52.274", "34.80"),
    ("370", "Eindhoven Airport", "5.377", "51.451", "22.60"),
    ("375", "Volkel", "5.707", "51.659", "22.00"),
    ("380", "Maastricht Airport", "5.762", "50.906", "114.30"),
]

MEASUREMENT_TYPES = [
    ("T", "Temperature", "Air temperature at 1.50 m, hourly value", "C", "1"),
    ("FH", "Wind speed", "Hourly mean wind speed", "m/s", "2"),
    ("RH", "Precipitation", "Hourly precipitation sum (0.05 for less than 0.05 mm)", "mm", "3"),
    ("Q", "Global radiation", "Hourly sum of global radiation", "J/cm2", "4"),
    ("U", "Relative humidity", "Relative humidity at 1.50 m", "%", "5"),
]

# Public holidays of the Netherlands as rules; see plans/holidays.py for the columns.
NL_HOLIDAYS = [
    ("Nieuwjaarsdag", 1, 1, None, None, None, None, None),
    ("Eerste paasdag", None, None, 0, None, None, None, None),
    ("Tweede paasdag", None, None, 1, None, None, None, None),
    ("Koninginnedag", 4, 30, None, 1949, 1979, None, 1),
    ("Koninginnedag", 4, 30, None, 1980, 2013, None, -1),
    ("Koningsdag", 4, 27, None, 2014, None, None, -1),
    ("Bevrijdingsdag", 5, 5, None, 1990, None, 5, None),
    ("Hemelvaartsdag", None, None, 39, None, None, None, None),
    ("Eerste Pinksterdag", None, None, 49, None, None, None, None),
    ("Tweede Pinksterdag", None, None, 50, None, None, None, None),
    ("Eerste Kerstdag", 12, 25, None, None, None, None, None),
    ("Tweede Kerstdag", 12, 26, None, None, None, None, None),
]


def code_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from literal rows. It is part of the plan itself: no job, no Python worker, known size."""

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(value)

    fields = [field.split() for field in schema.split(", ")]
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(name for name, _ in fields)})")


def months(spark: SparkSession) -> DataFrame:
    return code_table(spark, MONTHS, "month_nr int, month_code string, month_name string")


def weekdays(spark: SparkSession) -> DataFrame:
    return code_table(spark, WEEKDAYS, "weekday_nr int, weekday_code string, weekday_name string")


def unknown_members(spark: SparkSession) -> DataFrame:
    return code_table(
        spark,
        UNKNOWN_MEMBERS,
        "unknown_id int, unknown_code string, unknown_name string, unknown_desc string, unknown_date date, "
        "unknown_sort int",
    )


def environments(spark: SparkSession) -> DataFrame:
    return code_table(
        spark,
        ENVIRONMENTS,
        "environment_code string, environment_name string, environment_alias string, environment_desc string, "
        "environment_sort string",
    )


def stations(spark: SparkSession) -> DataFrame:
    return code_table(
        spark,
        STATIONS,
        "station_code string, station_name string, longitude string, latitude string, elevation_m string",
    )


def measurement_types(spark: SparkSession) -> DataFrame:
    return code_table(
        spark,
        MEASUREMENT_TYPES,
        "measurement_type_code string, measurement_type_name string, measurement_type_desc string, unit string, "
        "measurement_type_sort string",
    )


def nl_holidays(spark: SparkSession) -> DataFrame:
    return code_table(
        spark,
        NL_HOLIDAYS,
        "holiday_name string, month int, day int, easter_offset int, first_year int, last_year int, every_years int, "
        "sunday_shift int",
    )
