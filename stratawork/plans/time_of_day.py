"""The time-of-day dimension, one row per second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time_from_parts, two_digits
from .calendar import integer_series

# The last hour of each part of the day, its name and its place; night spans midnight.
DAY_PARTS = [(4, "night", 4), (11, "morning", 1), (16, "afternoon", 2), (20, "evening", 3), (23, "night", 4)]
DAY_PARTS_ALT = [
    (4, "night", 8),
    (8, "morning (early)", 1),
    (10, "morning", 2),
    (11, "morning (late)", 3),
    (15, "afternoon (early)", 4),
    (16, "afternoon (late)", 5),
    (18, "evening (early)", 6),
    (20, "evening", 7),
    (23, "night", 8),
]


def _part(hour: Column, parts: list[tuple[int, str, int]], field: int) -> Column:
    """The part an hour falls into: the first one whose last hour is not before it."""
    chosen = F.lit(None)
    for part in reversed(parts):
        chosen = F.when(hour <= part[0], F.lit(part[field])).otherwise(chosen)
    return chosen


def day_part(hour: Column) -> Column:
    return _part(hour, DAY_PARTS, 1)


def time_of_day(spark: SparkSession) -> DataFrame:
    """All 86 400 seconds of a day. The spine is complete, so every sort number is the part's own number plus one."""
    seconds = integer_series(spark, 86400).select(
        F.floor(F.col("n") / 3600).cast("int").alias("hour_nr"),
        F.floor(F.col("n") % 3600 / 60).cast("int").alias("minute_nr"),
        (F.col("n") % 60).cast("int").alias("second_nr"),
    )
    hour, minute, second = F.col("hour_nr"), F.col("minute_nr"), F.col("second_nr")
    zero = F.lit(0)

    def unit(name: str) -> list[Column]:
        digits = two_digits(f"{name}_nr")
        return [
            F.col(f"{name}_nr"),
            F.concat(F.lit(name[0].upper()), digits).alias(f"{name}_code"),
            F.concat(F.lit(f"{name.capitalize()} "), digits).alias(f"{name}_name"),
            (F.col(f"{name}_nr") + 1).alias(f"{name}_sort"),
        ]

    return seconds.select(
        time_from_parts(hour, minute, second).alias("time"),
        (hour * 10000 + minute * 100 + second).alias("time_simple"),
        time_from_parts(hour, zero, zero).alias("time_hour"),
        time_from_parts(hour, minute, zero).alias("time_minute"),
        time_from_parts(hour, minute, second).alias("time_second"),
        *unit("hour"),
        *unit("minute"),
        *unit("second"),
        _part(hour, DAY_PARTS, 1).alias("day_part"),
        _part(hour, DAY_PARTS, 2).alias("day_part_sort"),
        _part(hour, DAY_PARTS_ALT, 1).alias("day_part_alt"),
        _part(hour, DAY_PARTS_ALT, 2).alias("day_part_alt_sort"),
    )


def time_dimension(times: DataFrame, key: str = "id_dim__common__time") -> DataFrame:
    """The time of day keyed by HHMMSS."""
    return times.select(F.col("time_simple").alias(key), "*")
