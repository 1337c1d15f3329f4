"""The calendar dimension, one row per day plus the two sentinel dates."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed_values import code_table
from ..functions import (
    FIRST_SENTINEL,
    LAST_SENTINEL,
    date_simple,
    is_leap_year,
    iso_week,
    iso_year,
    known_date,
    period_end,
    period_start,
    two_digits,
    weekday_nr,
    yes_no,
)

EPOCH = date(1900, 1, 1)


def integer_series(spark: SparkSession, n: int) -> DataFrame:
    """0 .. n-1 in the column `n`."""
    return spark.range(n).withColumnRenamed("id", "n")


def date_spine(spark: SparkSession, start_year: int = 2000, end_year: int | None = None, horizon: int = 10) -> DataFrame:
    """Every day from the start year to the end year; `day` counts from 1900-01-01.

    The start year is fixed on purpose: one that moves with the clock would drop days. Without an end
    year it is this year plus the horizon.
    """
    last_year = end_year if end_year is not None else date.today().year + horizon
    first = (date(start_year, 1, 1) - EPOCH).days
    days = (date(last_year, 12, 31) - date(start_year, 1, 1)).days + 1
    day = F.date_add(F.to_date(F.lit(FIRST_SENTINEL)), F.col("day"))
    return (
        integer_series(spark, days)
        .select((F.col("n") + first).cast("int").alias("day"))
        .select("day", day.alias("date"), day.cast("timestamp_ntz").alias("date_time"))
    )


def year_span(df: DataFrame, date_col: str) -> tuple[int, int]:
    """First and last year of a table's real dates (action: one scan of the column). The sentinels are no dates.

    For tables whose calendar is not shared; a calendar that several facts use starts in a fixed year.
    """
    real = df.filter(~F.col(date_col).cast("date").isin(FIRST_SENTINEL, LAST_SENTINEL))
    lowest, highest = real.agg(F.year(F.min(date_col)), F.year(F.max(date_col))).first()
    if lowest is None:
        raise ValueError(f"{date_col} has no dates")
    return lowest, highest


def end_year(dates: list[tuple[DataFrame, str]], horizon: int = 10) -> int:
    """The last year of a shared calendar: this year plus the horizon, or that of a later real date (action).

    `dates` are the tables that meet the calendar and their date columns; each column is scanned once. The sentinels are
    no dates.
    """
    years = [date.today().year + horizon]
    for df, column in dates:
        day = F.col(column).cast("date")
        latest = df.agg(F.year(F.max(F.when(~day.isin(FIRST_SENTINEL, LAST_SENTINEL), day)))).first()[0]
        years.append(latest or years[0])
    return max(years)


def with_sentinels(spine: DataFrame) -> DataFrame:
    """The spine plus the two dates that mean 'no date', each once, also where the spine reaches them."""
    ends = code_table(
        spine.sparkSession,
        [(0, FIRST_SENTINEL, f"{FIRST_SENTINEL} 00:00:00"), (99999999, LAST_SENTINEL, f"{LAST_SENTINEL} 23:59:59")],
        "day int, date date, date_time timestamp_ntz",
    )
    return spine.filter(~F.col("date").isin(FIRST_SENTINEL, LAST_SENTINEL)).unionByName(ends)


def calendar(spine: DataFrame, months: DataFrame, weekdays: DataFrame, holidays: DataFrame) -> DataFrame:
    """The full calendar of a spine without gaps.

    The sequences count periods from the first date of the spine, so they are plain arithmetic. Label tables are joined
    without a hint: Spark broadcasts what is small.

    `base_year` starts in April. `year_week_nr` combines the calendar year with the ISO week, and the
    first ISO year counts its days from the first date of the spine.
    """
    base = with_sentinels(spine).select(
        "date",
        "date_time",
        date_simple("date").alias("date_simple"),
        F.year("date").alias("year_nr"),
        F.quarter("date").alias("quarter_nr"),
        F.month("date").alias("month_nr"),
        F.weekofyear("date").alias("week_nr"),
        iso_year("date").alias("iso_year_nr"),
        iso_week("date").alias("iso_week_nr"),
        F.dayofyear("date").alias("day_of_year_nr"),
        F.dayofmonth("date").alias("day_of_month_nr"),
        weekday_nr("date").alias("day_of_week_nr"),
        known_date("date").alias("_known"),
    )
    labels = months.select("month_nr", F.col("month_code").alias("month_abbr"), "month_name")
    names = weekdays.select(
        F.col("weekday_nr").alias("day_of_week_nr"),
        F.col("weekday_code").alias("week_day_abbr"),
        F.col("weekday_name").alias("week_day_name"),
    )
    rows = (
        base.join(labels, "month_nr", "left")
        .join(names, "day_of_week_nr", "left")
        .join(holidays.select("date", "holiday_name"), "date", "left")
    )
    real = spine.filter(~F.col("date").isin(FIRST_SENTINEL, LAST_SENTINEL))
    rows = rows.withColumn("_first", real.agg(F.min("date").alias("first")).scalar())

    def text(column: str) -> Column:
        return F.col(column).cast("string")

    def sequence(period: Callable[[Column], Column]) -> Column:
        """How many periods a date is after the first one, which is 1; the sentinels have no number."""
        number = period(F.col("date")) - period(F.col("_first")) + 1
        return F.when(~F.col("date").isin(FIRST_SENTINEL, LAST_SENTINEL), number.cast("int"))

    def days_of(date: Column) -> Column:
        return F.datediff(date, F.lit(FIRST_SENTINEL).cast("date"))

    units = ["year", "quarter", "month", "week"]
    # The column names and codes below are fixed values: results are compared on them.
    weekend, workday = F.col("day_of_week_nr") >= 6, F.col("day_of_week_nr") <= 5
    return rows.select(
        "date",
        "date_time",
        "date_simple",
        "year_nr",
        F.when(F.col("month_nr") < 4, F.col("year_nr") - 1).otherwise(F.col("year_nr")).alias("base_year"),
        "quarter_nr",
        "month_nr",
        "week_nr",
        "iso_year_nr",
        "iso_week_nr",
        (F.col("year_nr") * 10000 + F.col("quarter_nr") * 100 + F.col("month_nr")).alias("year_quarter_month_nr"),
        (F.col("year_nr") * 100 + F.col("quarter_nr")).alias("year_quarter_nr"),
        (F.col("year_nr") * 100 + F.col("month_nr")).alias("year_month_nr"),
        (F.col("year_nr") * 100 + F.col("week_nr")).alias("year_week_nr"),
        (F.col("iso_year_nr") * 100 + F.col("iso_week_nr")).alias("iso_year_week_nr"),
        "day_of_year_nr",
        "day_of_month_nr",
        "day_of_week_nr",
        F.row_number().over(Window.partitionBy("iso_year_nr").orderBy("date")).alias("iso_year_day_nr"),
        F.concat(F.lit("Y"), text("year_nr")).alias("year_code"),
        F.concat(F.lit("Year "), text("year_nr")).alias("year_name"),
        F.concat(F.lit("Q"), text("quarter_nr")).alias("quarter_code"),
        F.concat(F.lit("Quarter "), text("quarter_nr")).alias("quarter_name"),
        F.concat(F.lit("M"), two_digits("month_nr")).alias("month_code"),
        "month_name",
        "month_abbr",
        F.concat(F.lit("W"), two_digits("week_nr")).alias("week_code"),
        F.concat(F.lit("Week "), text("week_nr")).alias("week_desc"),
        F.concat(F.lit("Y"), text("iso_year_nr")).alias("iso_year_code"),
        F.concat(F.lit("ISO Year "), text("iso_year_nr")).alias("iso_year_desc"),
        F.concat(F.lit("W"), two_digits("iso_week_nr")).alias("iso_week_code"),
        F.concat(F.lit("ISO Week "), text("iso_week_nr")).alias("iso_week_desc"),
        F.concat(F.lit("YD"), F.lpad(text("day_of_year_nr"), 3, "0")).alias("year_day_code"),
        F.concat(F.lit("MD"), two_digits("day_of_month_nr")).alias("month_day_code"),
        F.concat(F.lit("WD"), two_digits("day_of_week_nr")).alias("week_day_code"),
        "week_day_name",
        "week_day_abbr",
        *[yes_no(F.col("date") == period_start("_known", u)).alias(f"is_first_day_of_{u}") for u in units[:3]],
        yes_no(F.col("day_of_week_nr") == 1).alias("is_first_day_of_week"),
        *[yes_no(F.col("date") == period_end("_known", u)).alias(f"is_last_day_of_{u}") for u in units[:3]],
        yes_no(F.col("day_of_week_nr") == 7).alias("is_last_day_of_week"),
        yes_no(is_leap_year("year_nr")).alias("is_leap_year"),
        yes_no((F.col("day_of_month_nr") == 29) & (F.col("month_nr") == 2)).alias("is_leap_day"),
        yes_no(weekend).alias("is_weekend"),
        yes_no(workday).alias("is_workday"),
        *[period_start("_known", u).alias(f"first_date_of_{u}") for u in units],
        *[period_end("_known", u).alias(f"last_date_of_{u}") for u in units],
        sequence(iso_year).alias("iso_year_sort"),
        sequence(F.year).alias("year_sort"),
        sequence(lambda d: F.year(d) * 4 + F.quarter(d)).alias("quarter_sort"),
        sequence(lambda d: F.year(d) * 12 + F.month(d)).alias("month_sort"),
        sequence(days_of).alias("day_sort"),
        sequence(lambda d: F.floor(days_of(d) / 7)).alias("week_sort"),
        F.col("holiday_name").isNotNull().alias("is_holiday"),
        "holiday_name",
        (F.col("month_nr").isin(5, 6, 7, 8) & weekend).alias("is_high_generation_day"),
        (F.col("month_nr").isin(12, 1, 2, 3) & workday).alias("is_high_consumption_day"),
    )


def calendar_dimension(calendar: DataFrame, key: str = "id_dim__common__calendar") -> DataFrame:
    """The calendar columns that facts are analysed by, keyed by YYYYMMDD."""
    return calendar.select(
        F.col("date_simple").alias(key),
        "date", "date_time", "date_simple", "year_nr", "base_year", "quarter_nr", "month_nr", "month_name",
        "week_nr", "iso_year_nr", "iso_week_nr", "is_holiday", "holiday_name", "is_high_generation_day",
        "is_high_consumption_day",
    )
