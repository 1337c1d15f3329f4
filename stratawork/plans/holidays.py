"""Public holidays from a table of rules.

A rule is a fixed `month`/`day`, an `easter_offset` in days, an `orthodox_offset` from the Easter of the Julian calendar, an
`islamic_month`/`islamic_day` of the tabular Islamic calendar, or the `nth` `weekday_nr` (1 = Monday) of a `month`, counted
from its end if negative; columns that no rule needs may be left out. It may hold only from `first_year` to
`last_year`, only in years divisible by `every_years`, and move by `sunday_shift` days when it
falls on a Sunday. Rules are input data: pass another country's table for another country.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import easter_sunday, islamic_date, islamic_year, orthodox_easter, weekday_nr
from ..operators.joins import all_rows


def holidays(spine: DataFrame, rules: DataFrame, date: str = "date") -> DataFrame:
    """(date, holiday_name) of the spine dates that are holidays, one row per date.

    Rules meet the distinct years only, and the spine is joined on the computed date. Two holidays
    on one date are listed in one name.
    """
    years = spine.filter(F.col(date).isNotNull()).select(F.year(date).alias("year")).distinct()
    years = years.withColumns({"easter": easter_sunday("year"), "orthodox": orthodox_easter("year")})

    def given(column: str, default: int) -> Column:
        return F.coalesce(column, F.lit(default)) if column in rules.columns else F.lit(default)

    holds = (given("first_year", 0) <= F.col("year")) & (given("last_year", 9999) >= F.col("year")) & (F.col("year") % given("every_years", 1) == 0)
    nominal = F.lit(None).cast("date")
    if "month" in rules.columns and "day" in rules.columns:
        nominal = F.make_date("year", "month", "day")
    for offset, sunday in (("easter_offset", "easter"), ("orthodox_offset", "orthodox")):
        if offset in rules.columns:
            nominal = F.when(F.col(offset).isNotNull(), F.date_add(sunday, F.coalesce(offset, F.lit(0)))).otherwise(nominal)
    if "nth" in rules.columns:
        first = F.make_date("year", "month", F.lit(1))
        ahead = F.date_add(first, F.pmod(F.col("weekday_nr") - weekday_nr(first), F.lit(7)) + 7 * (F.col("nth") - 1))
        last = F.last_day(first)
        back = F.date_sub(last, F.pmod(weekday_nr(last) - F.col("weekday_nr"), F.lit(7)) - 7 * (F.col("nth") + 1))
        counted = F.when(F.col("nth") > 0, ahead).otherwise(back)
        counted = F.when(F.month(counted) == F.col("month"), counted)  # not every month has a fifth one
        nominal = F.when(F.col("nth").isNotNull(), counted).otherwise(nominal)
    dates = F.array(nominal)
    if "islamic_month" in rules.columns:
        # A Gregorian year meets two or three Islamic ones, so a day can fall into it twice.
        first = islamic_year(F.make_date("year", F.lit(1), F.lit(1)))
        all_of = F.array(*[islamic_date(first + k, "islamic_month", "islamic_day") for k in range(3)])
        dates = F.when(F.col("islamic_month").isNotNull(), F.filter(all_of, lambda d: F.year(d) == F.col("year"))).otherwise(dates)
    shift = F.when(weekday_nr("nominal") == 7, given("sunday_shift", 0)).otherwise(0)
    named = (
        years.select("*", F.inline(all_rows(rules)))
        .filter(holds)
        .withColumn("nominal", F.explode(dates))
        .filter("nominal is not null")
        .select(F.date_add("nominal", shift).alias(date), "holiday_name")
        .groupBy(date)
        .agg(F.concat_ws("; ", F.array_sort(F.collect_set("holiday_name"))).alias("holiday_name"))
    )
    return named.join(spine.select(date), date, "left_semi")
