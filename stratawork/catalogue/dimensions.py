"""Generated dimensions over the tables' dates, dense sequences and unknown members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values
from ..functions import time_simple
from ..operators import dense_sequence, dimension, join_reference, typed, with_unknown_members
from ..plans import calendar as full_calendar
from ..plans import (
    calendar_dimension,
    date_spine,
    end_year,
    holidays,
    time_dimension,
    time_of_day,
    with_sentinels,
)
from .inputs import UNKNOWN
from .registry import query, read


#: The calendars start in a fixed year, so an older row renumbers nothing.
START_YEAR = 1990


def order_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days up to ten years from now, or up to the year of the last order if that is later."""
    return date_spine(spark, START_YEAR, end_year([(read(spark, sf_dir, "orders"), "o_orderdate")]))


def calendar_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar that all facts share."""
    spine = order_spine(spark, sf_dir)
    named = holidays(spine, fixed_values.nl_holidays(spark))
    return full_calendar(spine, fixed_values.months(spark), fixed_values.weekdays(spark), named)


SPINE = f"""
spine AS (
  SELECT CAST(d AS DATE) AS date FROM
    (SELECT DATE '{START_YEAR}-01-01' AS a,
            make_date(greatest(year(current_date) + 10, max(year(o_orderdate)) FILTER (CAST(o_orderdate AS DATE) <> DATE '9999-12-31')),
                      12, 31) AS b FROM orders),
    generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY) AS g(d)
),
dated AS (
  SELECT date, CAST(date AS TIMESTAMP) AS date_time FROM spine
  UNION ALL SELECT DATE '1900-01-01', TIMESTAMP '1900-01-01 00:00:00'
  UNION ALL SELECT DATE '9999-12-31', TIMESTAMP '9999-12-31 23:59:59'
)
"""

# Easter from the golden number and the century corrections, then the rules year by year.
HOLIDAYS = """
years AS (SELECT DISTINCT CAST(year(date) AS INTEGER) AS y FROM spine),
moon AS (
  SELECT y, (19 * (y % 19) + y // 100 - (y // 100) // 4 - (y // 100 - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30 AS h
  FROM years
),
sunday AS (
  SELECT y, h, (32 + 2 * ((y // 100) % 4) + 2 * ((y % 100) // 4) - h - (y % 100) % 4) % 7 AS l FROM moon
),
easter AS (
  SELECT y, make_date(y, 3, 1) + CAST(21 + h + l - 7 * ((y % 19 + 11 * h + 22 * l) // 451) AS INTEGER) AS e FROM sunday
),
named AS (
  SELECT make_date(y, 1, 1) AS date, 'Nieuwjaarsdag' AS n FROM years
  UNION ALL SELECT e, 'Eerste paasdag' FROM easter
  UNION ALL SELECT e + 1, 'Tweede paasdag' FROM easter
  UNION ALL SELECT e + 39, 'Hemelvaartsdag' FROM easter
  UNION ALL SELECT e + 49, 'Eerste Pinksterdag' FROM easter
  UNION ALL SELECT e + 50, 'Tweede Pinksterdag' FROM easter
  UNION ALL SELECT make_date(y, 12, 25), 'Eerste Kerstdag' FROM years
  UNION ALL SELECT make_date(y, 12, 26), 'Tweede Kerstdag' FROM years
  UNION ALL SELECT make_date(y, 5, 5), 'Bevrijdingsdag' FROM years WHERE y >= 1990 AND y % 5 = 0
  UNION ALL SELECT CASE WHEN isodow(make_date(y, 4, 30)) = 7 THEN make_date(y, 4, 29) ELSE make_date(y, 4, 30) END,
                   'Koninginnedag' FROM years WHERE y BETWEEN 1980 AND 2013
  UNION ALL SELECT CASE WHEN isodow(make_date(y, 4, 27)) = 7 THEN make_date(y, 4, 26) ELSE make_date(y, 4, 27) END,
                   'Koningsdag' FROM years WHERE y >= 2014
),
holiday AS (SELECT date, string_agg(DISTINCT n, '; ' ORDER BY n) AS holiday_name FROM named GROUP BY date)
"""

PARTS = """
parts AS (
  SELECT date, date_time, nullif(date, DATE '9999-12-31') AS k, CAST(year(date) AS INTEGER) AS y,
         CAST(quarter(date) AS INTEGER) AS q, CAST(month(date) AS INTEGER) AS m, CAST(day(date) AS INTEGER) AS d,
         CAST(weekofyear(date) AS INTEGER) AS w, CAST(isoyear(date) AS INTEGER) AS iy,
         CAST(dayofyear(date) AS INTEGER) AS yd, CAST(isodow(date) AS INTEGER) AS wd,
         date IN (DATE '1900-01-01', DATE '9999-12-31') AS ends
  FROM dated
)
"""

CALENDAR_COLUMNS = """
  p.date, date_time, y * 10000 + m * 100 + d AS date_simple, y AS year_nr,
  CAST(y - CASE WHEN m < 4 THEN 1 ELSE 0 END AS INTEGER) AS base_year, q AS quarter_nr, m AS month_nr, w AS week_nr,
  iy AS iso_year_nr, w AS iso_week_nr,
  y * 10000 + q * 100 + m AS year_quarter_month_nr, y * 100 + q AS year_quarter_nr, y * 100 + m AS year_month_nr,
  y * 100 + w AS year_week_nr, iy * 100 + w AS iso_year_week_nr,
  yd AS day_of_year_nr, d AS day_of_month_nr, wd AS day_of_week_nr,
  CAST(row_number() OVER (PARTITION BY iy ORDER BY p.date) AS INTEGER) AS iso_year_day_nr,
  format('Y{}', y) AS year_code, format('Year {}', y) AS year_name,
  format('Q{}', q) AS quarter_code, format('Quarter {}', q) AS quarter_name,
  format('M{:02d}', m) AS month_code, strftime(p.date, '%B') AS month_name, strftime(p.date, '%b') AS month_abbr,
  format('W{:02d}', w) AS week_code, format('Week {}', w) AS week_desc,
  format('Y{}', iy) AS iso_year_code, format('ISO Year {}', iy) AS iso_year_desc,
  format('W{:02d}', w) AS iso_week_code, format('ISO Week {}', w) AS iso_week_desc,
  format('YD{:03d}', yd) AS year_day_code, format('MD{:02d}', d) AS month_day_code,
  format('WD{:02d}', wd) AS week_day_code,
  strftime(p.date, '%A') AS week_day_name, strftime(p.date, '%a') AS week_day_abbr,
  CASE WHEN yd = 1 AND k IS NOT NULL THEN 'Y' ELSE 'N' END AS is_first_day_of_year,
  CASE WHEN d = 1 AND m % 3 = 1 THEN 'Y' ELSE 'N' END AS is_first_day_of_quarter,
  CASE WHEN d = 1 THEN 'Y' ELSE 'N' END AS is_first_day_of_month,
  CASE WHEN wd = 1 THEN 'Y' ELSE 'N' END AS is_first_day_of_week,
  CASE WHEN k IS NOT NULL AND m = 12 AND d = 31 THEN 'Y' ELSE 'N' END AS is_last_day_of_year,
  CASE WHEN k = last_day(k) AND m % 3 = 0 THEN 'Y' ELSE 'N' END AS is_last_day_of_quarter,
  CASE WHEN k = last_day(k) THEN 'Y' ELSE 'N' END AS is_last_day_of_month,
  CASE WHEN wd = 7 THEN 'Y' ELSE 'N' END AS is_last_day_of_week,
  CASE WHEN last_day(make_date(y, 2, 1)) = make_date(y, 2, 28) THEN 'N' ELSE 'Y' END AS is_leap_year,
  CASE WHEN m = 2 AND d = 29 THEN 'Y' ELSE 'N' END AS is_leap_day,
  CASE WHEN wd > 5 THEN 'Y' ELSE 'N' END AS is_weekend, CASE WHEN wd > 5 THEN 'N' ELSE 'Y' END AS is_workday,
  CAST(date_trunc('year', k) AS DATE) AS first_date_of_year,
  CAST(date_trunc('quarter', k) AS DATE) AS first_date_of_quarter,
  CAST(date_trunc('month', k) AS DATE) AS first_date_of_month,
  CAST(date_trunc('week', k) AS DATE) AS first_date_of_week,
  CASE WHEN k IS NOT NULL THEN make_date(y, 12, 31) END AS last_date_of_year,
  CASE WHEN k IS NOT NULL THEN last_day(make_date(y, q * 3, 1)) END AS last_date_of_quarter,
  last_day(k) AS last_date_of_month, CAST(date_trunc('week', k) AS DATE) + 6 AS last_date_of_week,
  CAST(CASE WHEN NOT ends THEN dense_rank() OVER (ORDER BY iy) - 1 END AS INTEGER) AS iso_year_sort,
  CAST(CASE WHEN NOT ends THEN dense_rank() OVER (ORDER BY y) - 1 END AS INTEGER) AS year_sort,
  CAST(CASE WHEN NOT ends THEN dense_rank() OVER (ORDER BY y, q) - 1 END AS INTEGER) AS quarter_sort,
  CAST(CASE WHEN NOT ends THEN dense_rank() OVER (ORDER BY y, m) - 1 END AS INTEGER) AS month_sort,
  CAST(CASE WHEN NOT ends THEN dense_rank() OVER (ORDER BY p.date) - 1 END AS INTEGER) AS day_sort,
  CAST(CASE WHEN NOT ends THEN dense_rank() OVER (ORDER BY iy, w) - 1 END AS INTEGER) AS week_sort,
  h.holiday_name IS NOT NULL AS is_holiday, h.holiday_name,
  m BETWEEN 5 AND 8 AND wd > 5 AS is_high_generation_day,
  m IN (12, 1, 2, 3) AND wd <= 5 AS is_high_consumption_day
"""


def _orders_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("orders"))


PER_DAY = "per_day AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders FROM orders GROUP BY 1)"


@query(f"""
WITH {SPINE}, {PER_DAY}
SELECT CAST(CASE WHEN s.date = DATE '9999-12-31' THEN 99999999 ELSE s.date - DATE '1900-01-01' END AS INTEGER) AS day,
       s.date, s.date_time, CAST(coalesce(orders, 0) AS BIGINT) AS orders
FROM dated s LEFT JOIN per_day o ON o.date = s.date
""")
def date_spine_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the shared calendar plus the sentinels, with its number of orders."""
    spine = with_sentinels(order_spine(spark, sf_dir))
    return spine.join(_orders_per_day(spark, sf_dir), "date", "left").na.fill(0, ["orders"])


@query(f"""
WITH {SPINE}, {HOLIDAYS}, {PARTS}, {PER_DAY}
SELECT {CALENDAR_COLUMNS}, CAST(coalesce(orders, 0) AS BIGINT) AS orders
FROM parts p LEFT JOIN holiday h ON h.date = p.date LEFT JOIN per_day o ON o.date = p.date
""")
def calendar_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full calendar of the shared calendar, with the number of orders per day."""
    days = calendar_of(spark, sf_dir)
    return days.join(_orders_per_day(spark, sf_dir), "date", "left").na.fill(0, ["orders"])


@query(f"""
WITH {SPINE}, {HOLIDAYS}, {PARTS}, {PER_DAY}, c AS (
  SELECT {CALENDAR_COLUMNS} FROM parts p LEFT JOIN holiday h ON h.date = p.date)
SELECT date_simple AS id_dim__common__calendar, c.date, date_time, date_simple, year_nr, base_year, quarter_nr,
       month_nr, month_name, week_nr, iso_year_nr, iso_week_nr, is_holiday, holiday_name, is_high_generation_day,
       is_high_consumption_day, CAST(orders AS BIGINT) AS orders
FROM c JOIN per_day o ON o.date = c.date
""")
def calendar_dimension_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar dimension on the days that have orders."""
    days = calendar_dimension(calendar_of(spark, sf_dir))
    return days.join(_orders_per_day(spark, sf_dir), "date")


@query(f"""
WITH {SPINE}, {HOLIDAYS}, {PER_DAY}
SELECT h.date, holiday_name, CAST(coalesce(orders, 0) AS BIGINT) AS orders
FROM holiday h JOIN spine s ON s.date = h.date LEFT JOIN per_day o ON o.date = h.date
""")
def holiday_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays of the shared calendar from the rules, with the orders placed on them."""
    spine = order_spine(spark, sf_dir)
    named = holidays(spine, fixed_values.nl_holidays(spark))
    return named.join(_orders_per_day(spark, sf_dir), "date", "left").na.fill(0, ["orders"])


#: Rules by the Julian Easter and by the tabular Islamic calendar: name, days after Easter, month, day.
OTHER_CALENDARS = [
    ("Orthodox Easter Monday", 1, None, None), ("Orthodox Whit Monday", 50, None, None), ("Islamic New Year", None, 1, 1),
    ("End of Ramadan", None, 10, 1), ("Feast of Sacrifice", None, 12, 10),
]


@query(f"""
WITH {SPINE}, years AS (SELECT DISTINCT CAST(year(date) AS INTEGER) AS y FROM spine), moon AS (
  SELECT y, (19 * (y % 19) + 15) % 30 AS d FROM years
), orthodox AS (
  SELECT make_date(y, 3, 21) + CAST(d + (2 * (y % 4) + 4 * (y % 7) - d + 34) % 7 + 1 + y // 100 - y // 400 - 2 AS INTEGER) AS e FROM moon
), lunar(n, m, d) AS (VALUES ('Islamic New Year', 1, 1), ('End of Ramadan', 10, 1), ('Feast of Sacrifice', 12, 10)), named AS (
  SELECT e + 1 AS date, 'Orthodox Easter Monday' AS n FROM orthodox UNION ALL SELECT e + 50, 'Orthodox Whit Monday' FROM orthodox
  UNION ALL
  SELECT DATE '1970-01-01' + CAST(354 * (h - 1) + (11 * h + 3) // 30 + 29 * (m - 1) + m // 2 + d - 1 - 492148 AS INTEGER), n
  FROM lunar, range(1, 3000) AS r(h)
)
SELECT date, string_agg(DISTINCT n, '; ' ORDER BY n) AS holiday_name FROM named SEMI JOIN spine USING (date) GROUP BY date
""")
def holiday_other_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays of the orders' years that follow the Julian Easter or the Islamic calendar."""
    rules = spark.createDataFrame(OTHER_CALENDARS, "holiday_name string, orthodox_offset int, islamic_month int, islamic_day int")
    return holidays(order_spine(spark, sf_dir), rules)


@query(f"""
WITH {SPINE}, {HOLIDAYS}
SELECT o_orderkey, strftime(o_orderdate, '%B') AS month_name, strftime(o_orderdate, '%A') AS weekday_name, holiday_name
FROM orders LEFT JOIN holiday h ON h.date = CAST(o_orderdate AS DATE)
""")
def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with month, weekday and holiday labels from three reference tables."""
    days = calendar_of(spark, sf_dir)
    labels = days.select("date", "month_name", F.col("week_day_name").alias("weekday_name"), "holiday_name")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return join_reference(orders, labels, ["date"]).drop("date")


@query("""
WITH t AS (
  SELECT event_id, CAST(strftime(ts, '%H%M%S') AS INTEGER) AS id_dim__common__time, CAST(hour(ts) AS INTEGER) AS h,
         CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s FROM events
)
SELECT event_id, id_dim__common__time, id_dim__common__time AS time_simple,
       format('{:02d}:{:02d}:{:02d}', h, mi, s) AS time, format('{:02d}:00:00', h) AS time_hour,
       format('{:02d}:{:02d}:00', h, mi) AS time_minute, format('{:02d}:{:02d}:{:02d}', h, mi, s) AS time_second,
       h AS hour_nr, format('H{:02d}', h) AS hour_code, format('Hour {:02d}', h) AS hour_name, h + 1 AS hour_sort,
       mi AS minute_nr, format('M{:02d}', mi) AS minute_code, format('Minute {:02d}', mi) AS minute_name,
       mi + 1 AS minute_sort,
       s AS second_nr, format('S{:02d}', s) AS second_code, format('Second {:02d}', s) AS second_name,
       s + 1 AS second_sort,
       CASE WHEN h < 5 OR h > 20 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 17 THEN 'afternoon' ELSE 'evening' END
         AS day_part,
       CAST(CASE WHEN h < 5 OR h > 20 THEN 4 WHEN h < 12 THEN 1 WHEN h < 17 THEN 2 ELSE 3 END AS INTEGER)
         AS day_part_sort,
       CASE WHEN h < 5 OR h > 20 THEN 'night' WHEN h < 9 THEN 'morning (early)' WHEN h < 11 THEN 'morning'
            WHEN h < 12 THEN 'morning (late)' WHEN h < 16 THEN 'afternoon (early)' WHEN h < 17 THEN 'afternoon (late)'
            WHEN h < 19 THEN 'evening (early)' ELSE 'evening' END AS day_part_alt,
       CAST(CASE WHEN h < 5 OR h > 20 THEN 8 WHEN h < 9 THEN 1 WHEN h < 11 THEN 2 WHEN h < 12 THEN 3 WHEN h < 16 THEN 4
            WHEN h < 17 THEN 5 WHEN h < 19 THEN 6 ELSE 7 END AS INTEGER) AS day_part_alt_sort
FROM t
""")
def time_of_day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time-of-day dimension: hour, minute, second and part of the day."""
    events = read(spark, sf_dir, "events").select("event_id", time_simple("ts").alias("id_dim__common__time"))
    return events.join(F.broadcast(time_dimension(time_of_day(spark))), "id_dim__common__time")  # 86 400 rows


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority,
       CAST(dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderpriority) AS BIGINT) AS sequence_nr
FROM orders
""")
def dense_sequence_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered densely by date and priority, without one task that sorts everything."""
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority"
    )
    return dense_sequence(orders, ["o_orderdate", "o_orderpriority"])


def supplier_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that are not in debt, plus the unknown members."""
    key = "id_dim__shop__supplier"
    active = typed(
        read(spark, sf_dir, "supplier").filter("s_acctbal >= 0"),
        [
            ("s_suppkey", "s_suppkey", "bigint"),
            ("s_name", "s_name", "varchar(50)"),
            ("s_nationkey", "s_nationkey", "int"),
            ("s_acctbal", "s_acctbal", "decimal(12,2)"),
        ],
    )
    return with_unknown_members(
        dimension(active, key, "s_suppkey"),
        fixed_values.unknown_members(spark),
        key,
        {"s_suppkey": F.col("unknown_id"), "s_name": F.col("unknown_name")},
    )


SUPPLIERS = """
suppliers AS (
  SELECT sha1(CAST(s_suppkey AS VARCHAR)) AS id_dim__shop__supplier, s_suppkey, s_name, s_nationkey,
         CAST(s_acctbal AS DECIMAL(12,2)) AS s_acctbal
  FROM supplier WHERE s_acctbal >= 0
  UNION ALL SELECT CAST(unknown_id AS VARCHAR), unknown_id, unknown_name, NULL, NULL FROM unknown
)
"""


@query(f"WITH {UNKNOWN}, {SUPPLIERS} SELECT * FROM suppliers")
def dim_supplier_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier dimension; coordinates of an unknown member would be NULL, here nation and balance are."""
    return supplier_dimension(spark, sf_dir)


@query(f"""
WITH {UNKNOWN}
SELECT sha1(p_brand) AS id_dim__shop__brand, p_brand AS brand_code, CAST(count(*) AS INTEGER) AS brand_sort,
       'parts' AS unit, 'Brand ' || p_brand AS brand_desc
FROM part GROUP BY p_brand
UNION ALL SELECT CAST(unknown_id AS VARCHAR), substring(unknown_code, 1, 10), -1, '', unknown_desc FROM unknown
""")
def dim_brand_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as a dimension whose unknown members have a blank unit and sort before the rest."""
    key = "id_dim__shop__brand"
    brands = (
        read(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("brand_code"))
        .agg(F.count("*").cast("int").alias("brand_sort"))
        .select(
            "brand_code",
            "brand_sort",
            F.lit("parts").alias("unit"),
            F.concat(F.lit("Brand "), "brand_code").alias("brand_desc"),
        )
    )
    return with_unknown_members(
        dimension(brands, key, "brand_code"),
        fixed_values.unknown_members(spark),
        key,
        {
            "brand_code": F.substring("unknown_code", 1, 10),
            "brand_sort": F.lit(-1),
            "unit": F.lit(""),
            "brand_desc": F.col("unknown_desc"),
        },
    )


@query("SELECT DISTINCT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def trading_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distinct union: nations that buy or sell."""
    buyers = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    sellers = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return buyers.union(sellers).distinct()


@query(f"""
WITH dated AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN DATE '1900-01-01' WHEN o_orderkey % 11 = 0 THEN DATE '9999-12-31'
                          ELSE CAST(o_orderdate AS DATE) END AS date
  FROM orders
)
SELECT o_orderkey, date, CAST(year(date) AS INTEGER) AS year_nr,
       CASE WHEN date NOT IN (DATE '1900-01-01', DATE '9999-12-31')
            THEN CAST(date - DATE '{START_YEAR}-01-01' + 1 AS INTEGER) END AS day_sort
FROM dated
""")
def sentinel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which some carry a date that means 'no date': each meets the calendar once."""
    key = F.col("o_orderkey")
    date = F.when(key % 7 == 0, F.lit("1900-01-01")).when(key % 11 == 0, F.lit("9999-12-31"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(date.cast("date"), F.col("o_orderdate").cast("date")).alias("date"))
    return join_reference(orders, calendar_of(spark, sf_dir).select("date", "year_nr", "day_sort"), ["date"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, value, CAST(dense_rank() OVER (ORDER BY value NULLS FIRST) AS BIGINT) AS sequence_nr
FROM (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0.05) + 0.0 AS value FROM lineitem)
""")
def dense_sequence_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered by a fraction that is NULL or a negative zero for some: rows meet their number by value."""
    discount = F.nullif("l_discount", F.lit(0.05))
    negative = F.when((discount == 0) & (F.col("l_partkey") % 2 == 0), F.lit(-0.0)).otherwise(discount)
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", negative.alias("value"))
    return dense_sequence(lines, ["value"]).withColumn("value", F.col("value") + 0.0)
