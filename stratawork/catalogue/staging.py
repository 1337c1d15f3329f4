"""Typed projections, expressions, filters and the unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values
from ..functions import (
    blank_to_null,
    date_simple,
    format_duration,
    hash_key,
    hour_ending,
    is_leap_year,
    iso_week,
    iso_year,
    json_text,
    loaded_at,
    parse_json,
    period_end,
    period_start,
    replace_sentinel,
    scaled,
    shift_hours,
    surrogate_key,
    time_from_parts,
    time_simple,
    try_int,
    utc_now,
    utc_today,
    weekday_nr,
    yes_no,
)
from ..operators import code_list, join_reference, typed, unpivot_by_codes, with_codes
from ..plans import calendar, date_spine, end_year, holidays
from ..plans.weather import measurements, stage_measurement_types, stage_observations
from .inputs import LANDED_HOURS, MERGED_LINES, hours, landed_hours, merged_lines, number_of
from .registry import query, read


@query("""
SELECT event_id, CAST(ts AS DATE) AS event_date, ts AS occurred_at, CAST(user_id AS INTEGER) AS user_nr,
       substring(event_type, 1, 5) AS event_code, CAST(value AS DECIMAL(10,2)) AS amount
FROM events
""")
def typed_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with declared names and types; the code is cut to its width."""
    return typed(
        read(spark, sf_dir, "events"),
        [
            ("event_id", "event_id", "bigint"),
            ("ts", "event_date", "date"),
            ("ts", "occurred_at", "timestamp_ntz"),
            ("user_id", "user_nr", "int"),
            ("event_type", "event_code", "varchar(5)"),
            ("value", "amount", "decimal(10,2)"),
        ],
    )


@query(f"""
WITH {LANDED_HOURS}
SELECT CAST(station_code AS INTEGER) AS station_code,
       CAST(CAST(date AS DATE) AS TIMESTAMP) + to_hours(CAST(hour AS INTEGER)) AS observed_at,
       CAST(t / 10.0 AS DECIMAL(17,6)) AS temperature_celsius,
       CAST(fh / 10.0 AS DECIMAL(17,6)) AS wind_speed_ms,
       CAST(CASE WHEN rh = -1 THEN 0.05 ELSE rh / 10.0 END AS DECIMAL(17,6)) AS precipitation_mm,
       CAST(q AS INTEGER) AS global_radiation_jcm2, CAST(u AS INTEGER) AS relative_humidity_pct, _load_id
FROM landed
""")
def staged_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings typed: hour-ending timestamps, tenths to units, the rainfall sentinel."""
    return stage_observations(landed_hours(spark, sf_dir))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
       CAST(CASE WHEN l_discount = 0 THEN 0.05 ELSE CAST(l_discount AS DECIMAL(10,2)) / 10 END AS DECIMAL(12,4))
         AS discount_tenth,
       CAST(CAST(l_quantity AS INTEGER) / 10.0 AS DECIMAL(17,6)) AS quantity_tens
FROM lineitem
""")
def sentinel_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentinel replaced and a unit factor applied, in decimals."""
    tenth = (F.col("l_discount").cast("decimal(10,2)") / 10).cast("decimal(12,4)")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        replace_sentinel("l_discount", 0.0, 0.05, tenth).cast("decimal(12,4)").alias("discount_tenth"),
        scaled("l_quantity", "10.0").alias("quantity_tens"),
    )


@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT o_orderkey,
       CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_simple,
       CAST(year(date) AS INTEGER) AS year_nr, CAST(quarter(date) AS INTEGER) AS quarter_nr,
       CAST(month(date) AS INTEGER) AS month_nr, CAST(dayofyear(date) AS INTEGER) AS day_of_year_nr,
       CAST(isodow(date) AS INTEGER) AS weekday_nr, CAST(weekofyear(date) AS INTEGER) AS iso_week,
       CAST(isoyear(date) AS INTEGER) AS iso_year,
       CAST(date_trunc('year', date) AS DATE) AS year_start, CAST(date_trunc('quarter', date) AS DATE) AS quarter_start,
       CAST(date_trunc('month', date) AS DATE) AS month_start, CAST(date_trunc('week', date) AS DATE) AS week_start,
       CAST(date_trunc('year', date) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS year_end,
       CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
       last_day(date) AS month_end, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week_end,
       CASE WHEN dayofyear(make_date(year(date), 12, 31)) = 366 THEN 'Y' ELSE 'N' END AS is_leap_year
FROM d
""")
def scalar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date parts, keys, ISO weeks and period bounds of the order dates."""
    dates = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    units = ("year", "quarter", "month", "week")
    return dates.select(
        "o_orderkey",
        date_simple("date").alias("date_simple"),
        F.year("date").alias("year_nr"),
        F.quarter("date").alias("quarter_nr"),
        F.month("date").alias("month_nr"),
        F.dayofyear("date").alias("day_of_year_nr"),
        weekday_nr("date").alias("weekday_nr"),
        iso_week("date").alias("iso_week"),
        iso_year("date").alias("iso_year"),
        *[period_start("date", unit).alias(f"{unit}_start") for unit in units],
        *[period_end("date", unit).alias(f"{unit}_end") for unit in units],
        yes_no(is_leap_year(F.year("date"))).alias("is_leap_year"),
    )


@query("""
SELECT event_id, CAST(strftime(ts, '%H%M%S') AS INTEGER) AS time_simple,
       CAST(hour(ts) AS INTEGER) AS hour_nr, CAST(minute(ts) AS INTEGER) AS minute_nr,
       CAST(second(ts) AS INTEGER) AS second_nr, strftime(ts, '%H:%M:%S') AS time_text,
       ts - INTERVAL 1 HOUR AS hour_before,
       date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end,
       CASE WHEN value IS NULL THEN NULL ELSE
         (CASE WHEN floor(value * 1000 / 3600) < 10 THEN '0' ELSE '' END)
           || CAST(CAST(floor(value * 1000 / 3600) AS BIGINT) AS VARCHAR)
           || ':' || lpad(CAST(CAST(floor(floor(value * 1000) / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0')
           || ':' || lpad(CAST(CAST(floor(value * 1000) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS duration
FROM events
""")
def scalar_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time parts, time keys, hour shifts and durations; hours of a duration grow past 99."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        time_simple("ts").alias("time_simple"),
        F.hour("ts").alias("hour_nr"),
        F.minute("ts").alias("minute_nr"),
        F.second("ts").alias("second_nr"),
        time_from_parts(F.hour("ts"), F.minute("ts"), F.second("ts")).alias("time_text"),
        shift_hours("ts", -1).alias("hour_before"),
        hour_ending(F.col("ts").cast("date"), F.hour("ts") + 1).alias("hour_end"),
        format_duration(F.col("value") * 1000).alias("duration"),
    )


@query("""
SELECT c_custkey, sha1(CAST(c_custkey AS VARCHAR)) AS customer_key,
       md5(CAST(c_custkey AS VARCHAR) || '-' || coalesce(nullif(c_mktsegment, 'BUILDING'),
         '_dbt_utils_surrogate_key_null_') || '-' || CAST(c_nationkey AS VARCHAR)) AS segment_key
FROM customer
""")
def scalar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed keys; a NULL part has a token of its own."""
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        hash_key("c_custkey").alias("customer_key"),
        surrogate_key("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")), "c_nationkey").alias("segment_key"),
    )


@query("""
SELECT event_id,
       TRY_CAST(CASE WHEN event_type = 'click' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS INTEGER) AS k,
       nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS kind,
       json_valid(CASE WHEN event_type = 'error' THEN '{' ELSE props END) AS is_json,
       TIMESTAMP '1970-01-01' + to_microseconds(CAST(epoch_us(ts) AS BIGINT)) AS loaded_at,
       '{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","kind":'
         || CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || event_type || '"' END || '}' AS as_json,
       TRUE AS clock_runs
FROM events
""")
def scalar_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient casts, blanks, JSON both ways, load ids as moments, the clock."""
    events = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    load_id = (micros.cast("decimal(20,0)") / 1000000).cast("decimal(26,7)").cast("string")
    label = blank_to_null(F.when(kind == "view", "").otherwise(kind))
    return events.select(
        "event_id",
        try_int(F.when(kind == "click", "n/a").otherwise(number_of().cast("string"))).alias("k"),
        label.alias("kind"),
        parse_json(F.when(kind == "error", "{").otherwise(F.col("props"))).isNotNull().alias("is_json"),
        loaded_at(load_id).alias("loaded_at"),
        json_text(F.struct(F.col("ts").alias("at"), label.alias("kind"))).alias("as_json"),
        ((utc_now() > F.col("ts")) & (utc_today() > F.col("ts").cast("date"))).alias("clock_runs"),
    )


@query("""
SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1997-01-01'
  AND o_orderdate < TIMESTAMP '1999-01-01' AND o_totalprice IS NOT NULL
""")
def filtered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that reach the Parquet scan: a list, an equality, a range, not null."""
    orders = read(spark, sf_dir, "orders").filter(
        F.col("o_orderstatus").isin("O", "P")
        & (F.col("o_orderpriority") == "1-URGENT")
        & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
        & F.col("o_totalprice").isNotNull()
    )
    return orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("o_orderdate")
    )


@query("""
SELECT event_id, user_id, ts, CAST(year(ts) AS INTEGER) AS year_nr, CAST(weekofyear(ts) AS INTEGER) AS iso_week_nr,
       CASE WHEN isodow(ts) >= 6 THEN 'Y' ELSE 'N' END AS is_weekend
FROM events WHERE value > 25
""")
def warm_hours_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High values first filtered, then enriched with calendar attributes."""
    events = read(spark, sf_dir, "events")
    spine = date_spine(spark, 2000, end_year([(events, "ts")]))  # a fixed start
    days = calendar(
        spine,
        fixed_values.months(spark),
        fixed_values.weekdays(spark),
        holidays(spine, fixed_values.nl_holidays(spark)),
    ).select("date", "year_nr", "iso_week_nr", "is_weekend")
    warm = events.filter("value > 25").select("event_id", "user_id", "ts", F.col("ts").cast("date").alias("date"))
    return join_reference(warm, days, ["date"]).drop("date")


MEASURE_COLUMNS = {"QTY": "l_quantity", "PRICE": "l_extendedprice", "DISC": "l_discount", "TAX": "l_tax"}
# The code table has a code without a column.
MEASURE_CODES = [("QTY", "Quantity"), ("PRICE", "Extended price"), ("DISC", "Discount"), ("TAX", "Tax"), ("NET", "Net")]
CODES = "codes(measure_code, measure_name) AS (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in MEASURE_CODES) + ")"

LONG_LINES = """
long AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, measure_code,
         CAST(CASE measure_code WHEN 'QTY' THEN l_quantity WHEN 'PRICE' THEN l_extendedprice
              WHEN 'DISC' THEN nullif(l_discount, 0) WHEN 'TAX' THEN nullif(l_tax, 0) END AS DECIMAL(10,2))
           AS measure_value
  FROM lines CROSS JOIN codes
)
"""


def measure_codes(spark: SparkSession) -> DataFrame:
    return fixed_values.code_table(spark, MEASURE_CODES, "measure_code string, measure_name string")


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as one row per measure; a zero discount or tax counts as missing."""
    lines = merged_lines(spark, sf_dir)
    for column in ("l_discount", "l_tax"):
        lines = lines.withColumn(column, F.nullif(column, F.lit(0.0)))
    return unpivot_by_codes(
        lines,
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"],
        MEASURE_COLUMNS,
        code_list(measure_codes(spark), "measure_code", MEASURE_COLUMNS),
        "measure_code",
        "measure_value",
    )


@query(f"WITH {MERGED_LINES}, {CODES}, {LONG_LINES} SELECT * FROM long WHERE measure_value IS NOT NULL")
def unpivot_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four measures of every line as long rows, in one scan."""
    return long_lines(spark, sf_dir)


LONG_HOURS = """
staged AS (
  SELECT CAST(station_code AS INTEGER) AS station_code,
         CAST(CAST(date AS DATE) AS TIMESTAMP) + to_hours(CAST(hour AS INTEGER)) AS observed_at,
         t / 10.0 AS "T", fh / 10.0 AS "FH", CASE WHEN rh = -1 THEN 0.05 ELSE rh / 10.0 END AS "RH",
         CAST(q AS DOUBLE) AS "Q", CAST(u AS DOUBLE) AS "U"
  FROM hours
),
measured AS (
  SELECT station_code, observed_at, code AS measurement_type_code, CAST(v AS DECIMAL(10,2)) AS measurement_value
  FROM (SELECT station_code, observed_at, unnest(['T','FH','RH','Q','U']) AS code, unnest(["T","FH","RH","Q","U"]) AS v
        FROM staged) WHERE v IS NOT NULL
)
"""


def measured_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = stage_measurement_types(fixed_values.measurement_types(spark))
    return measurements(stage_observations(hours(spark, sf_dir)), types)


@query(f"WITH {LANDED_HOURS}, {LONG_HOURS} SELECT * FROM measured")
def hourly_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings as one row per station, hour and measurement type."""
    return measured_hours(spark, sf_dir)


@query(f"WITH {CODES} SELECT s_suppkey, measure_code, measure_name FROM supplier CROSS JOIN codes")
def suppliers_with_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier with every measure code."""
    return with_codes(read(spark, sf_dir, "supplier").select("s_suppkey"), measure_codes(spark))
