"""Facts, flat products, roll-ups and key comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values
from ..functions import date_simple
from ..operators import (
    build_fact,
    calendar_rollup,
    daily_rollup,
    dimension,
    flatten_star,
    join_reference,
    measured_bytes,
    orphan_rows,
    reconcile_keys,
    with_codes,
    with_unknown_members,
)
from ..operators import reconcile_by_digest as digest_differences
from ..plans import calendar_dimension
from ..plans.weather import (
    measurement_fact,
    measurement_type_dimension,
    stage_measurement_types,
    stage_observations,
    station_dimension,
    station_weather,
)
from .dimensions import SUPPLIERS, calendar_of, supplier_dimension
from .inputs import LANDED_HOURS, MERGED_LINES, UNKNOWN, hours
from .registry import query, read
from .staging import CODES, LONG_HOURS, LONG_LINES, long_lines, measure_codes, measured_hours

SUPPLIER, MEASURE = "id_dim__shop__supplier", "id_dim__shop__measure"


def measure_dimension(spark: SparkSession) -> DataFrame:
    return with_unknown_members(
        dimension(measure_codes(spark), MEASURE, "measure_code"),
        fixed_values.unknown_members(spark),
        MEASURE,
        {"measure_code": F.col("unknown_code"), "measure_name": F.col("unknown_name")},
    )


def _star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """Fact and dimensions, and the size of each dimension, measured once for all joins."""
    suppliers, measures = supplier_dimension(spark, sf_dir), measure_dimension(spark)
    sizes = {SUPPLIER: measured_bytes(suppliers), MEASURE: measured_bytes(measures)}
    fact = build_fact(
        long_lines(spark, sf_dir),
        "id_fct__shop__measure",
        ["l_orderkey", "l_linenumber", "measure_code"],
        [(suppliers, {"l_suppkey": "s_suppkey"}, SUPPLIER), (measures, "measure_code", MEASURE)],
        [
            date_simple("l_shipdate").alias("id_dim__common__calendar"),
            F.col("l_shipdate").alias("shipped_at"),
            "measure_value",
        ],
        sizes=sizes,
    )
    return fact, suppliers, measures, sizes


FACT = f"""
{MERGED_LINES}, {CODES}, {LONG_LINES}, {UNKNOWN}, {SUPPLIERS},
measures AS (
  SELECT sha1(measure_code) AS {MEASURE}, measure_code, measure_name FROM codes
  UNION ALL SELECT CAST(unknown_id AS VARCHAR), unknown_code, unknown_name FROM unknown
),
fact AS (
  SELECT md5(l_orderkey || '-' || l_linenumber || '-' || l.measure_code) AS id_fct__shop__measure,
         coalesce({SUPPLIER}, '-2') AS {SUPPLIER}, coalesce({MEASURE}, '-2') AS {MEASURE},
         CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS id_dim__common__calendar, l_shipdate AS shipped_at,
         measure_value
  FROM long l LEFT JOIN suppliers s ON s.s_suppkey = l.l_suppkey
  LEFT JOIN measures m ON m.measure_code = l.measure_code
  WHERE measure_value IS NOT NULL
)
"""


@query(f"WITH {FACT} SELECT * FROM fact")
def fact_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line and measure, with dimension keys; a supplier in debt is unknown."""
    return _star(spark, sf_dir)[0]


@query(f"""
WITH {FACT}
SELECT s_suppkey, s_name, s_acctbal, measure_code, measure_name, shipped_at, id_dim__common__calendar, measure_value
FROM fact JOIN suppliers USING ({SUPPLIER}) JOIN measures USING ({MEASURE})
""")
def flat_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star flattened: one row per measure with supplier and measure attributes."""
    fact, suppliers, measures, sizes = _star(spark, sf_dir)
    flat = flatten_star(
        fact,
        [
            (suppliers, SUPPLIER, ["s_suppkey", "s_name", "s_acctbal"]),
            (measures, MEASURE, ["measure_code", "measure_name"]),
        ],
        sizes=sizes,
    )
    return flat.drop("id_fct__shop__measure")


def _station_star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    unknown = fixed_values.unknown_members(spark)
    stations = read(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").cast("int").alias("station_code"),
        F.col("c_name").alias("station_name"),
        (F.col("c_nationkey") / 10).cast("decimal(6,3)").alias("longitude"),
        (F.col("c_nationkey") / 4).cast("decimal(6,3)").alias("latitude"),
        F.col("c_nationkey").cast("decimal(6,2)").alias("elevation_m"),
    )
    stations = station_dimension(stations, unknown)
    types = measurement_type_dimension(
        stage_measurement_types(fixed_values.measurement_types(spark)), unknown
    )
    sizes = {
        "id_dim__weather__knmi_station": measured_bytes(stations),
        "id_dim__weather__knmi_measurement_type": measured_bytes(types),
    }
    fact = measurement_fact(measured_hours(spark, sf_dir), stations, types, sizes=sizes)
    return fact, stations, types, sizes


TYPES = "types(code, name, unit) AS (VALUES " + ", ".join(
    f"('{code}', '{name}', '{unit}')" for code, name, _, unit, _ in fixed_values.MEASUREMENT_TYPES
) + ")"
STATION_FACT = f"""
{LANDED_HOURS}, {LONG_HOURS}, {TYPES},
stations AS (
  SELECT sha1(CAST(c_custkey AS VARCHAR)) AS station_key, CAST(c_custkey AS INTEGER) AS station_code, c_name AS
         station_name, CAST(c_nationkey / 10.0 AS DECIMAL(6,3)) AS longitude,
         CAST(c_nationkey / 4.0 AS DECIMAL(6,3)) AS latitude
  FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT '-2', -2, '<< unknown >>', NULL, NULL
),
station_fact AS (
  SELECT md5(m.station_code || '-' || m.observed_at || '-' || measurement_type_code) AS
           id_fct__weather__knmi_measurement,
         coalesce(station_key, '-2') AS id_dim__weather__knmi_station,
         sha1(measurement_type_code) AS id_dim__weather__knmi_measurement_type,
         CAST(strftime(observed_at - INTERVAL 1 HOUR, '%Y%m%d') AS INTEGER) AS id_dim__common__calendar,
         CAST(strftime(observed_at - INTERVAL 1 HOUR, '%H%M%S') AS INTEGER) AS id_dim__common__time,
         observed_at, measurement_value, measurement_type_code
  FROM measured m LEFT JOIN stations s USING (station_code)
)
"""


@query(f"WITH {STATION_FACT} SELECT * EXCLUDE (measurement_type_code) FROM station_fact")
def station_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly fact with hashed, calendar and time-of-day keys."""
    return _station_star(spark, sf_dir)[0]


@query(f"""
WITH {STATION_FACT}
SELECT station_code, station_name, latitude, longitude, observed_at, measurement_type_code,
       name AS measurement_type_name, unit, measurement_value
FROM station_fact JOIN stations ON station_key = id_dim__weather__knmi_station JOIN types ON code = measurement_type_code
""")
def station_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly fact flattened into one row per station, hour and measurement type."""
    fact, stations, types, sizes = _station_star(spark, sf_dir)
    return station_weather(fact, stations, types, sizes=sizes)


@query(f"""
WITH {LANDED_HOURS}
SELECT CAST(station_code AS INTEGER) AS station_code, CAST(date AS DATE) AS observation_date,
       CAST(count(*) AS BIGINT) AS observation_count,
       CAST(((2 * CAST(sum(t) AS HUGEINT) * 10000 + count(*)) // (2 * count(*))) / 100000.0 AS DECIMAL(14,5))
         AS temperature_celsius_avg,
       CAST(min(t) / 10.0 AS DECIMAL(10,1)) AS temperature_celsius_min,
       CAST(max(t) / 10.0 AS DECIMAL(10,1)) AS temperature_celsius_max,
       CAST(sum(CASE WHEN rh = -1 THEN 5 ELSE rh * 10 END) / 100.0 AS DECIMAL(20,2)) AS precipitation_mm_sum
FROM hours GROUP BY 1, 2
""")
def station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day per station; hour 24 counts for the day it ends."""
    staged = stage_observations(hours(spark, sf_dir)).withColumns(
        {
            "temperature_celsius": F.col("temperature_celsius").cast("decimal(10,1)"),
            "precipitation_mm": F.col("precipitation_mm").cast("decimal(10,2)"),
        }
    )
    return daily_rollup(
        staged,
        ["station_code"],
        "observed_at",
        [
            F.count("*").alias("observation_count"),
            F.avg("temperature_celsius").alias("temperature_celsius_avg"),
            F.min("temperature_celsius").alias("temperature_celsius_min"),
            F.max("temperature_celsius").alias("temperature_celsius_max"),
            F.sum("precipitation_mm").alias("precipitation_mm_sum"),
        ],
        shift=-1,
        day="observation_date",
    )


@query("""
SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year_nr, CAST(month(o_orderdate) AS INTEGER) AS month_nr,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(32,2)) AS o_totalprice_sum,
       CAST(count(o_orderkey) AS BIGINT) AS o_orderkey_count, max(o_orderstatus) AS o_orderstatus_max
FROM orders GROUP BY 1, 2, 3
""")
def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per priority and month through the calendar dimension."""
    orders = read(spark, sf_dir, "orders")
    days = calendar_of(spark, sf_dir)
    fact = orders.select(
        "o_orderkey",
        "o_orderpriority",
        "o_orderstatus",
        F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"),
        date_simple("o_orderdate").alias("id_dim__common__calendar"),
    )
    return calendar_rollup(
        fact,
        calendar_dimension(days),
        "id_dim__common__calendar",
        ["year_nr", "month_nr"],
        {"o_totalprice": "sum", "o_orderkey": "count", "o_orderstatus": "max"},
        ["o_orderpriority"],
    )


@query("""
SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest orders: a row limit on an ordered query."""
    top = read(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)
    return top.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"))


@query("""
WITH produced AS (SELECT o_custkey AS custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
declared AS (SELECT c_custkey AS custkey FROM customer WHERE c_acctbal >= 0)
SELECT custkey, 'error' AS severity FROM (SELECT * FROM declared EXCEPT SELECT * FROM produced)
UNION ALL
SELECT custkey, 'warn' FROM (SELECT * FROM produced EXCEPT SELECT * FROM declared)
""")
def reconcile_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in good standing against customers with urgent orders."""
    urgent = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    declared = read(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("custkey"))
    return reconcile_keys(urgent.select(F.col("o_custkey").alias("custkey")), declared, ["custkey"])


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)
""")
def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose supplier is not in good standing: rows of a relationship test."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    return orphan_rows(lines, "l_suppkey", read(spark, sf_dir, "supplier").filter("s_acctbal >= 0"), "s_suppkey")


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, s_name
FROM lineitem LEFT JOIN supplier ON CAST(l_suppkey AS DECIMAL(20,1)) = CAST(s_suppkey / 2.0 AS DECIMAL(12,1))
""")
def lines_by_decimal_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines looked up by a key of another type: 1 is 1.0, not 1.5, however large the reference is."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    halves = read(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") / 2).cast("decimal(12,1)").alias("l_suppkey"), "s_name"
    )
    return join_reference(lines, halves, ["l_suppkey"], max_bytes=0)


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
WHERE CAST(l_suppkey AS DECIMAL(20,1)) NOT IN (SELECT CAST(s_suppkey / 2.0 AS DECIMAL(12,1)) FROM supplier)
""")
def orphans_by_decimal_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a parent whose keys are decimals: a fraction is never cut off."""
    halves = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") / 2).cast("decimal(12,1)").alias("half"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return orphan_rows(lines, "l_suppkey", halves, "half")


@query("""
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 1009 = 3 THEN 0 ELSE 1 END AS BIGINT) AS left_rows,
       CAST(CASE WHEN o_orderkey % 1013 = 5 THEN 0 ELSE 1 END AS BIGINT) AS right_rows,
       CASE WHEN o_orderkey % 1009 = 3 THEN 'missing' WHEN o_orderkey % 1013 = 5 THEN 'extra' ELSE 'changed' END AS status
FROM orders
WHERE (o_orderkey % 1009 = 3) <> (o_orderkey % 1013 = 5)
   OR (o_orderkey % 997 = 7 AND NOT (o_orderkey % 1009 = 3 AND o_orderkey % 1013 = 5))
""")
def reconcile_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy that lost some, holds some that the other lost, and has other prices in places."""
    orders = read(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 997 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    left = orders.filter("o_orderkey % 1009 != 3")
    right = orders.filter("o_orderkey % 1013 != 5").withColumn("o_totalprice", price)
    return digest_differences(left, right, ["o_orderkey"], ranges=64)


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, s_name
FROM lineitem LEFT JOIN supplier ON 2 * l_suppkey = s_suppkey
""")
def lines_by_wide_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines looked up by keys that no decimal holds together: 38 digits before the point, and ten behind it."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("decimal(38,0)"), "l_quantity")
    halves = read(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") / 2).cast("decimal(38,10)").alias("l_suppkey"), "s_name"
    )
    paths = [join_reference(lines.filter(f"l_linenumber % 2 = {k}"), halves, ["l_suppkey"], max_bytes=n) for k, n in ((0, 0), (1, 2**26))]
    joined = paths[0].unionByName(paths[1])
    return joined.select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("bigint").alias("l_suppkey"), "l_quantity", "s_name")


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE 2 * l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def orphans_by_wide_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a parent whose keys have digits behind the point that the lines' keys have no room for."""
    halves = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") / 2).cast("decimal(38,10)").alias("half"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("decimal(38,0)"))
    return orphan_rows(lines, "l_suppkey", halves, "half").withColumn("l_suppkey", F.col("l_suppkey").cast("bigint"))


@query("SELECT n_nationkey, p_partkey AS code, p_name AS code_name FROM nation CROSS JOIN part")
def nations_with_many_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with every one of a long list of codes."""
    codes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("code_name"))
    return with_codes(read(spark, sf_dir, "nation").select("n_nationkey"), codes)
