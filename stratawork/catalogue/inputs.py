"""Source-shaped inputs that are derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import latest_per_key
from .registry import read


def number_of(props: str = "props") -> Column:
    """The number in an event's JSON properties."""
    return F.get_json_object(props, "$.k").cast("bigint")


def landed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an hourly reading: user = station, tenths as integers, -1 and NULL where the type says so."""
    value = F.col("value").cast("decimal(12,2)")
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("station_code"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        (F.hour("ts") + 1).cast("bigint").alias("hour"),
        F.floor(value * 10).cast("bigint").alias("t"),
        number_of().alias("fh"),
        F.when(kind == "error", -1).when(kind != "signup", number_of()).cast("bigint").alias("rh"),
        F.floor(value).cast("bigint").alias("q"),
        F.when(kind != "view", number_of()).alias("u"),
        F.concat(
            (F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400).cast("string"),
            F.lit(".5731854"),
        ).alias("_load_id"),
    )


LANDED_HOURS = """
landed AS (
  SELECT user_id AS station_code, strftime(ts, '%Y-%m-%d') AS date, hour(ts) + 1 AS hour,
         CAST(floor(CAST(value AS DECIMAL(12,2)) * 10) AS BIGINT) AS t,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS fh,
         CASE WHEN event_type = 'error' THEN -1
              WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS rh,
         CAST(floor(CAST(value AS DECIMAL(12,2))) AS BIGINT) AS q,
         CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS u,
         CAST(CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) * 86400 AS VARCHAR)
           || '.5731854' AS _load_id
  FROM events
),
hours AS (
  SELECT * FROM landed
  QUALIFY row_number() OVER (PARTITION BY station_code, date, hour
    ORDER BY _load_id DESC, t DESC NULLS LAST, fh DESC NULLS LAST, rh DESC NULLS LAST, q DESC NULLS LAST,
             u DESC NULLS LAST) = 1
)
"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed readings, merged on their primary key."""
    return latest_per_key(landed_hours(spark, sf_dir), ["station_code", "date", "hour"], ["_load_id"])


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, one per (order, line number): the test table repeats that key."""
    return latest_per_key(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


MERGED_LINES = """
lines AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
             l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1
)
"""

# The unknown members as SQL rows, for the dimensions.
UNKNOWN = """
unknown(unknown_id, unknown_code, unknown_name, unknown_desc) AS (VALUES
  (-1, '<< emp >>', '<< empty >>', '<< empty record >>'),
  (-2, '<< unk >>', '<< unknown >>', '<< unknown record >>'),
  (-3, '<< n/a >>', '<< not applicable >>', '<< not applicable record>>'))
"""
