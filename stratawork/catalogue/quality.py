"""Data tests on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    Check,
    check_accepted_range,
    check_accepted_values,
    check_expression,
    check_has_data,
    check_not_empty,
    check_not_negative,
    check_not_null,
    check_query,
    check_relationships,
    check_rows_expected,
    check_unique,
    check_unique_combination,
    run_suite,
    store_failures,
    violations,
)
from ..session import new_folder
from .registry import query, read


def _gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with gaps: no user for errors, a blank type for views."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind != "error", F.col("user_id")).alias("user_id"),
        F.when(kind == "view", "").otherwise(kind).alias("event_type"),
        F.col("value").cast("decimal(12,2)").alias("value"),
    )


GAPPY = """
gappy AS (
  SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
         CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS event_type, CAST(value AS DECIMAL(12,2)) AS value
  FROM events
)
"""


@query(f"WITH {GAPPY} SELECT * FROM gappy WHERE user_id IS NULL")
def not_null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(_gappy_events(spark, sf_dir), check_not_null("user_id"))


@query(f"WITH {GAPPY} SELECT * FROM gappy WHERE coalesce(event_type, '') = ''")
def not_empty_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(_gappy_events(spark, sf_dir), check_not_empty("event_type"))


@query("SELECT * FROM customer WHERE c_acctbal < 0")
def not_negative_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(read(spark, sf_dir, "customer"), check_not_negative("c_acctbal"))


@query("SELECT * FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def accepted_values_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(read(spark, sf_dir, "orders"), check_accepted_values("o_orderstatus", ["O", "F"]))


@query("SELECT * FROM part WHERE p_size NOT BETWEEN 5 AND 45")
def accepted_range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(read(spark, sf_dir, "part"), check_accepted_range("p_size", 5, 45))


@query("SELECT * FROM lineitem WHERE NOT (l_discount <= l_tax)")
def expression_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(read(spark, sf_dir, "lineitem"), check_expression("discount", "l_discount <= l_tax"))


@query("""
SELECT o_custkey AS unique_field, CAST(count(*) AS BIGINT) AS n_records FROM orders GROUP BY 1 HAVING count(*) > 1
""")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(read(spark, sf_dir, "orders"), check_unique("o_custkey"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_combination_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(read(spark, sf_dir, "lineitem"), check_unique_combination("l_orderkey", "l_linenumber"))


@query("""
SELECT l_suppkey AS from_field, CAST(count(*) AS BIGINT) AS n_records FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 1
""")
def relationship_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = read(spark, sf_dir, "supplier").filter("s_acctbal >= 0")
    return violations(read(spark, sf_dir, "lineitem"), check_relationships("l_suppkey", parents, "s_suppkey"))


@query("SELECT CAST(1 AS INTEGER) AS validation_error WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
def has_data_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No order has a negative price, so the table of such orders has no data."""
    return violations(read(spark, sf_dir, "orders").filter("o_totalprice < 0"), check_has_data())


@query("SELECT CAST(1 AS INTEGER) AS validation_error WHERE (SELECT count(*) FROM customer) <> 1")
def rows_expected_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(read(spark, sf_dir, "customer"), check_rows_expected(1))


@query("""
SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total FROM orders
GROUP BY 1 HAVING sum(CAST(o_totalprice AS DECIMAL(12,2))) > 3000000
""")
def singular_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any query is a test: customers who ordered for more than a limit."""

    def over_limit(orders: DataFrame) -> DataFrame:
        total = F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("total")
        return orders.groupBy("o_custkey").agg(total).filter("total > 3000000")

    return violations(read(spark, sf_dir, "orders"), check_query("customers__limit", over_limit))


def _suite(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, list[Check]]]:
    customers = read(spark, sf_dir, "customer")
    suppliers = read(spark, sf_dir, "supplier").filter("s_acctbal >= 0")
    return {
        "events": (
            _gappy_events(spark, sf_dir),
            [
                check_has_data(),
                check_unique("event_id"),
                check_not_null("event_id"),
                check_not_null("user_id").warn(),
                check_not_empty("event_type"),
                check_not_negative("value"),
            ],
        ),
        "orders": (
            read(spark, sf_dir, "orders"),
            [
                check_has_data(),
                check_rows_expected(5),
                check_unique("o_orderkey"),
                check_unique("o_custkey").warn(),
                check_accepted_values("o_orderstatus", ["O", "F"]),
                check_relationships("o_custkey", customers, "c_custkey"),
            ],
        ),
        "lineitem": (
            read(spark, sf_dir, "lineitem"),
            [
                check_unique_combination("l_orderkey", "l_linenumber"),
                check_accepted_range("l_discount", 0.0, 0.05).warn(),
                check_expression("discount", "l_discount <= l_tax"),
                check_relationships("l_suppkey", suppliers, "s_suppkey").warn(),
            ],
        ),
    }


SUITE = f"""
WITH {GAPPY},
results(test, severity, failures) AS (
  SELECT 'events__has_data', 'error', count(*) FROM (SELECT 1 WHERE NOT EXISTS (SELECT 1 FROM events))
  UNION ALL SELECT 'events__event_id__unique', 'error', count(*)
    FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'events__event_id__not_null', 'error', count(*) FROM gappy WHERE event_id IS NULL
  UNION ALL SELECT 'events__user_id__not_null', 'warn', count(*) FROM gappy WHERE user_id IS NULL
  UNION ALL SELECT 'events__event_type__not_empty', 'error', count(*) FROM gappy WHERE coalesce(event_type, '') = ''
  UNION ALL SELECT 'events__value__not_negative', 'error', count(*) FROM gappy WHERE value < 0
  UNION ALL SELECT 'orders__has_data', 'error', count(*) FROM (SELECT 1 WHERE NOT EXISTS (SELECT 1 FROM orders))
  UNION ALL SELECT 'orders__rows_expected', 'error', count(*)
    FROM (SELECT 1 WHERE (SELECT count(*) FROM orders) <> 5)
  UNION ALL SELECT 'orders__o_orderkey__unique', 'error', count(*)
    FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'orders__o_custkey__unique', 'warn', count(*)
    FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'orders__o_orderstatus__accepted_values', 'error', count(*)
    FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
  UNION ALL SELECT 'orders__o_custkey__relationships', 'error', count(*)
    FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'lineitem__l_orderkey__l_linenumber__unique', 'error', count(*)
    FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'lineitem__l_discount__accepted_range', 'warn', count(*)
    FROM lineitem WHERE l_discount NOT BETWEEN 0.0 AND 0.05
  UNION ALL SELECT 'lineitem__discount__expression_is_true', 'error', count(*)
    FROM lineitem WHERE NOT (l_discount <= l_tax)
  UNION ALL SELECT 'lineitem__l_suppkey__relationships', 'warn', count(*)
    FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)
)
SELECT test, severity, CAST(failures AS BIGINT) AS failures,
       CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status
FROM results
"""


@query(SUITE)
def quality_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen tests on three tables: name, severity, failures, status."""
    return run_suite(_suite(spark, sf_dir))


@query("SELECT * FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def stored_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The violating rows that a failed suite wrote for one of its tests."""
    root = new_folder(spark, "failures")
    orders = read(spark, sf_dir, "orders")
    checks = [check_not_null("o_orderkey"), check_accepted_values("o_orderstatus", ["O", "F"])]
    store_failures({"orders": (orders, checks)}, root)
    return spark.read.schema(orders.schema).parquet(f"{root}/orders__o_orderstatus__accepted_values")
