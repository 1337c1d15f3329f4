from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratawork.operators import (
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
    orphan_rows,
    require_passed,
    run_suite,
    store_failures,
    violations,
)


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [(1, "a", 5, 10), (2, "", -1, 10), (2, None, None, 11), (None, "d", 7, None), (None, "d", 7, 99)],
        "id int, name string, v int, parent int",
    )


@pytest.fixture
def parent(spark):
    return spark.createDataFrame([(10,), (11,), (None,)], "key int")


def test_row_checks(table):
    assert violations(table, check_not_null("id")).count() == 2
    assert violations(table, check_not_empty("name")).count() == 2
    assert violations(table, check_not_negative("v")).count() == 1
    # NULL passes every test that is about a value.
    assert violations(table, check_accepted_values("name", ["a", ""])).count() == 2
    assert violations(table, check_accepted_range("v", 0, 6)).count() == 3
    assert violations(table, check_expression("v_below_six", "v < 6")).count() == 2


def test_group_checks(table, parent):
    assert [tuple(r) for r in violations(table, check_unique("id")).collect()] == [(2, 2)]
    assert violations(table, check_unique_combination("id", "name")).collect()[0].asDict() == {"id": None, "name": "d"}
    orphans = violations(table, check_relationships("parent", parent, "key"))
    assert [tuple(r) for r in orphans.collect()] == [(99, 1)]


@pytest.mark.parametrize("max_bytes", [0, 1 << 26])
def test_orphan_rows_keep_the_whole_row(table, parent, max_bytes):
    rows = orphan_rows(table, "parent", parent, "key", max_bytes=max_bytes).collect()
    assert [r.parent for r in rows] == [99]
    assert set(rows[0].asDict()) == set(table.columns)


def test_table_checks(table):
    assert violations(table, check_has_data()).count() == 0
    assert violations(table.limit(0), check_has_data()).collect()[0].validation_error == 1
    assert violations(table, check_rows_expected(5)).count() == 0
    assert violations(table, check_rows_expected(4)).count() == 1
    assert violations(table, check_query("negative", lambda df: df.filter("v < 0"))).count() == 1


def test_suite_agrees_with_the_single_tests(table, parent):
    checks = [
        check_has_data(),
        check_rows_expected(4),
        check_not_null("id").warn(),
        check_not_negative("v"),
        check_unique("id"),
        check_unique_combination("id", "name"),
        check_relationships("parent", parent, "key").warn(),
        check_query("nothing", lambda df: df.filter("v > 100")).named("quiet"),
    ]
    result = {r.test: (r.failures, r.status) for r in run_suite({"t": (table, checks)}).collect()}
    assert result == {
        "t__has_data": (0, "pass"),
        "t__rows_expected": (1, "fail"),
        "t__id__not_null": (2, "warn"),
        "t__v__not_negative": (1, "fail"),
        "t__id__unique": (1, "fail"),
        "t__id__name__unique": (1, "fail"),
        "t__parent__relationships": (1, "warn"),
        "t__quiet": (0, "pass"),
    }


def test_row_checks_share_one_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id - 1 as v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    suite = run_suite({"t": (df, [check_not_null("id"), check_not_negative("v"), check_has_data(), check_rows_expected(3)])})
    assert suite._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r.test: r.failures for r in suite.collect()}["t__v__not_negative"] == 1


def test_empty_table(table):
    empty = table.limit(0)
    result = {r.test: r.status for r in run_suite({"t": (empty, [check_has_data(), check_not_null("id"), check_unique("id")])}).collect()}
    assert result == {"t__has_data": "fail", "t__id__not_null": "pass", "t__id__unique": "pass"}


def test_failures_are_stored_for_failed_tests_only(spark, table, tmp_path):
    checks = [check_not_null("id").warn(), check_not_negative("id"), check_rows_expected(9), check_has_data()]
    statuses = store_failures({"t": (table, checks)}, str(tmp_path))
    assert statuses == [
        ("t__has_data", "pass", 0),
        ("t__id__not_negative", "pass", 0),
        ("t__id__not_null", "warn", 2),
        ("t__rows_expected", "fail", 1),
    ]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t__id__not_null", "t__rows_expected"]
    assert spark.read.parquet(str(tmp_path / "t__id__not_null")).filter(F.col("id").isNull()).count() == 2


def test_uniqueness_tests_share_one_scan(spark):
    rows = spark.createDataFrame(
        [(1, None, 0.0), (1, None, -0.0), (2, "a", 1.0), (3, "a", None), (3, "a", None)], "k int, t string, x double"
    )
    checks = [check_unique("k"), check_unique("t"), check_unique_combination("k", "t"), check_unique_combination("t", "k", "x")]
    found = {r.test: r.failures for r in run_suite({"rows": (rows, checks)}).collect()}
    alone = {f"rows__{c.name}": violations(rows, c).count() for c in checks}
    assert found == alone and set(found.values()) == {2, 1}
    plan = run_suite({"rows": (rows, checks)})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert [r.failures for r in run_suite({"none": (rows.limit(0), checks[:2])}).collect()] == [0, 0]


def test_require_passed(spark):
    rows = spark.createDataFrame([(1,), (1,)], "k int")
    require_passed({"rows": (rows, [check_not_null("k"), check_unique("k").warn()])})
    with pytest.raises(ValueError, match="rows__k__unique"):
        require_passed({"rows": (rows, [check_unique("k")])})
