"""Data tests: a test returns the rows that violate it.

The row-local tests of a table are counted together in one scan, its uniqueness tests in another one with one shuffle
of counts; a relationship test compares distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import join_reference
from .write import write_table


@dataclass(frozen=True)
class Check:
    """A data test. `condition` is true for a violating row; `rows` returns violating rows or groups.

    `weight` names the column of `rows` that says how many failures a row stands for. `keys` are the columns of a
    uniqueness test; all of a table's are counted in one scan and one shuffle. `nulls` says whether a NULL is a value.
    """

    name: str
    condition: Column | None = None
    rows: Callable[[DataFrame], DataFrame] | None = None
    total: Callable[[Column], Column] | None = None
    weight: str | None = None
    keys: tuple[str, ...] = ()
    nulls: bool = True
    severity: str = "error"
    store: bool = True

    def warn(self) -> Check:
        return replace(self, severity="warn")

    def named(self, name: str) -> Check:
        return replace(self, name=name)


def check_not_null(column: str) -> Check:
    return Check(f"{column}__not_null", F.col(column).isNull())


def check_not_empty(column: str) -> Check:
    return Check(f"{column}__not_empty", F.coalesce(F.col(column).cast("string"), F.lit("")) == "")


def check_not_negative(column: str) -> Check:
    """NULL passes."""
    return Check(f"{column}__not_negative", F.coalesce(F.col(column) < 0, F.lit(False)))


def check_accepted_values(column: str, values: list) -> Check:
    """NULL passes."""
    return Check(f"{column}__accepted_values", F.coalesce(~F.col(column).isin(values), F.lit(False)))


def check_accepted_range(column: str, low: object, high: object) -> Check:
    """NULL passes."""
    return Check(f"{column}__accepted_range", F.coalesce(~F.col(column).between(low, high), F.lit(False)))


def check_expression(name: str, expression: str) -> Check:
    """A row violates when the expression is false; unknown passes."""
    return Check(f"{name}__expression_is_true", F.coalesce(~F.expr(expression), F.lit(False)))


def check_unique(column: str) -> Check:
    """One violation per repeated value; NULL is not a value."""

    def repeated(df: DataFrame) -> DataFrame:
        return (
            df.filter(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("unique_field"))
            .agg(F.count("*").alias("n_records"))
            .filter("n_records > 1")
        )

    return Check(f"{column}__unique", rows=repeated, keys=(column,), nulls=False)


def check_unique_combination(*columns: str) -> Check:
    """One violation per repeated combination; NULLs count as equal here."""

    def repeated(df: DataFrame) -> DataFrame:
        return df.groupBy(*columns).agg(F.count("*").alias("n_records")).filter("n_records > 1").select(*columns)

    return Check("__".join(columns) + "__unique", rows=repeated, keys=columns)


def check_relationships(column: str, parent: DataFrame, parent_column: str) -> Check:
    """Child keys without a parent, with how many child rows carry them; NULL passes.

    Keys of different types meet as in `join_reference`. Distinct keys of both sides are shuffled, nothing is broadcast.
    """

    def orphans(df: DataFrame) -> DataFrame:
        children = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("from_field"))
        keys = parent.select(F.col(parent_column).alias("from_field")).filter("from_field is not null").distinct()
        counted = children.agg(F.count("*").alias("n_records"))
        return join_reference(counted, keys, ["from_field"], "left_anti", max_bytes=0, known_bytes=1)

    return Check(f"{column}__relationships", rows=orphans, weight="n_records")


def check_has_data() -> Check:
    """Violated by an empty table; stops at the first row when run alone."""

    def missing(df: DataFrame) -> DataFrame:
        one = df.limit(1).agg(F.count("*").alias("_n"))
        return one.filter("_n = 0").select(F.lit(1).alias("validation_error"))

    return Check("has_data", rows=missing, total=lambda n: F.when(n == 0, 1).otherwise(0), store=False)


def check_rows_expected(rows: int) -> Check:
    def differs(df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("_n")).filter(f"_n != {rows}").select(F.lit(1).alias("validation_error"))

    return Check("rows_expected", rows=differs, total=lambda n: F.when(n != rows, 1).otherwise(0))


def check_query(name: str, query: Callable[[DataFrame], DataFrame]) -> Check:
    """Any query that must return no rows."""
    return Check(name, rows=query)


def declare(
    *,
    has_data: bool = True,
    rows: int | None = None,
    not_null: list[str] = (),
    unique: list[str] = (),
    not_empty: list[str] = (),
    not_negative: list[str] = (),
    combination: list[str] = (),
    parents: dict[str, tuple[DataFrame, str]] | None = None,
) -> list[Check]:
    """The usual tests of a table from lists of columns; `parents` maps a foreign key to its dimension and only warns."""
    return [
        *([check_has_data()] if has_data else []),
        *([check_rows_expected(rows)] if rows is not None else []),
        *([check_unique_combination(*combination)] if combination else []),
        *map(check_not_null, not_null),
        *map(check_unique, unique),
        *map(check_not_empty, not_empty),
        *map(check_not_negative, not_negative),
        *[check_relationships(column, dim, key).warn() for column, (dim, key) in (parents or {}).items()],
    ]


def violations(df: DataFrame, check: Check) -> DataFrame:
    """The violating rows of one test."""
    return df.filter(check.condition) if check.condition is not None else check.rows(df)


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_column: str, **join_options: int) -> DataFrame:
    """The child rows whose key has no parent; NULL passes. Keys of different types are widened, never cut."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return join_reference(child.filter(F.col(column).isNotNull()), keys, [column], "left_anti", **join_options)


def _repeated_keys(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One row: a map from the number of a uniqueness test to how many keys are repeated.

    Every row is expanded into (test, key) and all tests are grouped together. A key is two 64-bit hashes of its values.
    """
    keys = []
    for i, check in enumerate(checks):
        wanted = F.lit(True) if check.nulls else F.col(check.keys[0]).isNotNull()
        key = F.struct(F.lit(i).alias("test"), F.xxhash64(*check.keys).alias("a"), F.xxhash64(F.lit("b"), *[
            F.coalesce(F.xxhash64(c), F.lit(0)) for c in check.keys], *[F.col(c).isNull() for c in check.keys]).alias("b"))
        keys.append(F.when(wanted, key))
    expanded = df.select(F.explode(F.array_compact(F.array(*keys))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    counts = expanded.filter("n > 1").groupBy("key.test").agg(F.count("*").alias("repeated"))
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("test", "repeated"))).alias("repeated"))


def _results(table: str, df: DataFrame, checks: list[Check]) -> DataFrame:
    """(test, severity, failures) of one table: one scan for what a scan can count, one for all keys, one query per other test."""
    together = [c for c in checks if c.condition is not None or c.total is not None]
    unique = [c for c in checks if c.keys]
    alone = [c for c in checks if c not in together and not c.keys]

    def label(check: Check, failures: Column) -> list[Column]:
        return [F.lit(f"{table}__{check.name}").alias("test"), F.lit(check.severity).alias("severity"),
                failures.cast("bigint").alias("failures")]

    parts = []
    if together:
        everything = F.count(F.lit(1))
        counts = [c.total(everything) if c.total else F.count_if(c.condition) for c in together]
        one = df.agg(*[count.alias(f"c{i}") for i, count in enumerate(counts)])
        rows = [F.struct(*label(c, F.col(f"c{i}"))) for i, c in enumerate(together)]
        parts.append(one.select(F.inline(F.array(*rows))))
    if unique:
        parts.append(_repeated_keys(df, unique).select(F.inline(F.array(*[
            F.struct(*label(c, F.coalesce(F.element_at("repeated", F.lit(i)), F.lit(0)))) for i, c in enumerate(unique)
        ]))))
    for check in alone:
        failures = F.coalesce(F.sum(check.weight), F.lit(0)) if check.weight else F.count(F.lit(1))
        parts.append(check.rows(df).agg(failures.alias("c")).select(*label(check, F.col("c"))))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def run_suite(suite: dict[str, tuple[DataFrame, list[Check]]]) -> DataFrame:
    """One row per test: name, severity, failures and pass / warn / fail."""
    result = None
    for table, (df, checks) in suite.items():
        part = _results(table, df, checks)
        result = part if result is None else result.unionByName(part)
    status = F.when(F.col("failures") == 0, "pass").when(F.col("severity") == "warn", "warn").otherwise("fail")
    return result.withColumn("status", status)


def require_passed(suite: dict[str, tuple[DataFrame, list[Check]]]) -> None:
    """Run the suite and raise if a test of severity `error` fails: call it on staged tables before they are published."""
    failed = run_suite(suite).filter("status = 'fail'").select("test", "failures").collect()
    if failed:
        raise ValueError("tests failed: " + ", ".join(f"{r['test']} ({r['failures']})" for r in sorted(failed)))


def store_failures(suite: dict[str, tuple[DataFrame, list[Check]]], root: str) -> list[tuple[str, str, int]]:
    """Run the suite and write the violating rows of each failed test to `<root>/<test>` (write).

    Only failed tests are queried again. Returns (test, status, failures), one entry per test.
    """
    results = {r["test"]: r for r in run_suite(suite).collect()}
    for table, (df, checks) in suite.items():
        for check in checks:
            if check.store and results[f"{table}__{check.name}"]["failures"] > 0:
                write_table(violations(df, check), f"{root}/{table}__{check.name}", "replace")
    return sorted((r["test"], r["status"], r["failures"]) for r in results.values())
