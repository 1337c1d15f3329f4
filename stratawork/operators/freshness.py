"""Source freshness, what changed since the last successful build, and rebuilding only that."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from .evolve import read_stored, record_columns, recorded_columns, stored_columns
from .write import move_partitions, partition_folders, remove_partitions, remove_path, write_table

WARN_AFTER = timedelta(hours=48)
ERROR_AFTER = timedelta(days=7)


def _ntz(moment: datetime | Column) -> Column:
    return moment if isinstance(moment, Column) else F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def freshness_status(
    latest: DataFrame, now: datetime | Column, warn_after: timedelta = WARN_AFTER, error_after: timedelta = ERROR_AFTER
) -> DataFrame:
    """Age and status of each (source, max_loaded_at); a source without a value could not be checked."""
    age = F.timestamp_diff("MICROSECOND", F.col("max_loaded_at"), F.col("snapshotted_at")) / 1000000
    status = (
        F.when(F.col("max_loaded_at").isNull(), "runtime error")
        .when(F.col("age_seconds") > error_after.total_seconds(), "error")
        .when(F.col("age_seconds") > warn_after.total_seconds(), "warn")
        .otherwise("pass")
    )
    aged = latest.withColumn("snapshotted_at", _ntz(now)).withColumn("age_seconds", age)
    return aged.withColumn("status", status)


def freshness(
    sources: dict[str, tuple[DataFrame, Column | None]],
    now: datetime | Column,
    warn_after: timedelta = WARN_AFTER,
    error_after: timedelta = ERROR_AFTER,
) -> DataFrame:
    """Freshness of several tables, each with its loaded-at expression; a table without one is skipped."""
    latest = None
    for source, (df, loaded) in sources.items():
        if loaded is None:
            continue
        one = df.agg(F.max(loaded).alias("max_loaded_at")).select(F.lit(source).alias("source"), "max_loaded_at")
        latest = one if latest is None else latest.unionByName(one)
    if latest is None:
        raise ValueError("no source has a loaded-at expression")
    return freshness_status(latest, now, warn_after, error_after)


def footer_aggregates(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """count, and max_<column> of each column, from the footers of a table's Parquet files; no row is read.

    The aggregates are pushed into the scan (`PushedAggregation` in the plan), which Spark does for numbers, dates and
    booleans of a table without partition columns; timestamps without zone are taken as the integers they are stored as.
    For other types, and for partitioned tables, the same plan reads the columns. Spark finds a footer's columns by their
    place, so this holds for files that all have the same columns in the same order; `stored_max` proves it.
    """
    kinds = spark.read.parquet(path).schema
    read_as = StructType([StructField(f.name, LongType() if isinstance(f.dataType, TimestampNTZType) else f.dataType) for f in kinds])
    session = spark.newSession()  # the older reader of Parquet can't push aggregates; only this session uses the newer one
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    table = session.read.schema(read_as).parquet(path)
    return table.agg(F.count("*").alias("count"), *[F.max(c).alias(f"max_{c}") for c in columns])


def stored_max(spark: SparkSession, path: str, column: str) -> object:
    """The largest value of a column of a Parquet table, from its footers as far as they tell (action); None without one.

    What the footers give is only a guess, as files may differ in their columns or in the unit of a timestamp (microseconds,
    as Spark writes it, are taken). It is proved by the rows: those not below it must be there, and their largest value is
    the answer. The filter is pushed down, so only row groups that reach it are read. Where there are none, or the footers
    can't be put together, the whole column is read.
    """
    rows = spark.read.parquet(path).select(column)
    kind = rows.schema[column].dataType
    try:
        guess = footer_aggregates(spark, path, [column]).first()[f"max_{column}"]
        if isinstance(kind, TimestampNTZType) and guess is not None:
            guess = (datetime(1970, 1, 1) + timedelta(microseconds=guess)).isoformat(" ")
    except (PySparkException, Py4JJavaError, OverflowError):
        guess = None
    if guess is not None:
        proved = rows.filter(F.col(column) >= F.lit(guess).cast(kind)).agg(F.max(column)).first()[0]
        if proved is not None:
            return proved
    return rows.agg(F.max(column)).first()[0]


def stored_freshness(
    spark: SparkSession,
    tables: dict[str, tuple[str, str]],
    now: datetime | Column,
    warn_after: timedelta = WARN_AFTER,
    error_after: timedelta = ERROR_AFTER,
) -> DataFrame:
    """Freshness of Parquet tables by the footers of their files: {source: (path, loaded-at column)} (action).

    A date counts as its midnight. What is fetched is one value for each table.
    """
    latest = []
    for source, (path, column) in tables.items():
        value = stored_max(spark, path, column)
        if isinstance(value, date) and not isinstance(value, datetime):
            value = datetime(value.year, value.month, value.day)
        latest.append((source, value))
    return freshness_status(spark.createDataFrame(latest, "source string, max_loaded_at timestamp_ntz"), now, warn_after, error_after)


def observations(results: DataFrame) -> DataFrame:
    """What a freshness check adds to the observation log: sources that could be queried."""
    return results.filter(F.col("max_loaded_at").isNotNull()).select(
        "source", "max_loaded_at", F.col("snapshotted_at").alias("observed_at")
    )


def latest_observation(
    log: DataFrame, before: datetime | Column | None = None, tiebreak: list[str] = ()
) -> DataFrame:
    """The latest value per source, before a moment if given; a latest one without a value drops the source."""
    if before is not None:
        log = log.filter(F.col("observed_at") < _ntz(before))
    latest = log.groupBy("source").agg(
        F.max_by("max_loaded_at", F.struct("observed_at", *tiebreak)).alias("max_loaded_at")
    )
    return latest.filter(F.col("max_loaded_at").isNotNull())


def last_success_start(runs: DataFrame, job: str) -> DataFrame:
    """When the latest successful run of a job started, one row; NULL before its first success."""
    return runs.filter((F.col("job") == job) & (F.col("status") == "SUCCESS")).agg(
        F.max("start_time").alias("last_success_start")
    )


def changed_sources(log: DataFrame, runs: DataFrame, job: str, tiebreak: list[str] = ()) -> DataFrame:
    """The sources whose latest value differs from what the last successful run built from.

    A source that was never built has changed; a failed run moves nothing. The log is read once:
    the latest value overall and the latest before the run are two aggregates of one grouping.
    """
    moment = F.struct("observed_at", *tiebreak)
    built = F.col("observed_at") < last_success_start(runs, job).scalar()
    compared = (
        log.withColumn("_before", built)
        .groupBy("source")
        .agg(
            F.max_by("max_loaded_at", moment).alias("max_loaded_at"),
            F.max_by("max_loaded_at", F.when(F.col("_before"), moment)).alias("_built"),
        )
    )
    changed = F.col("max_loaded_at").isNotNull() & ~F.col("max_loaded_at").eqNullSafe(F.col("_built"))
    return compared.filter(changed).drop("_built")


def change_set_key(changed: DataFrame) -> DataFrame:
    """The change set as one text, `source@value` parts sorted and joined by a pipe.

    The text is the caller's run key and names every changed source, so it is as long as there are sources.
    """
    part = F.concat_ws("@", F.col("source"), F.col("max_loaded_at").cast("string"))
    return changed.agg(F.concat_ws("|", F.array_sort(F.collect_list(part))).alias("change_set_key"))


def affected_partitions(df: DataFrame, loaded: str, since: datetime | Column, cols: list[str]) -> DataFrame:
    """The partition values that got rows after `since`."""
    return df.filter(F.col(loaded) > _ntz(since)).select(*cols).distinct()


class Step(NamedTuple):
    """A model of a chain that is built from the table before it.

    `partitions` gives each partition column of the model's table from columns of what it reads, so that rows of a source
    partition end in known target partitions: `{"month": F.trunc("day", "month")}`. `model` must give these columns too
    and compute each partition from the rows that are mapped to it.
    """

    model: Callable[[DataFrame], DataFrame]
    path: str
    partitions: dict[str, Column]


def _recompute(spark: SparkSession, df: DataFrame, affected: DataFrame, step: Step) -> DataFrame:
    """Rebuild the affected partitions of a step's table; returns them. Rows of `affected` are the partition columns' values."""
    names = list(step.partitions)
    marks = f"{step.path}__affected"
    # Written once, and as partitions: the folders' names are Spark's own.
    named = affected.select(*names, *[F.col(c).alias(f"_part_{c}") for c in names])
    write_table(named, marks, "replace", names, spread=True)
    wanted = spark.read.schema(StructType([StructField(f"_part_{c}", affected.schema[c].dataType) for c in names])).parquet(marks)
    keyed = df.withColumns({f"_key_{c}": e for c, e in step.partitions.items()})
    same = reduce(and_, [F.col(f"_key_{c}").eqNullSafe(F.col(f"_part_{c}")) for c in names])
    rows = keyed.join(wanted, same, "left_semi").drop(*[f"_key_{c}" for c in names])
    staging, built = f"{step.path}__staging", step.model(rows)
    write_table(built, staging, "replace", names, spread=True)
    made = set(partition_folders(spark, staging, len(names)))
    gone = [folder for folder in partition_folders(spark, marks, len(names)) if folder not in made]
    move_partitions(spark, staging, step.path, len(names))
    remove_partitions(spark, step.path, gone)
    remove_path(spark, staging)
    if recorded_columns(spark, step.path) is None:  # a folder's name does not tell text from numbers
        held = stored_columns(spark, step.path) or built.schema
        record_columns(spark, step.path, StructType([f for f in held if f.name not in names] + [built.schema[c] for c in names]))
    spark.catalog.refreshByPath(step.path)
    return wanted.select(*[F.col(f"_part_{c}").alias(c) for c in names])


def recompute_chain(spark: SparkSession, df: DataFrame, loaded: str, since: datetime | Column, steps: list[Step]) -> list[int]:
    """Rebuild what is downstream of rows loaded after `since`, step by step (write).

    The first step reads `df`, each other the table of the step before. The partitions that the newer rows are mapped to
    are rebuilt from all their rows, then the partitions that those are mapped to, and so on; no other file is touched. A
    partition of which nothing is left is removed; NULL is a partition like any other. Returns how many partitions of each
    step were affected. A chain that was cut off is repeated with the same `since`.
    """
    affected, counts = df.filter(F.col(loaded) > _ntz(since)), []
    for step in steps:
        affected = affected.select(*[e.alias(c) for c, e in step.partitions.items()]).distinct()
        affected = _recompute(spark, df, affected, step)
        counts.append(affected.count())
        if step is not steps[-1]:
            df = read_stored(spark, step.path)
    for step in steps:
        remove_path(spark, f"{step.path}__affected")
    return counts


def recompute_partitions(
    spark: SparkSession,
    df: DataFrame,
    loaded: str,
    since: datetime | Column,
    partition_by: list[str],
    model: Callable[[DataFrame], DataFrame],
    path: str,
) -> int:
    """Rebuild only the partitions of `path` whose source rows got newer (write); the source has the partition columns.

    `model` must keep the partition columns and compute each partition from its own rows. A partition of which nothing
    is left is removed; NULL is a partition like any other. Returns the number of partitions that got newer rows.
    """
    return recompute_chain(spark, df, loaded, since, [Step(model, path, {c: F.col(c) for c in partition_by})])[0]
