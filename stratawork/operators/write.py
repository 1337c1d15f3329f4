"""Materialising tables and views, and naming them by layer."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DateType,
    MapType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
    VariantType,
)

LAYERS = ("src", "ref", "stg", "int", "mrt", "exp", "mtd", "tmp")
VIEW_LAYERS = ("exp",)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    if not old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new):
        raise OSError(f"{source} could not be moved to {target}")


def partition_folders(spark: SparkSession, path: str, depth: int) -> list[str]:
    """The folders of a table's partitions over `depth` columns, relative to the table."""
    where = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *["*=*"] * depth]))
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return ["/".join(f.getPath().toString().split("/")[-depth:]) for f in found] if found else []


def _folder_calls(spark: SparkSession, path: str) -> tuple[Callable, Callable, Callable, str]:
    """How to delete, make and rename folders where a table lies, and its path for these calls.

    Mounted folders are reached by the operating system, which spares a call through the JVM for each of thousands of
    partitions; other stores by Spark's file system.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getScheme() == "file":
        plain = re.sub("^file:/+", "/", path)
        return (lambda p: shutil.rmtree(p, ignore_errors=True)), (lambda p: os.makedirs(p, exist_ok=True)), os.rename, plain

    def rename(old: str, new: str) -> None:
        if not store.rename(hadoop(old), hadoop(new)):
            raise OSError(f"{old} could not be moved to {new}")

    return (lambda p: store.delete(hadoop(p), True)), (lambda p: store.mkdirs(hadoop(p))), rename, path


def move_partitions(spark: SparkSession, source: str, target: str, depth: int) -> None:
    """Put each partition of a written table in the place of the target's, several at a time; no data is read."""
    folders = partition_folders(spark, source, depth)
    delete, make, rename, here = _folder_calls(spark, target)
    there = _folder_calls(spark, source)[3]

    def move(folder: str) -> None:
        delete(f"{here}/{folder}")
        rename(f"{there}/{folder}", f"{here}/{folder}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(make, sorted({f"{here}/{folder}".rpartition("/")[0] for folder in folders})))
        list(pool.map(move, folders))


def remove_partitions(spark: SparkSession, path: str, folders: list[str]) -> None:
    delete, _, _, here = _folder_calls(spark, path)
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda folder: delete(f"{here}/{folder}"), folders))


#: Bits of a column's rank in a curve, and the error of the quantiles that the ranks come from, in rows of 10 000.
CURVE_BITS, CURVE_ACCURACY = 8, 10_000


def _as_number(df: DataFrame, column: str) -> Column:
    """A double in the order of the column: dates and timestamps by their distance from 1970, texts by their first six bytes."""
    kind = df.schema[column].dataType
    if isinstance(kind, (StringType, BinaryType)):
        head = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column)).cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, (NumericType, BooleanType)):
        return F.col(column).cast("double")
    raise ValueError(f"column {column} of {kind.simpleString()} has no place on a curve")


def with_curve(df: DataFrame, columns: list[str], name: str = "_curve", bits: int = CURVE_BITS) -> DataFrame:
    """Add each row's place on a space-filling curve (Morton order) over the ranks of several columns (action).

    A value's rank is the number of quantiles below it, so skewed columns use the whole curve; the quantiles, 2^bits of
    each column, come from one aggregation and are all that is fetched. NULL ranks lowest. The bits of the ranks are
    interleaved, the first column's first, so near places are near in every column.
    """
    if not 0 < bits * len(columns) < 63:
        raise ValueError("the ranks must fit into 62 bits")
    numbers = [_as_number(df, c) for c in columns]
    steps = [k / 2**bits for k in range(1, 2**bits)]
    quantiles = df.agg(*[F.percentile_approx(n, steps, CURVE_ACCURACY).alias(f"q{i}") for i, n in enumerate(numbers)]).first()
    ranked = df
    for i, number in enumerate(numbers):
        cuts = F.lit(list(quantiles[i] or [0.0] * len(steps)))
        ranked = ranked.withColumns({f"_n{i}": F.coalesce(number, F.lit(float("-inf"))), f"_r{i}": F.lit(0)})
        for b in reversed(range(bits)):  # a search by halves in the list of quantiles
            above = F.col(f"_n{i}") > F.element_at(cuts, F.col(f"_r{i}") + 2**b)
            ranked = ranked.withColumn(f"_r{i}", F.col(f"_r{i}") + F.when(above, 2**b).otherwise(0))
    place = F.lit(0).cast("bigint")
    for b in reversed(range(bits)):
        for i in range(len(columns)):
            place = place * 2 + F.getbit(F.col(f"_r{i}"), F.lit(b)).cast("bigint")
    helpers = [f"_{kind}{i}" for i in range(len(columns)) for kind in "nr"]
    return ranked.withColumn(name, place).drop(*helpers)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str | None) -> Iterator[None]:
    """A session setting for one action; None leaves it as it is."""
    before = spark.conf.get(name, None)
    try:
        if value is not None:
            spark.conf.set(name, value)
        yield
    finally:
        if value is not None:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: list[str] = (),
    cluster_by: list[str] = (),
    curve: bool = False,
    files: int | None = None,
    spread: bool = False,
) -> None:
    """Write Parquet (write).

    `append` adds rows, `overwrite` replaces the partitions that occur in `df`, `replace` replaces the whole table (as
    does `overwrite` where it is not partitioned). The whole table is replaced only once the new one is complete: it is
    written beside the old one and moved into its place, so a plan that fails leaves the old rows. Rows of one partition
    are brought together, and a partition that holds too much is split again at run time. With `cluster_by` the rows are
    range-partitioned and sorted; a hash as the last sort column lets one value span files. With `curve` the range is one
    of places on a space-filling curve over the ranks of `cluster_by`, so a filter on any of the columns skips files.
    `files` is the number of ranges of a clustered write, else that of shuffle partitions. With `spread` partitions with
    few rows each are not brought together into few tasks: for writes in which opening files is what takes the time.
    """
    spark, partition_by, cluster_by = df.sparkSession, list(partition_by), list(cluster_by)
    if cluster_by:
        row_hash = F.xxhash64(*[f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))])
        order = [*partition_by, *(["_curve"] if curve else []), *cluster_by]
        df = with_curve(df, cluster_by) if curve else df
        number = [files] if files else []
        df = df.repartitionByRange(*number, *order, row_hash).sortWithinPartitions(*order).drop("_curve")
    elif partition_by:
        df = df.hint("rebalance", *partition_by)

    def save(kind: str, target: str, dynamic: bool) -> None:
        write = df.write.mode(kind).option("partitionOverwriteMode", "dynamic" if dynamic else "static")
        with _setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false" if spread and partition_by else None):
            (write.partitionBy(*partition_by) if partition_by else write).parquet(target)

    if mode == "append":
        return save("append", path, False)
    if mode == "overwrite" and partition_by:
        return save("overwrite", path, True)
    if mode not in ("overwrite", "replace"):
        raise ValueError(f"not a write mode: {mode}")
    new, old = f"{path}__new", f"{path}__old"
    if not path_exists(spark, path):
        if not path_exists(spark, old):
            return save("overwrite", path, False)
        move_path(spark, old, path)  # a replace was cut off between its two moves
    save("overwrite", new, False)
    remove_path(spark, old)
    move_path(spark, path, old)
    move_path(spark, new, path)
    spark.catalog.refreshByPath(path)
    remove_path(spark, old)


def layer_schema(layer: str | None, owner: str | None = None, shared: str = "_{layer}", own: str = "{owner}_{layer}") -> str:
    """The schema of a layer: a shared one, or an owner's copy of it where an owner is given.

    Names are upper case and come from the two patterns, which are the caller's convention. Without a layer it is the
    owner's schema, or the shared one for temporary models.
    """
    names = {"layer": (layer or "").strip().upper(), "owner": (owner or "").strip().upper()}
    if not names["layer"]:
        return names["owner"] or shared.format(layer="TMP")
    return (own if names["owner"] else shared).format(**names)


def materialise(
    df: DataFrame,
    root: str,
    layer: str,
    name: str,
    owner: str | None = None,
    as_view: bool | None = None,
    partition_by: list[str] = (),
    catalog: bool = False,
    view_sql: str | None = None,
) -> DataFrame:
    """Write a model to its layer and return the written table, or expose it as a view (write).

    Exposed products are views, everything else is a table; `as_view` overrides that. With `catalog` the layer is a
    database under `root` that other sessions see: a table is registered in it, column comments included, and a view is
    stored there. Its text is `view_sql`; without one it selects from the rows as they are now, kept as a table of the
    view's name plus `__rows`. Without `catalog` a view is known to this session only, by layer and name.
    """
    if layer not in LAYERS:
        raise ValueError(f"not a layer: {layer}")
    spark, schema = df.sparkSession, layer_schema(layer, owner)
    view = as_view if as_view is not None else layer in VIEW_LAYERS
    if view and not catalog:
        df.createOrReplaceTempView(f"{schema}__{name}")
        return spark.table(f"{schema}__{name}")
    if catalog:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}` LOCATION '{root}/{schema}'")
    if view and view_sql:
        spark.sql(f"CREATE OR REPLACE VIEW `{schema}`.`{name}` AS {view_sql}")
        return spark.table(f"`{schema}`.`{name}`")
    stored = f"{name}__rows" if view else name
    path = f"{root}/{schema}/{stored}"
    write_table(df, path, "replace", partition_by)
    if not catalog:
        return spark.read.schema(df.schema).parquet(path)
    spark.sql(f"DROP TABLE IF EXISTS `{schema}`.`{stored}`")
    spark.catalog.createTable(f"`{schema}`.`{stored}`", path=path, source="parquet", schema=df.schema)
    if view:
        spark.sql(f"CREATE OR REPLACE VIEW `{schema}`.`{name}` AS SELECT * FROM `{schema}`.`{stored}`")
    return spark.table(f"`{schema}`.`{name}`")
