"""Columns whose type changes between loads: a promotion lattice, side columns, and the recorded columns of a table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    NullType,
    NumericType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    VariantType,
)

#: Integers from narrow to wide, and the digits they need.
_INTEGERS = {ByteType(): 3, ShortType(): 5, IntegerType(): 10, LongType(): 20}
#: Types whose values come back unchanged from their text.
_AS_TEXT = (NumericType, DateType, TimestampNTZType, BooleanType)
_RECORD = "_columns.json"


def relaxed(kind: DataType) -> DataType:
    """The type with NULL allowed everywhere inside, which is how files are read."""
    if isinstance(kind, ArrayType):
        return ArrayType(relaxed(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(relaxed(kind.keyType), relaxed(kind.valueType))
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, relaxed(f.dataType), True, f.metadata) for f in kind])
    return kind


def digits(kind: DataType) -> tuple[int, int] | None:
    """Digits before and behind the point that an exact number type can hold; None for any other type."""
    if isinstance(kind, DecimalType):
        return kind.precision - kind.scale, kind.scale
    return (_INTEGERS[kind], 0) if kind in _INTEGERS else None


def promoted(stored: DataType, new: DataType) -> DataType | None:
    """The narrowest type that holds every value of both and in which Parquet files of both can be read; else None.

    Integers widen to larger integers and to decimals, decimals to larger ones up to 38 digits, int and float to double,
    a date to a timestamp without zone.
    """
    if stored == new or isinstance(new, NullType):
        return stored
    if isinstance(stored, NullType):
        return new
    if stored in _INTEGERS and new in _INTEGERS:
        return max(stored, new, key=_INTEGERS.get)
    a, b = digits(stored), digits(new)
    if a and b:
        whole, scale = max(a[0], b[0]), max(a[1], b[1])
        return DecimalType(whole + scale, scale) if whole + scale <= 38 else None
    kinds = {type(stored), type(new)}
    if kinds == {DateType, TimestampNTZType}:
        return TimestampNTZType()
    if DoubleType in kinds and kinds - {DoubleType} <= {FloatType, IntegerType, ShortType, ByteType}:
        return DoubleType()
    return None


def side_name(column: str, kind: DataType) -> str:
    """The column for values of a type that the stored type can't hold."""
    return f"{column}__v_{kind.typeName()}"


def split_values(column: str, stored: DataType, new: DataType) -> tuple[Column, Column]:
    """A column's values in the stored type, and those that it can't hold; of the two at least one is NULL.

    A value stays if it comes back unchanged from the stored type: text `12` is a number, `012` and `abc` are not.
    """
    value = F.col(column)
    nested = (ArrayType, MapType, StructType, VariantType)
    if isinstance(stored, nested) or isinstance(new, nested):
        return F.lit(None).cast(stored), value
    held = value.try_cast(stored)
    fits = held.try_cast(new).eqNullSafe(value)
    return F.when(fits, held), F.when(~fits, value)


def fitted(batch: DataFrame, stored: StructType, fixed: list[str] = ()) -> tuple[DataFrame, StructType]:
    """The batch in the table's columns and types, and those columns as they are with the batch.

    A type that widens is promoted on both sides. Where no promotion exists, values that the stored type holds stay, the
    others go to a column of their own (`side_name`) and leave NULL behind. Text takes numbers, dates and booleans as text. Columns in `fixed` (keys, partitions) may
    only widen, and are refused otherwise. Names that differ in case are one column unless the session tells them apart.
    """
    strict = batch.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    known = {f.name if strict else f.name.lower(): f.name for f in stored}
    batch = batch.select(*[F.col(f"`{c}`").alias(known.get(c if strict else c.lower(), c)) for c in batch.columns])
    columns, out, grown = {f.name: f for f in relaxed(stored)}, [], {}
    for field in relaxed(batch.schema):
        name = field.name
        if name not in columns:
            grown[name] = field
            out.append(F.col(name))
            continue
        kind = promoted(columns[name].dataType, field.dataType)
        if kind is not None:
            columns[name] = StructField(name, kind, True, columns[name].metadata)
            out.append(F.col(name).cast(kind).alias(name))
            continue
        if isinstance(columns[name].dataType, StringType) and isinstance(field.dataType, _AS_TEXT):
            out.append(F.col(name).cast("string").alias(name))
            continue
        side = side_name(name, field.dataType)
        kinds = f"column {name} is stored as {columns[name].dataType.simpleString()}, not {field.dataType.simpleString()}"
        if name in fixed:
            raise ValueError(kinds)
        if side in batch.columns or (side in columns and columns[side].dataType != field.dataType):
            raise ValueError(f"{kinds}, and {side} is taken")
        held, rest = split_values(name, columns[name].dataType, field.dataType)
        out += [held.alias(name), rest.alias(side)]
        if side not in columns:
            grown[side] = StructField(side, field.dataType)
    return batch.select(*out), StructType([*columns.values(), *grown.values()])


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_RECORD}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def record_columns(spark: SparkSession, path: str, schema: StructType) -> None:
    """Keep the table's columns in a small hidden file beside its data, which needn't be rewritten when a type widens."""
    store, where = _file(spark, path)
    stream = store.create(where, True)
    stream.write(bytearray(schema.json().encode()))
    stream.close()


def recorded_columns(spark: SparkSession, path: str) -> StructType | None:
    store, where = _file(spark, path)
    if not store.exists(where):
        return None
    stream = store.open(where)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return StructType.fromJson(json.loads(text))


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a table holds a data file; stops at the first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return False
    found = store.listFiles(where, True)
    while found.hasNext():
        if not found.next().getPath().getName().startswith(("_", ".")):
            return True
    return False


def stored_columns(spark: SparkSession, path: str) -> StructType | None:
    """The columns of a table: as recorded by the last merge, else as its files have them; None where there are neither."""
    if (columns := recorded_columns(spark, path)) is not None:
        return columns
    return spark.read.option("mergeSchema", "true").parquet(path).schema if has_files(spark, path) else None


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """A merged table by its recorded columns: files from before a promotion are read in the promoted type."""
    columns = stored_columns(spark, path)
    if columns is None:
        raise ValueError(f"{path} holds no table")
    return spark.read.schema(columns).parquet(path)
