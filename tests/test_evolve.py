"""Loads whose columns change their type or name, and tables that hold no rows."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, NullType, StringType, StructType, TimestampNTZType

from stratawork.operators import full_refresh, merge_into, promoted, read_stored, side_name, stored_columns
from stratawork.operators.evolve import split_values

KEYS, DAY = ["id", "day"], ["day"]


def kind(text):
    return StructType.fromDDL(f"c {text}")["c"].dataType


def merge(spark, path, rows, schema, **options):
    merge_into(spark, path, spark.createDataFrame(rows, schema), KEYS, ["id"], DAY, **options)


def rows_of(spark, path, *columns):
    return sorted(map(tuple, read_stored(spark, path).select(*columns).collect()), key=str)


@pytest.mark.parametrize("a, b, wide", [
    ("tinyint", "int", "int"), ("int", "bigint", "bigint"), ("bigint", "decimal(5,2)", "decimal(22,2)"), ("int", "decimal(20,4)", "decimal(20,4)"),
    ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"), ("date", "timestamp_ntz", "timestamp_ntz"), ("float", "double", "double"),
    ("int", "double", "double"), ("decimal(38,0)", "decimal(38,10)", None), ("bigint", "double", None), ("int", "string", None),
    ("array<int>", "array<bigint>", None),
])
def test_types_are_promoted_alike_from_both_sides(a, b, wide):
    assert promoted(kind(a), kind(b)) == promoted(kind(b), kind(a)) == (wide and kind(wide))
    assert promoted(kind(a), kind(a)) == promoted(kind(a), NullType()) == promoted(NullType(), kind(a)) == kind(a)


@pytest.mark.parametrize("first, second, value, later", [
    ("int", "bigint", 7, 2**40), ("bigint", "int", 2**40, 7), ("int", "decimal(12,2)", 7, Decimal("1.25")),
    ("bigint", "decimal(5,2)", 2**40, Decimal("1.25")), ("decimal(10,2)", "decimal(8,4)", Decimal("12345678.25"), Decimal("1.2345")),
    ("date", "timestamp_ntz", date(2024, 1, 2), datetime(2024, 1, 3, 4, 5)), ("float", "double", 0.5, 0.1), ("int", "double", 7, 0.1),
])
def test_a_promoted_column_leaves_older_files_alone(spark, tmp_path, first, second, value, later):
    path = str(tmp_path / "t")
    merge(spark, path, [(1, value, 1), (2, value, 2)], f"id int, v {first}, day int")
    older = sorted((tmp_path / "t" / "day=1").iterdir())
    merge(spark, path, [(2, later, 2), (3, None, 3)], f"id int, v {second}, day int")
    assert sorted((tmp_path / "t" / "day=1").iterdir()) == older
    assert stored_columns(spark, path)["v"].dataType == promoted(kind(first), kind(second))
    wanted = datetime(2024, 1, 2) if first == "date" else value
    assert rows_of(spark, path, "id", "v") == sorted([(1, wanted), (2, later), (3, None)], key=str)
    # a third load in the first type changes nothing any more
    merge(spark, path, [(4, value, 4)], f"id int, v {first}, day int")
    assert stored_columns(spark, path)["v"].dataType == promoted(kind(first), kind(second))
    assert (4, wanted) in rows_of(spark, path, "id", "v")


def test_values_that_no_promotion_holds_go_to_a_side_column(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, [(1, 5, 1)], "id int, v int, day int")
    merge(spark, path, [(2, "12", 1), (3, "012", 1), (4, "abc", 2), (5, None, 2), (6, "99999999999", 2)], "id int, v string, day int")
    side = side_name("v", StringType())
    assert rows_of(spark, path, "id", "v", side) == [
        (1, 5, None), (2, 12, None), (3, None, "012"), (4, None, "abc"), (5, None, None), (6, None, "99999999999"),
    ]
    merge(spark, path, [(4, [1, 2], 2)], "id int, v array<int>, day int")
    assert rows_of(spark, path, "id", "v", side, "v__v_array")[3] == (4, None, None, [1, 2])
    merge(spark, path, [(7, 1.5, 2), (8, 2.0, 2)], "id int, v double, day int")  # int and double have a common type
    assert stored_columns(spark, path)["v"].dataType == DoubleType()
    assert set(rows_of(spark, path, "id", "v")) >= {(1, 5.0), (7, 1.5), (8, 2.0)}


def test_split_values_lose_nothing(spark):
    cases = [("date", "string", "2024-01-02"), ("date", "string", "2024-1-2"), ("bigint", "double", 0.5), ("bigint", "double", 3.0), ("boolean", "string", "true"), ("boolean", "string", "yes")]
    for stored, new, value in cases:
        df = spark.createDataFrame([(value,)], f"c {new}")
        held, rest = df.select(*split_values("c", kind(stored), kind(new))).first()
        assert (held is None) != (rest is None)
        assert rest is None or rest == value


def test_keys_and_partitions_may_only_widen(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, [(1, 5, 1)], "id int, v int, day int")
    merge(spark, path, [(2**40, 6, 2), (1, 7, 1)], "id bigint, v int, day bigint")
    assert rows_of(spark, path, "id", "v", "day") == [(1, 7, 1), (2**40, 6, 2)]
    with pytest.raises(ValueError, match="id is stored as bigint"):
        merge(spark, path, [("1", 5, 1)], "id string, v int, day int")
    other = str(tmp_path / "dates")
    merge(spark, other, [(1, date(2024, 1, 1))], "id int, day date")
    with pytest.raises(ValueError, match="partition column day"):
        merge(spark, other, [(1, datetime(2024, 1, 1))], "id int, day timestamp_ntz")


def test_names_that_differ_in_case_are_one_column(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, [(1, "a", 1)], "id int, v string, day int")
    merge(spark, path, [(1, "b", 1), (2, "c", 2)], "ID int, V string, Day int")
    assert stored_columns(spark, path).names == ["id", "v", "day"]
    assert rows_of(spark, path, "id", "v", "day") == [(1, "b", 1), (2, "c", 2)]


@pytest.mark.parametrize("partition_by", [[], DAY])
def test_a_table_without_rows_can_be_merged_into(spark, tmp_path, partition_by):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, day int")
    for _ in range(2):
        merge_into(spark, path, batch.limit(0), KEYS, ["id"], partition_by)
        assert read_stored(spark, path).count() == 0 and stored_columns(spark, path).names == ["id", "v", "day"]
    merge_into(spark, path, batch, KEYS, ["id"], partition_by)
    assert read_stored(spark, path).count() == 2
    full_refresh(spark, path, batch.limit(0), KEYS, ["id"], partition_by)
    assert read_stored(spark, path).count() == 0
    merge_into(spark, path, batch, KEYS, ["id"], partition_by)
    merge_into(spark, path, batch.withColumn("v", F.lit("c")), KEYS, ["id"], partition_by)
    assert rows_of(spark, path, "id", "v", "day") == [(1, "c", 1), (2, "c", 2)]


def test_a_promotion_cut_off_before_its_files_moved_reads_as_before(spark, tmp_path, monkeypatch):
    from stratawork.operators import merge as module

    path = str(tmp_path / "t")
    merge(spark, path, [(1, 5, 1), (2, 5, 2)], "id int, v int, day int")
    with monkeypatch.context() as patch:
        patch.setattr(module, "_publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError):
            merge(spark, path, [(2, 2**40, 2)], "id int, v bigint, day int")
    assert rows_of(spark, path, "id", "v") == [(1, 5), (2, 5)]
    merge(spark, path, [(3, 6, 3)], "id int, v int, day int")
    assert rows_of(spark, path, "id", "v") == [(1, 5), (2, 2**40), (3, 6)]


def test_read_of_a_table_that_is_not_there(spark, tmp_path):
    with pytest.raises(ValueError, match="no table"):
        read_stored(spark, str(tmp_path / "none"))
    assert promoted(DateType(), TimestampNTZType()) == TimestampNTZType()
