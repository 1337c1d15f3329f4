from __future__ import annotations

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from stratawork.operators import (
    describe_columns,
    full_refresh,
    latest_per_key,
    layer_schema,
    materialise,
    merge_into,
    merge_latest,
    merge_upsert,
    path_exists,
    write_table,
)
from stratawork.streaming import stream_merge

merge_module = sys.modules["stratawork.operators.merge"]

SCHEMA = "id bigint, value string, load string, day date"
KEYS, ORDER = ["id", "day"], ["load"]


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id bigint, value string, load string, day string").withColumn(
        "day", F.col("day").cast("date")
    )


def content(df):
    return sorted((r.id, r.value, r.load, r.day.isoformat()) for r in df.collect())


def stored(spark, path):
    return content(spark.read.schema(SCHEMA).parquet(path))


FIRST = [(1, "a", "1", "2024-01-01"), (2, "b", "1", "2024-01-02"), (3, "c", "1", "2024-01-03")]
SECOND = [(2, "B", "2", "2024-01-02"), (3, "C", "2", "2024-01-03"), (3, "C0", "1", "2024-01-03"), (4, "d", "2", "2024-01-04")]
MERGED = [
    (1, "a", "1", "2024-01-01"),
    (2, "B", "2", "2024-01-02"),
    (3, "C", "2", "2024-01-03"),
    (4, "d", "2", "2024-01-04"),
]


def test_latest_per_key_breaks_ties_by_all_columns(spark):
    df = rows(spark, (1, "a", "2", "2024-01-01"), (1, "b", "2", "2024-01-01"), (1, "z", "1", "2024-01-01"))
    for shuffled in (df, df.orderBy("value"), df.orderBy(F.desc("value"))):
        assert content(latest_per_key(shuffled, KEYS, ORDER)) == [(1, "b", "2", "2024-01-01")]


def test_hot_key_is_limited_before_the_shuffle(spark, tmp_path):
    # A third of all rows carry one key.
    spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"), F.col("id").alias("load")
    ).repartition(8).write.parquet(str(tmp_path / "hot"))
    latest = latest_per_key(spark.read.parquet(str(tmp_path / "hot")), ["key"], ["load"])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Partial")
    assert latest.filter("key = 7").first().load == 29_997
    assert latest.count() == 20_000 + 1 - (7 % 3 != 0)


def test_upsert_and_twice_is_once(spark):
    first, second = rows(spark, *FIRST), rows(spark, *SECOND)
    once = merge_upsert(first, second, KEYS, ORDER)
    assert content(once) == MERGED
    assert content(merge_upsert(once, second, KEYS, ORDER)) == MERGED


def test_newest_wins_in_any_order(spark):
    first, second = rows(spark, *FIRST), rows(spark, *SECOND)
    assert content(merge_latest(merge_latest(first, second, KEYS, ORDER), first, KEYS, ORDER)) == MERGED
    assert content(merge_latest(second, first, KEYS, ORDER)) == MERGED


def test_merge_into_a_partitioned_table(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into(spark, path, rows(spark, *FIRST), KEYS, ORDER, ["day"])
    untouched = sorted((tmp_path / "t" / "day=2024-01-01").iterdir())
    for _ in range(2):
        merge_into(spark, path, rows(spark, *SECOND), KEYS, ORDER, ["day"])
        assert stored(spark, path) == MERGED
    assert sorted((tmp_path / "t" / "day=2024-01-01").iterdir()) == untouched
    for folder in ("__staging", "__batch"):
        assert not path_exists(spark, path + folder)


def test_merge_into_an_unpartitioned_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for load in (FIRST, SECOND, SECOND):
        merge_into(spark, path, rows(spark, *load), KEYS, ORDER)
    assert stored(spark, path) == MERGED


def test_partition_column_must_be_part_of_the_key(spark, tmp_path):
    with pytest.raises(ValueError, match="part of the key"):
        merge_into(spark, str(tmp_path / "t"), rows(spark, *FIRST), ["id"], ORDER, ["day"])


def test_a_cut_off_swap_is_repeated_by_the_next_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into(spark, path, rows(spark, *FIRST), KEYS, ORDER, ["day"])
    # What a job leaves that dies in the swap: complete staged partitions, the table not yet replaced.
    staged = rows(spark, (2, "B", "2", "2024-01-02"))
    write_table(staged, f"{path}__staging", "replace", ["day"])
    assert path_exists(spark, f"{path}__staging/_SUCCESS")
    merge_into(spark, path, rows(spark, (9, "z", "3", "2024-01-09")), KEYS, ORDER, ["day"])
    assert stored(spark, path) == [FIRST[0], (2, "B", "2", "2024-01-02"), FIRST[2], (9, "z", "3", "2024-01-09")]


def test_incomplete_staging_is_ignored(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into(spark, path, rows(spark, *FIRST), KEYS, ORDER, ["day"])
    write_table(rows(spark, (2, "X", "0", "2024-01-02")), f"{path}__staging", "replace", ["day"])
    (tmp_path / "t__staging" / "_SUCCESS").unlink()
    merge_into(spark, path, rows(spark, *SECOND), KEYS, ORDER, ["day"])
    assert stored(spark, path) == MERGED


def test_full_refresh_drops_older_rows_unless_replayed(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into(spark, path, rows(spark, *FIRST), KEYS, ORDER, ["day"])
    full_refresh(spark, path, rows(spark, *SECOND), KEYS, ORDER, ["day"])
    assert stored(spark, path) == MERGED[1:]
    full_refresh(spark, path, rows(spark, *SECOND), KEYS, ORDER, ["day"], replay_from=rows(spark, *FIRST))
    assert stored(spark, path) == MERGED


def test_a_failing_load_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into(spark, path, rows(spark, *FIRST), KEYS, ORDER, ["day"])
    broken = rows(spark, *SECOND).withColumn("value", F.raise_error(F.lit("bad row")))
    for load in (full_refresh, merge_into):
        with pytest.raises(Exception, match="bad row"):
            load(spark, path, broken, KEYS, ORDER, ["day"])
        assert stored(spark, path) == FIRST


def test_a_null_key_fails_and_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    for bad in ((None, "x", "2", "2024-01-01"), (1, "x", "2", None)):
        with pytest.raises(Exception, match="is NULL"):
            merge_into(spark, path, rows(spark, *FIRST, bad), KEYS, ORDER, ["day"])
        assert not path_exists(spark, path)
    merge_into(spark, path, rows(spark, *FIRST), KEYS, ORDER, ["day"])
    with pytest.raises(Exception, match="is NULL"):
        merge_into(spark, path, rows(spark, *SECOND, bad), KEYS, ORDER, ["day"])
    assert stored(spark, path) == FIRST
    merge_into(spark, path, rows(spark, *SECOND), KEYS, ORDER, ["day"])
    assert stored(spark, path) == MERGED


def test_a_cut_off_first_load_is_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(rows(spark, *FIRST), f"{path}__staging", "replace", ["day"])
    merge_into(spark, path, rows(spark, *SECOND), KEYS, ORDER, ["day"])
    assert stored(spark, path) == MERGED


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(rows(spark, *FIRST), path, "replace", ["day"])
    write_table(rows(spark, (8, "x", "9", "2024-01-03")), path, "append", ["day"])
    assert len(stored(spark, path)) == 4
    write_table(rows(spark, (8, "x", "9", "2024-01-03")), path, "overwrite", ["day"])
    assert stored(spark, path) == [*FIRST[:2], (8, "x", "9", "2024-01-03")]
    write_table(rows(spark, (8, "x", "9", "2024-01-03")), path, "replace", ["day"])
    assert len(stored(spark, path)) == 1


def test_clustered_files_are_sorted_and_a_hot_value_spans_files(spark, tmp_path):
    path = str(tmp_path / "c")
    hot = spark.range(20_000).select(F.when(F.col("id") < 15_000, 5).otherwise(F.col("id") % 9).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_table(hot, path, "replace", cluster_by=["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stats = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
    assert sum(s.lo <= 5 <= s.hi for s in stats) > 1
    bounds = sorted((s.lo, s.hi) for s in stats)
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    assert spark.read.parquet(path).count() == 20_000


def test_a_hot_partition_is_split_over_files(spark, tmp_path):
    path = str(tmp_path / "p")
    # A third of the rows fall on one day; the other days are small.
    noise = F.sha2(F.col("id").cast("string"), 512)
    days = spark.range(60_000).select("id", noise.alias("noise"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("day"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        write_table(days.repartition(8), path, "replace", ["day"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "p").glob("day=*")}
    assert len(files) == 20 and files["day=0"] > 2
    assert spark.read.parquet(path).count() == 60_000


def test_layers_are_shared_or_an_owners(spark):
    assert [layer_schema("stg"), layer_schema(None), layer_schema("stg", "ann"), layer_schema(None, " ann ")] == ["_STG", "_TMP", "ANN_STG", "ANN"]
    assert layer_schema("int", shared="wh_{layer}") == "wh_INT"


def test_a_batch_keeps_and_adds_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into(spark, path, spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 1)], "id int, v string, extra string, day int"), ["id", "day"], ["v"], ["day"])
    merge_into(spark, path, spark.createDataFrame([(2, "c", 5.0, 1), (3, "d", 6.0, 2)], "id int, v string, more double, day int"), ["id", "day"], ["v"], ["day"])
    rows = spark.read.option("mergeSchema", "true").parquet(path).select("id", "v", "extra", "more", "day").collect()
    assert sorted(map(tuple, rows)) == [(1, "a", "x", None, 1), (2, "c", None, 5.0, 1), (3, "d", None, 6.0, 2)]
    with pytest.raises(ValueError, match="stored as"):
        merge_into(spark, path, spark.createDataFrame([("1", "a", 1)], "id string, v string, day int"), ["id", "day"], ["v"], ["day"])
    assert spark.read.parquet(path).count() == 3


def test_a_blank_partition_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "")], "id int, part string")
    with pytest.raises(Exception, match="blank"):
        merge_into(spark, path, rows, ["id", "part"], ["id"], ["part"])
    assert not os.path.exists(path)


def test_a_cut_off_refresh_is_repeated_as_a_whole(spark, tmp_path, monkeypatch):
    path, keys = str(tmp_path / "t"), ["id", "day"]
    merge_into(spark, path, spark.createDataFrame([(1, 1), (2, 2)], "id int, day int"), keys, ["id"], ["day"])
    with monkeypatch.context() as patch:
        patch.setattr(merge_module, "_publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError):
            full_refresh(spark, path, spark.createDataFrame([(3, 3)], "id int, day int"), keys, ["id"], ["day"])
    merge_into(spark, path, spark.createDataFrame([(4, 3)], "id int, day int"), keys, ["id"], ["day"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(3, 3), (4, 3)]


@pytest.mark.parametrize("partition_by", [[], ["day"]])
def test_a_failing_replace_leaves_the_table(spark, tmp_path, partition_by):
    path = str(tmp_path / "t")
    write_table(spark.createDataFrame([(1, 1), (2, 2)], "id int, day int"), path, "replace", partition_by)
    failing = spark.range(3).selectExpr("cast(id as int) as id", "if(id = 2, cast(raise_error('no') as int), 1) as day")
    with pytest.raises(Exception, match="no"):
        write_table(failing, path, "replace", partition_by)
    assert spark.read.parquet(path).count() == 2
    write_table(spark.createDataFrame([(5, 5)], "id int, day int"), path, "replace", partition_by)
    assert spark.read.parquet(path).select("id").collect()[0].id == 5 and sorted(os.listdir(tmp_path)) == ["t"]


def test_an_exposed_view_is_seen_by_other_sessions(spark, tmp_path):
    view = materialise(spark.range(3), str(tmp_path), "exp", "exp__shop__seen", "viewer", catalog=True)
    other = spark.newSession()
    assert view.count() == other.table("viewer_exp.exp__shop__seen").count() == 3
    kinds = {r.name: r.tableType for r in other.catalog.listTables("viewer_exp")}
    assert kinds["exp__shop__seen"] == "VIEW"
    again = materialise(spark.range(0), str(tmp_path), "exp", "exp__shop__seen", "viewer", catalog=True,
                        view_sql="SELECT id * 2 AS double_id FROM viewer_exp.exp__shop__seen__rows")
    assert sorted(r.double_id for r in again.collect()) == [0, 2, 4]


def test_materialise_by_layer(spark, tmp_path):
    table = materialise(spark.range(3), str(tmp_path), "mrt", "dim__shop__three")
    assert table.count() == 3
    assert (tmp_path / "_MRT" / "dim__shop__three" / "_SUCCESS").exists()
    view = materialise(table, str(tmp_path), "exp", "exp__shop__three")
    assert spark.table("_exp__exp__shop__three").count() == view.count() == 3
    with pytest.raises(ValueError):
        materialise(table, str(tmp_path), "gold", "x")


def test_materialise_in_the_catalog(spark, tmp_path):
    described = describe_columns(spark.range(3), {"id": "Number."})
    for _ in range(2):  # a rebuild replaces the table
        table = materialise(described, str(tmp_path), "stg", "stg__shop__three", "tester", catalog=True)
    assert table.count() == spark.table("tester_stg.stg__shop__three").count() == 3
    parts = spark.range(6).selectExpr("id", "id % 2 as part")
    split = materialise(parts, str(tmp_path), "stg", "stg__shop__split", "tester", partition_by=["part"], catalog=True)
    assert split.filter("part = 1").count() == 3
    assert (tmp_path / "TESTER_STG" / "stg__shop__split" / "part=1").exists()
    comments = {r.col_name: r.comment for r in spark.sql("DESCRIBE tester_stg.stg__shop__three").collect()}
    assert comments["id"] == "Number."


def _drop(folder, name, *values):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps(dict(zip(("id", "value", "load", "day"), v))) for v in values]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_stream_merges_new_folders_and_survives_replay(spark, tmp_path):
    landing, target = tmp_path / "landing", str(tmp_path / "t")

    def run(state):
        stream_merge(
            spark, str(landing), SCHEMA, target, KEYS, ORDER, str(tmp_path / state), ["day"], max_files=1
        ).awaitTermination()

    _drop(landing / "events__2", "a.jsonl", *SECOND)
    run("state")
    # The older load arrives late: it adds what is missing and overwrites nothing newer.
    _drop(landing / "events__1", "b.jsonl", *FIRST)
    run("state")
    assert stored(spark, target) == MERGED
    run("another-state")  # everything again, from a fresh checkpoint
    assert stored(spark, target) == MERGED
