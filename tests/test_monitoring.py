from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratawork.operators import (
    affected_partitions,
    append_metadata,
    change_set_key,
    changed_sources,
    execution_rows,
    freshness,
    freshness_rows,
    invocation_rows,
    last_success_start,
    latest_observation,
    metadata_datasets,
    node_rows,
    observations,
    recompute_partitions,
    run_summary,
    slowest,
    total_runtime,
    with_outcome,
    write_table,
)
from stratawork.schemas import MANIFEST, METADATA, RUN_RESULT

NOW = datetime(2026, 9, 28, 12)
STARTED = datetime(2026, 9, 28, 6)
JOB = "build_fresher"


def moments(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "at string").select(F.col("at").cast("timestamp_ntz"))


def test_freshness_thresholds(spark):
    sources = {
        "fresh": (moments(spark, "2026-09-26 12:00:00"), F.col("at")),
        "late": (moments(spark, "2026-09-26 11:59:59"), F.col("at")),
        "stale": (moments(spark, "2026-09-21 11:59:59", "2026-09-01 00:00:00"), F.col("at")),
        "empty": (moments(spark), F.col("at")),
        "untracked": (spark.range(1), None),
    }
    found = {r.source: (r.status, r.age_seconds) for r in freshness(sources, NOW).collect()}
    assert found == {
        "fresh": ("pass", 172800.0),
        "late": ("warn", 172801.0),
        "stale": ("error", 604801.0),
        "empty": ("runtime error", None),
    }
    tight = freshness(sources, NOW, timedelta(hours=1), timedelta(hours=2))
    assert {r.status for r in tight.collect()} == {"error", "runtime error"}
    assert sorted(r.source for r in observations(freshness(sources, NOW)).collect()) == ["fresh", "late", "stale"]
    with pytest.raises(ValueError):
        freshness({"untracked": (spark.range(1), None)}, NOW)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, max_loaded_at string, at string").select(
        "source", "max_loaded_at", F.col("at").cast("timestamp_ntz").alias("observed_at")
    )


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), "job string, status string, at string").select(
        "job", "status", F.col("at").cast("timestamp_ntz").alias("start_time")
    )


SIX, SEVEN = "2026-09-28T06:00:00", "2026-09-28T07:00:00"


def values(df):
    return {r.source: r.max_loaded_at for r in df.collect()}


def test_latest_observation(spark):
    rows = [("k", SIX, "2026-09-28 06:05:00"), ("k", SEVEN, "2026-09-28 07:05:00"), ("o", SIX, "2026-09-28 06:05:00")]
    assert values(latest_observation(log(spark, *rows))) == {"k": SEVEN, "o": SIX}
    assert values(latest_observation(log(spark, *rows), datetime(2026, 9, 28, 7))) == {"k": SIX, "o": SIX}
    # The latest one has no value: the source is out, an older value does not stand in.
    rows.append(("k", None, "2026-09-28 08:05:00"))
    assert values(latest_observation(log(spark, *rows))) == {"o": SIX}


def test_changed_is_measured_from_the_last_successful_run(spark):
    none = runs(spark, ("other", "SUCCESS", "2026-09-28 09:00:00"))
    assert values(changed_sources(log(spark), none, JOB)) == {}
    first = ("k", SIX, "2026-09-28 06:05:00")
    assert values(changed_sources(log(spark, first), none, JOB)) == {"k": SIX}  # never built
    built = ("build_fresher", "SUCCESS", "2026-09-28 06:10:00")
    assert values(changed_sources(log(spark, first), runs(spark, built), JOB)) == {}
    again = ("k", SIX, "2026-09-28 06:35:00")
    assert values(changed_sources(log(spark, first, again), runs(spark, built), JOB)) == {}
    newer = ("k", SEVEN, "2026-09-28 07:05:00")
    failed = ("build_fresher", "FAILURE", "2026-09-28 07:10:00")
    assert values(changed_sources(log(spark, first, again, newer), runs(spark, built, failed), JOB)) == {"k": SEVEN}
    assert last_success_start(runs(spark, built, failed), JOB).first()[0] == datetime(2026, 9, 28, 6, 10)
    # Could not be queried: that is no new data.
    broken = ("k", None, "2026-09-28 08:05:00")
    assert values(changed_sources(log(spark, first, newer, broken), runs(spark, built), JOB)) == {}


def test_change_set_key_is_sorted(spark):
    rows = spark.createDataFrame([("b", SEVEN), ("a", SIX)], "source string, max_loaded_at string")
    assert change_set_key(rows).first()[0] == f"a@{SIX}|b@{SEVEN}"
    many = spark.range(10_001).selectExpr("concat('s', id) as source", "'1' as max_loaded_at")
    assert change_set_key(many).first()[0].count("|") == 10_000


def test_recompute_only_what_got_newer(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame(
        [("d1", 1, "2026-09-01 00:00:00"), ("d2", 2, "2026-09-01 00:00:00"), ("d2", 3, "2026-09-05 00:00:00")],
        "day string, v int, at string",
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))

    def model(df):
        return df.groupBy("day").agg(F.sum("v").alias("v"))

    write_table(model(rows).withColumn("v", F.lit(0).cast("bigint")), path, "replace", ["day"])
    since = datetime(2026, 9, 2)
    assert [r.day for r in affected_partitions(rows, "at", since, ["day"]).collect()] == ["d2"]
    assert recompute_partitions(spark, rows, "at", since, ["day"], model, path) == 1
    read = spark.read.schema("v bigint, day string").parquet(path)
    assert sorted((r.day, r.v) for r in read.collect()) == [("d1", 0), ("d2", 5)]
    assert recompute_partitions(spark, rows, "at", NOW, ["day"], model, path) == 0


def test_recompute_rebuilds_the_null_partition_and_removes_an_emptied_one(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame(
        [(None, 1, "2026-09-05 00:00:00"), ("a/b", -1, "2026-09-05 00:00:00"), ("c", 3, "2026-09-01 00:00:00")],
        "day string, v int, at string",
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    stale = spark.createDataFrame([(0, None), (5, "a/b"), (0, "c")], "v bigint, day string")
    write_table(stale, path, "replace", ["day"])

    def model(df):
        return df.filter("v > 0").groupBy("day").agg(F.sum("v").alias("v"))

    assert recompute_partitions(spark, rows, "at", datetime(2026, 9, 2), ["day"], model, path) == 2
    found = spark.read.schema("v bigint, day string").parquet(path).collect()
    assert {(r.day, r.v) for r in found} == {(None, 1), ("c", 0)}


def result(name, kind="model", status="success", **more):
    return {
        "status": status,
        "thread_id": "Thread-1",
        "execution_time": 1.5,
        "message": "it's \"done\" \\ ok",
        "failures": None,
        "adapter_response": {"rows_affected": 12, "code": "SUCCESS"},
        "timing": [
            {"name": "compile", "started_at": "2026-09-28T06:00:01.000001Z", "completed_at": "2026-09-28T06:00:02Z"},
            {"name": "execute", "started_at": "2026-09-28T06:00:02Z", "completed_at": "2026-09-28T06:00:03.5Z"},
        ],
        "node": {
            "unique_id": f"{kind}.shop.{name}",
            "resource_type": kind,
            "schema": "_STG",
            "name": name,
            "alias": name,
            "config": {"materialized": "table", "full_refresh": None},
        },
        **more,
    }


def read_json(spark, tmp_path, rows, schema):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    return spark.read.schema(schema).json(str(tmp_path / "in.jsonl"))


def test_execution_rows(spark, tmp_path):
    rows = [
        result("a"),
        result("b", status="skipped", timing=[], adapter_response={}),
        result("c", adapter_response={"rows_affected": "-"}),
        result("t", kind="test", status="fail", failures=3),
        result("s", kind="seed"),
        result("n", kind="snapshot"),
    ]
    results = read_json(spark, tmp_path, rows, RUN_RESULT)
    models = {r.name: r for r in execution_rows(results, "model", "inv", STARTED, full_refresh=True).collect()}
    assert set(models) == {"a", "b", "c"}
    a = models["a"]
    assert (a.compile_started_at, a.query_completed_at) == (
        datetime(2026, 9, 28, 6, 0, 1, 1),
        datetime(2026, 9, 28, 6, 0, 3, 500000),
    )
    assert (a.rows_affected, a.was_full_refresh, a.message) == (12, True, 'it\'s "done" \\ ok')
    assert json.loads(a.adapter_response) == {"rows_affected": 12, "code": "SUCCESS"}
    assert models["b"].compile_started_at is None and models["b"].rows_affected is None
    assert models["c"].rows_affected is None
    tests = execution_rows(results, "test", "inv", STARTED)
    assert tests.first().failures == 3
    for kind in ("model", "seed", "snapshot", "test"):
        found = execution_rows(results, kind, "inv", STARTED)
        assert found.count() > 0
        declared = StructType.fromDDL(METADATA[f"{kind}_executions"])
        assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in declared]


def test_node_rows(spark, tmp_path):
    def node(kind, name, **more):
        return {"unique_id": f"{kind}.shop.{name}", "resource_type": kind, "name": name, "schema": "_STG", **more}

    manifest = {
        "nodes": {
            "model.shop.a": node(
                "model", "a", depends_on={"nodes": ["source.shop.x"]}, tags=["t1", "t2"], alias="a",
                checksum={"name": "sha256", "checksum": "c0"}, original_file_path="models/a.sql",
                config={"materialized": "view", "meta": {"owner": "me"}},
            ),
            "test.shop.b": node("test", "b", original_file_path="tests/b.sql", depends_on={"nodes": []}),
            "seed.shop.c": node("seed", "c"),
            "snapshot.shop.d": node("snapshot", "d", config={"strategy": "check"}),
        },
        "sources": {"source.shop.x": node("source", "x", source_name="shop", freshness={"warn_after": None})},
        "exposures": {"exposure.shop.e": node("exposure", "e", owner={"name": "o"}, type="dashboard")},
    }
    frame = read_json(spark, tmp_path, [manifest], MANIFEST)
    found = {kind: node_rows(frame, kind, "inv", STARTED).collect() for kind in ("model", "seed", "snapshot", "test", "source", "exposure")}
    assert all(len(rows) == 1 for rows in found.values())
    model = found["model"][0]
    assert (model.depends_on_nodes, model.tags, model.checksum, model.path) == (["source.shop.x"], ["t1", "t2"], "c0", "models/a.sql")
    assert (model.materialization, json.loads(model.meta)) == ("view", {"owner": "me"})
    assert json.loads(model.all_results) == manifest["nodes"]["model.shop.a"]
    assert found["test"][0].test_path == "tests/b.sql" and found["snapshot"][0].strategy == "check"
    assert json.loads(found["source"][0].freshness) == {"warn_after": None}
    assert json.loads(found["exposure"][0].owner) == {"name": "o"}
    assert node_rows(frame, "model", "inv", STARTED, with_all_results=False).first().all_results is None


def test_invocations_and_freshness_rows(spark, tmp_path):
    raw = spark.createDataFrame(
        [("inv", "", "7", '{"a": 1}', "{")],
        "command_invocation_id string, dbt_cloud_job_id string, dbt_cloud_run_id string, invocation_args string, env_vars string",
    )
    row = invocation_rows(raw).first()
    assert (row.dbt_cloud_job_id, row.dbt_cloud_run_id, row.invocation_args, row.env_vars) == (None, "7", '{"a": 1}', None)
    checked = freshness({"k": (moments(spark, "2026-09-28 11:00:00"), F.col("at"))}, NOW)
    rows = freshness_rows(checked, "inv", STARTED)
    for _ in range(2):
        append_metadata(rows, str(tmp_path), "source_freshness")
    stored = spark.read.schema(METADATA["source_freshness"]).parquet(str(tmp_path / "source_freshness"))
    assert stored.count() == 2 and stored.first().age_seconds == 3600.0


def test_which_tables_a_command_writes():
    assert metadata_datasets("freshness") == ["source_freshness", "invocations"]
    assert "models" in metadata_datasets("build") and "models" not in metadata_datasets("test")
    assert metadata_datasets("run", has_results=False)[0] == "invocations"
    assert sorted({d for c in ("freshness", "build") for d in metadata_datasets(c)}) == sorted(METADATA)
    assert len(METADATA) == 12


def test_summary(spark):
    executions = spark.createDataFrame(
        [
            ("model", "success", 100.04, "a"), ("model", "success", 79.94, "b"), ("model", "error", 999.0, "c"),
            ("model", "skipped", 0.0, "d"), ("test", "pass", 0.0, "e"), ("test", "fail", 0.0, "f"),
            ("test", "error", 0.0, "g"), ("test", "warn", 0.0, "h"), ("seed", "success", 0.0, "i"),
            ("snapshot", "success", 0.0, "j"), ("model", "success", 79.94, "aa"), ("model", "success", None, "n"),
        ],
        "resource_type string, status string, execution_time double, name string",
    )
    counts = {r.resource_type: (r.passed, r.failed, r.warned, r.skipped) for r in run_summary(executions).collect()}
    assert counts == {"model": (4, 1, 0, 1), "test": (1, 2, 1, 0), "seed": (1, 0, 0, 0)}
    assert [r.name for r in slowest(executions, 3).collect()] == ["a", "aa", "b"]
    assert sorted(r.name for r in with_outcome(executions, "test", "failed").collect()) == ["f", "g"]
    # 179.98 s is 3m 0.0s, never 2m 60.0s.
    short = executions.filter("name in ('a', 'b')")
    assert tuple(map(float, total_runtime(short).first())) == (180.0, 3.0, 0.0)
    assert tuple(map(float, total_runtime(executions.limit(0)).first())) == (0.0, 0.0, 0.0)
