"""Declared schemas: landed observations, run artifacts and the twelve run-metadata tables."""

from __future__ import annotations

# Landed rows of the hourly weather source. `ww` and `ix` are NULL in every row of a recent window.
CLIMATE_HOURLY = (
    "station_code bigint, date string, hour bigint, t bigint, fh bigint, rh bigint, q bigint, u bigint, "
    "ww bigint, ix bigint, _load_id string"
)

# Run artifacts as JSON. A nested object read as string keeps its JSON text.
RUN_RESULT = (
    "status string, thread_id string, execution_time double, message string, failures int, adapter_response string, "
    "timing array<struct<name: string, started_at: string, completed_at: string>>, "
    "node struct<unique_id: string, resource_type: string, schema: string, name: string, alias: string, "
    "config: struct<materialized: string, full_refresh: boolean>>"
)
MANIFEST = "nodes map<string, string>, sources map<string, string>, exposures map<string, string>"
NODE = (
    "unique_id string, resource_type string, database string, schema string, name string, alias string, "
    "package_name string, original_file_path string, description string, tags array<string>, "
    "depends_on struct<nodes: array<string>>, checksum struct<checksum: string>, "
    "config struct<materialized: string, strategy: string, meta: string>, "
    "source_name string, loader string, identifier string, loaded_at_field string, freshness string, "
    "type string, owner string, maturity string, url string"
)

# The columns of the run-metadata tables, in order. JSON objects are kept as text.
_RUN = "command_invocation_id string, node_id string, run_started_at timestamp_ntz"
_TIMES = (
    "was_full_refresh boolean, thread_id string, status string, compile_started_at timestamp_ntz, "
    "query_completed_at timestamp_ntz, total_node_runtime double, rows_affected int"
)
_EXECUTION = (
    f"{_RUN}, {_TIMES}, materialization string, schema string, name string, alias string, message string, "
    "adapter_response string"
)
METADATA = {
    "exposures": f"{_RUN}, name string, type string, owner string, maturity string, path string, description string, "
    "url string, package_name string, depends_on_nodes array<string>, tags array<string>, all_results string",
    "invocations": "command_invocation_id string, dbt_version string, project_name string, "
    "run_started_at timestamp_ntz, dbt_command string, full_refresh_flag boolean, target_profile_name string, "
    "target_name string, target_schema string, target_threads int, dbt_cloud_project_id string, "
    "dbt_cloud_job_id string, dbt_cloud_run_id string, dbt_cloud_run_reason_category string, "
    "dbt_cloud_run_reason string, env_vars string, dbt_vars string, invocation_args string, dbt_custom_envs string",
    "model_executions": _EXECUTION,
    "models": f"{_RUN}, database string, schema string, name string, depends_on_nodes array<string>, "
    "package_name string, path string, checksum string, materialization string, tags array<string>, meta string, "
    "alias string, all_results string",
    "seed_executions": _EXECUTION,
    "seeds": f"{_RUN}, database string, schema string, name string, package_name string, path string, "
    "checksum string, meta string, alias string, all_results string",
    "snapshot_executions": _EXECUTION,
    "snapshots": f"{_RUN}, database string, schema string, name string, depends_on_nodes array<string>, "
    "package_name string, path string, checksum string, strategy string, meta string, alias string, "
    "all_results string",
    "sources": f"{_RUN}, database string, schema string, source_name string, loader string, name string, "
    "identifier string, loaded_at_field string, freshness string, all_results string",
    "source_freshness": f"{_RUN}, status string, max_loaded_at timestamp_ntz, snapshotted_at timestamp_ntz, "
    "age_seconds double, execution_seconds double, thread_id string",
    "test_executions": f"{_RUN}, {_TIMES}, failures int, message string, adapter_response string",
    "tests": f"{_RUN}, name string, depends_on_nodes array<string>, package_name string, test_path string, "
    "tags array<string>, all_results string",
}
