"""DataFrame operators."""

from .evolve import fitted, promoted, read_stored, side_name, stored_columns
from .freshness import (
    Step,
    affected_partitions,
    change_set_key,
    changed_sources,
    footer_aggregates,
    freshness,
    freshness_status,
    last_success_start,
    latest_observation,
    observations,
    recompute_chain,
    recompute_partitions,
    stored_freshness,
    stored_max,
)
from .joins import (
    build_fact,
    common_type,
    flatten_star,
    join_reference,
    lookup,
    measured_bytes,
    reconcile_by_digest,
    reconcile_keys,
    with_codes,
)
from .members import dimension, with_unknown_members
from .merge import full_refresh, latest_per_key, merge_into, merge_latest, merge_upsert
from .quality import (
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
    declare,
    orphan_rows,
    require_passed,
    run_suite,
    store_failures,
    violations,
)
from .reshape import code_list, unpivot_by_codes
from .rollup import calendar_rollup, daily_rollup, keep_rollup, rollup_states, rollup_values, row_count_latest
from .runlog import (
    append_metadata,
    execution_rows,
    freshness_rows,
    invocation_rows,
    manifest_node_rows,
    metadata_datasets,
    node_rows,
    read_manifests,
    run_summary,
    slowest,
    total_runtime,
    with_outcome,
)
from .sequence import dense_sequence, dense_values
from .staging import describe_columns, typed
from .write import layer_schema, materialise, path_exists, with_curve, write_table

__all__ = [name for name in dir() if not name.startswith("_")]
