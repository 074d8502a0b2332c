"""Operators: functions from DataFrame to DataFrame."""

from .cleaning import clean_orders, rejected_orders
from .log_history import attribute_events, failed_runs, log_stage_durations, run_wall_times
from .reports import (
    clean_summary,
    dimension_rows,
    distinct_values,
    orders_by_date,
    region_breakdown,
    sales_breakdown,
    sales_by,
    sales_summary_long,
    sales_totals,
    summary_row,
    top_key,
)
from .rules import (
    Rule,
    blank_counts,
    order_issues,
    order_rules,
    positive,
    region_profile,
    required,
    row_issues,
    unique_regions,
    validation_report,
)
from .run_history import (
    assign_runs,
    last_results,
    latest_runs,
    result_for,
    run_ids,
    run_manifest,
    run_parameters,
    run_starts,
    run_statuses,
    stages_not_run,
    unknown_statuses,
    upstream_outputs,
    with_durations,
    with_exit_status,
    with_result_defaults,
    with_runs,
    with_succeeded,
)
from .stage_graph import (
    dependency_edges,
    duplicate_stages,
    graph_findings,
    graph_verdicts,
    lookup_dependencies,
    missing_dependencies,
    normalized_stages,
    orderable_stages,
    place_stages,
    stage_inputs,
    stage_issues,
    stage_levels,
    topological_order,
    unresolved_stages,
)

__all__ = [name for name in dir() if not name.startswith("_")]
