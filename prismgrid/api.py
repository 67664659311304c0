"""The public functions in one place; loaded on first use."""

from __future__ import annotations

import importlib

_WHERE = {
    "operators.drift": "schema_changes lifespans file_footers unified_records alias_table",
    "operators.orphans": "find_orphans orphan_report OrphanLog deliveries",
    "operators.snapshots": "snapshot_changes comparisons",
    "operators.shred": "capture_records capture_table unread_bodies",
    "operators.components": "fingerprints shared_components repeated_components components regions navigation_menus analysis_stats page_counts inventory_screens type_coverage unnamed_controls actions semantic_labels refine_labels",
    "operators.relations": "element_links form_fields forms tables relation_stats",
    "operators.diff": "diff_pages diff_elements diff_components diff_stats crawl_pairs",
    "operators.navigation": "resolved_links not_captured adjacency orphan_screens bfs_depths egress_ledger link_destinations api_endpoints top_endpoints crawl_frontier modules in_scope",
    "operators.redaction": "redact narrowest_targets",
    "operators.runs": "run_metrics run_outcomes retention_plan settle_runs auth_checks auth_verdict numbered run_index append_index",
    "operators.generation": "scenarios scenario_steps page_records",
    "operators.correlate": "correlate_elements correlate_routes correlate_endpoints",
    "operators.uistate": "component_targets revealed classify_states distinct_states build_states content_hash attach_crops probe_plan tab_allowed",
    "sources.html": "elements_of headings_of unparsed_pages",
    "sources.code": "read_tree",
    "sources.tables": "table",
    "settings": "Settings load describe_envelope describe_session output_folder",
    "sources.sinks": "save elements_csv controls_csv write_documents urls_text find_captures",
    "reports": "crawl_report correlation_report scoping_notes change_summary test_skeleton test_skeleton_ts",
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names.split()}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"prismgrid.{_MODULE[name]}"), name)


def __dir__():
    return __all__
