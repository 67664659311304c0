"""Declared schemas. New optional fields are appended; readers fill them with null."""

from __future__ import annotations

TABLES = {
    "crawls": "crawl_id string, run_id string, site string, config_file string, start_url string, "
    "schema_version string, engine_version string, strategy string, max_pages int, max_depth int, "
    "auth_used boolean, pages_crawled int, pages_failed int, runtime_seconds double, "
    "started_at timestamp_ntz, finished_at timestamp_ntz, arrived_at timestamp_ntz",
    "page_nodes": "page_id bigint, crawl_id string, site string, url string, depth int, "
    "out_links array<string>, requested_url string, final_url string, title string, "
    "extracted_at string, arrived_at timestamp_ntz, deleted_at timestamp_ntz",
    "elements": "element_id bigint, crawl_id string, site string, url string, pos int, "
    "category string, tag string, role string, accessible_name string, text string, "
    "visible boolean, enabled boolean, "
    "bounding_box struct<x: double, y: double, width: double, height: double>, "
    "attributes map<string, string>, dom_path string, sibling_ordinal int, landmark string, "
    "shadow_depth int, frame string, frame_path string, ui_type string, "
    "options array<struct<label: string, value: string, selected: boolean, disabled: boolean>>, "
    "option_count int, states map<string, string>, value string, parent_path string, "
    "controls array<string>, described_by string, group_name string, owner_form string, "
    "column_names array<string>, row_count int, clip_screenshot string, source string, "
    "arrived_at timestamp_ntz, deleted_at timestamp_ntz",
    "nav_edges": "edge_id bigint, crawl_id string, site string, source string, target string, "
    "label string, region string, control string, arrived_at timestamp_ntz",
    "crawl_files": "file_id bigint, feed string, file_no int, delivered_at timestamp_ntz, "
    "line_no int, record string",
    "raw_captures": "capture_id bigint, site string, captured_at timestamp_ntz, "
    "arrived_at timestamp_ntz, body string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "site string, title string, updated_at timestamp_ntz",
    "person_names": "name_part string, part_kind string",
    "pii_labels": "sample_id int, text string, kind string, start_pos int, end_pos int",
    "text_labels": "sample_id int, text string, kind string",
    "common_words": "lang string, word string",
    "mix_targets": "mix_id int, source string, target_share double, max_repeats int",
}
