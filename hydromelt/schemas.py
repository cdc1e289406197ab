"""Schemas of the tables the jobs exchange."""

from __future__ import annotations

CELLS = "file_id string, encoding string, ragged boolean, row_idx bigint, cells array<string>"

FLAT_TERMS = ("code string, name_ko string, name_en string, abbr string, synonyms string, "
              "unit string, category string, verified string, note string")

MEASUREMENT_ROW = (
    "kind string, source_row bigint, source_column string, source_column_index int, "
    "site_name string, outlet string, sample_type string, measured_on date, period_label string, "
    "item_code string, unit string, value_num decimal(18,6), value_text string, is_numeric boolean, "
    "reported_limit decimal(18,6), quality_flag string"
)

INGEST_META = (
    "kind string, dictionary_version string, dictionary_hash string, encoding_detected string, "
    "header_row int, source_rows bigint, measured_columns int"
)

LIMITS_CSV = (
    "standard_set string, item_code string, item_name string, region_grade string, scale string, "
    "limit_min string, limit_max string, unit string, legal_basis string, legal_article string, "
    "effective_from string, source string, note string"
)

REVIEW_LOG = ("dict_file string, code string, synonym string, source string, "
              "collected_at string, reviewer string")

VALUE_SUMMARY = "struct<row_count:bigint,distinct_count:bigint,samples:array<string>,all_unique:boolean>"
