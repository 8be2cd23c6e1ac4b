"""Schemas of the stored tables, as DDL."""

from __future__ import annotations

BLOCK = (
    "block_id string, doc_id string, block_type string, text string, "
    "section_path array<string>, page_or_index int, headers array<string>, "
    "cells array<string>, metadata map<string,string>"
)

FACT = (
    "fact_id string, entity_type string, entity_name string, field_name string, "
    "value_num double, value_text string, unit string, year int, source_doc_id string, "
    "source_block_id string, source_span string, confidence double, status string, "
    "metadata map<string,string>, pos bigint"
)

DOCUMENT = (
    "doc_id string, file_name string, doc_type string, upload_time timestamp, status string, "
    "document_role string, skip_extraction boolean, document_set_id string"
)

FILLED_CELL = (
    "task_id string, sheet_name string, cell_ref string, entity_name string, field_name string, "
    "value_num double, value_text string, fact_id string, confidence double, evidence_text string"
)

TEMPLATE_CELL = (
    "template string, sheet string, row int, col int, value string"
)

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"

DOCUMENT_STATUSES = ("uploaded", "parsing", "parsed", "failed")
REVIEW_STATUSES = ("pending_review", "confirmed", "rejected")
