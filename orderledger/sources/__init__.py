"""Scans, sinks, record numbers and the shared folder."""

from .documents import document_id, read_json_documents, write_json_document, write_json_documents
from .event_log import parse_log_lines, read_log_lines, unparsed_lines
from .handoff import read_recorded, recorded_path
from .numbering import FILE_COLUMN, number_file_records, number_files, position_in_group
from .orders import (
    CLEAN_COLUMNS,
    REGION_COLUMNS,
    REQUIRED_COLUMNS,
    has_multiline_records,
    read_clean_orders,
    read_numbered_orders,
    read_raw_orders,
    with_required_columns,
    write_csv,
)
from .records import csv_records, file_outlines, parse_records
from .shared import pin_partitions, scratch_path, shared_dir, stage_table

__all__ = [
    "CLEAN_COLUMNS",
    "FILE_COLUMN",
    "REGION_COLUMNS",
    "REQUIRED_COLUMNS",
    "csv_records",
    "document_id",
    "file_outlines",
    "has_multiline_records",
    "number_file_records",
    "number_files",
    "parse_log_lines",
    "pin_partitions",
    "position_in_group",
    "read_clean_orders",
    "parse_records",
    "read_json_documents",
    "read_log_lines",
    "read_numbered_orders",
    "read_raw_orders",
    "read_recorded",
    "recorded_path",
    "scratch_path",
    "shared_dir",
    "stage_table",
    "unparsed_lines",
    "with_required_columns",
    "write_csv",
    "write_json_document",
    "write_json_documents",
]
