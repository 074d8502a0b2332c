"""Validate, clean and report as one lazy plan, and the job that writes its outputs."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_orders, rejected_orders
from ..operators.reports import (
    clean_summary,
    clean_summary_of,
    dimension_rows,
    region_breakdown,
    sales_breakdown,
    summary_row,
)
from ..operators.rules import (
    order_issues,
    region_profile,
    unique_regions,
    validation_report,
)
from ..sources.documents import ListField, MapField, write_json_document
from ..sources.numbering import number_files
from ..sources.orders import (
    CLEAN_COLUMNS,
    REGION_COLUMNS,
    REQUIRED_COLUMNS,
    read_numbered_orders,
    write_csv,
)
from ..sources.shared import stage_table


@dataclass(frozen=True)
class RetailFrames:
    """The lazy frames of the chain; nothing runs until one is used."""

    issues: DataFrame
    profile: DataFrame
    report: DataFrame
    clean: DataFrame
    rejects: DataFrame
    summary: DataFrame
    breakdown: DataFrame
    sales: DataFrame


def retail_frames(
    raw: DataFrame, ordinal: str | None = "row_number", strict: bool = False
) -> RetailFrames:
    """All results over numbered raw orders. A failed check does not stop the later steps.

    Rows that name the place of their file (``file_number``) are told apart by it before ``ordinal``.
    """
    file = "file_number" if "file_number" in raw.columns else None
    keep = [c for c in (file, ordinal) if c]
    clean = raw.transform(clean_orders, strict=strict, keep=keep)
    profile = raw.transform(region_profile)
    breakdown = clean.transform(sales_breakdown, ordinal=ordinal, file=file)
    return RetailFrames(
        issues=raw.transform(order_issues),
        profile=profile,
        report=profile.transform(validation_report),
        clean=clean,
        rejects=raw.drop("file_number").transform(rejected_orders),
        summary=clean.transform(clean_summary),
        breakdown=breakdown,
        sales=breakdown.transform(summary_row),
    )


def write_validation_report(frames: RetailFrames, source_path: str, path: str) -> str:
    """The validation report as a JSON document, with the whole issue list beside it."""
    profile = stage_table(frames.profile, "profile")
    columns = F.array(*[F.lit(c) for c in REQUIRED_COLUMNS])
    scalars = validation_report(profile).select(
        "*", F.lit(source_path).alias("source_path"), columns.alias("required_columns")
    )
    place = [c for c in ("source_file", "row_number") if c in frames.issues.columns]
    fields = {
        "issues": ListField(frames.issues, "message", (*place, "rule_order")),
        "unique_regions": ListField(unique_regions(profile), "region", ("region",)),
    }
    return write_json_document(scalars, path, fields)


def write_sales_summary(breakdown: DataFrame, path: str) -> str:
    """The sales summary as a JSON document with its four maps beside it.

    Reads ``breakdown`` once per map: give it a stored table.
    """
    regions = dimension_rows(breakdown, "region")
    products = dimension_rows(breakdown, "product")
    fields = {
        "orders_by_region": MapField(regions, "region", "orders"),
        "revenue_by_region": MapField(regions, "region", "revenue"),
        "units_by_product": MapField(products, "product", "units"),
        "revenue_by_product": MapField(products, "product", "revenue"),
    }
    return write_json_document(summary_row(breakdown), path, fields)


def run_retail(
    spark: SparkSession,
    raw_path: str,
    out_dir: str,
    strict: bool = False,
    multi_line: bool | None = None,
) -> dict[str, str]:
    """Read raw CSV, write every output below ``out_dir`` and return the paths.

    The text is parsed and numbered once into a staged table; all outputs read
    that, each only its columns.
    """
    raw = stage_table(
        read_numbered_orders(spark, raw_path, multi_line), "raw-orders"
    )
    frames = retail_frames(number_files(raw), strict=strict)
    breakdown = stage_table(frames.breakdown, "breakdown")
    # The breakdown's total row and keys are the clean summary: no second look at the rows.
    values = breakdown.where(F.col("dimension") != "total").select("dimension", "key")
    paths = {
        "raw_path": raw_path,
        "report_path": posixpath.join(out_dir, "interim", "0_validation_report"),
        "clean_path": posixpath.join(out_dir, "interim", "1_clean_orders"),
        "rejects_path": posixpath.join(out_dir, "interim", "1_rejected_orders"),
        "clean_summary_path": posixpath.join(out_dir, "interim", "1_clean_summary"),
        "summary_path": posixpath.join(out_dir, "processed", "2_sales_summary"),
        "region_breakdown_path": posixpath.join(out_dir, "processed", "2_revenue_by_region"),
    }
    write_validation_report(frames, raw_path, paths["report_path"])
    write_csv(frames.clean, paths["clean_path"], CLEAN_COLUMNS)
    write_csv(frames.rejects, paths["rejects_path"], frames.rejects.columns)
    totals = clean_summary_of(breakdown).select(
        "*", F.lit(raw_path).alias("source_path"), F.lit(paths["clean_path"]).alias("clean_path")
    )
    named = {"regions": "region", "products": "product"}
    lists = {
        field: ListField(values.where(F.col("dimension") == column), "key", ("key",))
        for field, column in named.items()
    }
    write_json_document(totals, paths["clean_summary_path"], lists)
    write_sales_summary(breakdown, paths["summary_path"])
    regions = region_breakdown(dimension_rows(breakdown, "region"))
    write_csv(regions, paths["region_breakdown_path"], REGION_COLUMNS)
    return paths
