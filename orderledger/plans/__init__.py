"""Chains of steps: validate, clean, report."""

from .retail import RetailFrames, retail_frames, run_retail, write_sales_summary, write_validation_report
from .runs import write_manifests

__all__ = [
    "RetailFrames",
    "retail_frames",
    "run_retail",
    "write_manifests",
    "write_sales_summary",
    "write_validation_report",
]
