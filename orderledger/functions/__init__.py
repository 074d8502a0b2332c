"""Column functions: text, numbers, dates, name lists and maps."""

from .collections import append_names, merge_maps, normalize_names
from .dates import iso_date, seconds_between
from .numeric import decimal_amount, is_positive, money_product, positive_number, whole_number
from .text import is_blank, strip, title_case

__all__ = [
    "append_names",
    "decimal_amount",
    "is_blank",
    "is_positive",
    "iso_date",
    "merge_maps",
    "money_product",
    "normalize_names",
    "positive_number",
    "seconds_between",
    "strip",
    "title_case",
    "whole_number",
]
