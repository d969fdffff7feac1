from voltledger.functions.semantics import (
    any_of,
    half_even,
    int_or_null,
    keep_unless,
    ratio,
    scaled,
    scaled_sum,
    strict_sum,
    whole,
    whole_or_null,
)
from voltledger.functions.text import (
    excel_date,
    half_year,
    money,
    month_number,
    percent,
    thousands,
    year_month,
    zip_text,
)

__all__ = [
    "any_of",
    "excel_date",
    "half_even",
    "half_year",
    "int_or_null",
    "keep_unless",
    "money",
    "month_number",
    "percent",
    "ratio",
    "scaled",
    "scaled_sum",
    "strict_sum",
    "thousands",
    "whole",
    "whole_or_null",
    "year_month",
    "zip_text",
]
