"""Text, calendar and presentation helpers, all built-in expressions."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltledger.functions.semantics import _col

_MONTHS = {
    name.lower(): f"{i:02d}"
    for i in range(1, 13)
    for name in (calendar.month_name[i], calendar.month_abbr[i])
}

# One parsed literal; built call by call it would cost as much as a whole spec.
_MONTH_MAP = "map(" + ", ".join(f"'{name}', '{n}'" for name, n in _MONTHS.items()) + ")"

EXCEL_ORIGIN = "1899-12-30"


def month_number(name: Column | str) -> Column:
    """Two-digit month for an English month name or its three-letter form."""
    return F.try_element_at(F.expr(_MONTH_MAP), F.lower(F.trim(_col(name))))


def excel_date(serial: Column | str, origin: str = EXCEL_ORIGIN) -> Column:
    """Date of a spreadsheet serial number held as text; NULL if not a number."""
    days = _col(serial).try_cast("double").try_cast("int")
    return F.date_add(F.lit(origin).cast("date"), days)


def year_month(year: Column | str, month: Column | str) -> Column:
    """``YYYYMM`` key."""
    return F.concat(_col(year), F.lpad(_col(month), 2, "0"))


def half_year(month: Column | str) -> Column:
    """1 for January to June, 2 for July to December."""
    return F.ceil(_col(month).try_cast("int") / 6).cast("int")


def zip_text(raw: Column | str, prefix: str = "") -> Column:
    """Right-trimmed postal code, with the lost leading zero put back.

    A missing code under a prefix becomes ``0NA``, which cleansing removes as a
    code outside the state; without a prefix it stays NULL and is kept.
    """
    text = F.rtrim(_col(raw))
    if not prefix:
        return text
    return F.concat(F.lit(prefix), F.coalesce(text, F.lit("NA")))


def _fixed(value: Column, digits: int) -> Column:
    # format_number rounds half to even, a report rounds half away from zero.
    return F.format_number(F.round(value.cast("decimal(38,10)"), digits), digits)


def thousands(value: Column | str, digits: int = 0) -> Column:
    """``1,234,567``"""
    return _fixed(_col(value), digits)


def money(value: Column | str, digits: int = 0) -> Column:
    """``$1,234.50``; the minus sign goes before the currency sign."""
    value = _col(value)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("$"), _fixed(F.abs(value), digits))


def percent(value: Column | str, digits: int = 1) -> Column:
    """``12.3%`` for a value already in percent."""
    return F.concat(_fixed(_col(value), digits), F.lit("%"))
