"""Green-choice usage, standard rates and utility participation counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.functions import whole_or_null, year_month
from voltledger.operators.cleanse import clean_green
from voltledger.operators.conform import accepted
from voltledger.operators.rates import SHEET_COLUMNS

# Heading of each count in the utilities' answers.
PARTICIPATION_COLUMNS = {
    "Eversource": {
        "zip": "Zip Code",
        "year": "Year End",
        "num_custs_supplier": "Supplier Customer Count",
        "num_custs_edc": "EDC Customer Count",
        "tot_custs": "Total Customer Count",
    },
    "UI": {
        "zip": "Zip Code",
        "year": "Year-end",
        "num_custs_supplier": "Supplier \r\nCustomer Count",
        "num_custs_edc": "EDC \r\nCustomer Count",
        "tot_custs": "Total \r\nCustomer Count",
    },
}


def _with_errors(rows: DataFrame, typed: Mapping[str, Column], checked: Mapping[str, Column]) -> DataFrame:
    """Typed columns and ``load_errors``: names of the columns whose text did not fit."""
    wrong = [F.when(text.isNotNull() & typed[n].isNull(), F.lit(n)) for n, text in checked.items()]
    errors = F.nullif(F.concat_ws(",", *wrong), F.lit(""))
    return rows.select(*[c.alias(n) for n, c in typed.items()], errors.alias("load_errors"))


def load_green(raw: DataFrame) -> DataFrame:
    """Green usage typed; a filled cell that does not fit its column is a load error."""
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schemas.GREEN}
    numbers = [f.name for f in schemas.GREEN if f.dataType.simpleString() != "string"]
    text = {n: F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in numbers}
    return _with_errors(raw, typed, text)


def green_usage(raw: DataFrame) -> DataFrame:
    """Usage of customers on a green choice, typed, without negative rows and load errors."""
    return clean_green(accepted(load_green(raw)))


def load_rate_sheet(raw: DataFrame) -> DataFrame:
    """Monthly standard rates in cents with the ``YYYYMM`` key, and ``load_errors``.

    A filled rate that is no number, a year that is not four digits and a month that is not one of
    twelve cost their row; an empty rate is missing.
    """
    year, month = (F.trim(F.col(c).cast("string")) for c in ("year", "month"))
    month = F.lpad(month, 2, "0")
    text = {
        "year": F.coalesce(year, F.lit("")),
        "month": F.coalesce(month, F.lit("")),
        **{r: F.nullif(F.trim(F.col(r).cast("string")), F.lit("")) for r in SHEET_COLUMNS.values()},
    }
    typed = {
        "year": F.when(year.rlike("^[0-9]{4}$"), year),
        "month": F.when(month.rlike("^(0[1-9]|1[0-2])$"), month),
        **{r: text[r].try_cast(schemas.RATE_SHEET[r].dataType) for r in SHEET_COLUMNS.values()},
    }
    typed["date_concat"] = year_month(typed["year"], typed["month"])
    return _with_errors(raw, {f.name: typed[f.name] for f in schemas.RATE_SHEET}, text)


def rate_sheet(raw: DataFrame) -> DataFrame:
    """``load_rate_sheet`` without the rows that have load errors."""
    return accepted(load_rate_sheet(raw))


def participation_counts(
    raw: DataFrame, utility: str | Column, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """``load_participation`` without the rows that have load errors."""
    return accepted(load_participation(raw, utility, columns))


def load_participation(
    raw: DataFrame, utility: str | Column, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Customer counts with missing values as 0, tagged with the utility, and ``load_errors``.

    A filled cell that is no whole number (``1,234``, ``12.7``) is a load error, not 0; ``12.0`` is 12.

    ``utility`` is a name, whose answer's headings are known, or a column of a
    sheet holding several utilities, with ``columns`` giving its headings.
    """
    if isinstance(utility, str):
        columns, utility = columns or PARTICIPATION_COLUMNS[utility], F.lit(utility)
    named = raw.select(
        *[F.col(f"`{src}`").cast("string").alias(dst) for dst, src in columns.items()],
        utility.alias("edc"),
    )
    counts = ("num_custs_supplier", "num_custs_edc", "tot_custs")
    text = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("0")) for c in counts}
    filled = {k: F.coalesce(F.rtrim(k), F.lit("0")) for k in ("zip", "year")}
    filled |= {c: whole_or_null(text[c]) for c in counts}
    typed = {
        f.name: filled.get(f.name, F.col(f.name)).cast(f.dataType) for f in schemas.PARTICIPATION
    }
    return _with_errors(named, typed, text)
