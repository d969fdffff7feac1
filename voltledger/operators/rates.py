"""Standard rates, rate comparison and weighted average rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.functions import half_year, ratio, scaled, year_month

# Utility code of each rate column of the monthly sheet.
SHEET_COLUMNS = {"EV": "eversource_rate", "UI": "ui_rate"}

# What a comparison keeps of a bill.
COMPARED = (
    "supplier",
    "year_charge",
    "month_charge",
    "billed_rate",
    "zipcode",
    "num_customers",
    "totalkwh",
    "edc",
    "year_commencement",
    "month_commencement",
    "contractterm",
)


def standard_rates(sheet: DataFrame) -> DataFrame:
    """Wide monthly sheet in cents -> (year_month, edc, standard_rate) in dollars."""
    long = sheet.unpivot(["date_concat"], list(SHEET_COLUMNS.values()), "rate_column", "cents")
    edc = F
    for code, column in SHEET_COLUMNS.items():
        edc = edc.when(F.col("rate_column") == column, F.lit(code))
    return long.select(
        F.col("date_concat").alias("year_month"),
        edc.alias("edc"),
        (F.col("cents") * F.lit(0.01).cast("decimal(2,2)")).cast("decimal(8,6)").alias(
            "standard_rate"
        ),
    )


def compare_rates(bills: DataFrame, sheet: DataFrame) -> DataFrame:
    """Each bill of a known utility with its month's standard rate.

    One left join on (month, utility) serves both utilities.  No join hint is
    given: the sheet is a stored table of months, so its file size is under the
    broadcast threshold and the bills are not shuffled; a sheet beyond the
    threshold is joined by a shuffle whose hot months adaptive execution splits.

    Amounts are exact, so sums do not depend on the order of the rows or on retried
    tasks.  ``overpayment_e7`` is the overpayment in 10**-7 dollars, the form that
    aggregates read: whole numbers are multiplied and added without decimal objects.
    """
    known = bills.filter(F.col("edc").isin(*SHEET_COLUMNS)).select(
        *COMPARED, year_month("year_charge", "month_charge").alias("year_month")
    )
    joined = known.join(standard_rates(sheet), ["year_month", "edc"], "left")
    difference = F.col("billed_rate") - F.col("standard_rate")
    difference_e6 = scaled("billed_rate", 6) - scaled("standard_rate", 6)
    return joined.select(
        *COMPARED,
        "standard_rate",
        difference.alias("rate_difference"),
        (difference * F.col("totalkwh")).cast("decimal(18,7)").alias("overpayment"),
        half_year("month_charge").alias("year_half"),
        (difference_e6 * scaled("totalkwh", 1)).alias("overpayment_e7"),
    )


def weighted_avg(
    df: DataFrame, keys: Sequence[str], rate: str, weights: dict[str, str]
) -> DataFrame:
    """Average of ``rate`` under several weights at once.

    ``weights`` maps each output column to its weight column.
    """
    return df.groupBy(*keys).agg(
        *[
            ratio(F.sum(F.col(rate) * F.col(w)), F.sum(w)).alias(name)
            for name, w in weights.items()
        ]
    )
