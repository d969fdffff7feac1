"""Participation in supplier service from the utilities' customer counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.functions import ratio
from voltledger.operators import (
    band_label,
    band_number,
    below_above,
    pivot_mean,
    report,
    with_total,
)
from voltledger.plans.inputs import Inputs
from voltledger.sources.amenities import STUDY_YEARS

COUNTS: Mapping[str, str] = {
    "supplier_customers": "num_custs_supplier",
    "edc_customers": "num_custs_edc",
    "total_customers": "tot_custs",
}

# Income bands, state median income and average minority share.
INCOME_BAND = 50000
INCOME_LABELS = (
    "Less than $50,000",
    "$50,000 - $100,000",
    "$100,000 - $150,000",
    "$150,000 - $200,000",
    "More than $200,000",
)
STATE_MEDIAN_INCOME = 80958
MEDIAN_YEARS = ("2017", "2021")
AVERAGE_MINORITY = "0.34"
MONTHS = 12


def participation_data(t: Inputs) -> DataFrame:
    return t.participation


def participation_by_zip_year(t: Inputs) -> DataFrame:
    """Both utilities' counts added up by postal code and year."""
    return t.participation.groupBy("zip", "year").agg(
        *[F.sum(src).alias(out) for out, src in COUNTS.items()]
    )


def participation_by_year_zcta(t: Inputs) -> DataFrame:
    """Participation rate by year and area with the area's median income.

    Counts meet the crosswalk one row per postal code and year.
    """
    area = t.crosswalk.select("zipcode", "zcta").join(
        t.income.select("zcta", "median_hh_income"), "zcta"
    )
    joined = participation_by_zip_year(t).join(area, F.col("zip") == F.col("zipcode"))
    return (
        joined.groupBy("year", "zcta", "median_hh_income")
        .agg(*[F.sum(c).alias(c) for c in COUNTS])
        .withColumn("participation_rate", ratio("supplier_customers", "total_customers"))
    )


def participation_by_year(t: Inputs) -> DataFrame:
    """The study years' slices, in one table keyed by year."""
    return participation_by_year_zcta(t).filter(F.col("year").isin(*STUDY_YEARS))


def participation_by_income_band(t: Inputs) -> DataFrame:
    """Participation by year and income band; incomes beyond the bands have no
    label."""
    number = band_number("median_hh_income", INCOME_BAND)
    rows = participation_by_year(t).filter(F.col("median_hh_income").isNotNull())
    return (
        rows.groupBy("year", number.alias("_band"))
        .agg(*[F.sum(c).alias(c) for c in COUNTS])
        .select(
            "year",
            band_label(F.col("_band"), INCOME_LABELS).alias("income_group"),
            *COUNTS,
            ratio("supplier_customers", "total_customers").alias("participation_rate"),
        )
    )


def participation_income_pivot(t: Inputs) -> DataFrame:
    """Rate by income band (rows) and study year (columns)."""
    out = pivot_mean(
        participation_by_income_band(t), "income_group", "year", STUDY_YEARS, "participation_rate"
    )
    return out.select("income_group", *[F.col(y).alias(f"rate_{y}") for y in STUDY_YEARS])


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("participation_rate", ratio("supplier_customers", "total_customers"))


def participation_vs_median(t: Inputs) -> DataFrame:
    """Below and at or above the state's median income, first and last year."""
    rows = participation_by_year_zcta(t).filter(F.col("year").isin(*MEDIAN_YEARS))
    return _with_rate(
        below_above(
            rows,
            "median_hh_income",
            STATE_MEDIAN_INCOME,
            {c: c for c in COUNTS},
            keys=["year"],
            label="income_group",
            names=(
                "Less than CT Median Household Income",
                "Greater than CT Median Household Income",
            ),
        )
    )


def participation_vs_minority(t: Inputs, year: str = "2021") -> DataFrame:
    """Below and at or above the state's average minority share."""
    rows = (
        participation_by_year_zcta(t)
        .filter(F.col("year") == year)
        .join(t.minority.select("zcta", F.col("pct_minority").cast("double")), "zcta")
    )
    return _with_rate(
        below_above(
            rows,
            "pct_minority",
            float(AVERAGE_MINORITY),
            {c: c for c in COUNTS},
            label="demo_group",
            names=("Less than ave minority", "Greater than ave minority"),
        )
    )


def suppliers_invoices_by_year(t: Inputs) -> DataFrame:
    """Distinct suppliers, invoices, average households and participation."""
    bills = t.cleaned.groupBy("year_charge").agg(
        F.count_distinct("supplier").alias("num_suppliers"),
        F.sum("num_customers").alias("num_invoices"),
        ratio(F.sum("num_customers"), F.lit(MONTHS)).alias("avg_num_hhlds"),
    )
    rates = t.participation.groupBy("year").agg(
        ratio(F.sum("num_custs_supplier"), F.sum("tot_custs")).alias("part_rate")
    )
    return bills.join(rates, F.col("year_charge") == F.col("year")).drop("year")


def participation_by_utility_year(t: Inputs) -> DataFrame:
    """Rate per utility side by side, years both utilities report."""
    cells = []
    for utility, name in (("Eversource", "eversource_part_rate"), ("UI", "ui_part_rate")):
        mine = F.col("edc") == utility
        cells += [
            F.count_if(mine).alias(f"_rows_{name}"),
            ratio(
                F.sum(F.when(mine, F.col("num_custs_supplier"))),
                F.sum(F.when(mine, F.col("tot_custs"))),
            ).alias(name),
        ]
    sides = t.participation.groupBy("year").agg(*cells)
    both = (F.col("_rows_eversource_part_rate") > 0) & (F.col("_rows_ui_part_rate") > 0)
    return sides.filter(both).select("year", "eversource_part_rate", "ui_part_rate")


def utility_totals(t: Inputs, year: str = "2021") -> DataFrame:
    """One year's counts per utility, as a check of the loaded answers."""
    rows = t.participation.filter(F.col("year") == year)
    return rows.groupBy("edc").agg(*[F.sum(src).alias(out) for out, src in COUNTS.items()])


def supplier_customers_by_year(t: Inputs) -> DataFrame:
    """Supplier customers by year, counted by the utilities and estimated from
    monthly bills, each with the average over its years."""

    def with_average(yearly: DataFrame, divisor: int) -> DataFrame:
        # A year is one row here; the number of years comes from the data.
        mean = ratio(F.sum("_n"), F.count(F.lit(1)) * divisor)
        return with_total(yearly, "year", "avg", {"customers": mean})

    counted = t.participation.groupBy("year").agg(F.sum("num_custs_supplier").alias("_n"))
    billed = t.cleaned.groupBy(F.col("year_charge").alias("year")).agg(
        F.sum("num_customers").alias("_n")
    )
    return report(
        {"utility counts": with_average(counted, 1), "bills": with_average(billed, MONTHS)},
        "measure",
    )
