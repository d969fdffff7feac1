"""Over- and under-payment products over the rate comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.functions import ratio
from voltledger.operators import (
    exceed_totals,
    kwh,
    net,
    per_unit_split,
    pivot_mean,
    premium,
    split,
)
from voltledger.plans.inputs import PREMIUM_STEPS, Inputs

# The contract bands in months.
SHORTEST_TERM, LONGEST_TERM = 12, 36


def rate_comparison(t: Inputs) -> DataFrame:
    """Compared bills; the scaled amount the aggregates use is not shown."""
    return t.comparison.drop("overpayment_e7")


def overpayment_by_year(t: Inputs) -> DataFrame:
    return split(
        t.cells,
        ["year_charge"],
        extras={
            "total_kwh": kwh(strict=True),
            "overpayment_per_kwh": ratio(net(strict=True), kwh(strict=True)),
        },
    )


def overpayment_by_supplier(t: Inputs) -> DataFrame:
    return split(t.cells, ["supplier"])


def overpayment_by_supplier_year(t: Inputs) -> DataFrame:
    return split(t.cells, ["supplier", "year_charge"])


def avg_premium_by_supplier_year(t: Inputs) -> DataFrame:
    return premium(t.cells, ["supplier", "year_charge"])


def overpayment_by_zip(t: Inputs) -> DataFrame:
    return split(t.cells, ["zipcode"])


def overpayment_by_zip_year(t: Inputs) -> DataFrame:
    return split(t.cells, ["year_charge", "zipcode"])


def overpayment_by_half_year(t: Inputs) -> DataFrame:
    return split(t.cells, ["year_charge", "year_half"])


def premium_distribution(t: Inputs, year: str = "2021") -> DataFrame:
    """Customers with bills above each premium, from the cells of one year."""
    return exceed_totals(
        t.premiums.filter(F.col("year_charge") == year),
        [f"greater than ${step} per kWh" for step in PREMIUM_STEPS],
        weight="num_customers",
        label="premium",
        total="bills_rendered",
    )


def savings_overpayment_by_year(t: Inputs) -> DataFrame:
    return per_unit_split(t.cells, ["year_charge"])


def contract_term_pivot(t: Inputs) -> DataFrame:
    """Net amount by utility and commencement month, one column per term."""
    term = F.col("contractterm")
    terms = list(range(SHORTEST_TERM, LONGEST_TERM + 1))
    nets = (
        t.terms.filter((term >= SHORTEST_TERM) & (term <= LONGEST_TERM))
        .groupBy("edc", "month_commencement", "contractterm")
        .agg(net().cast("double").alias("net"))
    )
    keyed = nets.withColumn("row", F.struct("edc", "month_commencement"))
    out = pivot_mean(keyed, "row", "contractterm", terms, "net")
    return out.select("row.*", *[F.col(str(n)).alias(f"term_{n}") for n in terms])


def contract_term_bands(t: Inputs) -> DataFrame:
    """Net amount and customers by utility and contract band.

    The three bands partition the rows; a missing term counts as short.
    """
    term = F.col("contractterm")
    band = (
        F.when(term.isNull() | (term < SHORTEST_TERM), "under 12 or none")
        .when(term <= LONGEST_TERM, "12 to 36")
        .otherwise("over 36")
    )
    return (
        t.terms.groupBy("edc", band.alias("band"))
        .agg(
            net().alias("net_overpayment"),
            F.sum("num_customers").alias("customers"),
        )
    )
