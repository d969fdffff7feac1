"""Cleansed tables, control totals, weighted average rates and green usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.functions import ratio
from voltledger.operators import clamp_negative, control_totals, kwh, merge_full, weighted_avg
from voltledger.plans.inputs import Inputs
from voltledger.sources import bill_audit


def q6_all(t: Inputs) -> DataFrame:
    return t.cleaned


def load_control_totals(t: Inputs) -> DataFrame:
    """Count and sums per supplier of the bills as loaded."""
    return bill_audit(t.bills)


def union_control_totals(t: Inputs) -> DataFrame:
    """Count and sums per supplier of the cleansed bills."""
    return bill_audit(t.cleaned)


def q9_all(t: Inputs) -> DataFrame:
    return t.green


def q9_control_totals(t: Inputs) -> DataFrame:
    """Green usage totals by year."""
    return control_totals(t.green, ("year_charge",), ("num_customers", "totalkwh"))


def edc_rates(t: Inputs) -> DataFrame:
    return t.rate_sheet


def utilities(t: Inputs) -> DataFrame:
    """Distinct utility names left after unification."""
    return t.cleaned.select("edc").distinct()


def wtd_avg_consolidated(t: Inputs) -> DataFrame:
    """All and green kWh side by side per (year, rate).

    Both sides are grouped before the join, which then needs no shuffle of its
    own; their size is bounded by years x distinct rates, not by the bills.
    """
    keys = ["year_charge", "billed_rate"]

    def side(df: DataFrame, name: str) -> DataFrame:
        sums = df.groupBy(*keys).agg(kwh().cast("decimal(20,1)").alias(f"kwh_{name}"))
        return sums.withColumns({f"{name}_year": F.col(keys[0]), f"{name}_rate": F.col(keys[1])})

    merged = merge_full(side(t.cleaned, "all"), side(t.green, "green"), keys)
    all_kwh = F.coalesce("kwh_all", F.lit(0))
    green_kwh = F.coalesce("kwh_green", F.lit(0))
    return merged.select(
        "all_year",
        "all_rate",
        all_kwh.alias("all_kwh"),
        "green_year",
        "green_rate",
        green_kwh.alias("green_kwh"),
        clamp_negative(all_kwh - green_kwh).alias("nongreen_kwh"),
        F.col("year_charge").alias("year"),
        F.col("billed_rate").alias("rate"),
    )


def wtd_avg_rates(t: Inputs) -> DataFrame:
    return weighted_avg(
        wtd_avg_consolidated(t),
        ["year"],
        "rate",
        {
            "wtd_avg_all": "all_kwh",
            "wtd_avg_nongreen": "nongreen_kwh",
            "wtd_avg_green": "green_kwh",
        },
    )


def usage_green_nongreen(t: Inputs) -> DataFrame:
    return (
        wtd_avg_consolidated(t)
        .groupBy("year")
        .agg(
            F.sum("all_kwh").alias("total_kwh"),
            F.sum("green_kwh").alias("green_kwh"),
            F.sum("nongreen_kwh").alias("nongreen_kwh"),
        )
        .withColumn("green_percentage", ratio("green_kwh", "total_kwh"))
    )
