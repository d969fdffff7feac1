"""Value of amenities against bills and overpayment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.functions import money, percent, ratio, thousands
from voltledger.operators import net, with_total
from voltledger.plans.inputs import Inputs

_SUMMED = ("value_redeemed", "total_bills", "total_overpayment")


def _sums() -> dict[str, Column]:
    return {c: F.sum(c) for c in _SUMMED}


def amenities_all(t: Inputs) -> DataFrame:
    return t.amenities


def _bills(t: Inputs, key: str) -> DataFrame:
    return t.cells.groupBy(key).agg(
        F.sum("num_customers").alias("total_bills"), net().alias("total_overpayment")
    )


def _value(t: Inputs, key: str) -> DataFrame:
    return t.amenities.groupBy(key).agg(F.sum("total_value_redeemed").alias("value_redeemed"))


def _with_shares(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "value_redeemed_per_bill": ratio("value_redeemed", "total_bills"),
            "value_pct_of_overpayment": ratio(F.col("value_redeemed") * 100, "total_overpayment"),
        }
    )


def amenity_summary_by_year(t: Inputs) -> DataFrame:
    """By year, for years with both amenities and bills, and their total."""
    bills = _bills(t, "year_charge").withColumnRenamed("year_charge", "year")
    joined = _value(t, "year").join(bills, "year")
    return _with_shares(with_total(joined, "year", "Total", _sums()))


def _supplier_summary(t: Inputs) -> DataFrame:
    """By supplier of bills, NULL where it gave no amenity, and an All row.

    The All row takes in the amenities of suppliers without bills too, so both
    come from one full merge: rows need a bill side, the total does not.
    """
    value, bills = _value(t, "supplier").alias("v"), _bills(t, "supplier").alias("b")
    full = (
        value.join(
            bills.withColumn("_billed", F.lit(True)), F.col("v.supplier") == F.col("b.supplier"), "full"
        )
        .withColumn("_who", F.coalesce("b.supplier", "v.supplier"))
        .withColumn("_side", F.coalesce("_billed", F.lit(False)))
        .select(F.col("_who").alias("supplier"), "_side", *_SUMMED)
    )
    summed = with_total(full, "supplier", "All", _sums(), within=["_side"])
    return _with_shares(summed.filter(F.col("_side").isNull() | F.col("_side"))).drop("_side")


def amenity_summary_by_supplier(t: Inputs) -> DataFrame:
    """By supplier of bills, 0 where it gave no amenity, and an All row."""
    return _filled(_supplier_summary(t), 0)


def _filled(df: DataFrame, zero: int | str) -> DataFrame:
    return df.select(
        "supplier", *[F.coalesce(c, F.lit(zero)).alias(c) for c in df.columns if c != "supplier"]
    )


def _formatted(df: DataFrame, key: str, share_digits: int, total_digits: int) -> DataFrame:
    """As report text; the total row shows its share with digits of its own."""
    total = F.col(key).isin("Total", "All")
    share = F.when(total, percent("value_pct_of_overpayment", total_digits)).otherwise(
        percent("value_pct_of_overpayment", share_digits)
    )
    return df.select(
        key,
        money("value_redeemed").alias("value_redeemed"),
        thousands("total_bills").alias("total_bills"),
        money("total_overpayment").alias("total_overpayment"),
        money("value_redeemed_per_bill", 2).alias("value_redeemed_per_bill"),
        share.alias("value_pct_of_overpayment"),
    )


def amenity_report_by_year(t: Inputs) -> DataFrame:
    """``amenity_summary_by_year`` as report text."""
    return _formatted(amenity_summary_by_year(t), "year", 1, 2)


def amenity_report_by_supplier(t: Inputs) -> DataFrame:
    """``amenity_summary_by_supplier`` as report text: a bare ``0`` in each cell that has no value."""
    return _filled(_formatted(_supplier_summary(t), "supplier", 2, 2), "0")
