"""Over- and under-payment in one pass over the compared bills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.functions import ratio, scaled, scaled_sum, strict_sum, whole


# Aggregates over a rate comparison.


def net(where: Column | None = None, strict: bool = False) -> Column:
    """Exact overpayment of the rows in dollars."""
    return scaled_sum("overpayment_e7", 7, where, strict)


def kwh(where: Column | None = None, strict: bool = False) -> Column:
    """Exact kWh of the rows."""
    return scaled_sum(scaled("totalkwh", 1), 1, where, strict)


# What the cells of a comparison add up.
MEASURES = ("overpayment_e7", "num_customers", "totalkwh")


def _signs(measures: Sequence[str]) -> list[Column]:
    return [F.signum(F.col(m).cast("double")).alias(f"_sign_{m}") for m in measures]


def additive(df: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Compared bills added up to cells that every aggregate here takes for bills.

    Rows share a cell only if each measure has the same sign in them, or is missing
    in all of them. So a cell's measure is positive, negative, zero or NULL exactly
    where its rows' are: conditions on a sign, sums of one side and sums that a
    missing value makes missing give the same values over cells as over rows. Counts
    of rows do not, nor do conditions on other amounts.

    ``n_bills`` is the number of a cell's rows, by which ``merged`` knows when it is empty.

    A cell's overpayment is one long, enough for 9 * 10**11 dollars; beyond that the
    sum fails.
    """
    cells = df.groupBy(*keys, *_signs(measures)).agg(
        *[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("n_bills")
    )
    return cells.select(*keys, *measures, "n_bills")


def merged(cells: DataFrame, changes: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """``cells`` after bills came and went, without the bills that stay.

    ``changes`` are cells by ``keys`` and ``side``: 1 for bills that came, -1 for those that went; a corrected
    bill went as it was and came as it is. Signs are those of the bills, so what went meets the very cell that it
    was added to, and a cell without a bill left is gone. The result equals ``additive`` of the bills as they are.

    It fails where bills went that were never there: where a cell would have less than no bill, an amount
    without a bill, or an amount of another sign than its bills.
    """
    names = [f"_sign_{m}" for m in measures]
    rows = cells.withColumn("side", F.lit(1)).unionByName(changes.select(*keys, *measures, "n_bills", "side"))
    sums = [F.sum(F.col(m) * F.col("side")).alias(m) for m in (*measures, "n_bills")]
    out = rows.groupBy(*keys, *_signs(measures)).agg(*sums)
    none = F.col("n_bills") == 0
    bad = F.col("n_bills") < 0
    for m, sign in zip(measures, names):
        now = F.signum(F.col(m).cast("double"))
        bad = bad | (none & (now != 0)) | (~none & (now != F.col(sign)))
    what = F.lit("bills were taken away that the cells do not have")
    counted = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(what).cast("long")).otherwise(F.col("n_bills"))
    kept = out.withColumn("n_bills", counted).where("n_bills != 0")
    return kept.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in cells.schema])


def split(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "overpayment_e7",
    weight: str = "num_customers",
    digits: int = 7,
    extras: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Gross over, gross under and net amounts with their customers, by keys.

    ``value`` holds whole numbers of ``10**-digits``.  Three conditional aggregates
    share one scan and one shuffle of partial sums.  A row whose value is NULL is
    on neither side but makes the net NULL.  A group without any overpaying row is
    left out; one without an underpaying row has NULL in the under columns.
    """
    v = F.col(value)
    over, under = v > 0, v <= 0
    out = df.groupBy(*keys).agg(
        F.count_if(over).alias("_over_rows"),
        whole(scaled_sum(v, digits, over)).alias("gross_overpayment"),
        strict_sum(weight, over).alias("customers_paying_more"),
        whole(scaled_sum(v, digits, under)).alias("gross_underpayment"),
        strict_sum(weight, under).alias("customers_paying_less"),
        whole(scaled_sum(v, digits, strict=True)).alias("net_overpayment"),
        strict_sum(weight).alias("customers_affected"),
        *[c.alias(n) for n, c in (extras or {}).items()],
    )
    return out.filter(F.col("_over_rows") > 0).drop("_over_rows")


def premium(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Net amount, bills, kWh and premium per kWh by keys."""
    return df.groupBy(*keys).agg(
        whole(net(strict=True)).alias("net_overpayment"),
        strict_sum("num_customers").alias("bills_rendered"),
        kwh(strict=True).alias("total_kwh"),
        ratio(net(strict=True), kwh(strict=True)).alias("avg_premium"),
    )


def per_unit_split(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average amount per kWh and per bill on each side, by keys.

    Groups without an underpaying row are left out.
    """
    v = F.col("overpayment_e7")
    aggs: list[Column] = [F.count_if(v <= 0).alias("_under_rows")]
    for side, label, cond in (("less", "under", v <= 0), ("more", "over", v > 0)):
        customers = strict_sum("num_customers", cond)
        aggs += [
            customers.alias(f"customers_paying_{side}"),
            ratio(net(cond), kwh(cond, strict=True)).alias(f"avg_per_kwh_{label}"),
            ratio(net(cond), customers).alias(f"avg_per_bill_{label}"),
        ]
    out = df.groupBy(*keys).agg(*aggs)
    return out.filter(F.col("_under_rows") > 0).drop("_under_rows")
