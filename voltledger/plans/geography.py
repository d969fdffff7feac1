"""Census-area products: roll-ups, income, demographics, extremes, extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.functions import ratio, strict_sum, whole
from voltledger.operators import attach_area, by_membership, kwh, net, rollup_geo, top_bottom
from voltledger.plans.inputs import Inputs
from voltledger.plans.overpayment import overpayment_by_zip, overpayment_by_zip_year
from voltledger.plans.participation import participation_by_year_zcta

SPLIT_SUMS = (
    "gross_overpayment",
    "customers_paying_more",
    "gross_underpayment",
    "customers_paying_less",
    "net_overpayment",
    "customers_affected",
)

# Report year, state average of the minority share, thresholds of
# the demographic criteria, and the area that is only a post office.
REPORT_YEAR = "2021"
MAJORITY, STATE_MINORITY = 0.5, 0.34
LOW_INCOME, HIGH_MINORITY, HIGH_LOW_ENGLISH = 50000, 0.35, 0.10
POST_OFFICES = ("06020",)


def acs_income(t: Inputs) -> DataFrame:
    return t.income


def crosswalk(t: Inputs) -> DataFrame:
    return t.crosswalk


def population_by_zcta(t: Inputs) -> DataFrame:
    return t.population


def overpayment_by_zcta(t: Inputs) -> DataFrame:
    """Areas add up the rounded postal-code totals; one missing total makes the
    area's total missing."""
    return rollup_geo(overpayment_by_zip(t), t.crosswalk, SPLIT_SUMS)


def overpayment_by_zcta_year(t: Inputs) -> DataFrame:
    return rollup_geo(overpayment_by_zip_year(t), t.crosswalk, SPLIT_SUMS, keys=["year_charge"])


def overpayment_income_by_zcta(t: Inputs) -> DataFrame:
    income = t.income.withColumnRenamed("zcta", "_area")
    return (
        overpayment_by_zcta(t)
        .join(income, F.col("zcta").eqNullSafe(F.col("_area")), "left")
        .drop("_area")
    )


def minority_flags(t: Inputs) -> DataFrame:
    share = F.col("pct_minority")

    def flag(threshold: float) -> Column:
        return F.when(share >= F.lit(threshold).cast("decimal(4,3)"), 1).when(share.isNotNull(), 0)

    return t.minority.select(
        "*",
        flag(MAJORITY).alias("majority_minority"),
        flag(STATE_MINORITY).alias("above_average_minority"),
    )


def _per_kwh(t: Inputs, years: DataFrame) -> DataFrame:
    by_zip = years.groupBy("year_charge", "zipcode").agg(
        kwh().alias("totalkwh"), net().alias("net_overpayment")
    )
    areas = attach_area(by_zip, t.crosswalk).groupBy("year_charge", "zcta").agg(
        whole(strict_sum("totalkwh")).alias("totalkwh"),
        whole(strict_sum("net_overpayment")).alias("net_overpayment"),
    )
    # The ratio uses the rounded sums.
    return areas.withColumn("overpayment_per_kwh", ratio("net_overpayment", "totalkwh"))


def overpayment_per_kwh_zcta_year(t: Inputs) -> DataFrame:
    """Rounded kWh and net amount by area and year and their ratio; unlike
    ``overpayment_by_zcta`` it starts from unrounded postal-code sums."""
    return _per_kwh(t, t.cells)


def save_overpay_by_zcta(t: Inputs, year: str = REPORT_YEAR) -> DataFrame:
    """Savers and overpayers side by side per area, bills with customers and kWh
    only.  An area on one side only keeps NULL on the other."""
    v = F.col("overpayment_e7")
    used = t.cells.filter(
        (F.col("year_charge") == year)
        & (F.col("num_customers") > 0)
        & (F.col("totalkwh") > 0)
        & v.isNotNull()
    )
    sides = {"saving": v <= 0, "overpay": v > 0}
    cells = {}
    for side, cond in sides.items():
        cells[f"bills_{side}"] = F.sum(F.when(cond, F.col("num_customers")))
        cells[f"kwh_{side}"] = kwh(cond)
        cells[f"amount_{side}"] = net(cond)
    by_zip = used.groupBy("zipcode").agg(*[c.alias(n) for n, c in cells.items()])
    # Plain equality here: a bill without a postal code belongs to no area.
    areas = t.crosswalk.select(F.col("zipcode"), "zcta")
    sums = (
        by_zip.join(areas, "zipcode").groupBy("zcta").agg(*[F.sum(n).alias(n) for n in cells])
    )
    saved = -F.col("amount_saving")
    return sums.select(
        "zcta",
        F.col("bills_saving").alias("bills_with_savings"),
        F.col("kwh_saving").alias("totalkwh_saving"),
        saved.alias("total_savings"),
        ratio(saved, "bills_saving").alias("savings_per_bill"),
        ratio(saved, "kwh_saving").alias("savings_per_kwh"),
        F.col("bills_overpay").alias("bills_with_overpay"),
        F.col("kwh_overpay").alias("totalkwh_overpay"),
        F.col("amount_overpay").alias("total_overpayment"),
        ratio("amount_overpay", "bills_overpay").alias("overpayment_per_bill"),
        ratio("amount_overpay", "kwh_overpay").alias("overpayment_per_kwh"),
    )


def _places(t: Inputs) -> DataFrame:
    """Place names by area, once each, so that joins do not multiply rows."""
    return t.crosswalk.select("zcta", "po_name").distinct()


def low_english_zctas(t: Inputs) -> DataFrame:
    return (
        t.income.select("zcta", "median_hh_income")
        .join(t.minority.select("zcta", "pct_minority"), "zcta")
        .join(
            t.english.filter(F.col("pct_low_english") > F.lit("0.1").cast("decimal(4,3)")).select(
                "zcta", "pct_low_english"
            ),
            "zcta",
        )
        .join(_places(t), "zcta")
        .distinct()
    )


def high_participation_75(t: Inputs, year: str = REPORT_YEAR, above: float = 0.75) -> DataFrame:
    rates = participation_by_year_zcta(t).filter(
        (F.col("year") == year)
        & (F.col("participation_rate") > above)
        & ~F.col("zcta").isin(*POST_OFFICES)
    )
    return (
        rates.select("zcta", "participation_rate")
        .join(_places(t), "zcta")
        .join(t.income.select("zcta", "median_hh_income", "count_households"), "zcta")
        .select("zcta", "po_name", "median_hh_income", "count_households", "participation_rate")
        .distinct()
    )


def high_participation_20(t: Inputs, year: str = REPORT_YEAR, above: float = 0.20) -> DataFrame:
    rates = participation_by_year_zcta(t).filter(
        (F.col("year") == year) & (F.col("participation_rate") > above)
    )
    return (
        t.income.filter(~F.col("zcta").isin(*POST_OFFICES))
        .select("zcta", "median_hh_income")
        .join(t.minority.select("zcta", "pct_minority"), "zcta")
        .join(t.english.select("zcta", "pct_low_english"), "zcta")
        .join(rates.select("zcta", "participation_rate", "supplier_customers"), "zcta")
        .join(_places(t), "zcta")
        .select(
            "zcta",
            "po_name",
            "participation_rate",
            "supplier_customers",
            "median_hh_income",
            "pct_minority",
            "pct_low_english",
        )
        .distinct()
    )


def overpayment_by_demographics(t: Inputs) -> DataFrame:
    """Net amount and its ratio to kWh per year in the areas of each criterion."""
    criteria = {
        "Median Income Less than $50,000": (t.income, F.col("median_hh_income") < LOW_INCOME),
        "Greater than 35% Minorities": (
            t.minority,
            F.col("pct_minority") > F.lit(HIGH_MINORITY).cast("decimal(4,3)"),
        ),
        "Greater than 10% Low English Proficiency": (
            t.english,
            F.col("pct_low_english") > F.lit(HIGH_LOW_ENGLISH).cast("decimal(4,3)"),
        ),
    }
    return (
        by_membership(overpayment_per_kwh_zcta_year(t), criteria, "zcta")
        .groupBy("section", F.col("year_charge").alias("year"))
        .agg(
            F.sum("net_overpayment").alias("net_overpayment"),
            ratio(F.sum("net_overpayment"), F.sum("totalkwh")).alias("overpay_kwh"),
        )
    )


def _extremes_per_kwh(
    t: Inputs, dim: DataFrame, by: str, year: str, n_low: int, n_high: int
) -> DataFrame:
    areas = _per_kwh(t, t.cells.filter(F.col("year_charge") == year))
    joined = dim.select("zcta", by).join(
        areas.select(
            "zcta", "net_overpayment", F.col("overpayment_per_kwh").alias("overpayment_kwh")
        ),
        "zcta",
    )
    return top_bottom(joined, by, n_low, n_high, tie="zcta")


def topbottom_minority(
    t: Inputs, year: str = REPORT_YEAR, n_low: int = 10, n_high: int = 10
) -> DataFrame:
    return _extremes_per_kwh(t, t.minority, "pct_minority", year, n_low, n_high)


def topbottom_income(
    t: Inputs, year: str = REPORT_YEAR, n_low: int = 10, n_high: int = 10
) -> DataFrame:
    return _extremes_per_kwh(t, t.income, "median_hh_income", year, n_low, n_high)


def topbottom_english(
    t: Inputs, year: str = REPORT_YEAR, n_low: int = 10, n_high: int = 10
) -> DataFrame:
    return _extremes_per_kwh(t, t.english, "pct_low_english", year, n_low, n_high)


_SAVE_COLUMNS: Sequence[str] = (
    "bills_with_savings",
    "savings_per_kwh",
    "savings_per_bill",
    "bills_with_overpay",
    "overpayment_per_kwh",
    "overpayment_per_bill",
)


def _extremes_save(
    t: Inputs, dim: DataFrame, by: str, year: str, n_low: int, n_high: int
) -> DataFrame:
    joined = dim.select("zcta", by).join(
        save_overpay_by_zcta(t, year).select("zcta", *_SAVE_COLUMNS), "zcta"
    )
    return top_bottom(joined, by, n_low, n_high, tie="zcta")


def save_topbottom_minority(
    t: Inputs, year: str = REPORT_YEAR, n_low: int = 15, n_high: int = 10
) -> DataFrame:
    return _extremes_save(t, t.minority, "pct_minority", year, n_low, n_high)


def save_topbottom_income(
    t: Inputs, year: str = REPORT_YEAR, n_low: int = 10, n_high: int = 10
) -> DataFrame:
    return _extremes_save(t, t.income, "median_hh_income", year, n_low, n_high)


def save_topbottom_english(
    t: Inputs, year: str = REPORT_YEAR, n_low: int = 15, n_high: int = 10
) -> DataFrame:
    return _extremes_save(t, t.english, "pct_low_english", year, n_low, n_high)


def public_extract(t: Inputs) -> DataFrame:
    """Customers and net amount by year, postal code, place, supplier, utility.

    Bills are aggregated before the crosswalk is joined; the second aggregate
    only adds up codes the crosswalk lists more than once for one place.
    """
    keys = ["year_charge", "zipcode", "supplier", "edc"]
    small = t.cells.groupBy(*keys).agg(
        F.sum("num_customers").alias("total_customers"), net().alias("net_overpayment")
    )
    area = t.crosswalk.select("zipcode", "zcta", F.col("po_name").alias("municipality"))
    return (
        small.join(area, "zipcode", "left")
        .groupBy(
            F.col("year_charge").alias("year"), "zipcode", "zcta", "municipality", "supplier", "edc"
        )
        .agg(
            F.sum("total_customers").alias("total_customers"),
            F.sum("net_overpayment").alias("net_overpayment"),
        )
    )


def census_extract(t: Inputs) -> DataFrame:
    return (
        t.crosswalk.select("zipcode", "zcta")
        .join(t.income.select("zcta", "count_households", "median_hh_income"), "zcta")
        .join(t.minority.select("zcta", "pct_minority"), "zcta")
        .join(t.english.select("zcta", "pct_low_english"), "zcta")
        .join(t.population.select("zcta", "total_population"), "zcta")
    )


def revenue_origin_by_income(t: Inputs, year: str = REPORT_YEAR) -> DataFrame:
    """Gross overpayment and participation of one year by area and income."""
    bills = split_year(t, year).select("zcta", "gross_overpayment")
    rates = (
        participation_by_year_zcta(t)
        .filter(F.col("year") == year)
        .select("zcta", "participation_rate")
    )
    return (
        t.income.select("zcta", "geographic_name", "median_hh_income")
        .join(bills, "zcta")
        .join(rates, "zcta")
    )


def split_year(t: Inputs, year: str) -> DataFrame:
    """``overpayment_by_zcta_year`` of one year; the year filter reaches the scan."""
    return overpayment_by_zcta_year(t).filter(F.col("year_charge") == year)
