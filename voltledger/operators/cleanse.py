"""Row removal and value repair on conformed tables (all narrow)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.functions import keep_unless

# Spellings of the two utilities in the extracts.
UTILITY_NAMES = {
    "UI": ("UIC", "United Illum", "United Illuminating", "UI"),
    "EV": (
        "Eversource (CL&P)",
        "Eversource Energy - CT",
        "Connecticut Light & Power",
        "Connecticut Light and Power",
        "Eversource",
        "CL&P",
        "CLP",
    ),
}


def drop_where(df: DataFrame, *predicates: Column) -> DataFrame:
    """Remove the rows where any predicate is TRUE; NULL keeps the row."""
    return df.filter(keep_unless(*predicates))


def normalise(df: DataFrame, column: str, mapping: Mapping[str, Iterable[str]]) -> DataFrame:
    """Replace listed spellings by their canonical value; others stay."""
    value = F.col(column)
    out = F
    for canonical, spellings in mapping.items():
        out = out.when(value.isin(*spellings), F.lit(canonical))
    return df.withColumn(column, out.otherwise(value))


def correct(
    df: DataFrame,
    corrections: Sequence[tuple[Mapping[str, object], Mapping[str, object]]],
) -> DataFrame:
    """Keyed corrections: each is (columns that must match, columns to set).

    All matches look at the uncorrected row.  The rules are literals in the
    projection, so no join is planned.  Where two rules set the same column of
    one row, the later one wins.
    """
    updates: dict[str, Column] = {}
    for match, values in corrections:
        hit = F.lit(True)
        for name, wanted in match.items():
            hit = hit & (F.col(name) == F.lit(wanted))
        for name, value in values.items():
            before = updates.get(name, F.col(name))
            updates[name] = F.when(hit, F.lit(value)).otherwise(before)
    return df.withColumns(updates) if updates else df


def clamp_negative(value: Column) -> Column:
    """0 for a negative value; NULL stays NULL."""
    return F.when(value < 0, F.lit(0)).otherwise(value)


def clean_bills(bills: DataFrame, zip_prefix: str = "06", zip_length: int = 5) -> DataFrame:
    """Bills fit for comparison: rate and kWh present and not negative, postal
    code in the state, utility names unified.  A missing postal code is kept."""
    # Single null tests, unlike dropna, are handed to the Parquet reader.
    kept = drop_where(
        bills.filter(F.col("billed_rate").isNotNull() & F.col("totalkwh").isNotNull()),
        F.col("totalkwh") < 0,
        F.col("billed_rate") < 0,
        ~F.col("zipcode").startswith(zip_prefix),
        F.length(F.rtrim("zipcode")) != zip_length,
    )
    return normalise(kept, "edc", UTILITY_NAMES)


def clean_green(green: DataFrame) -> DataFrame:
    """Green usage without negative kWh or rates; missing values are kept."""
    return drop_where(green, (F.col("totalkwh") < 0) | (F.col("billed_rate") < 0))
