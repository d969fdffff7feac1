"""Writing tables and report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from voltledger.operators.reports import control_totals

BILL_TOTALS = ("billed_rate", "num_customers", "totalkwh", "contractterm")


def append_table(df: DataFrame, name: str) -> None:
    """Append to a table, created on first use."""
    df.write.mode("append").saveAsTable(name)


def overwrite_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def write_by(df: DataFrame, path: str, column: str) -> None:
    """One table partitioned by a column of few values.

    The rebalance hint gives files of the advisory size: adaptive execution
    splits a value that holds much of the data over many tasks and merges small
    ones, where a plain repartition by the column would write each in one task.
    """
    df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)


def write_by_year(df: DataFrame, path: str, year: str = "year_charge") -> None:
    """Yearly table: a reader of one year opens one folder."""
    write_by(df, path, year)


def write_report(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited report with a heading line in every part file."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_load(loaded: DataFrame, path: str, sums: Sequence[str] = ()) -> dict[str, int | float]:
    """Accepted and rejected rows of a load in one pass, apart by folder.

    Returns how many there were of each and the sums of the accepted rows' columns ``sums``, which are
    observed while the rows are written.
    """
    good = F.col("load_errors").isNull()
    seen = Observation()
    metrics = [F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected")]
    metrics += [F.sum(F.when(good, F.col(c))).alias(f"sum_{c}") for c in sums]
    status = F.when(good, "accepted").otherwise("rejected")
    loaded.observe(seen, *metrics).withColumn("load_status", status).write.mode("overwrite").partitionBy(
        "load_status"
    ).parquet(path)
    return seen.get


def bill_audit(bills: DataFrame, keys: Sequence[str] = ("supplier",)) -> DataFrame:
    """Control totals of loaded bills."""
    return control_totals(bills, keys, BILL_TOTALS)
