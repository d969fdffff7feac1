"""Report shaping: sections, totals, extremes and control totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def report(sections: Mapping[str, DataFrame], column: str = "section") -> DataFrame:
    """Stack results under a section column."""
    named = [df.select(F.lit(name).alias(column), "*") for name, df in sections.items()]
    return reduce(DataFrame.unionByName, named)


def with_total(
    df: DataFrame,
    label_col: str,
    label: str,
    aggs: Mapping[str, Column],
    within: Sequence[str] = (),
) -> DataFrame:
    """Per-label aggregates and their grand total in one pass.

    ``within`` are further columns the rows are kept apart by; they are NULL in
    the total.  Grouping sets expand every input row to two, so hand in an already
    aggregated frame of few rows, as the report products do.
    """
    keys = [label_col, *within]
    grouped = df.groupingSets([keys, []], *keys).agg(
        F.grouping(label_col).alias("_total"), *[c.alias(n) for n, c in aggs.items()]
    )
    return grouped.select(
        F.when(F.col("_total") == 1, F.lit(label)).otherwise(F.col(label_col)).alias(label_col),
        *within,
        *aggs,
    )


def top_bottom(df: DataFrame, by: str, n_low: int, n_high: int, tie: str) -> DataFrame:
    """The ``n_low`` lowest and ``n_high`` highest rows by a measure.

    Two ``orderBy().limit()`` would compute ``df`` twice.  Here each row is offered once to
    either side and numbered within it; since the number is compared with a constant, Spark keeps only
    the first rows of each side in every partition before it shuffles them, so that of any
    number of rows ``2 * max(n_low, n_high)`` a partition meet.  ``tie`` makes
    the choice among equal values stable.  A row on both sides is returned once.
    """
    side, nth = "_side", "_nth"
    offered = df.filter(F.col(by).isNotNull()).withColumn(side, F.explode(F.array(F.lit(0), F.lit(1))))
    # Within a side the other one's key is missing throughout.
    order = [
        F.when(F.col(side) == 0, F.col(by)).asc(),
        F.when(F.col(side) == 1, F.col(by)).desc(),
        F.col(tie).asc(),
    ]
    first = offered.withColumn(nth, F.row_number().over(Window.partitionBy(side).orderBy(*order)))
    most = F.when(F.col(side) == 0, n_low).otherwise(n_high)
    kept = first.filter(F.col(nth) <= max(n_low, n_high)).filter(F.col(nth) <= most)
    return kept.drop(side, nth).distinct()


def control_totals(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Row count and sums after a load, by keys."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rec_count"), *[F.sum(c).alias(f"sum_{c}") for c in sums]
    )
