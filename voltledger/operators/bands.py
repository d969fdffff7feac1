"""Thresholds, bands and pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.operators.overpay import additive


def band_number(column: str, width: int) -> Column:
    """Number of the band of ``width`` a whole number falls in, from 0."""
    return F.call_function("div", F.col(column), F.lit(width))


def bands(column: str, width: int, labels: Sequence[str]) -> Column:
    """Label of the band a value falls in; NULL beyond the last label."""
    return band_label(band_number(column, width), labels)


def band_label(number: Column, labels: Sequence[str]) -> Column:
    out = F
    for i, label in enumerate(labels):
        out = out.when(number == i, F.lit(label))
    return out


def _rows_of(
    df: DataFrame, keys: Sequence[str], label: str, rows: Mapping[str, Mapping[str, Column]]
) -> DataFrame:
    """One wide aggregated row per key -> one row per (key, label)."""
    structs = [
        F.struct(F.lit(name).alias(label), *[c.alias(n) for n, c in cols.items()])
        for name, cols in rows.items()
    ]
    return df.select(*keys, F.inline(F.array(*structs)))


def exceed_counts(
    df: DataFrame,
    column: str,
    thresholds: Mapping[str, float | str],
    weight: str,
    label: str,
    total: str,
) -> DataFrame:
    """Sum of ``weight`` over the rows above each threshold.

    A row counts under every threshold it exceeds.  All thresholds are summed in
    one pass, then laid out as rows.
    """
    limits = [F.lit(str(t)).cast("decimal(18,6)") for t in thresholds.values()]
    sums = [
        F.sum(F.when(F.col(column) > limit, F.col(weight))).alias(f"_t{i}")
        for i, limit in enumerate(limits)
    ]
    wide = df.agg(*sums)
    rows = {name: {total: F.col(f"_t{i}")} for i, name in enumerate(thresholds)}
    return _rows_of(wide, [], label, rows)


def threshold_cells(
    df: DataFrame, keys: Sequence[str], column: str, thresholds: Sequence[float | str], weight: str
) -> DataFrame:
    """Sums of ``weight`` by keys and ``exceeded``, the number of the rising ``thresholds`` a row exceeds.

    A row without a value exceeds none. Cells add up, as rows do; see ``additive`` for what shares one.
    """
    limits = [F.lit(str(t)).cast("decimal(18,6)") for t in thresholds]
    over = [F.coalesce((F.col(column) > limit).cast("int"), F.lit(0)) for limit in limits]
    exceeded = reduce(add, over)
    return additive(df.withColumn("exceeded", exceeded), [*keys, "exceeded"], [weight])


def exceed_totals(cells: DataFrame, labels: Sequence[str], weight: str, label: str, total: str) -> DataFrame:
    """``exceed_counts`` from ``threshold_cells``; labels of the rising thresholds, the highest one's row first.

    What exceeds a threshold is all that exceeds as many or more, so totals are sums over the upper cells.
    """
    sums = [F.sum(F.when(F.col("exceeded") > i, F.col(weight))).alias(f"_t{i}") for i in range(len(labels))]
    wide = cells.agg(*sums)
    rows = {name: {total: F.col(f"_t{i}")} for i, name in reversed(list(enumerate(labels)))}
    return _rows_of(wide, [], label, rows)


def below_above(
    df: DataFrame,
    column: str,
    threshold: object,
    sums: Mapping[str, str],
    keys: Sequence[str] = (),
    label: str = "demo_group",
    names: tuple[str, str] = ("below", "at or above"),
) -> DataFrame:
    """Sums on both sides of a threshold; rows with a NULL measure are on neither.

    Both sides are always present, as the two conditional sums share one pass.
    """
    below, above = F.col(column) < F.lit(threshold), F.col(column) >= F.lit(threshold)
    aggs = []
    for i, cond in enumerate((below, above)):
        aggs += [F.sum(F.when(cond, F.col(src))).alias(f"_{i}_{out}") for out, src in sums.items()]
    wide = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    rows = {name: {out: F.col(f"_{i}_{out}") for out in sums} for i, name in enumerate(names)}
    return _rows_of(wide, keys, label, rows)


def pivot_mean(
    df: DataFrame, row: str, column: str, values: Sequence[object], measure: str
) -> DataFrame:
    """Mean of ``measure`` by row and a stated list of column values.

    The list is required: without it Spark would run a job to collect the values.
    """
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(measure))
