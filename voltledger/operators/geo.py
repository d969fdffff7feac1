"""Postal code -> census area roll-up and demographic selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.functions import strict_sum


def attach_area(
    df: DataFrame,
    crosswalk: DataFrame,
    zipcode: str = "zipcode",
    columns: Sequence[str] = ("zcta",),
) -> DataFrame:
    """Left join of the crosswalk in which a missing code matches a missing code.

    ``df`` should be aggregated by postal code already, so that only one row per
    code and group meets the crosswalk, never the bills.
    """
    area = crosswalk.select(F.col("zipcode").alias("_zip"), *columns)
    return df.join(area, F.col(zipcode).eqNullSafe(F.col("_zip")), "left").drop("_zip")


def rollup_geo(
    df: DataFrame,
    crosswalk: DataFrame,
    sums: Sequence[str],
    keys: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Re-aggregate postal-code totals to census areas (NULL area included)."""
    total = strict_sum if strict else F.sum
    return (
        attach_area(df, crosswalk)
        .groupBy("zcta", *keys)
        .agg(*[total(c).alias(c) for c in sums])
    )


def keep_in(df: DataFrame, dim: DataFrame, key: str, predicate: Column) -> DataFrame:
    """Rows whose key is in the dimension's selected keys (semi join)."""
    return df.join(dim.filter(predicate).select(key), key, "left_semi")


def by_membership(
    df: DataFrame, groups: Mapping[str, tuple[DataFrame, Column]], key: str, label: str = "section"
) -> DataFrame:
    """``keep_in`` for several selections at once: rows tagged with each selection
    their key belongs to.

    The selections become one small (label, key) list, so the facts are read once
    however many selections there are; a row appears once per selection.
    """
    members = reduce(
        DataFrame.unionByName,
        [dim.filter(p).select(F.lit(name).alias(label), key) for name, (dim, p) in groups.items()],
    ).distinct()
    return df.join(members, key)
