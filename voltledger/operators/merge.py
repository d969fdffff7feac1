"""Full outer merge of two aggregated results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_full(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on ``keys``; each key is taken from the side that has it.

    A NULL key matches nothing and keeps its row.  Inputs grouped by the same keys
    are already partitioned for the join, so it adds no shuffle.
    """
    left, right = a.alias("a"), b.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    rest_a = [F.col(f"a.{c}") for c in a.columns if c not in keys]
    rest_b = [F.col(f"b.{c}") for c in b.columns if c not in keys]
    merged = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    return left.join(right, on, "full").select(*merged, *rest_a, *rest_b)
