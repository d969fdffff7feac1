"""One small frame per rule on missing values, rounding, division and text."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from voltledger.functions import (
    excel_date,
    half_even,
    half_year,
    int_or_null,
    money,
    month_number,
    percent,
    ratio,
    strict_sum,
    thousands,
    whole,
    year_month,
    zip_text,
)
from voltledger.operators import clamp_negative, correct, drop_where, normalise


def one(df):
    return [r[0] for r in df.collect()]


def test_strict_sum_is_null_with_one_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, v int")
    out = {r.k: (r.s, r.p) for r in df.groupBy("k").agg(strict_sum("v").alias("s"), F.sum("v").alias("p")).collect()}
    assert out == {"a": (None, 1), "b": (5, 5)}


def test_strict_sum_where_looks_at_matching_rows_only(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (0, None)], "side int, v int")
    row = df.agg(
        strict_sum("v", F.col("side") == 1).alias("hit"),
        strict_sum("v", F.col("side") == 0).alias("null"),
        strict_sum("v", F.col("side") == 9).alias("none"),
    ).first()
    assert tuple(row) == (11, None, None)


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(Decimal("2.5"),), (Decimal("3.5"),), (Decimal("-2.5"),)], "v decimal(5,1)")
    assert one(df.select(whole("v"))) == [2, 4, -2]
    assert one(spark.range(1).select(half_even(F.lit(0.0625), 3))) == [0.062]


def test_ratio_of_zero_is_null(spark):
    df = spark.createDataFrame([(1, 4), (1, 0), (None, 4)], "a int, b int")
    assert one(df.select(ratio("a", "b"))) == [0.25, None, None]


def test_int_or_null(spark):
    df = spark.createDataFrame([("12.7",), ("250,000+",), ("-",), ("-3.9",), (None,), ("9e99",)], "v string")
    assert one(df.select(int_or_null("v"))) == [12, None, None, -3, None, None]


def test_delete_keeps_rows_with_a_null_predicate(spark):
    df = spark.createDataFrame([("06001",), ("07001",), (None,)], "z string")
    assert one(drop_where(df, ~F.col("z").startswith("06"))) == ["06001", None]


def test_text_dates(spark):
    df = spark.createDataFrame([("July",), ("jul",), ("Dec",), ("Smarch",), (None,)], "m string")
    assert one(df.select(month_number("m"))) == ["07", "07", "12", None, None]
    row = spark.range(1).select(
        excel_date(F.lit("43831")).alias("a"),
        excel_date(F.lit("43831"), "1900-01-01").alias("b"),
        excel_date(F.lit("Unknown")).alias("c"),
        year_month(F.lit("2019"), F.lit("7")).alias("d"),
    ).first()
    assert tuple(row) == (date(2020, 1, 1), date(2020, 1, 3), None, "201907")


def test_half_year(spark):
    df = spark.createDataFrame([("01",), ("06",), ("07",), ("12",), (None,), ("x",)], "m string")
    assert one(df.select(half_year("m"))) == [1, 1, 2, 2, None, None]


def test_zip_text(spark):
    df = spark.createDataFrame([("6001",), ("6001  ",), (None,)], "z string")
    assert one(df.select(zip_text("z", "0"))) == ["06001", "06001", "0NA"]
    assert one(df.select(zip_text("z"))) == ["6001", "6001", None]


def test_formats(spark):
    row = spark.range(1).select(
        money(F.lit(1234567.5)).alias("a"),
        money(F.lit(-0.125), 2).alias("b"),
        thousands(F.lit(1234567)).alias("c"),
        percent(F.lit(12.25)).alias("d"),
        money(F.lit(None).cast("double")).alias("e"),
    ).first()
    assert tuple(row) == ("$1,234,568", "-$0.13", "1,234,567", "12.3%", None)


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-1,), (0,), (4,), (None,)], "v int")
    assert one(df.select(clamp_negative(F.col("v")))) == [0, 0, 4, None]


def test_normalise_keeps_unlisted_and_null(spark):
    df = spark.createDataFrame([("CLP",), ("UIC",), ("Other",), (None,)], "edc string")
    out = normalise(df, "edc", {"EV": ["CLP"], "UI": ["UIC", "UI"]})
    assert one(out) == ["EV", "UI", "Other", None]


def test_corrections_match_uncorrected_rows_and_the_last_wins(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "1"), (None, "1")], "k string, v string")
    rules = (({"k": "a"}, {"v": "2", "k": "b"}), ({"k": "b"}, {"v": "3"}), ({"k": "a"}, {"v": "4"}))
    assert [tuple(r) for r in correct(df, rules).collect()] == [("b", "4"), ("b", "3"), (None, "1")]
    assert correct(df, ()) is df


@pytest.mark.parametrize("digits,want", [(0, "$3"), (2, "$2.50")])
def test_money_digits(spark, digits, want):
    assert one(spark.range(1).select(money(F.lit(2.5), digits))) == [want]
