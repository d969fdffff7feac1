"""Operators on hand-made frames, against brute force where there is a choice of form."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.functions import scaled, scaled_sum
from voltledger.operators import (
    attach_area,
    bands,
    below_above,
    by_membership,
    clean_bills,
    compare_rates,
    control_totals,
    exceed_counts,
    keep_in,
    merge_full,
    per_unit_split,
    pivot_mean,
    premium,
    report,
    rollup_geo,
    split,
    standard_rates,
    top_bottom,
    weighted_avg,
    with_total,
)

D = Decimal


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=repr)


def bill(**kw):
    base = dict(
        supplier="S", year_charge="2019", month_charge="07", billed_rate=D("0.12"), zipcode="06001",
        num_customers=1, totalkwh=D("100.0"), year_commencement=None, month_commencement=None,
        contractterm=None, servicechargesfees=0, term_fee=0, num_terminations=0, edc="EV",
    )
    base.update(kw)
    return tuple(base[f.name] for f in schemas.BILLS)


def test_clean_bills_edges(spark):
    cases = [
        bill(supplier="rate null", billed_rate=None),
        bill(supplier="kwh null", totalkwh=None),
        bill(supplier="kwh negative", totalkwh=D("-1.0")),
        bill(supplier="rate negative", billed_rate=D("-0.01")),
        bill(supplier="foreign", zipcode="07001"),
        bill(supplier="short", zipcode="0601"),
        bill(supplier="long", zipcode="060011"),
        bill(supplier="lost", zipcode="0NA"),
        bill(supplier="kept padded", zipcode="06001  "),
        bill(supplier="kept null zip", zipcode=None),
        bill(supplier="kept zero", billed_rate=D("0"), totalkwh=D("0")),
        bill(supplier="kept clp", edc="CL&P"),
        bill(supplier="kept other", edc="Elsewhere"),
        bill(supplier="kept no utility", edc=None),
    ]
    out = clean_bills(spark.createDataFrame(cases, schemas.BILLS))
    kept = {r.supplier: r.edc for r in out.collect()}
    assert kept == {
        "kept padded": "EV",
        "kept null zip": "EV",
        "kept zero": "EV",
        "kept clp": "EV",
        "kept other": "Elsewhere",
        "kept no utility": None,
    }


def sheet(spark):
    return spark.createDataFrame(
        [("2019", "07", D("8.1234"), D("9.0000"), "201907"), ("2019", "08", None, D("9.5"), "201908")],
        schemas.RATE_SHEET,
    )


def test_compare_rates(spark):
    bills = spark.createDataFrame(
        [
            bill(supplier="ev"),
            bill(supplier="ui", edc="UI", billed_rate=D("0.09")),
            bill(supplier="no rate", month_charge="08"),
            bill(supplier="no month", month_charge="09"),
            bill(supplier="unlisted", edc="Elsewhere"),
            bill(supplier="no utility", edc=None),
        ],
        schemas.BILLS,
    )
    out = {r.supplier: r for r in compare_rates(bills, sheet(spark)).collect()}
    assert set(out) == {"ev", "ui", "no rate", "no month"}
    assert out["ev"].standard_rate == D("0.081234")
    assert out["ev"].rate_difference == D("0.038766")
    assert out["ev"].overpayment == D("3.8766") and out["ev"].overpayment_e7 == 38766000
    assert out["ui"].overpayment == 0
    assert out["ev"].year_half == 2
    for name in ("no rate", "no month"):
        assert out[name].overpayment is None and out[name].overpayment_e7 is None


def test_standard_rates_unpivot(spark):
    assert rows(standard_rates(sheet(spark))) == sorted(
        [
            ("201907", "EV", D("0.081234")),
            ("201907", "UI", D("0.090000")),
            ("201908", "EV", None),
            ("201908", "UI", D("0.095000")),
        ],
        key=repr,
    )


def compared(spark, data):
    df = spark.createDataFrame(
        data, "k string, overpayment decimal(18,7), num_customers int, totalkwh decimal(10,1)"
    )
    return df.withColumn("overpayment_e7", (F.col("overpayment") * 10000000).cast("bigint"))


def test_split_edges(spark):
    df = compared(
        spark,
        [
            ("both", D("2.5"), 1, D(10)),
            ("both", D("-1.0"), 2, D(10)),
            ("both", D("0"), 4, D(10)),
            ("savers only", D("-3"), 1, D(10)),
            ("overpayers only", D("3.5"), 1, D(10)),
            ("missing amount", D("1"), 1, D(10)),
            ("missing amount", None, 8, D(10)),
            ("missing customers", D("1"), None, D(10)),
            ("missing customers", D("-1"), 2, D(10)),
        ],
    )
    assert rows(split(df, ["k"])) == sorted(
        [
            # zero counts as underpaid; sums ending in .5 go to the even side
            ("both", 2, 1, -1, 6, 2, 7),
            ("overpayers only", 4, 1, None, None, 4, 1),
            ("missing amount", 1, 1, None, None, None, 9),
            ("missing customers", 1, None, -1, 2, 0, None),
        ],
        key=repr,
    )


def test_split_equals_three_queries(spark):
    rng = random.Random(7)
    data = [
        (
            rng.choice("abcdef"),
            None if rng.random() < 0.02 else D(rng.randint(-500, 500)) / 10,
            None if rng.random() < 0.02 else rng.randint(0, 5),
            D(rng.randint(0, 100)),
        )
        for _ in range(400)
    ]
    df = compared(spark, data)

    def side(cond, names):
        from voltledger.functions import strict_sum, whole

        return df.filter(cond).groupBy("k").agg(
            whole(strict_sum("overpayment")).alias(names[0]), strict_sum("num_customers").alias(names[1])
        )

    v = F.col("overpayment")
    naive = (
        side(v > 0, ("gross_overpayment", "customers_paying_more"))
        .join(side(v <= 0, ("gross_underpayment", "customers_paying_less")), "k", "left")
        .join(side(F.lit(True), ("net_overpayment", "customers_affected")), "k", "left")
    )
    assert rows(split(df, ["k"])) == rows(naive)


def test_premium_and_per_unit(spark):
    df = compared(
        spark,
        [("a", D("4"), 2, D(8)), ("a", D("-1"), 1, D(4)), ("b", D("4"), 2, D(8)), ("c", D("-2"), 0, D(0))],
    )
    assert rows(premium(df.filter("k = 'a'"), ["k"])) == [("a", 3, 3, D("12.0"), 0.25)]
    assert rows(per_unit_split(df, ["k"])) == [
        ("a", 1, -0.25, -1.0, 2, 0.5, 2.0),
        ("c", 0, None, None, None, None, None),
    ]


def test_scaled_amounts_equal_decimals(spark):
    rng = random.Random(11)
    data = [
        (
            D(rng.randint(-999999, 999999)).scaleb(-5),
            D(rng.randint(-9_999_999_999, 9_999_999_999)).scaleb(-1),
        )
        for _ in range(3000)
    ]
    df = spark.createDataFrame(data, "r decimal(6,5), k decimal(10,1)")
    units = scaled("r", 6) * scaled("k", 1)
    exact = (F.col("r") * F.col("k")).cast("decimal(38,7)")
    row = df.select(units.alias("u"), exact.alias("x")).agg(
        scaled_sum("u", 7).alias("a"),
        F.sum("x").alias("b"),
        scaled_sum("u", 7, F.col("u") < 0).alias("c"),
        F.sum(F.when(F.col("x") < 0, F.col("x"))).alias("d"),
    ).first()
    assert row.a == row.b == sum(r * k for r, k in data) and row.c == row.d
    empty = df.filter("false").agg(scaled_sum(scaled("k", 1), 1).alias("s")).first()
    assert empty.s is None


def test_weighted_avg_and_merge_full(spark):
    a = spark.createDataFrame([("1", 10), ("2", 20), (None, 5)], "k string, a int")
    b = spark.createDataFrame([("2", 7), ("3", 8), (None, 6)], "k string, b int")
    merged = merge_full(a, b, ["k"])
    assert rows(merged) == sorted(
        [("1", 10, None), ("2", 20, 7), ("3", None, 8), (None, 5, None), (None, None, 6)], key=repr
    )
    df = spark.createDataFrame([("y", 1.0, 1, 0), ("y", 3.0, 3, 0)], "y string, r double, w int, z int")
    assert rows(weighted_avg(df, ["y"], "r", {"by_w": "w", "by_z": "z"})) == [("y", 2.5, None)]


def crosswalk(spark):
    return spark.createDataFrame([("06001", "06100"), ("06002", "06100")], "zipcode string, zcta string")


def test_rollup_geo_keeps_unmatched_codes_and_is_strict(spark):
    df = spark.createDataFrame(
        [("06001", 1, 1), ("06002", 2, None), ("06999", 4, 4), (None, 8, 8)],
        "zipcode string, a int, b int",
    )
    assert rows(rollup_geo(df, crosswalk(spark), ["a", "b"])) == sorted(
        [("06100", 3, None), (None, 12, 12)], key=repr
    )
    assert rows(rollup_geo(df, crosswalk(spark), ["b"], strict=False)) == sorted(
        [("06100", 1), (None, 12)], key=repr
    )


def test_missing_code_matches_missing_code(spark):
    areas = spark.createDataFrame([(None, "none"), ("06001", "06100")], "zipcode string, zcta string")
    df = spark.createDataFrame([(None,), ("06001",), ("x",)], "zipcode string")
    assert rows(attach_area(df, areas)) == sorted(
        [(None, "none"), ("06001", "06100"), ("x", None)], key=repr
    )


def test_membership_equals_semi_joins(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "zcta string, v int")
    one = spark.createDataFrame([("a", 1), ("a", 1), ("b", 9)], "zcta string, m int")
    two = spark.createDataFrame([("a", 5), ("c", None)], "zcta string, m int")
    low, high = F.col("m") < 5, F.col("m") >= 5
    tagged = by_membership(facts, {"low": (one, low), "high": (two, high)}, "zcta")
    assert rows(tagged, "section", "zcta", "v") == [("high", "a", 1), ("low", "a", 1)]
    assert rows(keep_in(facts, one, "zcta", low)) == [("a", 1)]


def test_bands_and_thresholds(spark):
    df = spark.createDataFrame(
        [(49999, 1), (50000, 2), (80957, 4), (80958, 8), (250000, 16), (None, 32)], "m int, n int"
    )
    labels = ["low", "middle"]
    assert [r[0] for r in df.select(bands("m", 50000, labels)).collect()] == [
        "low", "middle", "middle", "middle", None, None,
    ]
    assert rows(below_above(df, "m", 80958, {"n": "n"})) == [("at or above", 24), ("below", 7)]
    assert rows(below_above(df.filter("m > 90000"), "m", 80958, {"n": "n"})) == [
        ("at or above", 16),
        ("below", None),
    ]
    keyed = df.withColumn("y", F.lit("2021"))
    assert rows(below_above(keyed, "m", 80958, {"n": "n"}, keys=["y"])) == [
        ("2021", "at or above", 24),
        ("2021", "below", 7),
    ]


def test_exceed_counts_nest(spark):
    df = spark.createDataFrame([(D("0.16"), 1), (D("0.10"), 2), (D("0.05"), 4), (None, 8)], "d decimal(9,6), n int")
    out = exceed_counts(df, "d", {"a": "0.15", "b": "0.05", "c": "0.9"}, "n", "over", "bills")
    assert rows(out) == [("a", 1), ("b", 3), ("c", None)]


def test_pivot_mean_leaves_empty_cells_null(spark):
    df = spark.createDataFrame([("r", 12, 1.0), ("r", 12, 3.0), ("s", 99, 1.0)], "k string, t int, v double")
    assert rows(pivot_mean(df, "k", "t", [12, 13], "v")) == [("r", 2.0, None), ("s", None, None)]


def test_with_total_and_report(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 4)], "k string, v int")
    assert rows(with_total(df, "k", "Total", {"v": F.sum("v")})) == sorted(
        [("a", 1), ("b", 2), (None, 4), ("Total", 7)], key=repr
    )
    both = report({"one": df.filter("k = 'a'"), "two": df.filter("k = 'b'")})
    assert rows(both) == [("one", "a", 1), ("two", "b", 2)]


def test_top_bottom_equals_sorting(spark):
    rng = random.Random(3)
    data = [(f"{i:05d}", None if i % 50 == 0 else rng.randint(0, 40)) for i in range(3000)]
    df = spark.createDataFrame(data, "z string, m int").repartition(7)
    known = [r for r in data if r[1] is not None]
    low = sorted(known, key=lambda r: (r[1], r[0]))[:15]
    high = sorted(known, key=lambda r: (-r[1], r[0]))[:10]
    assert rows(top_bottom(df, "m", 15, 10, "z")) == sorted(set(low) | set(high), key=repr)


def test_top_bottom_prunes_before_the_shuffle(spark, tmp_path):
    rng = random.Random(4)
    data = [(f"{i:05d}", rng.randint(0, 10**6)) for i in range(20_000)]
    spark.createDataFrame(data, "z string, m int").repartition(6).write.parquet(str(tmp_path / "t"))
    df = top_bottom(spark.read.parquet(str(tmp_path / "t")), "m", 15, 10, "z")
    low, high = sorted(data, key=lambda r: (r[1], r[0]))[:15], sorted(data, key=lambda r: (-r[1], r[0]))[:10]
    assert rows(df) == sorted(low + high, key=repr)
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    limits = [x.strip(" +-:*") for x in final.splitlines() if "WindowGroupLimit" in x or "Exchange hashpartitioning(_side" in x]
    # From the top: final limit, exchange, limit in every partition; the rows are read once.
    assert ["Final" in limits[0], "Exchange" in limits[1], "Partial" in limits[2]] == [True] * 3 and len(limits) == 3
    assert final.count("FileScan parquet") == 1


def test_top_bottom_of_few_rows_returns_each_once(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "z string, m int")
    assert rows(top_bottom(df, "m", 10, 10, "z")) == [("a", 1), ("b", 2)]


def test_control_totals(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 3)], "k string, v int")
    assert rows(control_totals(df, ["k"], ["v"])) == [("a", 2, 1), ("b", 1, 3)]
