"""Stand-in inputs derived from the given order tables.

The given tables hold no billing data, so every conformed input is derived from
them by Spark, row for row, and grows with them.  The derivation gives bills the
types, value ranges and blemishes of real extracts (missing and negative values,
foreign and malformed postal codes, utility spellings, months without a standard
rate).  ``oracles.py`` states the same derivation in SQL.

A line item is one bill line; ship dates are moved 20 years so that the report
years 2017-2021 are covered.  A line's discount and tax steps give its ``mark``
(0-98), which decides its blemish.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.operators import (
    accepted,
    additive,
    clean_bills,
    compare_rates,
    conform_amenities,
    conform_bills,
    conform_landed,
    merged,
    rejected,
    stack,
)
from voltledger.plans import Inputs
from voltledger.plans.inputs import CELL_KEYS
from voltledger.session import ends_with_session, shared_folder, small_methods
from voltledger.sources import (
    AMENITY_SPECS,
    BILL_SPECS,
    CORRECTIONS,
    acs_income,
    clean_amenities,
    green_usage,
    low_english,
    minority_share,
    participation_counts,
    population,
    rate_sheet,
    write_by,
    zip_crosswalk,
)
from voltledger.sources.usage import PARTICIPATION_COLUMNS, load_green, load_rate_sheet

YEAR_SHIFT = 20
UNCOVERED_YEAR = "2014"

# Bill extract and the supplier name its rows carry.
SUPPLIERS = {
    "cne": "Constellation NewEnergy Inc",
    "mega": "Mega Energy",
    "think": "Think Energy",
    "wattifi": "Wattifi",
    "xoom": "XOOM",
    "ambit": "Ambit Energy",
    "ctge": "CTG&E",
    "viridian": "Viridian Energy",
    "public": "Public Power",
    "er": "Energy Rewards",
    "residents": "Residents Energy",
    "townsquare": "Town Square Energy",
    "major": "Major Energy",
    "nge": "NGE",
    "starion": "Starion Energy",
    "atlantic": "Atlantic Energy",
    "direct": "Direct Energy",
    "energyplus": "Energy Plus",
    "spark": "Spark Energy",
    "nap": "North American Power",
    "reliant": "Reliant Energy",
    "verde": "Verde Energy",
    "clearview": "ClearView Electric",
}

# Amenity extract and the supplier name its rows carry.
AMENITY_SUPPLIERS = {
    "ambit": "Ambit Energy",
    "atlantic": "Atlantic Energy",
    "clearview": "Clearview",
    "constellation": "Constellation",
    "ctge": "CTG&E",
    "direct": "Direct",
    "energyplus": "energyplus",
    "er": "Energy Rewards",
    "nap": "North American Power",
    "public": "Public Power",
    "reliant": "Reliant Energy",
    "townsquare_2018": "Town Square Energy",
    "townsquare_2019": "Town Square Energy",
    "townsquare_2020": "Town Square Energy",
    "townsquare_2021": "Town Square Energy",
    "verde": "Verde Energy",
    "xoom_extras": "XOOM Energy",
    "xoom_rewards": "XOOM Energy",
    "xoom_miles": "XOOM Energy",
    "xoom_donation": "XOOM Energy",
}

EV_SPELLINGS = (
    "Eversource (CL&P)",
    "Eversource Energy - CT",
    "Connecticut Light & Power",
    "Connecticut Light and Power",
    "Eversource",
    "CL&P",
    "CLP",
)
UI_SPELLINGS = ("UIC", "United Illum", "United Illuminating", "UI", "UI", "Norwich Utilities", None)

# Extracts that write a mark instead of a missing term, and what the mark means.
TERM_MARKS = {
    "think": "n/a",
    "xoom": "n/a",
    "ambit": "n/a",
    "ctge": "n/a",
    "public": "Unknown",
    "nge": "NA",
    "direct": "NULL",
    "energyplus": "Month-To-Month",
    "nap": "NULL",
    "reliant": "Month-To-Month",
    "clearview": "NULL",
}
COMMENCEMENT_MARKS = {
    "public": "See Response to EOE-6",
    "direct": "NULL",
    "energyplus": "Month-To-Month",
    "nap": "See Narrative",
    "reliant": "Month-To-Month",
    "clearview": "NULL",
}
MARK_IS_ONE_MONTH = ("nge", "direct", "energyplus", "nap", "reliant", "clearview")
MARK_IS_CHARGE_MONTH = ("direct", "energyplus", "nap")
MARK_IS_MISSING = ("public", "reliant", "clearview")
# Extracts that kept the leading zero; a lost code stays missing only there.
WHOLE_ZIP = tuple(s.name for s in BILL_SPECS if s.zip_prefix == "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values) -> Column:
    """values[index] as one indexed literal array."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def _cents(c: str) -> Column:
    return F.floor(F.col(c) * 100 + F.lit(0.5))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of a bill line as plain numbers."""
    mark = _cents("l_discount") * 9 + _cents("l_tax")
    late = (mark == 88) & (F.col("l_quantity") == 50) & (F.col("l_linenumber") <= 4)
    year = F.year("l_shipdate") + YEAR_SHIFT
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % len(SUPPLIERS)).cast("int").alias("who"),
        mark.cast("int").alias("mark"),
        F.when(late, int(UNCOVERED_YEAR)).otherwise(year).alias("y"),
        F.month("l_shipdate").alias("m"),
        (_cents("l_extendedprice") % 30011).alias("price"),
        (F.col("l_orderkey") % 1000).cast("int").alias("place"),
        F.col("l_linenumber").alias("n"),
        F.col("l_quantity").cast("int").alias("qty"),
        (F.col("l_partkey") % 12 + 1).cast("int").alias("start_month"),
        (F.col("l_partkey") % 49).cast("int").alias("months"),
        F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("flag"),
    )


# Marks of the lines whose cell is spoilt, and what stands there.
SPOILT = {"charge": (80, "Total:"), "commencement": (81, "Total: x"), "kwh": (82, "1,5")}


def _is(names) -> Column:
    keys = list(SUPPLIERS)
    return F.col("who").isin(*[keys.index(n) for n in names])


def _rate() -> Column:
    hundred_thousandths = F.lit(3000) + F.col("price")
    rate = (hundred_thousandths.cast("decimal(11,0)") * F.lit("0.00001").cast("decimal(5,5)")).cast(
        schemas.RATE
    )
    return (
        F.when(F.col("mark") == 96, F.lit(None))
        .when(F.col("mark") == 95, F.lit("-0.05").cast(schemas.RATE))
        .otherwise(rate)
    )


def _kwh() -> Column:
    tenths = F.col("qty") * 205
    kwh = (tenths.cast("decimal(9,0)") * F.lit("0.1").cast("decimal(1,1)")).cast(schemas.KWH)
    return (
        F.when(F.col("mark") == 98, F.lit(None))
        .when(F.col("mark") == 97, -kwh)
        .when(F.col("mark") == 87, F.lit(0).cast(schemas.KWH))
        .otherwise(kwh)
    )


def _customers() -> Column:
    return (
        F.when((F.col("mark") == 89) & (F.col("qty") == 50) & (F.col("n") <= 2), F.lit(None))
        .when(F.col("mark") == 86, F.lit(0))
        .otherwise(F.col("n"))
    )


def _zip() -> Column:
    place = F.lpad(F.col("place").cast("string"), 3, "0")
    return (
        F.when(F.col("mark") == 94, F.concat(F.lit("07"), place))
        .when(F.col("mark") == 93, F.concat(F.lit("06"), F.substring(place, 2, 2)))
        .when((F.col("mark") == 91) & _is(WHOLE_ZIP), F.lit(None))
        .when(F.col("mark").isin(90, 91), F.lit("0NA"))
        .otherwise(F.concat(F.lit("06"), place))
    )


def _edc() -> Column:
    return F.when(F.col("status") == "O", _pick(F.col("n") - 1, EV_SPELLINGS)).otherwise(
        _pick(F.col("n") - 1, UI_SPELLINGS)
    )


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conformed bills before cleansing: one projection of the line items."""
    marked = F.col("months") == 0
    text_year, text_month = F.col("y").cast("string"), F.lpad(F.col("m").cast("string"), 2, "0")
    no_start = _is(("residents", "starion"))
    start_year = (
        F.when(no_start | (marked & _is(MARK_IS_MISSING)), F.lit(None))
        .when(marked & _is(MARK_IS_CHARGE_MONTH), text_year)
        .otherwise((F.col("y") - 1).cast("string"))
    )
    start_month = (
        F.when(no_start | (marked & _is(MARK_IS_MISSING)), F.lit(None))
        .when(marked & _is(MARK_IS_CHARGE_MONTH), text_month)
        .otherwise(F.lpad(F.col("start_month").cast("string"), 2, "0"))
    )
    term = (
        F.when(_is(("starion",)) | (marked & _is(MARK_IS_ONE_MONTH)), F.lit(1))
        .when(marked, F.lit(None))
        .otherwise(F.col("months"))
    )
    out = {
        "supplier": _pick(F.col("who"), SUPPLIERS.values()),
        "year_charge": text_year,
        "month_charge": text_month,
        "billed_rate": _rate(),
        "zipcode": _zip(),
        "num_customers": _customers(),
        "totalkwh": _kwh(),
        "year_commencement": start_year,
        "month_commencement": start_month,
        "contractterm": term,
        "servicechargesfees": F.col("n") % 3,
        "term_fee": F.when(_is(("starion",)), F.lit(0)).otherwise(F.col("n") % 4 * 50),
        "num_terminations": F.when(F.col("n") == 7, 1).otherwise(0),
        "edc": _edc(),
    }
    return _lines(spark, sf_dir).select(
        *[out[f.name].cast(f.dataType).alias(f.name) for f in schemas.BILLS]
    )


def landed_bills(spark: SparkSession, sf_dir: str, spoilt: bool = False) -> DataFrame:
    """The same bill lines as every supplier's extract would write them.

    ``spoilt`` puts a text that can't be read into a charge month, a commencement or the kWh of some lines.
    """
    names = list(SUPPLIERS)
    by_style: dict[str, list[str]] = {}
    starts: dict[str, list[str]] = {}
    for spec in BILL_SPECS:
        by_style.setdefault(spec.charge, []).append(spec.name)
        starts.setdefault(spec.commencement, []).append(spec.name)

    def written(styles: dict[str, list[str]], year: Column, month: Column) -> Column:
        day = F.make_date(year, month, F.lit(15))
        two = F.lpad((year % 100).cast("string"), 2, "0")
        texts = {
            "ym": F.date_format(day, "yyyy-MM"),
            "name_yy": F.concat(F.date_format(day, "MMMM"), F.lit("-"), two),
            "name_yyyy": F.date_format(day, "MMM-yyyy"),
            "m_yy": F.concat(month.cast("string"), F.lit("/"), two),
            "serial": F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"),
            "none": F.lit(None).cast("string"),
        }
        out = F
        for style, members in styles.items():
            out = out.when(_is(members), texts[style])
        return out

    def mark_of(marks: dict[str, str]) -> Column:
        return _pick(F.col("who"), [marks.get(n) for n in names])

    marked = F.col("months") == 0
    start = written(starts, F.col("y") - 1, F.col("start_month"))
    zipcode = _zip()
    # Extracts that lost the leading zero; a lost code comes out as 0NA again.
    short = F.when(zipcode == "0NA", F.lit(None)).otherwise(F.substring(zipcode, 2, 4))
    months = F.col("months").cast("string")
    fee = (F.col("n") % 4 * 50).cast("string")
    ended = F.when(F.col("n") == 7, "1").otherwise("0")

    def cell(name: str, text: Column) -> Column:
        if spoilt and name in SPOILT:
            mark, bad = SPOILT[name]
            text = F.when(F.col("mark") == mark, F.lit(bad)).otherwise(text)
        return text.alias(name)

    return _lines(spark, sf_dir).select(
        _pick(F.col("who"), names).alias("extract"),
        _pick(F.col("who"), SUPPLIERS.values()).alias("supplier"),
        cell("charge", written(by_style, F.col("y"), F.col("m"))),
        _rate().cast("string").alias("rate"),
        F.when(_is(WHOLE_ZIP), F.rpad(zipcode, 7, " ")).otherwise(short).alias("zip"),
        _customers().cast("string").alias("customers"),
        cell("kwh", _kwh().cast("string")),
        cell(
            "commencement",
            F.when(marked & _is(COMMENCEMENT_MARKS), mark_of(COMMENCEMENT_MARKS)).otherwise(start),
        ),
        F.when(marked, mark_of(TERM_MARKS))
        .when(_is(("think",)), F.concat(months, F.lit(" Months")))
        .otherwise(months)
        .alias("term"),
        (F.col("n") % 3).cast("string").alias("service_fee"),
        F.when(_is(("nap",)) & (fee == "0"), "NULL").otherwise(fee).alias("term_fee"),
        F.when(_is(("nap",)) & (ended == "0"), "NULL").otherwise(ended).alias("terminations"),
        _edc().alias("edc"),
    )


def conformed_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract text, stored by extract, back to bills through the supplier specs."""
    landed = _store(spark, sf_dir, "landed_bills", landed_bills, part="extract")
    return conform_landed(landed, BILL_SPECS, conform_bills)


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows by load and unfit columns, where some bills, rates and green lines can't be read."""
    landed = _store(spark, sf_dir, "spoilt_bills", lambda s, d: landed_bills(s, d, spoilt=True), part="extract")
    no_rate = F.when(F.col("month") % 5 == 0, "n/a").otherwise(F.col("eversource_rate").cast("string"))
    no_count = F.when(F.col("num_customers") == 7, "n/a").otherwise(F.col("num_customers").cast("string"))
    loads = {
        "bills": conform_landed(landed, BILL_SPECS, conform_bills),
        "rate_sheet": load_rate_sheet(raw_rates(spark, sf_dir).withColumn("eversource_rate", no_rate)),
        "green": load_green(raw_green(spark, sf_dir).withColumn("num_customers", no_count)),
    }
    bad = [rejected(df).select(F.lit(name).alias("load"), "load_errors") for name, df in loads.items()]
    return stack(bad).groupBy("load", "load_errors").agg(F.count("*").alias("count"))


def changed_bills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bills as first delivered, those that came later and those that were taken back.

    A tenth of all bills is late, and of another tenth the first delivery has other kWh and customers. The
    first delivery without the last ones and with the late ones makes up ``bills``.
    """
    rows = inputs(spark, sf_dir).bills
    tenth = F.pmod(F.xxhash64(*rows.columns), F.lit(10))
    wrong = rows.where(tenth == 1).withColumns(
        {"totalkwh": (F.col("totalkwh") + 7).cast("decimal(10,1)"), "num_customers": F.nullif(F.col("num_customers") + 1, F.lit(3))}
    )
    return rows.where(tenth > 1).unionByName(wrong), rows.where(tenth < 2), wrong


def after_changes(spark: SparkSession, sf_dir: str) -> Inputs:
    """Inputs whose cells come from the first delivery's cells and the changes."""
    t = inputs(spark, sf_dir)
    first, added, removed = (compare_rates(clean_bills(b), t.rate_sheet) for b in changed_bills(spark, sf_dir))
    sides = added.withColumn("side", F.lit(1)).unionByName(removed.withColumn("side", F.lit(-1)))
    return t.replaced(cells=merged(additive(first, CELL_KEYS), additive(sides, [*CELL_KEYS, "side"]), CELL_KEYS))


def green(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on a green choice; raw, so postal codes play no part."""
    return green_usage(raw_green(spark, sf_dir))


def raw_green(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).filter(F.col("flag") == "R")
    return (
        lines.select(
            _pick(F.col("who"), SUPPLIERS.values()).alias("supplier"),
            F.col("y").cast("string").alias("year_charge"),
            _customers().alias("num_customers"),
            F.when(F.col("n") > 3, "100% renewable").otherwise("50% renewable").alias(
                "specific_commitment"
            ),
            _rate().alias("billed_rate"),
            _kwh().alias("totalkwh"),
        )
    )


def raw_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sheet in cents: 7 to 13 and 8 to 14, from the month's prices."""
    months = table(spark, sf_dir, "lineitem").groupBy(
        (F.year("l_shipdate") + YEAR_SHIFT).alias("year"), F.month("l_shipdate").alias("month")
    )
    mean = F.expr("total div lines")
    sheet = months.agg(
        F.sum(_cents("l_extendedprice")).alias("total"), F.count(F.lit(1)).alias("lines")
    )

    def cents(base: int, value: Column) -> Column:
        parts = (value % 60000).cast("decimal(9,0)") * F.lit("0.0001").cast("decimal(4,4)")
        return (parts + base).cast("decimal(6,4)")

    return sheet.select(
        F.col("year"),
        F.col("month"),
        cents(7, mean).alias("eversource_rate"),
        cents(8, F.expr("total div lines div 7")).alias("ui_rate"),
    )


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .select((F.col("c_custkey") % 1000).cast("int").alias("place"))
        .distinct()
    )


def _area(place: Column) -> Column:
    return F.concat(
        F.lit("06"), F.lpad(F.call_function("div", place, F.lit(4)).cast("string"), 3, "0")
    )


def raw_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per postal code; every 50th lies in another state."""
    place = F.col("place")
    return _places(spark, sf_dir).select(
        F.concat(F.lit("06"), F.lpad(place.cast("string"), 3, "0")).alias("ZIP_CODE"),
        F.concat(F.lit("Town "), F.call_function("div", place, F.lit(2)).cast("string")).alias(
            "PO_NAME"
        ),
        F.when(place % 50 == 49, "NY").otherwise("CT").alias("STATE"),
        F.lit("Zip Code Area").alias("ZIP_TYPE"),
        _area(place).alias("ZCTA"),
        F.lit("Zip matches ZCTA").alias("zip_join_type"),
    )


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return customers.groupBy(_area((F.col("c_custkey") % 1000).cast("int")).alias("area")).agg(
        F.count(F.lit(1)).alias("households"),
        F.sum(_cents("c_acctbal")).alias("balance"),
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"),
        F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("machinery"),
    )


def raw_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income sheet as text, heading row included."""
    income = F.expr("balance div households div 5")
    rows = _areas(spark, sf_dir).select(
        F.concat(F.lit("ZCTA5 "), F.col("area")).alias("geographic_name"),
        F.col("households").cast("string").alias("count_households"),
        F.when(income > 160000, "250,000+")
        .when(income < 30000, "-")
        .otherwise(income.cast("string"))
        .alias("median_hh_income"),
    )
    heading = spark.range(1).select(
        F.lit("Geographic Area Name").alias("geographic_name"),
        F.lit("Estimate!!Households!!Total").alias("count_households"),
        F.lit("Estimate!!Households!!Median income (dollars)").alias("median_hh_income"),
    )
    return rows.unionByName(heading)


def raw_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("building").cast("double") / F.col("households")
    white = (F.col("households") - F.col("building")) * 1000
    return _areas(spark, sf_dir).select(
        F.concat(F.lit("860Z200US"), F.col("area")).alias("c0"),
        F.concat(F.lit("ZCTA5 "), F.col("area")).alias("c1"),
        (F.call_function("div", white, F.col("households")).cast("decimal(9,0)") * F.lit("0.1").cast("decimal(1,1)"))
        .cast("string")
        .alias("c2"),
        share.cast("string").alias("c3"),
    )


def raw_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.expr("machinery * 1000 div households").cast("decimal(9,0)")
    return _areas(spark, sf_dir).select(
        F.col("area").alias("c0"),
        F.col("households").cast("string").alias("c1"),
        F.col("machinery").cast("string").alias("c2"),
        (share * F.lit("0.001").cast("decimal(3,3)")).cast("string").alias("c3"),
    )


def raw_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir).select(
        F.concat(F.lit("ZCTA5 "), F.col("area")).alias("Area"),
        (F.col("households") * 3).cast("string").alias("Total_population"),
    )


def participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts by postal code, year and utility, as one sheet of answers."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(
            F.lit("06"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0")
        ).alias("zip"),
        (F.year("o_orderdate") + YEAR_SHIFT).alias("year"),
        (F.col("o_orderstatus") != "O").alias("switched"),
        (F.col("o_orderkey") % 2 == 0).alias("ev"),
    )
    counts = orders.groupBy("zip", "year", "ev").agg(
        # A count of zero is left empty in the answers.
        F.nullif(F.count_if("switched"), F.lit(0)).alias("num_custs_supplier"),
        F.nullif(F.count_if(~F.col("switched")), F.lit(0)).alias("num_custs_edc"),
        F.count(F.lit(1)).alias("tot_custs"),
    )

    headings = PARTICIPATION_COLUMNS["Eversource"]
    sheet = counts.select(
        *[F.col(c).cast("string").alias(h) for c, h in headings.items()], "ev"
    )
    return participation_counts(
        sheet, F.when(F.col("ev"), "Eversource").otherwise("UI"), headings
    )


def landed_amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as amenity lines the way every supplier's extract writes them."""
    names = [s.name for s in AMENITY_SPECS]
    who = F.col("user_id") % len(names)
    kind = F.col("event_type")
    value = _cents("value").cast("decimal(12,0)") * F.lit("0.01").cast("decimal(2,2)")
    year = 2016 + F.col("event_id") % 7
    hard_names = {
        "view": "Hulu subscription",
        "click": "5% of 12 month kwh expenditure",
        "error": "$75 and ongoing free weekend charging (up to 250kwh)",
        "purchase": "1USB Battery Bank",
    }
    hard = F
    for event, text in hard_names.items():
        hard = hard.when(kind == event, F.lit(text))
    hard = hard.otherwise(kind)
    extract = _pick(who, names)
    return table(spark, sf_dir, "events").select(
        extract.alias("extract"),
        _pick(who, [AMENITY_SUPPLIERS[n] for n in names]).alias("supplier"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None))
        .when((extract == "clearview") & (kind == "signup"), F.concat(year.cast("string"), F.lit(" to date")))
        .otherwise(year.cast("string"))
        .alias("year"),
        F.when(extract == "clearview", hard)
        .when((extract == "nap") & (kind == "view"), "Understandabill")
        .when(extract == "direct", F.concat(kind, F.lit(" credit on the first bill of a new contract term")))
        .otherwise(kind)
        .alias("amenity"),
        F.when((extract == "clearview") & (kind == "click"), "5% of use")
        .otherwise(value.cast("decimal(10,2)").cast("string"))
        .alias("value"),
        F.when((extract == "direct") & (kind == "error"), "NULL")
        .otherwise((1 + F.col("event_id") % 20).cast("string"))
        .alias("redeemed"),
        F.when(kind == "error", F.lit(None))
        .otherwise((value * 3).cast("decimal(12,2)").cast("string"))
        .alias("cost"),
    )


def amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _store(spark, sf_dir, "landed_amenities", landed_amenities, part="extract")
    loaded = conform_landed(
        landed, AMENITY_SPECS, lambda rows, spec: conform_amenities(rows, spec, CORRECTIONS)
    )
    return clean_amenities(accepted(loaded))


_stored: dict[tuple[str, str, str], DataFrame] = {}


def _store(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    build: Callable[[SparkSession, str], DataFrame],
    part: str | None = None,
) -> DataFrame:
    """A derived input as a stored table of the session, written once.

    Real inputs arrive as stored tables.  Storing the derived ones gives the
    planner their true size, so it broadcasts dimensions only below its threshold,
    lets filters and column lists reach the bill files, and derives nothing twice.
    Without a shared folder it is refused: a lazy input would be derived again by
    each of the branches that read it.  The copies go when the session's JVM ends.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        folder = shared_folder(spark)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        built = build(spark, sf_dir)
        source = re.sub(r"\W+", "_", sf_dir)
        own = ends_with_session(spark, f"{folder}/standins/{key[0]}")
        path = f"{own}/{source}/{name}"
        with small_methods(spark):
            if part:
                write_by(built, path, part)
            else:
                built.write.mode("overwrite").parquet(path)
        _stored[key] = spark.read.schema(built.schema).parquet(path).select(*built.columns)
    return _stored[key]


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    sf_dir = str(sf_dir).rstrip("/")

    def dimension(name: str, source: Callable, raw: Callable) -> Callable[[], DataFrame]:
        return lambda: _store(spark, sf_dir, name, lambda s, d: source(raw(s, d)))

    return Inputs(
        bills=lambda: _store(spark, sf_dir, "bills", bills, part="year_charge"),
        green=lambda: _store(spark, sf_dir, "green", green, part="year_charge"),
        rate_sheet=dimension("rates", rate_sheet, raw_rates),
        income=dimension("income", acs_income, raw_income),
        crosswalk=dimension("crosswalk", zip_crosswalk, raw_crosswalk),
        participation=lambda: participation(spark, sf_dir),
        amenities=lambda: _store(spark, sf_dir, "amenities", amenities),
        minority=dimension("minority", minority_share, raw_minority),
        english=dimension("english", low_english, raw_english),
        population=dimension("population", population, raw_population),
    )
