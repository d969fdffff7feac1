"""Conform specs, census sheets and sinks."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.operators import accepted, land, rejected
from voltledger.sources import (
    AMENITY_SPECS,
    BILL_SPECS,
    acs_income,
    append_table,
    bill_audit,
    green_usage,
    load_amenities,
    load_bills,
    low_english,
    minority_share,
    overwrite_table,
    participation_counts,
    population,
    rate_sheet,
    read_extract,
    read_positional,
    union_amenities,
    write_by_year,
    write_load,
    write_report,
    zip_crosswalk,
)

D = Decimal
SPEC = {s.name: s for s in BILL_SPECS}

# One delivered row per supplier: charge, commencement, zip, term, term fee,
# terminations -> year, month, start year, start month, zip, term, fee, terminations.
DELIVERED = {
    "cne": ("2019-07", "2018-01", "6001", "12", "50", "0"),
    "mega": ("2019-07", "2018-01", "6001", "12.0", "50", "0"),
    "think": ("July-19", "January-18", "6001", "12 Months", "50", "0"),
    "wattifi": ("2019-07", "2018-01", "6001", "12", "50", "0"),
    "xoom": ("July-19", "January-18", "6001", "12", "50", "0"),
    "ambit": ("2019-07", "2018-01", "6001", "12", "50", "0"),
    "ctge": ("2019-07", "2018-01", "6001", "12", "50", "0"),
    "viridian": ("2019-07", "2018-01", "6001", "12", "50", "0"),
    "public": ("2019-07", "43115", "6001", "12", "50", "0"),
    "er": ("2019-07", "2018-01", "6001", "12", "50", "0"),
    "residents": ("July-19", None, "6001", "12", "50", "0"),
    "townsquare": ("July-19", "January-18", "06001", "12", "50", "0"),
    "major": ("2019-07", "2018-01", "6001", "12", "50", "0"),
    "nge": ("7/19", "1/18", "6001", "12", "50", "0"),
    "starion": ("Jul-2019", None, "06001", "12", "50", "0"),
    "atlantic": ("2019-07", "2018-01", "6001", "12", "50", "0"),
    "direct": ("2019-07", "January-18", "6001", "12", "50", "0"),
    "energyplus": ("2019-07", "2018-01", "06001  ", "12", "50", "0"),
    "spark": ("2019-07", "2018-01", "6001", "12", "50", "0"),
    "nap": ("2019-07", "January-18", "06001", "12", "NULL", "NULL"),
    "reliant": ("2019-07", "2018-01", "6001", "12", "50", "0"),
    "verde": ("2019-07", "2018-01", "6001", "12", "50", "0"),
    "clearview": ("July-2019", "January-2018", "6001", "12", "50", "0"),
}


def extract(spark, spec, *cells, **more):
    """Delivered rows under the supplier's own headings, plus a column of no use."""
    base = {"supplier": "Given Name", "rate": "0.123456789", "customers": "3", "kwh": "1000.04",
            "service_fee": "0", "edc": "UI "}
    keys = ("charge", "commencement", "zip", "term", "term_fee", "terminations")
    data = []
    for row in cells:
        values = {**base, **dict(zip(keys, row)), **more}
        data.append(["ignored", *[values.get(raw) for raw in spec.columns]])
    names = ["Comment", *spec.columns.values()]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame(data, schema)


def test_every_supplier_conforms(spark):
    assert set(DELIVERED) == set(SPEC) and len(SPEC) == 23
    out = load_bills({n: extract(spark, SPEC[n], row) for n, row in DELIVERED.items()})
    assert out.columns == [*schemas.BILLS.names, "load_errors"]
    got = out.collect()
    assert len(got) == 23 and all(r.load_errors is None for r in got)
    for r in got:
        assert (r.year_charge, r.month_charge, r.zipcode, r.edc) == ("2019", "07", "06001", "UI")
        assert (r.billed_rate, r.num_customers, r.totalkwh) == (D("0.12346"), 3, D("1000.0"))
        assert (r.servicechargesfees, r.num_terminations) == (0, 0)
    names = [r.supplier for r in got]
    assert names.count("Public Power") == names.count("Energy Rewards") == 1
    assert names.count("Given Name") == 21
    starts = [(r.year_commencement, r.month_commencement) for r in got]
    assert starts.count((None, None)) == 2 and starts.count(("2018", "01")) == 21
    assert sorted((r.contractterm, r.term_fee) for r in got) == [(1, 0), (12, 0)] + [(12, 50)] * 21


@pytest.mark.parametrize(
    "name,cells,want",
    [
        # blank marks in term and commencement
        ("nge", ("10/19", "12/18", "6001", "NA", "0", "0"), ("2019", "10", "2018", "12", 1)),
        ("nge", ("10/19", None, "6001", None, "0", "0"), ("2019", "10", None, None, None)),
        ("direct", ("2019-07", "NULL", "6001", "NULL", "0", "0"), ("2019", "07", "2019", "07", 1)),
        (
            "energyplus",
            ("2019-07", "Month-To-Month", "06001", "Month-To-Month", "0", "0"),
            ("2019", "07", "2019", "07", 1),
        ),
        ("nap", ("2019-07", "See Narrative", "06001", "NULL", "5", "1"), ("2019", "07", "2019", "07", 1)),
        ("nap", ("2019-07", "NULL", "06001", "6", "5", "1"), ("2019", "07", "2019", "07", 6)),
        ("nap", ("2019-07", None, "06001", "6", "5", "1"), ("2019", "07", None, None, 6)),
        (
            "reliant",
            ("2019-07", "Month-To-Month", "6001", "Month-To-Month", "0", "0"),
            ("2019", "07", None, None, 1),
        ),
        ("clearview", ("July-2019", "NULL", "6001", "NULL", "none", "0"), ("2019", "07", None, None, 1)),
        (
            "public",
            ("2019-07", "See Response to EOE-6", "6001", "Unknown", "0", "0"),
            ("2019", "07", None, None, None),
        ),
        ("townsquare", ("July-19", None, "06001", "6", "0", "0"), ("2019", "07", None, None, 6)),
        ("think", ("May-21", "NA", "6001", "1 Month", "0", "0"), ("2021", "05", None, None, 1)),
        ("xoom", ("May-21", "May-20", "6001", "n/a", "0", "0"), ("2021", "05", "2020", "05", None)),
        ("starion", ("Dec-2019", None, "06001", "any", "x", "0"), ("2019", "12", None, None, 1)),
    ],
)
def test_replacement_rules(spark, name, cells, want):
    r = load_bills({name: extract(spark, SPEC[name], cells)}).first()
    assert r.load_errors is None
    got = (r.year_charge, r.month_charge, r.year_commencement, r.month_commencement, r.contractterm)
    assert got == want


def test_lost_zip_becomes_removable_under_a_prefix_only(spark):
    with_prefix = load_bills({"cne": extract(spark, SPEC["cne"], ("2019-07", None, None, "1", "0", "0"))})
    bare = load_bills({"nap": extract(spark, SPEC["nap"], ("2019-07", None, None, "1", "0", "0"))})
    assert (with_prefix.first().zipcode, bare.first().zipcode) == ("0NA", None)


def test_bad_cells_reject_the_row_and_no_other(spark):
    spec = SPEC["mega"]
    good = extract(spark, spec, DELIVERED["mega"])
    cases = {
        "billed_rate": extract(spark, spec, DELIVERED["mega"], rate="12.5"),
        "num_customers": extract(spark, spec, DELIVERED["mega"], customers="2.5"),
        "totalkwh": extract(spark, spec, DELIVERED["mega"], kwh="many"),
        "contractterm": extract(spark, spec, ("2019-07", "2018-01", "6001", "a year", "0", "0")),
        "zipcode": extract(spark, spec, ("2019-07", "2018-01", "60011234", "1", "0", "0")),
    }
    raw = good
    for bad in cases.values():
        raw = raw.unionByName(bad)
    loaded = load_bills({"mega": raw})
    assert accepted(loaded).count() == 1
    assert sorted(r.load_errors for r in rejected(loaded).collect()) == sorted(cases)
    assert accepted(loaded).count() + rejected(loaded).count() == raw.count()


def test_land_ignores_heading_case_and_unknown_columns(spark):
    landed = land(spark.createDataFrame([("a", "1")], "`supplierNAME` string, `LDC` string"), SPEC["cne"].__class__("x", {"supplier": "SupplierName", "edc": "ldc"}))
    row = landed.first()
    assert (row.extract, row.supplier, row.edc, row.rate) == ("x", "a", "1", None)


AMENITY = {s.name: s for s in AMENITY_SPECS}


def perks(spark, name, *data):
    spec = AMENITY[name]
    columns = list(dict.fromkeys(spec.columns.values()))
    raws = [next(r for r, c in spec.columns.items() if c == col) for col in columns]
    return spark.createDataFrame(
        [[row.get(r) for r in raws] for row in data], ", ".join(f"`{c}` string" for c in columns)
    )


def perk(**kw):
    return {"supplier": "Name", "year": "2019", "amenity": "card", "value": "10.50", "redeemed": "4", **kw}


@pytest.mark.parametrize(
    "name,row,want",
    [
        ("ambit", perk(), ("Name", "2019", "card", D("10.50"), D(4), D(42))),
        ("ambit", perk(value="n/a"), ("Name", "2019", "card", None, D(4), None)),
        ("clearview", perk(amenity="Hulu subscription", value="?"), ("Clearview Energy", "2019", "Hulu subscription", D("5.99"), D(4), D("23.96"))),
        ("clearview", perk(amenity="5% of 12 month kwh expenditure", year="2020", value="5%"), ("Clearview Energy", "2020", "5% of 12 month kwh expenditure", D(54), D(270), D(14580))),
        ("clearview", perk(amenity="1USB Battery Bank", year="mixed"), ("Clearview Energy", "2018", "1USB Battery Bank", D("10.50"), D(4), D(42))),
        ("clearview", perk(year="2019 - part"), ("Clearview Energy", "2019", "card", D("10.50"), D(4), D(42))),
        ("direct", perk(amenity="x" * 50), ("Direct Energy Services, LLC", "2019", "x" * 40, D("10.50"), D(4), D(42))),
        ("energyplus", perk(cost=None), ("Name", "2019", "card", None, D(4), D(4))),
        ("energyplus", perk(cost="7.25"), ("Name", "2019", "card", None, D(4), D("7.25"))),
        ("reliant", perk(value="25.00 each"), ("Name", "2019", "card", D(25), D(4), D(4))),
        ("verde", perk(value="100 points", cost="12"), ("Name", "2019", "card", D(100), D(4), D(12))),
        ("townsquare_2018", perk(), ("Name", "2019", "card", D("10.50"), D(4), D(42))),
        ("townsquare_2020", perk(value=None, redeemed=None, cost=None), ("Name", "2019", "card", D(0), D(0), D(0))),
        ("xoom_donation", perk(), ("Name", "2019", "card", D("10.50"), D(4), D("10.50"))),
    ],
)
def test_amenity_rules(spark, name, row, want):
    out = load_amenities({name: perks(spark, name, row)}).first()
    assert out.load_errors is None and tuple(out)[:-1] == want


def test_amenity_rows_left_out_and_names(spark):
    out = union_amenities(
        {
            "ambit": perks(spark, "ambit", perk(supplier=None), perk(supplier="Supplier Name"), perk(supplier="A")),
            "direct": perks(spark, "direct", perk(redeemed="NULL"), perk(redeemed=None)),
            "nap": perks(spark, "nap", perk(amenity="Understandabill"), perk(supplier="N")),
            "constellation": perks(spark, "constellation", perk(supplier="Constellation"), perk(year="2022"), perk(supplier="C", year=None)),
            "xoom_miles": perks(spark, "xoom_miles", perk()),
            "xoom_extras": perks(spark, "xoom_extras", perk(supplier="XOOM Energy")),
        }
    )
    got = sorted(((r.supplier, r.year) for r in out.collect() if r.year), key=str) + [
        (r.supplier, r.year) for r in out.collect() if not r.year
    ]
    assert got == [
        ("A", "2019"),
        ("Constellation NewEnergy Inc", "2019"),
        ("N", "2019"),
        ("XOOM", "2019"),
        (None, "2019"),  # a row without a supplier is kept; only blank rows and headings go
        ("C", None),
    ]


def test_census_sheets(spark):
    income = acs_income(
        spark.createDataFrame(
            [
                ("Geographic Area Name", "Estimate!!Households!!Total", "Estimate"),
                ("ZCTA5 06001", "7000", "101000"),
                ("ZCTA5 06002", "12.0", "250,000+"),
                ("ZCTA5 06003", "9", "-"),
            ],
            "geographic_name string, count_households string, median_hh_income string",
        )
    )
    assert [tuple(r) for r in income.collect()] == [
        ("ZCTA5 06001", 7000, 101000, "06001"),
        ("ZCTA5 06002", 12, None, "06002"),
        ("ZCTA5 06003", 9, None, "06003"),
    ]
    names = "ZIP_CODE string, PO_NAME string, STATE string, ZIP_TYPE string, ZCTA string, zip_join_type string"
    areas = zip_crosswalk(
        spark.createDataFrame([("06001", "Avon", "CT", "t", "06001 ", "j"), ("10001", "NY", "NY", "t", "10001", "j")], names)
    )
    assert [tuple(r) for r in areas.collect()] == [("06001", "Avon", "CT", "t", "06001", "j")]
    shares = minority_share(
        spark.createDataFrame([("g", "ZCTA5 06001", "93.8", "0.0625"), ("g", "ZCTA5 06002", "x", None)], "a string, b string, c string, d string")
    )
    assert [(r.zcta, r.white_alone, r.pct_minority) for r in shares.collect()] == [
        ("06001", D("93.8"), D("0.062")),
        ("06002", None, None),
    ]
    english = low_english(spark.createDataFrame([("06001", "10", "1", "0.1")], "a string, b string, c string, d string"))
    assert tuple(english.first()) == ("06001", 10, 1, D("0.100"))
    people = population(spark.createDataFrame([("ZCTA5 06001", "18000")], "Area string, Total_population string"))
    assert tuple(people.first()) == ("06001", 18000)


def test_rates_green_and_participation(spark):
    sheet = rate_sheet(spark.createDataFrame([(2019, 7, "8.12345", "9")], "year int, month int, eversource_rate string, ui_rate string"))
    assert tuple(sheet.first()) == ("2019", "07", D("8.1235"), D("9.0000"), "201907")
    green = green_usage(
        spark.createDataFrame(
            [("a", "2019", 1, "x", "0.1", "-5"), ("b", "2019", 1, "x", "-0.1", None), ("c", "2019", 1, "x", None, "5"), ("d", "2019", 1, "x", "0.1", "5")],
            "supplier string, year_charge string, num_customers int, specific_commitment string, billed_rate string, totalkwh string",
        )
    )
    assert [r.supplier for r in green.collect()] == ["c", "d"]
    answer = spark.createDataFrame(
        [("06001", "2021", "5", None, "5")],
        "`Zip Code` string, `Year-end` string, `Supplier \r\nCustomer Count` string, `EDC \r\nCustomer Count` string, `Total \r\nCustomer Count` string",
    )
    assert tuple(participation_counts(answer, "UI").first()) == ("06001", "2021", 5, 0, 5, "UI")


def test_text_sheets_are_read_untyped(spark, tmp_path):
    (tmp_path / "a.csv").write_text('SupplierName,"Heading, x"\nA,01\n')
    sheet = read_extract(spark, str(tmp_path / "a.csv"))
    assert sheet.columns == ["SupplierName", "Heading, x"] and tuple(sheet.first()) == ("A", "01")
    (tmp_path / "b.csv").write_text("skip,me\nx,1\n")
    assert read_positional(spark, str(tmp_path / "b.csv"), ["p", "q"]).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "2019", 1), ("b", "2020", 2)], "k string, year_charge string, v int")
    write_by_year(df, str(tmp_path / "y"))
    assert sorted(p.name for p in (tmp_path / "y").glob("year*")) == ["year_charge=2019", "year_charge=2020"]
    write_report(df, str(tmp_path / "c"), sep=";")
    lines = [x for p in (tmp_path / "c").glob("part*") for x in p.read_text().splitlines()]
    assert "k;year_charge;v" in lines and "b;2020;2" in lines
    for _ in range(2):
        append_table(df, "appended")
        overwrite_table(df, "overwritten")
    assert spark.table("appended").count() == 4 and spark.table("overwritten").count() == 2
    for name in ("appended", "overwritten"):
        spark.sql(f"DROP TABLE {name}")


def test_one_write_keeps_accepted_and_rejected_apart(spark, tmp_path):
    loaded = load_bills(
        {"mega": extract(spark, SPEC["mega"], DELIVERED["mega"]).unionByName(extract(spark, SPEC["mega"], DELIVERED["mega"], kwh="?"))}
    )
    write_load(loaded, str(tmp_path / "l"))
    back = spark.read.parquet(str(tmp_path / "l"))
    assert {(r.load_status, r.load_errors) for r in back.collect()} == {("accepted", None), ("rejected", "totalkwh")}
    audit = bill_audit(accepted(loaded)).first()
    assert (audit.rec_count, audit.sum_num_customers, audit.sum_totalkwh) == (1, 3, D("1000.0"))
    assert audit.sum_billed_rate == D("0.12346") and audit.sum_contractterm == 12


def test_serial_dates_take_an_origin(spark):
    from voltledger.functions import excel_date

    assert spark.range(1).select(excel_date(F.lit("1"), "1900-01-01")).first()[0] == date(1900, 1, 2)
