"""Loads refuse what they can't read: marks per extract, months, counts, headings."""

from contextlib import contextmanager

import pytest

from voltledger.operators import accepted, rejected
from voltledger.operators.conform import AMENITY_RAW, BILL_RAW, conform_amenities, conform_bills
from voltledger.plans import PRODUCTS, ingest, product, publish, published, stored_inputs
from voltledger.sources import commit, committed
from voltledger.sources.amenities import AMENITY_SPECS
from voltledger.sources.bills import BILL_SPECS
from voltledger.sources.census import acs_income, low_english, minority_share, population
from voltledger.sources.readers import land_lines, read_positional, read_sheet, records
from voltledger.sources.usage import load_green, load_participation

SPECS = {s.name: s for s in BILL_SPECS}
SHEETS = {s.name: s for s in AMENITY_SPECS}


def bills(spark, name, **cells):
    row = {"supplier": "S", "charge": "2019-07", "rate": "0.1", "zip": "6001", "customers": "1", "kwh": "5", "edc": "UI"}
    row |= cells
    schema = ", ".join(f"{c} string" for c in ("extract", *BILL_RAW))
    landed = spark.createDataFrame([(name, *[row.get(c) for c in BILL_RAW])], schema)
    return conform_bills(landed, SPECS[name]).first()


@pytest.mark.parametrize(
    "name,mark,term",
    [
        ("nap", "NULL", 1),
        ("nap", "See Narrative", None),
        ("nap", " ", None),
        ("reliant", "Month-To-Month", 1),
        ("reliant", "NULL", None),
        ("direct", "NULL", 1),
        ("nge", "NA", 1),
    ],
)
def test_marks_are_those_of_the_extract(spark, name, mark, term):
    assert bills(spark, name, term=mark).contractterm == term


def test_an_empty_commencement_is_missing(spark):
    row = bills(spark, "direct", charge="7/19", commencement="  ")
    assert row.year_commencement is None and row.month_commencement is None


@pytest.mark.parametrize("charge", ["Total:", "2019-13", "19", "2019/0"])
def test_an_unreadable_charge_month_is_a_load_error(spark, charge):
    row = bills(spark, "cne", charge=charge)
    assert row.year_charge is None and row.month_charge is None and "year_charge" in row.load_errors


def test_ambit_loses_blank_and_heading_rows_only(spark):
    rows = [
        ("ambit", None, "2019", "Miles", "7", "3", None),
        ("ambit", None, None, " ", None, None, None),
        ("ambit", "Supplier Name", "Year", "Amenity Offered", "Value of Amenity", "Number of Amenities Redeemed by Customers", None),
    ]
    landed = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("extract", *AMENITY_RAW)))
    got = conform_amenities(landed, SHEETS["ambit"]).collect()
    assert [(r.supplier, r.amenity, r.load_errors) for r in got] == [(None, "Miles", None)]


def test_counts_with_a_thousands_comma_are_load_errors(spark):
    heads = ["Zip Code", "Year End", "Supplier Customer Count", "EDC Customer Count", "Total Customer Count"]
    raw = spark.createDataFrame([("06001", "2019", "1,234", None, "7"), ("06002", "2019", "5", " ", "7")], heads)
    loaded = load_participation(raw, "Eversource")
    bad = rejected(loaded).collect()
    assert [(r.zip, r.load_errors) for r in bad] == [("06001", "num_custs_supplier")]
    good = accepted(loaded).first()
    assert (good.num_custs_supplier, good.num_custs_edc, good.tot_custs) == (5, 0, 7)


def test_green_cells_that_do_not_fit_are_load_errors(spark):
    schema = "supplier string, year_charge string, num_customers string, specific_commitment string, billed_rate string, totalkwh string"
    raw = spark.createDataFrame([("S", "2019", "3", "x", "n/a", "5"), ("S", "2019", "3", "x", None, "5")], schema)
    rows = load_green(raw).orderBy("load_errors").collect()
    assert [r.load_errors for r in rows] == [None, "billed_rate"]


def test_heading_lines_are_not_areas(spark, tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text("Geography,Geographic Area Name,White alone,Minority\nid,Geographic,x,y\n8600000US06001,ZCTA5 06001,60.5,0.395\n,,,\n")
    raw = read_positional(spark, str(sheet), ["a", "b", "c", "d"])
    assert [r.zcta for r in minority_share(raw).collect()] == ["06001"]
    english = spark.createDataFrame([("ZCTA", "h", "l", "p"), ("06001", "10", "1", "0.1")], ["a", "b", "c", "d"])
    assert [r.zcta for r in low_english(english).collect()] == ["06001"]
    income = [("Geographic Area Name", "Households", "Median"), ("name", "x", "y"), ("ZCTA5 06001", "10", "250,000+")]
    raw = spark.createDataFrame(income, ["geographic_name", "count_households", "median_hh_income"])
    assert [(r.zcta, r.median_hh_income) for r in acs_income(raw).collect()] == [("06001", None)]
    people = spark.createDataFrame([("Area", "Total"), ("ZCTA5 06001", "12")], ["Area", "Total_population"])
    assert [(r.zcta, r.total_population) for r in population(people).collect()] == [("06001", 12)]



@pytest.mark.parametrize("above", [0, 1, 2, 4])
def test_a_sheet_is_read_from_its_heading_on(spark, tmp_path, above):
    lines = ["Responses,,", "Attachment 6,,", ",,", "note,of,things"][:above]
    for part in ("a.csv", "b.csv"):  # files of one path repeat their headings
        text = [*lines, '"Supplier  Name",skip,Total KWh', f'{part},"1,5",7', ",,", f'"say ""x""",,']
        (tmp_path / part).write_text("\n".join(text) + "\n")
    sheet = read_sheet(spark, str(tmp_path), ["Total kWh", "Supplier Name"])
    assert sheet.columns == ["Total kWh", "Supplier Name"]
    got = sorted(tuple(r) for r in sheet.fillna("-").collect())
    assert got == [("-", 'say "x"')] * 2 + [("7", "a.csv"), ("7", "b.csv")]


def test_headings_with_line_breaks_need_no_single_task(spark, tmp_path):
    body = "".join(f"06{i:03d},2021,{i},2\r\n" for i in range(500))
    (tmp_path / "s.csv").write_text('Answer,,,\r\nZip Code,Year-end,"Supplier \r\nCustomer Count","EDC \r\nCustomer Count"\r\n' + body, newline="")
    heads = ["Zip Code", "Supplier \r\nCustomer Count"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        sheet = read_sheet(spark, str(tmp_path), heads)
        assert sheet.rdd.getNumPartitions() > 1
        rows = sorted(tuple(r) for r in sheet.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == [(f"06{i:03d}", str(i)) for i in range(500)]


def split_small(spark, size):
    """Let splits have ``size`` bytes for a while."""

    @contextmanager
    def of():
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            yield
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    return of()


HEADING = ["Supplier\n\nName", 'Note "free\r\ntext"', "kWh"]


def broken_sheet(n, end):
    """Rows with line breaks, empty lines and quotes in cells, rows like those above the heading and like the heading."""
    above = [["Answer", "", ""], ["Acme", "x", "1"], ["", "of\n\n\nyear", ""]]
    rows = [["Acme", "x", "1"], ["Beta", 'a "b", c', "2"], ["Acme", "x", "1"], HEADING, ["", "of\n\n\nyear", ""]]
    rows += [[f"S{i}", ("line, \n" * (i % 5)) + '"' * (i % 3) + ("\n" if i % 7 == 0 else ""), str(i)] for i in range(n)]
    rows += [["long", "word\n" * 400, "9"], ["end", "\n", "10"]]
    text = "".join(",".join('"' + c.replace('"', '""') + '"' if set(c) & set('\n",') else c for c in r) + end for r in [*above, HEADING, *rows])
    return text, rows


@pytest.mark.parametrize("size", ["700", "128m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_breaks_in_cells_are_read_in_splits(spark, tmp_path, size, end):
    text, rows = broken_sheet(60, end)
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(text, newline="")
    with split_small(spark, size):
        sheet = read_sheet(spark, str(tmp_path), HEADING)
        lines = text.count("\n") * 2
        got = [tuple(r) for r in sheet.collect()]
    want = [tuple(c or None for c in r) for r in rows if any(r)] * 2
    assert len(got) == len(want) < lines
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_splits_of_the_text_are_many(spark, tmp_path):
    (tmp_path / "s.csv").write_text(broken_sheet(100, "\n")[0], newline="")
    with split_small(spark, "500"):
        lines, blocks = land_lines(spark, str(tmp_path / "s.csv"), str(tmp_path / "landed"))
        assert blocks.count() > 10 and blocks.where("inside").count() > 3
        # Later sessions may split otherwise; what is stored stays as it is.
    whole = records(lines, blocks)
    assert whole.count() == 100 + 11
    assert whole.orderBy("block", "at").first().value == "Answer,,"


def test_a_cell_that_is_never_closed_is_an_error(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a,b\n1,"2\n3,4\n')
    with pytest.raises(ValueError, match="never closed"):
        read_sheet(spark, str(tmp_path / "s.csv"), ["a", "b"])


def test_files_of_different_layout_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError, match="different places"):
        read_sheet(spark, str(tmp_path), ["a", "b"])


def test_a_sheet_without_its_heading_is_an_error(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no heading"):
        read_sheet(spark, str(tmp_path), ["a", "c"])


BILL = {"supplier": "S", "charge": "2021-07", "rate": "0.2", "zip": "6001", "customers": "3", "kwh": "10", "edc": "UI"}
PERK = {"supplier": "S", "year": "2021", "amenity": "Mug", "value": "5", "redeemed": "2"}


def headed(columns, *rows):
    """A heading and rows of cells by raw name."""
    quoted = ",".join(f'"{c}"' for c in columns.values())
    return [quoted, *[",".join(r.get(k, "") for k in columns) for r in rows]]


@pytest.fixture
def delivered(tmp_path):
    """Arguments of a first load."""

    def sheet(name, *lines):
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
        return str(tmp_path / f"{name}.csv")

    bad = [BILL | {"charge": "Total:"}, BILL | {"commencement": "Total: x"}]
    return {
        "bills": {"cne": sheet("cne", "Attachment", *headed(SPECS["cne"].columns, BILL, *bad, BILL | {"rate": "0.05"}))},
        "amenities": {"atlantic": sheet("atlantic", "Attachment", "x,y", *headed(SHEETS["atlantic"].columns, PERK, PERK | {"amenity": '"Mug,\n\nlarge"'}))},
        "participation": {"UI": sheet("ui", 'Zip Code,Year-end,"Supplier \nCustomer Count","EDC \nCustomer Count","Total \nCustomer Count"', "06001,2021,4,6,10", '06002,2021,"1,234",6,10', "06003,2021,12.7,6,10")},
        "sheets": {
            "green": sheet("green", "supplier,year_charge,num_customers,specific_commitment,billed_rate,totalkwh", "S,2021,1,x,0.2,5"),
            "rate_sheet": sheet("rates", "Year,Month,Eversource_rate,UI_rate", "2021,7,9,10", "2021,8,n/a,10", "2021,13,9,10", "Source: utilities,,,"),
            "crosswalk": sheet("xwalk", "ZIP_CODE,PO_NAME,STATE,ZIP_TYPE,ZCTA,zip_join_type", "06001,Avon,CT,a,06001,b", "6002,Else,CT,a,06002,b", "99999,Else,AK,a,99999,b"),
            "income": sheet("income", "Name,Households,Median", "ZCTA5 06001,10,90000", "ZCTA5 06002,ten,-"),
            "minority": sheet("minority", "id,name,white,share", "8600000US06001,ZCTA5 06001,60.5,0.395"),
            "english": sheet("english", "ZCTA,h,l,p", "06001,10,1,0.1"),
            "population": sheet("people", "Area,Total", "ZCTA5 06001,12"),
        },
    }


def totals(spark, folder):
    t = stored_inputs(spark, folder)
    return sorted(map(str, PRODUCTS["load_control_totals"](t).collect())), t.participation.count(), t.amenities.count(), t.green.count()


def test_from_sheets_to_a_report(spark, tmp_path, delivered):
    out = str(tmp_path / "out")
    tables = ingest(spark, out, **delivered)
    assert tables.bills.count() == 2 and tables.amenities.count() == 2
    rejects = {(r.load, r.load_errors, r["count"]) for r in spark.read.parquet(f"{out}/rejects").collect()}
    assert rejects == {
        ("bills", "year_charge", 1), ("bills", "year_commencement", 1), ("participation", "num_custs_supplier", 2),
        ("rate_sheet", "eversource_rate", 1), ("rate_sheet", "month", 1), ("rate_sheet", "year,month", 1), ("crosswalk", "zipcode", 1),
    }
    # What the commit says was observed while the rows were written.
    said = committed(spark, f"{out}/batches")["initial"]["tables"]
    assert (said["bills"]["accepted"], said["bills"]["rejected"], said["bills"]["sum_num_customers"]) == (2, 2, 6)
    assert float(said["bills"]["sum_billed_rate"]) == 0.25
    assert said["income"]["unread"] == {"count_households": 1} and said["population"]["unread"] == {}
    assert spark.read.parquet(f"{out}/control_totals").first().supplier == "S"
    names = ["overpayment_by_zcta_year", "amenity_report_by_year", "rate_comparison", "overpayment_by_zip_year"]
    publish(spark, tables, out, names)
    reports = published(spark, out)["reports"]
    report = spark.read.option("header", True).csv(reports["overpayment_by_zcta_year"]).first()
    # 10 kWh at ten and at minus five cents over the standard rate: 1 and -0.5, rounded half to even.
    assert (report.zcta, report.gross_overpayment, report.customers_affected) == ("06001", "1", "6")
    assert spark.read.option("header", True).option("sep", ";").csv(reports["rate_comparison"]).count() == 2
    assert [r.year_charge for r in product(spark, out, "overpayment_by_zip_year").collect()] == ["2021"]


def test_a_batch_loaded_again_adds_nothing(spark, tmp_path, delivered):
    out = str(tmp_path / "out")
    ingest(spark, out, **delivered)
    once = totals(spark, out)
    files = sorted(map(str, (tmp_path / "out" / "loads").iterdir()))
    ingest(spark, out, **delivered)
    assert totals(spark, out) == once and sorted(map(str, (tmp_path / "out" / "loads").iterdir())) == files
    # Another batch adds its rows; sheets it doesn't have stay as they are.
    tables = ingest(spark, out, bills=delivered["bills"], batch="2022.1")
    assert tables.bills.count() == 4 and tables.green.count() == 1 and tables.rate_sheet.count() == 1
    rates = tmp_path / "newer.csv"
    rates.write_text("Year,Month,Eversource_rate,UI_rate\n2021,7,9,10\n2021,9,9,11\n")
    assert ingest(spark, out, sheets={"rate_sheet": str(rates)}, batch="2022.2").rate_sheet.count() == 2


def test_a_load_that_fails_half_way_leaves_nothing(spark, tmp_path, delivered, monkeypatch):
    out = str(tmp_path / "out")
    ingest(spark, out, **delivered)
    once = totals(spark, out)
    broken = delivered | {"sheets": delivered["sheets"] | {"crosswalk": str(tmp_path / "cne.csv")}}
    with pytest.raises(ValueError, match="no heading"):
        ingest(spark, out, **broken, batch="second")  # bills and amenities are written by then
    assert totals(spark, out) == once
    ingest(spark, out, **delivered, batch="second")
    rows, *counts = totals(spark, out)
    assert counts == [2 * n for n in once[1:]] and len(rows) == len(once[0])
    with pytest.raises(ValueError, match="letters"):
        ingest(spark, out, batch="../x")


def test_a_name_is_committed_once(spark, tmp_path):
    folder = str(tmp_path / "c")
    assert committed(spark, folder) == {}
    assert commit(spark, folder, "a", {"n": 1}) and not commit(spark, folder, "a", {"n": 2})
    assert commit(spark, folder, "b", {"n": 3}) and committed(spark, folder) == {"a": {"n": 1}, "b": {"n": 3}}
