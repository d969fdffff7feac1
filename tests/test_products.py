"""Every registered query against its SQL, and the shape of the plans."""

import math
import random
import re
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracles
import standins
from voltledger import schemas
from voltledger.operators import additive, merged, per_unit_split, premium, split
from voltledger.plans import PRODUCTS, ordered, product, publish, publish_changes, published, reads, store_layers
from voltledger.sources import read_entry, write_report


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.12g}")
        return v

    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


# The corpus queries, where they are there, have tests of their own.
OWN = sorted(n for n in entry.queries() if n not in {*entry.CORPUS, "pipeline"})


def test_every_query_has_its_sql():
    assert set(OWN) == set(oracles.QUERIES) == {n for n in entry.oracle_sql() if not re.match(r"op\d", n)}


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, db, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(columns, cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def files(df):
    """Files that a query may read."""
    return "\n".join(df.inputFiles())


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def bill_scans(text):
    return len(re.findall(r"FileScan parquet \[[^\]]*billed_rate", text))


def ancestors(text, wanted):
    """Operators above the first matching line, nearest first."""
    lines = text.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    at = next(i for i, x in enumerate(lines) if wanted(x))
    out, level = [], depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < level:
            out.append(lines[i])
            level = depth[i]
    return out


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return standins.inputs(spark, sf_dir)


SINGLE_SCAN = [
    "overpayment_by_year",
    "overpayment_by_supplier_year",
    "overpayment_by_zcta_year",
    "premium_distribution",
    "savings_overpayment_by_year",
    "save_overpay_by_zcta",
    "overpayment_by_demographics",
    "topbottom_income",
    "save_topbottom_english",
    "contract_term_bands",
    "contract_term_pivot",
    "amenity_summary_by_year",
    "amenity_summary_by_supplier",
    "public_extract",
]


@pytest.mark.parametrize("name", SINGLE_SCAN)
def test_bills_are_scanned_once_and_never_shuffled_by_row(spark, tables, name):
    text = plan(PRODUCTS[name](tables))
    assert bill_scans(text) == 1
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # the stored rate sheet is below the broadcast threshold
    assert re.search(r"BroadcastHashJoin \[year_month#\d+, edc#\d+\]", text)
    # the bills meet their first exchange as partial sums
    above = ancestors(text, lambda x: "FileScan parquet" in x and "billed_rate" in x)
    first = next(i for i, x in enumerate(above) if "Exchange" in x)
    assert any("HashAggregate" in x and "partial_" in x for x in above[:first])


def test_filters_and_columns_reach_the_bill_files(spark, tables):
    df = PRODUCTS["premium_distribution"](tables)
    df.collect()
    text = df._jdf.queryExecution().toString()
    scan = next(x for x in text.splitlines()[::-1] if "FileScan parquet" in x and "billed_rate" in x)
    assert re.search(r"PartitionFilters: \[[^\]]*year_charge#\d+ = 2021", scan)
    assert "IsNotNull(billed_rate)" in scan and "IsNotNull(totalkwh)" in scan
    read = re.search(r"ReadSchema: struct<([^>]*)", scan).group(1)
    assert "servicechargesfees" not in read and "contractterm" not in read


def test_extract_branches_read_only_their_partition(spark, sf_dir):
    text = plan(standins.conformed_bills(spark, sf_dir))
    scans = [x for x in text.splitlines() if "FileScan parquet" in x]
    assert len(scans) == 23
    assert all(re.search(r"PartitionFilters: \[isnotnull\(extract#\d+\), \(extract#\d+ = ", x) for x in scans)
    assert "Exchange" not in text


def test_aggregate_code_is_small_enough_to_be_compiled(spark, tables):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("overpayment_by_year", "overpayment_by_zip_year", "save_overpay_by_zcta"):
            text = PRODUCTS[name](tables)._jdf.queryExecution().explainString(mode)
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_products_from_stored_layers_are_the_same(spark, tables, tmp_path):
    names = ["overpayment_by_year", "save_overpay_by_zcta", "topbottom_english", "revenue_origin_by_income"]
    layered = publish(spark, tables, str(tmp_path), names)
    for name in names:
        want = PRODUCTS[name](tables)
        stored = product(spark, str(tmp_path), name)
        assert table(want.columns, want.collect()) == table(stored.columns, stored.collect())
    text = plan(PRODUCTS["save_overpay_by_zcta"](layered))
    assert "rate_sheet" not in text and text.count("FileScan parquet") == 2
    reports = published(spark, str(tmp_path))["reports"]
    report = spark.read.option("header", True).csv(reports["revenue_origin_by_income"])
    assert report.columns[0] == "zcta" and report.count() == PRODUCTS[names[3]](tables).count()


def test_cells_give_the_same_products_and_are_what_publish_reads(spark, tables, tmp_path):
    layered, _ = store_layers(spark, tables, str(tmp_path))
    read = {n for n in PRODUCTS if str(tmp_path / "rate_comparison") in files(PRODUCTS[n](layered))}
    assert read == {"rate_comparison"}
    from_cells = [n for n in PRODUCTS if re.search(r"/(cells|terms|premiums)/", files(PRODUCTS[n](layered)))]
    assert "premium_distribution" in from_cells
    assert len(from_cells) >= 24
    for name in from_cells:
        want, got = PRODUCTS[name](tables), PRODUCTS[name](layered)
        assert want.schema.simpleString() == got.schema.simpleString()
        assert table(want.columns, want.collect()) == table(got.columns, got.collect()), name


def test_cells_keep_signs_and_missing_values(spark):
    schema = "k string, overpayment_e7 bigint, num_customers int, totalkwh decimal(18,1)"
    rows = [
        ("a", 5, 1, Decimal("2.0")), ("a", 7, 2, Decimal("1.0")), ("a", -3, 1, Decimal("1.0")), ("a", 0, 0, Decimal("0.0")),
        ("b", 4, None, Decimal("1.0")), ("b", 6, 3, Decimal("1.0")), ("c", None, 2, Decimal("1.0")), ("c", 9, 1, None),
        (None, -1, 1, Decimal("1.0")), (None, 8, 1, Decimal("1.0")),
    ]
    df = spark.createDataFrame(rows, schema)
    cells = additive(df, ["k"])
    assert cells.count() == 9  # only a's two overpaying rows share one
    for product in (split, premium, per_unit_split):
        key = lambda r: str(r[0])
        assert sorted(product(df, ["k"]).collect(), key=key) == sorted(product(cells, ["k"]).collect(), key=key)


def test_report_cells_without_an_amenity_are_a_bare_zero(tables):
    one = tables.amenities.limit(1)
    giver = one.first().supplier
    t = tables.replaced(amenities=tables.amenities.filter(tables.amenities.supplier == giver))
    rows = {r.supplier: r for r in PRODUCTS["amenity_report_by_supplier"](t).collect()}
    none = [r for s, r in rows.items() if s not in (giver, "All")]
    assert none and {(r.value_redeemed, r.value_redeemed_per_bill, r.value_pct_of_overpayment) for r in none} == {("0", "0", "0")}
    years = {r.year: r for r in PRODUCTS["amenity_report_by_year"](tables).collect()}
    assert all(len(r.value_pct_of_overpayment.split(".")[1]) == (3 if y == "Total" else 2) for y, r in years.items())


def test_invariants(spark, tables):
    rows = PRODUCTS["overpayment_by_supplier_year"](tables).collect()
    for r in rows:
        if r.net_overpayment is not None and r.gross_underpayment is not None:
            assert abs(r.gross_overpayment + r.gross_underpayment - r.net_overpayment) <= 1
    bands = PRODUCTS["contract_term_bands"](tables).collect()
    total = PRODUCTS["rate_comparison"](tables).selectExpr("sum(overpayment) o", "sum(num_customers) n").first()
    assert sum(b.net_overpayment for b in bands) == total.o
    assert sum(b.customers for b in bands) == total.n


def test_a_third_of_all_bills_under_one_key(spark, tables):
    """Hot postal code, supplier and month against brute force."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        hot = i % 3 == 0
        rows.append(
            (
                "Hot" if hot else f"S{rng.randint(0, 20)}",
                "2021",
                "05" if hot else f"{rng.randint(1, 10):02d}",
                Decimal(rng.randint(0, 30000)).scaleb(-5),
                "06001" if hot else f"06{rng.randint(0, 999):03d}",
                rng.randint(1, 5),
                Decimal(rng.randint(0, 90000)).scaleb(-1),
                None, None, None, 0, 0, 0,
                rng.choice(["EV", "UI"]),
            )
        )
    t = tables.replaced(bills=spark.createDataFrame(rows, schemas.BILLS))
    rates = {
        r.date_concat: {"EV": r.eversource_rate / 100, "UI": r.ui_rate / 100}
        for r in t.rate_sheet.collect()
    }
    want = {}
    for r in rows:
        amount = (r[3] - rates[r[1] + r[2]][r[13]]) * r[6]
        cell = want.setdefault((r[0], r[4]), [Decimal(0), 0])
        cell[0] += amount
        cell[1] += r[5]
    got = {}
    for r in PRODUCTS["public_extract"](t).collect():
        cell = got.setdefault((r.supplier, r.zipcode), [Decimal(0), 0])
        cell[0] += r.net_overpayment
        cell[1] += r.total_customers
    assert got == want


def test_standins_refuse_a_session_without_a_shared_folder(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(standins, "shared_folder", lambda s: None)
    monkeypatch.setattr(standins, "_stored", {})
    with pytest.raises(ValueError, match="checkpoint.dir"):
        standins.inputs(spark, sf_dir).bills


def snapshot(spark, folder, names):
    return {n: table((df := product(spark, folder, n)).columns, df.collect()) for n in names}


def parquet_files(folder):
    return {str(p) for p in folder.rglob("*.parquet")}


def test_a_failing_publish_shows_the_version_before(spark, tables, tmp_path, monkeypatch):
    folder, names = str(tmp_path), ["overpayment_by_year", "premium_distribution", "overpayment_by_zip_year"]
    publish(spark, tables, folder, names)
    before, version = snapshot(spark, folder, names), published(spark, folder)

    def fails(t):
        raise RuntimeError("no space left")

    monkeypatch.setitem(PRODUCTS, "overpayment_by_zip_year", fails)
    fewer = tables.replaced(bills=tables.bills.where("year_charge < '2020'"))
    with pytest.raises(RuntimeError, match="no space"):
        publish(spark, fewer, folder, names)
    assert published(spark, folder) == version and snapshot(spark, folder, names) == before
    monkeypatch.undo()
    publish(spark, fewer, folder, names)
    assert published(spark, folder)["number"] == version["number"] + 1
    assert snapshot(spark, folder, names) != before


def test_of_two_that_publish_at_once_one_fails(spark, tables, tmp_path, monkeypatch):
    names = ["overpayment_by_year"]
    real = PRODUCTS["overpayment_by_year"]

    def overtaken(t):
        monkeypatch.setitem(PRODUCTS, "overpayment_by_year", real)
        publish(spark, tables, str(tmp_path), names)
        return real(t)

    monkeypatch.setitem(PRODUCTS, "overpayment_by_year", overtaken)
    with pytest.raises(RuntimeError, match="another run"):
        publish(spark, tables, str(tmp_path), names)
    assert published(spark, str(tmp_path))["number"] == 1


def test_one_year_anew_writes_no_file_of_the_others(spark, tables, tmp_path):
    folder = str(tmp_path)
    names = ["overpayment_by_year", "overpayment_by_zip_year", "rate_comparison", "acs_income", "contract_term_bands", "premium_distribution"]
    publish(spark, tables, folder, names)
    old = parquet_files(tmp_path)
    # The rates of 2020 were corrected.
    rate = F.when(F.col("year_charge") == "2020", F.col("billed_rate") + 1).otherwise(F.col("billed_rate"))
    changed = tables.replaced(bills=tables.bills.withColumn("billed_rate", rate.cast("decimal(6,5)")))
    publish(spark, changed, folder, names, years=["2020"])
    new = parquet_files(tmp_path) - old
    assert old <= parquet_files(tmp_path)
    assert any("year_charge=2020" in f for f in new)
    assert not [f for f in new if "year_charge=" in f and "year_charge=2020" not in f]
    assert not [f for f in new if "acs_income" in f]  # reads no bills
    whole = tmp_path / "whole"
    publish(spark, changed, str(whole), names)
    assert snapshot(spark, folder, names) == snapshot(spark, str(whole), names)


def test_changes_give_what_all_bills_give(spark, sf_dir, tables, tmp_path):
    folder = str(tmp_path / "changed")
    whole, entries = store_layers(spark, tables, str(tmp_path / "whole"))
    asked = {n: reads(PRODUCTS[n], whole) for n in PRODUCTS}
    from_cells = [n for n in PRODUCTS if asked[n] & {"cells", "terms", "premiums"} and not asked[n] & {"bills", "cleaned", "comparison"}]
    assert len(from_cells) >= 20
    names = [*from_cells, "wtd_avg_rates", "acs_income"]
    first, added, removed = standins.changed_bills(spark, sf_dir)
    publish(spark, tables.replaced(bills=first), folder, names)
    before = published(spark, folder)
    t = tables.replaced(bills=first.where("false"))  # no bill but the changed ones can be read
    assert publish_changes(spark, t, folder, "march", added, removed)
    after = published(spark, folder)
    for layer in ("cells", "terms", "premiums"):
        got, want = product(spark, folder, layer), read_entry(spark, entries[layer])
        assert table(got.columns, got.collect()) == table(want.columns, want.collect())
    for name, got in snapshot(spark, folder, from_cells).items():
        want = PRODUCTS[name](whole)
        assert got == table(want.columns, want.collect()), name
    assert after["layers"]["cleaned_bills"] == before["layers"]["cleaned_bills"]
    assert after["products"]["acs_income"] == before["products"]["acs_income"]
    assert after["behind"]["tables"] == ["cleaned_bills", "rate_comparison", "wtd_avg_rates"] and len(after["behind"]["years"]) > 2
    # Once more adds nothing; bills that were never there can't be taken away; both leave the version.
    assert not publish_changes(spark, t, folder, "march", added, removed)
    with pytest.raises(Exception, match="cells do not have"):
        publish_changes(spark, t, folder, "april", removed=removed)
    assert published(spark, folder) == after
    with pytest.raises(ValueError, match="publish those years too"):
        publish(spark, tables, folder, names, years=["2019"])
    publish(spark, tables, folder, ["wtd_avg_rates"])
    assert published(spark, folder)["behind"] == {"years": [], "tables": []}
    assert not publish_changes(spark, t, folder, "march", added, removed)


def test_changes_of_one_year_write_no_file_of_the_others(spark, tables, tmp_path):
    folder, names = str(tmp_path), ["overpayment_by_zip_year", "overpayment_by_year"]
    publish(spark, tables, folder, names)
    old = parquet_files(tmp_path)
    late = tables.bills.where("year_charge = '2020'").limit(50)
    publish_changes(spark, tables, folder, "late", added=late)
    new = parquet_files(tmp_path) - old
    assert old <= parquet_files(tmp_path)
    assert any("year_charge=2020" in f for f in new)
    assert not [f for f in new if "year_charge=" in f and "year_charge=2020" not in f]
    publish(spark, tables.replaced(bills=tables.bills.unionAll(late)), str(tmp_path / "whole"), names)
    assert snapshot(spark, folder, names) == snapshot(spark, str(tmp_path / "whole"), names)


def test_merged_cells_are_those_of_the_bills_that_stay(spark):
    """Any bills, any of them taken away: missing values, zeros, repeated rows and emptied cells included."""
    draw = random.Random(11)
    schema = "k string, overpayment_e7 bigint, num_customers int, totalkwh decimal(18,1)"
    rows = [
        (draw.choice("ab") if draw.random() > 0.1 else None, draw.choice([None, -4, -1, 0, 3, 9]), draw.choice([None, 0, 1, 2]), draw.choice([None, Decimal("0.0"), Decimal("2.5")]))
        for _ in range(400)
    ]
    base, late = rows[:300], rows[300:]
    for gone in (draw.sample(base, 120), base, []):
        stay = list(base)
        for r in gone:
            stay.remove(r)
        df = lambda r: spark.createDataFrame(r, schema)
        sides = df(late).withColumn("side", F.lit(1)).unionAll(df(gone).withColumn("side", F.lit(-1)))
        got = merged(additive(df(base), ["k"]), additive(sides, ["k", "side"]), ["k"])
        want = additive(df(stay + late), ["k"])
        assert got.dtypes == want.dtypes and table(got.columns, got.collect()) == table(want.columns, want.collect())
    never = df([("z", 1, 1, Decimal("1.0"))]).withColumn("side", F.lit(-1))
    with pytest.raises(Exception, match="cells do not have"):
        merged(additive(df(base), ["k"]), additive(never, ["k", "side"]), ["k"]).collect()


def test_products_say_what_they_read(tables):
    assert reads(PRODUCTS["acs_income"], tables) == {"income"}
    assert reads(PRODUCTS["overpayment_by_year"], tables) == {"bills", "rate_sheet"}


def test_reports_are_in_order_over_many_files(spark, tables, tmp_path):
    """Files by name, lines as they stand; ties and missing values included."""
    draw = random.Random(3)
    rows = [(draw.choice([None, 1, 2, 5]), draw.choice([None, "06001", "06002"]), draw.choice([None, "x", "y"])) for _ in range(3000)]
    name = "high_participation_75"
    df = spark.createDataFrame(rows, "participation_rate int, zcta string, po_name string").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_report(ordered(name, df), str(tmp_path / "r"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    parts = sorted((tmp_path / "r").glob("part-*.csv"))
    lines = [tuple(line.split(",")) for p in parts for line in p.read_text().splitlines()[1:]]
    assert len(parts) > 1 and len(lines) == 3000
    # Descending with missing first, then ascending with missing last.
    key = lambda r: (r[0] is not None, -(r[0] or 0), r[1] is None, r[1] or "", r[2] is None, r[2] or "")
    assert lines == [tuple("" if c is None else str(c) for c in r) for r in sorted(rows, key=key)]
