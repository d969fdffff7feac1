"""Store the layers once and write every product from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltledger.operators import MEASURES, additive, clean_bills, compare_rates, merged, threshold_cells
from voltledger.plans.inputs import CELL_KEYS, DERIVED, PREMIUM_KEYS, PREMIUM_STEPS, TERM_KEYS, Inputs, premium_cells
from voltledger.plans.products import PRODUCTS
from voltledger.sources import commit, committed, entry, read_entry, write_by_year, write_report

# Row order of the reports that have one; a minus sign is descending.
REPORT_ORDER = {
    "load_control_totals": ("supplier",),
    "union_control_totals": ("supplier",),
    "q9_control_totals": ("year_charge",),
    "wtd_avg_rates": ("year",),
    "usage_green_nongreen": ("year",),
    "premium_distribution": ("premium",),
    "participation_by_income_band": ("year", "income_group"),
    "high_participation_75": ("-participation_rate", "zcta", "po_name"),
    "high_participation_20": ("-participation_rate", "zcta", "po_name"),
    "amenity_summary_by_year": ("year",),
    "amenity_report_by_year": ("year",),
    "overpayment_by_demographics": ("section", "year"),
    "topbottom_minority": ("-pct_minority", "zcta"),
    "topbottom_income": ("-median_hh_income", "zcta"),
    "topbottom_english": ("pct_low_english", "zcta"),
    "save_topbottom_minority": ("-pct_minority", "zcta"),
    "save_topbottom_income": ("-median_hh_income", "zcta"),
    "save_topbottom_english": ("pct_low_english", "zcta"),
    "contract_term_pivot": ("edc", "month_commencement"),
    "supplier_customers_by_year": ("measure", "year"),
    "public_extract": ("year", "zipcode", "supplier"),
    "revenue_origin_by_income": ("median_hh_income", "zcta"),
}

# Row-level layers: stored as tables, too large for a report.
LAYERS = ("q6_all", "q9_all", "rate_comparison", "amenities_all", "participation_data")


# Of those, the ones whose layer is the product.
STORED_LAYERS = {"q6_all": "cleaned_bills", "rate_comparison": "rate_comparison"}
# Products delivered apart by year, and the column that has it.
BY_YEAR = {"overpayment_by_zip_year": "year_charge"}


def _order(key: str) -> Column:
    # Missing values last upwards and first downwards, as in SQL databases.
    if key.startswith("-"):
        return F.col(key[1:]).desc_nulls_first()
    return F.col(key).asc_nulls_last()


def ordered(name: str, df: DataFrame) -> DataFrame:
    """A product in its report order; only aggregated results are sorted.

    Rows that are equal in the report's keys come in the order of their other columns, so that the order
    is one whatever the partitions. A range-partitioned sort: files in the order of their names, and
    lines in them, have the report's order.
    """
    keys = REPORT_ORDER.get(name)
    if not keys:
        return df
    named = {k.lstrip("-") for k in keys}
    return df.orderBy(*[_order(k) for k in keys], *[_order(c) for c in df.columns if c not in named])


class _Watched(Inputs):
    """Inputs that note which of them are asked for."""

    def __init__(self, tables: Inputs) -> None:
        super().__init__(**tables.__dict__["_tables"])
        self.asked: set[str] = set()

    def _table(self, name: str) -> DataFrame:
        self.asked.add(name)
        return super()._table(name)


def reads(product: Callable[[Inputs], DataFrame], t: Inputs) -> set[str]:
    """The inputs and layers that a product reads; nothing is run."""
    watched = _Watched(t)
    product(watched)
    return watched.asked


# What changes with the bills of a year.
OF_BILLS = frozenset({"bills", *DERIVED})


def _written(
    spark: SparkSession, df: DataFrame, path: str, by: str | None = None, years: Sequence[str] | None = None, older: dict | None = None
) -> dict:
    """Write a table, or of one kept by year the given years, and return its entry for the commit."""
    if by is None:
        df.write.mode("overwrite").parquet(path)
        return entry(df, path)
    write_by_year(df.where(F.col(by).isin(list(years))) if years else df, path, by)
    return entry(df, path, by, years, older)


def store_layers(
    spark: SparkSession, t: Inputs, folder: str, years: Sequence[str] | None = None, older: dict | None = None
) -> tuple[Inputs, dict]:
    """Cleansed bills, the rate comparison and its additive cells as tables; the inputs with them, and their entries.

    The bills are read and joined once here, and the comparison is added up once by
    ``CELL_KEYS``, once by ``TERM_KEYS`` and once by year and premium step. The products aggregate those
    cells, whose number is bounded by the keys, and read no bills of the comparison. With ``years``
    only those years are read, joined and written anew; the others stay where ``older`` has them.
    """
    entries: dict[str, dict] = {}

    def stored(df: DataFrame, name: str, by: str | None = "year_charge") -> DataFrame:
        entries[name] = _written(spark, df, f"{folder}/{name}", by, years, (older or {}).get(name))
        return read_entry(spark, entries[name])

    cleaned = stored(clean_bills(t.bills), "cleaned_bills")
    comparison = stored(compare_rates(cleaned, t.rate_sheet), "rate_comparison")
    cells = stored(additive(comparison, CELL_KEYS), "cells")
    premiums = stored(premium_cells(comparison), "premiums")
    terms = stored(additive(comparison, TERM_KEYS), "terms", by=None)
    stored(t.rate_sheet, "rate_sheet", by=None)  # what later changes are compared with
    return t.replaced(cleaned=cleaned, comparison=comparison, cells=cells, terms=terms, premiums=premiums), entries


def published(spark: SparkSession, folder: str) -> dict | None:
    """The newest version committed to ``folder``: number, layers, products and reports."""
    versions = committed(spark, f"{folder}/versions")
    return versions[max(versions)] if versions else None


def product(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A product or layer as of the newest version."""
    version = published(spark, folder)
    if version is None:
        raise ValueError(f"{folder}: nothing was published")
    return read_entry(spark, {**version["layers"], **version["products"]}[name])


def publish(
    spark: SparkSession,
    t: Inputs,
    folder: str,
    products: Iterable[str] | None = None,
    years: Sequence[str] | None = None,
) -> Inputs:
    """Write the layers, then each product as a table and as a CSV report, as one version.

    Everything goes to folders of its own, and the version counts once it is committed at the end: until then, and
    if anything fails, readers (``published``, ``product``) see the version before, whole. Of two that are
    published at once the second fails.

    With ``years`` only the bills of those years have changed since the last version. Layers and products
    that are kept by year get new files for those years alone; products that read no bills, and those not
    asked for, stay as they are. Which products read bills is found from the products (``reads``). Years that
    ``publish_changes`` left behind must be among them.

    The cleansed bills and the comparison are their layers' tables and not written
    again; the comparison is also delivered as ``;`` text, in as many files as its
    table has. Yearly products in ``BY_YEAR`` are tables by year.
    """
    if spark.conf.get("spark.sql.ansi.enabled").lower() != "true":
        raise ValueError("publish needs spark.sql.ansi.enabled: sums would wrap on overflow")
    last = published(spark, folder)
    if years and last is None:
        raise ValueError(f"{folder}: years can be published anew only where a version is")
    behind = last.get("behind", {"years": [], "tables": []}) if last else {"years": [], "tables": []}
    if years and (left := set(behind["years"]) - set(years)):
        raise ValueError(f"{folder}: changes were published for {sorted(left, key=str)}, publish those years too")
    products = list(products or PRODUCTS)
    number = last["number"] + 1 if last else 1
    root = f"{folder}/data/{number:08d}-{uuid.uuid4().hex}"
    layered, layers = store_layers(spark, t, f"{root}/layers", years, last and last["layers"])
    tables = dict(last["products"]) if last else {}
    reports = dict(last["reports"]) if last else {}
    for name in products:
        if years and name in tables and not reads(PRODUCTS[name], layered) & OF_BILLS:
            continue
        if name == "rate_comparison":
            write_report(layered.comparison, f"{root}/reports/{name}", sep=";")
            reports[name] = f"{root}/reports/{name}"
        if name in STORED_LAYERS:
            tables[name] = layers[STORED_LAYERS[name]]
            continue
        df = ordered(name, PRODUCTS[name](layered))
        by = BY_YEAR.get(name)
        tables[name] = _written(spark, df, f"{root}/products/{name}", by, years if by else None, tables.get(name))
        if name not in LAYERS:
            reports[name] = f"{root}/reports/{name}"
            write_report(ordered(name, read_entry(spark, tables[name])), reports[name])
    stale = [n for n in behind["tables"] if n not in products and n not in layers]
    content = {
        "number": number,
        "layers": layers,
        "products": tables,
        "reports": reports,
        "changes": last.get("changes", []) if last else [],
        "behind": {"years": [], "tables": stale},
    }
    _commit_version(spark, folder, content)
    return layered


def _commit_version(spark: SparkSession, folder: str, content: dict) -> None:
    number = content["number"]
    if not commit(spark, f"{folder}/versions", f"{number:08d}", content):
        raise RuntimeError(f"{folder}: version {number} was published by another run")


# Layers kept by signed cells, not bill by bill: keys, measures and how changed bills become cells.
_CHANGED = {
    "cells": (CELL_KEYS, MEASURES, lambda df: additive(df, [*CELL_KEYS, "side"])),
    "terms": (TERM_KEYS, MEASURES, lambda df: additive(df, [*TERM_KEYS, "side"])),
    "premiums": (
        PREMIUM_KEYS,
        ("num_customers",),
        lambda df: threshold_cells(df, ["year_charge", "side"], "rate_difference", PREMIUM_STEPS, "num_customers"),
    ),
}


def publish_changes(
    spark: SparkSession,
    t: Inputs,
    folder: str,
    batch: str,
    added: DataFrame | None = None,
    removed: DataFrame | None = None,
) -> bool:
    """Publish late and corrected bills as a version of their own, without reading the bills before.

    ``added`` and ``removed`` are conformed bills: late ones are added, a corrected one is removed as it was and
    added as it is. They are cleansed and compared like all bills, with the rate sheet of the last version, and
    become signed cells, which are added to the last version's; of cells kept by year only
    the years concerned are read and written. Products that read cells and no bills are written anew.

    Row-level layers and products that read them stay as they were; the commit names them and the years under
    ``behind``, until ``publish`` writes them from bills that have the changes. A
    batch counts once, with its version; False if it was there already, and then nothing changes.
    It fails, and changes nothing, if bills are removed that the cells do not have.
    """
    last = published(spark, folder)
    if last is None:
        raise ValueError(f"{folder}: changes need a version to change")
    if batch in last.get("changes", []):
        return False
    number = last["number"] + 1
    root = f"{folder}/data/{number:08d}-{uuid.uuid4().hex}"
    old = last["layers"]
    rates = read_entry(spark, old["rate_sheet"])
    for name, bills, side in (("added", added, 1), ("removed", removed, -1)):
        if bills is not None:
            compared = compare_rates(clean_bills(bills), rates).withColumn("side", F.lit(side))
            compared.write.parquet(f"{root}/changes/side={name}")
    sides = [n for n, df in (("added", added), ("removed", removed)) if df is not None]
    if not sides:
        raise ValueError(f"batch {batch}: no bills were added or removed")
    changes = spark.read.parquet(*[f"{root}/changes/side={n}" for n in sides])
    # A handful of values, however many bills.
    found = [r.year_charge for r in changes.select("year_charge").distinct().collect()]
    years = None if None in found else sorted(found)
    layers = dict(old)
    for name, (keys, measures, cells_of) in _CHANGED.items():
        by = old[name]["by"]
        cells = read_entry(spark, old[name])
        if by and years is not None:
            cells = cells.where(F.col(by).isin(years))
        after = merged(cells, cells_of(changes), keys, measures)
        layers[name] = _written(spark, after, f"{root}/layers/{name}", by, years if by else None, old[name])
    read = {n: read_entry(spark, layers[n]) for n in _CHANGED}
    rows = {"cleaned": read_entry(spark, old["cleaned_bills"]), "comparison": read_entry(spark, old["rate_comparison"])}
    layered = t.replaced(**read, **rows)
    tables, reports = dict(last["products"]), dict(last["reports"])
    stale = {"cleaned_bills", "rate_comparison", *last.get("behind", {}).get("tables", [])}
    for name in tables:
        if name in STORED_LAYERS or (asked := reads(PRODUCTS[name], layered)) & {"bills", "cleaned", "comparison"}:
            stale.add(name)
        elif asked & set(_CHANGED):
            df = ordered(name, PRODUCTS[name](layered))
            by = BY_YEAR.get(name)
            tables[name] = _written(spark, df, f"{root}/products/{name}", by, years if by else None, tables[name])
            reports[name] = f"{root}/reports/{name}"
            write_report(ordered(name, read_entry(spark, tables[name])), reports[name])
            stale.discard(name)
    pending = set(last.get("behind", {}).get("years", [])) | set(found)
    content = {
        "number": number,
        "layers": layers,
        "products": tables,
        "reports": reports,
        "changes": [*last.get("changes", []), batch],
        "behind": {"years": sorted(pending, key=str), "tables": sorted(stale)},
    }
    _commit_version(spark, folder, content)
    return True
