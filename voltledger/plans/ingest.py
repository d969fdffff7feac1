"""From delivered sheets to the stored, conformed inputs of the products, batch by batch."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.operators import clean_green, stack
from voltledger.plans.inputs import Inputs
from voltledger.sources import (
    AMENITY_SPECS,
    BILL_SPECS,
    PARTICIPATION_COLUMNS,
    acs_income,
    bill_audit,
    clean_amenities,
    commit,
    committed,
    exists,
    load_amenities,
    load_bills,
    load_crosswalk,
    load_green,
    load_participation,
    load_rate_sheet,
    low_english,
    minority_share,
    population,
    read_positional,
    read_sheet,
    unread,
    write_load,
)
from voltledger.sources.sinks import BILL_TOTALS

# Sheets read by heading: columns and what loads them.
_HEADED: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {
    "green": (tuple(schemas.GREEN.names), load_green),
    "rate_sheet": (("year", "month", "eversource_rate", "ui_rate"), load_rate_sheet),
    "crosswalk": (("ZIP_CODE", "PO_NAME", "STATE", "ZIP_TYPE", "ZCTA", "zip_join_type"), load_crosswalk),
}
# By position: columns, what conforms them and the schema.
_BY_POSITION: dict[str, tuple[list[str], Callable[[DataFrame], DataFrame]]] = {
    "income": (["geographic_name", "count_households", "median_hh_income"], acs_income),
    "minority": (["geography", "geographic_area_name", "white_alone", "pct_minority"], minority_share),
    "english": (["zcta", "households", "limited_english_households", "pct_low_english"], low_english),
    "population": (["Area", "Total_population"], population),
}
# Tables that grow by batch; of the others the newest batch that has one counts.
_APPENDED = {
    "bills": schemas.BILLS,
    "amenities": schemas.AMENITIES,
    "participation": schemas.PARTICIPATION,
    "green": schemas.GREEN,
}
_NEWEST = {
    "rate_sheet": schemas.RATE_SHEET,
    "crosswalk": schemas.CROSSWALK,
    "income": schemas.INCOME,
    "minority": schemas.MINORITY,
    "english": schemas.LOW_ENGLISH,
    "population": schemas.POPULATION,
}
_CLEAN = {"amenities": clean_amenities, "green": clean_green}


def ingest(
    spark: SparkSession,
    folder: str,
    bills: Mapping[str, str] | None = None,
    amenities: Mapping[str, str] | None = None,
    participation: Mapping[str, str] | None = None,
    sheets: Mapping[str, str] | None = None,
    sep: str = ",",
    batch: str = "initial",
) -> Inputs:
    """Load every sheet as one batch into ``folder``; returns the tables of all batches for ``publish``.

    ``bills`` and ``amenities`` are paths by extract, ``participation`` by utility,
    ``sheets`` of green, rate_sheet, crosswalk, income, minority, english and
    population; a later batch may have some of them only. Bills, amenities, participation and green usage
    of all batches add up; of the other sheets the newest one counts.

    A batch counts as a whole, once it is committed under its name at the end: a load that failed
    half-way leaves nothing that is read, and one that is run again adds nothing. Rows that have
    load errors are stored beside the accepted ones, see ``load_rejects``. The commit has what was
    observed while the rows were written: accepted, rejected and totals of the accepted bills; and the
    census cells that could not be read.
    """
    if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", batch):
        raise ValueError(f"batch {batch!r}: letters, digits, dot, dash and underscore only")
    done = committed(spark, f"{folder}/batches")
    if batch in done:
        return stored_inputs(spark, folder)
    own = f"{folder}/loads/{batch}-{uuid.uuid4().hex}"
    content: dict[str, dict] = {}

    def sheet(path: str, headings, name: str) -> DataFrame:
        return read_sheet(spark, path, list(headings), sep, folder=f"{own}/lines/{name}")

    def extracts(paths: Mapping[str, str], specs: tuple) -> dict[str, DataFrame]:
        known = {s.name: s for s in specs}
        if unknown := set(paths) - set(known):
            raise ValueError(f"unknown extracts: {sorted(unknown)}")
        return {n: sheet(p, known[n].columns.values(), n) for n, p in paths.items()}

    def loaded(name: str, df: DataFrame, sums: tuple[str, ...] = ()) -> None:
        content[name] = write_load(df, f"{own}/{name}", sums)
        content[name] = {k: v if isinstance(v, int) else None if v is None else str(v) for k, v in content[name].items()}

    if bills:
        loaded("bills", load_bills(extracts(bills, BILL_SPECS)), BILL_TOTALS)
    if amenities:
        loaded("amenities", load_amenities(extracts(amenities, AMENITY_SPECS)))
    if participation:
        answers = (
            load_participation(sheet(p, PARTICIPATION_COLUMNS[u].values(), f"participation-{u}"), u)
            for u, p in participation.items()
        )
        loaded("participation", stack(answers))
    for name, path in (sheets or {}).items():
        if name in _HEADED:
            headings, load = _HEADED[name]
            loaded(name, load(sheet(path, headings, name)))
        else:
            columns, conform = _BY_POSITION[name]
            raw = read_positional(spark, path, columns, sep)
            loaded(name, conform(raw).withColumn("load_errors", F.lit(None).cast("string")))
            content[name]["unread"] = {r.column: r.n for r in unread(raw, name).collect()}
    commit(spark, f"{folder}/batches", batch, {"path": own, "number": len(done), "tables": content})
    inputs = stored_inputs(spark, folder)
    if bills:
        bill_audit(inputs.bills).write.mode("overwrite").parquet(f"{folder}/control_totals")
    load_rejects(spark, folder).write.mode("overwrite").parquet(f"{folder}/rejects")
    return inputs


def _batches(spark: SparkSession, folder: str) -> list[dict]:
    """Commits of ``folder``, in the order in which they were made."""
    done = committed(spark, f"{folder}/batches")
    return [done[n] for n in sorted(done, key=lambda n: (done[n]["number"], n))]


def _rows(spark: SparkSession, paths: list[str], status: str, schema) -> DataFrame:
    """Rows of one status below ``paths``, which have no folder for a status without rows."""
    kept = [p for p in (f"{path}/load_status={status}" for path in paths) if exists(spark, p)]
    return spark.read.schema(schema).parquet(*kept) if kept else spark.createDataFrame([], schema)


def stored_inputs(spark: SparkSession, folder: str) -> Inputs:
    """The tables of all batches that were committed to ``folder``."""
    batches = _batches(spark, folder)
    tables = {}
    for name, schema in {**_APPENDED, **_NEWEST}.items():
        paths = [f"{b['path']}/{name}" for b in batches if name in b["tables"]]
        if paths:
            rows = _rows(spark, paths if name in _APPENDED else paths[-1:], "accepted", schema)
            tables[name] = _CLEAN.get(name, lambda df: df)(rows)
    return Inputs(**tables)


def load_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """(load, load_errors, count): rejected rows of all batches by table and unfit columns."""
    batches = _batches(spark, folder)
    parts = []
    for name in {**_APPENDED, **_NEWEST}:
        paths = [f"{b['path']}/{name}" for b in batches if b["tables"].get(name, {}).get("rejected")]
        rows = _rows(spark, paths, "rejected", "load_errors string")
        parts.append(rows.select(F.lit(name).alias("load"), "load_errors"))
    return stack(parts).groupBy("load", "load_errors").count()


