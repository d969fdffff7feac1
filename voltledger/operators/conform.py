"""Spec-driven conforming of differently shaped extracts to one schema.

Loading has two narrow steps and no shuffle:

* ``land`` renames the columns of one extract to shared raw names, all text, and
  tags the rows with the extract's name.  Landed extracts stack into one table,
  stored by extract.
* ``conform_bills`` / ``conform_amenities`` turn the landed rows of one extract
  into typed rows by its spec.  ``conform_landed`` does so for every extract of a
  landed table: one branch per spec, each reading its own partition only, each
  with code small enough for the JVM to compile.  (One CASE over all specs reads
  the same data but makes methods the JVM leaves interpreted, several times
  slower.)

A value that does not fit its column does not lose the extract: the row gets a
``load_errors`` text naming the columns, and ``accepted`` / ``rejected`` divide
the rows.  Both sides come from one write partitioned by status
(``sinks.write_load``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltledger import schemas
from voltledger.functions import excel_date, month_number, zip_text
from voltledger.operators.cleanse import correct

BILL_RAW = (
    "supplier",
    "charge",
    "rate",
    "zip",
    "customers",
    "kwh",
    "commencement",
    "term",
    "service_fee",
    "term_fee",
    "terminations",
    "edc",
)

AMENITY_RAW = ("supplier", "year", "amenity", "value", "redeemed", "cost")

# Texts an extract writes where it has no value.
BLANKS = ("NULL", "See Narrative", "Month-To-Month", "See Response to EOE-6", "NA", "")


@dataclass(frozen=True)
class BillSpec:
    """How one supplier's bill extract maps to the bill schema.

    ``columns`` maps raw names to the extract's own column names.  Styles:
    ``ym`` YYYY-MM, ``name_yy`` July-19, ``name_yyyy`` July-2019 or Jul-2019,
    ``m_yy`` 7/19, ``serial`` spreadsheet day number, ``none`` never reported.
    """

    name: str
    columns: Mapping[str, str]
    charge: str = "ym"
    commencement: str = "ym"
    zip_prefix: str = "0"
    # Raw number columns in which other text becomes NULL instead of a load error.
    loose: tuple[str, ...] = ()
    # A blank mark as commencement stands for the month of the charge.
    blank_commencement_is_charge: bool = False
    # What this extract's own marks stand for, by raw column; other blank marks
    # and empty cells are NULL.
    blanks: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    # Raw columns replaced by a constant.
    constants: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class AmenitySpec:
    """How one supplier's amenity extract maps to the amenity schema.

    ``total``: product (value x redeemed), redeemed, value, cost, cost_or_redeemed
    or cost_or_zero.
    """

    name: str
    columns: Mapping[str, str]
    total: str = "product"
    value_chars: int | None = None
    keep_value: bool = True
    supplier: str | None = None
    # Longest amenity text kept; None leaves it whole.
    amenity_chars: int | None = None
    drop: Callable[[], Column] | None = None
    stored: bool = True


def land(
    extract: DataFrame, spec: BillSpec | AmenitySpec, raw: Sequence[str] | None = None
) -> DataFrame:
    """Shared raw text columns of one extract, tagged with its name."""
    raw = raw or (BILL_RAW if isinstance(spec, BillSpec) else AMENITY_RAW)
    known = {c.strip().lower(): c for c in extract.columns}
    out = [F.lit(spec.name).alias("extract")]
    for name in raw:
        source = spec.columns.get(name)
        if source is None:
            out.append(F.lit(None).cast("string").alias(name))
        else:
            actual = known[source.strip().lower()].replace("`", "``")
            out.append(F.col(f"`{actual}`").cast("string").alias(name))
    return extract.select(*out)


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """All frames as one, joined up in pairs so that the plan stays shallow."""
    level = list(frames)
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return level[0]


def _month_of(style: str, c: Column) -> Column:
    """struct(year text, month text) of a date text in one of the styles."""
    if style == "none":
        year = month = F.lit(None).cast("string")
    elif style == "ym":
        year, month = F.substring(c, 1, 4), F.substring(c, 6, 2)
    elif style == "serial":
        day = excel_date(c)
        year, month = F.date_format(day, "yyyy"), F.date_format(day, "MM")
    elif style == "m_yy":
        year = F.concat(F.lit("20"), F.substring_index(c, "/", -1))
        month = F.lpad(F.substring_index(c, "/", 1), 2, "0")
    else:
        year = F.right(c, F.lit(4)) if style == "name_yyyy" else F.right(c, F.lit(2))
        if style == "name_yy":
            year = F.concat(F.lit("20"), year)
        month = month_number(F.substring(c, 1, 3))
    return F.struct(year.alias("year"), month.alias("month"))


def _literal(text: str | None) -> str:
    return "CAST(NULL AS STRING)" if text is None else "'" + text.replace("'", "\\'") + "'"


_IS_BLANK = "{c} IN (" + ", ".join(_literal(b) for b in BLANKS) + ")"
_IS_MARK = "{c} IN (" + ", ".join(_literal(b) for b in BLANKS if b) + ")"


_IS_MONTH = "{c}.year RLIKE '^[0-9]{{4}}$' AND {c}.month RLIKE '^(0[1-9]|1[0-2])$'"


def _month_part(c: str, part: str) -> str:
    """Year or month of a date cell; NULL unless it is a month of four-digit year, never a year of its own."""
    return f"IF({_IS_MONTH.format(c=c)}, {c}.{part}, NULL)"


def _whole_number(name: str) -> str:
    """``12`` and ``12.0`` but not ``12.5``, which would not load as an integer."""
    return (
        f"coalesce(try_cast({name} AS INT), "
        f"try_cast(regexp_replace({name}, '[.]0*$', '') AS INT))"
    )


def _leading_number(name: str) -> str:
    """Number before an optional ``Months``; NULL for any other text."""
    bare = f"regexp_replace({name}, '(?i) *months?$', '')"
    return f"coalesce(try_cast({name} AS INT), try_cast(try_cast({bare} AS DOUBLE) AS INT))"


def conform_bills(landed: DataFrame, spec: BillSpec) -> DataFrame:
    """Landed rows of one bill extract -> bill schema plus ``load_errors``.

    Projections in steps, each reading finished columns of the one before, so that
    no rule is evaluated, or compiled, more than once.
    """
    fixed = {n: _literal(text) for n, text in spec.constants.items()}
    trimmed = landed.selectExpr(*[f"{fixed.get(n, f'trim({n})')} AS {n}" for n in BILL_RAW])

    def unmarked(name: str) -> Column:
        """The cell with this extract's marks replaced by what they stand for."""
        known = "".join(
            f" WHEN {name} = {_literal(mark)} THEN {_literal(str(number))}"
            for mark, number in spec.blanks.get(name, {}).items()
        )
        blank = f" WHEN {_IS_BLANK.format(c=name)} THEN NULL"
        return F.expr(f"CASE{known}{blank} ELSE {name} END AS {name}")

    numbers = ("rate", "customers", "kwh", "term", "service_fee", "term_fee", "terminations")
    marked = F.expr(f"coalesce({_IS_MARK.format(c='commencement')}, false)")
    started = F.expr("nullif(commencement, '')")
    cells = trimmed.select(
        "supplier",
        "edc",
        zip_text("zip", spec.zip_prefix).alias("zip"),
        *[unmarked(n) for n in numbers],
        _month_of(spec.charge, F.col("charge")).alias("charge"),
        F.when(~marked, _month_of(spec.commencement, started)).alias("start"),
        marked.alias("start_marked"),
        F.col("charge").alias("charge_text"),
        F.when(~marked, started).alias("start_text"),
    )

    def number(name: str) -> str:
        return _leading_number(name) if name in spec.loose else _whole_number(name)

    def start(part: str) -> str:
        own = _month_part("start", part)
        return f"IF(start_marked, {_month_part('charge', part)}, {own})" if spec.blank_commencement_is_charge else own

    typed = {
        "supplier": "supplier",
        "year_charge": _month_part("charge", "year"),
        "month_charge": _month_part("charge", "month"),
        "billed_rate": f"try_cast(try_cast(rate AS DECIMAL(38,18)) AS {schemas.RATE})",
        "zipcode": "zip",
        "num_customers": _whole_number("customers"),
        "totalkwh": f"try_cast(try_cast(kwh AS DECIMAL(38,18)) AS {schemas.KWH})",
        "year_commencement": start("year"),
        "month_commencement": start("month"),
        "contractterm": number("term"),
        "servicechargesfees": _whole_number("service_fee"),
        "term_fee": number("term_fee"),
        "num_terminations": number("terminations"),
        "edc": "edc",
    }
    # Texts that have to fit, by target column; a loose one may be anything.
    texts = {
        "year_charge": "nullif(charge_text, '')",
        "year_commencement": "start_text",
        "billed_rate": "rate",
        "num_customers": "customers",
        "totalkwh": "kwh",
        "contractterm": "term",
        "servicechargesfees": "service_fee",
        "term_fee": "term_fee",
        "num_terminations": "terminations",
    }
    texts = {target: raw for target, raw in texts.items() if raw not in spec.loose}
    for target, style in (("year_charge", spec.charge), ("year_commencement", spec.commencement)):
        if style == "none":
            del texts[target]
    return _checked(cells, typed, texts, schemas.BILLS, schemas.BILL_WIDTHS)


def conform_amenities(
    landed: DataFrame, spec: AmenitySpec, corrections: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """Landed rows of one amenity extract -> amenity schema plus ``load_errors``.

    ``corrections`` maps extract names to keyed corrections on the raw text.
    """
    rows = landed
    if spec.drop is not None:
        # A missing value goes with the rows the rule names.
        rows = rows.filter(F.coalesce(~spec.drop(), F.lit(False)))
    rows = correct(rows, (corrections or {}).get(spec.name, ()))
    value = f"substring(trim(value), 1, {spec.value_chars})" if spec.value_chars else "trim(value)"
    amenity = f"substring(amenity, 1, {spec.amenity_chars})" if spec.amenity_chars else "amenity"
    kind = "DECIMAL(20,6)"
    cells = rows.selectExpr(
        f"{_literal(spec.supplier) if spec.supplier else 'rtrim(supplier)'} AS supplier",
        "substring(trim(year), 1, 4) AS year",
        f"{amenity} AS amenity",
        f"try_cast({value} AS {kind}) AS value",
        f"try_cast(trim(redeemed) AS {kind}) AS redeemed",
        f"try_cast(trim(cost) AS {kind}) AS cost",
    )
    totals = {
        "product": f"try_cast(try_multiply(value, redeemed) AS {kind})",
        "redeemed": "redeemed",
        "value": "value",
        "cost": "cost",
        "cost_or_redeemed": "coalesce(cost, redeemed)",
        "cost_or_zero": f"coalesce(cost, CAST(0 AS {kind}))",
    }

    def filled(expression: str, zero: str) -> str:
        """0 for every missing cell of the extracts that ask for it."""
        return f"coalesce({expression}, {zero})" if spec.total == "cost_or_zero" else expression

    shown = "value" if spec.keep_value else f"CAST(NULL AS {kind})"
    no_amount = f"CAST(0 AS {kind})"
    amounts = {
        "alleged_value": filled(shown, no_amount),
        "num_redeemed": filled("redeemed", no_amount),
        "total_value_redeemed": totals[spec.total],
    }
    first = cells.selectExpr(
        *[f"{filled(n, _literal('0'))} AS {n}" for n in ("supplier", "year", "amenity")],
        *[f"{e} AS {n}" for n, e in amounts.items()],
    )
    typed = {n: n for n in ("supplier", "year", "amenity")}
    for n in amounts:
        typed[n] = f"try_cast({n} AS {schemas.AMENITIES[n].dataType.simpleString()})"
    texts = {n: n for n in amounts}
    return _checked(first, typed, texts, schemas.AMENITIES, schemas.AMENITY_WIDTHS)


def _checked(
    df: DataFrame,
    typed: Mapping[str, str],
    texts: Mapping[str, str],
    schema: T.StructType,
    widths: Mapping[str, int],
) -> DataFrame:
    """Typed columns and the names of those whose text did not fit them.

    The optimizer moves a filter below a plain projection by copying the projected
    expressions into it; for a filter on ``load_errors`` that would evaluate every
    rule again.  The one-row generator (``inline``) keeps such filters above it.
    """
    columns = [f"'{f.name}', {typed[f.name]}" for f in schema]
    columns += [f"'_text_{target}', {source}" for target, source in texts.items()]
    rows = df.selectExpr(f"inline(array(named_struct({', '.join(columns)})))")
    checks = [f"IF(_text_{n} IS NOT NULL AND {n} IS NULL, '{n}', NULL)" for n in texts]
    checks += [f"IF(length({n}) > {width}, '{n}', NULL)" for n, width in widths.items()]
    errors = f"nullif(concat_ws(',', {', '.join(checks)}), '') AS load_errors"
    return rows.selectExpr(*schema.names, errors)


def conform_landed(
    landed: DataFrame, specs: Sequence, conform: Callable[[DataFrame, object], DataFrame]
) -> DataFrame:
    """Every extract of a landed table, which is best stored by ``extract``."""
    stored = [s for s in specs if getattr(s, "stored", True)]
    return stack(conform(landed.filter(F.col("extract") == s.name), s) for s in stored)


def accepted(loaded: DataFrame) -> DataFrame:
    return loaded.filter(F.col("load_errors").isNull()).drop("load_errors")


def rejected(loaded: DataFrame) -> DataFrame:
    return loaded.filter(F.col("load_errors").isNotNull())
