"""Column rules for missing values, rounding and division.

The analysis mixes two worlds: statistical sums, where one missing value makes
the whole group missing, and SQL sums, which skip missing values.  Every rule
is stated once here as a plain ``Column`` so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(value: Column | str, where: Column | None = None) -> Column:
    """Sum that is NULL as soon as one of its rows is NULL.

    With ``where`` only the matching rows take part; no matching row gives NULL.
    Both counts and the sum are mergeable, so the map-side combine is kept.
    """
    value = _col(value)
    if where is None:
        rows = F.count(F.lit(1))
    else:
        value = F.when(where, value)
        rows = F.count(F.when(where, F.lit(1)))
    return F.when(F.count(value) == rows, F.sum(value))


# Whole and rest of a scaled integer are summed apart at this many units.
_CHUNK = 100_000


def scaled(value: Column | str, digits: int) -> Column:
    """Decimal of at most 15 digits as a whole number of ``10**-digits``.

    Such a decimal is exact in a double up to rounding, so no object is made per
    row, as decimal arithmetic would.
    """
    return F.rint(_col(value).cast("double") * float(10**digits)).cast("bigint")


def scaled_sum(
    units: Column | str, digits: int, where: Column | None = None, strict: bool = False
) -> Column:
    """Exact decimal sum of scaled integers, in long arithmetic.

    Chunks and remainders are summed apart, which leaves room for 9 * 10**13 rows and,
    at 7 digits, 9 * 10**16 dollars a group. Beyond it the sum fails under
    ``spark.sql.ansi.enabled``, which ``build_session`` sets and ``publish`` demands.
    Decimal sums give the same value at twice the time for the whole query.
    With ``strict`` a NULL among the rows makes the sum NULL.
    """
    units = _col(units)
    value = units if where is None else F.when(where, units)
    chunks = F.sum(F.call_function("div", value, F.lit(_CHUNK).cast("bigint")))
    rest = F.sum(value % F.lit(_CHUNK).cast("bigint"))
    whole_units = chunks.cast("decimal(19,0)") * F.lit(_CHUNK).cast("decimal(6,0)")
    unit = F.lit("1" if digits == 0 else "0." + "0" * (digits - 1) + "1").cast(
        f"decimal({max(digits, 1)},{digits})"
    )
    total = ((whole_units + rest.cast("decimal(19,0)")) * unit).cast(f"decimal(38,{digits})")
    if not strict:
        return total
    rows = F.count(F.lit(1)) if where is None else F.count(F.when(where, F.lit(1)))
    return F.when(F.count(value) == rows, total)


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as a double; NULL for a zero or missing denominator."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def half_even(value: Column | str, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(_col(value), digits)


def whole(value: Column | str) -> Column:
    """Round half to even to a whole number."""
    return F.bround(_col(value), 0).cast("bigint")


def int_or_null(text: Column | str) -> Column:
    """Leading whole part of a number in text; NULL if the text is no number."""
    return _col(text).try_cast("double").try_cast("int")


def whole_or_null(text: Column | str) -> Column:
    """``12`` and ``12.0`` as 12; NULL for a text with a fraction and for one that is no number."""
    return F.regexp_replace(_col(text), "[.]0*$", "").try_cast("int")


def any_of(*predicates: Column) -> Column:
    out = predicates[0]
    for p in predicates[1:]:
        out = out | p
    return out


def keep_unless(*predicates: Column) -> Column:
    """Filter that removes a row only where a predicate is TRUE.

    A predicate that is NULL keeps its row.  Written as ``p IS NULL OR NOT p`` so
    that Catalyst can push the null test down to the column and the scan.
    """
    keep = F.lit(True)
    for p in predicates:
        keep = keep & (p.isNull() | ~p)
    return keep
