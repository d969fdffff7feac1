"""Census and crosswalk dimensions from their text sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.functions import int_or_null


def _fit(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


# Marks of the census tables for an amount that is not published.
MARKS = ("-", "250,000+", "2,500-", "(X)", "N", "**", "***")


def unread(raw: DataFrame, sheet: str) -> DataFrame:
    """(column, n): filled number cells of an area's row that become NULL without being a known mark.

    ``raw`` is what the sheet's function takes. Such cells cost no row; they are counted at the load.
    """
    of, numbers = _NUMBERS[sheet]
    rows = raw.filter(is_area(of(raw)))
    bad = {raw.columns[i]: typed(F.col(raw.columns[i])).isNull() for i, typed in numbers.items()}
    filled = {c: F.col(c).isNotNull() & (F.trim(c) != "") & ~F.trim(c).isin(*MARKS) for c in bad}
    counts = rows.agg(*[F.count_if(b & filled[c]).alias(c) for c, b in bad.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in bad]))).where("n > 0")


def area_code(name: Column | str) -> Column:
    """Five-digit census area inside ``ZCTA5 06001``."""
    return F.substring(name, 7, 5)


def is_area(code: Column | str) -> Column:
    """Five digits: what is left when heading lines, which arrive as rows, are dropped."""
    return F.coalesce((F.col(code) if isinstance(code, str) else code).rlike("^[0-9]{5}$"), F.lit(False))


def acs_income(raw: DataFrame) -> DataFrame:
    """Households and median income by area from (geographic_name, count_households,
    median_hh_income) text.  Heading rows are dropped; ``250,000+`` and ``-``
    become NULL."""
    zcta = area_code("geographic_name")
    rows = raw.withColumn("zcta", zcta).filter(is_area("zcta"))
    return _fit(
        rows.withColumns(
            {
                "count_households": int_or_null("count_households"),
                "median_hh_income": int_or_null("median_hh_income"),
            }
        ),
        schemas.INCOME,
    )


def load_crosswalk(raw: DataFrame, state: str = "CT") -> DataFrame:
    """One state's postal code -> census area rows, and ``load_errors``.

    A postal code or area that is filled but not five digits costs its row.
    """
    rows = zip_crosswalk(raw, state)
    wrong = [F.when((F.col(c) != "") & ~F.col(c).rlike("^[0-9]{5}$"), F.lit(c)) for c in ("zipcode", "zcta")]
    return rows.withColumn("load_errors", F.nullif(F.concat_ws(",", *wrong), F.lit("")))


def zip_crosswalk(raw: DataFrame, state: str = "CT") -> DataFrame:
    """One state's postal code -> census area rows as they stand."""
    rows = raw.filter(F.col("STATE") == state).withColumnsRenamed(
        {
            "ZIP_CODE": "zipcode",
            "PO_NAME": "po_name",
            "STATE": "state",
            "ZIP_TYPE": "zip_type",
            "ZCTA": "zcta",
        }
    )
    trimmed = rows.withColumns({"zipcode": F.rtrim("zipcode"), "zcta": F.rtrim("zcta")})
    return _fit(trimmed, schemas.CROSSWALK)


def minority_share(raw: DataFrame) -> DataFrame:
    """Minority share by area; columns of the raw sheet are taken by position."""
    named = raw.toDF("geography", "geographic_area_name", "white_alone", "pct_minority")
    named = named.filter(is_area(area_code("geographic_area_name")))
    share = F.bround(F.col("pct_minority").try_cast("double"), 3)
    return _fit(
        named.withColumns(
            {
                "white_alone": F.col("white_alone").try_cast("decimal(4,1)"),
                "pct_minority": share,
                "zcta": area_code("geographic_area_name"),
            }
        ),
        schemas.MINORITY,
    )


def low_english(raw: DataFrame) -> DataFrame:
    """Share of households with limited English by area, columns by position."""
    named = raw.toDF("zcta", "households", "limited_english_households", "pct_low_english")
    named = named.filter(is_area("zcta"))
    return _fit(
        named.withColumns(
            {
                "households": int_or_null("households"),
                "limited_english_households": int_or_null("limited_english_households"),
                "pct_low_english": F.col("pct_low_english").try_cast("decimal(4,3)"),
            }
        ),
        schemas.LOW_ENGLISH,
    )


def population(raw: DataFrame) -> DataFrame:
    """Total population by area from (Area, Total_population)."""
    return _fit(
        raw.filter(is_area(area_code("Area"))).select(
            area_code("Area").alias("zcta"), int_or_null("Total_population").alias("total_population")
        ),
        schemas.POPULATION,
    )


# Where a sheet's row has its area, and its number columns by place with their types.
_NUMBERS = {
    "income": (lambda raw: area_code(raw.columns[0]), {1: int_or_null, 2: int_or_null}),
    "minority": (lambda raw: area_code(raw.columns[1]), {2: lambda c: c.try_cast("decimal(4,1)"), 3: lambda c: c.try_cast("double")}),
    "english": (lambda raw: F.col(raw.columns[0]), {1: int_or_null, 2: int_or_null, 3: lambda c: c.try_cast("decimal(4,3)")}),
    "population": (lambda raw: area_code(raw.columns[0]), {1: int_or_null}),
}
