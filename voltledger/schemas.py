"""Column types of the conformed tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _type(name: str) -> T.DataType:
    if name.startswith("decimal"):
        precision, scale = name[len("decimal(") : -1].split(",")
        return T.DecimalType(int(precision), int(scale))
    return {"string": T.StringType(), "int": T.IntegerType()}[name]


def _struct(*fields: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, _type(t), True) for n, t in fields])


RATE = "decimal(6,5)"
KWH = "decimal(10,1)"

BILLS = _struct(
    ("supplier", "string"),
    ("year_charge", "string"),
    ("month_charge", "string"),
    ("billed_rate", RATE),
    ("zipcode", "string"),
    ("num_customers", "int"),
    ("totalkwh", KWH),
    ("year_commencement", "string"),
    ("month_commencement", "string"),
    ("contractterm", "int"),
    ("servicechargesfees", "int"),
    ("term_fee", "int"),
    ("num_terminations", "int"),
    ("edc", "string"),
)

# Longest text each column of a bill may hold; a longer one is a load error.
BILL_WIDTHS = {
    "supplier": 50,
    "year_charge": 4,
    "month_charge": 2,
    "zipcode": 7,
    "year_commencement": 4,
    "month_commencement": 2,
    "edc": 30,
}

GREEN = _struct(
    ("supplier", "string"),
    ("year_charge", "string"),
    ("num_customers", "int"),
    ("specific_commitment", "string"),
    ("billed_rate", RATE),
    ("totalkwh", KWH),
)

RATE_SHEET = _struct(
    ("year", "string"),
    ("month", "string"),
    ("eversource_rate", "decimal(6,4)"),
    ("ui_rate", "decimal(6,4)"),
    ("date_concat", "string"),
)

INCOME = _struct(
    ("geographic_name", "string"),
    ("count_households", "int"),
    ("median_hh_income", "int"),
    ("zcta", "string"),
)

CROSSWALK = _struct(
    ("zipcode", "string"),
    ("po_name", "string"),
    ("state", "string"),
    ("zip_type", "string"),
    ("zcta", "string"),
    ("zip_join_type", "string"),
)

PARTICIPATION = _struct(
    ("zip", "string"),
    ("year", "string"),
    ("num_custs_supplier", "int"),
    ("num_custs_edc", "int"),
    ("tot_custs", "int"),
    ("edc", "string"),
)

AMENITIES = _struct(
    ("supplier", "string"),
    ("year", "string"),
    ("amenity", "string"),
    ("alleged_value", "decimal(6,2)"),
    ("num_redeemed", "decimal(10,2)"),
    ("total_value_redeemed", "decimal(15,2)"),
)

AMENITY_WIDTHS = {"supplier": 30, "year": 4, "amenity": 40}

MINORITY = _struct(
    ("geography", "string"),
    ("geographic_area_name", "string"),
    ("white_alone", "decimal(4,1)"),
    ("pct_minority", "decimal(4,3)"),
    ("zcta", "string"),
)

LOW_ENGLISH = _struct(
    ("zcta", "string"),
    ("households", "int"),
    ("limited_english_households", "int"),
    ("pct_low_english", "decimal(4,3)"),
)

POPULATION = _struct(("zcta", "string"), ("total_population", "int"))
