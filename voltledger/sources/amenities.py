"""Amenity extracts of the suppliers and their keyed repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.operators.cleanse import drop_where, normalise
from voltledger.operators.conform import (
    AMENITY_RAW,
    AmenitySpec,
    accepted,
    conform_amenities,
    land,
    stack,
)

# Column names of each supplier's extract, as delivered, with the
# rules that belong to it.
_PLAIN = {
    "supplier": "Supplier Name",
    "year": "Year",
    "amenity": "Amenity Offered",
    "value": "Value of Amenity",
    "redeemed": "Number of Amenities Redeemed by Customers",
}
_DISTRIBUTED = {**_PLAIN, "redeemed": "Amount of Amenity Distributed to Customers"}
_XOOM = {
    "supplier": "i. Supplier Name;",
    "year": "ii. Year (not date) of amenity provided;",
    "amenity": "iii. The type of amenity offered (i.e. gift card, customer credit, "
    "airline mileage, energy efficient perks, etc);",
    "value": "vi. the value of each amenity offered;",
    "redeemed": "viii. how many of each amenity was redeemed.",
}
_TOWN_SQUARE = {**_PLAIN, "redeemed": "Number of Amenties Redeemed by Customers"}



def _blank_row() -> Column:
    """No mapped cell has anything in it."""
    cells = [F.coalesce(F.trim(c), F.lit("")) for c in AMENITY_RAW]
    return F.concat(*cells) == ""


AMENITY_SPECS: tuple[AmenitySpec, ...] = (
    # The sheet starts with a blank row and a repeated heading.
    AmenitySpec("ambit", _PLAIN, drop=lambda: _blank_row() | F.coalesce(F.trim("supplier") == "Supplier Name", F.lit(False))),
    AmenitySpec("atlantic", _DISTRIBUTED),
    AmenitySpec(
        "clearview",
        {
            "supplier": "SUPPLIER NAME",
            "year": "YEAR",
            "amenity": "AMENITY OFFERED",
            "value": "VALUE OF AMENITY",
            "redeemed": "AMOUNT OF AMENITY DISTRIBUTED TO CUSTOMERS",
        },
        supplier="Clearview Energy",
        amenity_chars=40,
    ),
    AmenitySpec(
        "constellation",
        {
            "supplier": "Supplier Name",
            "year": "Year",
            "amenity": "Amenity Provided",
            "value": "Value ($)",
            "redeemed": "Amentities Redeemed",
        },
    ),
    AmenitySpec("ctge", _PLAIN),
    AmenitySpec(
        "direct",
        {**_PLAIN, "redeemed": "Number of Amenities Redeemed by Customer"},
        supplier="Direct Energy Services, LLC",
        amenity_chars=40,
        drop=lambda: F.col("redeemed") == "NULL",
    ),
    AmenitySpec(
        "energyplus",
        {**_PLAIN, "cost": "Cost of Miles/Points Redeemed"},
        total="cost_or_redeemed",
        keep_value=False,
    ),
    AmenitySpec("er", _PLAIN),
    AmenitySpec("nap", _DISTRIBUTED, drop=lambda: F.col("amenity") == "Understandabill"),
    AmenitySpec("public", _PLAIN),
    AmenitySpec("reliant", _PLAIN, total="redeemed", value_chars=3),
    AmenitySpec("townsquare_2018", _TOWN_SQUARE),
    AmenitySpec("townsquare_2019", _TOWN_SQUARE),
    AmenitySpec(
        "townsquare_2020",
        {**_TOWN_SQUARE, "cost": "Amount of Amenity Distributed to Customers"},
        total="cost_or_zero",
    ),
    AmenitySpec(
        "townsquare_2021",
        {**_TOWN_SQUARE, "cost": "Amount of Amenity Distributed to Customers"},
        total="cost_or_zero",
    ),
    AmenitySpec(
        "verde",
        {
            **_PLAIN,
            "redeemed": "Number of Amenities Redemeed by Customers",
            "cost": "Cost to Company",
        },
        total="cost",
        value_chars=3,
    ),
    AmenitySpec("xoom_extras", _XOOM),
    AmenitySpec("xoom_rewards", _XOOM),
    # Airline miles carry no money value: read, never stored.
    AmenitySpec("xoom_miles", _XOOM, stored=False),
    AmenitySpec("xoom_donation", _XOOM, total="value"),
)

_SHARE = "5% of 12 month kwh expenditure"

# Repairs of hard-to-read records, on the raw text.
CORRECTIONS = {
    "clearview": (
        ({"amenity": "$75 and ongoing free weekend charging (up to 250kwh)"}, {"value": "180"}),
        ({"amenity": "Hulu subscription"}, {"value": "5.99"}),
        ({"amenity": _SHARE, "year": "2019"}, {"value": "66.80"}),
        ({"amenity": _SHARE, "year": "2020"}, {"value": "54.00", "redeemed": "270"}),
        ({"amenity": _SHARE, "year": "2021"}, {"value": "45.31"}),
        ({"amenity": "1USB Battery Bank"}, {"year": "2018"}),
        ({"amenity": "8 LED Bulbs and 8 LED Bulbs"}, {"year": "2018"}),
    ),
}

# Bill-side name of the suppliers named differently here.
BILL_SUPPLIERS = {
    "Constellation NewEnergy Inc": ("Constellation",),
    "XOOM": ("XOOM Energy",),
    "ClearView Electric": ("Clearview Energy",),
    "Energy Plus": ("energyplus",),
}

# Years under study.
STUDY_YEARS = ("2017", "2018", "2019", "2020", "2021")


def clean_amenities(df: DataFrame, years: Sequence[str] = STUDY_YEARS) -> DataFrame:
    """Study years only (a missing year is kept), suppliers named as on the bills."""
    return normalise(drop_where(df, ~F.col("year").isin(*years)), "supplier", BILL_SUPPLIERS)


def load_amenities(extracts: dict[str, DataFrame]) -> DataFrame:
    """Raw extracts by spec name -> amenity schema plus ``load_errors``."""
    return stack(
        conform_amenities(land(extracts[s.name], s), s, CORRECTIONS)
        for s in AMENITY_SPECS
        if s.stored and s.name in extracts
    )


def union_amenities(extracts: dict[str, DataFrame]) -> DataFrame:
    """The accepted, cleaned amenities of all extracts."""
    return clean_amenities(accepted(load_amenities(extracts)))

