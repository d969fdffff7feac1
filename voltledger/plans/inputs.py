"""The conformed tables every product starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from voltledger.operators import clean_bills, compare_rates, threshold_cells

CONFORMED = (
    "bills",
    "green",
    "rate_sheet",
    "income",
    "crosswalk",
    "participation",
    "amenities",
    "minority",
    "english",
    "population",
)
# Derived from the bills unless given as stored tables.
DERIVED = ("cleaned", "comparison", "cells", "terms", "premiums")

# Keys of the two additive layers.
CELL_KEYS = ("supplier", "edc", "zipcode", "year_charge", "year_half")
TERM_KEYS = ("edc", "month_commencement", "contractterm")

PREMIUM_KEYS = ("year_charge", "exceeded")

# Premiums in dollars per kWh above which bills are counted, rising.
PREMIUM_STEPS = ("0.02", "0.05", "0.10", "0.15")


def premium_cells(comparison: DataFrame) -> DataFrame:
    """Customers by year and number of premium steps that their bills exceed."""
    return threshold_cells(comparison, ["year_charge"], "rate_difference", PREMIUM_STEPS, "num_customers")


class Inputs:
    """Conformed inputs by name, each a DataFrame or a function giving one.

    A function is called when a product first needs its table.  ``cleaned``,
    ``comparison``, ``cells``, ``terms`` and ``premiums`` are derived from the bills unless they
    are given, as stored tables, under those names.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        unknown = set(tables) - {*CONFORMED, *DERIVED}
        if unknown:
            raise ValueError(f"unknown inputs: {sorted(unknown)}")
        self._tables = dict(tables)

    def _table(self, name: str) -> DataFrame:
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("_tables", {})
        if name in tables:
            return self._table(name)
        if name in CONFORMED:
            raise AttributeError(f"input {name!r} was not given")
        raise AttributeError(name)

    @property
    def cleaned(self) -> DataFrame:
        """Cleansed bills."""
        return self._table("cleaned") if "cleaned" in self._tables else clean_bills(self.bills)

    @property
    def comparison(self) -> DataFrame:
        """Cleansed bills with standard rate and overpayment."""
        if "comparison" in self._tables:
            return self._table("comparison")
        return compare_rates(self.cleaned, self.rate_sheet)

    @property
    def cells(self) -> DataFrame:
        """What products by ``CELL_KEYS`` aggregate: the comparison's cells if stored, else itself."""
        return self._table("cells") if "cells" in self._tables else self.comparison

    @property
    def terms(self) -> DataFrame:
        """The same by ``TERM_KEYS``."""
        return self._table("terms") if "terms" in self._tables else self.comparison

    @property
    def premiums(self) -> DataFrame:
        """Customers by year and premium step."""
        return self._table("premiums") if "premiums" in self._tables else premium_cells(self.comparison)

    def replaced(self, **tables: DataFrame | Callable[[], DataFrame]) -> Inputs:
        """The same inputs with some tables exchanged."""
        return Inputs(**{**self._tables, **tables})
