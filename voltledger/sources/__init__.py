from voltledger.sources.amenities import (
    AMENITY_SPECS,
    CORRECTIONS,
    STUDY_YEARS,
    clean_amenities,
    load_amenities,
    union_amenities,
)
from voltledger.sources.bills import BILL_SPECS, load_bills, union_bills
from voltledger.sources.census import (
    acs_income,
    load_crosswalk,
    low_english,
    minority_share,
    population,
    unread,
    zip_crosswalk,
)
from voltledger.sources.readers import read_extract, read_positional, read_sheet
from voltledger.sources.sinks import (
    append_table,
    bill_audit,
    overwrite_table,
    write_by,
    write_by_year,
    write_load,
    write_report,
)
from voltledger.sources.usage import (
    PARTICIPATION_COLUMNS,
    green_usage,
    load_green,
    load_participation,
    load_rate_sheet,
    participation_counts,
    rate_sheet,
)
from voltledger.sources.versions import commit, committed, entry, exists, read_entry

__all__ = [
    "AMENITY_SPECS",
    "BILL_SPECS",
    "CORRECTIONS",
    "PARTICIPATION_COLUMNS",
    "STUDY_YEARS",
    "acs_income",
    "append_table",
    "bill_audit",
    "clean_amenities",
    "commit",
    "committed",
    "entry",
    "exists",
    "green_usage",
    "load_amenities",
    "load_bills",
    "load_crosswalk",
    "load_green",
    "load_participation",
    "load_rate_sheet",
    "low_english",
    "minority_share",
    "overwrite_table",
    "participation_counts",
    "population",
    "rate_sheet",
    "read_entry",
    "read_extract",
    "read_positional",
    "read_sheet",
    "union_amenities",
    "union_bills",
    "unread",
    "write_by",
    "write_by_year",
    "write_load",
    "write_report",
    "zip_crosswalk",
]
