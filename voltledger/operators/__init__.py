from voltledger.operators.bands import (
    band_label,
    band_number,
    bands,
    below_above,
    exceed_counts,
    exceed_totals,
    pivot_mean,
    threshold_cells,
)
from voltledger.operators.cleanse import (
    clamp_negative,
    clean_bills,
    clean_green,
    correct,
    drop_where,
    normalise,
)
from voltledger.operators.conform import (
    accepted,
    conform_amenities,
    conform_bills,
    conform_landed,
    land,
    rejected,
    stack,
)
from voltledger.operators.geo import attach_area, by_membership, keep_in, rollup_geo
from voltledger.operators.merge import merge_full
from voltledger.operators.overpay import MEASURES, additive, kwh, merged, net, per_unit_split, premium, split
from voltledger.operators.rates import compare_rates, standard_rates, weighted_avg
from voltledger.operators.reports import control_totals, report, top_bottom, with_total

__all__ = [
    "accepted",
    "MEASURES",
    "additive",
    "attach_area",
    "band_label",
    "band_number",
    "bands",
    "below_above",
    "by_membership",
    "clamp_negative",
    "clean_bills",
    "clean_green",
    "compare_rates",
    "conform_amenities",
    "conform_bills",
    "conform_landed",
    "control_totals",
    "correct",
    "drop_where",
    "exceed_counts",
    "exceed_totals",
    "keep_in",
    "kwh",
    "merged",
    "land",
    "merge_full",
    "net",
    "normalise",
    "per_unit_split",
    "pivot_mean",
    "premium",
    "rejected",
    "rollup_geo",
    "split",
    "stack",
    "standard_rates",
    "threshold_cells",
    "top_bottom",
    "weighted_avg",
    "with_total",
]
