"""Every named result by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from voltledger.plans import amenities, geography, overpayment, participation, usage
from voltledger.plans.inputs import Inputs

PRODUCTS: dict[str, Callable[[Inputs], DataFrame]] = {
    f.__name__: f
    for f in (
        usage.load_control_totals,
        usage.union_control_totals,
        usage.q6_all,
        usage.q9_all,
        usage.q9_control_totals,
        usage.utilities,
        usage.wtd_avg_consolidated,
        usage.wtd_avg_rates,
        usage.usage_green_nongreen,
        usage.edc_rates,
        overpayment.rate_comparison,
        overpayment.overpayment_by_year,
        overpayment.overpayment_by_supplier,
        overpayment.overpayment_by_supplier_year,
        overpayment.avg_premium_by_supplier_year,
        overpayment.overpayment_by_zip,
        overpayment.overpayment_by_zip_year,
        overpayment.overpayment_by_half_year,
        overpayment.premium_distribution,
        overpayment.savings_overpayment_by_year,
        geography.acs_income,
        geography.crosswalk,
        geography.overpayment_by_zcta,
        geography.overpayment_by_zcta_year,
        geography.overpayment_income_by_zcta,
        participation.participation_data,
        participation.participation_by_zip_year,
        participation.utility_totals,
        participation.participation_by_year_zcta,
        participation.participation_by_year,
        participation.participation_by_income_band,
        participation.participation_income_pivot,
        participation.participation_vs_median,
        participation.suppliers_invoices_by_year,
        participation.participation_by_utility_year,
        geography.high_participation_75,
        amenities.amenities_all,
        amenities.amenity_summary_by_year,
        amenities.amenity_summary_by_supplier,
        amenities.amenity_report_by_year,
        amenities.amenity_report_by_supplier,
        geography.minority_flags,
        participation.participation_vs_minority,
        geography.overpayment_per_kwh_zcta_year,
        geography.save_overpay_by_zcta,
        geography.low_english_zctas,
        geography.high_participation_20,
        geography.overpayment_by_demographics,
        geography.topbottom_minority,
        geography.topbottom_income,
        geography.topbottom_english,
        geography.save_topbottom_minority,
        geography.save_topbottom_income,
        geography.save_topbottom_english,
        geography.population_by_zcta,
        overpayment.contract_term_pivot,
        overpayment.contract_term_bands,
        geography.public_extract,
        geography.census_extract,
        participation.supplier_customers_by_year,
        geography.revenue_origin_by_income,
    )
}
