"""Bill extracts of the suppliers: where each keeps the bill columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voltledger.operators.conform import BillSpec, accepted, conform_bills, land, stack

# Column names of each supplier's extract, as delivered, with the
# date styles and replacement rules that belong to it.
BILL_SPECS: tuple[BillSpec, ...] = (
    BillSpec(
        "cne",
        {
            "supplier": "SupplierName",
            "charge": "MonthYear_ResCharge",
            "rate": "BilledRate",
            "zip": "ZipCode",
            "customers": "NumberOfCustomer_Rate_Zip",
            "kwh": "TotalkWh",
            "commencement": "MonthYear_CommencementDate",
            "term": "ContractTerm",
            "service_fee": "ServiceChargesFees",
            "term_fee": "ContractTerminationFee",
            "terminations": "ActualTerminationFee",
            "edc": "LDC",
        },
    ),
    BillSpec(
        "mega",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date (Month Year)",
            "term": "Contract Term (i.e. length of contract",
            "service_fee": "Service Charges or Other Fees (excluding termination fees)",
            "term_fee": "Termination fee",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
    ),
    BillSpec(
        "think",
        {
            "supplier": "SupplierName",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "ZipCode",
            "customers": "NumberOfCustomers",
            "kwh": "TotalkWh",
            "commencement": "CurrentContractCommencementDate",
            "term": "ContractTerm",
            "service_fee": "ServiceCharges",
            "term_fee": "TerminationFee",
            "terminations": "# of Termination Fees Charged",
            "edc": "EDC",
        },
        charge="name_yy",
        commencement="name_yy",
        loose=("term",),
    ),
    BillSpec(
        "wattifi",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Codes",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date (month-year)",
            "term": "Contract Term in Months (i.e. length of contract)",
            "service_fee": "Service Charges or Other Fees",
            "term_fee": "Termination Fee",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
    ),
    BillSpec(
        "xoom",
        {
            "supplier": "SUPPLIER_NAME",
            "charge": "MONTH-YEAR",
            "rate": "RATE",
            "zip": "ZIP_CODE",
            "customers": "NUMBER_OF_CUSTOMERS",
            "kwh": "TOTAL_KWH",
            "commencement": "CURRENT_CONTRACT_START_DT",
            "term": "CONTRACT_TERM",
            "service_fee": "SERVICE CHARGES OR OTHER FEES",
            "term_fee": "TERMINATION FEE",
            "terminations": "# OF TERMINATION FEES",
            "edc": "EDC",
        },
        charge="name_yy",
        commencement="name_yy",
        loose=("term",),
    ),
    BillSpec(
        "ambit",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date (month year)",
            "term": "Contract Term in Months (i.e., length of contract)",
            "service_fee": "Service Charges or Other Fees (excluding Termination Fees)",
            "term_fee": "Termination Fee",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
        loose=("term",),
    ),
    BillSpec(
        "ctge",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date (month year)",
            "term": "Contract Term in Months (i.e., length of contract)",
            "service_fee": "Service Charge or Other Fees (excluding Termination Fees)",
            "term_fee": "Termination Fees",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
        loose=("term",),
    ),
    BillSpec(
        "viridian",
        {
            "supplier": "Supplier name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date (month year)",
            "term": "Contract Term in Months (i.e., length of contract)",
            "service_fee": "Service Charge or Other Fees (excluding Termination Fees)",
            "term_fee": "Termination Fees",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
    ),
    BillSpec(
        "public",
        {
            "supplier": "Supplier name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date (month year)",
            "term": "Contract Term in Months (i.e., length of contract)",
            "service_fee": "Service Charge or Other Fees (excluding Termination Fees)",
            "term_fee": "Termination Fees",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
        commencement="serial",
        loose=("term",),
        constants={"supplier": "Public Power"},
    ),
    BillSpec(
        "er",
        {
            "supplier": "Supplier name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date (month year)",
            "term": "Contract Term in Months (i.e., length of contract)",
            "service_fee": "Service Charge or Other Fees (excluding Termination Fees)",
            "term_fee": "Termination Fees",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
        constants={"supplier": "Energy Rewards"},
    ),
    BillSpec(
        "residents",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of\r\nCustomers",
            "kwh": "Total kWh",
            "term": "Contract Term\r\nin Months",
            "service_fee": "Service Charges\r\nor Fees",
            "term_fee": "Termination Fee",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
        charge="name_yy",
        commencement="none",
    ),
    BillSpec(
        "townsquare",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date",
            "term": "Contract Term in Months",
            "service_fee": "Service Charges or Fees",
            "term_fee": "Termination Fee",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
        charge="name_yy",
        commencement="name_yy",
        zip_prefix="",
    ),
    BillSpec(
        "major",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Customer Count",
            "kwh": "Total kWh",
            "commencement": "Contract Start Year Month",
            "term": "ContractTerm",
            "service_fee": "Service Charge",
            "term_fee": "MsfAmt",
            "terminations": "ETFAmt",
            "edc": "EDC",
        },
    ),
    BillSpec(
        "nge",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date (month year)",
            "term": "Contract Term in Months",
            "service_fee": "Service Charges of Other Fees",
            "term_fee": "Termination Fee",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
        charge="m_yy",
        commencement="m_yy",
        loose=("term",),
        blanks={"term": {"NA": 1}},
    ),
    BillSpec(
        "starion",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "term": "Contract Term in Months",
            "service_fee": "Service Charges or Other Fees",
            "term_fee": "Termination Fee",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
        charge="name_yyyy",
        commencement="none",
        zip_prefix="",
        constants={"term": "1", "term_fee": "0"},
    ),
    BillSpec(
        "atlantic",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date (month-year)",
            "term": "Contract Term in Months (i.e., length of contract)",
            "service_fee": "Service Charges or Other Fees (excluding Termination Fees)",
            "term_fee": "Termination Fee",
            "terminations": "Number of termination fees charged associated with those "
            "customer contracts during that billing cycle",
            "edc": "EDC",
        },
    ),
    BillSpec(
        "direct",
        {
            "supplier": "Supplier",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "Zip Code",
            "customers": "Number of Customers",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date (month year)",
            "term": "Contract Term in Months",
            "service_fee": "Service Charges or Other Fees (excluding Termination Fees)",
            "term_fee": "Termination Fees",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
        commencement="name_yy",
        loose=("term",),
        blank_commencement_is_charge=True,
        blanks={"term": {"NULL": 1}},
    ),
    BillSpec(
        "energyplus",
        {
            "supplier": "BrandName",
            "charge": "MonthYear",
            "rate": "Rate",
            "zip": "ZipCode",
            "customers": "NumberOfCustomers",
            "kwh": "TotalkWh",
            "commencement": "CurrentContractStart",
            "term": "CurrentContractNumberOfMonths",
            "service_fee": "SvcCharges",
            "term_fee": "EarlyTerminationFee",
            "terminations": "NumberOfTerminations",
            "edc": "EDC",
        },
        zip_prefix="",
        loose=("term",),
        blank_commencement_is_charge=True,
        blanks={"term": {"Month-To-Month": 1}},
    ),
    BillSpec(
        "spark",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Billed Rate",
            "zip": "Zip Code",
            "customers": "Customer Count",
            "kwh": "Total kWh",
            "commencement": "ContractStartYearMonth",
            "term": "Contract Term",
            "service_fee": "Monthly Service Fee",
            "term_fee": "Termination Amt.",
            "terminations": "Termination Count",
            "edc": "EDC",
        },
    ),
    BillSpec(
        "nap",
        {
            "supplier": "Supplier",
            "charge": "MTH_YR",
            "rate": "RATE",
            "zip": "ZIP_CODE",
            "customers": "NBR_OF_CUSTOMERS",
            "kwh": "TOTAL_kWh",
            "commencement": "CONTRACT_START_DATE",
            "term": "TERM_MTHS",
            "service_fee": "SRV_CHRG_AND_FEES",
            "term_fee": "ETF",
            "terminations": "NBR_OF_ETFS",
            "edc": "EDC",
        },
        commencement="name_yy",
        zip_prefix="",
        loose=("term", "term_fee", "terminations"),
        blank_commencement_is_charge=True,
        blanks={"term": {"NULL": 1}, "term_fee": {"NULL": 0}, "terminations": {"NULL": 0}},
    ),
    BillSpec(
        "reliant",
        {
            "supplier": "BrandName",
            "charge": "MonthYear",
            "rate": "Rate",
            "zip": "ZipCode",
            "customers": "NumberOfCustomers",
            "kwh": "TotalkWh",
            "commencement": "CurrentContractStart",
            "term": "CurrentContractNumberOfMonths",
            "service_fee": "SvcCharges",
            "term_fee": "EarlyTerminationFee",
            "terminations": "NumberOfTerminations",
            "edc": "EDC",
        },
        loose=("term",),
        blanks={"term": {"Month-To-Month": 1}},
    ),
    BillSpec(
        "verde",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Billed Rate",
            "zip": "Zip Code",
            "customers": "Customer Count",
            "kwh": "Total kWh",
            "commencement": "ContractStartYearMonth",
            "term": "Contract Term",
            "service_fee": "Monthly Service Fee",
            "term_fee": "Termination Amt.",
            "terminations": "Termination Count",
            "edc": "EDC",
        },
    ),
    BillSpec(
        "clearview",
        {
            "supplier": "Supplier Name",
            "charge": "Month-Year",
            "rate": "Rate",
            "zip": "ZipCode",
            "customers": "Customers subscribed to Green Services",
            "kwh": "Total kWh",
            "commencement": "Current Contract Commencement Date (month year)",
            "term": "Contract Term in Months (i.e. length of contract)",
            "service_fee": "Service Charges or Other Fees (excluding Termination Fess)",
            "term_fee": "Termination Fee",
            "terminations": "# of Terminations",
            "edc": "EDC",
        },
        charge="name_yyyy",
        commencement="name_yyyy",
        loose=("term", "term_fee"),
        blanks={"term": {"NULL": 1}},
    ),
)


def load_bills(extracts: dict[str, DataFrame]) -> DataFrame:
    """Raw extracts by spec name -> bill schema plus ``load_errors``."""
    return stack(
        conform_bills(land(extracts[s.name], s), s) for s in BILL_SPECS if s.name in extracts
    )


def union_bills(extracts: dict[str, DataFrame]) -> DataFrame:
    """The accepted bills of all extracts."""
    return accepted(load_bills(extracts))
