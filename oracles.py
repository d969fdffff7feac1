"""The registered queries in SQL over the given tables.

Written branch by branch (filtered groups joined together, unions per side), so
that they check the one-pass DataFrame forms by another route.  ``TABLES`` states
the stand-in derivation of ``standins.py``; a query takes in the tables it names.
"""

from __future__ import annotations

import re

import standins as S


def _case(index: str, values) -> str:
    whens = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values)
    )
    return f"CASE {index} {whens} END"


def _who(names) -> str:
    keys = list(S.SUPPLIERS)
    return "who IN (" + ", ".join(str(keys.index(n)) for n in names) + ")"


def _cents(c: str) -> str:
    return f"CAST(floor({c} * 100 + 0.5) AS BIGINT)"


_AMENITY = [s.name for s in S.AMENITY_SPECS]

TABLES = {
    "lines": f"""
        SELECT l_suppkey % 23 AS who,
               {_cents('l_discount')} * 9 + {_cents('l_tax')} AS mark,
               CASE WHEN {_cents('l_discount')} * 9 + {_cents('l_tax')} = 88
                         AND l_quantity = 50 AND l_linenumber <= 4
                    THEN 2014 ELSE year(l_shipdate) + 20 END AS y,
               month(l_shipdate) AS m,
               {_cents('l_extendedprice')} % 30011 AS price,
               l_orderkey % 1000 AS place,
               l_linenumber AS n,
               CAST(l_quantity AS INTEGER) AS qty,
               l_partkey % 12 + 1 AS start_month,
               l_partkey % 49 AS months,
               l_linestatus AS status,
               l_returnflag AS flag
        FROM lineitem""",
    "facts": f"""
        SELECT *,
               CASE WHEN mark = 96 THEN NULL WHEN mark = 95 THEN -0.05
                    ELSE CAST(CAST(3000 + price AS DECIMAL(11,0)) * 0.00001 AS DECIMAL(6,5))
               END AS rate,
               CASE WHEN mark = 98 THEN NULL WHEN mark = 87 THEN 0.0
                    ELSE (CASE WHEN mark = 97 THEN -1 ELSE 1 END)
                         * CAST(CAST(qty * 205 AS DECIMAL(9,0)) * 0.1 AS DECIMAL(10,1))
               END AS kwh,
               CASE WHEN mark = 89 AND qty = 50 AND n <= 2 THEN NULL
                    WHEN mark = 86 THEN 0 ELSE n END AS customers,
               {_case('who', S.SUPPLIERS.values())} AS name
        FROM lines""",
    "bills": f"""
        SELECT name AS supplier,
               CAST(y AS VARCHAR) AS year_charge,
               lpad(CAST(m AS VARCHAR), 2, '0') AS month_charge,
               CAST(rate AS DECIMAL(6,5)) AS billed_rate,
               CASE WHEN mark = 94 THEN '07' || lpad(CAST(place AS VARCHAR), 3, '0')
                    WHEN mark = 93 THEN '06' || substr(lpad(CAST(place AS VARCHAR), 3, '0'), 2, 2)
                    WHEN mark = 91 AND {_who(S.WHOLE_ZIP)} THEN NULL
                    WHEN mark IN (90, 91) THEN '0NA'
                    ELSE '06' || lpad(CAST(place AS VARCHAR), 3, '0') END AS zipcode,
               CAST(customers AS INTEGER) AS num_customers,
               CAST(kwh AS DECIMAL(10,1)) AS totalkwh,
               CASE WHEN {_who(('residents', 'starion'))} THEN NULL
                    WHEN months = 0 AND {_who(S.MARK_IS_MISSING)} THEN NULL
                    WHEN months = 0 AND {_who(S.MARK_IS_CHARGE_MONTH)} THEN CAST(y AS VARCHAR)
                    ELSE CAST(y - 1 AS VARCHAR) END AS year_commencement,
               CASE WHEN {_who(('residents', 'starion'))} THEN NULL
                    WHEN months = 0 AND {_who(S.MARK_IS_MISSING)} THEN NULL
                    WHEN months = 0 AND {_who(S.MARK_IS_CHARGE_MONTH)}
                    THEN lpad(CAST(m AS VARCHAR), 2, '0')
                    ELSE lpad(CAST(start_month AS VARCHAR), 2, '0') END AS month_commencement,
               CAST(CASE WHEN {_who(('starion',))} THEN 1
                    WHEN months = 0 AND {_who(S.MARK_IS_ONE_MONTH)} THEN 1
                    WHEN months = 0 THEN NULL
                    ELSE months END AS INTEGER) AS contractterm,
               n % 3 AS servicechargesfees,
               CASE WHEN {_who(('starion',))} THEN 0 ELSE n % 4 * 50 END AS term_fee,
               CASE WHEN n = 7 THEN 1 ELSE 0 END AS num_terminations,
               CASE WHEN status = 'O' THEN {_case('n - 1', S.EV_SPELLINGS)}
                    ELSE {_case('n - 1', S.UI_SPELLINGS)} END AS edc
        FROM facts""",
    "q6": """
        SELECT * EXCLUDE (edc),
               CASE WHEN edc IN ('UIC', 'United Illum', 'United Illuminating', 'UI') THEN 'UI'
                    WHEN edc LIKE 'Eversource%' OR edc LIKE 'Connecticut Light%'
                         OR edc IN ('CL&P', 'CLP') THEN 'EV'
                    ELSE edc END AS edc
        FROM bills
        WHERE billed_rate >= 0 AND totalkwh >= 0
          AND (zipcode IS NULL OR (zipcode LIKE '06%' AND length(zipcode) = 5))""",
    "q9": """
        SELECT name AS supplier, CAST(y AS VARCHAR) AS year_charge,
               CAST(customers AS INTEGER) AS num_customers,
               CASE WHEN n > 3 THEN '100% renewable' ELSE '50% renewable' END
                   AS specific_commitment,
               CAST(rate AS DECIMAL(6,5)) AS billed_rate, CAST(kwh AS DECIMAL(10,1)) AS totalkwh
        FROM facts
        WHERE flag = 'R' AND (kwh IS NULL OR kwh >= 0) AND (rate IS NULL OR rate >= 0)""",
    "sheet": f"""
        SELECT CAST(y AS VARCHAR) AS year, lpad(CAST(m AS VARCHAR), 2, '0') AS month,
               CAST(7 + CAST(mean % 60000 AS DECIMAL(9,0)) * 0.0001 AS DECIMAL(6,4))
                   AS eversource_rate,
               CAST(8 + CAST(mean // 7 % 60000 AS DECIMAL(9,0)) * 0.0001 AS DECIMAL(6,4))
                   AS ui_rate,
               CAST(y AS VARCHAR) || lpad(CAST(m AS VARCHAR), 2, '0') AS date_concat
        FROM (SELECT year(l_shipdate) + 20 AS y, month(l_shipdate) AS m,
                     CAST(sum({_cents('l_extendedprice')}) // count(*) AS BIGINT) AS mean
              FROM lineitem GROUP BY 1, 2)""",
    "rc": """
        SELECT b.supplier, b.year_charge, b.month_charge, b.billed_rate, b.zipcode,
               b.num_customers, b.totalkwh, b.edc, b.year_commencement, b.month_commencement,
               b.contractterm, r.standard_rate,
               b.billed_rate - r.standard_rate AS rate_difference,
               CAST((b.billed_rate - r.standard_rate) * b.totalkwh AS DECIMAL(18,7))
                   AS overpayment,
               CASE WHEN b.month_charge <= '06' THEN 1 ELSE 2 END AS year_half
        FROM q6 b
        LEFT JOIN (
            SELECT date_concat, 'EV' AS edc,
                   CAST(eversource_rate * 0.01 AS DECIMAL(8,6)) AS standard_rate FROM sheet
            UNION ALL
            SELECT date_concat, 'UI', CAST(ui_rate * 0.01 AS DECIMAL(8,6)) FROM sheet
        ) r ON b.year_charge || b.month_charge = r.date_concat AND b.edc = r.edc
        WHERE b.edc IN ('EV', 'UI')""",
    "xwalk": """
        SELECT '06' || lpad(CAST(place AS VARCHAR), 3, '0') AS zipcode,
               'Town ' || CAST(place // 2 AS VARCHAR) AS po_name, 'CT' AS state,
               'Zip Code Area' AS zip_type,
               '06' || lpad(CAST(place // 4 AS VARCHAR), 3, '0') AS zcta,
               'Zip matches ZCTA' AS zip_join_type
        FROM (SELECT DISTINCT c_custkey % 1000 AS place FROM customer)
        WHERE place % 50 <> 49""",
    "areas": f"""
        SELECT '06' || lpad(CAST(c_custkey % 1000 // 4 AS VARCHAR), 3, '0') AS zcta,
               count(*) AS households, CAST(sum({_cents('c_acctbal')}) AS BIGINT) AS balance,
               count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
               count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
        FROM customer GROUP BY 1""",
    "income": """
        SELECT 'ZCTA5 ' || zcta AS geographic_name,
               CAST(households AS INTEGER) AS count_households,
               CAST(CASE WHEN money BETWEEN 30000 AND 160000 THEN money END AS INTEGER)
                   AS median_hh_income, zcta
        FROM (SELECT *, CAST(trunc(trunc(balance / households) / 5) AS BIGINT) AS money
              FROM areas)""",
    "minority": """
        SELECT '860Z200US' || zcta AS geography, 'ZCTA5 ' || zcta AS geographic_area_name,
               CAST(CAST((households - building) * 1000 // households AS DECIMAL(9,0)) * 0.1
                    AS DECIMAL(4,1)) AS white_alone,
               CAST(round_even(CAST(building AS DOUBLE) / households, 3) AS DECIMAL(4,3))
                   AS pct_minority, zcta
        FROM areas""",
    "english": """
        SELECT zcta, CAST(households AS INTEGER) AS households,
               CAST(machinery AS INTEGER) AS limited_english_households,
               CAST(CAST(machinery * 1000 // households AS DECIMAL(9,0)) * 0.001
                    AS DECIMAL(4,3)) AS pct_low_english
        FROM areas""",
    "people": "SELECT zcta, CAST(households * 3 AS INTEGER) AS total_population FROM areas",
    "counts": """
        SELECT '06' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS zip,
               CAST(year(o_orderdate) + 20 AS VARCHAR) AS year,
               CAST(count(*) FILTER (WHERE o_orderstatus <> 'O') AS INTEGER)
                   AS num_custs_supplier,
               CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS INTEGER) AS num_custs_edc,
               CAST(count(*) AS INTEGER) AS tot_custs,
               CASE WHEN o_orderkey % 2 = 0 THEN 'Eversource' ELSE 'UI' END AS edc
        FROM orders GROUP BY 1, 2, 6""",
    "zip_counts": """
        SELECT zip, year, CAST(sum(num_custs_supplier) AS BIGINT) AS supplier_customers,
               CAST(sum(num_custs_edc) AS BIGINT) AS edc_customers,
               CAST(sum(tot_custs) AS BIGINT) AS total_customers
        FROM counts GROUP BY zip, year""",
    "part_rate": """
        SELECT z.year, i.zcta, CAST(sum(z.supplier_customers) AS BIGINT) AS supplier_customers,
               CAST(sum(z.edc_customers) AS BIGINT) AS edc_customers,
               CAST(sum(z.total_customers) AS BIGINT) AS total_customers,
               CAST(sum(z.supplier_customers) AS DOUBLE)
                   / nullif(CAST(sum(z.total_customers) AS DOUBLE), 0) AS participation_rate,
               i.median_hh_income
        FROM zip_counts z JOIN xwalk x ON z.zip = x.zipcode JOIN income i ON x.zcta = i.zcta
        GROUP BY z.year, i.zcta, i.median_hh_income""",
    "perk_lines": f"""
        SELECT {_case(f'user_id % {len(_AMENITY)}', _AMENITY)} AS extract,
               {_case(f'user_id % {len(_AMENITY)}', [S.AMENITY_SUPPLIERS[n] for n in _AMENITY])}
                   AS name,
               CASE WHEN event_id % 97 <> 0
                    THEN CAST(2016 + event_id % 7 AS VARCHAR) END AS y,
               event_type AS kind,
               CAST(CAST({_cents('value')} AS DECIMAL(12,0)) * 0.01 AS DECIMAL(12,2)) AS worth,
               1 + event_id % 20 AS used
        FROM events""",
    "perks": """
        SELECT CASE extract WHEN 'clearview' THEN 'ClearView Electric'
                    WHEN 'direct' THEN 'Direct Energy Services, LLC'
                    ELSE CASE name WHEN 'Constellation' THEN 'Constellation NewEnergy Inc'
                                   WHEN 'XOOM Energy' THEN 'XOOM'
                                   WHEN 'energyplus' THEN 'Energy Plus' ELSE name END
               END AS supplier,
               year,
               CASE WHEN extract = 'clearview' THEN substr(title, 1, 40)
                    WHEN extract = 'direct'
                    THEN substr(kind || ' credit on the first bill of a new contract term', 1, 40)
                    ELSE kind END AS amenity,
               CASE WHEN extract = 'energyplus' THEN NULL ELSE unit END AS alleged_value,
               CAST(quantity AS DECIMAL(10,2)) AS num_redeemed,
               CAST(CASE extract WHEN 'energyplus' THEN coalesce(cost, quantity)
                         WHEN 'reliant' THEN quantity
                         WHEN 'townsquare_2020' THEN coalesce(cost, 0)
                         WHEN 'townsquare_2021' THEN coalesce(cost, 0)
                         WHEN 'verde' THEN cost
                         WHEN 'xoom_donation' THEN unit
                         ELSE unit * quantity END AS DECIMAL(15,2)) AS total_value_redeemed
        FROM (
            SELECT *,
                   CASE WHEN extract = 'clearview' AND kind = 'purchase' THEN '2018'
                        WHEN extract IN ('townsquare_2020', 'townsquare_2021')
                        THEN coalesce(y, '0') ELSE y END AS year,
                   CASE kind WHEN 'view' THEN 'Hulu subscription'
                        WHEN 'click' THEN '5% of 12 month kwh expenditure'
                        WHEN 'error' THEN '$75 and ongoing free weekend charging (up to 250kwh)'
                        WHEN 'purchase' THEN '1USB Battery Bank' ELSE kind END AS title,
                   CAST(CASE WHEN extract = 'clearview' AND kind = 'error' THEN 180
                             WHEN extract = 'clearview' AND kind = 'view' THEN 5.99
                             WHEN extract = 'clearview' AND kind = 'click'
                             THEN CASE y WHEN '2019' THEN 66.80 WHEN '2020' THEN 54.00
                                         WHEN '2021' THEN 45.31 END
                             WHEN extract IN ('reliant', 'verde')
                             THEN CAST(substr(CAST(worth AS VARCHAR), 1, 3) AS DECIMAL(6,2))
                             ELSE worth END AS DECIMAL(6,2)) AS unit,
                   CASE WHEN extract = 'clearview' AND kind = 'click' AND y = '2020'
                        THEN 270 ELSE used END AS quantity,
                   CASE WHEN kind <> 'error' THEN worth * 3 END AS cost
            FROM perk_lines
            WHERE extract <> 'xoom_miles'
              AND NOT (extract = 'nap' AND kind = 'view')
              AND NOT (extract = 'direct' AND kind = 'error')
        )
        WHERE year IS NULL OR year IN ('2017', '2018', '2019', '2020', '2021')""",
    "consolidated": """
        SELECT a.year_charge AS all_year, a.billed_rate AS all_rate,
               coalesce(a.kwh_all, 0) AS all_kwh,
               g.year_charge AS green_year, g.billed_rate AS green_rate,
               coalesce(g.kwh_green, 0) AS green_kwh,
               greatest(coalesce(a.kwh_all, 0) - coalesce(g.kwh_green, 0), 0) AS nongreen_kwh,
               coalesce(a.year_charge, g.year_charge) AS year,
               coalesce(a.billed_rate, g.billed_rate) AS rate
        FROM (SELECT year_charge, billed_rate, CAST(sum(totalkwh) AS DECIMAL(20,1)) AS kwh_all
              FROM q6 GROUP BY 1, 2) a
        FULL JOIN (SELECT year_charge, billed_rate,
                          CAST(sum(totalkwh) AS DECIMAL(20,1)) AS kwh_green
                   FROM q9 GROUP BY 1, 2) g
          ON a.year_charge = g.year_charge AND a.billed_rate = g.billed_rate""",
}

_STRICT = "CASE WHEN count({c}) = count(*) THEN sum({c}) END"


def _whole(expr: str) -> str:
    return f"CAST(round_even({expr}, 0) AS BIGINT)"


def _strict(c: str) -> str:
    return _STRICT.format(c=c)


def _int(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def _dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


def _split(keys: str, extra: str = "") -> str:
    """Three grouped branches joined from the overpaying side."""
    names = [k.strip() for k in keys.split(",")]
    using = lambda t: " AND ".join(f"o.{k} IS NOT DISTINCT FROM {t}.{k}" for k in names)
    return f"""
        SELECT {', '.join('o.' + k for k in names)}, gross_overpayment, customers_paying_more,
               gross_underpayment, customers_paying_less, net_overpayment, customers_affected
               {', total_kwh, overpayment_per_kwh' if extra else ''}
        FROM (SELECT {keys}, {_whole('sum(overpayment)')} AS gross_overpayment,
                     {_int(_strict('num_customers'))} AS customers_paying_more
              FROM rc WHERE overpayment > 0 GROUP BY {keys}) o
        LEFT JOIN (SELECT {keys}, {_whole('sum(overpayment)')} AS gross_underpayment,
                          {_int(_strict('num_customers'))} AS customers_paying_less
                   FROM rc WHERE overpayment <= 0 GROUP BY {keys}) u ON {using('u')}
        LEFT JOIN (SELECT {keys}, {_whole(_strict('overpayment'))} AS net_overpayment,
                          {_int(_strict('num_customers'))} AS customers_affected {extra}
                   FROM rc GROUP BY {keys}) t ON {using('t')}"""


_SUMS = (
    "gross_overpayment",
    "customers_paying_more",
    "gross_underpayment",
    "customers_paying_less",
    "net_overpayment",
    "customers_affected",
)
_ZIP_SUMS = ", ".join(f"{_int(_strict('z.' + c))} AS {c}" for c in _SUMS)

TABLES["by_zip"] = _split("zipcode")
TABLES["by_zip_year"] = _split("year_charge, zipcode")
TABLES["by_zcta"] = f"""
    SELECT x.zcta, {_ZIP_SUMS} FROM by_zip z LEFT JOIN xwalk x ON z.zipcode = x.zipcode
    GROUP BY x.zcta"""
TABLES["by_zcta_year"] = f"""
    SELECT x.zcta, z.year_charge, {_ZIP_SUMS}
    FROM by_zip_year z LEFT JOIN xwalk x ON z.zipcode = x.zipcode
    GROUP BY x.zcta, z.year_charge"""
TABLES["per_kwh"] = f"""
    SELECT year_charge, zcta, totalkwh, net_overpayment,
           {_ratio('net_overpayment', 'totalkwh')} AS overpayment_per_kwh
    FROM (SELECT z.year_charge, x.zcta, {_whole(_strict('z.kwh'))} AS totalkwh,
                 {_whole(_strict('z.net'))} AS net_overpayment
          FROM (SELECT year_charge, zipcode, sum(totalkwh) AS kwh, sum(overpayment) AS net
                FROM rc GROUP BY 1, 2) z
          LEFT JOIN xwalk x ON z.zipcode = x.zipcode GROUP BY 1, 2)"""


def _side(where: str, sign: str, bills: str, kwh: str, total: str, per_bill: str, per_kwh: str) -> str:
    return f"""
        SELECT x.zcta, {_int('sum(num_customers)')} AS {bills}, {_dbl('sum(totalkwh)')} AS {kwh},
               {_dbl(f'{sign}sum(overpayment)')} AS {total},
               {_ratio(f'{sign}sum(overpayment)', 'sum(num_customers)')} AS {per_bill},
               {_ratio(f'{sign}sum(overpayment)', 'sum(totalkwh)')} AS {per_kwh}
        FROM rc JOIN xwalk x ON rc.zipcode = x.zipcode
        WHERE year_charge = '2021' AND {where} AND num_customers > 0 AND totalkwh > 0
        GROUP BY x.zcta"""


TABLES["savers"] = _side(
    "overpayment <= 0", "-", "bills_with_savings", "totalkwh_saving", "total_savings",
    "savings_per_bill", "savings_per_kwh",
)
TABLES["payers"] = _side(
    "overpayment > 0", "", "bills_with_overpay", "totalkwh_overpay", "total_overpayment",
    "overpayment_per_bill", "overpayment_per_kwh",
)
TABLES["both_sides"] = """
    SELECT coalesce(s.zcta, p.zcta) AS zcta, s.* EXCLUDE (zcta), p.* EXCLUDE (zcta)
    FROM savers s FULL JOIN payers p ON s.zcta = p.zcta"""


def _extremes(source: str, by: str, low: int, high: int, columns: str) -> str:
    cols = f"d.zcta, {_shown(by)}, {columns}"
    base = f"FROM {source} d JOIN {{t}} b ON d.zcta = b.zcta WHERE d.{by} IS NOT NULL"
    table = "both_sides" if "savings" in columns else "per_kwh"
    base = base.format(t=table) + ("" if table == "both_sides" else " AND b.year_charge = '2021'")
    return f"""
        SELECT * FROM (SELECT {cols} {base} ORDER BY d.{by} ASC, d.zcta LIMIT {low})
        UNION
        SELECT * FROM (SELECT {cols} {base} ORDER BY d.{by} DESC, d.zcta LIMIT {high})"""


def _shown(by: str) -> str:
    return f"d.{by}" if by == "median_hh_income" else f"{_dbl('d.' + by)} AS {by}"


_NET = "b.net_overpayment, b.overpayment_per_kwh AS overpayment_kwh"
_SAVE = (
    "b.bills_with_savings, b.savings_per_kwh, b.savings_per_bill, b.bills_with_overpay, "
    "b.overpayment_per_kwh, b.overpayment_per_bill"
)

_BILL = f"""supplier, year_charge, month_charge, {_dbl('billed_rate')} AS billed_rate, zipcode,
    num_customers, {_dbl('totalkwh')} AS totalkwh, year_commencement, month_commencement,
    contractterm, servicechargesfees, term_fee, num_terminations, edc"""

_COUNTS = ", ".join(
    f"{_int(f'sum({c})')} AS {c}" for c in ("supplier_customers", "edc_customers", "total_customers")
)
_PART = f"{_ratio('sum(supplier_customers)', 'sum(total_customers)')} AS participation_rate"

_BAND = """CASE median_hh_income // 50000 WHEN 0 THEN 'Less than $50,000'
    WHEN 1 THEN '$50,000 - $100,000' WHEN 2 THEN '$100,000 - $150,000'
    WHEN 3 THEN '$150,000 - $200,000' WHEN 4 THEN 'More than $200,000' END"""
_STUDY = "('2017', '2018', '2019', '2020', '2021')"
_BANDS = f"""SELECT year, {_BAND} AS income_group, {_COUNTS}, {_PART} FROM part_rate
    WHERE median_hh_income IS NOT NULL AND year IN {_STUDY}
    GROUP BY year, median_hh_income // 50000"""


def _criterion(title: str, table: str, test: str) -> str:
    return f"""SELECT '{title}' AS section, year_charge AS year,
        {_int('sum(net_overpayment)')} AS net_overpayment,
        {_ratio('sum(net_overpayment)', 'sum(totalkwh)')} AS overpay_kwh
        FROM per_kwh WHERE zcta IN (SELECT zcta FROM {table} WHERE {test}) GROUP BY year_charge"""


def _median(year: str, test: str, name: str) -> str:
    return f"""SELECT '{year}' AS year, '{name}' AS income_group, {_COUNTS}, {_PART}
        FROM part_rate WHERE year = '{year}' AND median_hh_income {test} 80958"""


def _share(test: str, name: str) -> str:
    return f"""SELECT '{name}' AS demo_group, {_COUNTS}, {_PART}
        FROM part_rate p JOIN minority d ON p.zcta = d.zcta
        WHERE year = '2021' AND pct_minority {test} 0.34"""


def _premium(limit: str) -> str:
    return f"""SELECT 'greater than ${limit} per kWh' AS premium,
        {_int('sum(num_customers)')} AS bills_rendered
        FROM rc WHERE rate_difference > {limit} AND year_charge = '2021'"""


def _band(title: str, test: str) -> str:
    return f"""SELECT edc, '{title}' AS band, {_dbl('sum(overpayment)')} AS net_overpayment,
        {_int('sum(num_customers)')} AS customers FROM rc WHERE {test} GROUP BY edc"""


_VALUE = {
    "year": "SELECT year AS k, sum(total_value_redeemed) AS v FROM perks GROUP BY year",
    "supplier": "SELECT supplier AS k, sum(total_value_redeemed) AS v FROM perks GROUP BY supplier",
}


def _billed(key: str) -> str:
    return f"""SELECT {key} AS k, sum(num_customers) AS n, sum(overpayment) AS o
        FROM rc GROUP BY {key}"""


TABLES["perk_years"] = f"""
    SELECT a.k AS who, a.v, b.n, b.o
    FROM ({_VALUE['year']}) a JOIN ({_billed('year_charge')}) b ON a.k = b.k"""
TABLES["perk_report_year"] = """
    SELECT who, v, n, o FROM perk_years
    UNION ALL SELECT 'Total', sum(v), sum(n), sum(o) FROM perk_years"""
TABLES["perk_report_supplier"] = f"""
    SELECT b.k AS who, a.v, b.n, b.o
    FROM ({_billed('supplier')}) b LEFT JOIN ({_VALUE['supplier']}) a ON a.k = b.k
    UNION ALL
    SELECT 'All', (SELECT sum(total_value_redeemed) FROM perks), sum(num_customers),
           sum(overpayment) FROM rc"""


def _perk_numbers(table: str, key: str, zero: bool) -> str:
    z = (lambda e: f"coalesce({e}, 0)") if zero else (lambda e: e)
    return f"""SELECT who AS {key}, {z(_dbl('v'))} AS value_redeemed, {z(_int('n'))} AS total_bills,
        {z(_dbl('o'))} AS total_overpayment, {z(_ratio('v', 'n'))} AS value_redeemed_per_bill,
        {z(_ratio('v * 100', 'o'))} AS value_pct_of_overpayment FROM {table}"""


def _perk_text(table: str, key: str, digits: int, empty: str = "NULL") -> str:
    """Masks of the report: whole dollars, cents a bill, the total's share with two decimals;
    ``empty`` stands in a cell without a value."""
    return f"""SELECT {key},
        coalesce(CASE WHEN value_redeemed < 0 THEN '-' ELSE '' END || '$'
            || format('{{:,d}}', CAST(round(abs(value_redeemed), 0) AS BIGINT)), {empty}) AS value_redeemed,
        coalesce(format('{{:,d}}', total_bills), {empty}) AS total_bills,
        coalesce(CASE WHEN total_overpayment < 0 THEN '-' ELSE '' END || '$'
            || format('{{:,d}}', CAST(round(abs(total_overpayment), 0) AS BIGINT)), {empty})
            AS total_overpayment,
        coalesce(CASE WHEN value_redeemed_per_bill < 0 THEN '-' ELSE '' END || '$'
            || format('{{:,.2f}}', round(abs(value_redeemed_per_bill), 2)), {empty})
            AS value_redeemed_per_bill,
        coalesce(CASE WHEN {key} IN ('Total', 'All')
            THEN format('{{:,.2f}}', round(value_pct_of_overpayment, 2))
            ELSE format('{{:,.{digits}f}}', round(value_pct_of_overpayment, {digits})) END || '%',
            {empty}) AS value_pct_of_overpayment
        FROM ({table})"""


_PREMIUM = f"""supplier, year_charge, {_whole(_strict('overpayment'))} AS net_overpayment,
    {_int(_strict('num_customers'))} AS bills_rendered,
    {_dbl(_strict('totalkwh'))} AS total_kwh,
    {_ratio(_strict('overpayment'), _strict('totalkwh'))} AS avg_premium"""

_TERMS = range(12, 37)


def _audit(table: str) -> str:
    return f"""SELECT supplier, count(*) AS rec_count, {_dbl('sum(billed_rate)')} AS sum_billed_rate,
        {_int('sum(num_customers)')} AS sum_num_customers,
        {_dbl('sum(totalkwh)')} AS sum_totalkwh, {_int('sum(contractterm)')} AS sum_contractterm
        FROM {table} GROUP BY supplier"""


_STARTS = [s.name for s in S.BILL_SPECS if s.commencement != "none"]
_CHARGES = [s.name for s in S.BILL_SPECS if s.charge != "none"]

QUERIES = {
    "conform_bills": f"SELECT {_BILL} FROM bills",
    "load_rejects": f"""
        SELECT 'bills' AS load, bad AS load_errors, count(*) AS count FROM (
            SELECT CASE WHEN mark = {S.SPOILT['charge'][0]} AND {_who(_CHARGES)} THEN 'year_charge'
                        WHEN mark = {S.SPOILT['commencement'][0]} AND {_who(_STARTS)} THEN 'year_commencement'
                        WHEN mark = {S.SPOILT['kwh'][0]} THEN 'totalkwh' END AS bad
            FROM lines)
        WHERE bad IS NOT NULL GROUP BY bad
        UNION ALL SELECT 'green', 'num_customers', count(*) FROM lines
        WHERE flag = 'R' AND n = 7 AND mark <> 86 HAVING count(*) > 0
        UNION ALL SELECT 'rate_sheet', 'eversource_rate', count(*) FROM (
            SELECT DISTINCT year(l_shipdate), month(l_shipdate) FROM lineitem WHERE month(l_shipdate) % 5 = 0)
        HAVING count(*) > 0""",
    "load_control_totals": _audit("bills"),
    "union_control_totals": _audit("q6"),
    "q6_all": f"SELECT {_BILL} FROM q6",
    "q9_all": f"""
        SELECT supplier, year_charge, num_customers, specific_commitment,
               {_dbl('billed_rate')} AS billed_rate, {_dbl('totalkwh')} AS totalkwh FROM q9""",
    "q9_control_totals": f"""
        SELECT year_charge, count(*) AS rec_count,
               {_int('sum(num_customers)')} AS sum_num_customers,
               {_dbl('sum(totalkwh)')} AS sum_totalkwh
        FROM q9 GROUP BY year_charge""",
    "utilities": "SELECT DISTINCT edc FROM q6",
    "wtd_avg_consolidated": f"""
        SELECT all_year, {_dbl('all_rate')} AS all_rate, {_dbl('all_kwh')} AS all_kwh, green_year,
               {_dbl('green_rate')} AS green_rate, {_dbl('green_kwh')} AS green_kwh,
               {_dbl('nongreen_kwh')} AS nongreen_kwh, year, {_dbl('rate')} AS rate
        FROM consolidated""",
    "wtd_avg_rates": "SELECT year, "
    + ", ".join(
        _ratio(f"sum(rate * CAST({w}_kwh AS DECIMAL(20,1)))", f"sum({w}_kwh)") + f" AS wtd_avg_{w}"
        for w in ("all", "nongreen", "green")
    )
    + " FROM consolidated GROUP BY year",
    "usage_green_nongreen": f"""
        SELECT year, {_dbl('sum(all_kwh)')} AS total_kwh, {_dbl('sum(green_kwh)')} AS green_kwh,
               {_dbl('sum(nongreen_kwh)')} AS nongreen_kwh,
               {_ratio('sum(green_kwh)', 'sum(all_kwh)')} AS green_percentage
        FROM consolidated GROUP BY year""",
    "edc_rates": f"""
        SELECT year, month, {_dbl('eversource_rate')} AS eversource_rate,
               {_dbl('ui_rate')} AS ui_rate, date_concat FROM sheet""",
    "rate_comparison": f"""
        SELECT supplier, year_charge, month_charge, {_dbl('billed_rate')} AS billed_rate, zipcode,
               num_customers, {_dbl('totalkwh')} AS totalkwh, edc, year_commencement,
               month_commencement, contractterm, {_dbl('standard_rate')} AS standard_rate,
               {_dbl('rate_difference')} AS rate_difference, {_dbl('overpayment')} AS overpayment,
               year_half FROM rc""",
    "overpayment_by_year": f"""
        SELECT * REPLACE ({_dbl('total_kwh')} AS total_kwh) FROM ({_split(
            'year_charge',
            f''', {_strict('totalkwh')} AS total_kwh,
            {_ratio(_strict('overpayment'), _strict('totalkwh'))} AS overpayment_per_kwh''',
        )})""",
    "overpayment_by_supplier": _split("supplier"),
    "overpayment_by_supplier_year": _split("supplier, year_charge"),
    "overpayment_after_changes": _split("supplier, year_charge"),
    "avg_premium_by_supplier_year": f"SELECT {_PREMIUM} FROM rc GROUP BY supplier, year_charge",
    "overpayment_by_zip": "SELECT * FROM by_zip",
    "overpayment_by_zip_year": "SELECT * FROM by_zip_year",
    "overpayment_by_half_year": _split("year_charge, year_half"),
    "premium_distribution": " UNION ALL ".join(
        _premium(x) for x in ("0.15", "0.10", "0.05", "0.02")
    ),
    "savings_overpayment_by_year": f"""
        SELECT u.year_charge, u.customers AS customers_paying_less,
               u.per_kwh AS avg_per_kwh_under, u.per_bill AS avg_per_bill_under,
               o.customers AS customers_paying_more, o.per_kwh AS avg_per_kwh_over,
               o.per_bill AS avg_per_bill_over
        FROM (SELECT year_charge, {_int(_strict('num_customers'))} AS customers,
                     {_ratio('sum(overpayment)', _strict('totalkwh'))} AS per_kwh,
                     {_ratio('sum(overpayment)', _strict('num_customers'))} AS per_bill
              FROM rc WHERE overpayment <= 0 GROUP BY 1) u
        LEFT JOIN (SELECT year_charge, {_int(_strict('num_customers'))} AS customers,
                     {_ratio('sum(overpayment)', _strict('totalkwh'))} AS per_kwh,
                     {_ratio('sum(overpayment)', _strict('num_customers'))} AS per_bill
              FROM rc WHERE overpayment > 0 GROUP BY 1) o USING (year_charge)""",
    "acs_income": "SELECT * FROM income",
    "crosswalk": "SELECT * FROM xwalk",
    "overpayment_by_zcta": "SELECT * FROM by_zcta",
    "overpayment_by_zcta_year": "SELECT * FROM by_zcta_year",
    "overpayment_income_by_zcta": """
        SELECT z.*, i.geographic_name, i.count_households, i.median_hh_income
        FROM by_zcta z LEFT JOIN income i ON z.zcta = i.zcta""",
    "participation_data": "SELECT * FROM counts",
    "participation_by_zip_year": "SELECT * FROM zip_counts",
    "utility_totals": f"""
        SELECT edc, {_int('sum(num_custs_supplier)')} AS supplier_customers,
               {_int('sum(num_custs_edc)')} AS edc_customers,
               {_int('sum(tot_custs)')} AS total_customers
        FROM counts WHERE year = '2021' GROUP BY edc""",
    "participation_by_year_zcta": "SELECT * FROM part_rate",
    "participation_by_year": f"SELECT * FROM part_rate WHERE year IN {_STUDY}",
    "participation_by_income_band": _BANDS,
    "participation_income_pivot": "SELECT income_group, "
    + ", ".join(
        f"avg(participation_rate) FILTER (WHERE year = '{y}') AS rate_{y}" for y in ('2017', '2018', '2019', '2020', '2021')
    )
    + f" FROM ({_BANDS}) GROUP BY income_group",
    "participation_vs_median": " UNION ALL ".join(
        _median(y, test, name)
        for y in ("2017", "2021")
        for test, name in (
            ("<", "Less than CT Median Household Income"),
            (">=", "Greater than CT Median Household Income"),
        )
    ),
    "suppliers_invoices_by_year": f"""
        SELECT a.*, p.part_rate
        FROM (SELECT year_charge, count(DISTINCT supplier) AS num_suppliers,
                     {_int('sum(num_customers)')} AS num_invoices,
                     {_ratio('sum(num_customers)', '12')} AS avg_num_hhlds
              FROM q6 GROUP BY year_charge) a
        JOIN (SELECT year, {_ratio('sum(supplier_customers)', 'sum(total_customers)')} AS part_rate
              FROM zip_counts GROUP BY year) p ON a.year_charge = p.year""",
    "participation_by_utility_year": f"""
        SELECT e.year, e.r AS eversource_part_rate, u.r AS ui_part_rate
        FROM (SELECT year, {_ratio('sum(num_custs_supplier)', 'sum(tot_custs)')} AS r
              FROM counts WHERE edc = 'Eversource' GROUP BY year) e
        JOIN (SELECT year, {_ratio('sum(num_custs_supplier)', 'sum(tot_custs)')} AS r
              FROM counts WHERE edc = 'UI' GROUP BY year) u ON e.year = u.year""",
    "high_participation_75": """
        SELECT DISTINCT p.zcta, x.po_name, i.median_hh_income, i.count_households,
               p.participation_rate
        FROM part_rate p JOIN xwalk x ON p.zcta = x.zcta JOIN income i ON p.zcta = i.zcta
        WHERE p.year = '2021' AND p.participation_rate > 0.75 AND p.zcta <> '06020'""",
    "amenities_all": f"""
        SELECT supplier, year, amenity, {_dbl('alleged_value')} AS alleged_value,
               {_dbl('num_redeemed')} AS num_redeemed,
               {_dbl('total_value_redeemed')} AS total_value_redeemed FROM perks""",
    "amenity_summary_by_year": _perk_numbers("perk_report_year", "year", False),
    "amenity_summary_by_supplier": _perk_numbers("perk_report_supplier", "supplier", True),
    "amenity_report_by_year": _perk_text(
        _perk_numbers("perk_report_year", "year", False), "year", 1
    ),
    "amenity_report_by_supplier": _perk_text(
        _perk_numbers("perk_report_supplier", "supplier", False), "supplier", 2, "'0'"
    ),
    "minority_flags": f"""
        SELECT geography, geographic_area_name, {_dbl('white_alone')} AS white_alone,
               {_dbl('pct_minority')} AS pct_minority, zcta,
               CASE WHEN pct_minority IS NULL THEN NULL WHEN pct_minority >= 0.5 THEN 1 ELSE 0 END
                   AS majority_minority,
               CASE WHEN pct_minority IS NULL THEN NULL WHEN pct_minority >= 0.34 THEN 1 ELSE 0 END
                   AS above_average_minority
        FROM minority""",
    "participation_vs_minority": _share("<", "Less than ave minority")
    + " UNION ALL "
    + _share(">=", "Greater than ave minority"),
    "overpayment_per_kwh_zcta_year": "SELECT * FROM per_kwh",
    "save_overpay_by_zcta": "SELECT * FROM both_sides",
    "low_english_zctas": f"""
        SELECT DISTINCT i.zcta, i.median_hh_income, {_dbl('m.pct_minority')} AS pct_minority,
               {_dbl('e.pct_low_english')} AS pct_low_english, x.po_name
        FROM income i JOIN minority m ON i.zcta = m.zcta JOIN english e ON i.zcta = e.zcta
        JOIN xwalk x ON i.zcta = x.zcta WHERE e.pct_low_english > 0.1""",
    "high_participation_20": f"""
        SELECT DISTINCT i.zcta, x.po_name, p.participation_rate, p.supplier_customers,
               i.median_hh_income, {_dbl('m.pct_minority')} AS pct_minority,
               {_dbl('e.pct_low_english')} AS pct_low_english
        FROM income i JOIN minority m ON i.zcta = m.zcta JOIN english e ON i.zcta = e.zcta
        JOIN xwalk x ON i.zcta = x.zcta JOIN part_rate p ON i.zcta = p.zcta
        WHERE p.participation_rate > 0.20 AND p.year = '2021' AND i.zcta <> '06020'""",
    "overpayment_by_demographics": " UNION ALL ".join(
        (
            _criterion("Median Income Less than $50,000", "income", "median_hh_income < 50000"),
            _criterion("Greater than 35% Minorities", "minority", "pct_minority > 0.35"),
            _criterion(
                "Greater than 10% Low English Proficiency", "english", "pct_low_english > 0.10"
            ),
        )
    ),
    "topbottom_minority": _extremes("minority", "pct_minority", 10, 10, _NET),
    "topbottom_income": _extremes("income", "median_hh_income", 10, 10, _NET),
    "topbottom_english": _extremes("english", "pct_low_english", 10, 10, _NET),
    "save_topbottom_minority": _extremes("minority", "pct_minority", 15, 10, _SAVE),
    "save_topbottom_income": _extremes("income", "median_hh_income", 10, 10, _SAVE),
    "save_topbottom_english": _extremes("english", "pct_low_english", 15, 10, _SAVE),
    "population_by_zcta": "SELECT * FROM people",
    "contract_term_pivot": "SELECT edc, month_commencement, "
    + ", ".join(
        f"{_dbl(f'sum(overpayment) FILTER (WHERE contractterm = {n})')} AS term_{n}" for n in _TERMS
    )
    + " FROM rc WHERE contractterm > 11 AND contractterm < 37 GROUP BY edc, month_commencement",
    "contract_term_bands": " UNION ALL ".join(
        (
            _band("under 12 or none", "(contractterm < 12 OR contractterm IS NULL)"),
            _band("12 to 36", "contractterm > 11 AND contractterm < 37"),
            _band("over 36", "contractterm > 36"),
        )
    ),
    "public_extract": f"""
        SELECT a.year_charge AS year, a.zipcode, x.zcta, x.po_name AS municipality, a.supplier,
               a.edc, {_int('sum(a.num_customers)')} AS total_customers,
               {_dbl('sum(a.overpayment)')} AS net_overpayment
        FROM rc a LEFT JOIN xwalk x ON a.zipcode = x.zipcode
        GROUP BY ALL""",
    "census_extract": f"""
        SELECT x.zipcode, x.zcta, i.count_households, p.total_population, i.median_hh_income,
               {_dbl('m.pct_minority')} AS pct_minority,
               {_dbl('e.pct_low_english')} AS pct_low_english
        FROM xwalk x JOIN income i ON x.zcta = i.zcta JOIN minority m ON x.zcta = m.zcta
        JOIN english e ON x.zcta = e.zcta JOIN people p ON x.zcta = p.zcta""",
    "supplier_customers_by_year": f"""
        SELECT 'utility counts' AS measure, year, {_dbl('sum(num_custs_supplier)')} AS customers
        FROM counts GROUP BY year
        UNION
        SELECT 'utility counts', 'avg',
               {_ratio('sum(num_custs_supplier)', 'count(DISTINCT year)')} FROM counts
        UNION
        SELECT 'bills', year_charge, {_ratio('sum(num_customers)', '12')} FROM q6
        GROUP BY year_charge
        UNION
        SELECT 'bills', 'avg', {_ratio('sum(num_customers)', '(count(DISTINCT year_charge) * 12)')}
        FROM q6""",
    "revenue_origin_by_income": """
        SELECT i.zcta, i.geographic_name, i.median_hh_income, b.gross_overpayment,
               p.participation_rate
        FROM income i JOIN by_zcta_year b ON i.zcta = b.zcta JOIN part_rate p ON i.zcta = p.zcta
        WHERE b.year_charge = '2021' AND p.year = '2021'""",
}


def _needed(body: str) -> list[str]:
    """The tables a query names, directly or through others, in a usable order."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+\(?\s*([a-z0-9_]+)", text):
            if name in TABLES and name not in found:
                visit(TABLES[name])
                found.append(name)

    visit(body)
    return found


def sql(name: str) -> str:
    body = QUERIES[name]
    ctes = ",\n".join(f"{t} AS ({TABLES[t]})" for t in _needed(body))
    return f"WITH {ctes}\n{body}" if ctes else body
