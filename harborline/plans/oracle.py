"""The catalogue's queries stated again in plain SQL, for an independent check.

Business days are counted arithmetically and holidays are derived in SQL, so
neither shares code or method with the DataFrame side.
"""

from __future__ import annotations

FIRST_YEAR, LAST_YEAR = 1990, 2010

# Observed federal holidays. In each year: four fixed dates, and six given by
# month, ISO weekday and either the nth or the last occurrence.
HOLIDAYS = f"""
years AS (SELECT unnest(range({FIRST_YEAR}, {LAST_YEAR} + 2)) AS y),
fixed AS (
    SELECT make_date(y::INT, m, d) AS day
    FROM years, (VALUES (1, 1), (7, 4), (11, 11), (12, 25)) AS f(m, d)
),
first_days AS (
    SELECT make_date(y::INT, m, 1) AS start, wd, nth
    FROM years, (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) AS f(m, wd, nth)
),
holidays AS (
    SELECT CASE isodow(day) WHEN 6 THEN day - 1 WHEN 7 THEN day + 1 ELSE day END AS holiday FROM fixed
    UNION ALL
    SELECT start + CAST((wd - isodow(start) + 7) % 7 + 7 * (nth - 1) AS INT) FROM first_days
    UNION ALL
    SELECT make_date(y::INT, 5, 31) - CAST((isodow(make_date(y::INT, 5, 31)) + 6) % 7 AS INT) FROM years
)"""

RAW = """
raw_lines AS (
    SELECT
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
            date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS row_id,
        l_orderkey AS order_id,
        CAST(o_orderdate AS DATE) AS order_date,
        CAST(l_shipdate AS DATE) AS line_ship_date,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class'
            WHEN '3-MEDIUM' THEN 'Second Class' WHEN '4-NOT SPECIFIED' THEN 'Standard Class'
            WHEN '5-LOW' THEN 'Standard Class' END AS ship_mode,
        o_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
        'ALL' AS country, n_name AS city, n_name AS state,
        lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS postal_code, r_name AS region,
        concat(p_brand, '-', CAST(p_size AS VARCHAR)) AS product_id,
        p_type AS category, p_brand AS sub_category, p_name AS product_name,
        CAST(CAST(l_extendedprice AS DECIMAL(18, 4)) * (1 - CAST(l_discount AS DECIMAL(9, 6)))
            AS DECIMAL(18, 4)) AS sales,
        CAST(l_quantity AS INT) AS quantity,
        CAST(l_discount AS DECIMAL(9, 6)) AS discount,
        CAST(p_retailprice AS DECIMAL(18, 4)) AS unit_cost
    FROM lineitem
    LEFT JOIN orders ON o_orderkey = l_orderkey
    LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN region ON r_regionkey = n_regionkey
    LEFT JOIN part ON p_partkey = l_partkey
)"""

LINES = f"""{RAW},
lines AS (
    SELECT * EXCLUDE (unit_cost), CAST(sales - quantity * unit_cost AS DECIMAL(18, 4)) AS profit,
        max(line_ship_date) OVER (PARTITION BY order_id) AS ship_date
    FROM raw_lines WHERE line_ship_date >= order_date
)"""

CANONICAL = """row_id, order_id, order_date, ship_date, ship_mode, customer_id, customer_name, segment,
    country, city, state, postal_code, region, product_id, category, sub_category, product_name,
    sales, quantity, discount, profit"""

PLACE = "country, city, state, postal_code, region"


def weekdays(date: str) -> str:
    """Weekdays from Monday 1970-01-05 up to and including ``date``."""
    x = f"date_diff('day', DATE '1970-01-05', {date})"
    return f"(5 * ({x} // 7) + least({x} % 7 + 1, 5))"


def business_days(start: str, end: str) -> str:
    return (
        f"CAST({weekdays(end)} - {weekdays(start)} - (SELECT count(*) FROM holidays "
        f"WHERE holiday > {start} AND holiday <= {end}) AS INT)"
    )


ORDERS = f"""{LINES}, {HOLIDAYS},
grouped AS (
    SELECT order_id, order_date, ship_date, ship_mode, customer_id, {PLACE},
        CAST(sum(sales) AS DECIMAL(28, 4)) AS order_sales,
        CAST(sum(profit) AS DECIMAL(28, 4)) AS order_profit,
        count(*) AS order_line_count,
        sum(CAST(sales * discount AS DECIMAL(38, 10))) AS discount_value
    FROM lines GROUP BY ALL
),
shipped AS (SELECT DISTINCT order_date, ship_date FROM grouped),
spans AS (SELECT order_date, ship_date, {business_days("order_date", "ship_date")} AS bd FROM shipped),
order_rows AS (
    SELECT g.*, CAST(g.ship_date - g.order_date AS INT) AS calendar_days_to_ship,
        s.bd AS business_days_to_ship,
        date_trunc('month', g.order_date)::DATE AS order_month
    FROM grouped g JOIN spans s USING (order_date, ship_date)
)"""

# Allowed business days, as in the order-table settings.
SCENARIOS = """
sla(rank, scenario, ship_mode, days) AS (
    VALUES
    (0, 'base', 'Same Day', 0), (0, 'base', 'First Class', 250),
    (0, 'base', 'Second Class', 500), (0, 'base', 'Standard Class', 1000),
    (1, 'calibrated', 'Same Day', 0), (1, 'calibrated', 'First Class', 600),
    (1, 'calibrated', 'Second Class', 700), (1, 'calibrated', 'Standard Class', 800),
    (2, 'strict', 'Same Day', 0), (2, 'strict', 'First Class', 500),
    (2, 'strict', 'Second Class', 600), (2, 'strict', 'Standard Class', 700),
    (3, 'lenient', 'Same Day', 0), (3, 'lenient', 'First Class', 700),
    (3, 'lenient', 'Second Class', 800), (3, 'lenient', 'Standard Class', 900)
)"""

DETAIL = f"""{ORDERS}, {SCENARIOS},
detail AS (
    SELECT scenario, days, o.*, business_days_to_ship > days AS is_late
    FROM order_rows o JOIN sla USING (ship_mode)
)"""

CALIBRATED = f"""{DETAIL}, cal AS (SELECT * FROM detail WHERE scenario = 'calibrated')"""

MEASURES = """
    count(DISTINCT order_id) AS orders,
    count(*) FILTER (WHERE NOT is_late) AS successful_orders,
    count(*) FILTER (WHERE is_late) AS late_orders,
    CAST(sum(order_sales) AS DECIMAL(38, 4)) AS total_sales,
    CAST(coalesce(sum(order_sales) FILTER (WHERE is_late), 0) AS DECIMAL(38, 4)) AS late_order_sales,
    CAST(sum(order_profit) AS DECIMAL(38, 4)) AS total_profit,
    CAST(coalesce(sum(order_profit) FILTER (WHERE is_late), 0) AS DECIMAL(38, 4)) AS late_order_profit,
    count(*) FILTER (WHERE NOT is_late) / count(*) AS success_rate,
    count(*) FILTER (WHERE is_late) / count(*) AS late_order_rate"""

RATE = """count(DISTINCT order_id) AS orders,
    CAST(count(DISTINCT CASE WHEN is_late THEN order_id END) AS BIGINT) AS late_orders,
    count(DISTINCT CASE WHEN is_late THEN order_id END) / count(DISTINCT order_id) AS late_rate"""


def summary(dims: str) -> str:
    keys = f"scenario{dims}"
    return f"WITH {DETAIL} SELECT {keys}, {MEASURES} FROM detail GROUP BY {keys}"


def rates(dims: str, minimum: int = 0) -> str:
    names = ", ".join(d.split(" AS ")[-1] for d in dims.split(", "))
    return (
        f"WITH {CALIBRATED} SELECT {dims}, {RATE} FROM cal GROUP BY {names} "
        f"HAVING count(DISTINCT order_id) >= {minimum}"
    )


def members(column: str, minimum: int = 0) -> str:
    return (
        f"SELECT l.{column}, {RATE.replace('order_id', 'c.order_id')} FROM lines l "
        f"JOIN cal c ON c.order_id = l.order_id GROUP BY l.{column} "
        f"HAVING count(DISTINCT c.order_id) >= {minimum}"
    )


def both_ends(rated: str, column: str, high: int, low: int) -> str:
    return f"""{rated}
    SELECT *, 'high' AS "end" FROM
        (SELECT * FROM rated ORDER BY late_rate DESC, orders DESC, {column} LIMIT {high})
    UNION ALL
    SELECT *, 'low' AS "end" FROM
        (SELECT * FROM rated ORDER BY late_rate, orders DESC, {column} LIMIT {low})"""


def dimension(key: str, natural: str, attributes: str = "") -> str:
    columns = natural + (f", {attributes}" if attributes else "")
    return (
        f"WITH {LINES} SELECT row_number() OVER (ORDER BY {natural}) AS {key}, {columns} "
        f"FROM (SELECT DISTINCT {columns} FROM lines)"
    )


def late_against_on_time(dims: str) -> str:
    return f"""WITH {CALIBRATED}
    SELECT {dims}is_late, count(*) AS orders,
        round(avg(CAST(discount_value AS DOUBLE) / nullif(CAST(order_sales AS DOUBLE), 0)), 9)
            AS avg_weighted_discount,
        CAST(sum(order_profit) AS DOUBLE) / count(order_profit) AS avg_order_profit,
        round(avg(CAST(order_profit AS DOUBLE) / nullif(CAST(order_sales AS DOUBLE), 0)), 9)
            AS avg_margin
    FROM cal GROUP BY {dims}is_late"""


def correlation(x: str, y: str) -> str:
    value = f"corr({x}, {y})"
    return f"CASE WHEN isnan({value}) THEN NULL ELSE round({value}, 9) END"


CASE_MEASURES = """count(*) AS orders,
        CAST(sum(CASE WHEN is_late THEN 0 ELSE 1 END) AS BIGINT) AS successful_orders,
        CAST(sum(CASE WHEN is_late THEN 1 ELSE 0 END) AS BIGINT) AS late_orders,
        sum(order_sales) AS total_sales,
        sum(CASE WHEN is_late THEN order_sales ELSE 0 END) AS late_order_sales,
        sum(order_profit) AS total_profit,
        sum(CASE WHEN is_late THEN order_profit ELSE 0 END) AS late_order_profit,
        sum(CASE WHEN is_late THEN 0 ELSE 1 END) / count(*) AS success_rate,
        sum(CASE WHEN is_late THEN 1 ELSE 0 END) / count(*) AS late_order_rate"""


def matching() -> str:
    """Counts equal, money within 1e-7, rates within 1e-12; one-sided rows fail."""
    exact = [f"a.{c} = b.{c}" for c in ("orders", "successful_orders", "late_orders")]
    money = [
        f"abs(CAST(a.{c} AS DECIMAL(38, 10)) - CAST(b.{c} AS DECIMAL(38, 10))) < 0.0000001"
        for c in ("total_sales", "late_order_sales", "total_profit", "late_order_profit")
    ]
    rate = [f"abs(a.{c} - b.{c}) < 1e-12" for c in ("success_rate", "late_order_rate")]
    return f"coalesce({' AND '.join(exact + money + rate)}, false)"


def both_ways(
    keys: str, change: str = "SELECT *", where: str = "", other: str = "detail"
) -> str:
    """CASE sums (a) joined in full with FILTER aggregates (b)."""
    return f"""(SELECT {keys}, {CASE_MEASURES} FROM detail GROUP BY {keys}) a
        FULL JOIN ({change} FROM (SELECT {keys}, {MEASURES} FROM {other} GROUP BY {keys}) {where}) b
        USING ({keys})"""


# Differences planted on one side, as in the perturbed query.
PLANTED = {
    "overall": """SELECT * REPLACE (total_sales
        + CASE WHEN scenario = 'strict' THEN 0.0001 ELSE 0 END AS total_sales)""",
    "by_ship_mode": """SELECT * REPLACE (late_orders
        + CASE WHEN ship_mode = 'Same Day' THEN 1 ELSE 0 END AS late_orders)""",
    "by_region": "SELECT *",
    "by_month": """SELECT * REPLACE (late_order_rate
        + CASE WHEN order_month < DATE '1997-01-01' THEN 1e-13 ELSE 1e-9 END AS late_order_rate)""",
}
FAMILY_KEYS = {
    "overall": "scenario",
    "by_ship_mode": "scenario, ship_mode",
    "by_region": "scenario, region",
    "by_month": "scenario, order_month",
}


def reconciliation(perturbed: bool) -> str:
    parts = []
    for name, keys in FAMILY_KEYS.items():
        change = PLANTED[name] if perturbed else "SELECT *"
        where = "WHERE region <> 'ASIA'" if perturbed and name == "by_region" else ""
        parts.append(f"""
        SELECT '{name}' AS output, count(*) AS compared,
            count(*) FILTER (WHERE NOT {matching()}) AS failures
        FROM {both_ways(keys, change, where)}""")
    return f"WITH {DETAIL}" + " UNION ALL ".join(parts)


def duplicated_line() -> str:
    """One order of the other side holds the line with the least id twice."""
    extra = "coalesce((SELECT {0} FROM lines WHERE row_id = (SELECT min(row_id) FROM lines) AND order_id = d.order_id), 0)"
    changed = ", ".join(
        f"CAST(d.order_{m} + {extra.format(m)} AS DECIMAL(28, 4)) AS order_{m}" for m in ("sales", "profit")
    )
    parts = [f"""
        SELECT '{name}' AS output, count(*) AS compared,
            count(*) FILTER (WHERE NOT {matching()}) AS failures
        FROM {both_ways(keys, other="doubled")}""" for name, keys in FAMILY_KEYS.items()]
    doubled = f"doubled AS (SELECT d.* REPLACE ({changed}) FROM detail d)"
    return f"WITH {DETAIL}, {doubled}" + " UNION ALL ".join(parts)


def checks(tests: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f" SELECT '{name}' AS check_name, count(*) FILTER (WHERE {test}) AS violations FROM raw_lines"
        for name, test in tests.items()
    )


def row_checks() -> str:
    return checks({
        "row_count": "true",
        "row_id_null": "row_id IS NULL",
        "null_values": " OR ".join(f"{c} IS NULL" for c in NULLABLE),
        "ship_before_order": "line_ship_date < order_date",
        "negative_sales": "sales < 0",
        "quantity_not_positive": "quantity <= 0",
        "discount_outside_0_1": "discount < 0 OR discount > 1",
    })


def keyed_checks() -> str:
    modes = "'Same Day', 'First Class', 'Second Class', 'Standard Class'"
    return f"""
    SELECT 'row_id_duplicated' AS check_name, count(*) AS violations
        FROM (SELECT row_id FROM raw_lines GROUP BY row_id HAVING count(*) > 1)
    UNION ALL SELECT 'unknown_ship_modes', count(*)
        FROM (SELECT DISTINCT ship_mode FROM raw_lines WHERE ship_mode NOT IN ({modes}))
    UNION ALL SELECT 'inconsistent_orders', count(*) FROM (
        SELECT order_id FROM
            (SELECT DISTINCT order_id, order_date, line_ship_date, ship_mode, customer_id, {PLACE} FROM raw_lines)
        GROUP BY order_id HAVING count(*) > 1)"""


# Column of the raw lines -> expression; profit is null where its inputs are.
NULLABLE = {
    **{c: c for c in ("row_id", "order_id", "order_date", "line_ship_date", "ship_mode",
                      "customer_id", "customer_name", "segment", "country", "city", "state",
                      "postal_code", "region", "product_id", "category", "sub_category",
                      "product_name", "sales", "quantity", "discount", "unit_cost")},
}


def null_counts() -> str:
    names = {"line_ship_date": "ship_date", "unit_cost": "profit"}
    # Orders always get a ship mode and a country, matched or not.
    return f"WITH {RAW}" + " UNION ALL ".join(
        f" SELECT '{names.get(c, c)}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS violations "
        "FROM raw_lines"
        for c in NULLABLE
    )


HOTSPOTS = f"""WITH {CALIBRATED},
cells AS (
    SELECT l.sub_category, c.ship_mode, c.region, {RATE.replace('order_id', 'c.order_id')}
    FROM lines l JOIN cal c ON c.order_id = l.order_id
    GROUP BY l.sub_category, c.ship_mode, c.region HAVING count(DISTINCT c.order_id) >= 30
),
placed AS (
    SELECT *,
        row_number() OVER (ORDER BY late_rate DESC, orders DESC, sub_category, ship_mode, region) AS by_rate,
        row_number() OVER (ORDER BY late_orders DESC, orders DESC, sub_category, ship_mode, region) AS by_count
    FROM cells
)
SELECT sub_category, ship_mode, region, orders, late_orders, late_rate, by_count = 1 AS is_leader,
    sub_category || ' · ' || ship_mode || ' · ' || region AS label
FROM placed WHERE by_rate <= 9 OR by_count = 1"""

REGION_YEARS = f"""WITH {CALIBRATED},
groups AS (
    SELECT region, year(order_date) AS y, CAST(count(*) AS DOUBLE) AS orders,
        count(*) FILTER (WHERE is_late) / count(*) AS late_rate
    FROM cal GROUP BY ALL
)"""

def grain(lines: str = "lines") -> str:
    return f"""WITH {DETAIL}, kept AS (SELECT * FROM {lines}),
c(check_name, left_count, right_count) AS (
    SELECT 'orders_in_both_facts', (SELECT count(DISTINCT order_id) FROM kept),
        (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
            WHERE l_shipdate >= o_orderdate)
    UNION ALL SELECT 'order_id_unique', count(*), count(DISTINCT order_id) FROM order_rows
    UNION ALL SELECT 'financials_per_order', (SELECT count(DISTINCT order_id) FROM kept),
        (SELECT count(*) FROM order_rows)
    UNION ALL SELECT 'orders_without_financials',
        count(*) FILTER (WHERE order_id NOT IN (SELECT order_id FROM kept)), 0 FROM order_rows
    UNION ALL SELECT 'null_order_fields', count(*) FILTER (WHERE order_id IS NULL OR order_date IS NULL
        OR ship_date IS NULL OR ship_mode IS NULL OR customer_id IS NULL
        OR business_days_to_ship IS NULL), 0 FROM order_rows
    UNION ALL SELECT 'scenario_rows', (SELECT count(*) FROM detail),
        (SELECT count(*) FROM order_rows) * (SELECT count(DISTINCT scenario) FROM sla)
    UNION ALL SELECT 'scenario_key_duplicates', count(*) - count(DISTINCT (scenario, order_id)), 0 FROM detail
    UNION ALL SELECT 'threshold_key_duplicates', count(*) - count(DISTINCT (scenario, ship_mode)), 0 FROM sla
)
SELECT check_name, left_count, right_count, left_count = right_count AS is_equal FROM c"""

STAR = f"""WITH {LINES},
customers AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) AS customer_key
    FROM (SELECT DISTINCT customer_id FROM lines)),
locations AS (SELECT {PLACE}, row_number() OVER (ORDER BY {PLACE}) AS location_key
    FROM (SELECT DISTINCT {PLACE} FROM lines)),
products AS (SELECT product_id, product_name, category, sub_category,
    row_number() OVER (ORDER BY product_id, product_name, category, sub_category) AS product_key
    FROM (SELECT DISTINCT product_id, product_name, category, sub_category FROM lines)),
modes AS (SELECT ship_mode, row_number() OVER (ORDER BY ship_mode) AS ship_mode_key
    FROM (SELECT DISTINCT ship_mode FROM lines))
SELECT row_id, order_id,
    CAST(strftime(order_date, '%Y%m%d') AS INT) AS order_date_key,
    CAST(strftime(ship_date, '%Y%m%d') AS INT) AS ship_date_key,
    customer_key, location_key, product_key, ship_mode_key, sales, quantity, discount, profit
FROM lines JOIN customers USING (customer_id) JOIN locations USING ({PLACE})
JOIN products USING (product_id, product_name, category, sub_category) JOIN modes USING (ship_mode)"""

# Ids read from text sort as text.
TEXT_STAR = STAR.replace(
    "SELECT DISTINCT customer_id", "SELECT DISTINCT CAST(customer_id AS VARCHAR) AS customer_id"
).replace("SELECT row_id, order_id,", "SELECT row_id, CAST(lines.order_id AS VARCHAR) AS order_id,").replace(
    "JOIN customers USING (customer_id)",
    "JOIN customers c ON c.customer_id = CAST(lines.customer_id AS VARCHAR)",
)


def read_nulls() -> str:
    """Nulls per column where three columns hold texts that read as null."""
    planted = {
        "city": "region = 'ASIA'",
        "segment": "quantity < 10",
        "category": "NOT (region = 'ASIA' AND quantity < 10)",
    }
    return f"WITH {LINES}" + " UNION ALL ".join(
        f" SELECT '{c}' AS column_name, count(*) FILTER (WHERE {planted.get(c, f'{c} IS NULL')}) AS violations FROM lines"
        for c in (name.strip() for name in CANONICAL.split(","))
    )


ORACLE = {
    "canonical_lines": f"WITH {LINES} SELECT {CANONICAL} FROM lines",
    "business_days": f"""WITH {ORDERS} SELECT order_id, order_date, ship_date,
        calendar_days_to_ship, business_days_to_ship FROM order_rows""",
    "fact_orders": f"""WITH {DETAIL} SELECT order_id, order_date, ship_date, ship_mode, customer_id,
        {PLACE}, calendar_days_to_ship, business_days_to_ship, days AS sla_days,
        business_days_to_ship - days AS sla_variance, is_late FROM detail WHERE scenario = 'base'""",
    "order_financials": f"""WITH {ORDERS}
        SELECT order_id, order_sales, order_profit, order_line_count FROM grouped""",
    "shipment_lateness": f"""WITH {LINES}, {HOLIDAYS}, {SCENARIOS},
        shipments AS (SELECT DISTINCT order_id, order_date, ship_mode, line_ship_date FROM lines),
        spans AS (SELECT order_date, line_ship_date,
            {business_days("order_date", "line_ship_date")} AS business_days_to_ship
            FROM (SELECT DISTINCT order_date, line_ship_date FROM shipments))
        SELECT order_id, order_date, ship_mode, line_ship_date, business_days_to_ship,
            days AS sla_days, business_days_to_ship - days AS sla_variance,
            business_days_to_ship > days AS is_late
        FROM shipments JOIN spans USING (order_date, line_ship_date)
        JOIN sla USING (ship_mode) WHERE scenario = 'base'""",
    "scenario_orders": f"""WITH {DETAIL}
        SELECT d.scenario, d.order_id, d.order_date, d.ship_date, d.ship_mode, d.customer_id,
            {PLACE}, d.calendar_days_to_ship, d.business_days_to_ship,
            b.days AS base_sla_days, d.business_days_to_ship - b.days AS base_sla_variance,
            d.order_sales, d.order_profit, d.order_line_count, d.days AS scenario_sla_days,
            d.is_late, NOT d.is_late AS is_success,
            CAST(CASE WHEN d.is_late THEN d.order_sales ELSE 0 END AS DECIMAL(28, 4)) AS late_order_sales,
            CAST(CASE WHEN d.is_late THEN d.order_profit ELSE 0 END AS DECIMAL(28, 4)) AS late_order_profit,
            d.order_month, strftime(d.order_month, '%Y-%m') AS order_month_label
        FROM detail d JOIN sla b ON b.scenario = 'base' AND b.ship_mode = d.ship_mode""",
    "summary_overall": summary(""),
    "summary_by_ship_mode": summary(", ship_mode"),
    "summary_by_region": summary(", region"),
    "summary_by_month": summary(", order_month"),
    "summary_grouping_sets": f"""WITH {DETAIL}
        SELECT CASE WHEN grouping(ship_mode) = 0 THEN 'by_ship_mode'
                WHEN grouping(region) = 0 THEN 'by_region'
                WHEN grouping(order_month) = 0 THEN 'by_month' ELSE 'overall' END AS family,
            scenario, ship_mode, region, order_month, {MEASURES}
        FROM detail GROUP BY GROUPING SETS
            ((scenario), (scenario, ship_mode), (scenario, region), (scenario, order_month))""",
    "summary_distinct_orders": summary(", ship_mode"),
    "dq_row_checks": f"WITH {RAW} {row_checks()}",
    "dq_line_accounting": """SELECT CASE WHEN o_orderkey IS NULL THEN 'order missing'
            WHEN o_orderdate IS NULL THEN 'order date missing'
            WHEN l_shipdate IS NULL THEN 'ship date missing'
            WHEN CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) THEN 'shipped before order'
            ELSE 'accepted' END AS outcome, count(*) AS line_count
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
        UNION ALL SELECT 'all lines', count(*) FROM lineitem""",
    "dq_contract_report": f"WITH {RAW} {row_checks()} UNION ALL {keyed_checks()}",
    "dq_expected_rows": f"""WITH {RAW} {row_checks()}
        UNION ALL SELECT 'row_count_difference', abs(count(*) - 9994) FROM raw_lines""",
    "dq_order_fact_variants": f"""WITH {LINES} SELECT order_id, count(DISTINCT line_ship_date) AS variants
        FROM lines GROUP BY order_id HAVING count(DISTINCT line_ship_date) > 1""",
    "dq_null_counts": null_counts(),
    "dq_duplicate_keys": """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "dq_duplicate_row_ids": f"""WITH {RAW} SELECT count(*) AS row_count,
        count(DISTINCT row_id) AS distinct_row_ids,
        (SELECT count(*) FROM (SELECT row_id FROM raw_lines GROUP BY row_id HAVING count(*) > 1))
            AS duplicated_row_ids FROM raw_lines""",
    "dq_inconsistent_orders": f"""WITH {RAW} SELECT order_id, count(*) AS variants FROM
        (SELECT DISTINCT order_id, order_date, line_ship_date, ship_mode, customer_id, {PLACE} FROM raw_lines)
        GROUP BY order_id HAVING count(*) > 1""",
    "dq_unknown_modes": """SELECT o_orderpriority AS ship_mode, count(*) AS row_count FROM orders
        WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN
            ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') GROUP BY o_orderpriority""",
    "dq_planted_modes": """SELECT '6-NONE' AS ship_mode, count(*) AS row_count FROM orders
        WHERE o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0 HAVING count(*) > 0""",
    "dq_dimension_conflicts": f"""WITH {LINES} SELECT product_id, count(*) AS variants FROM
        (SELECT DISTINCT product_id, product_name, category, sub_category FROM lines)
        GROUP BY product_id HAVING count(*) > 1""",
    "dq_grain_reconciliation": grain(),
    "dq_grain_missing_lines": grain("lines WHERE ship_mode <> 'Same Day'"),
    "dim_date": f"""WITH {LINES},
        b AS (SELECT min(least(order_date, ship_date)) AS lo, max(greatest(order_date, ship_date)) AS hi FROM lines),
        days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
        SELECT CAST(strftime(date, '%Y%m%d') AS INT) AS date_key, date, CAST(year(date) AS INT) AS year,
            CAST(quarter(date) AS INT) AS quarter, CAST(month(date) AS INT) AS month,
            monthname(date) AS month_name, dayname(date) AS day_of_week, isodow(date) >= 6 AS is_weekend
        FROM days""",
    "dim_customer": dimension("customer_key", "customer_id", "customer_name, segment"),
    "dim_location": dimension("location_key", PLACE),
    "dim_product": dimension("product_key", "product_id, product_name, category, sub_category"),
    "dim_ship_mode": dimension("ship_mode_key", "ship_mode"),
    "fact_order_lines_star": STAR,
    "region_volume": rates("region"),
    "overall_late_rate": f"WITH {CALIBRATED} SELECT count(*) FILTER (WHERE is_late) / count(*) AS late_rate FROM cal",
    "mode_year_trend": rates("ship_mode, CAST(year(order_date) AS INT) AS order_year"),
    "subcategory_hotspots": HOTSPOTS,
    "category_rates": f"WITH {CALIBRATED} {members('category')}",
    "subcategory_rates": f"WITH {CALIBRATED} {members('sub_category', 1100)}",
    "subcategory_extremes": both_ends(
        f"WITH {CALIBRATED}, rated AS ({members('sub_category', 1100)})", "sub_category", 5, 3),
    "state_rates": rates("state", 450),
    "state_extremes": both_ends(
        f"WITH {CALIBRATED}, rated AS (SELECT state, {RATE} FROM cal GROUP BY state "
        "HAVING count(DISTINCT order_id) >= 450)", "state", 2, 2),
    "year_rates": rates("CAST(year(order_date) AS INT) AS order_year"),
    "top_months": f"""WITH {CALIBRATED} SELECT strftime(order_date, '%Y-%m') AS order_month_label, {RATE}
        FROM cal GROUP BY order_month_label HAVING count(DISTINCT order_id) >= 100
        ORDER BY late_rate DESC, orders DESC, order_month_label LIMIT 3""",
    "late_vs_ontime_financials": late_against_on_time(""),
    "late_vs_ontime_by_mode": late_against_on_time("ship_mode, "),
    "late_correlations": f"""WITH {CALIBRATED},
        ratios AS (SELECT CAST(is_late AS INT)::DOUBLE AS late, CAST(order_profit AS DOUBLE) AS profit,
            CAST(discount_value AS DOUBLE) / nullif(CAST(order_sales AS DOUBLE), 0) AS discount FROM cal)
        SELECT 'weighted_discount' AS measure, {correlation('late', 'discount')} AS correlation FROM ratios
        UNION ALL SELECT 'order_profit', {correlation('late', 'profit')} FROM ratios""",
    "region_year_correlation": f"""{REGION_YEARS} SELECT count(*) AS observations,
        {correlation('orders', 'late_rate')} AS correlation FROM groups""",
    "within_region_correlation": f"""{REGION_YEARS} SELECT region, count(*) AS observations,
        {correlation('orders', 'late_rate')} AS correlation FROM groups GROUP BY region""",
    "reconcile_clean": reconciliation(perturbed=False),
    "reconcile_exported": reconciliation(perturbed=False),
    "reconcile_perturbed": reconciliation(perturbed=True),
    "reconcile_duplicated_line": duplicated_line(),
    "reconcile_overall": f"""WITH {DETAIL}
        SELECT scenario, {matching()} AS matches,
            a.late_orders AS left_late_orders, b.late_orders AS right_late_orders,
            a.late_order_rate AS left_late_order_rate, b.late_order_rate AS right_late_order_rate
        FROM {both_ways("scenario")}""",
    "pipeline_by_month": f"""WITH {DETAIL}
        SELECT scenario, strftime(order_month, '%Y-%m') AS order_month_label, {MEASURES}
        FROM detail GROUP BY scenario, order_month_label""",
    "pipeline_star_fact": TEXT_STAR,
    "pipeline_analyze_by_region": summary(", region"),
    "csv_roundtrip": f"""WITH {LINES} SELECT * REPLACE (CAST(order_id AS VARCHAR) AS order_id,
        CAST(customer_id AS VARCHAR) AS customer_id) FROM (SELECT {CANONICAL} FROM lines)""",
    "csv_null_tokens": read_nulls(),
}
ORACLE["load_fact_orders"] = ORACLE["fact_orders"]
ORACLE["load_order_lines"] = ORACLE["canonical_lines"]
ORACLE["stored_scenario"] = ORACLE["scenario_orders"] + " WHERE d.scenario = 'strict'"
