"""DuckDB text of the domain views (same expressions as ``sources.views``).

``with_views(sql)`` prefixes a query with the CTEs it references, in
dependency order, so each oracle string runs alone on the driver's tables.
"""

from __future__ import annotations

import re


def _pad(expr: str) -> str:
    return f"(CASE WHEN regexp_full_match({expr}, '\\d{{1,6}}') THEN lpad({expr}, 6, '0') ELSE {expr} END)"


VIEWS: dict[str, str] = {
    "v_territory": """
        SELECT n.n_nationkey AS territory_id, n.n_name AS territory_name, r.r_name AS region,
               'Active' AS status
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "v_employee": f"""
        SELECT s_suppkey AS employee_id, s_name AS employee_name,
               lower(replace(s_name, '#', '.')) || '@example.com' AS email,
               CASE WHEN s_suppkey % 20 = 0 THEN 'QuanLy' ELSE 'NhanVien' END AS role,
               CASE WHEN s_suppkey % 17 = 3 THEN 'Inactive' ELSE 'Active' END AS status,
               {_pad('CAST(s_suppkey AS VARCHAR)')} AS sale_code
        FROM supplier""",
    "v_employee_territory": """
        SELECT s_suppkey AS employee_id, s_nationkey AS territory_id, true AS is_primary FROM supplier
        UNION ALL
        SELECT s_suppkey, (s_nationkey + 1) % 25, false FROM supplier""",
    "v_product": """
        SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS active_ingredient,
               p_type AS dosage_code, p_type AS dosage_form,
               CAST(p_retailprice AS DECIMAL(14,2)) AS price,
               CASE WHEN p_partkey % 23 = 0 THEN 'Inactive' ELSE 'Active' END AS status,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'SP' || CAST(p_partkey AS VARCHAR) END AS sale_code,
               lower(p_type) AS unit
        FROM part""",
    "v_customer": """
        SELECT c_custkey AS customer_id, c_name AS customer_name,
               CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'BUILDING') THEN 'PhongMachTu'
                    WHEN c_mktsegment = 'MACHINERY' THEN 'SoYTe' ELSE 'BenhVien' END AS customer_type,
               c_nationkey AS territory_id,
               CASE WHEN c_custkey % 29 = 0 THEN 'Inactive' ELSE 'Active' END AS status,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'KH' || CAST(c_custkey AS VARCHAR) END AS sale_code,
               c_mktsegment AS sale_group
        FROM customer""",
    "v_employee_customer": """
        SELECT DISTINCT l.l_suppkey AS employee_id, o.o_custkey AS customer_id
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        WHERE (l.l_suppkey + o.o_custkey) % 4 <> 0""",
    "v_account": """
        SELECT s_suppkey AS employee_id, lower(s_name) AS username FROM supplier WHERE s_suppkey % 3 <> 0""",
    "v_sheet_sales": """
        SELECT order_key, line_number, employee_id, customer_id, product_id, doc_date,
               year(doc_date) AS year, month(doc_date) AS month, strftime(doc_date, '%Y-%m') AS period,
               quantity, revenue, coefficient,
               CASE WHEN returnflag = 'R' THEN -CAST(revenue * coefficient AS DECIMAL(18,2))
                    ELSE CAST(revenue * coefficient AS DECIMAL(18,2)) END AS sales
        FROM (
          SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_number, l.l_suppkey AS employee_id,
                 o.o_custkey AS customer_id, l.l_partkey AS product_id,
                 CAST(o.o_orderdate AS DATE) AS doc_date,
                 CAST(l.l_quantity AS DECIMAL(18,3)) AS quantity,
                 CAST(l.l_extendedprice AS DECIMAL(18,2)) AS revenue,
                 CAST(CAST(1 AS DECIMAL(10,4)) - CAST(l.l_discount AS DECIMAL(10,4)) AS DECIMAL(10,4)) AS coefficient,
                 l.l_returnflag AS returnflag
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "v_sheet_sales_nullkey": """
        SELECT * REPLACE (CASE WHEN product_id % 101 = 0 THEN NULL ELSE product_id END AS product_id)
        FROM v_sheet_sales""",
    "v_sheet_detail": f"""
        SELECT s.*, r.r_name AS manager_name,
               {_pad('CAST(s.employee_id AS VARCHAR)')} AS employee_code,
               sp.s_name AS employee_name, n.n_name AS province, c.c_mktsegment AS customer_group,
               'KH' || CAST(s.customer_id AS VARCHAR) AS customer_code, c.c_name AS customer_name,
               'CT' || CAST(s.order_key AS VARCHAR) AS external_doc,
               'SP' || CAST(s.product_id AS VARCHAR) AS product_code, p.p_name AS product_name,
               lower(p.p_type) AS unit, CAST(p.p_retailprice AS DECIMAL(18,3)) AS unit_price
        FROM v_sheet_sales s
        LEFT JOIN supplier sp ON s.employee_id = sp.s_suppkey
        LEFT JOIN nation n ON sp.s_nationkey = n.n_nationkey
        LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
        LEFT JOIN customer c ON s.customer_id = c.c_custkey
        LEFT JOIN part p ON s.product_id = p.p_partkey""",
    "v_manual_sales": """
        SELECT period, customer_id, product_id, max(employee_id) AS employee_id,
               CAST(sum(abs(sales)) AS DECIMAL(14,2)) AS amount, 'Website' AS source_note
        FROM v_sheet_sales WHERE order_key % 11 = 0
        GROUP BY period, customer_id, product_id""",
    "v_prescription": """
        SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS prescription_id,
               CAST(l.l_shipdate AS DATE) AS report_date, l.l_suppkey AS employee_id,
               o.o_custkey AS customer_id, l.l_partkey AS product_id,
               CAST(l.l_quantity AS INTEGER) AS quantity,
               CAST(CAST(CAST(l.l_quantity AS INTEGER) AS DECIMAL(14,2)) * CAST(p.p_retailprice AS DECIMAL(14,2))
                    AS DECIMAL(14,2)) AS amount
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
        WHERE l.l_linestatus = 'O' AND l.l_returnflag <> 'R'""",
    "v_tender": """
        SELECT o.o_orderkey AS tender_id, o.o_custkey AS customer_id, li.product_id, li.quantity,
               CAST(o.o_totalprice AS DECIMAL(14,2)) AS bid_price,
               CASE o.o_orderpriority WHEN '1-URGENT' THEN 'DangLamHoSo' WHEN '2-HIGH' THEN 'ChoKetQua'
                    WHEN '3-MEDIUM' THEN 'TrungThau' ELSE 'TruotThau' END AS status,
               li.employee_id, CAST(o.o_orderdate AS DATE) + INTERVAL 14 DAY AS due_date_ts,
               CAST(o.o_orderdate AS DATE) AS updated_date
        FROM orders o JOIN (
          SELECT l_orderkey, min(l_suppkey) AS employee_id, min(l_partkey) AS product_id,
                 CAST(sum(l_quantity) AS BIGINT) AS quantity
          FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey""",
    "v_daily_report": """
        SELECT report_date, employee_id, 'report ' || CAST(report_date AS VARCHAR) AS summary,
               CAST(NULL AS VARCHAR) AS kpi_note
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS report_date, user_id AS employee_id FROM events)""",
    "v_kpi_target": """
        SELECT p.period, s.s_suppkey AS employee_id, s.s_nationkey AS territory_id,
               CASE WHEN s.s_suppkey % 2 = 0 THEN NULL ELSE s.s_suppkey END AS product_id,
               CAST(abs(s.s_acctbal) AS DECIMAL(14,2)) AS target_sales,
               CAST(s.s_nationkey AS INTEGER) AS target_prescriptions
        FROM supplier s CROSS JOIN (VALUES ('2001-06'), ('2001-07')) p(period)""",
}

# v_tender exposes due_date as a DATE; DuckDB's date + interval is a timestamp.
VIEWS["v_tender"] = f"""
        SELECT * EXCLUDE (due_date_ts), CAST(due_date_ts AS DATE) AS due_date
        FROM ({VIEWS['v_tender']})"""


# Tables with planted violations; those not named here are the tables themselves.
DAMAGED: dict[str, str] = {
    "territory": "SELECT * REPLACE (CASE WHEN territory_id % 9 <> 4 THEN region END AS region) FROM v_territory",
    "employee": """
        SELECT * REPLACE (
          CASE WHEN employee_id % 31 <> 7 THEN employee_name END AS employee_name,
          CASE employee_id % 13 WHEN 5 THEN 'shared@example.com' WHEN 6 THEN 'no address'
               WHEN 7 THEN repeat('x', 250) || '@example.com' ELSE email END AS email,
          CASE WHEN employee_id % 17 = 2 THEN 'Gone' ELSE status END AS status)
        FROM v_employee""",
    "employee_territory": """
        SELECT employee_id, territory_id + CASE WHEN employee_id % 9 = 4 THEN 100 ELSE 0 END AS territory_id, is_primary
        FROM v_employee_territory, range(2) r(i) WHERE i = 0 OR (employee_id % 10 = 1 AND is_primary)""",
    "product": """
        SELECT * REPLACE (CASE WHEN product_id % 10 IN (0, 1) THEN 'MA' || CAST(product_id // 2 AS VARCHAR)
                                    || CASE WHEN product_id % 2 = 0 THEN '-' ELSE '.' END || 'z'
                               ELSE sale_code END AS sale_code) FROM v_product""",
    "customer": """
        SELECT * REPLACE (
          CASE customer_id % 23 WHEN 6 THEN territory_id + 50 WHEN 7 THEN NULL ELSE territory_id END AS territory_id,
          CASE WHEN customer_id % 29 = 3 THEN 'Khac' ELSE customer_type END AS customer_type) FROM v_customer""",
    "employee_customer": """
        SELECT employee_id, customer_id FROM v_employee_customer, range(2) r(i) WHERE i = 0 OR customer_id % 19 = 3""",
    "account": """
        SELECT CASE WHEN employee_id % 5 = 1 THEN -employee_id ELSE employee_id END AS employee_id,
               CASE WHEN employee_id % 8 = 2 THEN 'shared' ELSE username END AS username FROM v_account""",
    "sheet_sales": """
        SELECT * REPLACE (CASE WHEN product_id % 37 = 5 THEN -product_id ELSE product_id END AS product_id,
                          CASE WHEN order_key % 41 <> 7 THEN employee_id END AS employee_id,
                          CASE WHEN order_key % 43 = 1 THEN 13 ELSE month END AS month) FROM v_sheet_sales""",
    # hand-entered sales are made from the damaged sheet
    "manual_sales": VIEWS["v_manual_sales"].replace("v_sheet_sales", "v_damaged_sheet_sales"),
    "prescription": """
        SELECT * REPLACE (CASE WHEN employee_id % 8 = 3 THEN 0 ELSE quantity END AS quantity,
                          CASE WHEN product_id % 21 = 4 THEN -amount ELSE amount END AS amount) FROM v_prescription""",
    "tender": "SELECT * REPLACE (CASE WHEN tender_id % 14 <> 2 THEN updated_date END AS updated_date) FROM v_tender",
    "kpi_target": """
        SELECT * REPLACE (CASE employee_id % 6 WHEN 2 THEN 99 WHEN 3 THEN NULL ELSE territory_id END AS territory_id,
                          CASE WHEN employee_id % 12 = 5 THEN period || 'x' ELSE period END AS period)
        FROM (SELECT k.* FROM v_kpi_target k, range(2) r(i) WHERE i = 0 OR employee_id % 15 = 1)""",
}
VIEWS |= {f"v_damaged_{name}": sql for name, sql in DAMAGED.items()}


_NAME = re.compile(r"\bv_[a-z_0-9]+\b")


def _deps(sql: str) -> list[str]:
    return [m for m in dict.fromkeys(_NAME.findall(sql)) if m in VIEWS or m in EXTRA]


# Extra named CTEs registered by query modules (derived frames shared by several oracles).
EXTRA: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    EXTRA[name] = sql


def with_views(sql: str) -> str:
    order: list[str] = []

    def visit(name: str, stack: tuple = ()):
        if name in order or name in stack:
            return
        body = VIEWS.get(name) or EXTRA[name]
        for dep in _deps(body):
            if dep != name:
                visit(dep, stack + (name,))
        order.append(name)

    for name in _deps(sql):
        visit(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS.get(n) or EXTRA[n]})" for n in order)
    head = re.match(r"^\s*WITH\s+", sql, re.IGNORECASE)
    if head:
        return f"WITH {ctes},\n{sql[head.end():]}"
    return f"WITH {ctes}\n{sql}"
