"""DuckDB oracle SQL for each registered query (same parameters as ``catalog``).

These strings are independent formulations (EXISTS / NOT EXISTS, window
functions, correlated subqueries) of what the Spark plans compute, run on
the driver's tables through the views in ``oracle.views``.
"""

from __future__ import annotations

from fieldlens.oracle.views import DAMAGED, register, with_views
from fieldlens import params as P
from fieldlens.schema import TENDER_LABELS

ORACLE: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    ORACLE[name] = with_views(sql)


def is_manager(emp) -> bool:
    return emp in P.MANAGER_IDS


def scope(alias: str, emp) -> str:
    """F5 in SQL: managers see all; reps own rows with an assigned customer."""
    if is_manager(emp):
        return "true"
    return (f"{alias}.employee_id = {emp} AND EXISTS (SELECT 1 FROM v_employee_customer sc "
            f"WHERE sc.employee_id = {emp} AND sc.customer_id = {alias}.customer_id)")


def owner(alias: str, emp) -> str:
    return "true" if is_manager(emp) else f"{alias}.employee_id = {emp}"


def cust_scope(alias: str, emp) -> str:
    if is_manager(emp):
        return "true"
    return (f"EXISTS (SELECT 1 FROM v_employee_customer ec WHERE ec.employee_id = {emp} "
            f"AND ec.customer_id = {alias}.customer_id)")


# --------------------------------------------------------------- shared CTEs
register("v_combined", """
    SELECT period, customer_id, product_id, employee_id, CAST(sum(sales) AS DECIMAL(38,2)) AS amount,
           'DATA_SALE' AS source
    FROM v_sheet_sales s
    WHERE NOT EXISTS (SELECT 1 FROM v_manual_sales m WHERE m.period = s.period
                      AND m.customer_id = s.customer_id AND m.product_id = s.product_id)
    GROUP BY period, customer_id, product_id, employee_id
    UNION ALL
    SELECT period, customer_id, product_id, employee_id, CAST(amount AS DECIMAL(38,2)), 'WEBSITE'
    FROM v_manual_sales""")

register("v_combined_b", """
    SELECT period, customer_id, product_id, employee_id, amount, source FROM (
      SELECT period, customer_id, product_id, employee_id, CAST(sum(sales) AS DECIMAL(38,2)) AS amount,
             'DATA_SALE' AS source
      FROM v_sheet_sales
      WHERE customer_id IS NOT NULL AND product_id IS NOT NULL AND employee_id IS NOT NULL
      GROUP BY period, customer_id, product_id, employee_id) s
    WHERE NOT EXISTS (SELECT 1 FROM v_manual_sales m WHERE m.period = s.period
                      AND m.customer_id = s.customer_id AND m.product_id = s.product_id)
    UNION ALL
    SELECT period, customer_id, product_id, employee_id, CAST(amount AS DECIMAL(38,2)), CAST(NULL AS VARCHAR)
    FROM v_manual_sales""")

register("v_combined_nk", """
    SELECT period, customer_id, product_id, employee_id, CAST(sum(sales) AS DECIMAL(38,2)) AS amount,
           'DATA_SALE' AS source
    FROM v_sheet_sales_nullkey s
    WHERE NOT EXISTS (SELECT 1 FROM v_manual_sales m WHERE m.period = s.period
                      AND m.customer_id = s.customer_id AND m.product_id = s.product_id)
    GROUP BY period, customer_id, product_id, employee_id
    UNION ALL
    SELECT period, customer_id, product_id, employee_id, CAST(amount AS DECIMAL(38,2)), 'WEBSITE'
    FROM v_manual_sales""")

register("v_rx", "SELECT *, strftime(report_date, '%Y-%m') AS period FROM v_prescription")


def _period_bounds(expr: str) -> tuple[str, str]:
    first = f"CAST(({expr}) || '-01' AS DATE)"
    return (f"strftime({first} - INTERVAL 3 MONTH, '%Y-%m')", f"strftime({first} + INTERVAL 1 MONTH, '%Y-%m')")


def dashboard_sql(emp, period: str | None, as_of: str) -> str:
    chosen = (f"SELECT '{period}' AS period" if period else
              f"SELECT coalesce(max(period), strftime(DATE '{as_of}', '%Y-%m')) AS period FROM avail")
    start, end = _period_bounds("c.period")
    return f"""
    , avail AS (SELECT period FROM v_combined s WHERE {scope('s', emp)}
                UNION SELECT period FROM v_rx r WHERE {scope('r', emp)}),
    chosen AS ({chosen}),
    bounds AS (SELECT c.period, {start} AS start_p, {end} AS end_p FROM chosen c),
    lost AS (
      SELECT k.customer_id FROM v_customer k CROSS JOIN bounds b
      WHERE k.customer_type = 'PhongMachTu' AND k.status = 'Active' AND {cust_scope('k', emp)}
        AND EXISTS (SELECT 1 FROM v_combined o WHERE o.customer_id = k.customer_id AND o.amount > 0
                    AND o.period < b.start_p AND {owner('o', emp)})
        AND NOT EXISTS (SELECT 1 FROM v_combined r WHERE r.customer_id = k.customer_id AND r.amount <> 0
                    AND r.period >= b.start_p AND r.period < b.end_p AND {owner('r', emp)}))
    SELECT c.period,
      (SELECT CAST(coalesce(sum(s.amount), 0) AS DECIMAL(38,2)) FROM v_combined s
        WHERE {scope('s', emp)} AND s.period = c.period) AS sales,
      (SELECT CAST(coalesce(sum(r.quantity), 0) AS INTEGER) FROM v_rx r
        WHERE {scope('r', emp)} AND r.period = c.period) AS prescription_quantity,
      (SELECT CAST(coalesce(sum(r.amount), 0) AS DECIMAL(38,2)) FROM v_rx r
        WHERE {scope('r', emp)} AND r.period = c.period) AS prescription_amount,
      (SELECT CAST(count(*) AS INTEGER) FROM v_tender t
        WHERE {scope('t', emp)} AND t.status IN ('DangLamHoSo', 'ChoKetQua')) AS open_tenders,
      (SELECT CAST(count(*) AS INTEGER) FROM lost) AS lost_sales,
      (SELECT coalesce(list(period ORDER BY period DESC), []) FROM avail) AS available_periods
    FROM chosen c"""


def _with(sql: str) -> str:
    """Queries that start with extra CTEs (``, name AS ...``) get a dummy head."""
    return "WITH _one AS (SELECT 1)" + sql


def build() -> dict[str, str]:
    q("combined_sales", "SELECT * FROM v_combined")
    q("combined_sales_export", "SELECT * FROM v_combined_b")
    q("combined_sales_nullkey", "SELECT * FROM v_combined_nk")
    q("sheet_monthly", """
      SELECT period, employee_id, employee_code, province, customer_group, customer_id, customer_code,
             product_id, product_code, max(employee_name) AS employee_name, max(manager_name) AS manager_name,
             max(customer_name) AS customer_name, max(product_name) AS product_name, max(unit) AS unit,
             CAST(sum(quantity) AS DECIMAL(38,3)) AS total_quantity,
             CAST(sum(revenue) AS DECIMAL(38,2)) AS total_revenue,
             CAST(sum(sales) AS DECIMAL(38,2)) AS total_sales, count(*) AS line_count
      FROM (SELECT *, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period2
            FROM v_sheet_detail) d
      GROUP BY period, employee_id, employee_code, province, customer_group, customer_id, customer_code,
               product_id, product_code""")
    q("dashboard", _with(dashboard_sql(P.MANAGER, None, P.AS_OF)))
    q("dashboard_period", _with(dashboard_sql(P.MANAGER, P.PERIOD, P.AS_OF)))
    q("dashboard_rep", _with(dashboard_sql(P.REP, None, P.AS_OF)))
    q("available_periods", f"""
      SELECT period FROM v_combined s WHERE {scope('s', P.REP)}
      UNION SELECT period FROM v_rx r WHERE {scope('r', P.REP)}""")
    q("latest_periods", "SELECT DISTINCT period FROM v_combined ORDER BY period DESC LIMIT 4")
    q("scope_sales", f"SELECT * FROM v_combined s WHERE {scope('s', P.REP)}")
    q("scope_customers", f"SELECT * FROM v_customer k WHERE {cust_scope('k', P.REP)}")
    q("scope_targets", f"SELECT * FROM v_kpi_target t WHERE t.employee_id = {P.REP}")

    def lost_sql(emp):
        start, end = _period_bounds("l.period")
        return f"""
        , latest AS (SELECT max(period) AS period FROM v_combined s WHERE {owner('s', emp)}),
        b AS (SELECT l.period, {start} AS start_p, {end} AS end_p FROM latest l)
        SELECT k.customer_id, k.customer_name, b.period, '{P.LOST_REASON_SQL}' AS reason
        FROM v_customer k CROSS JOIN b
        WHERE k.customer_type = 'PhongMachTu' AND k.status = 'Active' AND {cust_scope('k', emp)}
          AND b.period IS NOT NULL
          AND EXISTS (SELECT 1 FROM v_combined o WHERE o.customer_id = k.customer_id AND o.amount > 0
                      AND o.period < b.start_p AND {owner('o', emp)})
          AND NOT EXISTS (SELECT 1 FROM v_combined r WHERE r.customer_id = k.customer_id AND r.amount <> 0
                      AND r.period >= b.start_p AND r.period < b.end_p AND {owner('r', emp)})"""

    q("lost_sales", _with(lost_sql(P.MANAGER)))
    q("lost_sales_rep", _with(lost_sql(P.REP)))
    start, end = _period_bounds("l.period")
    q("lost_sales_by_rep", f"""
      WITH latest AS (SELECT employee_id, max(period) AS period FROM v_combined GROUP BY employee_id),
      b AS (SELECT l.employee_id, l.period, {start} AS start_p, {end} AS end_p FROM latest l
            WHERE l.period IS NOT NULL)
      SELECT b.employee_id, k.customer_id, k.customer_name, b.period
      FROM b JOIN v_employee_customer ec ON ec.employee_id = b.employee_id
      JOIN v_customer k ON k.customer_id = ec.customer_id
      WHERE k.customer_type = 'PhongMachTu' AND k.status = 'Active'
        AND EXISTS (SELECT 1 FROM v_combined o WHERE o.customer_id = k.customer_id AND o.amount > 0
                    AND o.period < b.start_p AND o.employee_id = b.employee_id)
        AND NOT EXISTS (SELECT 1 FROM v_combined r WHERE r.customer_id = k.customer_id AND r.amount <> 0
                    AND r.period >= b.start_p AND r.period < b.end_p AND r.employee_id = b.employee_id)""")
    q("lost_sales_latest4", """
      WITH w AS (SELECT DISTINCT period FROM v_combined_b ORDER BY period DESC LIMIT 4)
      SELECT k.customer_id, k.customer_name FROM v_customer k
      WHERE k.customer_type = 'PhongMachTu' AND (SELECT count(*) FROM w) >= 4
        AND EXISTS (SELECT 1 FROM v_combined_b s WHERE s.customer_id = k.customer_id
                    AND s.period NOT IN (SELECT period FROM w) AND s.amount > 0)
        AND coalesce((SELECT sum(s.amount) FROM v_combined_b s WHERE s.customer_id = k.customer_id
                      AND s.period IN (SELECT period FROM w)), 0) = 0""")

    def reminders_sql(emp):
        ids = ("SELECT ec.employee_id FROM v_employee_customer ec JOIN v_customer k ON k.customer_id = ec.customer_id"
               if is_manager(emp) else f"SELECT {emp}")
        return f"""
        SELECT e.employee_id, e.employee_name, e.email, DATE '{P.AS_OF_REMINDERS}' AS report_date,
               '{P.REMINDER_PREFIX_SQL}' || e.employee_name || '{P.REMINDER_MIDDLE_SQL}'
                 || '{P.AS_OF_REMINDERS}' || '.' AS message
        FROM v_employee e
        WHERE (e.status IS NULL OR e.status <> 'Inactive') AND e.role = 'NhanVien'
          AND e.employee_id IN ({ids})
          AND NOT EXISTS (SELECT 1 FROM v_daily_report d WHERE d.employee_id = e.employee_id
                          AND d.report_date = DATE '{P.AS_OF_REMINDERS}')"""

    q("reminders", reminders_sql(P.MANAGER))
    q("reminders_rep", reminders_sql(P.REP))
    q("reminders_loose", f"""
      SELECT e.employee_id, e.employee_name, e.role FROM v_employee e
      WHERE e.role IN ('NhanVien', 'MR', 'Supervisor')
        AND NOT EXISTS (SELECT 1 FROM v_daily_report d WHERE d.employee_id = e.employee_id
                        AND d.report_date = DATE '{P.AS_OF_REMINDERS}')""")
    build_lists()
    build_maintenance()
    build_quality()
    build_quality("_damaged", DAMAGED)
    from fieldlens.oracle import sheet
    sheet.build(q)
    build_imports()
    build_misc()
    build_small()
    build_export()
    return ORACLE


def _page_sql(inner: str, order: str, page: int, size: int) -> str:
    page, size = P_clamp(page, size)
    return f"""
      SELECT *, greatest(1, CAST(ceil(total / {size}) AS BIGINT)) AS pages, {page} AS page, {size} AS page_size
      FROM (SELECT *, count(*) OVER () AS total FROM ({inner}) x) y
      ORDER BY {order} LIMIT {size} OFFSET {(page - 1) * size}"""


def P_clamp(page, size):
    from fieldlens.operators.paging import clamp_page
    return clamp_page(page, size)


def _search(cols, text) -> str:
    if not text:
        return "true"
    t = str(text).strip().replace("'", "''")
    return "(" + " OR ".join(f"CAST({c} AS VARCHAR) ILIKE '%{t}%'" for c in cols) + ")"


def build_lists() -> None:
    def sales_sql(emp, period, search, page, size):
        inner = f"""
          SELECT s.period, s.customer_id, k.customer_name, s.product_id, p.product_name, s.employee_id,
                 n.employee_name, s.amount, s.source
          FROM v_combined s JOIN v_customer k ON k.customer_id = s.customer_id
          JOIN v_product p ON p.product_id = s.product_id JOIN v_employee n ON n.employee_id = s.employee_id
          WHERE {scope('s', emp)} AND {f"s.period = '{period}'" if period else 'true'}
            AND {_search(['k.customer_name', 'p.product_name'], search)}"""
        return _page_sql(inner, "period DESC, customer_name, product_name, customer_id, product_id, "
                                "employee_id, source", page, size)

    q("sales_page", sales_sql(P.MANAGER, None, None, P.PAGE, P.PAGE_SIZE))
    q("sales_search", sales_sql(P.MANAGER, P.PERIOD, P.SEARCH, 1, 20))
    q("sales_page_rep", sales_sql(P.REP, None, " ", 2, 0))

    def rx_sql(emp, period, search, page, size):
        inner = f"""
          SELECT r.prescription_id, r.report_date, r.employee_id, n.employee_name, r.customer_id, k.customer_name,
                 r.product_id, p.product_name, r.quantity, r.amount
          FROM v_rx r JOIN v_customer k ON k.customer_id = r.customer_id
          JOIN v_product p ON p.product_id = r.product_id JOIN v_employee n ON n.employee_id = r.employee_id
          WHERE {scope('r', emp)} AND {f"r.period = '{period}'" if period else 'true'}
            AND {_search(['k.customer_name', 'p.product_name', 'n.employee_name'], search)}"""
        return _page_sql(inner, "report_date DESC, prescription_id, employee_id, customer_id, product_id, "
                                "quantity, amount", page, size)

    q("prescription_page", rx_sql(P.REP, None, None, 1, 1000))
    q("prescription_search", rx_sql(P.MANAGER, P.PERIOD, P.SEARCH, 2, 10))

    def tender_sql(emp, status, search, page, size):
        known = status in ("DangLamHoSo", "ChoKetQua", "TrungThau", "TruotThau")
        inner = f"""
          SELECT t.tender_id, t.customer_id, k.customer_name, t.product_id, p.product_name, t.quantity,
                 t.bid_price, t.status, t.employee_id, n.employee_name, t.due_date, t.updated_date
          FROM v_tender t JOIN v_customer k ON k.customer_id = t.customer_id
          JOIN v_product p ON p.product_id = t.product_id JOIN v_employee n ON n.employee_id = t.employee_id
          WHERE {scope('t', emp)} AND {f"t.status = '{status}'" if known else 'true'}
            AND {_search(['t.tender_id', 'k.customer_name', 'p.product_name', 'n.employee_name'], search)}"""
        return _page_sql(inner, "updated_date DESC, tender_id", page, size)

    q("tender_page", tender_sql(P.MANAGER, P.TENDER_STATUS, "customer#00000", 2, 0))
    q("tender_search", tender_sql(P.REP, "Unknown", "1", 99, None))

    q("api_sales", """
      SELECT coalesce(source, '') AS source, period, CAST(customer_id AS VARCHAR) AS customer_id,
             CAST(product_id AS VARCHAR) AS product_id, CAST(employee_id AS VARCHAR) AS employee_id,
             coalesce(amount, CAST(0 AS DECIMAL(38,2))) AS amount
      FROM v_combined_b""")
    q("export_sales", "SELECT * FROM v_combined_b")
    q("api_tenders", """
      SELECT CAST(tender_id AS VARCHAR) AS tender_id, CAST(customer_id AS VARCHAR) AS customer_id,
             CAST(product_id AS VARCHAR) AS product_id, CAST(coalesce(quantity, 0) AS BIGINT) AS quantity,
             coalesce(bid_price, CAST(0 AS DECIMAL(14,2))) AS bid_price, status,
             CAST(employee_id AS VARCHAR) AS employee_id, coalesce(strftime(due_date, '%Y-%m-%d'), '') AS due_date
      FROM v_tender""")
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TENDER_LABELS.items())
    q("tender_labels", f"""
      SELECT tender_id, status, coalesce(CASE status {labels} END, status) AS status_label,
             replace(format('{{:,.0f}}', round(bid_price, 0)), ',', '.') || ' ₫' AS bid_price_text
      FROM v_tender""")
    terr = """(SELECT e.*, coalesce(t.ids, []) AS territory_ids FROM v_employee e LEFT JOIN
               (SELECT employee_id, list(territory_id ORDER BY territory_id) AS ids FROM v_employee_territory
                GROUP BY employee_id) t ON t.employee_id = e.employee_id)"""
    q("employee_territory_list", f"SELECT * FROM {terr}")
    q("bundle_employees", f"SELECT * FROM {terr} WHERE employee_id = {P.REP}")
    q("bundle_customers", f"SELECT * FROM v_customer k WHERE {cust_scope('k', P.REP)}")
    q("bundle_recent_reports", f"SELECT * FROM v_daily_report WHERE report_date >= DATE '{P.AS_OF}' - 31")
    q("assignment_names", """
      SELECT ec.employee_id, ec.customer_id, coalesce(e.employee_name, CAST(ec.employee_id AS VARCHAR)) AS employee_name,
             coalesce(k.customer_name, CAST(ec.customer_id AS VARCHAR)) AS customer_name
      FROM v_employee_customer ec LEFT JOIN v_employee e ON e.employee_id = ec.employee_id
      LEFT JOIN v_customer k ON k.customer_id = ec.customer_id""")
    cov = """SELECT e.employee_id, e.employee_name, e.role, e.status, a.username, a.username IS NOT NULL AS has_account
             FROM v_employee e LEFT JOIN v_account a ON a.employee_id = e.employee_id"""
    q("account_coverage", cov)
    q("profile_counts", f"""
      SELECT count(*) AS employees, count(*) FILTER (WHERE has_account) AS with_account,
             count(*) FILTER (WHERE NOT has_account) AS without_account FROM ({cov}) c""")

    def admin_sql(view, cols, text, page, size=6):
        hay = " || ' ' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)
        t = str(text).lower().replace("'", "''")
        return f"""
          WITH hits AS (SELECT {', '.join(cols)} FROM {view} WHERE contains(lower({hay}), '{t}')),
          pg AS (SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / {size}) AS BIGINT)) AS pages FROM hits),
          shown AS (SELECT total, pages, least({page}, pages) AS page FROM pg),
          ranked AS (SELECT *, row_number() OVER (ORDER BY {cols[0]}) - 1 AS rk FROM hits)
          SELECT ranked.* EXCLUDE (rk), shown.*, {size} AS page_size FROM ranked CROSS JOIN shown
          WHERE rk >= (shown.page - 1) * {size} AND rk < shown.page * {size}"""

    q("admin_search", admin_sql("v_customer", ["customer_id", "customer_name", "customer_type", "territory_id",
                                               "status"], "customer#0000001", 3))
    q("admin_search_last", admin_sql("v_employee", ["employee_id", "employee_name", "email", "role", "status"],
                                     "NHANVIEN", 1000))


BIG = 1_000_000_000
MGR_ROLES = "('QuanLy', 'Admin', 'Manager')"


def _upsert_sql(target: str, cols: list[str], changes: str, keys: list[str], order: str,
                null_safe: bool = False) -> str:
    eq = " AND ".join(f"c.{k} {'IS NOT DISTINCT FROM' if null_safe else '='} t.{k}" for k in keys)
    c = ", ".join(cols)
    return f"""
      WITH ch AS ({changes}),
      last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}) AS rn
                              FROM ch) WHERE rn = 1)
      SELECT {c} FROM {target} t WHERE NOT EXISTS (SELECT 1 FROM last c WHERE {eq})
      UNION ALL SELECT {c} FROM last"""


def build_maintenance() -> None:
    manual_cols = ["period", "customer_id", "product_id", "employee_id", "amount", "source_note"]
    q("upsert_manual", _upsert_sql("v_manual_sales", manual_cols, """
        SELECT period, customer_id, product_id, employee_id, CAST(abs(sales) AS DECIMAL(14,2)) AS amount,
               'Import website' AS source_note, order_key, line_number, sales
        FROM v_sheet_sales WHERE order_key % 13 = 0""", ["period", "customer_id", "product_id"],
        "order_key DESC, line_number DESC, sales DESC"))
    cust_cols = ["customer_id", "customer_name", "customer_type", "territory_id", "status", "sale_code", "sale_group"]
    ORACLE["upsert_written"] = ORACLE["upsert_manual"]
    q("upsert_moved", _upsert_sql("""(SELECT * FROM v_manual_sales
        QUALIFY row_number() OVER (PARTITION BY customer_id, product_id ORDER BY period DESC) = 1)""", manual_cols, """
        SELECT period, customer_id, product_id, employee_id, CAST(abs(sales) AS DECIMAL(14,2)) AS amount,
               'Import website' AS source_note, order_key, line_number, sales
        FROM v_sheet_sales WHERE order_key % 13 = 0""", ["customer_id", "product_id"],
        "period DESC, order_key DESC, line_number DESC, sales DESC"))
    q("upsert_customer", _upsert_sql("v_customer", cust_cols, f"""
        SELECT customer_id, upper(customer_name) AS customer_name, customer_type, territory_id,
               'Inactive' AS status, sale_code, sale_group, 1 AS seq FROM v_customer WHERE customer_id % 10 = 0
        UNION ALL
        SELECT customer_id + {BIG}, customer_name, customer_type, territory_id, status, CAST(NULL AS VARCHAR),
               sale_group, 1 FROM v_customer WHERE customer_id % 50 = 1""", ["customer_id"], "seq DESC"))
    tender_cols = ["tender_id", "customer_id", "product_id", "quantity", "bid_price", "status", "employee_id",
                   "due_date", "updated_date"]
    q("upsert_tender", _upsert_sql("v_tender", tender_cols, f"""
        SELECT * REPLACE ('TrungThau' AS status), 1 AS seq FROM v_tender WHERE tender_id % 9 = 0
        UNION ALL
        SELECT * REPLACE ('TruotThau' AS status, DATE '{P.AS_OF}' AS updated_date), 2 FROM v_tender
        WHERE tender_id % 9 = 0 AND tender_id % 2 = 0""", ["tender_id"], "seq DESC"))
    q("upsert_reports", _upsert_sql("v_daily_report", ["report_date", "employee_id", "summary", "kpi_note"], """
        SELECT CAST(ts AS DATE) AS report_date, user_id AS employee_id,
               event_type || ' ' || CAST(event_id AS VARCHAR) AS summary, props AS kpi_note, event_id
        FROM events WHERE event_id % 5 = 0""", ["report_date", "employee_id"], "event_id DESC"))
    q("upsert_partial", """
      WITH ch AS (SELECT employee_id, upper(employee_name) AS employee_name, CAST(NULL AS VARCHAR) AS email,
                         CASE WHEN employee_id % 10 = 0 THEN 'QuanLy' ELSE 'NhanVien' END AS role,
                         CASE WHEN employee_id % 10 = 0 THEN NULL ELSE 'NEW' || CAST(employee_id AS VARCHAR) END
                           AS sale_code
                  FROM v_employee WHERE employee_id % 5 = 0)
      SELECT e.employee_id,
             CASE WHEN c.employee_id IS NULL THEN e.employee_name ELSE c.employee_name END AS employee_name,
             CASE WHEN c.employee_id IS NULL THEN e.email ELSE c.email END AS email,
             CASE WHEN c.employee_id IS NULL THEN e.role ELSE c.role END AS role,
             e.status,
             CASE WHEN c.employee_id IS NULL THEN e.sale_code ELSE coalesce(c.sale_code, e.sale_code) END AS sale_code
      FROM v_employee e LEFT JOIN ch c ON c.employee_id = e.employee_id""")
    q("assign_insert", """
      WITH ch AS (SELECT DISTINCT l.l_suppkey AS employee_id, o.o_custkey AS customer_id
                  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderkey % 5 = 0)
      SELECT employee_id, customer_id FROM v_employee_customer
      UNION ALL
      SELECT employee_id, customer_id FROM ch c WHERE NOT EXISTS (
        SELECT 1 FROM v_employee_customer t WHERE t.employee_id = c.employee_id AND t.customer_id = c.customer_id)""")
    kpi_cols = ["period", "employee_id", "territory_id", "product_id", "target_sales", "target_prescriptions"]
    q("kpi_upsert", _upsert_sql("v_kpi_target", kpi_cols, """
        WITH base AS (
          SELECT s_suppkey AS employee_id, s_nationkey AS territory_id,
                 CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_suppkey END AS product_id,
                 CAST(abs(s_acctbal) * 2 AS DECIMAL(14,2)) AS target_sales,
                 CAST(s_nationkey + 1 AS INTEGER) AS target_prescriptions FROM supplier)
        SELECT '2001-07' AS period, *, 1 AS seq FROM base
        UNION ALL
        SELECT '2001-07', employee_id, territory_id, product_id, CAST(1 AS DECIMAL(14,2)), target_prescriptions, 2
        FROM base WHERE employee_id % 2 = 0
        UNION ALL
        SELECT '2001-08', *, 1 FROM base""", ["period", "employee_id", "product_id"], "seq DESC", null_safe=True))
    q("latest_per_key", """
      SELECT employee_id, updated_at, username, event_id FROM (
        SELECT user_id AS employee_id, ts AS updated_at, event_type AS username, event_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, event_id DESC) AS rn
        FROM events) WHERE rn = 1""")
    deact = f"""
      WITH ids AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 11 = 0
                   UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 20 = 0
                   UNION SELECT s_suppkey + {BIG} FROM supplier WHERE s_suppkey % 37 = 1),
      known AS (SELECT id FROM ids WHERE id IN (SELECT employee_id FROM v_employee) AND id <> {P.MANAGER_ID}),
      m AS (SELECT count(*) AS m FROM v_employee WHERE status = 'Active' AND role IN {MGR_ROLES}),
      bm AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rk FROM known
             WHERE id IN (SELECT employee_id FROM v_employee WHERE status = 'Active' AND role IN {MGR_ROLES})),
      last AS (SELECT id FROM bm, m WHERE m.m - bm.rk <= 1),
      refused AS (
        SELECT id AS employee_id, 'not found' AS reason FROM ids WHERE id NOT IN (SELECT employee_id FROM v_employee)
        UNION ALL SELECT id, 'acting user' FROM ids
          WHERE id = {P.MANAGER_ID} AND id IN (SELECT employee_id FROM v_employee)
        UNION ALL SELECT id, 'last active manager' FROM last)"""
    q("deactivate_refused", deact + " SELECT * FROM refused")
    q("deactivate", deact + """
      SELECT e.* REPLACE (CASE WHEN e.employee_id IN (SELECT id FROM known)
                                 AND e.employee_id NOT IN (SELECT id FROM last) THEN 'Inactive' ELSE e.status END
                          AS status)
      FROM v_employee e""")
    pairs = f"""
      WITH pairs AS (SELECT employee_id, customer_id FROM v_employee_customer WHERE (employee_id + customer_id) % 7 = 0
                     UNION SELECT employee_id, customer_id + {BIG} FROM v_employee_customer
                     WHERE (employee_id + customer_id) % 13 = 0)"""
    q("remove_assignments", pairs + """
      SELECT * FROM v_employee_customer t WHERE NOT EXISTS (
        SELECT 1 FROM pairs p WHERE p.employee_id = t.employee_id AND p.customer_id = t.customer_id)""")
    q("remove_assignments_missing", pairs + """
      SELECT * FROM pairs p WHERE NOT EXISTS (
        SELECT 1 FROM v_employee_customer t WHERE p.employee_id = t.employee_id AND p.customer_id = t.customer_id)""")
    refs = {
        "daily_report": ["employee_id"], "kpi_target": ["employee_id", "product_id"],
        "prescription": ["employee_id", "customer_id", "product_id"],
        "manual_sales": ["employee_id", "customer_id", "product_id"],
        "sheet_sales": ["employee_id", "customer_id", "product_id"],
        "tender": ["employee_id", "customer_id", "product_id"],
        "employee_customer": ["employee_id", "customer_id"], "employee_territory": ["employee_id"],
        "account": ["employee_id"], "customer": ["customer_id"], "employee": ["employee_id"],
        "product": ["product_id"],
    }
    keysets = {"employee_id": "pe", "customer_id": "pc", "product_id": "pp"}
    parts = []
    for table, cols in refs.items():
        conds = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {keysets[c]} k WHERE k.id = t.{c})" for c in cols)
        parts.append(f"SELECT '{table}' AS table_name, count(*) AS rows FROM v_{table} t WHERE {conds}")
    q("purge_cascade", """
      WITH pe AS (SELECT employee_id AS id FROM v_employee WHERE employee_id % 50 = 1),
      pc AS (SELECT customer_id AS id FROM v_customer WHERE customer_id % 97 = 5),
      pp AS (SELECT product_id AS id FROM v_product WHERE product_id % 89 = 3)
      """ + "\nUNION ALL ".join(parts))

    rx_changes = """
      SELECT 'new-' || CAST(order_key AS VARCHAR) || '-' || CAST(line_number AS VARCHAR) AS prescription_id,
             strftime(doc_date, '%Y-%m-%d') AS report_date, customer_id, product_id, quantity - 10 AS quantity
      FROM v_sheet_sales WHERE order_key % 19 = 0"""
    register("v_rx_changes", rx_changes)
    rx_cols = "prescription_id, report_date, employee_id, customer_id, product_id, quantity, amount"
    q("price_prescriptions", """
      SELECT c.product_id, c.prescription_id, c.report_date, c.customer_id, CAST(c.quantity AS INTEGER) AS quantity,
             CAST(CAST(CAST(c.quantity AS INTEGER) AS DECIMAL(14,2)) * p.price AS DECIMAL(14,2)) AS amount
      FROM v_rx_changes c JOIN v_product p ON p.product_id = c.product_id AND p.status = 'Active'""")

    def rx_append(owner):
        return f"""
          SELECT {rx_cols} FROM v_prescription
          UNION ALL
          SELECT c.prescription_id, CAST(c.report_date AS DATE), CAST({owner} AS BIGINT), c.customer_id, c.product_id,
                 CAST(c.quantity AS INTEGER),
                 CAST(CAST(CAST(c.quantity AS INTEGER) AS DECIMAL(14,2)) * p.price AS DECIMAL(14,2))
          FROM v_rx_changes c JOIN v_product p ON p.product_id = c.product_id AND p.status = 'Active'
          WHERE c.quantity > 0 AND c.quantity = floor(c.quantity)"""
    q("prescription_append", rx_append(P.REP_ID))
    q("apply_prescriptions", rx_append(P.MANAGER_ID))

    allowed = f"""(SELECT ec.customer_id FROM v_employee_customer ec JOIN v_customer k
                   ON k.customer_id = ec.customer_id AND k.status = 'Active' WHERE ec.employee_id = {P.REP_ID})"""
    register("v_sales_changes", """
      SELECT period, customer_id, product_id, CAST(sales AS DECIMAL(14,2)) AS amount, order_key, line_number, sales
      FROM v_sheet_sales WHERE order_key % 17 = 0""")
    q("gate_changes", f"""
      SELECT period, customer_id, product_id, amount, coalesce(customer_id IN {allowed}, false) AS allowed
      FROM v_sales_changes""")
    sales_flow = f"""
      WITH c AS (SELECT *, CASE WHEN NOT (amount >= 0 AND regexp_full_match(period, '\\d{{4}}-\\d{{2}}')) THEN 'invalid'
                               WHEN customer_id NOT IN {allowed} THEN 'customer outside scope'
                               WHEN product_id NOT IN (SELECT product_id FROM v_product WHERE status = 'Active')
                                 THEN 'product inactive' END AS reason FROM v_sales_changes)"""
    q("apply_sales_refused", sales_flow + """
      SELECT period, customer_id, product_id, amount, reason FROM c WHERE reason IS NOT NULL""")
    q("apply_sales", sales_flow + f"""
      , last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, customer_id, product_id
                                ORDER BY order_key DESC, line_number DESC, sales DESC) AS rn
                                FROM c WHERE reason IS NULL) WHERE rn = 1)
      SELECT period, customer_id, product_id, employee_id, amount, source_note FROM v_manual_sales t
      WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.period = t.period AND l.customer_id = t.customer_id
                        AND l.product_id = t.product_id)
      UNION ALL
      SELECT period, customer_id, product_id, CAST({P.REP_ID} AS BIGINT), amount, 'Website' FROM last""")
    tender_flow = f"""
      WITH ch AS (
        SELECT tender_id, customer_id, product_id, quantity, bid_price, 'TrungThau' AS status,
               strftime(due_date, '%Y-%m-%d') AS due_date, 1 AS seq FROM v_tender WHERE tender_id % 9 = 0
        UNION ALL
        SELECT tender_id, customer_id + 1, product_id, quantity - 100, bid_price, 'TruotThau',
               CAST(NULL AS VARCHAR), 2 FROM v_tender WHERE tender_id % 9 = 0 AND tender_id % 2 = 0
        UNION ALL
        SELECT tender_id, customer_id, product_id, quantity, bid_price, 'ChoKetQua',
               CASE WHEN tender_id % 8 = 3 THEN '2024-02-30' ELSE ' ' END, 3
        FROM v_tender WHERE tender_id % 9 = 0 AND tender_id % 4 = 3),
      c AS (SELECT ch.*, CASE
              WHEN NOT (coalesce(quantity, 0) >= 0 AND coalesce(bid_price, 0) >= 0) THEN 'invalid'
              WHEN trim(due_date) <> '' AND TRY_CAST(due_date AS DATE) IS NULL THEN 'invalid'
              WHEN customer_id NOT IN {allowed}
                OR EXISTS (SELECT 1 FROM v_tender t WHERE t.tender_id = ch.tender_id
                           AND t.customer_id NOT IN {allowed}) THEN 'customer outside scope'
              WHEN product_id NOT IN (SELECT product_id FROM v_product WHERE status = 'Active')
                THEN 'product inactive' END AS reason FROM ch)"""
    q("apply_tenders_refused", tender_flow + """
      SELECT tender_id, customer_id, product_id, quantity, bid_price, status, due_date, reason
      FROM c WHERE reason IS NOT NULL""")
    q("apply_tenders", tender_flow + f"""
      , last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY seq DESC) AS rn
                                FROM c WHERE reason IS NULL) WHERE rn = 1)
      SELECT tender_id, customer_id, product_id, quantity, bid_price, status, employee_id, due_date, updated_date
      FROM v_tender t WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.tender_id = t.tender_id)
      UNION ALL
      SELECT tender_id, customer_id, product_id, CAST(coalesce(quantity, 0) AS BIGINT),
             CAST(coalesce(bid_price, 0) AS DECIMAL(14,2)), status, CAST({P.REP_ID} AS BIGINT),
             CAST(nullif(trim(due_date), '') AS DATE), DATE '{P.AS_OF}' FROM last""")
    q("role_fold", """
      SELECT employee_id, raw_role,
             CASE WHEN trim(raw_role) IN ('QuanLy', 'Admin', 'Manager') THEN 'QuanLy' ELSE 'NhanVien' END AS role,
             CASE WHEN trim(raw_status) = 'Inactive' THEN 'Inactive' ELSE 'Active' END AS status
      FROM (SELECT employee_id,
                   CASE WHEN employee_id % 7 = 1 THEN 'Admin' WHEN employee_id % 7 = 2 THEN 'Manager'
                        WHEN employee_id % 7 = 3 THEN 'MR' ELSE role END AS raw_role,
                   CASE WHEN employee_id % 5 = 0 THEN NULL ELSE status END AS raw_status FROM v_employee)""")


def build_quality(suffix: str = "", damaged=()) -> None:
    """The three reports over the tables, or over those with planted violations (``damaged``)."""
    from fieldlens.operators.quality import CODED, FOREIGN_KEYS, LENGTHS, REQUIRED, UNIQUE_KEYS
    from fieldlens.oracle.sheet import slug

    def v(table):
        return f"v_damaged_{table}" if table in damaged else f"v_{table}"
    parts = []
    for child, col, parent, pkey in FOREIGN_KEYS:
        parts.append(f"""
          SELECT '{child}' AS table_name, '{col}' AS column_name, CAST(c.{col} AS VARCHAR) AS key_value,
                 count(*) AS rows
          FROM {v(child)} c WHERE c.{col} IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM {v(parent)} p WHERE p.{pkey} = c.{col})
          GROUP BY c.{col}""")
    q("orphans" + suffix, " UNION ALL ".join(parts))
    rules = {
        "prescription": {"quantity_positive": "NOT (quantity > 0)", "amount_not_negative": "amount < 0"},
        "manual_sales": {"amount_not_negative": "amount < 0",
                         "period_shape": "NOT regexp_matches(period, '^\\d{4}-\\d{2}$')"},
        "product": {"price_not_negative": "price < 0", "status_enum": "status NOT IN ('Active', 'Inactive')"},
        "tender": {"quantity_not_negative": "quantity < 0", "bid_not_negative": "bid_price < 0",
                   "status_enum": "status NOT IN ('DangLamHoSo', 'ChoKetQua', 'TrungThau', 'TruotThau')"},
        "employee": {"role_enum": "role NOT IN ('QuanLy', 'Admin', 'Manager', 'NhanVien', 'MR', 'Supervisor')",
                     "status_enum": "status NOT IN ('Active', 'Inactive')",
                     "email_shape": "email IS NOT NULL AND NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')",
                     "name_length": "length(employee_name) > 150"},
        "customer": {"type_enum": "customer_type NOT IN ('BenhVien', 'PhongMachTu', 'SoYTe')",
                     "status_enum": "status NOT IN ('Active', 'Inactive')"},
        "kpi_target": {"target_not_negative": "target_sales < 0",
                       "period_shape": "NOT regexp_matches(period, '^\\d{4}-\\d{2}$')"},
        "sheet_sales": {"month_range": "NOT (month BETWEEN 1 AND 12)", "year_range": "NOT (year BETWEEN 2000 AND 2100)"},
    }
    for table, cols in REQUIRED.items():
        rules.setdefault(table, {}).update({f"{c}_required": f"{c} IS NULL" for c in cols})
    for table, cols in LENGTHS.items():
        rules.setdefault(table, {}).update({f"{c}_length": f"length({c}) > {n}" for c, n in cols.items()})
    parts = []
    for table, rs in rules.items():
        for name, cond in rs.items():
            parts.append(f"SELECT '{table}' AS table_name, '{name}' AS rule, "
                         f"count(*) FILTER (WHERE coalesce({cond}, false)) AS violations FROM {v(table)}")
    q("domain_checks" + suffix, " UNION ALL ".join(parts))
    parts = []
    for table, keys, partial in UNIQUE_KEYS:
        where = ("WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in keys)) if partial else ""
        kv = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
        parts.append(f"""
          SELECT '{table}' AS table_name, '{','.join(keys)}' AS key_columns, {kv} AS key_value, count(*) AS rows
          FROM {v(table)} {where} GROUP BY {', '.join(keys)} HAVING count(*) > 1""")
    for table in CODED:
        parts.append(f"""
          SELECT '{table}', 'slug(sale_code)', {slug('sale_code')}, count(DISTINCT sale_code)
          FROM {v(table)} WHERE sale_code IS NOT NULL GROUP BY 3 HAVING count(DISTINCT sale_code) > 1""")
    q("duplicate_keys" + suffix, " UNION ALL ".join(parts))


def build_routes(typed) -> None:
    """Routed and loaded imports: a CASE in the order of the rules, EXISTS for parents and stored keys."""
    from fieldlens.plans.ingest import RESOURCE_SOURCES
    from fieldlens.schema import RESOURCES

    month = "WHEN NOT regexp_full_match(period, '\\d{4}-(0[1-9]|1[0-2])') THEN 'period is not a month'"
    date = ("WHEN {0} IS NOT NULL AND (TRY_CAST({0} AS DATE) IS NULL OR NOT regexp_full_match({0}, "
            "'\\d{{4}}-\\d{{2}}-\\d{{2}}')) THEN '{0} is not a date'").format
    low = "WHEN {0} < 0 THEN '{0} is out of range'".format
    count = "WHEN {0} < {1} OR {0} <> floor({0}) OR {0} > 2147483647 THEN '{0} is out of range'".format
    whens = {
        "employees": ["WHEN NOT regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN 'email is not valid'"],
        "products": [low("price")],
        "customers": ["WHEN customer_type NOT IN ('BenhVien', 'PhongMachTu', 'SoYTe') "
                      "THEN 'customer_type is not allowed'"],
        "prescriptions": [date("report_date"), count("quantity", 1), low("amount")],
        "sales": [month, low("amount")],
        "tenders": [date("due_date"), "WHEN status NOT IN ('DangLamHoSo', 'ChoKetQua', 'TrungThau', 'TruotThau') "
                    "THEN 'status is not allowed'", count("quantity", 0), low("bid_price")],
        "dailyReports": [date("report_date")],
        "kpiTargets": [month, low("target_sales"), count("target_prescriptions", 0)],
    }
    parts = []
    for name, spec in RESOURCES.items():
        table = f"v_{RESOURCE_SOURCES[name][0]}"
        tests = ["WHEN len(_errors) > 0 THEN _errors[1]", *whens.get(name, [])]
        for f in spec.fields:
            for parent in ("territory", "employee", "customer", "product"):
                if f.name == f"{parent}_id" and spec.keys != (f.name,):
                    tests.append(f"WHEN {f.name} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_{parent} p WHERE "
                                 f"CAST(p.{f.name} AS VARCHAR) = r.{f.name}) THEN 'unknown {f.name}'")
        same = " AND ".join(f"CAST(s.{k} AS VARCHAR) IS NOT DISTINCT FROM r.{k}" for k in spec.keys)
        known = "kept" if spec.mode == "insert_absent" else "updated"
        passed = ("'appended'" if spec.mode == "append" else
                  f"CASE WHEN EXISTS (SELECT 1 FROM {table} s WHERE {same}) THEN '{known}' ELSE 'inserted' END")
        routed = f"""SELECT * EXCLUDE (_errors), CASE WHEN error IS NOT NULL THEN 'rejected' ELSE {passed} END AS outcome
                     FROM (SELECT *, CASE {' '.join(tests)} END AS error FROM ({typed(name)}) r) r"""
        q(f"route_{name}", routed)
        parts.append(f"""SELECT '{name}' AS resource, outcome, error, count(*) AS rows FROM ({routed})
                         GROUP BY outcome, error""")
        if name in LOADED:
            key, (given, others) = spec.keys[0], LOADED[name]
            cols = [f"coalesce(CAST(r.{key} AS BIGINT), s.{key}) AS {key}"]
            cols += [f"CASE WHEN r.{key} IS NULL THEN s.{c} ELSE CAST(r.{c} AS {t}) END AS {c}" for c, t in given.items()]
            q(f"load_{name}", f"""SELECT {', '.join(cols + [f's.{c}' for c in others])} FROM {table} s
                FULL JOIN (SELECT * FROM ({routed}) WHERE error IS NULL) r ON CAST(s.{key} AS VARCHAR) = r.{key}""")
    q("import_outcomes", " UNION ALL ".join(parts))


#: Of the loaded tables: columns that the import gives, with their types, and the others.
LOADED = {
    "territories": ({"territory_name": "VARCHAR", "region": "VARCHAR", "status": "VARCHAR"}, []),
    "employees": ({"employee_name": "VARCHAR", "email": "VARCHAR", "role": "VARCHAR", "status": "VARCHAR"}, ["sale_code"]),
    "products": ({"product_name": "VARCHAR", "active_ingredient": "VARCHAR", "dosage_code": "VARCHAR",
                  "dosage_form": "VARCHAR", "price": "DECIMAL(14,2)", "status": "VARCHAR"}, ["sale_code", "unit"]),
    "customers": ({"customer_name": "VARCHAR", "customer_type": "VARCHAR", "territory_id": "BIGINT",
                   "status": "VARCHAR"}, ["sale_code", "sale_group"]),
    "tenders": ({"employee_id": "BIGINT", "customer_id": "BIGINT", "product_id": "BIGINT", "quantity": "BIGINT",
                 "bid_price": "DECIMAL(14,2)", "status": "VARCHAR", "due_date": "DATE"}, ["updated_date"]),
}


def build_imports() -> None:
    from fieldlens.functions.numbers import LITERAL
    from fieldlens.plans.ingest import ABSENT_FIELDS, DAMAGE, FIELD_SOURCE, NEW_KEY, RESOURCE_SOURCES
    from fieldlens.schema import MANAGER_ROLES, RESOURCES, TRUE_WORDS

    def raw_sql(resource, damaged=False):
        table, key_expr = RESOURCE_SOURCES[resource]
        cols = [f"({key_expr}) AS source_row"] if damaged else []
        for f in RESOURCES[resource].fields:
            name = FIELD_SOURCE.get(f.name, f.name)
            value = ("CAST(NULL AS VARCHAR)" if (resource, f.name) in ABSENT_FIELDS
                     else f"CAST({name} AS VARCHAR)")
            if f.kind == "bool":
                value = f"CASE WHEN {name} THEN ' x ' ELSE 'no' END"
            if damaged and RESOURCES[resource].keys == (f.name,):
                value = f"(CASE WHEN ({key_expr}) % 13 = {NEW_KEY[0]} THEN '{NEW_KEY[1]}' || {value} ELSE {value} END)"
            elif damaged:
                for rest, text in DAMAGE.get(f.name, ()):
                    value = f"(CASE WHEN ({key_expr}) % 13 = {rest} THEN '{text}' ELSE {value} END)"
            cols.append(f"CASE WHEN ({key_expr}) % 3 = 0 OR ({key_expr}) % 17 = 0 THEN '  ' ELSE {value} END "
                        f"AS \"{f.aliases[0]}\"")
            if len(f.aliases) > 1:
                cols.append(f"CASE WHEN ({key_expr}) % 17 = 0 THEN '' ELSE ' ' || {value} || ' ' END "
                            f"AS \"{f.aliases[1]}\"")
        return f"SELECT {', '.join(cols)} FROM v_{table}"

    def pick(aliases):
        parts = [f"nullif(trim(\"{a}\"), '')" for a in aliases]
        return f"coalesce({', '.join(parts)})" if len(parts) > 1 else parts[0]

    def typed(resource, damaged=False):
        exprs, checks = ["source_row"] if damaged else [], []
        for f in RESOURCES[resource].fields:
            v = pick(f.aliases)
            if f.kind == "text":
                d = "" if f.default is None else str(f.default)
                e = f"coalesce({v}, '{d}')"
            elif f.kind in ("opt_text",):
                e = v
            elif f.kind == "number":
                e = (f"CASE WHEN {v} IS NULL OR trim({v}) = '' THEN CAST({f.default or 0} AS DECIMAL(38,10)) "
                     f"WHEN regexp_full_match(trim({v}), '{LITERAL[1:-1]}') THEN TRY_CAST(trim({v}) AS DECIMAL(38,10)) END")
                checks.append(f"CASE WHEN ({e}) IS NULL THEN '{f.aliases[0]} is not a number' END")
            elif f.kind == "bool":
                words = ", ".join(f"'{w}'" for w in TRUE_WORDS)
                e = f"coalesce(lower(trim({v})) IN ({words}), false)"
            elif f.kind == "role":
                roles = ", ".join(f"'{r}'" for r in MANAGER_ROLES)
                e = f"CASE WHEN trim({v}) IN ({roles}) THEN 'QuanLy' ELSE 'NhanVien' END"
            elif f.kind == "status":
                e = f"CASE WHEN trim({v}) = 'Inactive' THEN 'Inactive' ELSE 'Active' END"
            elif f.kind == "date":
                e = f"coalesce({v}, '')"
            if f.required:
                checks.append(f"CASE WHEN {v} IS NULL THEN 'missing {' or '.join(f.aliases)}' END")
            exprs.append(f"{e} AS {f.name}")
        errs = f"list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL)"
        return f"SELECT {', '.join(exprs)}, {errs} AS _errors FROM ({raw_sql(resource, damaged)})"

    parts = []
    for resource in RESOURCES:
        t = typed(resource)
        q(f"import_{resource}", f"SELECT * EXCLUDE (_errors) FROM ({t}) WHERE len(_errors) = 0")
        parts.append(f"""SELECT '{resource}' AS resource, _errors[1] AS error, count(*) AS rows
                         FROM ({t}) WHERE len(_errors) > 0 GROUP BY _errors[1]""")
    q("import_rejects", " UNION ALL ".join(parts))
    build_routes(lambda resource: typed(resource, damaged=True))
    q("alias_pick", f"""SELECT {pick(['id_khach_hang', 'id'])} AS customer_id,
                          coalesce({pick(['ten_khach_hang', 'name'])}, 'unknown') AS customer_name
                        FROM ({raw_sql('customers')})""")
    v = pick(["gia_ke_don", "prescriptionPrice"])
    q("strict_number", f"""SELECT {pick(['id_san_pham', 'id'])} AS product_id,
        CASE WHEN {v} IS NULL OR trim({v}) = '' THEN CAST(0 AS DECIMAL(38,10))
             WHEN regexp_full_match(trim({v}), '{LITERAL[1:-1]}') THEN TRY_CAST(trim({v}) AS DECIMAL(38,10)) END AS price
        FROM ({raw_sql('products')})""")
    words = ", ".join(f"'{w}'" for w in TRUE_WORDS)
    q("parse_bool", f"""SELECT id_nhan_vien AS raw_employee, is_primary AS raw_primary,
        coalesce(lower(trim({pick(['is_primary', 'isPrimary'])})) IN ({words}), false) AS is_primary
        FROM ({raw_sql('employeeTerritories')})""")


def build_misc() -> None:
    q("reconcile_detail", f"""
      WITH s AS (SELECT * FROM v_combined_nk WHERE period = '{P.PERIOD}'),
      d AS (SELECT CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS dashboard_sales, count(*) AS dashboard_rows
            FROM s),
      l AS (SELECT CAST(coalesce(sum(s.amount), 0) AS DECIMAL(38,2)) AS detail_sales, count(*) AS detail_rows
            FROM s JOIN v_customer k ON k.customer_id = s.customer_id JOIN v_product p ON p.product_id = s.product_id
            JOIN v_employee e ON e.employee_id = s.employee_id)
      SELECT '{P.PERIOD}' AS period, dashboard_sales, detail_sales, dashboard_rows, detail_rows,
             dashboard_sales = detail_sales AS matches FROM d CROSS JOIN l""")
    cols = ["customer_id", "customer_name", "customer_type", "territory_id", "status", "sale_code", "sale_group"]
    q("csv_roundtrip", "SELECT " + ", ".join(f"trim(coalesce(CAST({c} AS VARCHAR), '')) AS {c}" for c in cols)
      + " FROM v_customer")
    from fieldlens.oracle.sheet import RAW_KEYS
    q("csv_scan", "SELECT source_row, " + ", ".join(f"trim(coalesce(raw_{k}, '')) AS raw_{k}" for k in RAW_KEYS)
      + " FROM v_sheet_numbered")
    q("align_schema", """SELECT employee_id, employee_name, email, role, coalesce(status, 'Active') AS status,
                           sale_code, 'NONE' AS sale_group FROM v_employee""")
    q("import_log", "SELECT 'run-1' AS batch_id, count(*) AS row_count, 'Completed' AS status FROM v_sheet_resolved")
    q("sheet_stream", "SELECT source_row, period, sales, row_hash FROM v_sheet_accepted")
    q("upload_session", "SELECT source_row, period, sales, row_hash FROM v_sheet_accepted")
    # Epochs: the sheet in thirds, rows of every fifteenth number come with the second chunk too; the last chunk is late.
    epochs = """(SELECT source_row, CASE source_row % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS epoch FROM v_sheet_numbered
                 UNION ALL SELECT source_row, 1 FROM v_sheet_numbered WHERE source_row % 15 = 0)"""
    refused = f"""
      SELECT 'batch-1' AS batch_id, e.source_row, CAST(e.epoch AS BIGINT) AS epoch, errors[1] AS reason
      FROM {epochs} e JOIN v_sheet_errors s ON s.source_row = e.source_row WHERE len(errors) > 0
      UNION ALL SELECT 'batch-1', source_row, 3, 'batch is closed' FROM v_sheet_numbered WHERE source_row % 7 = 0"""
    q("upload_refused", refused)
    q("upload_log", f"""
      SELECT 'batch-1' AS batch_id, 3 AS chunks,
             (SELECT count(*) FROM {epochs} e JOIN v_sheet_accepted s ON s.source_row = e.source_row) AS accepted,
             count(*) FILTER (WHERE epoch < 3) AS rejected, count(*) FILTER (WHERE epoch = 3) AS refused,
             'Completed' AS status, true AS finished FROM ({refused})""")
    start, end = _period_bounds("b.period")
    q("dashboard_by_rep", f"""
      WITH sc AS (SELECT s.* FROM v_combined s JOIN v_employee_customer ec
                  ON ec.employee_id = s.employee_id AND ec.customer_id = s.customer_id),
      rc AS (SELECT r.* FROM v_rx r JOIN v_employee_customer ec
             ON ec.employee_id = r.employee_id AND ec.customer_id = r.customer_id),
      tc AS (SELECT t.* FROM v_tender t JOIN v_employee_customer ec
             ON ec.employee_id = t.employee_id AND ec.customer_id = t.customer_id),
      per AS (SELECT e.employee_id, coalesce(
                (SELECT max(p) FROM (SELECT period AS p FROM sc WHERE sc.employee_id = e.employee_id
                                     UNION ALL SELECT period FROM rc WHERE rc.employee_id = e.employee_id)),
                strftime(DATE '{P.AS_OF}', '%Y-%m')) AS period
              FROM v_employee e),
      b AS (SELECT employee_id, period, {start} AS start_p, {end} AS end_p FROM per b)
      SELECT b.employee_id, b.period,
        CAST(coalesce((SELECT sum(amount) FROM sc WHERE sc.employee_id = b.employee_id AND sc.period = b.period), 0)
             AS DECIMAL(38,2)) AS sales,
        CAST(coalesce((SELECT sum(quantity) FROM rc WHERE rc.employee_id = b.employee_id AND rc.period = b.period), 0)
             AS INTEGER) AS prescription_quantity,
        CAST(coalesce((SELECT sum(amount) FROM rc WHERE rc.employee_id = b.employee_id AND rc.period = b.period), 0)
             AS DECIMAL(38,2)) AS prescription_amount,
        CAST((SELECT count(*) FROM tc WHERE tc.employee_id = b.employee_id
              AND tc.status IN ('DangLamHoSo', 'ChoKetQua')) AS INTEGER) AS open_tenders,
        CAST((SELECT count(*) FROM v_customer k
              WHERE k.customer_type = 'PhongMachTu' AND k.status = 'Active'
                AND EXISTS (SELECT 1 FROM v_employee_customer ec WHERE ec.employee_id = b.employee_id
                            AND ec.customer_id = k.customer_id)
                AND EXISTS (SELECT 1 FROM v_combined o WHERE o.customer_id = k.customer_id AND o.amount > 0
                            AND o.period < b.start_p AND o.employee_id = b.employee_id)
                AND NOT EXISTS (SELECT 1 FROM v_combined r WHERE r.customer_id = k.customer_id AND r.amount <> 0
                            AND r.period >= b.start_p AND r.period < b.end_p AND r.employee_id = b.employee_id))
             AS INTEGER) AS lost_sales
      FROM b""")


def build_small() -> None:
    q("active_managers", """SELECT count(*) AS active_managers FROM v_employee
                            WHERE status = 'Active' AND role IN ('QuanLy', 'Admin', 'Manager')""")


def build_export() -> None:
    names = ["territory", "employee", "product", "customer", "employee_territory", "employee_customer",
             "prescription", "tender", "daily_report", "kpi_target"]
    parts = [f"SELECT '{n}' AS table_name, count(*) AS rows FROM v_{n}" for n in names]
    parts.append("SELECT 'sales' AS table_name, count(*) AS rows FROM v_combined_b")
    q("export_snapshot", " UNION ALL ".join(parts))
