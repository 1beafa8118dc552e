"""DuckDB oracle for the sheet pipeline: rendering, numbering, normalising, deriving, diffing.

The rules are re-stated as SQL expressions (RE2 regexes, TRY_CAST,
try_strptime, strip_accents) over the same rendered sheet.
"""

from __future__ import annotations

from fieldlens.functions.numbers import _SPACE_POINTS
from fieldlens.oracle.views import register
from fieldlens.schema import SHEET_EMAIL_DOMAIN

SPACE = "[" + "".join(chr(c) for c in _SPACE_POINTS) + "]"
GROUPED = r"-?\d{1,3}(?:\.\d{3})+(?:,\d+)?"
DEC_COMMA = r"-?\d+,\d+"
LITERAL = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
BIG = 1_000_000_000

RAW_KEYS = ["manager", "emp_code", "emp_name", "province", "group", "month", "year", "cust_code", "cust_name",
            "doc_date", "ext_doc", "prod_code", "prod_name", "unit", "qty", "price", "revenue", "coef", "sales"]
NUMBERS = [("month", "month", False), ("year", "year", False), ("quantity", "qty", False),
           ("unit_price", "price", False), ("revenue", "revenue", False), ("coefficient", "coef", True),
           ("sales", "sales", False)]
TYPES = {"quantity": "DECIMAL(18,3)", "unit_price": "DECIMAL(18,3)", "revenue": "DECIMAL(18,2)",
         "coefficient": "DECIMAL(10,4)", "sales": "DECIMAL(18,2)"}
TEXT_FIELDS = ["manager_name", "employee_code", "employee_name", "province", "customer_group", "customer_code",
               "customer_name", "external_doc", "product_code", "product_name", "unit"]
HASHED = ["manager_name", "employee_code", "employee_name", "province", "customer_group", "month", "year",
          "customer_code", "customer_name", "doc_date", "external_doc", "product_code", "product_name", "unit",
          "quantity", "unit_price", "revenue", "coefficient", "sales"]


def vn2(x: str) -> str:
    return f"translate(format('{{:,.2f}}', {x}), ',.', '.,')"


def whole_slug(x: str) -> str:
    s = f"upper(replace(replace(strip_accents(coalesce({x}, '')), 'đ', 'd'), 'Đ', 'd'))"
    return f"regexp_replace(regexp_replace({s}, '[^A-Z0-9]+', '_', 'g'), '^_|_$', '', 'g')"


def slug(x: str) -> str:
    return f"left({whole_slug(x)}, 28)"


def own_ids(prefix: str, code: str, known: str | None) -> str:
    """(code, id) of the sheet's codes that ``known`` (a table with sale_code) lacks; every code has an id of its own."""
    absent = "" if known is None else f"WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.sale_code = c.code)"
    return f"""(SELECT code, CASE WHEN code = min(code) OVER (PARTITION BY base) THEN base
                ELSE base || '_' || upper(left(sha256(code), 16)) END AS id
                FROM (SELECT code, '{prefix}' || {slug('code')} AS base
                      FROM (SELECT DISTINCT {code} AS code FROM v_sheet_accepted) c {absent}))"""


def pad(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    return f"(CASE WHEN regexp_full_match({t}, '\\d{{1,6}}') THEN lpad({t}, 6, '0') ELSE {t} END)"


def ctype(x: str) -> str:
    s = slug(x)
    return (f"(CASE WHEN contains({s}, 'PHONG_MACH') OR contains({s}, 'PHONG_KHAM') THEN 'PhongMachTu' "
            f"WHEN contains({s}, 'SO_Y_TE') THEN 'SoYTe' ELSE 'BenhVien' END)")


def doc_date(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    sl = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    a = f"TRY_CAST(regexp_extract({t}, '{sl}', 1) AS INTEGER)"
    b = f"TRY_CAST(regexp_extract({t}, '{sl}', 2) AS INTEGER)"
    y = f"regexp_extract({t}, '{sl}', 3)"
    m = f"(CASE WHEN {a} > 12 THEN {b} ELSE {a} END)"
    d = f"(CASE WHEN {a} > 12 THEN {a} ELSE {b} END)"
    txt = f"{y} || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0')"
    return (f"(CASE WHEN regexp_full_match({t}, '\\d{{5}}(\\.\\d+)?') "
            f"THEN DATE '1899-12-30' + CAST(floor(CAST({t} AS DOUBLE)) AS INTEGER) "
            f"WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(try_strptime({t}, '%Y-%m-%d') AS DATE) "
            f"WHEN regexp_full_match({t}, '{sl}') THEN CAST(try_strptime({txt}, '%Y-%m-%d') AS DATE) END)")


def locale_stages(src: str, specs: list[tuple[str, str, bool]]) -> str:
    """Staged SQL: adds a DECIMAL(38,10) column per spec (out name, input column, coefficient)."""
    r = ", ".join(f"regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '{SPACE}', '', 'g') AS r_{n}"
                  for n, c, _ in specs)
    g = ", ".join(f"regexp_full_match(r_{n}, '\\(.+\\)') AS g_{n}" for n, _, _ in specs)
    b = ", ".join(f"CASE WHEN g_{n} THEN substr(r_{n}, 2, length(r_{n}) - 2) ELSE r_{n} END AS b_{n}"
                  for n, _, _ in specs)
    norms = []
    for n, _, coef in specs:
        first = lambda e: f"regexp_replace({e}, ',', '.')"  # noqa: E731  (no 'g': first comma only)
        if coef:
            norms.append(f"{first(f'b_{n}')} AS n_{n}")
        else:
            norms.append(f"""CASE WHEN regexp_full_match(b_{n}, '{GROUPED}') THEN {first(f"replace(b_{n}, '.', '')")}
                 WHEN regexp_full_match(b_{n}, '{DEC_COMMA}') THEN {first(f'b_{n}')}
                 WHEN contains(b_{n}, '.') AND contains(b_{n}, ',') THEN {first(f"replace(b_{n}, '.', '')")}
                 ELSE b_{n} END AS n_{n}""")
    v = ", ".join(f"""CASE WHEN r_{n} = '' OR r_{n} = '-' THEN CAST(0 AS DECIMAL(38,10))
                      WHEN NOT regexp_full_match(n_{n}, '{LITERAL}') THEN NULL
                      WHEN g_{n} THEN -TRY_CAST(n_{n} AS DECIMAL(38,10))
                      ELSE TRY_CAST(n_{n} AS DECIMAL(38,10)) END AS {n}""" for n, _, _ in specs)
    drop = ", ".join(f"{p}_{n}" for n, _, _ in specs for p in "rgbn")
    return (f"(SELECT * EXCLUDE ({drop}) FROM (SELECT *, {v} FROM (SELECT *, {', '.join(norms)} FROM "
            f"(SELECT *, {b} FROM (SELECT *, {g} FROM (SELECT *, {r} FROM {src}))))))")


def row_hash(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    parts = ", ".join(f"coalesce(CAST({p}{c} AS VARCHAR), '')" for c in HASHED)
    return f"sha256(concat_ws(chr(31), {parts}))"


def register_views() -> None:
    group = ("CASE customer_group WHEN 'HOUSEHOLD' THEN 'Phòng mạch tư nhân' WHEN 'BUILDING' THEN 'Phòng khám đa khoa' "
             "WHEN 'MACHINERY' THEN 'Sở Y tế' WHEN 'AUTOMOBILE' THEN 'Bệnh viện tỉnh' "
             "WHEN 'FURNITURE' THEN 'Nhà thuốc & Quầy thuốc tư nhân, Phòng khám' ELSE customer_group END")
    serial = "CAST(date_diff('day', DATE '1899-12-30', doc_date) AS VARCHAR)"
    date_text = (f"CASE line_number % 3 WHEN 0 THEN strftime(doc_date, '%Y-%m-%d') "
                 f"WHEN 1 THEN CAST(month(doc_date) AS VARCHAR) || '/' || CAST(day(doc_date) AS VARCHAR) || '/' "
                 f"|| CAST(year(doc_date) AS VARCHAR) "
                 f"ELSE {serial} || CASE WHEN order_key % 2 = 0 THEN '.5' ELSE '' END END")
    register("v_sheet_raw", f"""
      SELECT order_key, line_number, product_id, employee_id, customer_id, quantity, revenue, coefficient, sales,
        manager_name AS raw_manager,
        CASE WHEN employee_id % 9 = 4 THEN 'X' || CAST(employee_id AS VARCHAR) ELSE CAST(employee_id AS VARCHAR) END
          AS raw_emp_code,
        employee_name AS raw_emp_name, province AS raw_province, {group} AS raw_group,
        CASE WHEN order_key % 97 = 0 THEN '13' ELSE CAST(month AS VARCHAR) END AS raw_month,
        CAST(year AS VARCHAR) AS raw_year,
        CASE WHEN customer_id % 41 = 0 THEN 'Nhà thuốc Trung Tâm - chi nhánh số ' || CAST(customer_id AS VARCHAR)
             ELSE customer_code END AS raw_cust_code,
        CASE WHEN customer_id % 31 = 0 THEN '' ELSE customer_name END AS raw_cust_name,
        {date_text} AS raw_doc_date, external_doc AS raw_ext_doc, product_code AS raw_prod_code,
        product_name AS raw_prod_name, unit AS raw_unit,
        CAST(CAST(quantity AS INTEGER) AS VARCHAR) AS raw_qty, {vn2('unit_price')} AS raw_price,
        {vn2('revenue')} AS raw_revenue, replace(CAST(coefficient AS VARCHAR), '.', ',') AS raw_coef,
        CASE WHEN order_key % 89 = 0 THEN 'abc' WHEN sales < 0 THEN '(' || {vn2('-sales')} || ')'
             ELSE {vn2('sales')} END AS raw_sales
      FROM v_sheet_detail""")
    register("v_sheet_numbered", """
      SELECT * EXCLUDE (order_key, line_number, product_id, employee_id, customer_id, quantity, revenue,
                        coefficient, sales),
             row_number() OVER (ORDER BY order_key, line_number, product_id, employee_id, customer_id, quantity,
                                revenue, coefficient, sales) + 1 AS source_row
      FROM v_sheet_raw""")
    parsed = locale_stages("v_sheet_numbered", [(f"p_{n}", f"raw_{k}", c) for n, k, c in NUMBERS])
    t = lambda k: f"trim(coalesce(raw_{k}, ''))"
    int_ok = lambda n, lo, hi: f"(p_{n} IS NOT NULL AND p_{n} = floor(p_{n}) AND p_{n} BETWEEN {lo} AND {hi})"
    register("v_sheet_checked", f"""
      SELECT source_row,
        {t('manager')} AS manager_name, {pad('raw_emp_code')} AS employee_code, {t('emp_name')} AS employee_name,
        {t('province')} AS province, {t('group')} AS customer_group,
        TRY_CAST(p_month AS INTEGER) AS month, TRY_CAST(p_year AS INTEGER) AS year,
        {t('cust_code')} AS customer_code,
        CASE WHEN {t('cust_name')} = '' THEN {t('cust_code')} ELSE {t('cust_name')} END AS customer_name,
        {t('ext_doc')} AS external_doc, {t('prod_code')} AS product_code, {t('prod_name')} AS product_name,
        {t('unit')} AS unit, {doc_date('raw_doc_date')} AS doc_date,
        {', '.join(f"TRY_CAST(p_{n} AS {TYPES[n]}) AS {n}" for n in TYPES)},
        {', '.join(f"p_{n} AS x_{n}" for n in TYPES)},
        p_month, p_year
      FROM {parsed}""")
    errs = [
        f"CASE WHEN p_month IS NULL THEN 'month is not a number' WHEN NOT {int_ok('month', 1, 12)} "
        f"THEN 'month is not valid' END",
        f"CASE WHEN p_year IS NULL THEN 'year is not a number' WHEN NOT {int_ok('year', 2000, 2100)} "
        f"THEN 'year is not valid' END",
        "CASE WHEN doc_date IS NULL THEN 'document date is not valid' END",
    ]
    for n in TYPES:
        errs.append(f"CASE WHEN x_{n} IS NULL THEN '{n} is not a number' WHEN {n} IS NULL THEN '{n} is out of range' END")
    for n in TEXT_FIELDS:
        errs.append(f"CASE WHEN {n} = '' THEN '{n} is blank' END")
    register("v_sheet_errors", f"""
      SELECT *, list_filter([{', '.join(errs)}], lambda e: e IS NOT NULL) AS errors FROM v_sheet_checked""")
    cols = ("source_row, manager_name, employee_code, employee_name, province, customer_group, month, year, "
            "customer_code, customer_name, external_doc, product_code, product_name, unit, doc_date, "
            "quantity, unit_price, revenue, coefficient, sales")
    register("v_sheet_accepted", f"""
      SELECT {cols}, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period,
             {row_hash()} AS row_hash
      FROM v_sheet_errors WHERE len(errors) = 0""")
    ids = lambda view, prefix, code: (
        f"(SELECT sale_code, min(CAST({view[2:]}_id AS VARCHAR)) AS mid FROM {view} "
        f"WHERE sale_code IS NOT NULL GROUP BY sale_code)")
    register("v_sheet_resolved", f"""
      SELECT a.*, t.id AS territory_id, coalesce(e.mid, ge.id) AS employee_id, coalesce(c.mid, gc.id) AS customer_id,
             coalesce(p.mid, gp.id) AS product_id
      FROM v_sheet_accepted a
      LEFT JOIN {ids('v_employee', '', '')} e ON e.sale_code = a.employee_code
      LEFT JOIN {ids('v_customer', '', '')} c ON c.sale_code = a.customer_code
      LEFT JOIN {ids('v_product', '', '')} p ON p.sale_code = a.product_code
      LEFT JOIN {own_ids('SALE_DB_', whole_slug('province'), None)} t ON t.code = {whole_slug('a.province')}
      LEFT JOIN {own_ids('SALE_NV_', 'employee_code', 'v_employee')} ge ON ge.code = a.employee_code
      LEFT JOIN {own_ids('SALE_KH_', 'customer_code', 'v_customer')} gc ON gc.code = a.customer_code
      LEFT JOIN {own_ids('SALE_SP_', 'product_code', 'v_product')} gp ON gp.code = a.product_code""")
    # Previous version of the stored sheet: most rows, some with other sales, some gone since, one other source.
    register("v_sheet_prev", f"""
      WITH base AS (
        SELECT * REPLACE (CAST(CASE WHEN source_row % 7 = 0 THEN sales + 1 ELSE sales END AS DECIMAL(18,2)) AS sales)
        FROM v_sheet_resolved WHERE source_row % 10 <> 0)
      SELECT * REPLACE ({row_hash()} AS row_hash),
             CASE WHEN source_row % 10 = 3 THEN 'other' ELSE 'sheet' END AS source_id
      FROM (SELECT * FROM base UNION ALL
            SELECT * REPLACE (source_row + {BIG} AS source_row) FROM base WHERE source_row % 10 = 5)""")


def first_per(view: str, key: str, cols: str) -> str:
    return f"""SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY source_row) AS rn
               FROM {view}) WHERE rn = 1"""


def build(q) -> None:
    register_views()
    raw_cols = ", ".join(f"raw_{k}" for k in RAW_KEYS)
    q("sheet_row_number", f"SELECT source_row, {raw_cols} FROM v_sheet_numbered")
    q("sheet_normalise", "SELECT * FROM v_sheet_accepted")
    q("sheet_rejects", """SELECT source_row, errors[1] AS error, CAST(len(errors) AS INTEGER) AS error_count
                          FROM v_sheet_errors WHERE len(errors) > 0""")
    q("locale_number", "SELECT source_row, " + ", ".join(f"p_{n} AS {n}" for n, _, _ in NUMBERS)
      + " FROM " + locale_stages("v_sheet_numbered", [(f"p_{n}", f"raw_{k}", c) for n, k, c in NUMBERS]))
    q("doc_date", f"SELECT source_row, raw_doc_date, {doc_date('raw_doc_date')} AS doc_date FROM v_sheet_numbered")
    q("slug", f"""SELECT source_row, {slug('raw_province')} AS province_slug, {slug('raw_group')} AS group_slug,
                  {slug('raw_cust_code')} AS customer_slug FROM v_sheet_numbered""")
    q("customer_type", f"SELECT source_row, raw_group, {ctype('raw_group')} AS customer_type FROM v_sheet_numbered")
    q("pad_code", f"SELECT source_row, raw_emp_code, {pad('raw_emp_code')} AS employee_code FROM v_sheet_numbered")
    q("resolve_codes", "SELECT source_row, territory_id, employee_id, customer_id, product_id FROM v_sheet_resolved")
    q("derive_territory", first_per("v_sheet_resolved", "territory_id",
                                    "territory_id, province AS territory_name, 'DATA SALE' AS region, "
                                    "'Active' AS status"))
    q("derive_employee", first_per(
        "(SELECT * FROM v_sheet_resolved WHERE employee_code NOT IN "
        "(SELECT sale_code FROM v_employee WHERE sale_code IS NOT NULL))", "employee_id",
        f"employee_id, employee_name, 'sale-' || lower({slug('employee_code')}) || '{SHEET_EMAIL_DOMAIN}' AS email, "
        "'NhanVien' AS role, 'Active' AS status, employee_code AS sale_code"))
    q("derive_customer", first_per("v_sheet_resolved", "customer_id",
                                   f"customer_id, customer_name, {ctype('customer_group')} AS customer_type, "
                                   "territory_id, customer_code AS sale_code, customer_group AS sale_group"))
    q("derive_product", first_per("v_sheet_resolved", "product_id",
                                  "product_id, product_name, 'Khac' AS dosage_code, "
                                  "'Chưa phân loại từ DATA SALE' AS dosage_form, "
                                  "CAST(greatest(unit_price, 0) AS DECIMAL(14,2)) AS price, "
                                  "product_code AS sale_code, unit"))
    q("derive_assignments", "SELECT DISTINCT employee_id, customer_id FROM v_sheet_resolved")
    stats = """
      SELECT count(*) AS row_count, count(DISTINCT source_row) AS source_row_count,
             min(source_row) AS min_source_row, max(source_row) AS max_source_row,
             count(DISTINCT employee_id) AS employee_count, count(DISTINCT customer_id) AS customer_count,
             count(DISTINCT product_id) AS product_count,
             CAST(coalesce(sum(sales), 0) AS DECIMAL(38,2)) AS total_sales,
             min(doc_date) AS first_document_date, max(doc_date) AS last_document_date
      FROM v_sheet_resolved"""
    q("import_stats", stats)
    q("import_stats_by_source", stats.replace("SELECT count(*)", "SELECT source_id, count(*)")
      .replace("FROM v_sheet_resolved", "FROM v_sheet_prev GROUP BY source_id"))
    numbers = locale_stages("v_sheet_numbered", [(f"p_{n}", f"raw_{k}", c) for n, k, c in NUMBERS])
    names = dict(zip(RAW_KEYS, ["manager", *HASHED[1:]]))
    blanks = ", ".join(f"count(*) FILTER (WHERE trim(coalesce(raw_{k}, '')) = '') AS blank_{n}" for k, n in names.items())
    bad = ", ".join(f"count(*) FILTER (WHERE p_{n} IS NULL) AS bad_{n}" for n, _, _ in NUMBERS)
    profile = f"""
      SELECT count(*) AS rows, {blanks}, {bad}, count(*) FILTER (WHERE {doc_date('raw_doc_date')} IS NULL) AS bad_doc_date,
             CAST(coalesce(sum(p_sales), 0) AS DECIMAL(38,2)) AS expected_total
      FROM {numbers}"""
    cells = " UNION ALL ".join(f"SELECT '{n}' AS column_name, source_row, raw_{k} AS value FROM {numbers} WHERE p_{n} IS NULL"
                               for n, k, _ in NUMBERS)
    q("sheet_samples", f"""SELECT * FROM ({cells})
      QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY source_row) <= 10""")
    q("sheet_profile", profile)
    q("reconcile_import", f"""
      SELECT s.row_count = p.rows AS rows_ok, s.source_row_count = p.rows AS distinct_rows_ok,
             s.min_source_row = 2 AS min_row_ok, s.max_source_row = p.rows + 1 AS max_row_ok,
             abs(CAST(s.total_sales - p.expected_total AS DOUBLE))
               <= greatest(1.0, abs(CAST(p.expected_total AS DOUBLE)) * 1e-9) AS total_ok,
             p.rows, s.row_count, p.expected_total, s.total_sales
      FROM ({profile}) p CROSS JOIN ({stats}) s""")
    diff = """
      SELECT coalesce(o.source_row, n.source_row) AS source_row,
             CASE WHEN o.row_hash IS NULL THEN 'inserted' WHEN n.row_hash IS NULL THEN 'deleted'
                  WHEN o.row_hash = n.row_hash THEN 'unchanged' ELSE 'updated' END AS change
      FROM (SELECT source_row, row_hash FROM v_sheet_prev WHERE source_id = 'sheet') o
      FULL OUTER JOIN (SELECT source_row, row_hash FROM v_sheet_resolved) n ON o.source_row = n.source_row"""
    q("snapshot_diff", diff)
    q("changed_rows", f"SELECT * FROM ({diff}) d WHERE change = 'updated'")
    q("sheet_import", """
      SELECT source_id, source_row, employee_id, customer_id, product_id, period, sales, row_hash
      FROM v_sheet_prev WHERE source_id <> 'sheet'
      UNION ALL
      SELECT 'sheet', source_row, employee_id, customer_id, product_id, period, sales, row_hash
      FROM v_sheet_resolved""")
