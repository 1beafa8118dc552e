"""Searched, paged lists (R5-R7), API shapes (P16, P19), bundles (S5) and admin views.

Lists join names with inner joins (J1: rows with unresolved ids drop out),
filter, count the filtered set once (W1) and return one page as a top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.keys import with_children
from fieldlens.operators.paging import by_enum, by_period, clamp_page, page, search_any, search_concat
from fieldlens.operators.scope import scope_customers, scope_rows
from fieldlens.plans.dashboard import prescription_period
from fieldlens.plans.sales import combined_sales
from fieldlens.schema import TENDER_LABELS, TENDER_STATUSES
from fieldlens.session import Viewer


def with_names(df: DataFrame, T, how: str = "inner") -> DataFrame:
    """Attach customer, product and employee names."""
    out = df
    if "customer_id" in df.columns:
        out = out.join(T.customer.select("customer_id", "customer_name"), "customer_id", how)
    if "product_id" in df.columns:
        out = out.join(T.product.select("product_id", "product_name"), "product_id", how)
    if "employee_id" in df.columns:
        out = out.join(T.employee.select("employee_id", "employee_name"), "employee_id", how)
    return out


def sales_list(T, viewer: Viewer, period=None, search=None, page_no=1, size=20) -> DataFrame:
    """Combined sales in scope, with names, period filter, search, paging."""
    rows = with_names(scope_rows(combined_sales(T), T, viewer), T)
    rows = search_any(by_period(rows, period), ["customer_name", "product_name"], search)
    order = [F.col("period").desc(), F.col("customer_name").asc(), F.col("product_name").asc(),
             F.col("customer_id").asc(), F.col("product_id").asc(), F.col("employee_id").asc(),
             F.col("source").asc()]
    return page(rows.select("period", "customer_id", "customer_name", "product_id", "product_name",
                            "employee_id", "employee_name", "amount", "source"), order, page_no, size)


def prescription_list(T, viewer: Viewer, period=None, search=None, page_no=1, size=20) -> DataFrame:
    """Prescriptions in scope; newest first."""
    rows = with_names(scope_rows(prescription_period(T.prescription), T, viewer), T)
    rows = search_any(by_period(rows, period), ["customer_name", "product_name", "employee_name"], search)
    cols = ["prescription_id", "report_date", "employee_id", "employee_name", "customer_id", "customer_name",
            "product_id", "product_name", "quantity", "amount"]
    order = [F.col("report_date").desc(), F.col("prescription_id").asc(), F.col("employee_id").asc(),
             F.col("customer_id").asc(), F.col("product_id").asc(), F.col("quantity").asc(),
             F.col("amount").asc()]
    return page(rows.select(*cols), order, page_no, size)


def tender_list(T, viewer: Viewer, status=None, search=None, page_no=1, size=20) -> DataFrame:
    """Tenders in scope; optional known status; search also matches the tender id."""
    rows = with_names(scope_rows(T.tender, T, viewer), T)
    rows = by_enum(rows, "status", status, TENDER_STATUSES)
    rows = search_any(rows, ["tender_id", "customer_name", "product_name", "employee_name"], search)
    cols = ["tender_id", "customer_id", "customer_name", "product_id", "product_name", "quantity",
            "bid_price", "status", "employee_id", "employee_name", "due_date", "updated_date"]
    order = [F.col("updated_date").desc(), F.col("tender_id").asc()]
    return page(rows.select(*cols), order, page_no, size)


def api_sales(T) -> DataFrame:
    """The API shape of the export sales: null text -> '', null number -> 0."""
    s = combined_sales(T, variant="export")
    return s.select(
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.col("period"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("product_id").cast("string").alias("product_id"),
        F.col("employee_id").cast("string").alias("employee_id"),
        F.coalesce(F.col("amount"), F.lit(0).cast("decimal(38,2)")).alias("amount"))


def api_tenders(T) -> DataFrame:
    """P16 for tenders: dates as ISO text, missing numbers as 0."""
    t = T.tender
    return t.select(
        F.col("tender_id").cast("string").alias("tender_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("product_id").cast("string").alias("product_id"),
        F.coalesce(F.col("quantity"), F.lit(0)).cast("long").alias("quantity"),
        F.coalesce(F.col("bid_price"), F.lit(0).cast("decimal(14,2)")).alias("bid_price"),
        F.col("status"),
        F.col("employee_id").cast("string").alias("employee_id"),
        F.coalesce(F.date_format("due_date", "yyyy-MM-dd"), F.lit("")).alias("due_date"))


def vnd_text(col):
    """Money as VND text: rounded half away from zero, dot-grouped, with the dong sign."""
    grouped = F.format_number(F.round(col, 0), 0)
    return F.concat(F.translate(grouped, ",", "."), F.lit(" ₫"))


def tender_labels(T) -> DataFrame:
    """Status label lookup (fallback: the code) and money text."""
    labels = F.create_map(*[x for k, v in TENDER_LABELS.items() for x in (F.lit(k), F.lit(v))])
    t = T.tender
    return t.select("tender_id", "status",
                    F.coalesce(labels[F.col("status")], F.col("status")).alias("status_label"),
                    vnd_text(F.col("bid_price")).alias("bid_price_text"))


# ------------------------------------------------------------------ bundle
def employees_with_territories(T) -> DataFrame:
    """Each employee with the sorted list of its territory ids."""
    return with_children(T.employee, T.employee_territory, "employee_id", "territory_id", "territory_ids")


def bundle_employees(T, viewer: Viewer) -> DataFrame:
    emps = employees_with_territories(T)
    if viewer.is_manager:
        return emps
    return emps.filter(F.col("employee_id") == F.lit(viewer.employee_id))


def bundle_customers(T, viewer: Viewer) -> DataFrame:
    return scope_customers(T, viewer)


def recent(df: DataFrame, col: str, as_of, days: int = 31) -> DataFrame:
    """rows dated on or after ``as_of - days``."""
    return df.filter(F.col(col) >= F.date_sub(F.lit(str(as_of)).cast("date"), days))


def bundle_recent_reports(T, viewer: Viewer, as_of) -> DataFrame:
    reports = recent(T.daily_report, "report_date", as_of)
    if viewer.is_manager:
        return reports
    return reports.filter(F.col("employee_id") == F.lit(viewer.employee_id))


def master_bundle(T, viewer: Viewer, as_of) -> dict[str, DataFrame]:
    """Lightweight first load, restricted to the viewer (no fact tables)."""
    targets = T.kpi_target
    return {
        "territories": T.territory,
        "employees": bundle_employees(T, viewer),
        "products": T.product,
        "customers": bundle_customers(T, viewer),
        "daily_reports": bundle_recent_reports(T, viewer, as_of),
        "kpi_targets": targets if viewer.is_manager else targets.filter(
            F.col("employee_id") == F.lit(viewer.employee_id)),
    }


# ------------------------------------------------------------------ admin
def assignment_names(T) -> DataFrame:
    """Assignments with names; a missing name falls back to the id."""
    ec = T.employee_customer
    e = T.employee.select("employee_id", "employee_name")
    c = T.customer.select("customer_id", "customer_name")
    j = ec.join(e, "employee_id", "left").join(c, "customer_id", "left")
    return j.select("employee_id", "customer_id",
                    F.coalesce("employee_name", F.col("employee_id").cast("string")).alias("employee_name"),
                    F.coalesce("customer_name", F.col("customer_id").cast("string")).alias("customer_name"))


def account_coverage(employee: DataFrame, account: DataFrame) -> DataFrame:
    """Each employee with its login name, if any."""
    j = employee.select("employee_id", "employee_name", "role", "status").join(
        account.select("employee_id", "username"), "employee_id", "left")
    return j.withColumn("has_account", F.col("username").isNotNull())


def profile_counts(employee: DataFrame, account: DataFrame) -> DataFrame:
    """Employees, accounts, employees without an account."""
    cov = account_coverage(employee, account)
    return cov.agg(F.count(F.lit(1)).alias("employees"),
                   F.count_if(F.col("has_account")).alias("with_account"),
                   F.count_if(~F.col("has_account")).alias("without_account"))


ADMIN_TEXT = {
    "employee": ["employee_id", "employee_name", "email", "role", "status"],
    "customer": ["customer_id", "customer_name", "customer_type", "territory_id", "status"],
    "product": ["product_id", "product_name", "dosage_code", "status"],
    "territory": ["territory_id", "territory_name", "region", "status"],
}


def admin_search(T, resource: str, text, page_no=1, size=6) -> DataFrame:
    """F13 + T3: searched admin page; a page past the end shows the last page.

    Clamping needs only the number of hits, a one-row scalar; the page itself
    is then a top-k (sort within tasks, keep offset + size rows each).
    """
    df = {"employee": T.employee, "customer": T.customer, "product": T.product,
          "territory": T.territory}[resource]
    cols = ADMIN_TEXT[resource]
    hits = search_concat(df.select(*cols), cols, text)
    total = hits.count()
    pages = max(1, -(-total // size))
    shown = min(max(1, int(page_no)), pages)
    return (hits.orderBy(F.col(cols[0]).asc()).offset((shown - 1) * size).limit(size)
            .select(*cols, F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("pages"),
                    F.lit(shown).cast("long").alias("page"), F.lit(size).alias("page_size")))


def clamp(page_no, size):
    return clamp_page(page_no, size)
