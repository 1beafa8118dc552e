"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each runs over the whole driver tables (no id subsets, no row caps); a limit
appears only where paging or top-k is the feature itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens import params as P
from fieldlens.functions.dates import parse_doc_date
from fieldlens.functions.numbers import strict_number as _strict
from fieldlens.functions.numbers import with_locale_numbers
from fieldlens.functions.text import customer_type, pad_code, slug
from fieldlens.functions.text import parse_bool as _bool
from fieldlens.functions.text import pick as _pick
from fieldlens.operators import merge, quality
from fieldlens.operators.keys import latest_per_key
from fieldlens.operators.paging import latest_periods
from fieldlens.operators.scope import owned, scope_customers, scope_rows
from fieldlens.plans import alerts, changes, dashboard, imports, ingest, listing, sales
from fieldlens.schema import MONEY, RESOURCES, SHEET_HEADERS, SHEET_MONEY
from fieldlens.session import in_slices, scratch_path, shuffles_freed, staged, unstage
from fieldlens.sources import csv as csvio
from fieldlens.sources.versions import VersionedTable
from fieldlens.sources.views import DamagedTables, Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


# ----------------------------------------------------------- sales sources
@register("combined_sales")
def q_combined_sales(spark, d):
    return sales.combined_sales(_t(spark, d))


@register("combined_sales_export")
def q_combined_sales_export(spark, d):
    return sales.combined_sales(_t(spark, d), variant="export")


@register("combined_sales_nullkey")
def q_combined_sales_nullkey(spark, d):
    T = _t(spark, d)
    return sales.combined_sales(T, sheet=T.sheet_sales_nullkey)


@register("sheet_monthly")
def q_sheet_monthly(spark, d):
    return sales.sheet_monthly(_t(spark, d).sheet_detail)


# ----------------------------------------------------------- dashboard
@register("dashboard")
def q_dashboard(spark, d):
    return dashboard.dashboard(_t(spark, d), P.MANAGER_VIEWER, as_of=P.AS_OF)


@register("dashboard_period")
def q_dashboard_period(spark, d):
    return dashboard.dashboard(_t(spark, d), P.MANAGER_VIEWER, period=P.PERIOD, as_of=P.AS_OF)


@register("dashboard_rep")
def q_dashboard_rep(spark, d):
    return dashboard.dashboard(_t(spark, d), P.REP_VIEWER, as_of=P.AS_OF)


@register("dashboard_by_rep")
def q_dashboard_by_rep(spark, d):
    return dashboard.dashboard_by_rep(_t(spark, d), as_of=P.AS_OF)


@register("available_periods")
def q_available_periods(spark, d):
    return dashboard.available_periods(_t(spark, d), P.REP_VIEWER)


@register("latest_periods")
def q_latest_periods(spark, d):
    return latest_periods(sales.combined_sales(_t(spark, d)), 4)


# ----------------------------------------------------------- scope
@register("scope_sales")
def q_scope_sales(spark, d):
    T = _t(spark, d)
    return scope_rows(sales.combined_sales(T), T, P.REP_VIEWER)


@register("scope_customers")
def q_scope_customers(spark, d):
    return scope_customers(_t(spark, d), P.REP_VIEWER)


@register("scope_targets")
def q_scope_targets(spark, d):
    return owned(_t(spark, d).kpi_target, P.REP_VIEWER)


# ----------------------------------------------------------- alerts
@register("lost_sales")
def q_lost_sales(spark, d):
    return alerts.lost_sales(_t(spark, d), P.MANAGER_VIEWER)


@register("lost_sales_rep")
def q_lost_sales_rep(spark, d):
    return alerts.lost_sales(_t(spark, d), P.REP_VIEWER)


@register("lost_sales_by_rep")
def q_lost_sales_by_rep(spark, d):
    return alerts.lost_sales_by_rep(_t(spark, d))


@register("lost_sales_latest4")
def q_lost_sales_latest4(spark, d):
    return alerts.lost_sales_latest(_t(spark, d))


@register("reminders")
def q_reminders(spark, d):
    return alerts.reminders(_t(spark, d), P.MANAGER_VIEWER, P.AS_OF_REMINDERS)


@register("reminders_rep")
def q_reminders_rep(spark, d):
    return alerts.reminders(_t(spark, d), P.REP_VIEWER, P.AS_OF_REMINDERS)


@register("reminders_loose")
def q_reminders_loose(spark, d):
    return alerts.reminders_loose(_t(spark, d), P.AS_OF_REMINDERS)


# ----------------------------------------------------------- lists


@register("sales_page")
def q_sales_page(spark, d):
    return listing.sales_list(_t(spark, d), P.MANAGER_VIEWER, page_no=P.PAGE, size=P.PAGE_SIZE)


@register("sales_search")
def q_sales_search(spark, d):
    return listing.sales_list(_t(spark, d), P.MANAGER_VIEWER, period=P.PERIOD, search=P.SEARCH)


@register("sales_page_rep")
def q_sales_page_rep(spark, d):
    return listing.sales_list(_t(spark, d), P.REP_VIEWER, search=" ", page_no=2, size=0)


@register("prescription_page")
def q_prescription_page(spark, d):
    return listing.prescription_list(_t(spark, d), P.REP_VIEWER, page_no=1, size=1000)


@register("prescription_search")
def q_prescription_search(spark, d):
    return listing.prescription_list(_t(spark, d), P.MANAGER_VIEWER, period=P.PERIOD, search=P.SEARCH,
                                     page_no=2, size=10)


@register("tender_page")
def q_tender_page(spark, d):
    return listing.tender_list(_t(spark, d), P.MANAGER_VIEWER, status=P.TENDER_STATUS,
                               search="customer#00000", page_no=2, size=0)


@register("tender_search")
def q_tender_search(spark, d):
    return listing.tender_list(_t(spark, d), P.REP_VIEWER, status="Unknown", search="1", page_no=99)


@register("api_sales")
def q_api_sales(spark, d):
    return listing.api_sales(_t(spark, d))


@register("export_sales")
def q_export_sales(spark, d):
    return sales.combined_sales(_t(spark, d), variant="export")


@register("api_tenders")
def q_api_tenders(spark, d):
    return listing.api_tenders(_t(spark, d))


@register("tender_labels")
def q_tender_labels(spark, d):
    return listing.tender_labels(_t(spark, d))


@register("bundle_employees")
def q_bundle_employees(spark, d):
    return listing.bundle_employees(_t(spark, d), P.REP_VIEWER)


@register("bundle_customers")
def q_bundle_customers(spark, d):
    return listing.bundle_customers(_t(spark, d), P.REP_VIEWER)


@register("bundle_recent_reports")
def q_bundle_recent_reports(spark, d):
    return listing.bundle_recent_reports(_t(spark, d), P.MANAGER_VIEWER, P.AS_OF)


@register("employee_territory_list")
def q_employee_territory_list(spark, d):
    return listing.employees_with_territories(_t(spark, d))


@register("assignment_names")
def q_assignment_names(spark, d):
    return listing.assignment_names(_t(spark, d))


@register("account_coverage")
def q_account_coverage(spark, d):
    T = _t(spark, d)
    return listing.account_coverage(T.employee, T.account)


@register("profile_counts")
def q_profile_counts(spark, d):
    T = _t(spark, d)
    return listing.profile_counts(T.employee, T.account)


@register("admin_search")
def q_admin_search(spark, d):
    return listing.admin_search(_t(spark, d), "customer", "customer#0000001", page_no=3)


@register("admin_search_last")
def q_admin_search_last(spark, d):
    return listing.admin_search(_t(spark, d), "employee", "NHANVIEN", page_no=1000)


# ----------------------------------------------------------- maintenance

BIG = 1_000_000_000  # offset for ids that do not exist in the masters


def manual_changes(T):
    s = T.sheet_sales.filter(F.col("order_key") % 13 == 0)
    return s.select("period", "customer_id", "product_id", "employee_id",
                    F.abs("sales").cast(MONEY).alias("amount"), F.lit("Import website").alias("source_note"),
                    F.struct("order_key", "line_number", "sales").alias("seq"))


@register("upsert_manual")
def q_upsert_manual(spark, d):
    T = _t(spark, d)
    return merge.upsert(T.manual_sales, manual_changes(T), ["period", "customer_id", "product_id"], "seq")


def customer_changes(T):
    c = T.customer
    upd = c.filter(F.col("customer_id") % 10 == 0).select(
        "customer_id", F.upper("customer_name").alias("customer_name"), "customer_type", "territory_id",
        F.lit("Inactive").alias("status"), "sale_code", "sale_group", F.lit(1).alias("seq"))
    new = c.filter(F.col("customer_id") % 50 == 1).select(
        (F.col("customer_id") + BIG).alias("customer_id"), "customer_name", "customer_type", "territory_id",
        "status", F.lit(None).cast("string").alias("sale_code"), "sale_group", F.lit(1).alias("seq"))
    return upd.unionByName(new)


@register("upsert_customer")
def q_upsert_customer(spark, d):
    T = _t(spark, d)
    return merge.upsert(T.customer, customer_changes(T), ["customer_id"], "seq")


def tender_upsert_changes(T):
    t = T.tender.filter(F.col("tender_id") % 9 == 0)
    a = t.withColumn("status", F.lit("TrungThau")).withColumn("seq", F.lit(1))
    b = (t.filter(F.col("tender_id") % 2 == 0).withColumn("status", F.lit("TruotThau"))
         .withColumn("updated_date", F.lit(P.AS_OF).cast("date")).withColumn("seq", F.lit(2)))
    return a.unionByName(b)


@register("upsert_tender")
def q_upsert_tender(spark, d):
    T = _t(spark, d)
    return merge.upsert(T.tender, tender_upsert_changes(T), ["tender_id"], "seq")


def report_changes(T):
    e = T.raw("events").filter(F.col("event_id") % 5 == 0)
    return e.select(F.col("ts").cast("date").alias("report_date"), F.col("user_id").alias("employee_id"),
                    F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("summary"),
                    F.col("props").alias("kpi_note"), F.col("event_id").alias("seq"))


@register("upsert_reports")
def q_upsert_reports(spark, d):
    T = _t(spark, d)
    return merge.upsert(T.daily_report, report_changes(T), ["report_date", "employee_id"], "seq")


def employee_changes(T):
    e = T.employee.filter(F.col("employee_id") % 5 == 0)
    return e.select("employee_id", F.upper("employee_name").alias("employee_name"),
                    F.lit(None).cast("string").alias("email"),
                    F.when(F.col("employee_id") % 10 == 0, "QuanLy").otherwise("NhanVien").alias("role"),
                    "status",
                    F.when(F.col("employee_id") % 10 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("NEW"), F.col("employee_id").cast("string"))).alias("sale_code"),
                    F.lit(1).alias("seq"))


@register("upsert_partial")
def q_upsert_partial(spark, d):
    T = _t(spark, d)
    return merge.upsert(T.employee, employee_changes(T), ["employee_id"], "seq",
                        columns=["employee_name", "email", "role"], keep_if_null=["sale_code"])


def assignment_changes(T):
    li = T.raw("lineitem").select("l_orderkey", "l_suppkey")
    o = T.raw("orders").filter(F.col("o_orderkey") % 5 == 0).select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").alias("employee_id"), F.col("o_custkey").alias("customer_id"))


@register("assign_insert")
def q_assign_insert(spark, d):
    T = _t(spark, d)
    return merge.insert_absent(T.employee_customer, assignment_changes(T), ["employee_id", "customer_id"])


def kpi_changes(T):
    s = T.raw("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    key = F.col("s_suppkey")
    base = s.select(key.alias("employee_id"), F.col("s_nationkey").alias("territory_id"),
                    F.when(key % 2 == 0, F.lit(None).cast("long")).otherwise(key).alias("product_id"),
                    (F.abs("s_acctbal") * 2).cast(MONEY).alias("target_sales"),
                    (F.col("s_nationkey") + 1).cast("int").alias("target_prescriptions"))
    upd = base.withColumn("period", F.lit("2001-07")).withColumn("seq", F.lit(1))
    again = (base.filter(key % 2 == 0).withColumn("period", F.lit("2001-07"))
             .withColumn("target_sales", F.lit(1).cast(MONEY)).withColumn("seq", F.lit(2)))
    new = base.withColumn("period", F.lit("2001-08")).withColumn("seq", F.lit(1))
    return upd.unionByName(again).unionByName(new)


@register("kpi_upsert")
def q_kpi_upsert(spark, d):
    T = _t(spark, d)
    return merge.upsert(T.kpi_target, kpi_changes(T), ["period", "employee_id", "product_id"], "seq",
                        null_safe=True)


@register("latest_per_key")
def q_latest_per_key(spark, d):
    T = _t(spark, d)
    creds = T.raw("events").select(F.col("user_id").alias("employee_id"), F.col("ts").alias("updated_at"),
                                   F.col("event_type").alias("username"), F.col("event_id"))
    return latest_per_key(creds, ["employee_id"], ["updated_at", "username", "event_id"])


def deactivation_ids(T):
    s = T.raw("supplier").select("s_suppkey")
    known = s.filter(F.col("s_suppkey") % 11 == 0).select(F.col("s_suppkey").alias("id"))
    mgr = s.filter(F.col("s_suppkey") % 20 == 0).select(F.col("s_suppkey").alias("id"))
    unknown = s.filter(F.col("s_suppkey") % 37 == 1).select((F.col("s_suppkey") + BIG).alias("id"))
    return known.unionByName(mgr).unionByName(unknown)


@register("deactivate")
def q_deactivate(spark, d):
    T = _t(spark, d)
    out, _ = merge.deactivate(T.employee, deactivation_ids(T), "employee_id", actor=P.MANAGER_ID,
                              guard_managers=True)
    return out


@register("deactivate_refused")
def q_deactivate_refused(spark, d):
    T = _t(spark, d)
    _, refused = merge.deactivate(T.employee, deactivation_ids(T), "employee_id", actor=P.MANAGER_ID,
                                  guard_managers=True)
    return refused


def removal_pairs(T):
    ec = T.employee_customer
    a = ec.filter((F.col("employee_id") + F.col("customer_id")) % 7 == 0)
    b = ec.filter((F.col("employee_id") + F.col("customer_id")) % 13 == 0).select(
        "employee_id", (F.col("customer_id") + BIG).alias("customer_id"))
    return a.unionByName(b)


@register("remove_assignments")
def q_remove_assignments(spark, d):
    T = _t(spark, d)
    return merge.remove_pairs(T.employee_customer, removal_pairs(T), ["employee_id", "customer_id"])[0]


@register("remove_assignments_missing")
def q_remove_assignments_missing(spark, d):
    T = _t(spark, d)
    return merge.remove_pairs(T.employee_customer, removal_pairs(T), ["employee_id", "customer_id"])[1]


PURGED_TABLES = ["daily_report", "kpi_target", "prescription", "manual_sales", "sheet_sales", "tender",
                 "employee_customer", "employee_territory", "account", "customer", "employee", "product"]


@register("purge_cascade")
def q_purge_cascade(spark, d):
    T = _t(spark, d)
    keys = {
        "employee": T.employee.filter(F.col("employee_id") % 50 == 1).select("employee_id"),
        "customer": T.customer.filter(F.col("customer_id") % 97 == 5).select("customer_id"),
        "product": T.product.filter(F.col("product_id") % 89 == 3).select("product_id"),
    }
    after = merge.purge({n: getattr(T, n) for n in PURGED_TABLES}, keys)
    parts = [after[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
             for n in PURGED_TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("prescription_append")
def q_prescription_append(spark, d):
    T = _t(spark, d)
    new = changes.prescription_changes(T).filter(F.col("quantity") > 0)
    rows = changes.price_prescriptions(
        new.select("prescription_id", F.col("report_date").cast("date").alias("report_date"),
                   F.lit(P.REP_ID).cast("long").alias("employee_id"), "customer_id", "product_id",
                   F.col("quantity").cast("int").alias("quantity")), T.product)
    return merge.append_rows(T.prescription, rows)


@register("price_prescriptions")
def q_price_prescriptions(spark, d):
    T = _t(spark, d)
    ch = changes.prescription_changes(T).withColumn("quantity", F.col("quantity").cast("int"))
    return changes.price_prescriptions(ch, T.product)


@register("gate_changes")
def q_gate_changes(spark, d):
    return changes.gate_report(_t(spark, d), P.REP_VIEWER)


@register("apply_sales")
def q_apply_sales(spark, d):
    T = _t(spark, d)
    return changes.apply_changes("sales", changes.sales_changes(T), T, P.REP_VIEWER)[0]


@register("apply_sales_refused")
def q_apply_sales_refused(spark, d):
    T = _t(spark, d)
    return changes.apply_changes("sales", changes.sales_changes(T), T, P.REP_VIEWER)[1].drop("seq")


@register("apply_prescriptions")
def q_apply_prescriptions(spark, d):
    T = _t(spark, d)
    return changes.apply_changes("prescriptions", changes.prescription_changes(T), T, P.MANAGER_VIEWER)[0]


@register("apply_tenders")
def q_apply_tenders(spark, d):
    T = _t(spark, d)
    return changes.apply_changes("tenders", changes.tender_changes(T), T, P.REP_VIEWER, as_of=P.AS_OF)[0]


@register("apply_tenders_refused")
def q_apply_tenders_refused(spark, d):
    T = _t(spark, d)
    return changes.apply_changes("tenders", changes.tender_changes(T), T, P.REP_VIEWER,
                                 as_of=P.AS_OF)[1].drop("seq")


# ----------------------------------------------------------- quality
@register("orphans")
def q_orphans(spark, d):
    return quality.orphans(_t(spark, d))


@register("domain_checks")
def q_domain_checks(spark, d):
    return quality.domain_checks(_t(spark, d))


@register("duplicate_keys")
def q_duplicate_keys(spark, d):
    return quality.duplicate_keys(_t(spark, d))


def _damaged(spark, d):
    return DamagedTables(spark, d)


@register("orphans_damaged")
def q_orphans_damaged(spark, d):
    return quality.orphans(_damaged(spark, d))


@register("domain_checks_damaged")
def q_domain_checks_damaged(spark, d):
    return quality.domain_checks(_damaged(spark, d))


@register("duplicate_keys_damaged")
def q_duplicate_keys_damaged(spark, d):
    return quality.duplicate_keys(_damaged(spark, d))


@register("role_fold")
def q_role_fold(spark, d):
    T = _t(spark, d)
    from fieldlens.functions.text import normalise_role, normalise_status
    e = T.employee
    raw_role = F.when(F.col("employee_id") % 7 == 1, "Admin").when(F.col("employee_id") % 7 == 2, "Manager") \
        .when(F.col("employee_id") % 7 == 3, "MR").otherwise(F.col("role"))
    return e.select("employee_id", raw_role.alias("raw_role"), normalise_role(raw_role).alias("role"),
                    normalise_status(F.when(F.col("employee_id") % 5 == 0, F.lit(None))
                                     .otherwise(F.col("status"))).alias("status"))


# ----------------------------------------------------------- sheet ingest

RAW = ingest.H  # short key -> sheet header


def _numbered(T):
    return ingest.numbered_sheet(T)


def _english(raw):
    return raw.select("source_row", *[F.col(f"`{h}`").alias(f"raw_{k}") for k, h in RAW.items()])


def _sheet_text(T, *more):
    """The rendered sheet staged as text, for what writes or sends it several times."""
    rows = ingest.numbered_rows(T)
    sheet = ingest.numbered_sheet(T, rows).select(*[F.col(f"`{h}`") for h in SHEET_HEADERS], "source_row", *more)
    sheet = staged(in_slices(sheet, ["source_row"], rows.count()), "sheet")
    unstage(rows)
    return sheet


def _normalised(T, rows=None):
    own = ingest.numbered_rows(T) if rows is None else rows
    both = ingest.normalise_sheet(ingest.numbered_sheet(T, own), rows=own.count())
    if rows is None:
        unstage(own)
    return both


def _accepted(T, rows=None):
    return _normalised(T, rows)[0]


def _resolved(T, rows=None):
    return ingest.with_resolved_ids(_accepted(T, rows), T)


def _previous(T, resolved):
    row = F.col("source_row")
    base = resolved.filter(row % 10 != 0).withColumn(
        "sales", F.when(row % 7 == 0, (F.col("sales") + 1).cast(SHEET_MONEY)).otherwise(F.col("sales")))
    # Some rows come again under another number: both from one pass over the rows.
    prev = base.withColumn("source_row", F.explode(F.when(row % 10 == 5, F.array(row, row + BIG)).otherwise(F.array(row))))
    return (prev.withColumn("row_hash", ingest.row_hash())
            .withColumn("source_id", F.when(F.col("source_row") % 10 == 3, "other").otherwise("sheet")))


@register("sheet_row_number")
def q_sheet_row_number(spark, d):
    return _english(_numbered(_t(spark, d)))


@register("sheet_normalise")
def q_sheet_normalise(spark, d):
    return _accepted(_t(spark, d))


@register("sheet_rejects")
def q_sheet_rejects(spark, d):
    return _normalised(_t(spark, d))[1]


@register("locale_number")
def q_locale_number(spark, d):
    raw = _english(_numbered(_t(spark, d)))
    specs = {"month": ("raw_month", False), "year": ("raw_year", False), "quantity": ("raw_qty", False),
             "unit_price": ("raw_price", False), "revenue": ("raw_revenue", False),
             "coefficient": ("raw_coef", True), "sales": ("raw_sales", False)}
    return with_locale_numbers(raw, specs).select("source_row", *specs)


@register("doc_date")
def q_doc_date(spark, d):
    raw = _english(_numbered(_t(spark, d)))
    return raw.select("source_row", "raw_doc_date", parse_doc_date("raw_doc_date").alias("doc_date"))


@register("slug")
def q_slug(spark, d):
    raw = _english(_numbered(_t(spark, d)))
    return raw.select("source_row", slug("raw_province").alias("province_slug"),
                      slug("raw_group").alias("group_slug"), slug("raw_cust_code").alias("customer_slug"))


@register("customer_type")
def q_customer_type(spark, d):
    raw = _english(_numbered(_t(spark, d)))
    return raw.select("source_row", "raw_group", customer_type("raw_group").alias("customer_type"))


@register("pad_code")
def q_pad_code(spark, d):
    raw = _english(_numbered(_t(spark, d)))
    return raw.select("source_row", "raw_emp_code", pad_code("raw_emp_code").alias("employee_code"))


@register("resolve_codes")
def q_resolve_codes(spark, d):
    return _resolved(_t(spark, d)).select("source_row", "territory_id", "employee_id", "customer_id", "product_id")


def _derived(spark, d, name):
    T = _t(spark, d)
    return ingest.derive_masters(_resolved(T), T)[name]


@register("derive_territory")
def q_derive_territory(spark, d):
    return _derived(spark, d, "territory")


@register("derive_employee")
def q_derive_employee(spark, d):
    return _derived(spark, d, "employee")


@register("derive_customer")
def q_derive_customer(spark, d):
    return _derived(spark, d, "customer")


@register("derive_product")
def q_derive_product(spark, d):
    return _derived(spark, d, "product")


@register("derive_assignments")
def q_derive_assignments(spark, d):
    return _derived(spark, d, "employee_customer")


@register("import_stats")
def q_import_stats(spark, d):
    return ingest.import_stats(_resolved(_t(spark, d)))


@register("import_stats_by_source")
def q_import_stats_by_source(spark, d):
    T = _t(spark, d)
    return ingest.import_stats(_previous(T, _resolved(T)), ["source_id"])


@register("sheet_profile")
def q_sheet_profile(spark, d):
    T = _t(spark, d)
    rows = ingest.numbered_rows(T)
    return ingest.sheet_profile(ingest.numbered_sheet(T, rows), rows.count())


@register("sheet_samples")
def q_sheet_samples(spark, d):
    return ingest.sheet_samples(_numbered(_t(spark, d)))


@register("reconcile_import")
def q_reconcile_import(spark, d):
    T = _t(spark, d)
    numbered = ingest.numbered_rows(T)
    rows = _accepted(T, numbered)
    return ingest.reconcile_import(ingest.sheet_profile(ingest.numbered_sheet(T, numbered), numbered.count()),
                                   ingest.import_stats(rows, ids=ingest.resolved_codes(rows, T)))


def _snapshot(spark, d):
    T = _t(spark, d)
    resolved = _resolved(T)
    return ingest.replace_snapshot(_previous(T, resolved), resolved, "sheet")


@register("snapshot_diff")
def q_snapshot_diff(spark, d):
    return _snapshot(spark, d)[1]


@register("changed_rows")
def q_changed_rows(spark, d):
    return _snapshot(spark, d)[1].filter(F.col("change") == "updated")


#: Rows of the test sheet that go into one CSV file.
SHEET_FILE_ROWS = 10_000


def _sheet_files(T, rows):
    """The test sheet as compressed CSV files of consecutive rows; (paths, expression for the row's number in the whole sheet)."""
    folder = scratch_path(T.spark, "sheet-files") + "/data"
    row = F.col("source_row") - 2
    sheet = ingest.numbered_sheet(T, rows).withColumn("chunk", F.floor(row / SHEET_FILE_ROWS))
    for part in in_slices(sheet, ["chunk"], rows.count()):
        with shuffles_freed(T.spark):
            (part.repartition("chunk").sortWithinPartitions("chunk", "source_row")
             .select("chunk", *[F.col(f"`{h}`") for h in SHEET_HEADERS]).write.mode("append").partitionBy("chunk")
             .option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
             .option("compression", "gzip").csv(folder))
    chunk = F.regexp_extract("source_file", "chunk=(\\d+)", 1).try_cast("long")
    return f"{folder}/*/*.csv.gz", (F.coalesce(chunk, F.lit(0)) * SHEET_FILE_ROWS + F.col("source_row")).alias("source_row")


@register("sheet_import")
def q_sheet_import(spark, d):
    """A stored sheet of two sources; the files of one are imported and swapped in, the pointer is read."""
    T = _t(spark, d)
    table = VersionedTable(spark, scratch_path(spark, "sheet-table") + "/sheet")
    numbered = ingest.numbered_rows(T)
    accepted = _accepted(T, numbered)
    count = accepted.count()
    resolved = staged(in_slices(ingest.with_resolved_ids(accepted, T), ["source_row"], count), "resolved")
    unstage(accepted)
    previous = _previous(T, resolved).withColumn("batch_id", F.lit("run-0"))
    for source in ("other", "sheet"):
        mine = ingest.stored_sheet(previous.filter(F.col("source_id") == source).drop("source_id"), source)
        table.replace(in_slices(mine, ["source_row"], count), source, ["period"])
    unstage(resolved)
    paths, row = _sheet_files(T, numbered)
    unstage(numbered)
    ingest.import_files_to_table(table, paths, T, "sheet", "run-1")
    return VersionedTable(spark, table.root).read().select("source_id", row, "employee_id", "customer_id", "product_id",
                                                           "period", "sales", "row_hash")


# ----------------------------------------------------------- standard imports


def _import_query(resource):
    def q(spark, d):
        return ingest.import_resource_rows(_t(spark, d), resource)[0]
    return q


for _res in RESOURCES:
    register(f"import_{_res}")(_import_query(_res))


def _route_query(resource):
    def q(spark, d):
        return imports.routed(_t(spark, d), resource)
    return q


def _load_query(resource):
    def q(spark, d):
        T = _t(spark, d)
        return imports.load_resource(ingest.resource_raw(T, resource, damaged=True), RESOURCES[resource], T,
                                     imports.stored_table(T, resource))[0]
    return q


for _res in RESOURCES:
    register(f"route_{_res}")(_route_query(_res))
for _res in ("territories", "products", "customers", "employees", "tenders"):
    register(f"load_{_res}")(_load_query(_res))


@register("import_outcomes")
def q_import_outcomes(spark, d):
    return imports.import_outcomes(_t(spark, d))


@register("import_rejects")
def q_import_rejects(spark, d):
    T = _t(spark, d)
    parts = [ingest.import_resource_rows(T, r)[1].groupBy("error").agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(r).alias("resource"), "error", "rows") for r in RESOURCES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("alias_pick")
def q_alias_pick(spark, d):
    raw = ingest.resource_raw(_t(spark, d), "customers")
    return raw.select(_pick(raw, ["id_khach_hang", "id"]).alias("customer_id"),
                      _pick(raw, ["ten_khach_hang", "name"], "unknown").alias("customer_name"))


@register("strict_number")
def q_strict_number(spark, d):
    raw = ingest.resource_raw(_t(spark, d), "products")
    return raw.select(_pick(raw, ["id_san_pham", "id"]).alias("product_id"),
                      _strict(_pick(raw, ["gia_ke_don", "prescriptionPrice"]), 0).alias("price"))


@register("parse_bool")
def q_parse_bool(spark, d):
    raw = ingest.resource_raw(_t(spark, d), "employeeTerritories")
    return raw.select(F.col("id_nhan_vien").alias("raw_employee"), F.col("is_primary").alias("raw_primary"),
                      _bool(_pick(raw, ["is_primary", "isPrimary"])).alias("is_primary"))


# ----------------------------------------------------------- sources, sinks, stream, misc


@register("reconcile_detail")
def q_reconcile_detail(spark, d):
    T = _t(spark, d)
    return dashboard.reconcile_detail(T, P.MANAGER_VIEWER, P.PERIOD, sheet=T.sheet_sales_nullkey)


@register("csv_roundtrip")
def q_csv_roundtrip(spark, d):
    T = _t(spark, d)
    path = csvio.write_resource_csv(T.customer, scratch_path(spark, "csv-customer") + "/data")
    return csvio.read_resource_csv(spark, path)


@register("csv_scan")
def q_csv_scan(spark, d):
    T = _t(spark, d)
    rows = ingest.numbered_rows(T)
    sheet = in_slices(ingest.numbered_sheet(T, rows), ["source_row"], rows.count())
    path = csvio.write_resource_csv(sheet, scratch_path(spark, "csv-sheet") + "/data", compression="gzip")
    unstage(rows)
    raw = csvio.read_resource_csv(spark, path)
    return raw.select(F.col("source_row").cast("long").alias("source_row"),
                      *[F.col(f"`{h}`").alias(f"raw_{k}") for k, h in RAW.items()])


@register("align_schema")
def q_align_schema(spark, d):
    from pyspark.sql import types as TT
    schema = TT.StructType([TT.StructField("employee_id", TT.LongType()),
                            TT.StructField("employee_name", TT.StringType()),
                            TT.StructField("email", TT.StringType()),
                            TT.StructField("role", TT.StringType()),
                            TT.StructField("status", TT.StringType()),
                            TT.StructField("sale_code", TT.StringType()),
                            TT.StructField("sale_group", TT.StringType())])
    return merge.align_schema(_t(spark, d).employee, schema, {"sale_group": "NONE", "status": "Active"})


@register("import_log")
def q_import_log(spark, d):
    return ingest.log_batch(None, "run-1", _resolved(_t(spark, d)), "Completed")


@register("sheet_stream")
def q_sheet_stream(spark, d):
    from fieldlens.streaming.sheet_stream import read_sheet_table, stream_sheet
    T = _t(spark, d)
    root = scratch_path(spark, "sheet-stream")
    chunks = f"{root}/incoming"
    sheet = _sheet_text(T)
    csvio.write_resource_csv(sheet, chunks, mode="append", compression="gzip")
    # The same rows sent again later (a retried chunk): the import must stay idempotent.
    csvio.write_resource_csv(sheet.filter(F.col("source_row") % 5 == 0), chunks, mode="append", compression="gzip")
    query = stream_sheet(spark, chunks, f"{root}/table", f"{root}/checkpoint")
    query.awaitTermination()
    return read_sheet_table(spark, f"{root}/table", ["source_row", "period", "sales", "row_hash"])


def _upload(spark, d):
    """Three chunks of one batch, one of them sent again and one epoch replayed, a close, then a late chunk."""
    from fieldlens.streaming.sheet_stream import UploadSession
    root = scratch_path(spark, "upload")
    session = UploadSession(spark, f"{root}/session")
    sheet = _sheet_text(_t(spark, d), F.lit("batch-1").alias("batch_id"))
    third = F.col("source_row") % 3
    again = F.col("source_row") % 15 == 0  # rows of the first chunk that come again with the second
    chunks = [sheet.filter(third == 0), sheet.filter((third == 1) | again), sheet.filter(third == 2)]
    for chunk in chunks:
        csvio.write_resource_csv(chunk, f"{root}/incoming", mode="append", compression="gzip")
        session.start(f"{root}/incoming").awaitTermination()
    session.merge(chunks[1], 1)
    session.close("batch-1")
    csvio.write_resource_csv(sheet.filter(F.col("source_row") % 7 == 0), f"{root}/incoming", mode="append",
                             compression="gzip")
    session.start(f"{root}/incoming").awaitTermination()
    return session


@register("upload_session")
def q_upload_session(spark, d):
    return _upload(spark, d).sheet.read().select("source_row", "period", "sales", "row_hash")


@register("upload_refused")
def q_upload_refused(spark, d):
    return _upload(spark, d).refused.read().select("batch_id", "source_row", "epoch", "reason")


@register("upload_log")
def q_upload_log(spark, d):
    return _upload(spark, d).log().select("batch_id", "chunks", "accepted", "rejected", "refused", "status",
                                          (F.col("finished") >= F.col("started")).alias("finished"))


@register("active_managers")
def q_active_managers(spark, d):
    from fieldlens.operators.scope import active_manager_count
    return active_manager_count(_t(spark, d).employee)


EXPORTED = ["territory", "employee", "product", "customer", "employee_territory", "employee_customer",
            "prescription", "tender", "daily_report", "kpi_target"]


@register("export_snapshot")
def q_export_snapshot(spark, d):
    """Write every exported table as JSON, read the folders back, count rows per table."""
    T = _t(spark, d)
    tables = {n: getattr(T, n) for n in EXPORTED}
    tables["sales"] = sales.combined_sales(T, variant="export")
    root = scratch_path(spark, "export")
    csvio.export_snapshot(tables, root, compression="gzip")
    parts = [spark.read.json(f"{root}/{n}").agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(n).alias("table_name"), "rows") for n in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("upsert_written")
def q_upsert_written(spark, d):
    """M1 written: the manual table stored by period; a change batch rewrites the files that hold its keys."""
    T = _t(spark, d)
    table = VersionedTable(spark, scratch_path(spark, "manual-table") + "/manual_sales")
    table.replace(T.manual_sales, partition_cols=["period"])
    table.upsert(manual_changes(T), ["period", "customer_id", "product_id"], "seq", ["period"])
    return table.read().select("period", "customer_id", "product_id", "employee_id", "amount", "source_note")


@register("upsert_moved")
def q_upsert_moved(spark, d):
    """M1 written: the latest manual sale of each customer and product, stored by period; changes move it on."""
    T = _t(spark, d)
    keys = ["customer_id", "product_id"]
    table = VersionedTable(spark, scratch_path(spark, "latest-table") + "/latest_sales")
    table.replace(latest_per_key(T.manual_sales, keys, ["period"]), partition_cols=["period"])
    changes = manual_changes(T).withColumn("seq", F.struct("period", "seq"))
    table.upsert(changes, keys, "seq", ["period"])
    return table.read().select("period", "customer_id", "product_id", "employee_id", "amount", "source_note")
