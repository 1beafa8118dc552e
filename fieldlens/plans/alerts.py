"""Lost customers (R3, R3b) and missing-report reminders.

EXISTS(old sale) AND NOT EXISTS(recent sale) over the same relation is fused
into one grouped pass: per customer (or per employee and customer),
``max(amount > 0 AND period < start)`` and
``max(amount <> 0 AND start <= period < end)``. One shuffle on the group key
instead of two correlated joins; NULL amounts make both flags NULL, i.e.
false, as in SQL.

Where the window ends at the latest period of the same rows, three months per group say all: the latest, the first with
a sale and the last with any amount. They come from one hash aggregate of the combined sales (``sale_months``), which is
cut by a checkpoint of one row a group; the latest period and the lost groups are both read from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.paging import latest_periods
from fieldlens.operators.scope import owned, scope_customers
from fieldlens.plans.sales import combined_sales
from fieldlens.schema import (CLINIC, LOST_REASON, REMINDER_MIDDLE, REMINDER_PREFIX,
                              REMINDER_SUFFIX, REP_ROLES_LOOSE)
from fieldlens.session import Viewer, checkpoint_dir


def _month_start(period_col):
    return F.to_date(F.concat(period_col, F.lit("-01")))


def bounds_from(chosen: DataFrame, keys=(), months: int = 4) -> DataFrame:
    """Add the window [start, end) of ``months`` months ending at ``period``.

    Built from the first of the month, so month ends never shift the window.
    """
    first = _month_start(F.col("period"))
    return chosen.select(
        *keys, "period",
        F.date_format(F.add_months(first, -(months - 1)), "yyyy-MM").alias("start_period"),
        F.date_format(F.add_months(first, 1), "yyyy-MM").alias("end_period"))


def _flags(df: DataFrame, keys) -> DataFrame:
    amount, period = F.col("amount"), F.col("period")
    old = (amount > 0) & (period < F.col("start_period"))
    recent = (amount != 0) & (period >= F.col("start_period")) & (period < F.col("end_period"))
    return (df.groupBy(*keys)
            .agg(F.max(old).alias("had_old"), F.max(recent).alias("had_recent"))
            .filter(F.col("had_old") & ~F.coalesce(F.col("had_recent"), F.lit(False))))


def active_clinics(T, customers: DataFrame | None = None) -> DataFrame:
    c = T.customer if customers is None else customers
    return c.filter((F.col("customer_type") == CLINIC) & (F.col("status") == "Active"))


def lost_customers(T, viewer: Viewer, combined: DataFrame, bounds: DataFrame,
                   owner_scope: bool = True) -> DataFrame:
    """Active clinics in the viewer's customer scope, sold before the window, nothing in it."""
    sales = owned(combined, viewer) if owner_scope else combined
    b = F.broadcast(bounds.select("start_period", "end_period"))  # single row
    lost = _flags(sales.select("customer_id", "period", "amount").crossJoin(b), ["customer_id"])
    clinics = active_clinics(T, scope_customers(T, viewer))
    return (clinics.join(lost, "customer_id", "left_semi")
            .crossJoin(F.broadcast(bounds.select("period"))))


def month_number(period):
    """'yyyy-MM' as the number yyyyMM: the same order, but one that hash aggregates can hold."""
    return F.substring(period, 1, 4).try_cast("int") * 100 + F.substring(period, 6, 2).try_cast("int")


def month_text(number):
    return F.format_string("%04d-%02d", F.floor(number / 100), number % 100)


def months_before(number, months: int):
    """The month number ``months`` months before ``number``."""
    since = F.floor(number / 100) * 12 + number % 100 - 1 - months
    return F.floor(since / 12) * 100 + since % 12 + 1


def sale_months(sales: DataFrame, *keys: str) -> DataFrame:
    """(keys, latest, first_sold, last_active): per group the latest month, the first with an amount above 0 and the last
    with one other than 0, checkpointed."""
    m, amount = month_number(F.col("period")), F.col("amount")
    checkpoint_dir(sales.sparkSession)
    return (sales.groupBy(*keys).agg(F.max(m).alias("latest"), F.min(F.when(amount > 0, m)).alias("first_sold"),
                                     F.max(F.when(amount != 0, m)).alias("last_active")).checkpoint(eager=True))


def _lost(start):
    """Sold before ``start`` and nothing since."""
    return (F.col("first_sold") < start) & ~F.coalesce(F.col("last_active") >= start, F.lit(False))


def lost_sales(T, viewer: Viewer, combined: DataFrame | None = None, months: int = 4) -> DataFrame:
    """R3 (alert trigger): window ends at the latest period of the viewer's own sales."""
    combined = combined_sales(T) if combined is None else combined
    seen = sale_months(owned(combined, viewer), "customer_id")
    end = seen.agg(F.max("latest").alias("end")).filter(F.col("end").isNotNull())  # single row
    lost = seen.crossJoin(F.broadcast(end)).filter(_lost(months_before(F.col("end"), months - 1)))
    return (active_clinics(T, scope_customers(T, viewer)).join(lost.select("customer_id"), "customer_id", "left_semi")
            .crossJoin(F.broadcast(end.select(month_text(F.col("end")).alias("period"))))
            .select("customer_id", "customer_name", "period", F.lit(LOST_REASON).alias("reason")))


def lost_pairs(T, combined: DataFrame, bounds: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """Lost (employee, customer) pairs, each employee with its own window.

    ``bounds`` has one row per employee; AQE broadcasts it when small (it is
    one row per employee, not per sale) and otherwise splits skewed keys.
    """
    f = combined.select("employee_id", "customer_id", "period", "amount").join(
        bounds.select("employee_id", "start_period", "end_period"), "employee_id")
    lost = _flags(f, ["employee_id", "customer_id"])
    ec = T.employee_customer if assignments is None else assignments
    assigned = lost.join(ec, ["employee_id", "customer_id"], "left_semi")
    clinics = active_clinics(T).select("customer_id", "customer_name")
    return (assigned.join(clinics, "customer_id")
            .join(bounds.select("employee_id", "period"), "employee_id")
            .select("employee_id", "customer_id", "customer_name", "period"))


def lost_sales_by_rep(T, combined: DataFrame | None = None, months: int = 4) -> DataFrame:
    """R3 for every employee at once: union of the per-rep alert lists."""
    combined = combined_sales(T) if combined is None else combined
    seen = sale_months(combined, "employee_id", "customer_id")
    ends = seen.groupBy("employee_id").agg(F.max("latest").alias("end"))
    lost = seen.join(ends, "employee_id").filter(_lost(months_before(F.col("end"), months - 1)))
    clinics = active_clinics(T).select("customer_id", "customer_name")
    return (lost.join(T.employee_customer, ["employee_id", "customer_id"], "left_semi").join(clinics, "customer_id")
            .select("employee_id", "customer_id", "customer_name", month_text(F.col("end")).alias("period")))


def lost_sales_latest(T, viewer: Viewer | None = None, n: int = 4, min_periods: int = 4,
                      sales: DataFrame | None = None) -> DataFrame:
    """window = the latest ``n`` periods present in the data.

    Lost when some sale outside the window was > 0 and the window's sum is 0
    (no rows counts as 0). No status test. Empty when fewer than
    ``min_periods`` periods exist.
    """
    sales = combined_sales(T, variant="export") if sales is None else sales
    checkpoint_dir(sales.sparkSession)
    # One row a customer and month feeds both the latest periods and the flags.
    sales = (sales.groupBy("customer_id", "period")
             .agg(F.sum("amount").alias("amount"), F.max(F.col("amount") > 0).alias("sold")).checkpoint(eager=True))
    window = latest_periods(sales, n).withColumn("in_window", F.lit(True))
    enough = window.agg(F.count(F.lit(1)).alias("n_periods")).filter(F.col("n_periods") >= min_periods)
    flagged = sales.join(F.broadcast(window), "period", "left")
    in_w = F.coalesce(F.col("in_window"), F.lit(False))
    per_customer = (flagged.groupBy("customer_id")
                    .agg(F.max(~in_w & F.col("sold")).alias("had_earlier"),
                         F.sum(F.when(in_w, F.col("amount"))).alias("recent_total"))
                    .filter(F.col("had_earlier") & (F.coalesce(F.col("recent_total"), F.lit(0)) == 0)))
    customers = T.customer if viewer is None else scope_customers(T, viewer)
    clinics = customers.filter(F.col("customer_type") == CLINIC)
    return (clinics.join(per_customer, "customer_id", "left_semi")
            .crossJoin(F.broadcast(enough.select())).select("customer_id", "customer_name"))


def _reminder_message(name, date):
    return F.concat(F.lit(REMINDER_PREFIX), name, F.lit(REMINDER_MIDDLE), date, F.lit(REMINDER_SUFFIX))


def reminders(T, viewer: Viewer, as_of) -> DataFrame:
    """Active reps in scope with no daily report on ``as_of``.

    Manager: reps with at least one customer assignment; rep: only themselves.
    """
    day = F.lit(str(as_of)).cast("date")
    if viewer.is_manager:
        customers = scope_customers(T, viewer).select("customer_id")
        ids = T.employee_customer.join(customers, "customer_id", "left_semi").select("employee_id")
    else:
        ids = T.employee.select("employee_id").filter(F.col("employee_id") == F.lit(viewer.employee_id))
    status = F.col("status")
    emps = (T.employee.filter((status.isNull() | (status != "Inactive")) & (F.col("role") == "NhanVien"))
            .join(ids, "employee_id", "left_semi"))
    today = T.daily_report.filter(F.col("report_date") == day).select("employee_id")
    out = emps.join(today, "employee_id", "left_anti")
    date_text = F.date_format(day, "yyyy-MM-dd")
    return out.select("employee_id", "employee_name", "email", day.alias("report_date"),
                      _reminder_message(F.col("employee_name"), date_text).alias("message"))


def reminders_loose(T, as_of) -> DataFrame:
    """Every employee with a rep-like role and no report on ``as_of``."""
    day = F.lit(str(as_of)).cast("date")
    today = T.daily_report.filter(F.col("report_date") == day).select("employee_id")
    return (T.employee.filter(F.col("role").isin(*REP_ROLES_LOOSE))
            .join(today, "employee_id", "left_anti")
            .select("employee_id", "employee_name", "role"))
