"""Dashboard.

The chosen period stays a one-row DataFrame (``bounds``) and is attached to
facts by a broadcast of that single row, so the dashboard is one lazy job;
nothing is collected to choose the period.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.paging import PERIOD_SHAPE
from fieldlens.operators.scope import scope_rows
from fieldlens.plans.alerts import bounds_from, lost_customers
from fieldlens.plans.sales import combined_sales
from fieldlens.schema import OPEN_TENDER_STATUSES, TOTAL
from fieldlens.session import Viewer, checkpoint_dir


def _materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small, bounded intermediate (checkpoint in the shared folder)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def check_period(period) -> str | None:
    """A period shaped YYYY-MM must also be a real month; other text means 'not given'."""
    if not isinstance(period, str) or not PERIOD_SHAPE.match(period):
        return None
    if not 1 <= int(period[5:7]) <= 12:
        raise ValueError(f"period {period!r} is not a month")
    return period


def prescription_period(df: DataFrame) -> DataFrame:
    return df.withColumn("period", F.date_format("report_date", "yyyy-MM"))


def available_periods(T, viewer: Viewer, combined: DataFrame | None = None) -> DataFrame:
    """Distinct periods of scoped sales UNION scoped prescriptions."""
    combined = combined_sales(T) if combined is None else combined
    s = scope_rows(combined, T, viewer).select("period")
    r = scope_rows(prescription_period(T.prescription), T, viewer).select("period")
    return s.union(r).distinct()


def chosen_period(periods: DataFrame, period=None, as_of=None) -> DataFrame:
    """One row: requested period if valid, else the latest available, else as_of's month."""
    p = check_period(period)
    spark = periods.sparkSession
    if p is not None:
        return spark.range(1).select(F.lit(p).alias("period"))
    as_of = as_of or _dt.date.today()
    fallback = F.date_format(F.lit(as_of).cast("date"), "yyyy-MM")
    return periods.agg(F.coalesce(F.max("period"), fallback).alias("period"))


def dashboard(T, viewer: Viewer, period=None, as_of=None) -> DataFrame:
    """R2: one row for a viewer: period, sales, prescriptions, open tenders, lost customers, periods.

    Facts are aggregated once per period (partial aggregates, a result of one
    row per month); the chosen period then only picks from those small
    frames. Only the lost-customer test needs the per-customer pass.
    """
    combined = combined_sales(T)
    s_by_p = scope_rows(combined, T, viewer).groupBy("period").agg(F.sum("amount").alias("sales"))
    r_by_p = (scope_rows(prescription_period(T.prescription), T, viewer).groupBy("period")
              .agg(F.sum("quantity").alias("prescription_quantity"), F.sum("amount").alias("prescription_amount")))
    # One row per month: materialised so the chosen period, the picked metrics and the
    # period list all read this small table instead of recomputing the facts.
    by_p = _materialise(s_by_p.join(r_by_p, "period", "full_outer"))
    s_by_p = by_p.select("period", "sales")
    r_by_p = by_p.select("period", "prescription_quantity", "prescription_amount")
    periods = by_p.select("period")
    chosen = chosen_period(periods, period, as_of)
    bounds = bounds_from(chosen)
    one = F.broadcast(chosen)  # single row

    picked = one.join(s_by_p, "period", "left").join(r_by_p, "period", "left").select(
        "period",
        F.coalesce("sales", F.lit(0)).cast(TOTAL).alias("sales"),
        F.coalesce("prescription_quantity", F.lit(0)).cast("long").alias("prescription_quantity"),
        F.coalesce("prescription_amount", F.lit(0)).cast(TOTAL).alias("prescription_amount"))
    tenders = (scope_rows(T.tender, T, viewer).filter(F.col("status").isin(*OPEN_TENDER_STATUSES))
               .agg(F.count(F.lit(1)).cast("long").alias("open_tenders")))
    lost = lost_customers(T, viewer, combined, bounds, owner_scope=True).agg(
        F.count(F.lit(1)).cast("long").alias("lost_sales"))
    plist = periods.agg(F.sort_array(F.collect_set("period"), asc=False).alias("available_periods"))
    # All inputs below are single rows (periods are months): the cross joins cost nothing.
    return picked.crossJoin(tenders).crossJoin(lost).crossJoin(plist)


def dashboard_by_rep(T, period=None, as_of=None) -> DataFrame:
    """The rep dashboard for every employee in one job.

    Each employee's period is their own latest (or the requested one). All
    metrics are grouped by employee after semi joins with the assignments, so
    the work is a handful of shuffles regardless of how many reps there are.
    """
    p = check_period(period)
    # The monthly combined frame feeds five aggregates below; materialise it once.
    combined = _materialise(combined_sales(T))
    ec = T.employee_customer.select("employee_id", "customer_id")
    emp = T.employee.select("employee_id")

    s = combined.join(ec, ["employee_id", "customer_id"], "left_semi")
    r = prescription_period(T.prescription).join(ec, ["employee_id", "customer_id"], "left_semi")
    t = T.tender.join(ec, ["employee_id", "customer_id"], "left_semi")

    if p is not None:
        per = emp.withColumn("period", F.lit(p))
    else:
        as_of = as_of or _dt.date.today()
        fallback = F.date_format(F.lit(as_of).cast("date"), "yyyy-MM")
        latest = s.select("employee_id", "period").union(r.select("employee_id", "period")) \
            .groupBy("employee_id").agg(F.max("period").alias("period"))
        per = emp.join(latest, "employee_id", "left").withColumn("period", F.coalesce("period", fallback))

    sales = (s.join(per, ["employee_id", "period"], "left_semi").groupBy("employee_id")
             .agg(F.sum("amount").cast(TOTAL).alias("sales")))
    rx = (r.join(per, ["employee_id", "period"], "left_semi").groupBy("employee_id")
          .agg(F.sum("quantity").cast("long").alias("prescription_quantity"),
               F.sum("amount").cast(TOTAL).alias("prescription_amount")))
    tenders = (t.filter(F.col("status").isin(*OPEN_TENDER_STATUSES)).groupBy("employee_id")
               .agg(F.count(F.lit(1)).cast("long").alias("open_tenders")))
    from fieldlens.plans.alerts import lost_pairs  # local: avoids an import cycle
    lost = (lost_pairs(T, combined, bounds_from(per, keys=["employee_id"]), assignments=ec)
            .groupBy("employee_id").agg(F.count(F.lit(1)).cast("long").alias("lost_sales")))
    out = (per.join(sales, "employee_id", "left").join(rx, "employee_id", "left")
           .join(tenders, "employee_id", "left").join(lost, "employee_id", "left"))
    return out.select(
        "employee_id", "period",
        F.coalesce("sales", F.lit(0).cast(TOTAL)).cast(TOTAL).alias("sales"),
        F.coalesce("prescription_quantity", F.lit(0)).cast("long").alias("prescription_quantity"),
        F.coalesce("prescription_amount", F.lit(0).cast(TOTAL)).cast(TOTAL).alias("prescription_amount"),
        F.coalesce("open_tenders", F.lit(0)).cast("long").alias("open_tenders"),
        F.coalesce("lost_sales", F.lit(0)).cast("long").alias("lost_sales"),
    )


def reconcile_detail(T, viewer: Viewer, period: str, sheet: DataFrame | None = None) -> DataFrame:
    """A10: dashboard total against the sum of the listed detail for one period.

    The list joins names with inner joins, so rows with unresolved ids count in
    the dashboard but not in the list; the difference reveals them.
    """
    from fieldlens.plans.listing import with_names
    p = check_period(period)
    combined = combined_sales(T, sheet=sheet)
    scoped = scope_rows(combined, T, viewer).filter(F.col("period") == F.lit(p))
    dash = scoped.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL).alias("dashboard_sales"),
                      F.count(F.lit(1)).alias("dashboard_rows"))
    detail = with_names(scoped, T).agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL).alias("detail_sales"),
                                       F.count(F.lit(1)).alias("detail_rows"))
    return dash.crossJoin(detail).select(  # two single rows
        F.lit(p).alias("period"), "dashboard_sales", "detail_sales", "dashboard_rows", "detail_rows",
        (F.col("dashboard_sales") == F.col("detail_sales")).alias("matches"))
