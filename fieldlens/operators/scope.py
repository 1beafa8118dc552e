"""Row visibility (F5-F8) and the write gate for change tables.

Managers see every row: the filter is simply omitted so Catalyst plans the
unfiltered scan. A rep sees rows they own whose customer is assigned to them;
the assignment side is first filtered to the one viewer, so it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.session import Viewer


def viewer_assignments(T, viewer: Viewer) -> DataFrame:
    ec = T.employee_customer
    return ec.filter(F.col("employee_id") == F.lit(viewer.employee_id)).select("customer_id")


def owned(df: DataFrame, viewer: Viewer, col: str = "employee_id") -> DataFrame:
    """A rep sees only their own rows."""
    if viewer.is_manager:
        return df
    return df.filter(F.col(col) == F.lit(viewer.employee_id))


def scope_rows(df: DataFrame, T, viewer: Viewer) -> DataFrame:
    """own rows whose customer is assigned to the viewer (EXISTS -> semi join)."""
    if viewer.is_manager:
        return df
    kept = owned(df, viewer).join(viewer_assignments(T, viewer), "customer_id", "left_semi")
    return kept.select(*df.columns)


def scope_customers(T, viewer: Viewer, customers: DataFrame | None = None) -> DataFrame:
    """all customers for a manager, assigned customers for a rep."""
    customers = T.customer if customers is None else customers
    if viewer.is_manager:
        return customers
    return customers.join(viewer_assignments(T, viewer), "customer_id", "left_semi").select(*customers.columns)


def gate_changes(changes: DataFrame, T, viewer: Viewer, existing: DataFrame | None = None,
                 key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """a rep may change a row only for an assigned, active customer.

    For tenders the row already stored under the same key must pass the same
    test (``existing`` with ``key``). Returns (allowed, refused); refused rows
    carry a ``reason``.
    """
    if viewer.is_manager:
        return changes, changes.limit(0).withColumn("reason", F.lit(None).cast("string"))
    active = T.customer.filter(F.col("status") == "Active").select("customer_id")
    allowed_customers = viewer_assignments(T, viewer).join(active, "customer_id", "left_semi").distinct()
    # One flag join instead of a set difference: each change row is kept or refused in one pass.
    marked = changes.join(allowed_customers.withColumn("_cust_ok", F.lit(True)), "customer_id", "left")
    ok_cond = F.coalesce(F.col("_cust_ok"), F.lit(False))
    if existing is not None and key is not None:
        prior = existing.select(key, F.col("customer_id").alias("_prior_customer"))
        prior_bad = (prior.join(allowed_customers.withColumnRenamed("customer_id", "_prior_customer"),
                                "_prior_customer", "left_anti")
                     .select(key).distinct().withColumn("_prior_bad", F.lit(True)))
        marked = marked.join(prior_bad, key, "left")
        ok_cond = ok_cond & F.col("_prior_bad").isNull()
    else:
        marked = marked.withColumn("_prior_bad", F.lit(None).cast("boolean"))
    marked = marked.withColumn("_ok", ok_cond)
    cols = changes.columns
    ok = marked.filter(F.col("_ok")).select(*cols)
    refused = marked.filter(~F.col("_ok")).select(*cols).withColumn("reason", F.lit("customer outside scope"))
    return ok, refused


def active(df: DataFrame, col: str = "status") -> DataFrame:
    """F4 (SQL form): rows whose status is exactly 'Active'."""
    return df.filter(F.col(col) == "Active")


def in_window(df: DataFrame, col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """half-open text-period window start <= p < end (either side may be open)."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(col) >= F.lit(start))
    if end is not None:
        cond = cond & (F.col(col) < F.lit(end))
    return df.filter(cond)


def resolved(df: DataFrame, id_cols=("customer_id", "product_id", "employee_id")) -> DataFrame:
    """drop rows with an unresolved (NULL) id."""
    return df.dropna(subset=list(id_cols))


def active_manager_count(employee: DataFrame) -> DataFrame:
    """One row, the number of active managers (the guard of M6)."""
    from fieldlens.schema import MANAGER_ROLES
    return (employee.filter((F.col("status") == "Active") & F.col("role").isin(*MANAGER_ROLES))
            .agg(F.count(F.lit(1)).alias("active_managers")))
