"""Apply tables of operational changes.

A web form post of the source system becomes one row of a change table. The
pipeline per kind: validity (F14) -> write gate (F12) -> active product ->
pricing (P17) -> upsert or append. The acting user becomes the owner of the
rows. Every refused row is returned with its reason; nothing is dropped
silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.text import blank_to_null
from fieldlens.operators.merge import append_rows, upsert
from fieldlens.operators.scope import gate_changes
from fieldlens.schema import MONEY, TENDER_STATUSES
from fieldlens.session import Viewer


def valid_change(kind: str):
    """shape checks of one change row, as a boolean Column."""
    present = lambda c: blank_to_null(F.col(c).cast("string")).isNotNull()
    if kind == "sales":
        return (F.coalesce(F.col("period").rlike(r"^\d{4}-\d{2}$"), F.lit(False))
                & present("customer_id") & present("product_id")
                & F.col("amount").isNotNull() & (F.col("amount") >= 0))
    if kind == "prescriptions":
        q = F.col("quantity")
        return (F.coalesce(F.col("report_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
                & F.col("report_date").try_cast("date").isNotNull()  # the calendar's dates only
                & present("customer_id") & present("product_id")
                & q.isNotNull() & (q == F.floor(q)) & (q > 0) & (q <= 2**31 - 1))
    if kind == "tenders":
        due = blank_to_null(F.col("due_date").cast("string"))  # optional; the calendar's dates only
        return (present("tender_id") & present("customer_id") & present("product_id") & present("status")
                & (F.coalesce(F.col("quantity"), F.lit(0)) >= 0)
                & (F.coalesce(F.col("bid_price"), F.lit(0)) >= 0)
                & (due.isNull() | due.rlike(r"^\d{4}-\d{2}-\d{2}$") & due.try_cast("date").isNotNull()))
    raise ValueError(kind)


def _split(df: DataFrame, cond, reason: str) -> tuple[DataFrame, DataFrame]:
    flagged = df.withColumn("_ok", F.coalesce(cond, F.lit(False)))
    return (flagged.filter("_ok").drop("_ok"),
            flagged.filter(~F.col("_ok")).drop("_ok").withColumn("reason", F.lit(reason)))


def _active_products(T) -> DataFrame:
    return T.product.filter(F.col("status") == "Active").select("product_id", "price")


def price_prescriptions(changes: DataFrame, product: DataFrame) -> DataFrame:
    """amount = quantity x price of an active product (inner join drops the rest)."""
    p = product.filter(F.col("status") == "Active").select("product_id", "price")
    return (changes.join(p, "product_id")
            .withColumn("amount", (F.col("quantity").cast(MONEY) * F.col("price")).cast(MONEY))
            .drop("price"))


def apply_changes(kind: str, changes: DataFrame, T, viewer: Viewer, as_of=None):
    """Returns (resulting table, refused rows with ``reason``)."""
    ok, bad = _split(changes, valid_change(kind), "invalid")
    existing = T.tender if kind == "tenders" else None
    allowed, outside = gate_changes(ok, T, viewer, existing=existing,
                                    key="tender_id" if kind == "tenders" else None)
    prod = _active_products(T)
    good = allowed.join(prod.select("product_id"), "product_id", "left_semi")
    inactive = allowed.join(prod.select("product_id"), "product_id", "left_anti") \
        .withColumn("reason", F.lit("product inactive"))
    refused = bad.unionByName(outside).unionByName(inactive)
    target = {"sales": T.manual_sales, "prescriptions": T.prescription, "tenders": T.tender}[kind]
    owner = F.lit(viewer.employee_id).cast(target.schema["employee_id"].dataType)

    if kind == "sales":
        rows = good.select("period", "customer_id", "product_id", owner.alias("employee_id"),
                           F.col("amount").cast(MONEY).alias("amount"), F.lit("Website").alias("source_note"),
                           "seq")
        return upsert(T.manual_sales, rows, ["period", "customer_id", "product_id"], "seq"), refused
    if kind == "prescriptions":
        rows = good.select(F.col("prescription_id"), F.col("report_date").cast("date").alias("report_date"),
                           owner.alias("employee_id"), "customer_id", "product_id",
                           F.col("quantity").cast("int").alias("quantity"))
        return append_rows(T.prescription, price_prescriptions(rows, T.product)), refused
    if kind == "tenders":
        rows = good.select("tender_id", "customer_id", "product_id",
                           F.coalesce("quantity", F.lit(0)).cast("long").alias("quantity"),
                           F.coalesce("bid_price", F.lit(0)).cast(MONEY).alias("bid_price"),
                           "status", owner.alias("employee_id"),
                           blank_to_null(F.col("due_date").cast("string")).cast("date").alias("due_date"),
                           F.lit(str(as_of)).cast("date").alias("updated_date"), "seq")
        return upsert(T.tender, rows, ["tender_id"], "seq"), refused
    raise ValueError(kind)


# ------------------------------------------------------------ change tables
# Change tables derived from the driver tables, so their size grows with them.

def sales_changes(T) -> DataFrame:
    s = T.sheet_sales.filter(F.col("order_key") % 17 == 0)
    return s.select("period", "customer_id", "product_id",
                    F.col("sales").cast(MONEY).alias("amount"),
                    F.struct("order_key", "line_number", "sales").alias("seq"))


def prescription_changes(T) -> DataFrame:
    s = T.sheet_sales.filter(F.col("order_key") % 19 == 0)
    return s.select(F.concat_ws("-", F.lit("new"), F.col("order_key").cast("string"),
                                F.col("line_number").cast("string")).alias("prescription_id"),
                    F.date_format("doc_date", "yyyy-MM-dd").alias("report_date"),
                    "customer_id", "product_id",
                    (F.col("quantity") - F.lit(10)).alias("quantity"))


def tender_changes(T) -> DataFrame:
    t = T.tender.filter(F.col("tender_id") % 9 == 0)
    first = t.select("tender_id", "customer_id", "product_id", "quantity", "bid_price",
                     F.lit("TrungThau").alias("status"), F.date_format("due_date", "yyyy-MM-dd").alias("due_date"),
                     F.lit(1).alias("seq"))
    third = t.filter(F.col("tender_id") % 4 == 3).select(  # blank and impossible due dates
        "tender_id", "customer_id", "product_id", "quantity", "bid_price", F.lit("ChoKetQua").alias("status"),
        F.when(F.col("tender_id") % 8 == 3, F.lit("2024-02-30")).otherwise(F.lit(" ")).alias("due_date"),
        F.lit(3).alias("seq"))
    second = t.filter(F.col("tender_id") % 2 == 0).select(
        "tender_id", (F.col("customer_id") + 1).alias("customer_id"), "product_id",
        (F.col("quantity") - 100).alias("quantity"), "bid_price",
        F.lit("TruotThau").alias("status"), F.lit(None).cast("string").alias("due_date"), F.lit(2).alias("seq"))
    return first.unionByName(second).unionByName(third)


def gate_report(T, viewer: Viewer) -> DataFrame:
    """F12 alone: every sales change with its gate outcome."""
    ch = sales_changes(T)
    allowed, refused = gate_changes(ch, T, viewer)
    return (allowed.withColumn("allowed", F.lit(True))
            .unionByName(refused.drop("reason").withColumn("allowed", F.lit(False)))
            .drop("seq"))


__all__ = ["apply_changes", "valid_change", "price_prescriptions", "sales_changes",
           "prescription_changes", "tender_changes", "gate_report", "TENDER_STATUSES"]
