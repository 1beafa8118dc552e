"""Sheet rollups and the combined sales source (A1, A2, R1/U1, variants A and B).

Shuffle plan: the sheet is aggregated once on (period, customer, product,
employee) with a partial (map-side) hash aggregate, so every later step works
on the much smaller monthly frame. The precedence rule is an anti join on
three keys against the manual table; AQE broadcasts that side when its
runtime size is small and otherwise sort-merges. A hot customer or product is
harmless: the aggregate combines it map-side and AQE splits skewed join
partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.schema import SOURCE_MANUAL, SOURCE_SHEET, TOTAL

KEY4 = ["period", "customer_id", "product_id", "employee_id"]
KEY3 = ["period", "customer_id", "product_id"]


def period_of(year, month):
    """P13: 'YYYY-MM' from year and month columns."""
    return F.concat(F.col(year).cast("string") if isinstance(year, str) else year.cast("string"),
                    F.lit("-"), F.lpad((F.col(month) if isinstance(month, str) else month).cast("string"), 2, "0"))


def sheet_monthly(sheet: DataFrame) -> DataFrame:
    """A1: monthly rollup over ten group keys of the detailed sheet."""
    return (sheet.withColumn("period", period_of("year", "month"))
            .groupBy("period", "employee_id", "employee_code", "province", "customer_group",
                     "customer_id", "customer_code", "product_id", "product_code")
            .agg(F.max("employee_name").alias("employee_name"),
                 F.max("manager_name").alias("manager_name"),
                 F.max("customer_name").alias("customer_name"),
                 F.max("product_name").alias("product_name"),
                 F.max("unit").alias("unit"),
                 F.sum("quantity").cast("decimal(38,3)").alias("total_quantity"),
                 F.sum("revenue").cast(TOTAL).alias("total_revenue"),
                 F.sum("sales").cast(TOTAL).alias("total_sales"),
                 F.count(F.lit(1)).alias("line_count")))


def sheet_by_key(sheet: DataFrame) -> DataFrame:
    """A2: sales per (period, customer, product, employee), straight from the rows."""
    if "period" not in sheet.columns:
        sheet = sheet.withColumn("period", period_of("year", "month"))
    return sheet.groupBy(*KEY4).agg(F.sum("sales").cast(TOTAL).alias("amount"))


def combined_sales(T, variant: str = "report", sheet: DataFrame | None = None,
                   manual: DataFrame | None = None) -> DataFrame:
    """Sheet sales hidden by any manual row with the same key, plus the manual rows.

    variant "report" (A): rows with unresolved ids are kept, tags DATA_SALE/WEBSITE.
    variant "export" (B): rows with unresolved ids are dropped first, manual rows untagged.
    """
    sheet = T.sheet_sales if sheet is None else sheet
    manual = T.manual_sales if manual is None else manual
    monthly = sheet_by_key(sheet.select(*KEY4, "sales"))
    if variant == "export":
        monthly = monthly.dropna(subset=["customer_id", "product_id", "employee_id"])
    kept = monthly.join(manual.select(*KEY3), KEY3, "left_anti")
    sheet_part = kept.select(*KEY4, "amount", F.lit(SOURCE_SHEET).alias("source"))
    manual_tag = F.lit(SOURCE_MANUAL) if variant == "report" else F.lit(None).cast("string")
    manual_part = manual.select(*KEY4, F.col("amount").cast(TOTAL).alias("amount"), manual_tag.alias("source"))
    return sheet_part.unionByName(manual_part)
