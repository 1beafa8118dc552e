"""Stored domain tables: the production layout of the tables the reports read.

``save_domain`` writes each domain table once as parquet under a root folder,
facts partitioned by month so period filters prune whole folders;
``StoredTables`` reads them back with the same attributes as ``views.Tables``,
so every plan in this package runs unchanged on stored tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Partition columns per table: facts by month, masters unpartitioned.
LAYOUT = {
    "territory": [],
    "employee": [],
    "employee_territory": [],
    "product": [],
    "customer": [],
    "employee_customer": [],
    "account": [],
    "sheet_sales": ["year", "month"],
    "manual_sales": ["period"],
    "prescription": ["report_month"],
    "tender": [],
    "daily_report": ["report_month"],
    "kpi_target": ["period"],
}
_DERIVED_PARTS = {"report_month": lambda: F.date_format("report_date", "yyyy-MM")}


def save_domain(T, root: str, tables=None) -> list[str]:
    """Write the domain tables under ``root``; returns the written folders."""
    written = []
    for name in tables or LAYOUT:
        df = getattr(T, name)
        parts = LAYOUT[name]
        for p in parts:
            if p in _DERIVED_PARTS and p not in df.columns:
                df = df.withColumn(p, _DERIVED_PARTS[p]())
        w = df.write.mode("overwrite")
        if parts:
            # Group each task's rows by folder without a shuffle: a hot month (a third of all
            # rows) stays spread over every task instead of landing in one writer.
            df = df.sortWithinPartitions(*parts)
            w = df.write.mode("overwrite").partitionBy(*parts)
        path = f"{root.rstrip('/')}/{name}"
        w.parquet(path)
        written.append(path)
    return written


class StoredTables:
    """Domain tables read from ``save_domain`` output (same attribute names as ``views.Tables``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}")
        # Partition values come back from folder names: pin their types instead of trusting inference.
        for col, typ in (("year", "int"), ("month", "int"), ("period", "string")):
            if col in LAYOUT[name]:
                df = df.withColumn(col, F.col(col).cast(typ))
        return df.drop("report_month") if "report_month" in df.columns else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in LAYOUT:
            df = self._read(name)
            object.__setattr__(self, name, df)
            return df
        raise AttributeError(name)

    @cached_property
    def sheet_sales_nullkey(self) -> DataFrame:
        s = self.sheet_sales
        return s.withColumn("product_id", F.when(F.col("product_id") % 101 == 0, F.lit(None).cast("long"))
                            .otherwise(F.col("product_id")))
