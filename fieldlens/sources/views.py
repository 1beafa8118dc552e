"""Domain tables derived from the driver's parquet tables.

The driver ships TPC-H-shaped tables; the field-sales domain (territories,
employees, customers, products, assignments, two sales sources,
prescriptions, tenders, daily reports, KPI targets, accounts) is defined over
them as DataFrame views. Each view is pruned and lazy: Catalyst pushes
projections into the parquet scans and only the columns a query touches are
read. The DuckDB text of the same views lives in ``fieldlens.oracle.views``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.schema import (CLINIC, COEFFICIENT, HEALTH_DEPT, HOSPITAL, MONEY,
                              SHEET_MONEY, SHEET_QTY)

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def pad_code_expr(c):
    """All-digit codes of at most six digits are left-padded to six."""
    return F.when(c.rlike(r"^\d{1,6}$"), F.lpad(c, 6, "0")).otherwise(c)


class Tables:
    """Lazily built domain DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------ masters
    @cached_property
    def territory(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return (n.join(r, n.n_regionkey == r.r_regionkey)
                .select(n.n_nationkey.alias("territory_id"), n.n_name.alias("territory_name"),
                        r.r_name.alias("region"), F.lit("Active").alias("status")))

    @cached_property
    def employee(self) -> DataFrame:
        s = self.raw("supplier")
        key = F.col("s_suppkey")
        return s.select(
            key.alias("employee_id"),
            F.col("s_name").alias("employee_name"),
            F.concat(F.lower(F.regexp_replace("s_name", "#", ".")), F.lit("@example.com")).alias("email"),
            F.when(key % 20 == 0, "QuanLy").otherwise("NhanVien").alias("role"),
            F.when(key % 17 == 3, "Inactive").otherwise("Active").alias("status"),
            pad_code_expr(key.cast("string")).alias("sale_code"),
        )

    @cached_property
    def employee_territory(self) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey", "s_nationkey")
        primary = s.select(F.col("s_suppkey").alias("employee_id"),
                           F.col("s_nationkey").alias("territory_id"), F.lit(True).alias("is_primary"))
        second = s.select(F.col("s_suppkey").alias("employee_id"),
                          ((F.col("s_nationkey") + 1) % 25).alias("territory_id"),
                          F.lit(False).alias("is_primary"))
        return primary.unionByName(second)

    @cached_property
    def product(self) -> DataFrame:
        p = self.raw("part")
        key = F.col("p_partkey")
        return p.select(
            key.alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("active_ingredient"),
            F.col("p_type").alias("dosage_code"),
            F.col("p_type").alias("dosage_form"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            F.when(key % 23 == 0, "Inactive").otherwise("Active").alias("status"),
            F.when(key % 7 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("SP"), key.cast("string"))).alias("sale_code"),
            F.lower("p_type").alias("unit"),
        )

    @cached_property
    def customer(self) -> DataFrame:
        c = self.raw("customer")
        key, seg = F.col("c_custkey"), F.col("c_mktsegment")
        return c.select(
            key.alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.when(seg.isin("HOUSEHOLD", "BUILDING"), CLINIC)
             .when(seg == "MACHINERY", HEALTH_DEPT).otherwise(HOSPITAL).alias("customer_type"),
            F.col("c_nationkey").alias("territory_id"),
            F.when(key % 29 == 0, "Inactive").otherwise("Active").alias("status"),
            F.when(key % 7 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("KH"), key.cast("string"))).alias("sale_code"),
            seg.alias("sale_group"),
        )

    @cached_property
    def employee_customer(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_suppkey")
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        pairs = li.join(o, li.l_orderkey == o.o_orderkey).select(
            F.col("l_suppkey").alias("employee_id"), F.col("o_custkey").alias("customer_id"))
        return pairs.filter((F.col("employee_id") + F.col("customer_id")) % 4 != 0).distinct()

    @cached_property
    def account(self) -> DataFrame:
        s = self.raw("supplier")
        return (s.filter(F.col("s_suppkey") % 3 != 0)
                .select(F.col("s_suppkey").alias("employee_id"), F.lower("s_name").alias("username")))

    # ------------------------------------------------------------ facts
    def _lines(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                         "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return li.join(o, li.l_orderkey == o.o_orderkey)

    @cached_property
    def sheet_sales(self) -> DataFrame:
        """Normalised sheet rows (one per lineitem), ids resolved."""
        doc_date = F.col("o_orderdate").cast("date")
        revenue = F.col("l_extendedprice").cast(SHEET_MONEY)
        coefficient = (F.lit(1).cast(COEFFICIENT) - F.col("l_discount").cast(COEFFICIENT)).cast(COEFFICIENT)
        line_sales = (revenue * coefficient).cast(SHEET_MONEY)
        return self._lines().select(
            F.col("l_orderkey").alias("order_key"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_suppkey").alias("employee_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_partkey").alias("product_id"),
            doc_date.alias("doc_date"),
            F.year(doc_date).alias("year"),
            F.month(doc_date).alias("month"),
            F.date_format(doc_date, "yyyy-MM").alias("period"),
            F.col("l_quantity").cast(SHEET_QTY).alias("quantity"),
            revenue.alias("revenue"),
            coefficient.alias("coefficient"),
            F.when(F.col("l_returnflag") == "R", -line_sales).otherwise(line_sales).alias("sales"),
        )

    @cached_property
    def sheet_sales_nullkey(self) -> DataFrame:
        """Variant with unresolved product ids on some rows (tests null handling)."""
        s = self.sheet_sales
        return s.withColumn("product_id", F.when(F.col("product_id") % 101 == 0, F.lit(None).cast("long"))
                            .otherwise(F.col("product_id")))

    @cached_property
    def sheet_detail(self) -> DataFrame:
        """Sheet rows with the descriptive text columns of the source sheet."""
        return self.detail_of(self.sheet_sales)

    def detail_of(self, s: DataFrame) -> DataFrame:
        """Attach names, codes and unit price to sheet rows (any extra columns of ``s`` are kept)."""
        sup = self.raw("supplier").select("s_suppkey", "s_name", "s_nationkey")
        nat = self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        reg = self.raw("region").select("r_regionkey", "r_name")
        cus = self.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
        par = self.raw("part").select("p_partkey", "p_name", "p_type", "p_retailprice")
        sup_geo = (sup.join(nat, sup.s_nationkey == nat.n_nationkey, "left")
                   .join(reg, F.col("n_regionkey") == reg.r_regionkey, "left")
                   .select("s_suppkey", "s_name", "n_name", "r_name"))
        return (s.join(sup_geo, s.employee_id == sup_geo.s_suppkey, "left")
                .join(cus, s.customer_id == cus.c_custkey, "left")
                .join(par, s.product_id == par.p_partkey, "left")
                .select(
                    s["*"],
                    F.col("r_name").alias("manager_name"),
                    pad_code_expr(s.employee_id.cast("string")).alias("employee_code"),
                    F.col("s_name").alias("employee_name"),
                    F.col("n_name").alias("province"),
                    F.col("c_mktsegment").alias("customer_group"),
                    F.concat(F.lit("KH"), s.customer_id.cast("string")).alias("customer_code"),
                    F.col("c_name").alias("customer_name"),
                    F.concat(F.lit("CT"), s.order_key.cast("string")).alias("external_doc"),
                    F.concat(F.lit("SP"), s.product_id.cast("string")).alias("product_code"),
                    F.col("p_name").alias("product_name"),
                    F.lower("p_type").alias("unit"),
                    F.col("p_retailprice").cast(SHEET_QTY).alias("unit_price"),
                ))

    @cached_property
    def manual_sales(self) -> DataFrame:
        s = self.sheet_sales.filter(F.col("order_key") % 11 == 0)
        return (s.groupBy("period", "customer_id", "product_id")
                .agg(F.max("employee_id").alias("employee_id"),
                     F.sum(F.abs("sales")).cast(MONEY).alias("amount"))
                .withColumn("source_note", F.lit("Website")))

    @cached_property
    def prescription(self) -> DataFrame:
        li = (self.raw("lineitem").filter((F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "R"))
              .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        p = self.raw("part").select("p_partkey", "p_retailprice")
        qty = F.col("l_quantity").cast("int")
        return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
                .select(
                    F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
                     .alias("prescription_id"),
                    F.col("l_shipdate").cast("date").alias("report_date"),
                    F.col("l_suppkey").alias("employee_id"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("l_partkey").alias("product_id"),
                    qty.alias("quantity"),
                    (qty.cast(MONEY) * F.col("p_retailprice").cast(MONEY)).cast(MONEY).alias("amount"),
                ))

    @cached_property
    def tender(self) -> DataFrame:
        li = (self.raw("lineitem").groupBy("l_orderkey")
              .agg(F.min("l_suppkey").alias("employee_id"), F.min("l_partkey").alias("product_id"),
                   F.sum("l_quantity").cast("long").alias("quantity")))
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
        pr = F.col("o_orderpriority")
        odate = F.col("o_orderdate").cast("date")
        return (o.join(li, o.o_orderkey == li.l_orderkey)
                .select(
                    F.col("o_orderkey").alias("tender_id"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("product_id"),
                    F.col("quantity"),
                    F.col("o_totalprice").cast(MONEY).alias("bid_price"),
                    F.when(pr == "1-URGENT", "DangLamHoSo").when(pr == "2-HIGH", "ChoKetQua")
                     .when(pr == "3-MEDIUM", "TrungThau").otherwise("TruotThau").alias("status"),
                    F.col("employee_id"),
                    F.date_add(odate, 14).alias("due_date"),
                    odate.alias("updated_date"),
                ))

    @cached_property
    def daily_report(self) -> DataFrame:
        e = self.raw("events").select("ts", "user_id")
        return (e.select(F.col("ts").cast("date").alias("report_date"), F.col("user_id").alias("employee_id"))
                .distinct()
                .withColumn("summary", F.concat(F.lit("report "), F.col("report_date").cast("string")))
                .withColumn("kpi_note", F.lit(None).cast("string")))

    @cached_property
    def kpi_target(self) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
        periods = self.spark.range(2).select(
            F.when(F.col("id") == 0, "2001-06").otherwise("2001-07").alias("period"))
        key = F.col("s_suppkey")
        return (s.crossJoin(F.broadcast(periods))  # two literal periods: fixed size
                .select("period", key.alias("employee_id"), F.col("s_nationkey").alias("territory_id"),
                        F.when(key % 2 == 0, F.lit(None).cast("long")).otherwise(key).alias("product_id"),
                        F.abs(F.col("s_acctbal")).cast(MONEY).alias("target_sales"),
                        F.col("s_nationkey").cast("int").alias("target_prescriptions")))


class DamagedTables(Tables):
    """The same tables with planted violations of the quality rules: lost parents, missing, long, shared and impossible
    values, repeated rows. The violations grow with the tables."""

    @cached_property
    def territory(self) -> DataFrame:
        t = super().territory
        return t.withColumn("region", F.when(F.col("territory_id") % 9 != 4, F.col("region")))

    @cached_property
    def employee(self) -> DataFrame:
        key = F.col("employee_id")
        return super().employee.withColumns({
            "employee_name": F.when(key % 31 != 7, F.col("employee_name")),
            "email": F.when(key % 13 == 5, "shared@example.com").when(key % 13 == 6, "no address")
                      .when(key % 13 == 7, F.concat(F.repeat(F.lit("x"), 250), F.lit("@example.com"))).otherwise(F.col("email")),
            "status": F.when(key % 17 == 2, "Gone").otherwise(F.col("status")),
        })

    @cached_property
    def employee_territory(self) -> DataFrame:
        t = super().employee_territory
        moved = t.withColumn("territory_id", F.when(F.col("employee_id") % 9 == 4, F.col("territory_id") + 100)
                             .otherwise(F.col("territory_id")))
        return moved.unionByName(moved.where("employee_id % 10 = 1 and is_primary"))

    @cached_property
    def product(self) -> DataFrame:
        key = F.col("product_id")
        # Two codes of neighbouring products that differ in a sign only, so their generated ids would be one.
        pair = F.concat(F.lit("MA"), F.floor(key / 2).cast("string"), F.when(key % 2 == 0, "-").otherwise("."), F.lit("z"))
        return super().product.withColumn("sale_code", F.when(key % 10 < 2, pair).otherwise(F.col("sale_code")))

    @cached_property
    def customer(self) -> DataFrame:
        key = F.col("customer_id")
        return super().customer.withColumns({
            "territory_id": F.when(key % 23 == 6, F.col("territory_id") + 50).when(key % 23 == 7, F.lit(None))
                             .otherwise(F.col("territory_id")),
            "customer_type": F.when(key % 29 == 3, "Khac").otherwise(F.col("customer_type"))})

    @cached_property
    def employee_customer(self) -> DataFrame:
        pairs = super().employee_customer
        return pairs.unionByName(pairs.where("customer_id % 19 = 3"))

    @cached_property
    def account(self) -> DataFrame:
        key = F.col("employee_id")
        return super().account.withColumns({
            "employee_id": F.when(key % 5 == 1, -key).otherwise(key),
            "username": F.when(key % 8 == 2, "shared").otherwise(F.col("username"))})

    @cached_property
    def sheet_sales(self) -> DataFrame:
        return super().sheet_sales.withColumns({
            "product_id": F.when(F.col("product_id") % 37 == 5, -F.col("product_id")).otherwise(F.col("product_id")),
            "employee_id": F.when(F.col("order_key") % 41 != 7, F.col("employee_id")),
            "month": F.when(F.col("order_key") % 43 == 1, 13).otherwise(F.col("month"))})

    @cached_property
    def prescription(self) -> DataFrame:
        return super().prescription.withColumns({
            "quantity": F.when(F.col("employee_id") % 8 == 3, 0).otherwise(F.col("quantity")),
            "amount": F.when(F.col("product_id") % 21 == 4, -F.col("amount")).otherwise(F.col("amount"))})

    @cached_property
    def tender(self) -> DataFrame:
        return super().tender.withColumn("updated_date", F.when(F.col("tender_id") % 14 != 2, F.col("updated_date")))

    @cached_property
    def kpi_target(self) -> DataFrame:
        key = F.col("employee_id")
        t = super().kpi_target.withColumns({
            "territory_id": F.when(key % 6 == 2, F.lit(99)).when(key % 6 != 3, F.col("territory_id")),
            "period": F.when(key % 12 == 5, F.concat(F.col("period"), F.lit("x"))).otherwise(F.col("period"))})
        return t.unionByName(t.where("employee_id % 15 = 1"))


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
