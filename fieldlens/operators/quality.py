"""Data-quality reports (Q2-Q4): orphans, domain rules, duplicate keys.

Each table is read once per report. A child's foreign keys are laid out as (column, value) rows and counted before any
shuffle, so a value is one row a task however often it occurs; the distinct values of all children meet all parents'
keys in a single join. Rules are counted in one aggregate a table; several unique keys of a table in one grouping.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fieldlens.functions.text import slug
from fieldlens.schema import MANAGER_ROLES, REP_ROLES_LOOSE, TENDER_STATUSES

EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
CUSTOMER_TYPES = ("BenhVien", "PhongMachTu", "SoYTe")  # fixed values
PERIOD_SHAPE = r"^\d{4}-\d{2}$"

# (child table, column, parent table, parent key)
FOREIGN_KEYS = [
    ("customer", "territory_id", "territory", "territory_id"),
    ("account", "employee_id", "employee", "employee_id"),
    ("employee_territory", "employee_id", "employee", "employee_id"),
    ("employee_territory", "territory_id", "territory", "territory_id"),
    ("employee_customer", "employee_id", "employee", "employee_id"),
    ("employee_customer", "customer_id", "customer", "customer_id"),
    ("prescription", "employee_id", "employee", "employee_id"),
    ("prescription", "customer_id", "customer", "customer_id"),
    ("prescription", "product_id", "product", "product_id"),
    ("manual_sales", "employee_id", "employee", "employee_id"),
    ("manual_sales", "customer_id", "customer", "customer_id"),
    ("manual_sales", "product_id", "product", "product_id"),
    ("tender", "employee_id", "employee", "employee_id"),
    ("tender", "customer_id", "customer", "customer_id"),
    ("tender", "product_id", "product", "product_id"),
    ("daily_report", "employee_id", "employee", "employee_id"),
    ("kpi_target", "employee_id", "employee", "employee_id"),
    ("kpi_target", "territory_id", "territory", "territory_id"),
    ("kpi_target", "product_id", "product", "product_id"),
    ("sheet_sales", "employee_id", "employee", "employee_id"),
    ("sheet_sales", "customer_id", "customer", "customer_id"),
    ("sheet_sales", "product_id", "product", "product_id"),
]

# Columns that must not be null, and the greatest lengths of texts.
REQUIRED = {
    "territory": ["territory_name", "region"],
    "employee": ["employee_name", "email", "role", "status"],
    "product": ["product_name", "dosage_form", "price", "status"],
    "customer": ["customer_name", "customer_type", "territory_id", "status"],
    "account": ["username", "employee_id"],
    "prescription": ["report_date", "employee_id", "customer_id", "product_id", "quantity", "amount"],
    "manual_sales": ["period", "customer_id", "product_id", "employee_id", "amount"],
    "tender": ["customer_id", "product_id", "status", "employee_id", "updated_date"],
    "daily_report": ["report_date", "employee_id", "summary"],
    "kpi_target": ["period", "employee_id", "target_sales", "target_prescriptions"],
    "sheet_sales": ["month", "year", "doc_date", "quantity", "revenue", "coefficient", "sales"],
}
LENGTHS = {
    "territory": {"territory_name": 120, "region": 120},
    "employee": {"email": 255, "sale_code": 20},
    "product": {"product_name": 180, "active_ingredient": 240, "sale_code": 40, "unit": 30},
    "customer": {"customer_name": 220, "sale_code": 40, "sale_group": 80},
    "account": {"username": 80},
    "manual_sales": {"period": 7, "source_note": 160},
    "kpi_target": {"period": 7},
}


def key_counts(T) -> DataFrame:
    """(table_name, column_name, parent, key_value, rows) of every foreign key's distinct values."""
    parts = []
    for child, keys in groupby(FOREIGN_KEYS, key=lambda k: k[0]):
        parents = {col: parent for _, col, parent, _ in keys}
        df = getattr(T, child).select(*parents)
        if not all(isinstance(f.dataType, IntegralType) for f in df.schema):  # side by side they need one type
            df = df.select(*[F.col(c).cast("string").alias(c) for c in parents])
        parent = F.create_map(*[F.lit(x) for pair in parents.items() for x in pair])[F.col("column_name")]
        parts.append(df.unpivot([], list(parents), "column_name", "_v").where(F.col("_v").isNotNull())
                     .groupBy("column_name", "_v").agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(child).alias("table_name"), "column_name", parent.alias("parent"),
                             F.col("_v").cast("string").alias("key_value"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def orphans(T) -> DataFrame:
    """Q2: child values with no parent row, counted per (table, column, value)."""
    parents = reduce(DataFrame.unionByName, [
        getattr(T, parent).select(F.lit(parent).alias("parent"), F.col(key).cast("string").alias("key_value"))
        for parent, key in sorted({(parent, key) for _, _, parent, key in FOREIGN_KEYS})])
    # An outer join, since Spark moves an anti join below the union: every child would read every parent.
    known = parents.distinct().withColumn("known", F.lit(True))
    return (key_counts(T).join(known, ["parent", "key_value"], "left").where(F.col("known").isNull())
            .select("table_name", "column_name", "key_value", "rows"))


def _rules():
    in_roles = list(MANAGER_ROLES) + list(REP_ROLES_LOOSE)
    rules = {
        "prescription": {
            "quantity_positive": ~(F.col("quantity") > 0),
            "amount_not_negative": F.col("amount") < 0,
        },
        "manual_sales": {
            "amount_not_negative": F.col("amount") < 0,
            "period_shape": ~F.col("period").rlike(PERIOD_SHAPE),
        },
        "product": {"price_not_negative": F.col("price") < 0,
                    "status_enum": ~F.col("status").isin("Active", "Inactive")},
        "tender": {
            "quantity_not_negative": F.col("quantity") < 0,
            "bid_not_negative": F.col("bid_price") < 0,
            "status_enum": ~F.col("status").isin(*TENDER_STATUSES),
        },
        "employee": {
            "role_enum": ~F.col("role").isin(*in_roles),
            "status_enum": ~F.col("status").isin("Active", "Inactive"),
            "email_shape": F.col("email").isNotNull() & ~F.col("email").rlike(EMAIL_SHAPE),
            "name_length": F.length("employee_name") > 150,
        },
        "customer": {
            "type_enum": ~F.col("customer_type").isin(*CUSTOMER_TYPES),
            "status_enum": ~F.col("status").isin("Active", "Inactive"),
        },
        "kpi_target": {
            "target_not_negative": F.col("target_sales") < 0,
            "period_shape": ~F.col("period").rlike(PERIOD_SHAPE),
        },
        "sheet_sales": {
            "month_range": ~F.col("month").between(1, 12),
            "year_range": ~F.col("year").between(2000, 2100),
        },
    }
    for table, cols in REQUIRED.items():
        rules.setdefault(table, {}).update({f"{c}_required": F.col(c).isNull() for c in cols})
    for table, cols in LENGTHS.items():
        rules.setdefault(table, {}).update({f"{c}_length": F.length(c) > n for c, n in cols.items()})
    return rules


def domain_checks(T) -> DataFrame:
    """Q3: violations per rule, all rules of a table in one aggregate pass."""
    parts = []
    for table, rules in _rules().items():
        names = list(rules)
        agg = getattr(T, table).agg(*[F.count_if(F.coalesce(rules[n], F.lit(False))).alias(n) for n in names])
        stack = ", ".join(f"'{n}', `{n}`" for n in names)
        parts.append(agg.selectExpr(f"'{table}' AS table_name",
                                    f"stack({len(names)}, {stack}) AS (rule, violations)"))
    return reduce(DataFrame.unionByName, parts)


# (table, key columns, only rows where all keys are non-null)
UNIQUE_KEYS = [
    ("employee", ["employee_id"], False),
    ("employee", ["email"], True),
    ("employee", ["sale_code"], True),
    ("customer", ["customer_id"], False),
    ("customer", ["sale_code"], True),
    ("product", ["product_id"], False),
    ("product", ["sale_code"], True),
    ("territory", ["territory_id"], False),
    ("account", ["username"], False),
    ("account", ["employee_id"], False),
    ("employee_territory", ["employee_id", "territory_id"], False),
    ("employee_customer", ["employee_id", "customer_id"], False),
    ("prescription", ["prescription_id"], False),
    ("tender", ["tender_id"], False),
    ("manual_sales", ["period", "customer_id", "product_id"], False),
    ("daily_report", ["report_date", "employee_id"], False),
    ("kpi_target", ["period", "employee_id", "product_id"], False),
    ("sheet_sales", ["order_key", "line_number"], False),
]
CODED = ("employee", "customer", "product")  # tables whose ids may be generated from sale_code


def _cells(df: DataFrame, keysets, coded: bool) -> DataFrame:
    """(key_columns, vals, code): every key of every row; for a generated id its code, which ``code`` counts apart."""
    def cell(name, vals, code=F.lit(None).cast("string")):
        return F.struct(F.lit(name).alias("key_columns"), vals.alias("vals"), code.alias("code"))
    cells = []
    for keys, partial in keysets:
        vals = F.array(*[F.col(k).cast("string") for k in keys])
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        cells.append(cell(",".join(keys), F.when(whole, vals) if partial else vals))
    if coded:
        code = F.col("sale_code")
        cells.append(cell("slug(sale_code)", F.when(code.isNotNull(), F.array(slug(code))), code))
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("vals").isNotNull())


#: Rows of a table with a single key that one task groups: Spark packs partitions by shuffled bytes, of which a key that
#: compresses well needs few, but the groups of (mostly different) keys take memory by their number.
ROWS_A_TASK = 500_000


def _dealt(keys: DataFrame) -> DataFrame:
    """The keys dealt out by value to so many tasks that one has about ROWS_A_TASK rows, however large the table."""
    tasks = -(-keys.count() // ROWS_A_TASK)
    return keys.repartition(tasks, *keys.columns) if tasks > 1 else keys


def duplicate_keys(T) -> DataFrame:
    """Q4: keys held by more than one row (partial unique keys skip NULLs), and sale codes with one generated id.

    A table with a single key is grouped by the columns themselves; several keys of a table share one scan and grouping.
    """
    parts = []
    for table, group in groupby(UNIQUE_KEYS, key=lambda k: k[0]):
        keysets = [(keys, partial) for _, keys, partial in group]
        df, coded = getattr(T, table), table in CODED
        if len(keysets) == 1 and not coded and not keysets[0][1]:
            keys = keysets[0][0]
            dup = _dealt(df.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
            name, value = F.lit(",".join(keys)), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        else:
            dup = (_cells(df, keysets, coded).groupBy("key_columns", "vals", "code").agg(F.count(F.lit(1)).alias("n"))
                   .groupBy("key_columns", "vals").agg(F.sum("n").alias("n"), F.count("code").alias("codes"))
                   .withColumn("rows", F.when(F.col("codes") > 0, F.col("codes")).otherwise(F.col("n"))))
            name, value = F.col("key_columns"), F.concat_ws("|", "vals")
        parts.append(dup.where(F.col("rows") > 1).select(F.lit(table).alias("table_name"), name.alias("key_columns"),
                                                         value.alias("key_value"), "rows"))
    return reduce(DataFrame.unionByName, parts)
