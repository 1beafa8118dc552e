"""Sales-sheet ingest (S1-S3, P11, P12, I1, I2, J6, M3, A4, A8, A9, A13) and standard imports.

The reference parses a sheet in the browser, posts it in 500-row chunks and
runs up to seven statements per row. Here the whole sheet is one set of
partitions: every rule is a column expression, masters are derived with one
grouped pass per dimension (first row of the batch wins, by source row), and
snapshot replacement is a keyed diff.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions.dates import parse_doc_date, trimmed_doc_date
from fieldlens.functions.numbers import apart, js_trim, strict_number, trimmed, with_locale_numbers
from fieldlens.functions.text import (customer_type, normalise_role, normalise_status, padded, parse_bool,
                                      pick, slug)
from fieldlens.operators.codebook import assign_ids, record, stored_book
from fieldlens.operators.keys import first_per_key
from fieldlens.operators.merge import insert_absent, upsert
from fieldlens.schema import (COEFFICIENT, PREFIX_CUSTOMER, PREFIX_EMPLOYEE, PREFIX_PRODUCT, PREFIX_TERRITORY,
                              RESOURCES, SHEET_EMAIL_DOMAIN, SHEET_HEADERS, SHEET_MONEY,
                              SHEET_PRODUCT_DOSAGE_CODE, SHEET_PRODUCT_DOSAGE_FORM, SHEET_QTY, SHEET_REGION,
                              ResourceSpec)
from fieldlens.session import at_path, in_slices, staged, unstage
from fieldlens.sources.rownum import with_source_row_number
from fieldlens.sources.versions import VersionedTable

H = dict(zip(["manager", "emp_code", "emp_name", "province", "group", "month", "year", "cust_code",
              "cust_name", "doc_date", "ext_doc", "prod_code", "prod_name", "unit", "qty", "price",
              "revenue", "coef", "sales"], SHEET_HEADERS))

# Group texts used to render the test sheet from market segments (test fixture values).
GROUP_TEXT = {
    "HOUSEHOLD": "Phòng mạch tư nhân",
    "BUILDING": "Phòng khám đa khoa",
    "MACHINERY": "Sở Y tế",
    "AUTOMOBILE": "Bệnh viện tỉnh",
    "FURNITURE": "Nhà thuốc & Quầy thuốc tư nhân, Phòng khám",
}
# Codes of branches that agree in all the signs that a generated id keeps (test fixture value).
BRANCH_CODE = "Nhà thuốc Trung Tâm - chi nhánh số "
RAW_ORDER = ["order_key", "line_number", "product_id", "employee_id", "customer_id", "quantity", "revenue",
             "coefficient", "sales"]


def _vn2(col):
    """Decimal -> '1.234,56' (dot groups, comma decimals)."""
    text = F.replace(F.format_number(col, 2), F.lit("."), F.lit(";"))
    return F.replace(F.replace(text, F.lit(","), F.lit(".")), F.lit(";"), F.lit(","))


def sheet_raw(T, detail: DataFrame | None = None) -> DataFrame:
    """The sales sheet as text, rendered from the detailed sheet view (19 headers + order keys).

    Numbers use the Vietnamese locale, negatives are '(x)', dates come in
    three forms; some rows carry a bad month or a non-number, some codes do
    not exist in the masters.
    """
    d = T.sheet_detail if detail is None else detail
    keep = [c for c in ("source_row",) if c in d.columns]
    seg = F.col("customer_group")
    group = reduce(lambda acc, kv: acc.when(seg == kv[0], F.lit(kv[1])),
                   list(GROUP_TEXT.items())[1:],
                   F.when(seg == list(GROUP_TEXT)[0], F.lit(list(GROUP_TEXT.values())[0]))).otherwise(seg)
    form = F.col("line_number") % 3
    serial = F.datediff(F.col("doc_date"), F.lit("1899-12-30").cast("date")).cast("string")
    date_text = (F.when(form == 0, F.date_format("doc_date", "yyyy-MM-dd"))
                 .when(form == 1, F.concat_ws("/", F.month("doc_date").cast("string"),
                                              F.dayofmonth("doc_date").cast("string"),
                                              F.year("doc_date").cast("string")))
                 .otherwise(F.concat(serial, F.when(F.col("order_key") % 2 == 0, F.lit(".5")).otherwise(F.lit("")))))
    sales = F.col("sales")
    return d.select(
        *RAW_ORDER, *keep,
        F.col("manager_name").alias(H["manager"]),
        F.when(F.col("employee_id") % 9 == 4, F.concat(F.lit("X"), F.col("employee_id").cast("string")))
         .otherwise(F.col("employee_id").cast("string")).alias(H["emp_code"]),
        F.col("employee_name").alias(H["emp_name"]),
        F.col("province").alias(H["province"]),
        group.alias(H["group"]),
        F.when(F.col("order_key") % 97 == 0, F.lit("13")).otherwise(F.col("month").cast("string")).alias(H["month"]),
        F.col("year").cast("string").alias(H["year"]),
        F.when(F.col("customer_id") % 41 == 0, F.concat(F.lit(BRANCH_CODE), F.col("customer_id").cast("string")))
         .otherwise(F.col("customer_code")).alias(H["cust_code"]),
        F.when(F.col("customer_id") % 31 == 0, F.lit("")).otherwise(F.col("customer_name")).alias(H["cust_name"]),
        date_text.alias(H["doc_date"]),
        F.col("external_doc").alias(H["ext_doc"]),
        F.col("product_code").alias(H["prod_code"]),
        F.col("product_name").alias(H["prod_name"]),
        F.col("unit").alias(H["unit"]),
        F.col("quantity").cast("int").cast("string").alias(H["qty"]),
        _vn2(F.col("unit_price")).alias(H["price"]),
        _vn2(F.col("revenue")).alias(H["revenue"]),
        F.regexp_replace(F.col("coefficient").cast("string"), r"\.", ",").alias(H["coef"]),
        F.when(F.col("order_key") % 89 == 0, F.lit("abc"))
         .when(sales < 0, F.concat(F.lit("("), _vn2(-sales), F.lit(")")))
         .otherwise(_vn2(sales)).alias(H["sales"]),
    )


def numbered_rows(T) -> DataFrame:
    """S3: the sheet's narrow numeric rows, numbered from 2 in sheet order (a total sort here)."""
    narrow = T.sheet_sales.select(*RAW_ORDER, "doc_date", "year", "month").orderBy(*RAW_ORDER)
    return with_source_row_number(narrow, start=2)


def numbered_sheet(T, rows: DataFrame | None = None) -> DataFrame:
    """S3 on the rendered sheet, of its ``numbered_rows``.

    The sort and the numbering run on the narrow numeric rows; names are
    joined and the text rendered afterwards, so only a few numeric columns
    are shuffled and materialised.
    """
    return sheet_raw(T, T.detail_of(numbered_rows(T) if rows is None else rows)).drop(*RAW_ORDER)


def project_headers(df: DataFrame, headers=SHEET_HEADERS) -> DataFrame:
    """Select the sheet columns by name; fail if any is missing."""
    missing = [h for h in headers if h not in df.columns]
    if missing:
        raise ValueError(f"sheet is missing columns: {missing}")
    extra = [c for c in ("source_row", "source_file") if c in df.columns]
    return df.select(*[F.col(f"`{h}`") for h in headers], *extra)


TEXT_FIELDS = ["manager_name", "employee_code", "employee_name", "province", "customer_group", "customer_code",
               "customer_name", "external_doc", "product_code", "product_name", "unit"]
NUMBER_FIELDS = [("quantity", "qty", SHEET_QTY, False), ("unit_price", "price", SHEET_QTY, False),
                 ("revenue", "revenue", SHEET_MONEY, False), ("coefficient", "coef", COEFFICIENT, True),
                 ("sales", "sales", SHEET_MONEY, False)]
HASHED = ["manager_name", "employee_code", "employee_name", "province", "customer_group", "month", "year",
          "customer_code", "customer_name", "doc_date", "external_doc", "product_code", "product_name", "unit",
          "quantity", "unit_price", "revenue", "coefficient", "sales"]
#: What names a row of a source: its file, when the sheet comes from files, and its number there.
ROW_IDENTITY = ["source_file", "source_row"]


def row_hash(cols=HASHED):
    """SHA-256 over the normalised values (row number excluded), unit-separator joined."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def normalise_sheet(raw: DataFrame, materialize: bool = True, rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """(accepted normalised rows, rejected rows with their error list).

    The reference fails a whole chunk on the first bad row; here every row is
    judged on its own and the errors are kept (the first one is what the
    reference would report). With its number of ``rows`` a sheet that joins are
    still to render is parsed in slices.
    """
    text_keys = ["manager", "emp_code", "emp_name", "province", "group", "cust_code", "cust_name", "ext_doc", "prod_code",
                 "prod_name", "unit"]
    cols = {
        "manager_name": F.col("_manager"),
        "employee_code": padded(F.col("_emp_code")),
        "employee_name": F.col("_emp_name"),
        "province": F.col("_province"),
        "customer_group": F.col("_group"),
        "customer_code": F.col("_cust_code"),
        "customer_name": F.when(F.col("_cust_name") == "", F.col("_cust_code")).otherwise(F.col("_cust_name")),
        "external_doc": F.col("_ext_doc"),
        "product_code": F.col("_prod_code"),
        "product_name": F.col("_prod_name"),
        "unit": F.col("_unit"),
    }
    identity = [c for c in (*ROW_IDENTITY, "batch_id") if c in raw.columns]
    texts = {f"_{k}": trimmed(F.coalesce(F.col(f"`{H[k]}`"), F.lit(""))) for k in (*text_keys, "doc_date")}
    first = F.col(f"`{H['manager']}`")  # what ``apart`` holds is interpreted: a bare column
    texts["_manager"] = F.when(apart(first).isNotNull(), texts["_manager"]).otherwise("")
    numeric = {"month": "_t_month", "year": "_t_year", **{key: f"_t_{name}" for name, key, _, _ in NUMBER_FIELDS}}
    cut = raw.select(*identity, *[t.alias(n) for n, t in texts.items()],
                     *[F.col(f"`{H[key]}`").alias(n) for key, n in numeric.items()])
    specs = {"_month": ("_t_month", False), "_year": ("_t_year", False)}
    specs.update({f"_{name}": (f"_t_{name}", coef) for name, _, _, coef in NUMBER_FIELDS})
    numbers = with_locale_numbers(cut, specs).select(
        *identity, "_month", "_year", trimmed_doc_date(F.col("_doc_date")).alias("doc_date"),
        *[c.alias(n) for n, c in cols.items()], *[f"_{n}" for n, _, _, _ in NUMBER_FIELDS])
    # Each value gets its type once; the errors then ask what is null.
    df = numbers.select(
        *identity, *TEXT_FIELDS, "doc_date",
        *[F.col(f"_{n}").try_cast("int").alias(n) for n in ("month", "year")],
        *[F.col(f"_{n}").try_cast(t).alias(n) for n, _, t, _ in NUMBER_FIELDS],
        *[F.col(f"_{n}").isNull().alias(f"_no_{n}") for n in ("month", "year", *[f[0] for f in NUMBER_FIELDS])],
        *[(F.col(f"_{n}") == F.floor(f"_{n}")).alias(f"_whole_{n}") for n in ("month", "year")])

    def valid(name, least, most):
        return F.coalesce(F.col(f"_whole_{name}") & F.col(name).between(least, most), F.lit(False))
    errors = [
        F.when(F.col("_no_month"), F.lit("month is not a number")).when(~valid("month", 1, 12), F.lit("month is not valid")),
        F.when(F.col("_no_year"), F.lit("year is not a number")).when(~valid("year", 2000, 2100), F.lit("year is not valid")),
        F.when(F.col("doc_date").isNull(), F.lit("document date is not valid")),
    ]
    for name, _, _, _ in NUMBER_FIELDS:
        errors.append(F.when(F.col(f"_no_{name}"), F.lit(f"{name} is not a number"))
                      .when(F.col(name).isNull(), F.lit(f"{name} is out of range")))
    for name in TEXT_FIELDS:
        errors.append(F.when(F.col(name) == "", F.lit(f"{name} is blank")))
    out = df.select(*identity, *TEXT_FIELDS[:5], "month", "year", *TEXT_FIELDS[5:], "doc_date",
                    *[n for n, _, _, _ in NUMBER_FIELDS],
                    F.concat_ws("\n", *errors).alias("errors"))  # skips nulls; no error text has a line end
    if materialize:
        # Staging table: the parse is a deep stack of projections; filtering on its result would
        # make the optimizer inline every stage into the predicate. Cut the lineage once here; what
        # follows reads only the columns that it uses.
        out = staged(in_slices(out, [c for c in ROW_IDENTITY if c in identity], rows), "normalised")
    path = out.staged_path if materialize else None
    accepted = (out.filter(F.col("errors") == "").drop("errors")
                .withColumn("period", F.concat(F.col("year").cast("string"), F.lit("-"),
                                               F.lpad(F.col("month").cast("string"), 2, "0")))
                .withColumn("row_hash", row_hash()))
    found = F.split("errors", "\n")
    rejected = out.filter(F.col("errors") != "").select(
        *identity, found[0].alias("error"), F.size(found).alias("error_count"))
    return at_path(accepted, path), at_path(rejected, path)


# ------------------------------------------------------------------ I2 / J6
def _masters_as_text(T):
    """Master frames with ids as text, so generated ids and existing ids share a type."""
    return {
        "employee": T.employee.withColumn("employee_id", F.col("employee_id").cast("string")),
        "customer": T.customer.withColumn("customer_id", F.col("customer_id").cast("string"))
                               .withColumn("territory_id", F.col("territory_id").cast("string")),
        "product": T.product.withColumn("product_id", F.col("product_id").cast("string")),
        "territory": T.territory.withColumn("territory_id", F.col("territory_id").cast("string")),
    }


#: Kinds of codes of a sheet: column with the code, prefix of generated ids.
CODE_KINDS = {"territory": ("province", PREFIX_TERRITORY), "employee": ("employee_code", PREFIX_EMPLOYEE),
              "customer": ("customer_code", PREFIX_CUSTOMER), "product": ("product_code", PREFIX_PRODUCT)}
#: Codes of a kind up to which Spark chooses the join with their ids (by its own threshold, it broadcasts about as many).
BROADCAST_CODES = 150_000


def code_map(sheet: DataFrame, T, book: DataFrame | None = None) -> DataFrame:
    """(kind, name, code, id) of every distinct code of a sheet: the master's id by sale code (the smallest, if several
    hold one), else the book's, else a generated one that no other code has. A province's code is its whole slug: other
    spellings of one name are one territory.

    The sheet is read once for its distinct codes, which are staged; all else runs on these.
    """
    m = _masters_as_text(T)
    names = (sheet.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name"))
                                              for k, (c, _) in CODE_KINDS.items()])).alias("n")).select("n.*").distinct())
    names = staged(names, "codes")
    names = names.withColumn("code", F.when(F.col("kind") == "territory", slug("name", 1 << 30)).otherwise(F.col("name")))
    masters = [m[k].where(F.col("sale_code").isNotNull()).groupBy(F.col("sale_code").alias("code"))
               .agg(F.min(f"{k}_id").alias("id")).select(F.lit(k).alias("kind"), "code", "id")
               for k in CODE_KINDS if k != "territory"]
    known = reduce(DataFrame.unionByName, masters)
    if book is not None:
        known = known.unionByName(book.join(known, ["kind", "code"], "left_anti").select("kind", "code", "id"))
    taken = reduce(DataFrame.unionByName, [m[k].select(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("id"))
                                           for k in CODE_KINDS if k != "territory"])
    ids = assign_ids(names.select("kind", "code"), {k: p for k, (_, p) in CODE_KINDS.items()}, known, taken)
    return names.join(ids, ["kind", "code"]).select("kind", "name", "code", "id")


def with_resolved_ids(sheet: DataFrame, T, book: VersionedTable | None = None) -> DataFrame:
    """The sheet with its territory, employee, customer and product ids.

    The map of distinct codes is cut from its lineage once and joined by name; Spark broadcasts it by its size. It is
    grouped by name (one row each), so Spark knows the join keeps each row once and drops the joins whose id a query
    doesn't use. With a ``book`` (a versioned table) generated ids are kept there and read from there by later batches.
    """
    return join_ids(sheet, resolved_codes(sheet, T, book))


def resolved_codes(sheet: DataFrame, T, book: VersionedTable | None = None) -> DataFrame:
    """The staged ``code_map`` of a sheet; a ``book`` gets the generated ids that it doesn't hold yet."""
    ids = staged(code_map(sheet, T, None if book is None else stored_book(book)), "code-map")
    if book is not None:
        prefix = F.coalesce(*[F.when(F.col("kind") == k, F.lit(p)) for k, (_, p) in CODE_KINDS.items()])
        record(book, ids.where(F.startswith("id", prefix)).select("kind", "code", "id").distinct())
    return ids


def join_ids(sheet: DataFrame, ids: DataFrame, kinds=tuple(CODE_KINDS)) -> DataFrame:
    """The rows with the ids of a staged ``code_map``. A kind with more codes than ``BROADCAST_CODES`` is joined by hash: its
    codes are spread over the tasks, one row each, and the sheet's rows are not sorted by name."""
    sizes = {r["kind"]: r["count"] for r in ids.groupBy("kind").count().collect()}  # at most four
    for kind in kinds:
        name = CODE_KINDS[kind][0]
        own = (ids.where(F.col("kind") == kind).groupBy(F.col("name").alias("_name"))
               .agg(F.min("id").alias(f"{kind}_id")))
        if sizes.get(kind, 0) > BROADCAST_CODES:
            own = own.hint("shuffle_hash")
        sheet = sheet.join(own, sheet[name] == own["_name"], "left").drop("_name")
    return sheet


def derive_masters(sheet: DataFrame, T) -> dict[str, DataFrame]:
    """Dimension rows implied by the sheet; the first row of the batch wins per key.

    ``sheet`` must carry resolved ids (``with_resolved_ids``). Returns the
    rows to upsert/insert per master, not the merged masters.
    """
    m = _masters_as_text(T)
    seq = F.struct(*ROW_IDENTITY) if "source_file" in sheet.columns else F.col("source_row")
    s = sheet.withColumn("_seq", seq)
    territory = first_per_key(s.select("territory_id", F.col("province").alias("territory_name"), "_seq"),
                              ["territory_id"], "_seq") \
        .select("territory_id", "territory_name", F.lit(SHEET_REGION).alias("region"), F.lit("Active").alias("status"))
    # Employees are created only for codes no master holds; existing ones are never renamed.
    known_codes = m["employee"].filter(F.col("sale_code").isNotNull()).select(F.col("sale_code").alias("employee_code"))
    new_emp = s.join(known_codes.distinct(), "employee_code", "left_anti")
    employee = first_per_key(new_emp.select("employee_id", "employee_name", "employee_code", "_seq"),
                             ["employee_id"], "_seq").select(
        "employee_id", "employee_name",
        F.concat(F.lit("sale-"), F.lower(slug(F.col("employee_code"))), F.lit(SHEET_EMAIL_DOMAIN)).alias("email"),
        F.lit("NhanVien").alias("role"), F.lit("Active").alias("status"),
        F.col("employee_code").alias("sale_code"))
    customer = first_per_key(s.select("customer_id", "customer_name", "customer_group", "territory_id",
                                      "customer_code", "_seq"), ["customer_id"], "_seq").select(
        "customer_id", "customer_name", customer_type(F.col("customer_group")).alias("customer_type"),
        "territory_id", F.col("customer_code").alias("sale_code"), F.col("customer_group").alias("sale_group"))
    product = first_per_key(s.select("product_id", "product_name", "unit_price", "unit", "product_code",
                                     "_seq"), ["product_id"], "_seq").select(
        "product_id", "product_name", F.lit(SHEET_PRODUCT_DOSAGE_CODE).alias("dosage_code"),
        F.lit(SHEET_PRODUCT_DOSAGE_FORM).alias("dosage_form"),
        F.greatest(F.col("unit_price"), F.lit(0).cast(SHEET_QTY)).cast("decimal(14,2)").alias("price"),
        F.col("product_code").alias("sale_code"), "unit")
    emp_terr = s.select("employee_id", "territory_id").distinct().withColumn("is_primary", F.lit(True))
    emp_cust = s.select("employee_id", "customer_id").distinct()
    return {"territory": territory, "employee": employee, "customer": customer, "product": product,
            "employee_territory": emp_terr, "employee_customer": emp_cust}


def merge_masters(derived: dict[str, DataFrame], T) -> dict[str, DataFrame]:
    """Apply derived rows: upsert territory/customer/product, insert new employees and assignments."""
    m = _masters_as_text(T)
    seq = F.lit(1)
    terr = upsert(m["territory"], derived["territory"].withColumn("_seq", seq), ["territory_id"], "_seq",
                  columns=["territory_name"])
    cust = upsert(m["customer"], derived["customer"].withColumn("_seq", seq), ["customer_id"], "_seq",
                  columns=["customer_name", "customer_type", "territory_id", "sale_group"])
    prod = upsert(m["product"], derived["product"].withColumn("_seq", seq), ["product_id"], "_seq",
                  columns=["product_name", "price", "unit"])
    emp = insert_absent(m["employee"], derived["employee"], ["employee_id"])
    et = T.employee_territory.select(F.col("employee_id").cast("string"), F.col("territory_id").cast("string"),
                                     "is_primary")
    ec = T.employee_customer.select(F.col("employee_id").cast("string"), F.col("customer_id").cast("string"))
    return {"territory": terr, "customer": cust, "product": prod, "employee": emp,
            "employee_territory": insert_absent(et, derived["employee_territory"], ["employee_id", "territory_id"]),
            "employee_customer": insert_absent(ec, derived["employee_customer"], ["employee_id", "customer_id"])}


# ------------------------------------------------------------------ M3
def replace_snapshot(stored: DataFrame, batch: DataFrame, source_id: str,
                     key: str | list[str] = "source_row") -> tuple[DataFrame, DataFrame]:
    """M3: the batch replaces this source's rows; other sources stay.

    Returns (new table, diff) where diff has the key and one of inserted /
    updated / unchanged / deleted, decided by the row hash. One full outer
    join on (source, key); rows of several files need the file in ``key``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    mine = stored.filter(F.col("source_id") == F.lit(source_id))
    others = stored.filter(F.col("source_id") != F.lit(source_id))
    new_rows = batch.withColumn("source_id", F.lit(source_id))
    old = mine.select(*keys, F.col("row_hash").alias("_old"))
    new = new_rows.select(*keys, F.col("row_hash").alias("_new"))
    d = old.join(new, keys, "full_outer")
    change = (F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted")
              .when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated"))
    diff = d.select(*keys, change.alias("change"))
    return others.unionByName(new_rows.select(*stored.columns)), diff


# ------------------------------------------------------------------ A4 / A8 / A9
def import_stats(sheet: DataFrame, by=(), ids: DataFrame | None = None) -> DataFrame:
    """A4: counts, distinct ids, row range, total sales, document date range; of each group of ``by`` (a source).

    A scan of its own columns for the sums and for each distinct count: what is shuffled is a place (64 neighbouring ones are
    one group with a bit for each) or an id, and the ids' joins that a count doesn't use are dropped. A sheet without ids
    comes with its ``resolved_codes``: these are joined with its distinct codes, not with its rows.
    """
    place = F.col("source_row").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    zero = F.lit(0).cast("long")
    sums = sheet.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("source_row").alias("min_source_row"),
        F.max("source_row").alias("max_source_row"), F.sum("sales").alias("total_sales"),
        F.min("doc_date").alias("first_document_date"), F.max("doc_date").alias("last_document_date"))
    places = sheet.groupBy(*by, F.shiftright(place, 6).alias("_group")).agg(F.bit_or(bit).alias("_mask"))
    parts = [sums, places.groupBy(*by).agg(F.sum(F.bit_count("_mask")).alias("source_row_count"))]
    for c in ("employee_id", "customer_id", "product_id"):
        codes = sheet
        if ids is not None:
            codes = join_ids(sheet.select(*by, CODE_KINDS[c[:-3]][0]).distinct(), ids, [c[:-3]])
        own = codes.select(*by, c).where(F.col(c).isNotNull()).distinct()
        parts.append(own.groupBy(*by).agg(F.count(c).alias(f"{c[:-3]}_count")))
    merged = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)  # a row of each part and group
    counts = ("employee_count", "customer_count", "product_count")
    return (merged.groupBy(*by) if by else merged).agg(
        F.coalesce(F.sum("row_count"), zero).alias("row_count"),
        F.coalesce(F.sum("source_row_count"), zero).alias("source_row_count"),
        F.max("min_source_row").alias("min_source_row"), F.max("max_source_row").alias("max_source_row"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in counts],
        F.coalesce(F.sum("total_sales"), F.lit(0)).cast("decimal(38,2)").alias("total_sales"),
        F.max("first_document_date").alias("first_document_date"), F.max("last_document_date").alias("last_document_date"))


#: Names of the sheet's columns in a profile, in sheet order.
PROFILE_NAMES = dict(zip(H, ["manager", *HASHED[1:]]))
#: Number columns of the sheet: name, header key, coefficient.
PROFILE_NUMBERS = [("month", "month", False), ("year", "year", False), *((n, k, c) for n, k, _, c in NUMBER_FIELDS)]
SAMPLES = 10


def _parsed(raw: DataFrame) -> DataFrame:
    return with_locale_numbers(raw, {f"_{n}": (F.col(f"`{H[k]}`"), c) for n, k, c in PROFILE_NUMBERS})


def _profile_sums(raw: DataFrame) -> DataFrame:
    def blank(k):  # a sign that is printable ASCII settles it
        c = F.coalesce(F.col(f"`{H[k]}`"), F.lit(""))
        return F.count_if(~c.rlike("[!-~]") & (js_trim(c) == ""))
    return _parsed(raw).agg(
        F.count(F.lit(1)).alias("rows"),
        *[blank(k).alias(f"blank_{name}") for k, name in PROFILE_NAMES.items()],
        *[F.count_if(F.col(f"_{n}").isNull()).alias(f"bad_{n}") for n, _, _ in PROFILE_NUMBERS],
        F.count_if(parse_doc_date(F.col(f"`{H['doc_date']}`")).isNull()).alias("bad_doc_date"),
        F.sum("_sales").alias("expected_total"))


def sheet_profile(raw: DataFrame, rows: int = 0) -> DataFrame:
    """Blanks of all nineteen columns, texts that are no number or date, expected sales total, in one pass. With its
    number of ``rows`` a sheet that joins are still to render is read in slices, whose sums are added up."""
    sums = [_profile_sums(part) for part in in_slices(raw, ["source_row"], rows)]
    counts = sums[0].columns[:-1]
    if len(sums) > 1:
        sums = [staged(sums, "profile").agg(*[F.sum(c).alias(c) for c in (*counts, "expected_total")])]
    return sums[0].select(*counts, F.coalesce("expected_total", F.lit(0)).cast("decimal(38,2)").alias("expected_total"))


def sheet_samples(raw: DataFrame, k: int = SAMPLES) -> DataFrame:
    """(column_name, source_row, value) of the first k texts of each number column that are no number. Each task keeps
    its own first k of a column before the shuffle, so a column that is bad throughout is no large group."""
    place = [c for c in ROW_IDENTITY if c in raw.columns]
    cells = _parsed(raw).select(*place, F.explode(F.filter(F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.col(f"`{H[key]}`").alias("value"), F.col(f"_{n}").isNull().alias("bad"))
        for n, key, _ in PROFILE_NUMBERS]), lambda c: c["bad"])).alias("c"))
    order = Window.partitionBy("column_name").orderBy(*place)
    return (cells.select("c.column_name", *place, "c.value").withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= k).drop("_rank"))


def reconcile_import(profile: DataFrame, stats: DataFrame) -> DataFrame:
    """Stored rows against the sheet: counts, row range, total within max(1, 1e-9 |expected|)."""
    j = profile.crossJoin(stats)  # both single rows
    tol = F.greatest(F.lit(1).cast("decimal(38,10)"), F.abs(F.col("expected_total")) * F.lit(1e-9).cast("decimal(20,10)"))
    return j.select(
        (F.col("row_count") == F.col("rows")).alias("rows_ok"),
        (F.col("source_row_count") == F.col("rows")).alias("distinct_rows_ok"),
        (F.col("min_source_row") == 2).alias("min_row_ok"),
        (F.col("max_source_row") == F.col("rows") + 1).alias("max_row_ok"),
        (F.abs(F.col("total_sales") - F.col("expected_total")) <= tol).alias("total_ok"),
        "rows", "row_count", "expected_total", "total_sales")


def log_batch(log: DataFrame | None, run_id: str, rows: DataFrame, status: str) -> DataFrame:
    """Append one row per run: id, rows accumulated, status."""
    entry = rows.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(run_id).alias("batch_id"), "row_count", F.lit(status).alias("status"))
    return entry if log is None else log.unionByName(entry)


@dataclass
class ImportResult:
    sheet: DataFrame          # new snapshot of the sheet table
    rejected: DataFrame       # rows refused by the normaliser
    diff: DataFrame           # inserted / updated / unchanged / deleted per source row
    masters: dict             # merged master tables
    log: DataFrame            # batch log row


def import_sheet(raw: DataFrame, T, stored: DataFrame | None = None, source_id: str = "sheet",
                 strict: bool = False, derive: bool = True, run_id: str = "run",
                 book: VersionedTable | None = None) -> ImportResult:
    """Normalise -> resolve/derive masters -> upsert by source row -> replace the snapshot.

    ``strict=True`` refuses the whole batch when any row is rejected (the
    reference's chunk rule); the check costs one count.
    """
    accepted, rejected = normalise_sheet(project_headers(raw))
    if strict and rejected.limit(1).count() > 0:
        raise ValueError("sheet has rejected rows; run with strict=False to quarantine them")
    if derive:
        rows = with_resolved_ids(accepted, T, book)
        masters = merge_masters(derive_masters(rows, T), T)
    else:
        rows = (accepted.withColumn("territory_id", F.lit(None).cast("string"))
                .withColumn("employee_id", F.lit(None).cast("string"))
                .withColumn("customer_id", F.lit(None).cast("string"))
                .withColumn("product_id", F.lit(None).cast("string")))
        masters = {}
    rows = rows.withColumn("batch_id", F.lit(run_id))
    if stored is None:
        stored = rows.limit(0).withColumn("source_id", F.lit(source_id))
    sheet, diff = replace_snapshot(stored, rows, source_id, [c for c in ROW_IDENTITY if c in rows.columns])
    return ImportResult(sheet, rejected, diff, masters, log_batch(None, run_id, rows, "Completed"))


# ------------------------------------------------------------------ I3
def typed_resource(raw: DataFrame, spec: ResourceSpec) -> DataFrame:
    """The typed columns of one standard resource and ``_errors``, the reasons its text refuses them.

    Column aliases, defaults, role/status folds and booleans follow ``spec``.
    """
    exprs, checks = [], []
    for f in spec.fields:
        v = pick(raw, f.aliases)
        if f.kind == "text":
            e = F.coalesce(v, F.lit("" if f.default is None else str(f.default)))
        elif f.kind == "opt_text":
            e = v
        elif f.kind == "number":
            e = strict_number(v, f.default or 0)
            checks.append(F.when(e.isNull(), F.lit(f"{f.aliases[0]} is not a number")))
        elif f.kind == "bool":
            e = parse_bool(v)
        elif f.kind == "role":
            e = normalise_role(v)
        elif f.kind == "status":
            e = normalise_status(v)
        elif f.kind == "date":
            e = F.coalesce(v, F.lit(""))
        else:
            raise ValueError(f.kind)
        if f.required:
            checks.append(F.when(v.isNull(), F.lit(f"missing {' or '.join(f.aliases)}")))
        exprs.append(e.alias(f.name))
    keep = ["source_row"] if "source_row" in raw.columns else []
    return raw.select(*keep, *exprs, F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("_errors"))


def import_resource(raw: DataFrame, spec: ResourceSpec) -> tuple[DataFrame, DataFrame]:
    """Typed rows of one standard resource plus rejects (missing required value, bad number)."""
    df = typed_resource(raw, spec)
    keep = ["source_row"] if "source_row" in raw.columns else []
    ok = df.filter(F.size("_errors") == 0).drop("_errors")
    bad = df.filter(F.size("_errors") > 0).select(*keep, F.col("_errors")[0].alias("error"))
    return ok, bad


def apply_resource(target: DataFrame, rows: DataFrame, spec: ResourceSpec, seq: str = "source_row") -> DataFrame:
    """Merge imported rows by the spec's mode: upsert (last row wins), insert-if-absent, append.

    A resource lists only some of its table's columns: an update leaves the
    others as stored, an insert leaves them NULL.
    """
    given = [c for c in target.columns if c in rows.columns]
    if spec.mode == "append":
        return target.unionByName(rows.select(*given), allowMissingColumns=True)
    if spec.mode == "insert_absent":
        whole = rows.select(seq, *[(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
                                   for f in target.schema.fields])
        return insert_absent(target, whole, list(spec.keys), seq=seq)
    return upsert(target, rows.select(*given, seq), list(spec.keys), seq, columns=given,
                  null_safe=spec.mode == "upsert_null_safe")


__all__ = ["sheet_raw", "numbered_sheet", "normalise_sheet", "derive_masters", "with_resolved_ids",
           "replace_snapshot", "import_stats", "sheet_profile", "reconcile_import", "import_sheet",
           "import_resource", "apply_resource", "RESOURCES"]


# ------------------------------------------------------------------ I3 test inputs
# Each standard resource's CSV is rendered from a domain table: every value as
# text under the first alias (blank on some rows) and the second alias (padded),
# and rows where both are blank, so alias choice, trimming, defaults and
# required-value refusals are all exercised.
RESOURCE_SOURCES = {
    "employees": ("employee", "employee_id"),
    "territories": ("territory", "territory_id"),
    "products": ("product", "product_id"),
    "customers": ("customer", "customer_id"),
    "employeeTerritories": ("employee_territory", "employee_id + territory_id"),
    "employeeCustomers": ("employee_customer", "employee_id + customer_id"),
    "prescriptions": ("prescription", "customer_id + product_id"),
    "sales": ("manual_sales", "customer_id + product_id"),
    "tenders": ("tender", "tender_id"),
    "dailyReports": ("daily_report", "employee_id"),
    "kpiTargets": ("kpi_target", "employee_id"),
}
# Domain column feeding each import field when the names differ.
FIELD_SOURCE = {"is_primary": "is_primary", "report_date": "report_date"}
# Optional fields the domain tables do not carry: rendered as NULL.
ABSENT_FIELDS = {("products", "package_spec"), ("customers", "address"), ("customers", "phone")}


# Damage of the routed imports' inputs, field -> (k % 13, text): dates, months, enumerations and e-mails that the rules
# refuse, and parents that do not exist. A resource's own single key is prefixed instead (``NEW_KEY``), so it inserts.
DAMAGE = {
    "report_date": ((1, "2024-02-30"),), "due_date": ((1, "2024-13-01"),), "period": ((2, "2024-13"), (10, "2031-01")),
    "email": ((3, "nobody.example"),), "customer_type": ((4, "Other"),), "price": ((4, "-1"),),
    "bid_price": ((3, "-0.5"),), "quantity": ((2, "1.5"),), "employee_id": ((5, "-1"),), "customer_id": ((6, "-1"),),
    "product_id": ((7, "-1"),), "territory_id": ((8, "-1"),),
}
NEW_KEY = (9, "9000000")


def resource_raw(T, resource: str, damaged: bool = False) -> DataFrame:
    """A resource's CSV columns; ``damaged`` adds ``source_row`` and values that the routing rules refuse."""
    table, key_expr = RESOURCE_SOURCES[resource]
    src = getattr(T, table)
    spec = RESOURCES[resource]
    k = F.expr(key_expr)
    cols = [k.alias("source_row")] if damaged else []
    for f in spec.fields:
        name = FIELD_SOURCE.get(f.name, f.name)
        value = (F.lit(None).cast("string") if (resource, f.name) in ABSENT_FIELDS
                 else F.col(name).cast("string"))
        if f.kind == "bool":
            value = F.when(F.col(name), F.lit(" x ")).otherwise(F.lit("no"))
        if damaged and spec.keys == (f.name,):
            value = F.when(k % 13 == NEW_KEY[0], F.concat(F.lit(NEW_KEY[1]), value)).otherwise(value)
        elif damaged:
            for rest, text in DAMAGE.get(f.name, ()):
                value = F.when(k % 13 == rest, F.lit(text)).otherwise(value)
        first = F.when((k % 3 == 0) | (k % 17 == 0), F.lit("  ")).otherwise(value)
        cols.append(first.alias(f.aliases[0]))
        if len(f.aliases) > 1:
            second = F.when(k % 17 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), value, F.lit(" ")))
            cols.append(second.alias(f.aliases[1]))
    return src.select(*cols)


def import_resource_rows(T, resource: str) -> tuple[DataFrame, DataFrame]:
    """I3 on the rendered input: typed rows (deduplicated by the spec's mode) and rejects."""
    spec = RESOURCES[resource]
    ok, bad = import_resource(resource_raw(T, resource), spec)
    return ok, bad


def import_sheet_files(spark, paths, T, stored: DataFrame | None = None, source_id: str = "sheet",
                       strict: bool = False, derive: bool = True, run_id: str = "run",
                       multi_line: bool = False, book: VersionedTable | None = None) -> ImportResult:
    """I1 from files: read the sheet CSVs, number rows from 2 in each file's order, import.

    Numbering uses the scan's own splits (no sort); the source row key becomes
    (file, row). The numbered text is staged before the parse.
    """
    from fieldlens.sources.csv import read_resource_csv
    path = paths if isinstance(paths, str) else list(paths)
    raw = read_resource_csv(spark, path, multi_line=multi_line, with_file=True)
    numbered = with_source_row_number(raw, start=2, path_col="source_file")
    result = import_sheet(numbered, T, stored=stored, source_id=source_id, strict=strict, derive=derive,
                          run_id=run_id, book=book)
    unstage(numbered)  # the import reads its normalised rows
    return result


#: Columns of the stored sheet: the source and its rows with their resolved ids.
STORED_SHEET = ["source_id", "source_file", "source_row", *HASHED, "period", "territory_id", "employee_id", "customer_id",
                "product_id", "row_hash", "batch_id"]


def stored_sheet(rows: DataFrame, source_id: str) -> DataFrame:
    """Imported rows in the columns of the stored sheet table."""
    given = rows.columns
    return rows.select(F.lit(source_id).alias("source_id"),
                       *[F.col(c) if c in given else F.lit(None).cast("string").alias(c) for c in STORED_SHEET[1:]])


def import_files_to_table(table, paths, T, source_id: str, run_id: str, strict: bool = False, derive: bool = True,
                          multi_line: bool = False, book: VersionedTable | None = None) -> ImportResult:
    """I1 and M3 written: import the sheet CSVs and swap them in for all rows of their source in a versioned table.

    ``table`` is a ``VersionedTable``. The new rows are written once; the diff against the version before and the log
    read what is written. The table changes by the commit alone, so a failure on the way leaves the old version.
    """
    spark = table.spark
    base = table.current()
    result = import_sheet_files(spark, paths, T, source_id=source_id, strict=strict, derive=derive, run_id=run_id,
                                multi_line=multi_line, book=book)
    sheet = stored_sheet(result.sheet, source_id)
    manifest = table.replace(in_slices(sheet, ROW_IDENTITY, sheet.count()), source_id, ["period"], note={"run": run_id})
    mine = [p for p, g in manifest.files.items() if g == source_id]
    rows = table.read(manifest.version, mine)
    before = table.read(base.version, [p for p, g in base.files.items() if g == source_id]) if base else rows.limit(0)
    _, diff = replace_snapshot(before, rows.drop("source_id"), source_id, ROW_IDENTITY)
    return ImportResult(table.read(manifest.version), result.rejected, diff, result.masters,
                        log_batch(None, run_id, rows, "Completed"))
