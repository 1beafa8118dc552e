"""Schemas, codebook and import specs.

The values under "Fixed values" must equal the source system's for results to
match: they are listed plainly, in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must match the source system)
# ---------------------------------------------------------------------------

# The 19 sales-sheet headers, in sheet order.
SHEET_HEADERS = [
    "Quản lý", "NV kinh doanh", "Tên NV KD", "Tỉnh", "Nhóm KH", "Tháng", "Năm",
    "Mã Kh", "Tên KH", "Ngày chứng từ", "Số Chứng từ ngoại", "Mã HH", "Tên HH",
    "DVT", "Số Lượng", "Đơn giá", "Doanh thu", "Hệ số", "DOANH SỐ",
]

# Roles that see every row; everyone else is a rep.
MANAGER_ROLES = ("QuanLy", "Admin", "Manager")
# Roles the loose reminder rule treats as reps.
REP_ROLES_LOOSE = ("NhanVien", "MR", "Supervisor")
# Words read as true by the boolean parser (after trim and lower case).
TRUE_WORDS = ("true", "1", "yes", "x", "có")
# Tender statuses, and the two that count as open.
TENDER_STATUSES = ("DangLamHoSo", "ChoKetQua", "TrungThau", "TruotThau")
OPEN_TENDER_STATUSES = ("DangLamHoSo", "ChoKetQua")
# Tender status labels shown to users.
TENDER_LABELS = {
    "DangLamHoSo": "Đang làm hồ sơ",
    "ChoKetQua": "Chờ kết quả",
    "TrungThau": "Trúng thầu",
    "TruotThau": "Trượt thầu",
}
# Customer types.
CLINIC = "PhongMachTu"
HEALTH_DEPT = "SoYTe"
HOSPITAL = "BenhVien"
# Source tags of the two sales sources.
SOURCE_SHEET = "DATA_SALE"
SOURCE_MANUAL = "WEBSITE"
# Surrogate id prefixes for masters derived from the sheet.
PREFIX_TERRITORY = "SALE_DB_"
PREFIX_EMPLOYEE = "SALE_NV_"
PREFIX_CUSTOMER = "SALE_KH_"
PREFIX_PRODUCT = "SALE_SP_"
# Region given to territories derived from the sheet.
SHEET_REGION = "DATA SALE"
# Product defaults for products derived from the sheet.
SHEET_PRODUCT_DOSAGE_CODE = "Khac"
SHEET_PRODUCT_DOSAGE_FORM = "Chưa phân loại từ DATA SALE"
# Email domain of employees derived from the sheet (a local placeholder domain).
SHEET_EMAIL_DOMAIN = "@sales-sheet.local"
# Reminder message: "Nhắc {name} gửi báo cáo KPI ngày {date}."
REMINDER_PREFIX = "Nhắc "
REMINDER_MIDDLE = " gửi báo cáo KPI ngày "
REMINDER_SUFFIX = "."
# Lost-customer reason text.
LOST_REASON = "Không phát sinh doanh số trong 4 tháng liên tục sau khi từng có sale."
# Paging: default size, clamp bounds.
PAGE_SIZE_DEFAULT, PAGE_SIZE_MIN, PAGE_SIZE_MAX = 20, 10, 100
# Dates given as spreadsheet serial numbers count days from this date.
SERIAL_EPOCH = "1899-12-30"

# ---------------------------------------------------------------------------
# Domain schemas
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(14, 2)
SHEET_QTY = T.DecimalType(18, 3)
SHEET_MONEY = T.DecimalType(18, 2)
COEFFICIENT = T.DecimalType(10, 4)
TOTAL = T.DecimalType(38, 2)

SHEET_NORMALISED = T.StructType([
    T.StructField("source_row", T.LongType()),
    T.StructField("manager_name", T.StringType()),
    T.StructField("employee_code", T.StringType()),
    T.StructField("employee_name", T.StringType()),
    T.StructField("province", T.StringType()),
    T.StructField("customer_group", T.StringType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("customer_code", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("doc_date", T.DateType()),
    T.StructField("external_doc", T.StringType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("quantity", SHEET_QTY),
    T.StructField("unit_price", SHEET_QTY),
    T.StructField("revenue", SHEET_MONEY),
    T.StructField("coefficient", COEFFICIENT),
    T.StructField("sales", SHEET_MONEY),
])


# ---------------------------------------------------------------------------
# Standard import specs (11 resources)
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Field:
    name: str                 # output column
    aliases: tuple            # input header aliases, first non-blank wins
    kind: str = "text"        # text | opt_text | number | bool | role | status | date
    default: object = None
    required: bool = False


@dataclass(frozen=True)
class ResourceSpec:
    name: str
    fields: tuple
    keys: tuple = ()
    mode: str = "upsert"      # upsert | insert_absent | append | upsert_null_safe
    null_safe_keys: tuple = field(default_factory=tuple)

    def column_names(self):
        return [f.name for f in self.fields]


def _f(name, aliases, kind="text", default=None, required=False):
    return Field(name, tuple(aliases), kind, default, required)


RESOURCES = {
    "employees": ResourceSpec("employees", (
        _f("employee_id", ["id_nhan_vien", "id"], required=True),
        _f("employee_name", ["ten_nhan_vien", "name"], required=True),
        _f("email", ["email"], "opt_text"),
        _f("role", ["chuc_vu", "role"], "role"),
        _f("status", ["trang_thai", "status"], "status"),
    ), keys=("employee_id",)),
    "territories": ResourceSpec("territories", (
        _f("territory_id", ["id_dia_ban", "id"], required=True),
        _f("territory_name", ["ten_dia_ban", "name"], required=True),
        _f("region", ["khu_vuc", "region"], required=True),
        _f("status", ["trang_thai", "status"], "status"),
    ), keys=("territory_id",)),
    "products": ResourceSpec("products", (
        _f("product_id", ["id_san_pham", "id"], required=True),
        _f("product_name", ["ten_san_pham", "name"], required=True),
        _f("active_ingredient", ["hoat_chat", "activeIngredient"], "opt_text"),
        _f("dosage_code", ["dang_bao_che", "dosageCode"], required=True),
        _f("dosage_form", ["mo_ta_dang_bao_che", "dosageForm"], required=True),
        _f("package_spec", ["quy_cach", "packageSpec"], "opt_text"),
        _f("price", ["gia_ke_don", "prescriptionPrice"], "number", 0),
        _f("status", ["trang_thai", "status"], "status"),
    ), keys=("product_id",)),
    "customers": ResourceSpec("customers", (
        _f("customer_id", ["id_khach_hang", "id"], required=True),
        _f("customer_name", ["ten_khach_hang", "name"], required=True),
        _f("customer_type", ["loai_khach_hang", "type"], required=True),
        _f("address", ["dia_chi", "address"], "opt_text"),
        _f("phone", ["dien_thoai", "phone"], "opt_text"),
        _f("territory_id", ["id_dia_ban", "territoryId"], required=True),
        _f("status", ["trang_thai", "status"], "status"),
    ), keys=("customer_id",)),
    "employeeTerritories": ResourceSpec("employeeTerritories", (
        _f("employee_id", ["id_nhan_vien", "employeeId"], required=True),
        _f("territory_id", ["id_dia_ban", "territoryId"], required=True),
        _f("is_primary", ["is_primary", "isPrimary"], "bool"),
    ), keys=("employee_id", "territory_id")),
    "employeeCustomers": ResourceSpec("employeeCustomers", (
        _f("employee_id", ["id_nhan_vien", "employeeId"], required=True),
        _f("customer_id", ["id_khach_hang", "customerId"], required=True),
    ), keys=("employee_id", "customer_id"), mode="insert_absent"),
    "prescriptions": ResourceSpec("prescriptions", (
        _f("report_date", ["ngay_bao_cao", "date"], "date", required=True),
        _f("employee_id", ["id_nhan_vien", "employeeId"], required=True),
        _f("customer_id", ["id_khach_hang", "customerId"], required=True),
        _f("product_id", ["id_san_pham", "productId"], required=True),
        _f("quantity", ["so_luong_ke_don", "quantity"], "number", 0, required=True),
        _f("amount", ["doanh_so_phat_sinh", "amount"], "number", 0),
    ), mode="append"),
    "sales": ResourceSpec("sales", (
        _f("period", ["thang_nam", "period"], required=True),
        _f("employee_id", ["id_nhan_vien", "employeeId"], required=True),
        _f("customer_id", ["id_khach_hang", "customerId"], required=True),
        _f("product_id", ["id_san_pham", "productId"], required=True),
        _f("amount", ["doanh_so_thuc", "amount"], "number", 0, required=True),
    ), keys=("period", "customer_id", "product_id")),
    "tenders": ResourceSpec("tenders", (
        _f("tender_id", ["id_goi_thau", "id"], required=True),
        _f("employee_id", ["id_nhan_vien", "employeeId"], required=True),
        _f("customer_id", ["id_khach_hang", "customerId"], required=True),
        _f("product_id", ["id_san_pham", "productId"], required=True),
        _f("quantity", ["so_luong_thau", "quantity"], "number", 0),
        _f("bid_price", ["gia_du_thau", "bidPrice"], "number", 0),
        _f("status", ["trang_thai", "status"], "text", "DangLamHoSo"),
        _f("due_date", ["han_nop", "dueDate"], "opt_text"),
    ), keys=("tender_id",)),
    "dailyReports": ResourceSpec("dailyReports", (
        _f("report_date", ["report_date", "date"], "date", required=True),
        _f("employee_id", ["id_nhan_vien", "employeeId"], required=True),
        _f("summary", ["summary"], required=True),
        _f("kpi_note", ["kpi_note", "kpiNote"], "opt_text"),
    ), keys=("report_date", "employee_id")),
    "kpiTargets": ResourceSpec("kpiTargets", (
        _f("period", ["thang_nam", "period"], required=True),
        _f("employee_id", ["id_nhan_vien", "employeeId"], required=True),
        _f("territory_id", ["id_dia_ban", "territoryId"], "opt_text"),
        _f("product_id", ["id_san_pham", "productId"], "opt_text"),
        _f("target_sales", ["target_sales", "targetSales"], "number", 0),
        _f("target_prescriptions", ["target_prescriptions", "targetPrescriptions"], "number", 0),
    ), keys=("period", "employee_id", "product_id"), mode="upsert_null_safe"),
}
