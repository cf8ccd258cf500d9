"""Labels, codes, patterns and limits the results depend on."""

# Fixed values -- supplier codes and names.
SUPPLIERS = {1: "罗莱", 2: "优家", 3: "宝缦", 4: "其他"}

# Fixed values -- staff codes.
SEXES = {"F": "女性", "M": "男性"}
MARITAL = {True: "已婚", False: "未婚"}
LEVELS = {
    1: "董事", 2: "会计", 3: "仓管", 4: "经理", 5: "店长",
    6: "店员", 7: "后勤", 8: "实习", 9: "其他", 99: "离职",
}

# Fixed values -- labels.
HEAD_OFFICE = "总部"
NO_CUSTOMER = "未登记"
STATUS_ACTIVE = "正常"
STATUS_DELETED = "已删除"
UNKNOWN = "不明"

# Fixed values -- report headings.
SALES_REPORT_HEADER = ["编号", "店铺", "日期", "产品名称", "尺寸", "类别", "价格", "数量", "小计"]
STOCK_REPORT_HEADER = ["编号", "名称", "条码", "尺寸", "当前库存", "仓库总库存", "状态"]
DISCOUNT_TOTAL = "折扣总额"
PAID_TOTAL = "实收"

# Fixed values -- audit wording: day, operator, product, then old and new state.
AUDIT_RULE = "-" * 31
AUDIT_DELETE_RECEIPT = "%s %s 删除 产品：%s\n原:%s套 单价%s 仓库%s\n" + AUDIT_RULE + "\n"
AUDIT_DELETE_ISSUE = "%s %s 删除 产品：%s\n原:%s套 仓库%s\n" + AUDIT_RULE + "\n"
AUDIT_EDIT_RECEIPT = "%s %s 修改 产品：%s\n原:%s套 单价%s 仓库%s\n新:%s套 单价%s 仓库%s\n" + AUDIT_RULE + "\n"
AUDIT_EDIT_ISSUE = "%s %s 修改 产品：%s\n原:%s套 仓库%s\n新:%s套 仓库%s\n" + AUDIT_RULE + "\n"

# Fixed values -- input patterns.
RE_ID = r"^[1-9][0-9]*$"
RE_CODE = r"^[A-Za-z0-9]{4,20}$"
RE_CODE_SEARCH = r"^[A-Za-z0-9]{0,20}$"
RE_MONEY = r"^[0-9]+\.?[0-9]{0,2}$"
RE_AMOUNT = r"^-?[0-9]{1,6}(\.[0-9]{0,2})?$"
RE_QUANTITY = r"^[1-9][0-9]*$"
RE_CUSTOMER_NAME = r"^[\x{4e00}-\x{9fa5}]{2,}$"
RE_TELEPHONE = r"^[1-9][0-9]{6,7}"
RE_PRODUCT_NAME = r"^\S{2,30}$"
RE_BARCODE = r"^[0-9]{4,20}$"
RE_SIZE = r"^([1-9][0-9]{0,2})+,+([1-9][0-9]{0,2})$"
RE_TIMESTAMP = r"^(1[6-9]|[2-9]\d)\d{2}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"

# Fixed values -- limits.
NOTE_MAX = 100
QUANTITY_MAX = 2**31 - 1
MONEY_BELOW = 1_000_000
PAGE_SIZE = 20
SEARCH_LIMIT = 100
RECENT_ORDERS = 10
LOOKBACK_DEFAULT_DAYS = 92
LOOKBACK_MAX_DAYS = 93
DASHBOARD_DAYS = 7
DASHBOARD_MAX_DAYS = 60
DASHBOARD_MAX_DAYS_WIDE = 120
LEVEL_LEFT = 99
