"""Categories, staff, choices, remittances, duplicates and data-quality rules."""

from datetime import date

from pyspark.sql import functions as F
from registry.core import AS_OF, HEAD_OFFICE, query
from registry.sales_queries import dec
from registry.stock_queries import LEVEL_CASE, STAFF_LABEL, SUPPLIER_CASE

from ledgerloom.operators import stock
from ledgerloom.plans import catalog as C
from ledgerloom.plans import quality as V

# -- categories, staff, lists ----------------------------------------------------------

query("category_tree", "i_category", 'select id, coalesce(pid_id, 0) as "pId", name from i_category where not hidden')(
    C.category_tree
)
query(
    "category_label", "i_category",
    "select c.id, concat_ws('-', p.name, c.name) as label from i_category c left join i_category p on p.id = c.pid_id",
)(C.category_label)
query(
    "leaf_categories", "i_category",
    """
select c.id, c.name, c.pid_id, p.name as parent,
  row_number() over (partition by coalesce(c.pid_id, 0) order by c.id) as position
from i_category c left join i_category p on p.id = c.pid_id
where not c.hidden and not exists (select 1 from i_category k where not k.hidden and k.pid_id = c.id)
""",
)(C.leaf_categories)
query(
    "product_form_categories", "i_category",
    """
select id, name, pid_id from i_category where not hidden
and pid_id in (select pid_id from i_category where not hidden and pid_id is not null)
""",
)(C.product_form_categories)
query(
    "staff_roster", "i_staff i_shop",
    f"""
select s.id, s.name, s.shop_id, h.name as shop, s.level, {LEVEL_CASE.format(c="level")} as level_label,
  row_number() over (partition by shop_id order by level, s.id) as position
from i_staff s left join i_shop h on h.id = shop_id where level < 99
""",
)(C.staff_roster)
query(
    "visible_staff_choice", "i_staff",
    f"""
select 'current' as list, id, {STAFF_LABEL.format(a="s")} as label from i_staff s where level < 99
union all select 'handler', id, {STAFF_LABEL.format(a="s")} from i_staff s where level >= 5
""",
)(
    lambda t: C.visible_staff_choice(t).select(F.lit("current").alias("list"), "id", "label").unionByName(
        C.visible_staff_choice(t, at_least=5).select(F.lit("handler").alias("list"), "id", "label")
    )
)
query("shop_choice", "i_shop", f"select id, name from i_shop where name <> '{HEAD_OFFICE}'")(
    lambda t: C.shop_choice(t, head_office=HEAD_OFFICE)
)
query("receipt_choice", "i_instream", "select id, code from i_instream where not hidden")(C.receipt_choice)
query(
    "remit_list", "i_remit i_staff",
    f"""
select r.id, {SUPPLIER_CASE.format(c="r.supplier")} as supplier, amount_cents,
  case when s.id is not null then {STAFF_LABEL.format(a="s")} end as staff, strftime(r.date, '%Y-%m-%d') as date, r.hidden
from i_remit r left join i_staff s on s.id = r.staff_id
""",
)(C.remit_list)


def _shared(src: str, *fields: str) -> str:
    return " union all ".join(
        f"select '{f}' as field, {f} as value, count(*) as count from {src} where not hidden and {f} is not null "
        f"group by 2 having count(*) > 1"
        for f in fields
    )


query("duplicate_products", "i_products", _shared("i_products", "name", "barcode"))(C.duplicate_products)
query("duplicate_customers", "i_customer", _shared("i_customer", "name", "code", "telephone"))(C.duplicate_customers)

# -- data quality ----------------------------------------------------------------------
#
# The inputs are stored rows turned back into the text a form would submit, with values
# from their other columns mixed in so that every rule has rows on both sides.


def err(**rules: str) -> str:
    return "concat_ws(',', " + ", ".join(f"case when {r} then '{n}' end" for n, r in rules.items()) + ") as errors"


def bad(x: str, pattern: str) -> str:
    return f"not regexp_full_match({x}, '{pattern}')"


MONEY_RE, QTY_RE, ID_RE, CODE_RE = "[0-9]+[.]?[0-9]{0,2}", "[1-9][0-9]*", "[1-9][0-9]*", "[A-Za-z0-9]{4,20}"


def _order_text(t):
    return t["sellorder"].select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("note").startswith("1"), F.col("note")).otherwise(F.coalesce("code", F.lit(""))).alias("code"),
        F.concat(
            F.coalesce(F.col("discount").cast("string"), F.lit("")), F.when(F.col("note") == "2-HIGH", "0").otherwise("")
        ).alias("discount"),
        F.repeat("note", F.lit(12)).alias("note"),
        F.when(F.col("note") == "5-LOW", F.date_format("date", "yyyy/MM/dd"))
        .otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss")).alias("date"),
    )


_ORDER_TEXT = f"""
with x as (select cast(id as varchar) as id, case when note like '1%' then note else coalesce(code, '') end as code,
  concat(case when discount_cents is null then '' else {dec("discount_cents")} end,
    case when note = '2-HIGH' then '0' else '' end) as discount,
  repeat(note, 12) as note, case when note = '5-LOW' then strftime(date, '%Y/%m/%d')
    else strftime(date, '%Y-%m-%d %H:%M:%S') end as date from i_sellorder)
"""
_ORDER_ERR = {
    "code": f"code <> '' and {bad('code', CODE_RE)}",
    "discount": f"discount <> '' and {bad('discount', MONEY_RE)}",
    "note": "length(replace(note, ' ', '')) > 100",
}
query("validate_order", "i_sellorder", _ORDER_TEXT + f"select *, {err(**_ORDER_ERR)} from x")(
    lambda t: V.validate_order(_order_text(t))
)
query(
    "validate_order_edit", "i_sellorder",
    _ORDER_TEXT + "select *, " + err(
        id=bad("id", ID_RE), **_ORDER_ERR, date="date like '%/%'", future="date not like '%/%' and date >= '2000-01-02'"
    ) + " from x",
)(lambda t: V.validate_order(_order_text(t), as_of=date(2000, 1, 1)))


def _sell_text(t):
    return t["sellorderdetail"].select(
        F.col("oid_id").alias("order_id"), "id", F.col("id").alias("line_no"),
        F.concat(F.col("price").cast("string"), F.when(F.col("quantity") > 40, "5").otherwise("")).alias("price"),
        F.concat(F.when(F.col("price") < 1000, "0").otherwise(""), F.col("quantity").cast("string")).alias("quantity"),
    )


_SELL_TEXT = f"""
with x as (select oid_id as order_id, id, id as line_no,
  concat({dec("price_cents")}, case when quantity > 40 then '5' else '' end) as price,
  concat(case when price_cents < 100000 then '0' else '' end, cast(quantity as varchar)) as quantity from i_sellorderdetail),
e as (select *, {err(price=bad("price", MONEY_RE), quantity=bad("quantity", QTY_RE))} from x)
"""
query("validate_order_line", "i_sellorderdetail", _SELL_TEXT + "select * from e")(
    lambda t: V.validate_order_line(_sell_text(t))
)
query(
    "first_bad_line", "i_sellorderdetail",
    _SELL_TEXT + "select order_id, min(line_no) as line_no, arg_min(split_part(errors, ',', 1), line_no) as error "
    "from e where errors <> '' group by 1",
)(lambda t: V.first_bad_line(_sell_text(t)))

query(
    "validate_order_business", "i_sellorderdetail i_sellorder i_products shop_stock",
    """
with l as (select o.id as order_id, o.shop_id, l.product_id, p.name, price_cents, quantity,
    coalesce(discount_cents, 0) * 20000 as discount from i_sellorderdetail l join i_sellorder o on o.id = oid_id
    join i_products p on p.id = l.product_id),
a as (select order_id, sum(quantity * price_cents) as gross, max(discount) as d,
    max(case when quantity > coalesce(stock, 0) then 1 else 0 end) as over
  from l left join shop_stock s on s.shop_id = l.shop_id and s.product_id = l.product_id group by 1),
b as (select order_id, max(n) as n from (select order_id, name, count(*) n from l group by 1, 2) group by 1)
select order_id, """ + err(
        discount_over_payable="d // 100 > case when gross - d < 0 then -((d - gross) // 100) else (gross - d) // 100 end",
        over_stock="over = 1", duplicate_product="n > 1",
    ) + " from a join b using (order_id)",
)(
    lambda t: V.validate_order_business(
        t["sellorderdetail"].join(
            t["sellorder"].select(
                F.col("id").alias("order_id"), "shop_id",
                (F.coalesce("discount", F.lit(0)).cast("decimal(8,2)") * 20000).cast("decimal(18,2)").alias("discount"),
            ),
            F.col("oid_id") == F.col("order_id"),
        ).join(t["products"].select(F.col("id").alias("product_id"), "name"), "product_id"),
        stock.shop_product_stock(t),
    )
)


def _search_text(t):
    d = F.col("date").cast("date")
    return t["sellorder"].select(
        "id",
        F.when(F.col("note") == "5-LOW", F.col("note")).otherwise(F.coalesce("code", F.lit(""))).alias("code"),
        F.coalesce(F.col("customer_id").cast("string"), F.lit("")).alias("customer"),
        F.col("staff_id").cast("string").alias("staff"), F.repeat("note", F.lit(9)).alias("note"),
        F.when(F.col("note") == "2-HIGH", F.lit("")).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("sDate"),
        F.when(F.col("note") == "3-MEDIUM", F.lit("soon"))
        .otherwise(F.date_format(F.date_add(d, (F.col("shop_id") - 12).cast("int")), "yyyy-MM-dd")).alias("eDate"),
        F.col("staff_id").alias("level"),
    )


query(
    "validate_search_params", "i_sellorder",
    """
with x as (select id, case when note = '5-LOW' then note else coalesce(code, '') end as code,
  coalesce(cast(customer_id as varchar), '') as customer, cast(staff_id as varchar) as staff, repeat(note, 9) as note,
  case when note = '2-HIGH' then '' else strftime(date, '%Y-%m-%d') end as "sDate",
  case when note = '3-MEDIUM' then 'soon' else strftime(cast(date as date) + cast(shop_id - 12 as integer), '%Y-%m-%d') end as "eDate",
  staff_id as level from i_sellorder),
y as (select *, try_cast("sDate" as date) as s, try_cast("eDate" as date) as e from x)
select id, code, customer, staff, note, "sDate", "eDate", level, """ + err(
        code=bad("code", "[A-Za-z0-9]{0,20}"), customer=f"customer <> '' and {bad('customer', ID_RE)}",
        staff=f"staff <> '' and {bad('staff', ID_RE)}", note="length(note) > 100",
        s_date="\"sDate\" <> '' and s is null", look_back="level > 5 and s < date '2001-08-01' - 93",
        e_date="\"eDate\" <> '' and e is null", e_date_future="e > date '2001-08-01'", order="s > e",
    ) + " from y",
)(lambda t: V.validate_search_params(_search_text(t), AS_OF))

query(
    "validate_receipt_line", "i_indetail",
    f"""
with x as (select id, inid_id, product_id, depot_id,
  concat({dec("value_cents")}, case when quantity > 45 then '5' else '' end) as value, cast(quantity as varchar) as quantity,
  repeat('x', quantity * 3) as depotdetail,
  id > min(id) over (partition by inid_id, product_id, depot_id) as r from i_indetail)
select * exclude (r), """ + err(
        value=bad("value", MONEY_RE), quantity=bad("quantity", QTY_RE), note="length(depotdetail) > 100", repeated="r"
    ) + " from x",
)(
    lambda t: V.validate_receipt_line(
        t["indetail"].select(
            "id", "inid_id", "product_id", "depot_id",
            F.concat(F.col("value").cast("string"), F.when(F.col("quantity") > 45, "5").otherwise("")).alias("value"),
            F.col("quantity").cast("string").alias("quantity"),
            F.repeat(F.lit("x"), F.col("quantity") * 3).alias("depotdetail"),
        )
    )
)
query(
    "validate_issue_line", "i_outdetail",
    """
with x as (select id, outid_id, product_id, depot_id, cast(quantity as varchar) as quantity,
  id > min(id) over (partition by outid_id, product_id, depot_id) as r from i_outdetail)
select * exclude (r), """ + err(quantity=bad("quantity", QTY_RE), repeated="r") + " from x",
)(
    lambda t: V.validate_issue_line(
        t["outdetail"].select("id", "outid_id", "product_id", "depot_id", F.col("quantity").cast("string").alias("quantity"))
    )
)
def customer_text(t):
    """Customers with Chinese names made from their telephone digits, and some broken fields."""
    return t["customer"].select(
        "id", "shop_id",
        F.when(F.col("hidden"), F.col("name")).otherwise(
            F.concat(F.lit("顾客"), F.translate(F.right("telephone", F.lit(2)), "0123456789", "零一二三四五六七八九"))
        ).alias("name"),
        F.concat(F.coalesce("code", F.lit("")), F.when(F.col("shop_id") == 1, "-").otherwise("")).alias("code"),
        F.concat(F.when(F.col("shop_id") == 0, "0").otherwise(""), "telephone").alias("telephone"),
        F.repeat(F.lit("a"), (F.col("shop_id") * 5).cast("int")).alias("address"),
        F.lit("").alias("note"), F.lit("2001-08-01").cast("date").alias("joindate"),
    )


CUSTOMER_TEXT = """
select id, shop_id, case when hidden then name else
  concat('顾客', translate(right(telephone, 2), '0123456789', '零一二三四五六七八九')) end as name,
  concat(coalesce(code, ''), case when shop_id = 1 then '-' else '' end) as code,
  concat(case when shop_id = 0 then '0' else '' end, telephone) as telephone, repeat('a', shop_id * 5) as address,
  '' as note, '2001-08-01' as joindate from i_customer
"""
CUSTOMER_ERR = {
    "name": "not regexp_full_match(name, '[\\x{4e00}-\\x{9fa5}]{2,}') or length(name) > 10",
    "code": f"code <> '' and {bad('code', CODE_RE)}",
    "telephone": "not regexp_matches(telephone, '^[1-9][0-9]{6,7}') or length(telephone) > 11",
    "address": "length(address) > 100",
    "note": "length(note) > 100",
}
query(
    "validate_customer", "i_customer", f"with x as ({CUSTOMER_TEXT}) select *, {err(**CUSTOMER_ERR)} from x"
)(lambda t: V.validate_customer(customer_text(t)))

query(
    "validate_view_request", "i_staff",
    """
with x as (select id, level, id * 7 % 150 as days, id % 3 = 0 as wide, case when id % 4 = 0 then 'depots' else 'sales' end as view
  from i_staff)
select *, """ + err(
        days="view <> 'depots' and level > 5 and days > case when wide then 120 else 60 end",
        view="view = 'depots' and level >= 5",
    ) + " from x",
)(
    lambda t: V.validate_view_request(
        t["staff"].select(
            "id", "level", (F.col("id") * 7 % 150).alias("days"), (F.col("id") % 3 == 0).alias("wide"),
            F.when(F.col("id") % 4 == 0, "depots").otherwise("sales").alias("view"),
        )
    )
)
query(
    "validate_stream_header", "i_instream i_staff",
    """
select h.id, h.code, h.supplier + 1 as supplier, """ + err(
        code=f"h.code <> '' and {bad('h.code', CODE_RE)}", supplier="h.supplier + 1 > 4",
        staff1="coalesce(s.level, 0) < 5", note="length(h.note) > 100",
    ) + " from i_instream h left join i_staff s on s.id = h.staff1_id",
)(
    lambda t: V.validate_stream_header(
        t["instream"].withColumn("supplier", F.col("supplier").cast("bigint") + 1), "in", t["staff"]
    ).select("id", "code", "supplier", "errors")
)
query(
    "validate_stream_header_out", "i_outstream i_staff i_shop",
    """
with x as (select h.*, (h.shop_id + 1) % 27 as shop, s.level, k.id as keeper from i_outstream h
  left join i_staff s on s.id = h.staff1_id left join i_staff k on k.id = h.keeper_id)
select x.id, x.code, x.shop as shop_id, """ + err(
        code=f"x.code <> '' and {bad('x.code', CODE_RE)}", shop="f.id is null", keeper="x.keeper is null",
        staff1="coalesce(x.level, 0) < 5", note="length(x.note) > 100",
    ) + f" from x left join i_shop f on f.id = x.shop and f.name <> '{HEAD_OFFICE}'",
)(
    lambda t: V.validate_stream_header(
        t["outstream"].withColumn("shop_id", (F.col("shop_id") + 1) % 27), "out", t["staff"], t["shop"], HEAD_OFFICE
    ).select("id", "code", "shop_id", "errors")
)
query(
    "validate_product", "i_products",
    """
with x as (select id, name, barcode, size, case when not hidden then category_id end as category_id, repeat(note, 15) as note
  from i_products)
select *, """ + err(
        name="length(name) not between 2 and 30 or not regexp_full_match(name, '[^ ]{2,30}')",
        barcode="length(barcode) > 20 or (barcode <> '' and not regexp_full_match(barcode, '[0-9]{4,20}'))",
        size="length(size) > 20 or (size <> '' and not regexp_full_match(size, '([1-9][0-9]{0,2})+,+([1-9][0-9]{0,2})'))",
        category="category_id is null", note="length(note) > 100",
    ) + " from x",
)(
    lambda t: V.validate_product(
        t["products"].select(
            "id", "name", "barcode", "size", F.when(~F.col("hidden"), F.col("category_id")).alias("category_id"),
            F.repeat("note", F.lit(15)).alias("note"),
        ),
        strict=True,
    )
)
query(
    "validate_remit", "i_remit i_staff",
    f"""
select r.id, r.supplier + 1 as supplier, concat({dec("amount_cents")}, case when hidden then '5' else '' end) as amount, """
    + err(supplier="r.supplier + 1 > 4", amount="hidden", staff="coalesce(s.level, 99) >= 99")
    + " from i_remit r left join i_staff s on s.id = r.staff_id",
)(
    lambda t: V.validate_remit(
        t["remit"].withColumn("supplier", F.col("supplier").cast("bigint") + 1).withColumn(
            "amount", F.concat(F.col("amount").cast("string"), F.when(F.col("hidden"), "5").otherwise(""))
        ),
        t["staff"],
    ).select("id", "supplier", "amount", "errors")
)
