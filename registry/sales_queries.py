"""Sales series, order searches, product and people searches, reports."""

from datetime import date

from registry.core import AS_OF, HEAD_OFFICE, query
from registry.stock_queries import LEVEL_CASE, STAFF_LABEL

from ledgerloom.plans import reports as R
from ledgerloom.plans import sales as A
from ledgerloom.plans import search as Q

query("order_total", "totals", "select id as oid_id, cast(total_cents as bigint) as total_cents from totals")(
    A.order_total
)
query(
    "customer_amount", "totals i_customer",
    """
select c.id as customer_id, c.name, cast(s.x as bigint) as amount_cents from i_customer c left join
(select customer_id, sum(total_cents) x from totals where not hidden and has_lines group by 1) s on s.customer_id = c.id
""",
)(A.customer_amount)
query(
    "customer_orders_series", "totals",
    """
select customer_id, id as oid_id, strftime(date, '%Y-%m-%d') as day, cast(total_cents as bigint) as amount_cents
from totals where not hidden and has_lines and customer_id is not null
""",
)(A.customer_orders_series)

SHOP_DAILY_DAYS = 60
query(
    "shop_daily_sales", "totals i_shop",
    f"""
with grid as (select id as shop_id, name, cast(d as date) as day from i_shop,
  range(timestamp '2001-08-01' - interval {SHOP_DAILY_DAYS - 1} day, timestamp '2001-08-02', interval 1 day) r(d)
  where name <> '{HEAD_OFFICE}'),
s as (select shop_id, cast(date as date) as day, sum(total_cents) x from totals where not hidden and has_lines group by 1, 2)
select g.shop_id, g.name, strftime(g.day, '%Y-%m-%d') as day, cast(coalesce(x, 0) as bigint) as amount_cents
from grid g left join s on s.shop_id = g.shop_id and s.day = g.day
""",
)(lambda t: A.shop_daily_sales(t, as_of=AS_OF, days=SHOP_DAILY_DAYS, head_office=HEAD_OFFICE))

query(
    "recent_orders", "totals i_shop i_staff",
    """
select o.id, s.name as shop, f.name as staff, cast(total_cents as bigint) as total_cents,
  strftime(date, '%Y-%m-%d %H:%M:%S') as date
from (select * from totals where not hidden order by id desc limit 10) o
left join i_shop s on s.id = o.shop_id left join i_staff f on f.id = o.staff_id
""",
)(A.recent_orders)
query(
    "notice_list", "i_posts",
    "select id, title, note, strftime(date, '%Y-%m-%d') as date from i_posts where not hidden",
)(A.notice_list)
query(
    "product_daily_sales", "v_sold",
    """
with s as (select product_id, strftime(date, '%Y-%m-%d') as day, cast(sum(quantity) as bigint) as quantity
  from v_sold group by 1, 2)
select *, cast(sum(quantity) over (partition by product_id) as bigint) as total from s where quantity <> 0
""",
)(A.product_daily_sales)
query(
    "product_units_sold", "v_sold i_products",
    """
select p.id as product_id, cast(coalesce(sum(quantity), 0) as bigint) as units_sold
from i_products p left join v_sold s on s.product_id = p.id group by 1
""",
)(A.product_units_sold)
query(
    "product_card", "i_products i_category summary v_sold shop_stock",
    """
select p.id as product_id, p.name, par.name as parent, c.name as category, p.barcode, p.size, s.avg_cost_cents,
  cast(coalesce(u.q, 0) as bigint) as units_sold, s.in_qty, s.out_qty, s.on_hand,
  cast(coalesce(ss.q, 0) as bigint) as shop_stock, p.hidden, p.note
from i_products p left join i_category c on c.id = p.category_id left join i_category par on par.id = c.pid_id
left join summary s on s.product_id = p.id
left join (select product_id, sum(quantity) q from v_sold group by 1) u on u.product_id = p.id
left join (select product_id, sum(stock) q from shop_stock group by 1) ss on ss.product_id = p.id
""",
)(A.product_card)
query(
    "product_card_staff", "i_products i_category summary v_sold shop_stock",
    """
select p.id as product_id, p.name, par.name as parent, c.name as category, p.barcode, p.size, cast(null as bigint) as avg_cost_cents,
  cast(coalesce(u.q, 0) as bigint) as units_sold, s.in_qty, s.out_qty, s.on_hand,
  cast(coalesce(ss.q, 0) as bigint) as shop_stock, p.hidden, p.note
from i_products p left join i_category c on c.id = p.category_id left join i_category par on par.id = c.pid_id
left join summary s on s.product_id = p.id
left join (select product_id, sum(quantity) q from v_sold where shop_id = 7 group by 1) u on u.product_id = p.id
left join (select product_id, sum(stock) q from shop_stock group by 1) ss on ss.product_id = p.id
""",
)(lambda t: A.product_card(t, level=5, shop_id=7))
query(
    "order_lines", "i_sellorderdetail i_sellorder i_products",
    """
select l.id, oid_id, product_id, p.name as pname, p.size as psize, price_cents, quantity,
  quantity * price_cents as amount_cents, discount_cents, o.note
from i_sellorderdetail l join i_sellorder o on o.id = l.oid_id left join i_products p on p.id = l.product_id
""",
)(A.order_lines)

# -- order search ----------------------------------------------------------------------

FIELDS = {"code": "o1", "note": "-", "s_date": date(1996, 1, 1), "e_date": date(2001, 7, 31)}
_WHERE = (
    "contains(lower(code), 'o1') and contains(note, '-') and not hidden "
    "and date >= timestamp '1996-01-01' and date <= timestamp '2001-08-01'"
)
query(
    "order_search", "totals",
    f"""
select id, code, customer_id, shop_id, staff_id, discount_cents, strftime(date, '%Y-%m-%d %H:%M:%S') as date,
  hidden, note, cast(total_cents as bigint) as total_cents from totals where {_WHERE}
""",
)(lambda t: Q.order_search(t, as_of=AS_OF, **FIELDS))

_ROWS = """
select o.id, o.code, cast(total_cents as bigint) as total_cents, discount_cents, strftime(o.date, '%Y-%m-%d') as day,
  coalesce(c.name, '未登记') as customer, coalesce(customer_id, 0) as customer_id, f.name as staff, staff_id,
  o.note, o.hidden
from ({src}) o left join i_customer c on c.id = o.customer_id left join i_staff f on f.id = o.staff_id
"""
_ROW_NEEDS = "totals i_customer i_staff"
query(
    "order_search_page", _ROW_NEEDS,
    _ROWS.format(src=f"select * from totals where {_WHERE} order by id desc limit 20 offset 40"),
)(lambda t: Q.order_search_page(t, as_of=AS_OF, page=3, **FIELDS))
query(
    "order_search_summary", "totals",
    f"""
select count(*) as rows, cast(ceil(count(*) / 20.0) as bigint) as pages,
  cast(coalesce(sum(total_cents), 0) as bigint) as t_total_cents from totals where {_WHERE}
""",
)(lambda t: Q.order_search_summary(t, as_of=AS_OF, **FIELDS))
query(
    "order_search_simple", _ROW_NEEDS,
    _ROWS.format(src="select * from totals where shop_id = 3 order by id desc limit 15"),
)(lambda t: Q.order_search_simple(t, 15, level=6, shop_id=3))
query("order_search_exact", _ROW_NEEDS, _ROWS.format(src="select * from totals where id = 42 and not hidden"))(
    lambda t: Q.order_search_exact(t, 42)
)

# -- reports ---------------------------------------------------------------------------

_REPORT_BODY = f"""
with m as (select * from totals where {_WHERE}),
b as (select row_number() over (order by m.date, m.id, l.id) as no, s.name as shop,
  strftime(m.date, '%Y-%m-%d %H:%M:%S') as date, p.name as product, p.size, c.name as category, price_cents, quantity,
  quantity * price_cents as subtotal_cents
from m join i_sellorderdetail l on l.oid_id = m.id left join i_shop s on s.id = m.shop_id
left join i_products p on p.id = l.product_id left join i_category c on c.id = p.category_id)
"""
_REPORT_NEEDS = "totals i_sellorderdetail i_shop i_products i_category"


def dec(cents: str) -> str:
    """Cents as '12.34' text, in integer arithmetic."""
    return (
        f"concat(case when {cents} < 0 then '-' else '' end, cast(abs({cents}) // 100 as varchar), '.', "
        f"lpad(cast(abs({cents}) % 100 as varchar), 2, '0'))"
    )


query("sales_report_lines", _REPORT_NEEDS, _REPORT_BODY + "select * from b")(
    lambda t: R.sales_report_lines(t, as_of=AS_OF, **FIELDS)
)
SALES_REPORT_SQL = (
    _REPORT_BODY
    + f"""
, f as (select cast(coalesce(sum(discount_cents), 0) as bigint) d, cast(coalesce(sum(total_cents), 0) as bigint) x from m)
select no as ordinal, cast(no as varchar) as no, coalesce(shop, '') as shop, date, coalesce(product, '') as product,
  coalesce(size, '') as size, coalesce(category, '') as category, {dec("price_cents")} as price,
  cast(quantity as varchar) as quantity, {dec("subtotal_cents")} as subtotal from b
union all select 9223372036854775807, '', '', '', '', '', '折扣总额', {dec("d")}, '实收', {dec("x")} from f
"""
)
query("sales_report", _REPORT_NEEDS, SALES_REPORT_SQL)(lambda t: R.sales_report(t, as_of=AS_OF, **FIELDS))

STOCK_REPORT_SQL = """
select s.shop_id, row_number() over (partition by s.shop_id order by s.product_id desc) + 1 as no, s.product_id,
  p.name, p.barcode, p.size, s.stock, m.on_hand as depot_stock, '正常' as status
from shop_stock s join i_products p on p.id = s.product_id join summary m on m.product_id = s.product_id
where not p.hidden
"""
query("stock_report", "shop_stock i_products summary", STOCK_REPORT_SQL)(R.stock_report)
query(
    "stock_report_depot", "depot_stock i_products summary",
    STOCK_REPORT_SQL.replace("shop_stock", "depot_stock").replace("shop_id", "depot_id"),
)(lambda t: R.stock_report(t, container="depot"))

# -- products --------------------------------------------------------------------------

query(
    "sellable_products", "shop_stock v_sold i_products",
    f"""
select * exclude (rn) from (
select s.shop_id, s.product_id, p.name, p.barcode, s.stock,
  coalesce({dec("pc")}, '') as price, coalesce(p.size, '0') as size,
  row_number() over (partition by s.shop_id order by s.stock desc, s.product_id) as rn
from shop_stock s join i_products p on p.id = s.product_id
left join (select shop_id, product_id, arg_max(price_cents, id) pc from v_sold group by 1, 2) l
  on l.shop_id = s.shop_id and l.product_id = s.product_id
where p.name ilike '%in%' or p.barcode ilike '%in%') where rn <= 25
""".replace("coalesce(concat(case", "coalesce(case when pc is not null then concat(case").replace(
        "2, '0')), '')", "2, '0')) end, '')"
    ),
)(lambda t: Q.sellable_products(t, q="in", limit=25))
query(
    "returnable_products", "shop_stock i_products",
    """
select s.shop_id, s.product_id, p.name, p.barcode, s.stock from shop_stock s join i_products p on p.id = s.product_id
where s.stock > 0 and (p.name ilike '%ring' or p.barcode ilike '%ring')
""",
)(lambda t: Q.returnable_products(t, q="%ring"))
query(
    "product_search", "i_products",
    """
select id, name, barcode from i_products where not hidden
and (contains(lower(name), 'ring') or contains(barcode, 'ring'))
""",
)(lambda t: Q.product_search(t, "RING"))
query(
    "product_search_first", "i_products",
    """
select id, name, barcode from i_products where not hidden
and (contains(lower(name), 'ring') or contains(barcode, 'ring')) order by id limit 100
""",
)(lambda t: Q.product_search(t, "RING", limit=100))
query(
    "product_search_mini", "i_products summary",
    """
select p.*, on_hand, last_value_cents from (
select id, name, barcode from i_products where not hidden
and (contains(lower(name), '01') or contains(barcode, '01'))) p
left join summary s on s.product_id = p.id
""",
)(lambda t: Q.product_search(t, "01", kind="mini"))
query(
    "product_search_mini_first", "i_products summary",
    """
select p.*, on_hand, last_value_cents from (
select id, name, barcode from i_products where not hidden
and (contains(lower(name), '01') or contains(barcode, '01')) order by id limit 100) p
left join summary s on s.product_id = p.id
""",
)(lambda t: Q.product_search(t, "01", kind="mini", limit=100))

# -- people ----------------------------------------------------------------------------

query(
    "customer_search", "i_customer",
    """
select id, concat_ws('|', name, coalesce(code, 'None'), coalesce(telephone, 'None'), cast(id as varchar)) as label
from i_customer where not hidden
and (contains(lower(name), 'build') or contains(lower(code), 'build') or contains(telephone, 'build'))
""",
)(lambda t: Q.customer_search(t, "Build"))
query(
    "customer_search_first", "i_customer",
    """
select id, concat_ws('|', name, coalesce(code, 'None'), coalesce(telephone, 'None'), cast(id as varchar)) as label
from i_customer where not hidden
and (contains(lower(name), 'build') or contains(lower(code), 'build') or contains(telephone, 'build'))
order by id limit 100
""",
)(lambda t: Q.customer_search(t, "Build", limit=100))
query(
    "staff_search", "i_staff",
    f"select id, shop_id, {STAFF_LABEL.format(a='s')} as label from i_staff s where level <> 0 and contains(lower(name), 'r#0')",
)(lambda t: Q.staff_search(t, "R#0"))
query(
    "customer_list", "i_customer i_shop",
    """
select c.id, c.name, c.code, c.telephone, s.name as shop, c.hidden
from i_customer c left join i_shop s on s.id = c.shop_id
""",
)(Q.customer_list)
