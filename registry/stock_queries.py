"""Stock, cost and movement documents."""

from registry.core import query

from ledgerloom import constants as K
from ledgerloom.plans import stock as S

query(
    "product_summary", "summary",
    "select product_id, avg_cost_cents, on_hand, last_value_cents, in_qty, out_qty from summary",
)(S.product_summary)

query("shop_product_stock", "shop_stock", "select * from shop_stock")(S.shop_product_stock)
query("depot_product_stock", "depot_stock", "select * from depot_stock")(S.depot_product_stock)

_LISTED = (
    "select s.product_id, s.{key}, s.stock, p.name, p.barcode, p.size from {src} s "
    "join i_products p on p.id = s.product_id where not p.hidden"
)
query("shop_stock_list", "shop_stock i_products", _LISTED.format(key="shop_id", src="shop_stock"))(S.shop_stock_list)
query("depot_stock_list", "depot_stock i_products", _LISTED.format(key="depot_id", src="depot_stock"))(
    S.depot_stock_list
)

_TOTAL = """
with s as (
  select {key}, cast(sum(stock) as bigint) as stock from (
    select {key}, quantity as stock from {plus} union all
    select {key}, -quantity from {minus} where {key} in (select {key} from {plus})) group by 1)
select {key}, stock, name, cast(sum(stock) over () as bigint) as total,
  cast(stock as double) * 100 / cast(sum(stock) over () as double) as share
from s join {dim} d on d.id = s.{key} where stock <> 0
"""
query(
    "shop_stock_total", "v_out v_sold i_shop",
    _TOTAL.format(key="shop_id", plus="v_out", minus="v_sold", dim="i_shop"),
)(S.shop_stock_total)
query(
    "depot_stock_total", "v_in v_out i_depot",
    _TOTAL.format(key="depot_id", plus="v_in", minus="v_out", dim="i_depot"),
)(S.depot_stock_total)

_NET_DEPOT = """
with net as (
  select product_id, depot_id, cast(sum(quantity) as bigint) as stock from (
    select product_id, depot_id, quantity from v_in union all
    select product_id, depot_id, -quantity from v_out) group by 1, 2)
"""
query(
    "product_by_depot", "v_in v_out i_products i_depot",
    _NET_DEPOT + """
select p.id as product_id, d.id as depot_id, d.name, coalesce(net.stock, 0) as stock
from i_products p join i_depot d on not d.hidden
left join net on net.product_id = p.id and net.depot_id = d.id
""",
)(S.product_by_depot)
query(
    "product_by_depot_chart", "v_in v_out i_depot",
    _NET_DEPOT + """
select product_id, depot_id, stock, name,
  cast(sum(stock) over (partition by product_id) as bigint) as total,
  case when sum(stock) over (partition by product_id) <> 0 then
  cast(stock as double) * 100 / cast(sum(stock) over (partition by product_id) as double) end as share
from net join i_depot d on d.id = net.depot_id where stock <> 0
""",
)(S.product_by_depot_chart)

query(
    "product_by_shop", "shop_stock i_shop",
    "select shop_id, product_id, stock, name from shop_stock join i_shop on id = shop_id",
)(S.product_by_shop)
query(
    "product_by_shop_chart", "shop_stock i_shop",
    """
select shop_id, product_id, stock, name,
  cast(sum(stock) over (partition by product_id) as bigint) as total,
  case when sum(stock) over (partition by product_id) <> 0 then
  cast(stock as double) * 100 / cast(sum(stock) over (partition by product_id) as double) end as share
from shop_stock join i_shop on id = shop_id where stock <> 0
""",
)(S.product_by_shop_chart)

# q * paid / received in millionths of a cent, rounded half up once
_VALUE = (
    "{q} * (c // n) * 1000000 + sign({q}) * ((abs({q}) * (c % n) * 2000000 + n) // (2 * n))"
)
query(
    "depot_value", "i_indetail v_in v_out i_depot",
    """
with pos as (
  select i.depot_id, i.product_id, i.q - coalesce(o.q, 0) as stock from
  (select depot_id, product_id, sum(quantity) q from i_indetail group by 1, 2) i left join
  (select depot_id, product_id, sum(quantity) q from v_out group by 1, 2) o
  on o.depot_id = i.depot_id and o.product_id = i.product_id),
paid as (select product_id, sum(quantity * value_cents)::hugeint as c, sum(quantity)::hugeint as n from v_in group by 1),
val as (select depot_id, sum(stock) as quantity, sum(@VALUE) as x from pos join paid using (product_id) group by 1)
select d.id as depot_id, d.name, cast(coalesce(quantity, 0) as bigint) as quantity,
  cast(coalesce(sign(x) * ((abs(x) + 500000) // 1000000), 0) as bigint) as amount_cents
from i_depot d left join val on val.depot_id = d.id
""".replace("@VALUE", _VALUE.format(q="stock")),
)(S.depot_value)

query(
    "out_line_cost", "i_outdetail summary",
    """
select o.id, outid_id, o.product_id, quantity, quantity * avg_cost_cents as amount_cents
from i_outdetail o join summary s on s.product_id = o.product_id
""",
)(S.out_line_cost)

query(
    "receipt_summary", "i_instream i_indetail",
    """
select h.id as inid_id, coalesce(n, 0) as lines, cast(coalesce(q, 0) as bigint) as quantity,
  cast(coalesce(c, 0) as bigint) as amount_cents
from i_instream h left join (select inid_id, count(*) n, sum(quantity) q, sum(quantity * value_cents) c
  from i_indetail group by 1) d on d.inid_id = h.id
""",
)(S.receipt_summary)

_ISSUE_SUM = """
with paid as (select product_id, sum(quantity * value_cents)::hugeint as c, sum(quantity)::hugeint as n from i_indetail group by 1),
s as (select outid_id, sum(quantity) as q, sum(@VALUE) as x from i_outdetail join paid using (product_id) group by 1)
""".replace("@VALUE", _VALUE.format(q="quantity"))
query(
    "issue_summary", "i_outstream i_outdetail i_indetail",
    _ISSUE_SUM + """
select h.id as outid_id, cast(coalesce(q, 0) as bigint) as quantity,
  cast(coalesce(sign(x) * ((abs(x) + 500000) // 1000000), 0) as bigint) as amount_cents
from i_outstream h left join s on s.outid_id = h.id
""",
)(S.issue_summary)

def _case(labels):
    return "case {c} " + " ".join(f"when {code} then '{label}'" for code, label in labels.items()) + " end"


LEVEL_CASE, SUPPLIER_CASE = _case(K.LEVELS), _case(K.SUPPLIERS)
STAFF_LABEL = "concat_ws(' ', " + LEVEL_CASE.format(c="{a}.level") + ", {a}.name)"

query(
    "receipt_list", "i_instream i_indetail i_staff",
    f"""
select h.id, h.code, {SUPPLIER_CASE.format(c="h.supplier")} as supplier, strftime(h.date, '%Y-%m-%d') as date,
  h.hidden, k.name as keeper, case when s.id is not null then {STAFF_LABEL.format(a="s")} end as staff1,
  coalesce(n, 0) as lines, cast(coalesce(q, 0) as bigint) as quantity, cast(coalesce(c, 0) as bigint) as amount_cents
from i_instream h left join (select inid_id, count(*) n, sum(quantity) q, sum(quantity * value_cents) c
  from i_indetail group by 1) d on d.inid_id = h.id
left join i_staff k on k.id = h.keeper_id left join i_staff s on s.id = h.staff1_id
""",
)(S.receipt_list)

_OUT_LIST = (
    _ISSUE_SUM
    + f"""
select h.id, h.code, sh.name as shop, strftime(h.date, '%Y-%m-%d %H:%M:%S') as date, h.hidden, k.name as keeper,
  case when st.id is not null then {STAFF_LABEL.format(a="st")} end as staff1,
  cast(coalesce(q, 0) as bigint) as quantity,
  cast(coalesce(sign(x) * ((abs(x) + 500000) // 1000000), 0) as bigint) as amount_cents
from i_outstream h left join s on s.outid_id = h.id
left join i_staff k on k.id = h.keeper_id left join i_staff st on st.id = h.staff1_id
left join i_shop sh on sh.id = h.shop_id where """
)
_OUT_NEEDS = "i_outstream i_outdetail i_indetail i_staff i_shop"
query("issue_list", _OUT_NEEDS, _OUT_LIST + "not h.returned")(S.issue_list)
query("return_list", _OUT_NEEDS, _OUT_LIST + "h.returned")(S.return_list)

query(
    "receipt_lines", "i_indetail i_products i_depot",
    """
select l.id, inid_id, product_id, p.name as product, value_cents, quantity, d.name as depot,
  quantity * value_cents as amount_cents
from i_indetail l left join i_products p on p.id = product_id left join i_depot d on d.id = depot_id
where quantity > 0
""",
)(S.receipt_lines)

_OUT_LINES = """
select l.id, outid_id, h.shop_id, l.product_id, p.name as product, abs(quantity) as quantity, d.name as depot,
  cast({stock} as bigint) as shop_stock
from i_outdetail l join i_outstream h on h.id = l.outid_id
left join i_products p on p.id = l.product_id left join i_depot d on d.id = depot_id {join}
where quantity <> 0 and {test}
"""
query(
    "issue_lines", "i_outdetail i_outstream i_products i_depot",
    _OUT_LINES.format(stock="0", join="", test="not h.returned"),
)(S.issue_lines)
query(
    "return_lines_stock", "i_outdetail i_outstream i_products i_depot shop_stock",
    _OUT_LINES.format(
        stock="ss.stock", test="h.returned",
        join="left join shop_stock ss on ss.shop_id = h.shop_id and ss.product_id = l.product_id",
    ),
)(S.return_lines_stock)

query(
    "receipt_search", "i_indetail i_instream",
    """
select l.inid_id, l.product_id, cast(sum(quantity) as bigint) as product_qty, h.code,
  strftime(h.date, '%Y-%m-%d') as date, h.hidden
from i_indetail l join i_instream h on h.id = l.inid_id where quantity > 0
group by l.inid_id, l.product_id, h.code, h.date, h.hidden having bool_or(depot_id = 1)
""",
)(lambda t: S.receipt_search(t, depot_id=1))

query(
    "issue_search", "i_outdetail i_outstream",
    """
with f as (
  select l.outid_id, l.product_id, cast(sum(quantity) as bigint) as product_qty, h.code, h.shop_id,
    strftime(h.date, '%Y-%m-%d %H:%M:%S') as date, h.hidden
  from i_outdetail l join i_outstream h on h.id = l.outid_id
  where quantity <> 0 and h.returned and not h.hidden group by all)
select *, cast(sum(product_qty) over (partition by product_id) as bigint) as total_qty from f
""",
)(lambda t: S.issue_search(t, returned=True))
