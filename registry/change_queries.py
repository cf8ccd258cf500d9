"""Ledger change jobs, each fed a batch that Spark derives from the tables.

Every job gets changes for whole tables; which of them are refused follows from the rows'
own values.
"""

from pyspark.sql import functions as F
from registry.catalog_queries import CUSTOMER_ERR, CUSTOMER_TEXT, customer_text
from registry.core import AS_OF, HEAD_OFFICE, query, stored

from ledgerloom import constants as K
from ledgerloom.plans import changes as J


def _s(c):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _worded(wording, *parts):
    """SQL for an audit entry of the operator ``op``."""
    return f"printf('{wording}', '{AS_OF}', 'op', {', '.join(parts)})"


# -- hiding, headers, master data ------------------------------------------------------

query(
    "soft_delete", "i_sellorder i_remit",
    "select id, hidden or id in (select id from i_remit where supplier = 2) as hidden from i_sellorder",
)(lambda t: J.soft_delete(t, "sellorder", t["remit"].filter("supplier = 2")).tables["sellorder"].select("id", "hidden"))
for _table in ("instream", "outstream"):
    query(
        f"soft_delete_{_table}", f"i_{_table} i_remit",
        f"select id, hidden or id in (select id from i_remit where supplier = 3) as hidden from i_{_table}",
    )(lambda t, table=_table: J.soft_delete(t, table, t["remit"].filter("supplier = 3")).tables[table].select("id", "hidden"))


def header_changes(t, table):
    """Each header of a table: every seventh sent in as new, the others changed; coded ones twice, the first time with a bad code.

    Headers without a code all ask for the same one.
    """
    party = (
        (F.col("supplier").cast("bigint") % 4 + 1).alias("supplier")
        if table == "instream" else ((F.col("shop_id") + 1) % 27).alias("shop_id")
    )
    base = t[table].select(
        (F.col("id") * 2 + 1).alias("seq"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("id"),
        F.concat(F.coalesce("code", F.lit("NEW1")), F.when(F.col("note") == "5-LOW", "-").otherwise("x")).alias("code"),
        party, F.col("date").alias("date"), "keeper_id", "staff1_id", (F.col("note") == "2-HIGH").alias("hidden"), "note",
    )
    first = base.filter(~F.col("code").startswith("NEW1")).withColumn("seq", F.col("seq") - 1).withColumn(
        "code", F.when(F.col("note") == "1-URGENT", F.lit("!")).otherwise(F.concat("code", F.lit("0")))
    )
    return base.unionByName(first)


def _header_sql(table, party, links, reason):
    return f"""
with b as (select h.id * 2 + 1 as seq, case when h.id % 7 <> 0 then h.id end as id,
    concat(coalesce(code, 'NEW1'), case when note = '5-LOW' then '-' else 'x' end) as code,
    {party}, note, note = '2-HIGH' as hidden, coalesce(s.level, 0) as level, k.id as keeper
  from {table} h left join i_staff s on s.id = h.staff1_id left join i_staff k on k.id = h.keeper_id),
x as (select * from b union all
  select seq - 1, id, case when note = '1-URGENT' then '!' else concat(code, '0') end, * exclude (seq, id, code)
  from b where code not like 'NEW1%'),
c as (select x.*, case when not regexp_full_match(code, '[A-Za-z0-9]{{4,20}}') then 'code' {reason}
  when keeper is null then 'keeper' when level < 5 then 'staff1' end as broken from x {links}),
o as (select *, case when broken is null then min(case when broken is null then seq end) over (partition by code) end as first from c),
r as (select o.*, coalesce(o.broken, case when o.seq > o.first and not coalesce(o.id = p.id, false) then 'duplicate_code' end) as reason
  from o left join c p on p.seq = o.first),
w as (select * from r where reason is null and id is not null qualify row_number() over (partition by id order by seq desc) = 1)
"""


_IN = _header_sql("i_instream", "h.supplier % 4 + 1 as supplier", "", "")
_OUT = _header_sql(
    "i_outstream", "(h.shop_id + 1) % 27 as shop_id",
    f"left join i_shop on i_shop.id = x.shop_id and i_shop.name <> '{HEAD_OFFICE}'", "when i_shop.id is null then 'shop'",
)
_HEADERS = """
select h.id, coalesce(w.code, h.code) as code, coalesce(w.{party}, h.{party}) as {party}, coalesce(w.hidden, h.hidden) as hidden{more}
from {table} h left join w on w.id = h.id
union all select (select max(id) from {table}) + row_number() over (order by seq), code, {party}, false{new}
from r where id is null and reason is null
"""
query(
    "upsert_headers", "i_instream i_staff",
    _IN + _HEADERS.format(table="i_instream", party="supplier", more="", new=""),
)(lambda t: J.upsert_headers(t, "instream", header_changes(t, "instream"), head_office=HEAD_OFFICE).tables["instream"].select(
    "id", "code", F.col("supplier").cast("bigint").alias("supplier"), "hidden"))
query(
    "upsert_headers_rejected", "i_instream i_staff", _IN + "select seq, id, reason from r where reason is not null",
)(lambda t: J.upsert_headers(t, "instream", header_changes(t, "instream"), head_office=HEAD_OFFICE).rejected)
query(
    "upsert_headers_out", "i_outstream i_staff i_shop",
    _OUT + _HEADERS.format(table="i_outstream", party="shop_id", more=", h.returned", new=", true"),
)(lambda t: J.upsert_headers(
    t, "outstream", header_changes(t, "outstream"), returned=True, head_office=HEAD_OFFICE
).tables["outstream"].select("id", "code", "shop_id", "hidden", "returned"))
query(
    "upsert_headers_out_rejected", "i_outstream i_staff i_shop", _OUT + "select seq, id, reason from r where reason is not null",
)(lambda t: J.upsert_headers(t, "outstream", header_changes(t, "outstream"), returned=True, head_office=HEAD_OFFICE).rejected)

def passed_on_codes(t):
    """Of every three headers in a row: the first moves to another code (an invalid one at times), the second takes its code and
    a new header the second's; the third asks for the first one's code before that."""
    h = t["instream"].filter("code is not null").select("id", "code", "note", "date")
    first, second, third = (h.filter(F.col("id") % 3 == i).select(
        (F.col("id") - i).alias("at"), *[F.col(c).alias(f"{c}{i}") for c in h.columns]) for i in range(3))
    group = first.join(second, "at").join(third, "at").drop("at")
    moved = F.when(F.col("note0") != "5-LOW", F.concat("code0", F.lit("r"))).otherwise("!")
    nobody = F.lit(None).cast("bigint")
    asks = [(1, F.col("id2"), F.col("code0")), (2, F.col("id0"), moved), (3, F.col("id1"), F.col("code0")), (4, nobody, F.col("code1"))]
    each = F.explode(F.array(*[F.struct((F.col("id0") * 10 + n).alias("seq"), i.alias("id"), c.alias("code")) for n, i, c in asks]))
    return group.select(each.alias("c"), F.col("note2").alias("note"), F.col("date2").alias("date")).select(
        "c.*", F.lit(1).cast("bigint").alias("supplier"), "date", F.lit(6).cast("bigint").alias("keeper_id"),
        F.lit(6).cast("bigint").alias("staff1_id"), F.lit(False).alias("hidden"), "note",
    )


_PASSED_ON = """
with h as (select * from i_instream where code is not null),
g as (select a.id, a.code as code0, b.code as code1, a.note <> '5-LOW' as moved,
    regexp_full_match(a.code, '[A-Za-z0-9]{4,20}') as fine0, regexp_full_match(b.code, '[A-Za-z0-9]{4,20}') as fine1,
    regexp_full_match(a.code || 'r', '[A-Za-z0-9]{4,20}') as fine_r
  from h a join h b on b.id = a.id + 1 join h c on c.id = a.id + 2 where a.id % 3 = 0),
r as (select *, moved and fine_r as ok2, moved and fine_r and fine0 as ok3, moved and fine_r and fine0 and fine1 as ok4 from g)
"""
query(
    "upsert_headers_released", "i_instream",
    _PASSED_ON + """
select h.id, case when a.ok2 then h.code || 'r' when b.ok3 then b.code0 else h.code end as code
from i_instream h left join r a on a.id = h.id left join r b on b.id + 1 = h.id
union all select (select max(id) from i_instream) + row_number() over (order by id), code1 from r where ok4
""",
)(lambda t: J.upsert_headers(t, "instream", passed_on_codes(t), head_office=HEAD_OFFICE).tables["instream"].select("id", "code"))
query(
    "upsert_headers_released_rejected", "i_instream",
    _PASSED_ON + """
select id * 10 + 1 as seq, id + 2 as id, case when fine0 then 'duplicate_code' else 'code' end as reason from r
union all select id * 10 + 2, id, 'code' from r where not ok2
union all select id * 10 + 3, id + 1, case when fine0 then 'duplicate_code' else 'code' end from r where not ok3
union all select id * 10 + 4, null, case when fine1 then 'duplicate_code' else 'code' end from r where not ok4
""",
)(lambda t: J.upsert_headers(t, "instream", passed_on_codes(t), head_office=HEAD_OFFICE).rejected)


def customer_changes(t):
    """Each customer: those of the first shops as new, the others changed twice."""
    rows = customer_text(t)
    last = rows.withColumn("seq", F.col("id") * 2 + 1).withColumn("id", F.when(F.col("shop_id") >= 5, F.col("id")))
    first = rows.filter(F.col("shop_id") >= 5).withColumn("seq", F.col("id") * 2).withColumn("name", F.lit("早名一"))
    return last.unionByName(first)


_CUSTOMER_CHANGES = f"""
with c as ({CUSTOMER_TEXT}),
x as (select c.* exclude (id), c.id * 2 + 1 as seq, case when c.shop_id >= 5 then c.id end as id from c
  union all select c.* exclude (id) replace ('早名一' as name), c.id * 2, c.id from c where c.shop_id >= 5),
r as (select *, {" ".join(f"case when {CUSTOMER_ERR[n]} then '{n}' else" for n in CUSTOMER_ERR)} null
  {"end " * len(CUSTOMER_ERR)} as reason from x),
w as (select * from r where reason is null and id is not null qualify row_number() over (partition by id order by seq desc) = 1)
"""
query(
    "upsert_customers", "i_customer",
    _CUSTOMER_CHANGES + """
select i.id, coalesce(w.name, i.name) as name, case when w.id is null then i.code else w.code end as code,
  case when w.id is null then i.telephone else w.telephone end as telephone, i.hidden
from i_customer i left join w on w.id = i.id
union all select (select max(id) from i_customer) + row_number() over (order by seq), name, code, telephone, false
from r where id is null and reason is null
""",
)(
    lambda t: J.upsert_customers(t, customer_changes(t)).tables["customer"].select("id", "name", "code", "telephone", "hidden")
)
query(
    "upsert_customers_rejected", "i_customer", _CUSTOMER_CHANGES + "select seq, id, reason from r where reason is not null",
)(lambda t: J.upsert_customers(t, customer_changes(t)).rejected)
def product_changes(t):
    """Each product: those without a size as new; hidden ones into no category, some into a root."""
    category = F.when(F.col("hidden"), -1).when(F.col("id") % 10 == 0, F.call_function("div", F.col("category_id"), F.lit(100)))
    return t["products"].select(
        F.col("id").alias("seq"), F.when(F.col("size").isNotNull(), F.col("id")).alias("id"),
        F.concat("name", F.lit(" II")).alias("name"), "barcode",
        category.otherwise(F.col("category_id")).cast("bigint").alias("category_id"), "size",
        F.col("size").startswith("1").alias("hidden"), F.repeat("note", F.lit(12)).alias("note"),
    )


_PRODUCT_CHANGES = """
with parents as (select distinct pid_id from i_category where not hidden and pid_id is not null),
form as (select id from i_category where not hidden and pid_id in (select pid_id from parents)),
x as (select id as seq, case when size is not null then id end as id, concat(name, ' II') as name, barcode,
    case when hidden then -1 when id % 10 = 0 then category_id // 100 else category_id end as category_id, size,
    size like '1%' as hidden, repeat(note, 12) as note from i_products),
r as (select *, case when length(note) > 100 then 'note' when category_id not in (select id from form) then 'category' end
  as reason from x)
"""
query(
    "upsert_products", "i_products i_category",
    _PRODUCT_CHANGES + """
select i.id, coalesce(r.name, i.name) as name, coalesce(r.hidden, i.hidden) as hidden
from i_products i left join r on r.id = i.id and reason is null
union all select (select max(id) from i_products) + row_number() over (order by seq), name, false
from r where id is null and reason is null
""",
)(lambda t: J.upsert_products(t, product_changes(t)).tables["products"].select("id", "name", "hidden"))
query(
    "upsert_products_rejected", "i_products i_category",
    _PRODUCT_CHANGES + "select seq, id, reason from r where reason is not null",
)(lambda t: J.upsert_products(t, product_changes(t)).rejected)
query(
    "upsert_remits", "i_remit i_staff",
    """
with x as (select r.id as seq, case when not hidden then r.id end as id, supplier + 1 as supplier, amount_cents + 100 as amount_cents,
  coalesce(s.level, 99) as level from i_remit r left join i_staff s on s.id = r.staff_id),
g as (select * from x where supplier <= 4 and level < 99)
select r.id, coalesce(g.supplier, r.supplier) as supplier, coalesce(g.amount_cents, r.amount_cents) as amount_cents, r.hidden
from i_remit r left join g on g.id = r.id
union all select (select max(id) from i_remit) + row_number() over (order by seq), supplier, amount_cents, false
from g where id is null
""",
)(
    lambda t: J.upsert_remits(
        t,
        t["remit"].select(
            F.col("id").alias("seq"), F.when(~F.col("hidden"), F.col("id")).alias("id"),
            (F.col("supplier").cast("bigint") + 1).alias("supplier"), (F.col("amount") + 1).cast("decimal(8,2)").alias("amount"),
            "staff_id", "date", "hidden", "note",
        ),
    ).tables["remit"].select("id", F.col("supplier").cast("bigint").alias("supplier"), "amount", "hidden")
)

# -- receipt lines ---------------------------------------------------------------------

query(
    "add_receipt_lines", "i_outdetail i_indetail",
    """
select id, inid_id, product_id, quantity, value_cents, depot_id from i_indetail
union all select (select max(id) from i_indetail) + row_number() over (order by id), outid_id, product_id, quantity, 1250, depot_id
from i_outdetail where quantity > 0 and quantity * 3 <= 100 and id % 50 > 2
""",
)(
    lambda t: J.add_receipt_lines(
        t,
        t["outdetail"].select(
            F.col("id").alias("seq"), F.col("outid_id").alias("inid_id"), "product_id", "depot_id",
            F.when(F.col("id") % 50 == 0, "123456789").otherwise("12.5").alias("value"),
            F.when(F.col("id") % 50 == 1, F.repeat(F.lit("9"), F.lit(20))).when(F.col("id") % 50 == 2, "3000000000")
            .otherwise(F.col("quantity").cast("string")).alias("quantity"),
            F.repeat(F.lit("x"), F.abs(F.col("quantity")) * 3).alias("depotdetail"),
        ),
    ).tables["indetail"].select(
        "id", "inid_id", "product_id", F.col("quantity").cast("bigint").alias("quantity"), "value", "depot_id"
    )
)


def _on(t, job, batch, *names, **options):
    """``job`` on a batch made from the tables, of which those ``names`` are kept."""
    t = stored(t, *names)
    return job(t, batch(t), as_of=AS_OF, **options)


def receipt_deletes(t):
    """A request to delete every receipt line, newest first."""
    return t["indetail"].select((-F.col("id")).alias("seq"), "id")


# One step per product at a time: the k-th request of every product is decided in step k.
_DELETE_STEPS = """
with recursive req as materialized (
  select l.id, l.product_id, l.quantity, case when h.hidden then 0 else l.quantity end as delta,
    row_number() over (partition by l.product_id order by l.id desc) as k
  from i_indetail l join i_instream h on h.id = l.inid_id),
cap as materialized (select product_id, in_qty - out_qty - 1 as c from summary),
walk as (
  select r.id, r.product_id, r.k, r.quantity <= c as ok, c - case when r.quantity <= c then delta else 0 end as rest
  from req r join cap using (product_id) where r.k = 1
  union all
  select r.id, r.product_id, r.k, r.quantity <= rest, rest - case when r.quantity <= rest then delta else 0 end
  from walk w join req r on r.product_id = w.product_id and r.k = w.k + 1)
"""
query(
    "delete_receipt_lines", "i_indetail i_instream summary",
    _DELETE_STEPS + "select id from walk where not ok",
)(lambda t: _on(t, J.delete_receipt_lines, receipt_deletes, "indetail").tables["indetail"].select("id"))
query(
    "delete_receipt_lines_audit", "i_indetail i_instream summary i_products i_depot",
    _DELETE_STEPS + """
select l.inid_id as header_id, -l.id as seq, """ + _worded(
        K.AUDIT_DELETE_RECEIPT, "p.name", "l.quantity::varchar",
        "(l.value_cents // 100)::varchar || '.' || lpad((l.value_cents % 100)::varchar, 2, '0')", "d.name",
    ) + """ as entry
from walk w join i_indetail l on l.id = w.id join i_products p on p.id = l.product_id join i_depot d on d.id = l.depot_id
where ok
""",
)(lambda t: _on(t, J.delete_receipt_lines, receipt_deletes, "indetail", operator="op").audit)


def receipt_deletes_again(t):
    """The same, and every third line a second time."""
    again = t["indetail"].filter(F.col("id") % 3 == 0).select((10**12 - F.col("id")).alias("seq"), "id")
    return receipt_deletes(t).unionByName(again)


query(
    "delete_receipt_lines_rejected", "i_indetail i_instream summary",
    _DELETE_STEPS + """
select -id as seq, id, 'stock_issued' as reason from walk where not ok
union all select 1000000000000 - id, id, case when ok then 'unknown_id' else 'stock_issued' end from walk where id % 3 = 0
""",
)(lambda t: _on(t, J.delete_receipt_lines, receipt_deletes_again, "indetail").rejected)


def receipt_edits(t):
    """Every receipt line: quantity down to a part of it, value kept, moved for small ones."""
    return t["indetail"].select(
        F.col("id").alias("seq"), "id", F.col("value").cast("string").alias("value"),
        F.expr("cast(quantity * 2 div 3 as string)").alias("quantity"),
        F.expr("case when quantity < 20 then (depot_id + 1) % 5 else depot_id end").alias("depot_id"),
        F.lit("shelf").alias("depotdetail"),
    )


# State per product: the stock of depots 0..4; the product's stock is their sum.
query(
    "edit_receipt_lines", "i_indetail i_instream v_in v_out i_products",
    """
with recursive req as materialized (
  select l.id, l.product_id, l.quantity as q0, l.quantity * 2 // 3 as q1, l.depot_id as d0,
    case when l.quantity < 20 then (l.depot_id + 1) % 5 else l.depot_id end as d1, not h.hidden as counts,
    row_number() over (partition by l.product_id order by l.id) as k
  from i_indetail l join i_instream h on h.id = l.inid_id where l.quantity * 2 // 3 >= 1),
net as (select product_id, depot_id, sum(quantity) as q from (select product_id, depot_id, quantity from v_in
  union all select product_id, depot_id, -quantity from v_out) group by 1, 2),
start as materialized (select p.id as product_id, [cast(coalesce(sum(case when depot_id = i then q end), 0) as bigint)
  for_i] as s from i_products p left join net on net.product_id = p.id group by 1),
walk as (
  select cast(-1 as bigint) as id, product_id, cast(0 as bigint) as k, false as ok, s, cast(0 as bigint) as q1, cast(0 as bigint) as d1 from start
  union all
  select r.id, r.product_id, r.k, q0 - r.q1 <= list_sum(s) and q0 - r.q1 <= s[r.d1 + 1],
    case when counts and q0 - r.q1 <= list_sum(s) and q0 - r.q1 <= s[r.d1 + 1] then
      [s[1] + case when r.d1 = 0 then r.q1 else 0 end - case when d0 = 0 then q0 else 0 end,
       s[2] + case when r.d1 = 1 then r.q1 else 0 end - case when d0 = 1 then q0 else 0 end,
       s[3] + case when r.d1 = 2 then r.q1 else 0 end - case when d0 = 2 then q0 else 0 end,
       s[4] + case when r.d1 = 3 then r.q1 else 0 end - case when d0 = 3 then q0 else 0 end,
       s[5] + case when r.d1 = 4 then r.q1 else 0 end - case when d0 = 4 then q0 else 0 end] else s end,
    r.q1, r.d1
  from walk w join req r on r.product_id = w.product_id and r.k = w.k + 1)
select l.id, coalesce(w.q1, l.quantity) as quantity, coalesce(w.d1, l.depot_id) as depot_id
from i_indetail l left join walk w on w.id = l.id and w.ok
""".replace(
        "[cast(coalesce(sum(case when depot_id = i then q end), 0) as bigint)\n  for_i]",
        "[" + ", ".join(f"cast(coalesce(sum(case when depot_id = {i} then q end), 0) as bigint)" for i in range(5)) + "]",
    ),
)(
    lambda t: _on(t, J.edit_receipt_lines, receipt_edits, "indetail").tables["indetail"].select(
        "id", F.col("quantity").cast("bigint").alias("quantity"), "depot_id"
    )
)

# -- issue lines -----------------------------------------------------------------------

query(
    "copy_receipt_to_issue", "i_indetail i_instream i_outdetail",
    """
select (select max(id) from i_outdetail) + row_number() over (order by l.inid_id, l.id) as id, inid_id as outid_id, product_id,
  quantity, depot_id from i_indetail l join i_instream h on h.id = inid_id where not h.hidden
union all select id, outid_id, product_id, quantity, depot_id from i_outdetail
""",
)(
    lambda t: J.copy_receipt_to_issue(
        t, t["instream"].select(F.col("id").alias("outid_id"), F.col("id").alias("inid_id"))
    ).tables["outdetail"].select("id", "outid_id", "product_id", F.col("quantity").cast("bigint").alias("quantity"), "depot_id")
)


def issue_adds(t):
    """Every sold quantity handed back, to a depot chosen by product."""
    return t["sellorderdetail"].select(
        F.col("id").alias("seq"), F.col("oid_id").alias("outid_id"), "product_id", (F.col("product_id") % 5).alias("depot_id"),
        F.col("quantity").cast("string").alias("quantity"),
    )


query(
    "add_issue_lines", "i_sellorderdetail i_outstream i_outdetail shop_stock v_sold",
    """
with a as (select d.id as seq, d.product_id, d.quantity, h.shop_id, not h.hidden as counts from i_sellorderdetail d
  join i_outstream h on h.id = d.oid_id),
sold as (select shop_id, product_id, sum(quantity) as q from v_sold group by 1, 2),
w as (select a.*, stock, q, sum(case when counts then -quantity else 0 end) over p as so_far,
    count(case when counts then 1 end) over p as n
  from a left join shop_stock s on s.shop_id = a.shop_id and s.product_id = a.product_id
  left join sold on sold.shop_id = a.shop_id and sold.product_id = a.product_id
  window p as (partition by a.shop_id, a.product_id order by seq))
select seq, (select max(id) from i_outdetail) + row_number() over (order by seq) as id,
  cast(case when stock is null and n = 0 then 0 else coalesce(stock, -q, 0) + so_far end as bigint) as shop_stock from w
""",
)(lambda t: J.add_issue_lines(t, issue_adds(t), returned=True).added)


def issue_edits(t):
    """Every issue line: the quantity doubled, small ones moved to the next depot."""
    return t["outdetail"].select(
        F.col("id").alias("seq"), "id", F.expr("cast(quantity * 2 as string)").alias("quantity"),
        F.expr("case when quantity < 20 then (depot_id + 1) % 5 else depot_id end").alias("depot_id"),
    )


# State per product: the stock of depots 0..4 and the product's issue lines as they stand.
_MOVE = ", ".join(
    f"s[{i + 1}] + case when r.d0 = {i} then q0 else 0 end - case when r.d1 = {i} then r.q1 else 0 end" for i in range(5)
)
query(
    "edit_issue_lines", "i_outdetail i_outstream v_in v_out i_products",
    """
with recursive req as materialized (
  select l.id, l.outid_id as o, l.product_id, l.quantity as q0, l.quantity * 2 as q1, l.depot_id as d0,
    case when l.quantity < 20 then (l.depot_id + 1) % 5 else l.depot_id end as d1, not h.hidden as counts,
    row_number() over (partition by l.product_id order by l.id) as k
  from i_outdetail l join i_outstream h on h.id = l.outid_id where l.quantity > 0),
net as (select product_id, depot_id, sum(i) - sum(o) as q, sum(n) > 0 as live from (
  select product_id, depot_id, quantity as i, 0 as o, 1 as n from v_in
  union all select product_id, depot_id, 0, quantity, 0 from v_out) group by 1, 2),
own as (select product_id, list({'id': id, 'o': outid_id, 'd': depot_id, 'q': quantity}) as ls from i_outdetail group by 1),
start as materialized (select p.id as product_id, [@S] as s, [@L] as live, any_value(ls) as ls
  from i_products p join own on own.product_id = p.id left join net on net.product_id = p.id group by 1),
walk as (
  select cast(-1 as bigint) as id, product_id, cast(0 as bigint) as k, false as ok, s, live, ls,
    cast(0 as bigint) as q1, cast(0 as bigint) as d1 from start
  union all
  select r.id, r.product_id, r.k, n.ok, case when n.ok and counts then [@MOVE] else s end, live,
    case when n.ok then list_transform(ls, lambda x: case when x.id = r.id then {'id': x.id, 'o': x.o, 'd': r.d1, 'q': r.q1}
      else x end) else ls end, r.q1, r.d1
  from walk w join req r on r.product_id = w.product_id and r.k = w.k + 1,
  lateral (select r.q1 <= case when live[r.d1 + 1] then s[r.d1 + 1] else 0 end + q0
    and len(list_filter(ls, lambda x: x.id <> r.id and x.o = r.o and x.d = r.d1 and x.q > 0)) = 0 as ok) n)
select l.id, coalesce(w.q1, l.quantity) as quantity, coalesce(w.d1, l.depot_id) as depot_id
from i_outdetail l left join walk w on w.id = l.id and w.ok
"""
    .replace("@S", ", ".join(f"cast(coalesce(sum(case when depot_id = {i} then q end), 0) as bigint)" for i in range(5)))
    .replace("@L", ", ".join(f"coalesce(bool_or(depot_id = {i} and live), false)" for i in range(5)))
    .replace("@MOVE", _MOVE),
)(
    lambda t: _on(t, J.edit_issue_lines, issue_edits, "outdetail").tables["outdetail"].select(
        "id", F.col("quantity").cast("bigint").alias("quantity"), "depot_id"
    )
)


def issue_deletes(t):
    """Every line of a returned document, every third line twice."""
    returned = t["outstream"].filter("returned").select(F.col("id").alias("outid_id"))
    lines = t["outdetail"].join(returned, "outid_id", "left_semi")
    again = lines.filter(F.col("id") % 3 == 0).select((F.col("id") * 2 + 1).alias("seq"), "id")
    return lines.select((F.col("id") * 2).alias("seq"), "id").unionByName(again)


query(
    "delete_issue_lines", "i_outdetail i_outstream",
    "select l.id, case when h.returned then 0 else l.quantity end as quantity from i_outdetail l "
    "join i_outstream h on h.id = l.outid_id",
)(
    lambda t: J.delete_issue_lines(t, issue_deletes(t), as_of=AS_OF).tables["outdetail"].select(
        "id", F.col("quantity").cast("bigint").alias("quantity")
    )
)
query(
    "audit_log", "i_outdetail i_outstream i_products i_depot",
    """
with twice as (select *, 0 as again from i_outdetail union all select *, 1 from i_outdetail where id % 3 = 0),
e as (select h.id, l.id * 2 + again as seq, """ + _worded(
        K.AUDIT_DELETE_ISSUE, "p.name", "(case when again = 1 then 0 else l.quantity end)::varchar", "d.name"
    ) + """ as entry
  from twice l join i_outstream h on h.id = l.outid_id join i_products p on p.id = l.product_id
  join i_depot d on d.id = l.depot_id where h.returned)
select h.id, string_agg(entry, '' order by seq desc) as log from i_outstream h left join e on e.id = h.id group by 1
""",
)(
    lambda t: J.render_log(
        t["outstream"], J.delete_issue_lines(t, issue_deletes(t), as_of=AS_OF, operator="op").audit
    ).select("id", "log")
)

# -- orders ----------------------------------------------------------------------------


def _documents(t, heads, line):
    lines = t["sellorderdetail"].groupBy("oid_id").agg(F.array_sort(F.collect_list(line)).alias("orderDetail"))
    return heads.join(lines, F.col("_oid") == F.col("oid_id")).drop("_oid", "oid_id")


def new_order_docs(t):
    """Every stored sale submitted again in its shop, in order of its id."""
    heads = t["sellorder"].select(
        F.col("id").alias("_oid"), F.col("id").alias("seq"), "shop_id", "staff_id",
        F.lit("2001-08-01 12:00:00").cast("timestamp_ntz").alias("moment"),
        F.lit("").alias("id"), F.lit("").alias("hidden"), _s("code").alias("code"), _s("customer_id").alias("customer"),
        _s("discount").alias("discount"), _s("note").alias("note"), F.lit("").alias("date"),
    )
    line = F.struct(
        F.lit("").alias("id"), F.col("product_id").cast("string").alias("product"), F.col("price").cast("string").alias("price"),
        F.col("quantity").cast("string").alias("quantity"),
    )
    return _documents(t, heads, line).withColumnRenamed("orderDetail", "lines")


# One step per shop: the k-th order of every shop is decided in step k against the shop's
# stock list, indexed by product.
_ORDER_WALK = """
with recursive claim as (select oid_id, product_id, sum(quantity) as need from i_sellorderdetail group by 1, 2),
ord as materialized (
  select o.id, o.shop_id, list(c.product_id) as ps, list(cast(c.need as bigint)) as ns,
    row_number() over (partition by o.shop_id order by o.id) as k
  from i_sellorder o join claim c on c.oid_id = o.id
  where o.code is null or regexp_full_match(o.code, '[A-Za-z0-9]{4,20}') group by o.id, o.shop_id),
start as materialized (
  select s.shop_id, list(coalesce(st.stock, 0) order by p.id) as stock
  from (select distinct shop_id from i_sellorder) s join i_products p on true
  left join shop_stock st on st.shop_id = s.shop_id and st.product_id = p.id group by 1),
walk as (
  select shop_id, cast(0 as bigint) as k, cast(-1 as bigint) as id, false as ok, stock from start
  union all
  select w.shop_id, o.k, o.id, n.ok,
    case when n.ok then list_transform(w.stock, lambda x, i: x - coalesce(o.ns[list_position(o.ps, i - 1)], 0)) else w.stock end
  from walk w join ord o on o.shop_id = w.shop_id and o.k = w.k + 1,
  lateral (select list_bool_and(list_transform(o.ps, lambda p, i: o.ns[i] <= w.stock[p + 1])) as ok) n)
"""
query(
    "apply_new_orders", "i_sellorder i_sellorderdetail i_products shop_stock",
    _ORDER_WALK + "select (select max(id) from i_sellorder) + row_number() over (order by w.id) as id, w.id as seq from walk w where ok",
)(lambda t: J.apply_new_orders(t, new_order_docs(t)).added.select("id", "seq"))


def order_edit_docs(t):
    """Every stored sale edited: large lines kept with one unit more, small ones replaced.

    Before that, sales that are not urgent are edited to other values, all lines kept; some of these edits are bad.
    """
    heads = t["sellorder"].select(
        F.col("id").alias("_oid"), (F.col("id") * 2 + 1).alias("_seq"), F.col("id").cast("string").alias("id"),
        F.when(F.col("note") == "1-URGENT", "1").otherwise("").alias("hidden"), F.lit("").alias("customer"), F.lit("7.5").alias("discount"),
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
    )
    lines = t["sellorderdetail"].groupBy("oid_id").agg(
        F.collect_list(F.struct("id", "product_id", "price", "quantity")).alias("orderDetail")
    )
    text = lambda l, c: l[c].cast("string").alias(c.removesuffix("_id"))

    def line(l):
        keep = l["quantity"] > 25
        return F.struct(
            F.when(keep, l["id"].cast("string")).otherwise("").alias("id"), text(l, "product_id"), text(l, "price"),
            F.when(keep, l["quantity"] + 1).otherwise(l["quantity"]).cast("string").alias("quantity"),
        )

    def whole(l):
        return F.struct(text(l, "id"), text(l, "product_id"), F.lit("1").alias("price"), F.lit("9").alias("quantity"))

    def document(seq, code, note, line):
        return F.struct(
            seq.alias("seq"), code.alias("code"), note.alias("note"), F.sort_array(F.transform("orderDetail", line)).alias("lines")
        )

    both = F.array_compact(F.array(
        document(F.col("_seq"), F.lit("EDIT1"), F.lit("checked"), line),
        F.when(F.col("hidden") == "", document(
            F.col("_seq") - 1, F.when(F.col("_oid") % 3 == 0, "!!").otherwise("BEFORE1"), F.lit("before"), whole)),
    ))
    # a sale and its lines meet once for both documents
    docs = heads.join(lines, F.col("_oid") == F.col("oid_id")).withColumn("_doc", F.explode(both))
    return docs.select("id", "hidden", "customer", "discount", "date", "_doc.*")


query(
    "apply_new_orders_rejected", "i_sellorder i_sellorderdetail i_products shop_stock",
    _ORDER_WALK + """
select w.id as seq, 'over_stock' as reason from walk w where not ok and w.id >= 0
union all select distinct o.id, 'code' from i_sellorder o join i_sellorderdetail l on l.oid_id = o.id
where o.code is not null and not regexp_full_match(o.code, '[A-Za-z0-9]{4,20}')""",
)(lambda t: J.apply_new_orders(t, new_order_docs(t)).rejected.select("seq", "reason"))


query(
    "apply_order_edits", "i_sellorder i_sellorderdetail",
    """
with l as (select l.*, o.note = '1-URGENT' or l.oid_id = 0 as untouched, quantity > 25 as keep from i_sellorderdetail l
  join i_sellorder o on o.id = l.oid_id)
select id, oid_id, product_id, case when untouched then quantity else quantity + 1 end as quantity, price_cents
from l where untouched or keep
union all select (select max(id) from l) + row_number() over (order by oid_id, cast(product_id as varchar), price_text, quantity_text),
  oid_id, product_id, quantity, price_cents
from (select *, concat(cast(price_cents // 100 as varchar), '.', lpad(cast(price_cents % 100 as varchar), 2, '0')) as price_text,
  cast(quantity as varchar) as quantity_text from l) where not untouched and not keep
""",
)(
    lambda t: _on(t, J.apply_order_edits, order_edit_docs, "sellorderdetail").tables["sellorderdetail"].select(
        "id", "oid_id", "product_id", F.col("quantity").cast("bigint").alias("quantity"), "price"
    )
)
query(
    "apply_order_edits_rejected", "i_sellorder i_sellorderdetail",
    """
select distinct o.id * 2 as seq, cast(o.id as varchar) as id, case when o.id = 0 then 'id' else 'code' end as reason
from i_sellorder o join i_sellorderdetail l on l.oid_id = o.id where o.id % 3 = 0 and o.note <> '1-URGENT'
union all select distinct 1, '0', 'id' from i_sellorderdetail where oid_id = 0
""",
)(lambda t: _on(t, J.apply_order_edits, order_edit_docs, "sellorderdetail").rejected.select("seq", "id", "reason"))
query(
    "apply_order_edits_headers", "i_sellorder i_sellorderdetail",
    """
with d as (select distinct oid_id from i_sellorderdetail where oid_id <> 0),
x as (select o.*, d.oid_id is not null and note <> '1-URGENT' as edited, d.oid_id is not null and note = '1-URGENT' as hide
  from i_sellorder o left join d on d.oid_id = o.id)
select id, case when edited then 'EDIT1' else code end as code, case when edited then 750 else discount_cents end as discount_cents,
  case when edited then 'checked' else note end as note, case when edited then false when hide then true else hidden end as hidden
from x
""",
)(
    lambda t: _on(t, J.apply_order_edits, order_edit_docs, "sellorderdetail").tables["sellorder"].select(
        "id", "code", "discount", "note", "hidden"
    )
)

# -- categories ------------------------------------------------------------------------


def category_nodes(t):
    """The visible tree renamed, plus a new node under each root and one below that."""
    c = t["category"].filter(~F.col("hidden"))
    roots = c.filter(F.col("pid_id").isNull())
    new = lambda base, parent, name: roots.select(
        (F.col("id") + base).alias("ordinal"), (F.col("id") + base).alias("id"), F.lit(name).alias("name"),
        (F.col("id") + parent).alias("pId"),
    )
    kept = c.select(F.col("id").alias("ordinal"), "id", F.concat("name", F.lit("*")).alias("name"), F.col("pid_id").alias("pId"))
    return kept.unionByName(new(1_000_000, 0, "NEW")).unionByName(new(2_000_000, 1_000_000, "NEWER"))


query(
    "apply_category_tree", "i_category",
    """
with r as (select id from i_category where pid_id is null),
n as (select id + 1000000 as temp, 'NEW' as name, id as pid from r union all select id + 2000000, 'NEWER', id + 1000000 from r),
a as (select *, (select max(id) from i_category) + row_number() over (order by temp) as real_id from n)
select id, case when hidden then name else concat(name, '*') end as name, pid_id, hidden from i_category
union all select a.real_id, a.name, coalesce(p.real_id, a.pid), false from a left join a p on p.temp = a.pid
""",
)(lambda t: J.apply_category_tree(t, category_nodes(t)).tables["category"].select("id", "name", "pid_id", "hidden"))
query(
    "apply_category_tree_products", "i_category i_products",
    "select p.id, p.hidden or c.hidden as hidden from i_products p join i_category c on c.id = p.category_id",
)(lambda t: J.apply_category_tree(t, category_nodes(t)).tables["products"].select("id", "hidden"))
