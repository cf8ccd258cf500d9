"""Sources, sinks, predicates, joins, aggregates, series, sets and scalar functions."""

import uuid

from pyspark.sql import functions as F
from registry.core import AS_OF, HEAD_OFFICE, query
from registry.sales_queries import FIELDS, SALES_REPORT_SQL, _REPORT_NEEDS, _WHERE, dec
from registry.stock_queries import LEVEL_CASE, STAFF_LABEL, SUPPLIER_CASE

from ledgerloom.constants import RE_CODE
from ledgerloom.functions import dates, labels, money, predicates, text
from ledgerloom.operators import cost, dense, lookup, orders, paging, sets, stock
from ledgerloom.plans import catalog, reports
from ledgerloom.session import shared_dir
from ledgerloom.sources import documents, sinks, tables

# -- sources and sinks -----------------------------------------------------------------

query("scan_table", "i_products", "select id, name, barcode, category_id, size, hidden, note from i_products")(
    lambda t: t["products"].drop("image")
)
query("scan_pruned", "i_shop", f"select id, name from i_shop where name <> '{HEAD_OFFICE}'")(
    lambda t: tables.scan_pruned(t["shop"].filter(F.col("name") != HEAD_OFFICE), "id", "name")
)


def order_documents(t):
    """Every stored sale as the JSON document its edit form would submit."""
    line = F.struct(
        F.col("id").cast("string").alias("id"),
        F.col("product_id").cast("string").alias("product"),
        F.col("price").cast("string").alias("price"),
        F.col("quantity").cast("string").alias("quantity"),
    )
    lines = t["sellorderdetail"].groupBy("oid_id").agg(F.array_sort(F.collect_list(line)).alias("orderDetail"))
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = t["sellorder"].join(lines, F.col("id") == F.col("oid_id"))
    return head.select(
        F.to_json(
            F.struct(
                s("id").alias("id"), F.lit("").alias("hidden"), F.concat(F.lit(" "), s("code")).alias("code"),
                s("customer_id").alias("customer"), s("discount").alias("discount"), s("note").alias("note"),
                F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "orderDetail",
            )
        ).alias("value")
    )


def fresh_path(t, name):
    """A new folder on shared storage."""
    return f"{shared_dir(t['shop'].sparkSession)}/{name}-{uuid.uuid4().hex}"


@query(
    "read_order_docs", "i_sellorderdetail i_sellorder",
    f"""
select cast(o.id as varchar) as order_id, concat(' ', coalesce(o.code, '')) as code, coalesce(cast(customer_id as varchar), '') as customer,
  case when discount_cents is null then '' else {dec('discount_cents')} end as discount, o.note,
  row_number() over (partition by o.id order by cast(l.id as varchar)) as line_no, cast(l.id as varchar) as line_id,
  cast(product_id as varchar) as product, {dec('price_cents')} as price, cast(quantity as varchar) as quantity
from i_sellorderdetail l join i_sellorder o on o.id = l.oid_id
""",
)
def _(t):
    path = fresh_path(t, "order-docs")
    order_documents(t).write.text(path)
    docs = documents.read_order_docs(t["shop"].sparkSession, path).withColumnRenamed("id", "order_id")
    return documents.order_doc_lines(docs, "order_id", "code", "customer", "discount", "note")


@query(
    "read_category_docs", "i_category",
    "select row_number() over (order by id) - 1 as ordinal, id, name, pid_id as \"pId\" from i_category",
)
def _(t):
    spark = t["shop"].sparkSession
    path = fresh_path(t, "category-docs")
    node = F.to_json(F.struct("id", "name", F.col("pid_id").alias("pId")))
    first = t["category"].agg(F.min("id").alias("m")).scalar()
    lines = t["category"].select("id", F.concat(F.when(F.col("id") == first, "[").otherwise(","), node).alias("value"))
    end = spark.range(1).select(F.lit(2**63 - 1).alias("id"), F.lit("]").alias("value"))
    # one file is one list: its lines are streamed into it in order
    lines.unionByName(end).coalesce(1).sortWithinPartitions("id").select("value").write.text(path)
    return documents.read_category_docs(spark, path)


@query(
    "write_sales_report_csv", _REPORT_NEEDS,
    SALES_REPORT_SQL.replace(
        "select no as ordinal, cast(no as varchar) as no",
        "select cast(no as varchar) as no",
    ).replace("select 9223372036854775807, ''", "select ''"),
)
def _(t):
    path = fresh_path(t, "sales-report")
    sinks.write_sales_report_csv(reports.sales_report(t, as_of=AS_OF, **FIELDS), path)
    names = ["no", "shop", "date", "product", "size", "category", "price", "quantity", "subtotal"]
    read = t["shop"].sparkSession.read.option("header", True).csv(path).toDF(*names)
    return read.select(*[F.coalesce(n, F.lit("")).alias(n) for n in names])


@query(
    "write_stock_report_csv", "shop_stock i_products summary",
    """
select cast(row_number() over (order by s.product_id desc) + 1 as varchar) as no, p.name, coalesce(p.barcode, '') as barcode,
  coalesce(p.size, '') as size, cast(s.stock as varchar) as stock, cast(m.on_hand as varchar) as depot_stock, '正常' as status
from shop_stock s join i_products p on p.id = s.product_id join summary m on m.product_id = s.product_id
where not p.hidden and s.shop_id = 7
""",
)
def _(t):
    path = fresh_path(t, "stock-report")
    sinks.write_stock_report_csv(reports.stock_report(t, container_id=7), path)
    names = ["no", "name", "barcode", "size", "stock", "depot_stock", "status"]
    read = t["shop"].sparkSession.read.option("header", True).csv(path).toDF(*names)
    return read.select(*[F.coalesce(n, F.lit("")).alias(n) for n in names])


query(
    "to_json_rows", "i_category",
    """
select concat('{"id":', id, ',"pId":', coalesce(pid_id, 0), ',"name":"', name, '"}') as doc
from i_category where not hidden
""",
)(lambda t: sinks.to_json_rows(catalog.category_tree(t), "id", "pId", "name"))

query(
    "pipe_rows", "shop_stock i_shop",
    "select concat_ws('|', name, cast(stock as varchar), '不明', cast(shop_id as varchar)) as line "
    "from shop_stock join i_shop on id = shop_id",
)(
    lambda t: sinks.pipe_rows(
        t["shop"].join(stock.shop_product_stock(t), F.col("id") == F.col("shop_id")).withColumn("unknown", F.lit("不明")),
        "name", "stock", "unknown", "shop_id",
    )
)
query(
    "pipe_split", "i_customer",
    "select name, coalesce(code, 'None') as code, coalesce(telephone, 'None') as telephone, id from i_customer",
)(
    lambda t: t["customer"]
    .select(text.pipe_split(labels.customer_label(*[F.col(c) for c in ("name", "code", "telephone", "id")])).alias("p"))
    .select(
        F.col("p")[0].alias("name"), F.col("p")[1].alias("code"), F.col("p")[2].alias("telephone"),
        F.col("p")[3].cast("bigint").alias("id"),
    )
)

# -- projections, filters, predicates --------------------------------------------------

query(
    "line_amount", "i_indetail i_sellorderdetail",
    """
select id, 'in' as ledger, quantity * value_cents as amount_cents from i_indetail
union all select id, 'sell', quantity * price_cents from i_sellorderdetail
""",
)(
    lambda t: t["indetail"]
    .select("id", F.lit("in").alias("ledger"), money.line_amount("quantity", "value").alias("amount"))
    .unionByName(
        t["sellorderdetail"].select("id", F.lit("sell").alias("ledger"), money.line_amount("quantity", "price").alias("amount"))
    )
)
query("eq_filter", "i_sellorder", "select id from i_sellorder where shop_id = 3 and staff_id = 4")(
    lambda t: t["sellorder"].filter((F.col("shop_id") == 3) & (F.col("staff_id") == 4)).select("id")
)
query(
    "exclude_filter", "i_outdetail i_outstream",
    "select l.id from i_outdetail l join i_outstream h on h.id = outid_id where quantity <> 0 and not h.hidden",
)(lambda t: stock.visible_issues(t).filter(F.col("quantity") != 0).select("id"))
query(
    "or_contains", "i_customer",
    """
select id from i_customer where contains(lower(name), 'ma') or contains(lower(code), 'ma') or contains(telephone, 'ma')
""",
)(lambda t: t["customer"].filter(text.any_contains("mA", "name", "code", "telephone")).select("id"))
query(
    "raw_like", "i_products",
    "select id from i_products where name ilike '%RED%' or barcode ilike '1_00%'",
)(
    lambda t: t["products"]
    .filter(text.raw_like(F.col("name"), "%RED%") | text.raw_like(F.col("barcode"), "1_00%"))
    .select("id")
)
query(
    "and_contains", "i_sellorder",
    "select id from i_sellorder where contains(lower(code), 'o2') and contains(lower(note), '') and note is not null",
)(
    lambda t: t["sellorder"]
    .filter(text.icontains(F.col("code"), "O2") & text.icontains(F.col("note"), ""))
    .select("id")
)
query(
    "range_filter", "i_sellorder",
    "select id from i_sellorder where date >= timestamp '1999-03-01' and date < timestamp '2000-01-01'",
)(
    lambda t: t["sellorder"]
    .filter((F.col("date") >= dates.day("1999-03-01").cast("timestamp_ntz")) & (F.col("date") < dates.day("2000-01-01").cast("timestamp_ntz")))
    .select("id")
)
query("null_filter", "i_category", "select id from i_category where pid_id is not null and not hidden")(
    lambda t: t["category"].filter(F.col("pid_id").isNotNull() & predicates.visible()).select("id")
)
query(
    "in_subquery", "i_products i_category",
    "select id from i_products where category_id in (select id from i_category where not hidden)",
)(
    lambda t: t["products"]
    .join(t["category"].filter(predicates.visible()).select(F.col("id").alias("category_id")), "category_id", "left_semi")
    .select("id")
)
query(
    "related_filter", "i_outdetail i_outstream",
    "select l.id, h.shop_id from i_outdetail l join i_outstream h on h.id = outid_id where h.returned and h.shop_id > 9",
)(
    lambda t: lookup.lines_of(
        t["outdetail"], "outid_id", t["outstream"].filter(F.col("returned") & (F.col("shop_id") > 9)), shop_id="shop_id"
    ).select("id", "shop_id")
)
query(
    "role_scope", "i_sellorder",
    """
select 'clerk' as role, id from i_sellorder where shop_id = 3 union all
select 'manager', id from i_sellorder union all select 'head', id from i_sellorder where shop_id = 5
""",
)(
    lambda t: t["sellorder"].filter(predicates.orders_in_scope(6, 3)).select(F.lit("clerk").alias("role"), "id")
    .unionByName(t["sellorder"].filter(predicates.orders_in_scope(4, 3)).select(F.lit("manager").alias("role"), "id"))
    .unionByName(t["sellorder"].filter(predicates.editable_orders(5, 5)).select(F.lit("head").alias("role"), "id"))
    .unionByName(t["sellorder"].filter(predicates.editable_orders(3, 5)).select(F.lit("keeper").alias("role"), "id"))
)
query(
    "alias_having", "v_sold",
    """
select strftime(date, '%Y-%m-%d') as day, cast(sum(quantity) as bigint) as quantity from v_sold group by 1
having sum(quantity) > 30 and day > '1998-01-01'
""",
)(
    lambda t: stock.visible_sales(t, date="date")
    .groupBy(F.to_date("date").alias("day")).agg(F.sum(F.col("quantity").cast("bigint")).alias("quantity"))
    .filter((F.col("quantity") > 30) & (F.col("day") > dates.day("1998-01-01")))
)
query(
    "null_default", "i_sellorder i_products",
    """
select id, coalesce(discount_cents, 0) as amount_cents, '' as size from i_sellorder
union all select id, 0, coalesce(size, '0') from i_products
""",
)(
    lambda t: t["sellorder"]
    .select("id", F.coalesce("discount", F.lit(0)).cast("decimal(8,2)").alias("amount"), F.lit("").alias("size"))
    .unionByName(t["products"].select("id", F.lit(0).cast("decimal(8,2)").alias("amount"), F.coalesce("size", F.lit("0")).alias("size")))
)
query("const_column", "i_outdetail", "select id, quantity, cast(0 as bigint) as squantity from i_outdetail")(
    lambda t: t["outdetail"].select("id", "quantity", F.lit(0).alias("squantity"))
)

# -- joins -----------------------------------------------------------------------------

query(
    "join_lines_header", "i_outdetail i_outstream",
    "select l.id, outid_id, h.shop_id, quantity from i_outdetail l join i_outstream h on h.id = outid_id",
)(
    lambda t: lookup.lines_of(t["outdetail"], "outid_id", t["outstream"], shop_id="shop_id").select(
        "id", "outid_id", "shop_id", "quantity"
    )
)
query(
    "join_three_way", "v_out i_shop",
    "select v.id, s.name as shop, quantity from v_out v join i_shop s on s.id = v.shop_id",
)(
    lambda t: stock.visible_issues_by_shop(t)
    .join(t["shop"].select(F.col("id").alias("shop_id"), F.col("name").alias("shop")), "shop_id")
    .select("id", "shop", "quantity")
)
query(
    "join_left_outflow", "v_out v_sold",
    """
select o.product_id, cast(o.q as bigint) as issued, cast(coalesce(s.q, 0) as bigint) as sold
from (select product_id, sum(quantity) q from v_out group by 1) o left join
(select product_id, sum(quantity) q from v_sold group by 1) s using (product_id)
""",
)(
    lambda t: stock.visible_issues(t)
    .groupBy("product_id").agg(F.sum(F.col("quantity").cast("bigint")).alias("issued"))
    .join(
        stock.visible_sales(t).groupBy("product_id").agg(F.sum(F.col("quantity").cast("bigint")).alias("sold")),
        "product_id", "left",
    )
    .select("product_id", "issued", F.coalesce("sold", F.lit(0).cast("bigint")).alias("sold"))
)
query(
    "join_left_double", "i_depot v_in v_out",
    """
select d.id as depot_id, d.name, cast(coalesce(i.q, 0) - coalesce(o.q, 0) as bigint) as stock from i_depot d
left join (select depot_id, sum(quantity) q from v_in group by 1) i on i.depot_id = d.id
left join (select depot_id, sum(quantity) q from v_out group by 1) o on o.depot_id = d.id
""",
)(
    lambda t: t["depot"].select(F.col("id").alias("depot_id"), "name")
    .join(stock.visible_receipts(t).groupBy("depot_id").agg(F.sum(F.col("quantity").cast("bigint")).alias("i")), "depot_id", "left")
    .join(stock.visible_issues(t).groupBy("depot_id").agg(F.sum(F.col("quantity").cast("bigint")).alias("o")), "depot_id", "left")
    .select("depot_id", "name", (F.coalesce("i", F.lit(0).cast("bigint")) - F.coalesce("o", F.lit(0).cast("bigint"))).alias("stock"))
)
query(
    "join_product_subselect", "v_out i_products",
    "select v.id, p.name from v_out v join i_products p on p.id = v.product_id where p.name ilike '%ring'",
)(
    lambda t: stock.visible_issues(t).join(
        t["products"].filter(text.raw_like(F.col("name"), "%ring")).select(F.col("id").alias("product_id"), "name"), "product_id"
    ).select("id", "name")
)
query(
    "join_self_parent", "i_category",
    "select c.id, c.name, p.name as parent from i_category c left join i_category p on p.id = c.pid_id",
)(lambda t: lookup.fk_lookup(t["category"], "pid_id", t["category"], parent="name").select("id", "name", "parent"))
query(
    "join_fk_lookup", "i_sellorder i_customer",
    """
select o.id, coalesce(c.name, '未登记') as customer, coalesce(customer_id, 0) as customer_id
from i_sellorder o left join i_customer c on c.id = customer_id
""",
)(
    lambda t: lookup.fk_lookup(t["sellorder"], "customer_id", t["customer"], customer="name").select(
        "id", F.coalesce("customer", F.lit("未登记")).alias("customer"),
        F.coalesce("customer_id", F.lit(0).cast("bigint")).alias("customer_id"),
    )
)
query("semi_join", "v_in", "select id, inid_id, quantity from v_in")(
    lambda t: stock.visible_receipts(t).select("id", "inid_id", "quantity")
)
query(
    "semi_join_having", "i_indetail i_outdetail",
    """
select product_id, cast(sum(quantity * value_cents) * 1000000 // sum(quantity) as bigint) as mean_millionths
from i_indetail group by product_id having product_id in (select product_id from i_outdetail where outid_id in
(select o_orderkey from orders where o_orderpriority = '1-URGENT'))
""",
)(
    lambda t: cost.received(
        t["indetail"].join(
            t["outdetail"].join(
                t["outstream"].filter(F.col("note") == "1-URGENT").select(F.col("id").alias("outid_id")), "outid_id", "left_semi"
            ).select("product_id"),
            "product_id", "left_semi",
        )
    ).select(
        "product_id",
        (
            money.mean_whole(F.col("in_cents"), F.col("in_qty")) * 1_000_000
            + money.mean_millionths(F.col("in_cents"), F.col("in_qty"))
        ).alias("mean_millionths"),
    )
)
query(
    "anti_join", "i_category",
    """
select id from i_category c where not hidden
and not exists (select 1 from i_category k where not k.hidden and k.pid_id = c.id)
""",
)(
    lambda t: t["category"].filter(predicates.visible())
    .join(catalog.parent_ids(t), F.col("id") == F.col("parent_id"), "left_anti").select("id")
)
query(
    "cross_dense", "i_shop",
    "select id, strftime(d, '%Y-%m-%d') as day from i_shop, "
    "range(timestamp '2001-07-03', timestamp '2001-08-02', interval 1 day) r(d)",
)(lambda t: dense.day_grid(t["shop"].select("id"), AS_OF, 30))
query(
    "tautology_join", "v_in v_out",
    """
select i.depot_id, i.product_id, cast(i.q - coalesce(o.q, 0) as bigint) as stock
from (select depot_id, product_id, sum(quantity) q from v_in group by 1, 2) i left join
(select depot_id, product_id, sum(quantity) q from v_out group by 1, 2) o using (depot_id, product_id)
""",
)(
    lambda t: stock.visible_receipts(t).groupBy("depot_id", "product_id").agg(F.sum(F.col("quantity").cast("bigint")).alias("i"))
    .join(
        stock.visible_issues(t).groupBy("depot_id", "product_id").agg(F.sum(F.col("quantity").cast("bigint")).alias("o")),
        ["depot_id", "product_id"], "left",
    )
    .select("depot_id", "product_id", (F.col("i") - F.coalesce("o", F.lit(0).cast("bigint"))).alias("stock"))
)
query(
    "positional_zip", "i_outstream i_outdetail",
    """
select h.id, h.code, l.product_id, l.q as product_qty from i_outstream h join
(select outid_id, product_id, cast(sum(quantity) as bigint) q from i_outdetail where quantity <> 0 group by 1, 2) l
on l.outid_id = h.id where not h.hidden
""",
)(
    lambda t: t["outstream"].filter(predicates.visible()).select("id", "code").join(
        t["outdetail"].filter(F.col("quantity") != 0).groupBy("outid_id", "product_id")
        .agg(F.sum(F.col("quantity").cast("bigint")).alias("product_qty")),
        F.col("id") == F.col("outid_id"),
    ).drop("outid_id")
)

# -- aggregates ------------------------------------------------------------------------

_q = lambda: F.col("quantity").cast("bigint")

query("group_sum", "v_sold", "select shop_id, cast(sum(quantity) as bigint) as quantity from v_sold group by 1")(
    lambda t: stock.visible_sales(t, shop_id="shop_id").groupBy("shop_id").agg(F.sum(_q()).alias("quantity"))
)
query(
    "group_sum_annotate", "i_indetail",
    "select inid_id, product_id, cast(sum(quantity) as bigint) as tq from i_indetail where quantity > 0 group by 1, 2",
)(lambda t: t["indetail"].filter("quantity > 0").groupBy("inid_id", "product_id").agg(F.sum(_q()).alias("tq")))
query(
    "global_sum", "v_in v_out",
    "select 'in' as side, cast(coalesce(sum(quantity), 0) as bigint) as quantity from v_in "
    "union all select 'out', cast(coalesce(sum(quantity), 0) as bigint) from v_out",
)(
    lambda t: stock.visible_receipts(t).agg(F.coalesce(F.sum(_q()), F.lit(0).cast("bigint")).alias("quantity"))
    .select(F.lit("in").alias("side"), "quantity")
    .unionByName(
        stock.visible_issues(t).agg(F.coalesce(F.sum(_q()), F.lit(0).cast("bigint")).alias("quantity"))
        .select(F.lit("out").alias("side"), "quantity")
    )
)
query(
    "sum_product", "i_sellorderdetail",
    "select product_id, cast(sum(quantity * price_cents) as bigint) as amount_cents from i_sellorderdetail group by 1",
)(
    lambda t: t["sellorderdetail"].groupBy("product_id")
    .agg(money.money(F.sum(money.line_cents("quantity", "price"))).alias("amount"))
)
query(
    "weighted_avg", "i_indetail",
    """
select product_id, cast((n // d) + case when 2 * (n % d) > d or (2 * (n % d) = d and (n // d) % 2 = 1) then 1 else 0 end
  as bigint) as avg_cost_cents
from (select product_id, sum(quantity * value_cents) n, sum(quantity) d from i_indetail group by 1)
""",
)(
    lambda t: t["indetail"].groupBy("product_id").agg(
        money.money(money.half_even_div(F.sum(money.line_cents("quantity", "value")), F.sum(_q()))).alias("avg_cost")
    )
)
query("count_rows", "i_indetail", "select inid_id, count(id) as lines from i_indetail group by 1")(
    lambda t: t["indetail"].groupBy("inid_id").agg(F.count("id").alias("lines"))
)
query(
    "group_by_date", "v_sold",
    "select strftime(date, '%Y-%m-%d') as day, cast(sum(quantity) as bigint) as quantity from v_sold group by 1",
)(
    lambda t: stock.visible_sales(t, date="date").groupBy(F.to_date("date").alias("day")).agg(F.sum(_q()).alias("quantity"))
)
query(
    "nested_agg", "totals",
    """
select shop_id, count(*) as orders, cast(sum(total_cents) as bigint) as amount_cents from totals
where not hidden and has_lines group by 1
""",
)(
    lambda t: orders.net_visible_orders(t, "shop_id").groupBy("shop_id")
    .agg(F.count("*").alias("orders"), money.money(F.sum("net_cents")).alias("amount"))
)
query(
    "scalar_subquery", "v_in i_indetail",
    "select id, quantity - (select coalesce(max(quantity), 0) from v_in) as below_max from i_indetail",
)(
    lambda t: t["indetail"].select(
        "id",
        (_q() - F.coalesce(stock.visible_receipts(t).agg(F.max(_q()).alias("m")).scalar(), F.lit(0).cast("bigint"))).alias("below_max"),
    )
)
query("distinct_values", "i_category", "select distinct pid_id as parent_id from i_category where not hidden and pid_id is not null")(
    catalog.parent_ids
)
query(
    "last_value_in_group", "v_in v_sold",
    """
select 'in' as ledger, product_id, arg_max(value_cents, id) as price_cents from v_in group by product_id
union all select 'sell', product_id, arg_max(price_cents, id) from v_sold group by product_id
""",
)(
    lambda t: stock.visible_receipts(t).groupBy("product_id").agg(F.max_by("value", "id").alias("price"))
    .select(F.lit("in").alias("ledger"), "product_id", "price")
    .unionByName(
        stock.visible_sales(t).groupBy("product_id").agg(F.max_by("price", "id").alias("price"))
        .select(F.lit("sell").alias("ledger"), "product_id", "price")
    )
)
query(
    "running_python_total", "totals",
    f"""
select cast(coalesce(sum(discount_cents), 0) as bigint) as discount_total_cents,
  cast(coalesce(sum(total_cents), 0) as bigint) as paid_total_cents from totals where {_WHERE}
""",
)(lambda t: reports.sales_report_footer(t, as_of=AS_OF, **FIELDS))
query(
    "drop_zero_groups", "shop_stock", "select shop_id, product_id, stock from shop_stock where stock <> 0"
)(lambda t: stock.shop_product_stock(t).filter(F.col("stock") != 0))
query(
    "group_collect", "i_staff i_shop",
    f"""
with r as (select s.*, h.name as shop, row_number() over (partition by shop_id order by level, s.id) as position
  from i_staff s left join i_shop h on h.id = shop_id where level < 99)
select shop_id, shop, (position - 1) // 3 as part, count(*) as n, string_agg(id || ':' || name, ',' order by position) as members
from r group by all
""",
)(
    lambda t: catalog.staff_groups(t, 3).select(
        "shop_id", "shop", "part", "n",
        F.array_join(F.transform("rows", lambda r: F.concat(r["id"].cast("string"), F.lit(":"), r["name"])), ",").alias("members"),
    )
)
query(
    "exists_guard", "i_depot i_indetail",
    """
select d.id, coalesce(q, 0) as quantity from i_depot d
left join (select depot_id, cast(sum(quantity) as bigint) q from i_indetail group by 1) on depot_id = d.id
""",
)(
    lambda t: t["depot"].select("id").join(
        t["indetail"].groupBy(F.col("depot_id").alias("id")).agg(F.sum(_q()).alias("quantity")), "id", "left"
    ).select("id", F.coalesce("quantity", F.lit(0).cast("bigint")).alias("quantity"))
)

# -- order, limit, pages, series -------------------------------------------------------

query(
    "row_counter", "totals i_sellorderdetail",
    f"""
select row_number() over (order by o.date, o.id, l.id) as no, quantity * price_cents as subtotal_cents
from (select * from totals where {_WHERE}) o join i_sellorderdetail l on l.oid_id = o.id
""",
)(lambda t: reports.sales_report_lines(t, as_of=AS_OF, **FIELDS).select("no", "subtotal"))
query(
    "share_of_total", "shop_stock",
    """
with s as (select product_id, cast(sum(stock) as bigint) as stock from shop_stock group by 1 having sum(stock) <> 0)
select product_id, stock, cast((select sum(stock) from s) as bigint) as total,
  cast(stock as double) * 100 / cast((select sum(stock) from s) as double) as share from s
""",
)(
    lambda t: stock.with_share(
        stock.shop_product_stock(t).groupBy("product_id").agg(F.sum("stock").alias("stock")), "stock"
    )
)
query(
    "order_by", "i_staff", "select id, shop_id, level from i_staff order by shop_id desc, level, id"
)(lambda t: t["staff"].select("id", "shop_id", F.col("level").cast("bigint").alias("level")).orderBy(F.col("shop_id").desc(), "level", "id"))
query(
    "limit_n", "shop_stock", "select * from shop_stock order by stock desc, shop_id, product_id limit 100"
)(lambda t: paging.top_k(stock.shop_product_stock(t), 100, F.col("stock").desc(), F.col("shop_id"), F.col("product_id")))
query("page_slice", "i_instream", "select id, code from i_instream order by id desc limit 20 offset 80")(
    lambda t: paging.page_slice(t["instream"].select("id", "code"), [F.col("id").desc()], page=5)
)
query("page_count", "i_sellorder", "select cast(ceil(count(*) / 20.0) as bigint) as pages, count(*) as rows from i_sellorder")(
    lambda t: t["sellorder"].agg(paging.page_count(F.count("*")).alias("pages"), F.count("*").alias("rows"))
)
query(
    "page_window", "i_remit",
    """
with c as (select cast(ceil(count(*) / 20.0) as bigint) as pages from i_remit),
p as (select distinct o_orderkey // 20 + 1 as page from orders)
select page, coalesce(list_aggregate([x for x in range(greatest(page - 4, 1), least(page + 4, pages) + 1)],
  'string_agg', ','), '') as shown from p, c
""",
)(
    lambda t: t["sellorder"].select(F.expr("id div 20 + 1").alias("page")).distinct().select(
        "page",
        paging.page_window(F.col("page"), t["remit"].agg(paging.page_count(F.count("*")).alias("n")).scalar()).alias("shown"),
    )
)
query("top_recent", "i_sellorder", "select id from i_sellorder where not hidden order by id desc limit 10")(
    lambda t: paging.top_k(t["sellorder"].filter(predicates.visible()).select("id"), 10, F.col("id").desc())
)
query(
    "dense_series", "v_sold i_shop",
    """
select s.id as shop_id, strftime(d, '%Y-%m-%d') as day, strftime(d, '%m-%d') as label,
  cast(coalesce(q, 0) as bigint) as quantity
from i_shop s cross join range(timestamp '2000-08-02', timestamp '2001-08-02', interval 1 day) r(d)
left join (select shop_id, date, sum(quantity) q from v_sold group by 1, 2) f on f.shop_id = s.id and f.date = d
""",
)(
    lambda t: dense.fill_days(
        t["shop"].select(F.col("id").alias("shop_id")), "shop_id",
        stock.visible_sales(t, shop_id="shop_id", date="date").groupBy("shop_id", F.to_date("date").alias("day"))
        .agg(F.sum(_q()).alias("quantity")),
        "quantity", AS_OF, 365,
    ).withColumn("label", dates.short_day(F.col("day")))
)

# -- sets ------------------------------------------------------------------------------


def submitted_ids(t):
    """A product list some rows of which are not stored: ids moved up by the part size."""
    return t["products"].select((F.col("id") + F.split("size", ",")[0].cast("bigint")).alias("id")).filter("id is not null")


_SUBMITTED = "(select distinct p_partkey + p_size as id from part where p_partkey % 19 <> 0)"
query("ids_intersect", "i_products", f"select id from i_products where id in {_SUBMITTED}")(
    lambda t: sets.ids_kept(t["products"], submitted_ids(t))
)
query(
    "ids_minus", "i_products",
    f"""
select 'removed' as side, id from i_products where id not in {_SUBMITTED}
union all select 'added', id from {_SUBMITTED} where id not in (select id from i_products)
""",
)(
    lambda t: sets.ids_removed(t["products"], submitted_ids(t)).select(F.lit("removed").alias("side"), "id")
    .unionByName(sets.ids_added(t["products"], submitted_ids(t)).select(F.lit("added").alias("side"), "id"))
)
query(
    "union_footer", "i_remit",
    f"""
select id as ordinal, cast(id as varchar) as no, {dec("amount_cents")} as amount from i_remit
union all select 9223372036854775807, '', {dec("x")} from (select cast(sum(amount_cents) as bigint) x from i_remit)
""",
)(
    lambda t: t["remit"].select(F.col("id").alias("ordinal"), F.col("id").cast("string").alias("no"), F.col("amount").cast("string").alias("amount"))
    .unionByName(
        t["remit"].agg(money.money(F.sum(money.cents("amount"))).cast("string").alias("amount"))
        .select(F.lit(2**63 - 1).alias("ordinal"), F.lit("").alias("no"), "amount")
    )
)

# -- scalar functions ------------------------------------------------------------------

query(
    "fn_text", "i_products",
    r"""
select id, replace(concat(name, ' x'), ' ', '') as squashed, trim(concat('  ', name, ' ')) as trimmed,
  name as untagged, replace(concat('"', name, '"'), '"', '''') as quoted, length(name) as n,
  regexp_full_match(coalesce(barcode, ''), '[A-Za-z0-9]{4,20}') as code_ok,
  concat_ws('|', name, coalesce(barcode, 'None'), cast(id as varchar)) as full_name
from i_products
""",
)(
    lambda t: t["products"].select(
        "id",
        text.squash(F.concat("name", F.lit("  x"))).alias("squashed"),
        text.trim_spaces(F.concat(F.lit("  "), "name", F.lit(" "))).alias("trimmed"),
        text.strip_tags(F.concat(F.lit("<b class='x'>"), "name", F.lit("</b>"))).alias("untagged"),
        text.swap_quotes(F.concat(F.lit('"'), "name", F.lit('"'))).alias("quoted"),
        F.length("name").cast("bigint").alias("n"),
        F.coalesce("barcode", F.lit("")).rlike(RE_CODE).alias("code_ok"),
        labels.product_label(F.col("name"), F.col("barcode"), F.col("id")).alias("full_name"),
    )
)
query(
    "fn_date", "i_sellorder",
    """
select id, strftime(date, '%Y-%m-%d') as day, strftime(date, '%m-%d') as short, strftime(date, '%Y-%m-%d %H:%M:%S') as moment,
  strftime(cast(date as date) - 92, '%Y-%m-%d') as back, datediff('day', date, timestamp '2001-08-01') * -1 - 1 as slot,
  strftime(date, '%Y-%m-%d') as parsed, cast(null as varchar) as broken from i_sellorder
""",
)(
    lambda t: t["sellorder"].select(
        "id", dates.iso_day(F.col("date")).alias("day"), dates.short_day(F.col("date")).alias("short"),
        dates.iso_moment(F.col("date")).alias("moment"), dates.days_before(F.col("date"), 92).alias("back"),
        dates.day_offset(F.col("date"), AS_OF).cast("bigint").alias("slot"),
        dates.parse_day(dates.iso_day(F.col("date"))).alias("parsed"),
        dates.parse_day(F.concat(dates.iso_day(F.col("date")), F.lit("x"))).alias("broken"),
    )
)
query(
    "fn_math", "i_sellorderdetail",
    """
select id, abs(quantity) as q, cast(ceil(quantity / 3.0) as bigint) as up,
  sign(x) * ((abs(x) + 5) // 10) as half_up_cents,
  (x // 10) + case when x % 10 > 5 or (x % 10 = 5 and (x // 10) % 2 = 1) then 1 else 0 end as half_even_cents
from (select *, price_cents * 5 as x from i_sellorderdetail)
""",
)(
    lambda t: t["sellorderdetail"].select(
        "id", F.abs("quantity").cast("bigint").alias("q"), F.ceil(F.col("quantity") / 3).alias("up"),
        money.round_half_up(F.col("price") * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(10,2)").alias("half_up"),
        money.round_half_even(F.col("price") * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(10,2)").alias("half_even"),
    )
)
query(
    "fn_cast", "i_products",
    """
select id, try_cast(barcode as bigint) as number, try_cast(size as bigint) as size_number,
  try_cast(name as decimal(8,2)) is null as name_is_text from i_products
""",
)(
    lambda t: t["products"].select(
        "id", F.col("barcode").try_cast("bigint").alias("number"), F.col("size").try_cast("bigint").alias("size_number"),
        F.col("name").try_cast("decimal(8,2)").isNull().alias("name_is_text"),
    )
)
query(
    "fn_label", "i_staff",
    f"""
select id, {LEVEL_CASE.format(c="level")} as level_label, case sex when 'F' then '女性' when 'M' then '男性' end as sex_label,
  case when marital then '已婚' else '未婚' end as marital_label, {STAFF_LABEL.format(a="i_staff")} as label,
  {SUPPLIER_CASE.format(c="(id % 5)")} as supplier_label, case when id % 2 = 0 then '已删除' else '正常' end as status
from i_staff
""",
)(
    lambda t: t["staff"].select(
        "id", labels.level_label(F.col("level")).alias("level_label"), labels.sex_label(F.col("sex")).alias("sex_label"),
        labels.marital_label(F.col("marital")).alias("marital_label"),
        labels.staff_label(F.col("level"), F.col("name")).alias("label"),
        labels.supplier_label(F.col("id") % 5).alias("supplier_label"),
        labels.status_label(F.col("id") % 2 == 0).alias("status"),
    )
)
query(
    "fn_array", "i_products",
    """
select id, cast(split_part(size, ',', 1) as bigint) as width, cast(split_part(size, ',', 2) as bigint) as height,
  size as joined from i_products
""",
)(
    lambda t: t["products"].withColumn("s", text.size_array(F.col("size"))).select(
        "id", F.col("s")[0].cast("bigint").alias("width"), F.col("s")[1].cast("bigint").alias("height"), F.col("s").alias("joined")
    )
)
query(
    "fn_json", "i_category", "select id, name, coalesce(pid_id, 0) as \"pId\" from i_category where not hidden"
)(
    lambda t: sinks.to_json_rows(catalog.category_tree(t), "id", "name", "pId")
    .select(F.from_json("doc", "id bigint, name string, pId bigint").alias("d")).select("d.*")
)
