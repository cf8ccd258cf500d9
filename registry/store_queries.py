"""Versions of a store and sums kept up with changes."""

from pyspark.sql import functions as F
from registry.core import AS_OF, query, stored
from registry.sales_queries import _WHERE, FIELDS
from registry.table_queries import fresh_path

from ledgerloom.operators import maintained, trigram
from ledgerloom.plans import changes as J
from ledgerloom.plans import search
from ledgerloom.sources import clustered, newest, snapshots

#: few rows to a file, so that small tables have several as well
_FILE_ROWS = 4_000


@query(
    "snapshot_commit", "i_outdetail",
    """
select 1 as version, id, product_id, quantity from i_outdetail
union all select 2, id, product_id, case when outid_id between 100 and 200 then 0 else quantity end from i_outdetail
""",
)
def _(t):
    """Both versions of the issue lines after a commit that deletes those of a hundred documents."""
    spark, root = t["shop"].sparkSession, fresh_path(t, "store")
    snapshots.write_store({n: t[n] for n in ("outstream", "outdetail")}, root, _FILE_ROWS)
    stored = snapshots.read_snapshot(spark, root)
    tables = t.replaced(outstream=stored["outstream"], outdetail=stored["outdetail"])
    lines = tables["outdetail"].filter("outid_id between 100 and 200").select(F.col("id").alias("seq"), "id")
    snapshots.commit(spark, root, J.delete_issue_lines(tables, lines, as_of=AS_OF).delta, file_rows=_FILE_ROWS)
    both = [snapshots.read_snapshot(spark, root, v)["outdetail"].withColumn("version", F.lit(v)) for v in (1, 2)]
    return both[0].unionByName(both[1]).select("version", "id", "product_id", "quantity")


@query(
    "snapshot_files", "i_outdetail",
    """
select 1 as version, count(*) as n, min(id) as low, max(id) as high, 0 as shared from i_outdetail
union all select 2, count(*), min(id), max(id), 1 from i_outdetail
""",
)
def _(t):
    """What the manifests say of both versions; ``shared`` is 1 if the second lists a file of the first."""
    spark, root = t["shop"].sparkSession, fresh_path(t, "store")
    snapshots.write_store({"outdetail": t["outdetail"]}, root, _FILE_ROWS // 40)
    first = snapshots.read_snapshot(spark, root)["outdetail"]
    change = first.filter("outid_id between 100 and 120").withColumn("quantity", F.lit(0))
    snapshots.commit(spark, root, {"outdetail": snapshots.Delta(change)}, file_rows=_FILE_ROWS // 40)
    old, new = (snapshots.manifest(spark, root, v).filter("table = 'outdetail'").withColumn("version", F.lit(v)) for v in (1, 2))
    kept = old.select("file", F.lit(1).alias("_kept"))
    listed = old.withColumn("_kept", F.lit(0)).unionByName(new.join(kept, "file", "left").select(*old.columns, F.coalesce("_kept", F.lit(0)).alias("_kept")))
    return listed.groupBy("version").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("_kept").alias("shared")
    )


def _after(t, *tables):
    """The state after headers are hidden, kept up from the state before."""
    t = stored(t, "indetail", "outdetail")
    state, hidden = maintained.build(t), t["remit"].filter("supplier = 3")
    delta = {}
    for table in tables:
        delta |= J.soft_delete(t, table, hidden).delta
    return maintained.advance(state, t, delta)


_HIDDEN = "(select id from i_remit where supplier = 3)"
query(
    "maintained_shop_stock", "v_out v_sold i_remit",
    f"""
select o.shop_id, o.product_id, cast(o.q - coalesce(s.q, 0) as bigint) as stock
from (select shop_id, product_id, sum(quantity) as q from v_out where outid_id not in {_HIDDEN} group by all) o
left join (select shop_id, product_id, sum(quantity) as q from v_sold where oid_id not in {_HIDDEN} group by all) s
  on s.shop_id = o.shop_id and s.product_id = o.product_id
""",
)(lambda t: maintained.shop_product_stock(_after(t, "outstream", "sellorder")))
query(
    "maintained_depot_stock", "v_in v_out i_remit",
    f"""
select i.depot_id, i.product_id, cast(i.q - coalesce(o.q, 0) as bigint) as stock
from (select depot_id, product_id, sum(quantity) as q from v_in where inid_id not in {_HIDDEN} group by all) i
left join (select depot_id, product_id, sum(quantity) as q from v_out group by all) o
  on o.depot_id = i.depot_id and o.product_id = i.product_id
""",
)(lambda t: maintained.depot_product_stock(_after(t, "instream")))
query(
    "maintained_product_summary", "i_products v_in v_out i_remit",
    f"""
select p.id as product_id, case when coalesce(d, 0) = 0 then 0 else cast((n // d) + case when 2 * (n % d) > d
  or (2 * (n % d) = d and (n // d) % 2 = 1) then 1 else 0 end as bigint) end as avg_cost_cents,
  cast(coalesce(d, 0) - coalesce(oq, 0) as bigint) as on_hand, last_cents as last_value_cents,
  cast(coalesce(d, 0) as bigint) as in_qty, cast(coalesce(oq, 0) as bigint) as out_qty
from i_products p left join (select product_id, sum(quantity * value_cents) n, sum(quantity) d, arg_max(value_cents, id) last_cents
    from v_in where inid_id not in {_HIDDEN} group by 1) i on i.product_id = p.id
  left join (select product_id, sum(quantity) oq from v_out where outid_id not in {_HIDDEN} group by 1) o on o.product_id = p.id
""",
)(lambda t: maintained.product_summary(_after(t, "instream", "outstream"), t["products"]))


# -- searches with an index, and over ledgers stored by month ---------------------------


def _index(t, table, *columns):
    """The stored trigram index of a table's columns."""
    path = fresh_path(t, f"{table}-index")
    trigram.write_index(t[table].select("id", *columns), columns, path)
    return trigram.read_index(t["shop"].sparkSession, path)


query(
    "or_contains_indexed", "i_customer",
    """
select id from i_customer where contains(lower(name), 'omer_1') or contains(lower(code), 'omer_1') or contains(telephone, 'omer_1')
union all select id from i_customer where contains(lower(name), 'ma') or contains(lower(code), 'ma') or contains(telephone, 'ma')
union all select id from i_customer where contains(telephone, '0042')
""",
)(
    lambda t: _three_searches(t["customer"], _index(t, "customer", "name", "code", "telephone"))
)


def _three_searches(df, index):
    found = [trigram.contains(df, index, q, "name", "code", "telephone").select("id") for q in ("oMER_1", "mA", "0042")]
    return found[0].unionAll(found[1]).unionAll(found[2])


query(
    "raw_like_indexed", "i_products",
    "select id from i_products where name ilike '%RED%' or barcode ilike '1_000%'",
)(
    lambda t: trigram.like(t["products"], _index(t, "products", "name", "barcode"), {"name": "%RED%", "barcode": "1_000%"}).select("id")
)
query(
    "and_contains_indexed", "i_sellorder",
    "select id from i_sellorder where contains(lower(code), 'so12') and contains(note, '-') and note is not null",
)(
    lambda t: trigram.contains_all(t["sellorder"], _index(t, "sellorder", "code", "note"), {"code": "sO12", "note": "-"}).select("id")
)


def _clustered(t):
    path = fresh_path(t, "by-month")
    clustered.write_clustered({n: t[n] for n in ("instream", "indetail", "outstream", "outdetail", "sellorder", "sellorderdetail", "customer", "staff")}, path)
    return clustered.read_clustered(t["shop"].sparkSession, path)


query(
    "order_search_clustered", "totals",
    f"""
select id, code, customer_id, shop_id, staff_id, discount_cents, strftime(date, '%Y-%m-%d %H:%M:%S') as date,
  hidden, note, cast(total_cents as bigint) as total_cents from totals where {_WHERE}
""",
)(
    lambda t: search.order_search(_clustered(t), as_of=AS_OF, **FIELDS)
)
query("order_search_exact_clustered", "totals", "select id, cast(total_cents as bigint) as total_cents from totals where id = 42 and not hidden")(
    lambda t: search.order_search_exact(_clustered(t), 42).select("id", "total")
)


def _store(t, table):
    """A store of one table in files of few rows, with a second version that adds some and changes some."""
    spark, root = t["shop"].sparkSession, fresh_path(t, "store")
    rows = t[table].filter("id % 5 <> 1")
    snapshots.write_store({table: rows}, root, _FILE_ROWS // 8)
    snapshots.commit(spark, root, {table: snapshots.Delta(t[table].filter("id % 5 = 1 or id < 50"))}, file_rows=_FILE_ROWS // 8)
    return spark, root


query(
    "top_recent_stored", "i_sellorder",
    """
(select 'all' as asked, id, code from i_sellorder order by id desc limit 10)
union all (select 'shop', id, code from i_sellorder where shop_id = 3 order by id desc limit 15)
""",
)(lambda t: _recent(*_store(t, "sellorder")))


def _recent(spark, root):
    latest = newest.newest(spark, root, "sellorder", 10).select(F.lit("all").alias("asked"), "id", "code")
    of_shop = newest.newest(spark, root, "sellorder", 15, F.col("shop_id") == 3)
    return latest.unionByName(of_shop.select(F.lit("shop").alias("asked"), "id", "code"))


query(
    "page_slice_stored", "i_sellorder",
    """
(select 3 as page, id, code from i_sellorder order by id desc limit 20 offset 40)
union all (select 70, id, code from i_sellorder order by id desc limit 20 offset 1380)
""",
)(lambda t: _pages(*_store(t, "sellorder")))


def _pages(spark, root):
    third, deep = (newest.page(spark, root, "sellorder", n).select(F.lit(n).alias("page"), "id", "code") for n in (3, 70))
    return third.unionByName(deep)
