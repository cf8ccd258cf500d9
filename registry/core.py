"""Pairs each registered query with the SQL that checks it.

Queries read the ledger tables derived from the driver's star schema; the SQL carries
the same derivation as common table expressions. Money leaves both sides as BIGINT
cents, dates and times as text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerloom.session import cut, tune
from ledgerloom.sources.sample import HEAD_OFFICE, sample_tables
from ledgerloom.sources.tables import Tables

AS_OF = date(2001, 8, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# -- the derivation, in SQL ------------------------------------------------------------

_LEAF = (
    "case p_type when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3 "
    "when 'PROMO' then 4 when 'SMALL' then 5 when 'STANDARD' then 6 end"
)
_ROOT = "cast(substr(p_brand, 7) as bigint)"
_CODE = "case when o_orderkey % 31 <> 0 then concat('{}', cast(o_orderkey as varchar)) end as code"
_PEOPLE = (
    "o_orderkey % 10 as keeper_id, o_orderkey % 10 as staff1_id, o_orderkey % 10 as staff_id, "
    "o_orderkey % 10 = 3 as hidden, o_orderpriority as note"
)

_CTE = {
    "line": (
        "select l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, "
        "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as id, "
        "l_orderkey as header_id, l_partkey as product_id, cast(l_quantity as bigint) as quantity, "
        "cast(cast(l_extendedprice as decimal(12,2)) * 100 as bigint) // cast(l_quantity as bigint) as price_cents, "
        "l_suppkey % 5 as depot_id, l_linenumber, l_returnflag from lineitem",
        [],
    ),
    "hdr": (
        "select *, cast(c_nationkey as bigint) as shop_id from orders join customer on o_custkey = c_custkey", []
    ),
    "i_shop": ("select cast(n_nationkey as bigint) as id, n_name as name from nation", []),
    "i_depot": ("select cast(r_regionkey as bigint) as id, r_name as name, r_regionkey = 4 as hidden from region", []),
    "i_category": (
        f"select distinct {_ROOT} as id, p_brand as name, cast(null as bigint) as pid_id, false as hidden from part "
        f"union all select distinct {_ROOT} * 100 + {_LEAF}, p_type, {_ROOT}, "
        f"{_LEAF} = 6 and {_ROOT} % 5 = 0 from part",
        [],
    ),
    "i_products": (
        "select p_partkey as id, p_name as name, "
        "case when p_partkey % 17 <> 0 then cast(100000 + p_partkey as varchar) end as barcode, "
        f"{_ROOT} * 100 + {_LEAF} as category_id, case when p_partkey % 19 <> 0 then "
        "concat(cast(p_size as varchar), ',', cast(p_size + 10 as varchar)) end as size, "
        "p_partkey % 13 = 0 as hidden, p_type as note from part",
        [],
    ),
    "i_staff": (
        "select s_suppkey as id, s_name as name, case when s_acctbal < 5000 then 'F' else 'M' end as sex, "
        "s_acctbal < 2500 as marital, cast(s_nationkey as bigint) as shop_id, "
        "case when s_suppkey % 10 = 0 then 99 else s_suppkey % 10 end as level from supplier",
        [],
    ),
    "i_customer": (
        "select c_custkey as id, c_name as name, case when c_custkey % 23 <> 0 then c_mktsegment end as code, "
        "cast(c_nationkey as bigint) as shop_id, cast(13500000000 + c_custkey as varchar) as telephone, "
        "c_custkey % 19 = 0 as hidden from customer",
        [],
    ),
    "i_instream": (
        f"select o_orderkey as id, {_CODE.format('IN')}, o_orderkey % 4 + 1 as supplier, "
        f"cast(o_orderdate as date) as date, {_PEOPLE} from orders",
        [],
    ),
    "i_indetail": (
        "select id, header_id as inid_id, product_id, price_cents as value_cents, quantity, depot_id, "
        "l_returnflag from line where l_linenumber <= 4",
        ["line"],
    ),
    "i_outstream": (
        f"select o_orderkey as id, {_CODE.format('OUT')}, o_orderdate as date, shop_id, "
        f"o_orderkey % 7 = 0 as returned, {_PEOPLE} from hdr",
        ["hdr"],
    ),
    "i_outdetail": (
        "select id, header_id as outid_id, product_id, "
        "case when header_id % 7 = 0 then -quantity else quantity end as quantity, depot_id, l_returnflag "
        "from line where l_linenumber in (5, 6)",
        ["line"],
    ),
    "i_sellorder": (
        f"select o_orderkey as id, {_CODE.format('SO')}, "
        "case when o_orderkey % 11 <> 0 then o_custkey end as customer_id, shop_id, o_orderdate as date, "
        "case when o_orderkey % 29 <> 0 then (o_orderkey % 5) * 100 end as discount_cents, "
        f"{_PEOPLE} from hdr",
        ["hdr"],
    ),
    "i_sellorderdetail": (
        "select id, header_id as oid_id, product_id, quantity, price_cents, l_returnflag "
        "from line where l_linenumber = 7",
        ["line"],
    ),
    "i_remit": (
        "select o_orderkey as id, o_orderkey % 4 + 1 as supplier, "
        "cast(cast(o_totalprice as decimal(12,2)) * 100 as bigint) as amount_cents, o_orderkey % 10 as staff_id, "
        "cast(o_orderdate as date) as date, o_orderkey % 10 = 3 as hidden from orders",
        [],
    ),
    "i_posts": (
        "select cast(r_regionkey as bigint) as id, r_name as title, r_name as note, date '2001-08-01' as date, "
        "r_regionkey = 2 as hidden from region",
        [],
    ),
    # -- shared results --------------------------------------------------------------
    "v_in": ("select d.* from i_indetail d join i_instream h on h.id = d.inid_id where not h.hidden",
             ["i_indetail", "i_instream"]),
    "v_out": ("select d.*, h.shop_id from i_outdetail d join i_outstream h on h.id = d.outid_id where not h.hidden",
              ["i_outdetail", "i_outstream"]),
    "v_sold": (
        "select d.*, h.shop_id, h.date from i_sellorderdetail d join i_sellorder h on h.id = d.oid_id "
        "where not h.hidden",
        ["i_sellorderdetail", "i_sellorder"],
    ),
    "gross": ("select oid_id, sum(quantity * price_cents) as gross_cents from i_sellorderdetail group by 1",
              ["i_sellorderdetail"]),
    "totals": (
        "select o.*, case when g.oid_id is null then 0 else gross_cents - coalesce(discount_cents, 0) end as total_cents, "
        "g.oid_id is not null as has_lines from i_sellorder o left join gross g on g.oid_id = o.id",
        ["i_sellorder", "gross"],
    ),
    "shop_stock": (
        "select o.shop_id, o.product_id, cast(o.q - coalesce(s.q, 0) as bigint) as stock from "
        "(select shop_id, product_id, sum(quantity) q from v_out group by 1, 2) o left join "
        "(select shop_id, product_id, sum(quantity) q from v_sold group by 1, 2) s "
        "on s.shop_id = o.shop_id and s.product_id = o.product_id",
        ["v_out", "v_sold"],
    ),
    "depot_stock": (
        "select i.depot_id, i.product_id, cast(i.q - coalesce(o.q, 0) as bigint) as stock from "
        "(select depot_id, product_id, sum(quantity) q from v_in group by 1, 2) i left join "
        "(select depot_id, product_id, sum(quantity) q from v_out group by 1, 2) o "
        "on o.depot_id = i.depot_id and o.product_id = i.product_id",
        ["v_in", "v_out"],
    ),
    "summary": (
        "select p.id as product_id, case when coalesce(d, 0) = 0 then 0 else cast((n // d) + case when 2 * (n % d) > d "
        "or (2 * (n % d) = d and (n // d) % 2 = 1) then 1 else 0 end as bigint) end as avg_cost_cents, "
        "cast(coalesce(d, 0) - coalesce(oq, 0) as bigint) as on_hand, last_cents as last_value_cents, "
        "cast(coalesce(d, 0) as bigint) as in_qty, cast(coalesce(oq, 0) as bigint) as out_qty "
        "from i_products p left join (select product_id, sum(quantity * value_cents) n, sum(quantity) d, "
        "arg_max(value_cents, id) last_cents from v_in group by 1) i on i.product_id = p.id "
        "left join (select product_id, sum(quantity) oq from v_out group by 1) o on o.product_id = p.id",
        ["i_products", "v_in", "v_out"],
    ),
}


def sql(body: str, *needs: str) -> str:
    """``body`` behind the common table expressions it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in _CTE[name][1]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    head = ",\n".join(f"{n} as ({_CTE[n][0]})" for n in ordered)
    body = body.strip()
    if body.startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    if body.startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


# -- registration ----------------------------------------------------------------------


def plain(df: DataFrame) -> DataFrame:
    """Money as BIGINT cents (``x`` -> ``x_cents``), integers BIGINT, dates and times as text."""
    out = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 2:
            out.append(f"cast({name} * 100 as bigint) as {f.name}_cents")
        elif isinstance(f.dataType, (T.ShortType, T.IntegerType)):
            out.append(f"cast({name} as bigint) as {name}")
        elif isinstance(f.dataType, T.DateType):
            out.append(f"cast({name} as string) as {name}")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            out.append(f"date_format({name}, 'yyyy-MM-dd HH:mm:ss') as {name}")
        elif isinstance(f.dataType, T.ArrayType):
            out.append(f"array_join(cast({name} as array<string>), ',') as {name}")
        else:
            out.append(name)
    return df.selectExpr(*out)


def stored(t: Tables, *names: str) -> Tables:
    """The tables with some of them derived once and kept, for jobs that read them several times."""
    return t.replaced(**{name: cut(t[name]) for name in names})


def query(name: str, needs: str = "", body: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with the SQL that computes the same."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(sample_tables(tune(spark), sf_dir)))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if body is not None:
            ORACLE[name] = sql(body, *needs.split())
        return fn

    return register


__all__ = ["AS_OF", "HEAD_OFFICE", "ORACLE", "QUERIES", "plain", "query", "sql", "stored"]
