"""Ledger tables derived from a TPC-H-like star schema.

Orders become the headers of all three ledgers; line numbers split the line items
into receipts (1-4), issues and returns (5-6) and sales (7). Parts are products,
nations shops, regions depots, suppliers staff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.tables import Tables

HEAD_OFFICE = "NATION_0"

#: schemas of the star tables, so that opening one reads no file footer
STAR = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}

# A line id is the place of the line in its order. Plans that do not use it drop the
# window. Unit prices come from integer cents: a double quotient would round differently
# from engine to engine. Only lines of a ledger and those before them take part, as a place depends on no
# others. Receipts come first: before them are only lines without a number, of which only that they are there takes part.
# Lines before the other ledgers are many, so they are counted by order and not sorted.
_VALUES = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")


def _lines(own: str, before: str | None = None) -> str:
    place = f"row_number() over (partition by l_orderkey order by l_linenumber, {', '.join(_VALUES)})"
    if before is None:
        values = ", ".join(f"case when {own} then {c} end as {c}" for c in _VALUES)
        rows = f"select l_orderkey, l_linenumber, {values} from {{lineitem}} where {own} or l_linenumber is null"
    else:
        place = f"coalesce(n_before, 0) + {place}"
        counts = f"select l_orderkey as counted, count(*) as n_before from {{lineitem}} where {before} or l_linenumber is null group by 1"
        rows = f"""select l_orderkey, l_linenumber, {", ".join(_VALUES)}, n_before from (select * from {{lineitem}} where {own})
  left join ({counts}) on l_orderkey = counted"""
    return f"""
select * from (select l_orderkey * 1000 + {place} as id,
    l_orderkey as header_id, l_partkey as product_id, cast(l_quantity as int) as quantity,
    cast(cast(cast(cast(l_extendedprice as decimal(12,2)) * 100 as bigint) div cast(l_quantity as bigint)
      as decimal(12,0)) * 0.01 as decimal(8,2)) as price,
    l_suppkey % 5 as depot_id, l_linenumber
  from ({rows}))
where {own}
"""


_PEOPLE = (
    "o_orderkey % 10 as keeper_id, o_orderkey % 10 as staff1_id, cast(null as bigint) as staff2_id"
)
_HIDDEN = "o_orderkey % 10 = 3 as hidden, o_orderpriority as note"
_CODE = "case when o_orderkey % 31 <> 0 then concat('{prefix}', cast(o_orderkey as string)) end as code"
_SHOP = (
    "(select c_custkey, cast(c_nationkey as bigint) as shop_id from {customer}) on o_custkey = c_custkey"
)
_ROOT = "cast(substr(p_brand, 7) as bigint)"
_LEAF = (
    "cast(array_position(array('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'), p_type) as bigint)"
)


def _nulls(**columns: str) -> str:
    return ", ".join(f"cast(null as {kind}) as {name}" for name, kind in columns.items())


#: table -> query over the star tables, types as declared in ``schemas``
QUERIES = {
    "shop": f"""
select cast(n_nationkey as bigint) as id, n_name as name, {_nulls(telephone="string")},
  cast(n_regionkey as string) as address, {_nulls(opendate="date", note="string")} from {{nation}}""",
    "depot": f"""
select cast(r_regionkey as bigint) as id, r_name as name, {_nulls(address="string")}, r_regionkey = 4 as hidden,
  {_nulls(note="string")} from {{region}}""",
    "category": f"""
select distinct {_ROOT} as id, p_brand as name, cast(null as bigint) as pid_id, false as hidden from {{part}}
union all select distinct {_ROOT} * 100 + {_LEAF}, p_type, {_ROOT}, {_LEAF} = 6 and {_ROOT} % 5 = 0 from {{part}}""",
    "products": f"""
select p_partkey as id, p_name as name, case when p_partkey % 17 <> 0 then cast(100000 + p_partkey as string) end as barcode,
  {_nulls(image="string")}, {_ROOT} * 100 + {_LEAF} as category_id,
  case when p_partkey % 19 <> 0 then concat(cast(p_size as string), ',', cast(p_size + 10 as string)) end as size,
  p_partkey % 13 = 0 as hidden, p_type as note from {{part}}""",
    "staff": f"""
select s_suppkey as id, s_suppkey as user_id, s_name as name, case when s_acctbal < 5000 then 'F' else 'M' end as sex,
  {_nulls(image="string", edu="string")}, s_acctbal < 2500 as marital,
  {_nulls(school="string", graduation="date", address="string", cellphone="string", idcode="string", homephone="string")},
  cast(s_nationkey as bigint) as shop_id,
  cast(case when s_suppkey % 10 = 0 then 99 else s_suppkey % 10 end as smallint) as level,
  {_nulls(joindate="date", exwork="string", family="string", note="string")} from {{supplier}}""",
    "payslip": f"""
select s_suppkey as id, s_suppkey as staff_id, cast(s_acctbal as decimal(7,2)) as pay, {_nulls(date="date", note="string")}
from {{supplier}}""",
    "customer": f"""
select c_custkey as id, c_name as name, case when c_custkey % 23 <> 0 then c_mktsegment end as code,
  cast(c_nationkey as bigint) as shop_id, cast(13500000000 + c_custkey as string) as telephone,
  {_nulls(address="string", joindate="date")}, c_custkey % 19 = 0 as hidden, {_nulls(note="string")} from {{customer}}""",
    "instream": f"""
select o_orderkey as id, {_CODE.replace("{prefix}", "IN")}, cast(o_orderkey % 4 + 1 as smallint) as supplier,
  cast(o_orderdate as date) as date, {_PEOPLE}, {_nulls(log="string")}, {_HIDDEN} from {{orders}}""",
    "indetail": f"""
select id, header_id as inid_id, product_id, price as value, quantity, depot_id, {_nulls(depotdetail="string")}
from ({_lines("l_linenumber <= 4")})""",
    "outstream": f"""
select o_orderkey as id, {_CODE.replace("{prefix}", "OUT")}, o_orderdate as date, {_PEOPLE}, shop_id,
  o_orderkey % 7 = 0 as returned, {_HIDDEN}, {_nulls(log="string")} from {{orders}} join {_SHOP}""",
    "outdetail": f"""
select id, header_id as outid_id, product_id, case when header_id % 7 = 0 then -quantity else quantity end as quantity,
  depot_id from ({_lines("l_linenumber in (5, 6)", "l_linenumber < 5")})""",
    "sellorder": f"""
select o_orderkey as id, {_CODE.replace("{prefix}", "SO")}, case when o_orderkey % 11 <> 0 then o_custkey end as customer_id,
  shop_id, o_orderkey % 10 as staff_id,
  case when o_orderkey % 29 <> 0 then cast(o_orderkey % 5 as decimal(8,2)) end as discount, o_orderdate as date, {_HIDDEN}
from {{orders}} join {_SHOP}""",
    "sellorderdetail": f"""
select id, header_id as oid_id, product_id, quantity, price from ({_lines("l_linenumber = 7", "l_linenumber < 7")})""",
    "remit": f"""
select o_orderkey as id, cast(o_orderkey % 4 + 1 as smallint) as supplier, cast(o_totalprice as decimal(8,2)) as amount,
  o_orderkey % 10 as staff_id, cast(o_orderdate as date) as date, {_HIDDEN} from {{orders}}""",
    "posts": """
select cast(r_regionkey as bigint) as id, r_name as title, r_name as note, date'2001-08-01' as date,
  r_regionkey = 2 as hidden from {region}""",
}


def sample_tables(spark: SparkSession, path: str) -> Tables:
    star: dict[str, DataFrame] = {}

    def read(name: str) -> DataFrame:
        if name not in star:
            star[name] = spark.read.schema(STAR[name]).parquet(f"{path}/{name}.parquet")
        return star[name]

    def make(table: str) -> DataFrame:
        text = QUERIES[table]
        return spark.sql(text, **{name: read(name) for name in STAR if "{" + name + "}" in text})

    return Tables({table: (lambda t=table: make(t)) for table in QUERIES})
