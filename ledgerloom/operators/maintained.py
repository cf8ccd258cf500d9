"""Stock and product sums that are kept up with changes instead of being counted again.

The state holds, for each key, sums over all visible lines and how many lines there are. A change job's ``delta`` names
lines and headers. The lines it names and those below headers it names are taken out as they were and put in as they are;
the difference of what they add up to goes onto the state. The rest of the ledgers is not summed.

The latest purchase price is no sum. Where the line it came from is among those taken out, the product's
receipts are searched again, else the latest of the lines put in is compared with it.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import half_even_div, line_cents, money
from ledgerloom.functions.predicates import visible
from ledgerloom.operators.lookup import lines_of
from ledgerloom.schemas import LINE_HEADER
from ledgerloom.sources.snapshots import Delta
from ledgerloom.session import cut

Tables = Mapping[str, DataFrame]


class State(NamedTuple):
    #: shop_id, product_id, stock, in_lines (issue lines), lines (with sale lines)
    shop_stock: DataFrame
    #: depot_id, product_id, stock, in_lines (receipt lines), lines (with issue lines)
    depot_stock: DataFrame
    #: product_id, in_qty, out_qty, in_cents, lines, last_id and last_value (of the latest receipt line)
    product_flows: DataFrame


_KEYS = {"shop_stock": ["shop_id", "product_id"], "depot_stock": ["depot_id", "product_id"], "product_flows": ["product_id"]}
_SUMS = {
    "shop_stock": ["stock", "in_lines", "lines"], "depot_stock": ["stock", "in_lines", "lines"],
    "product_flows": ["in_qty", "out_qty", "in_cents", "lines"],
}


class _Lines(NamedTuple):
    """The lines of the three ledgers whose header is visible, with the shop where there is one."""

    receipts: DataFrame
    issues: DataFrame
    sales: DataFrame


def _visible(lines: Tables, headers: Tables) -> _Lines:
    def below(line: str, **columns: str) -> DataFrame:
        header, fk = LINE_HEADER[line]
        return lines_of(lines[line], fk, headers[header].filter(visible()), **columns)

    return _Lines(below("indetail"), below("outdetail", shop_id="shop_id"), below("sellorderdetail", shop_id="shop_id"))


def _moves(v: _Lines, sign: int) -> dict[str, DataFrame]:
    """What the lines add to each part of the state, times ``sign``; a row for each line."""
    q, zero, one = F.col("quantity").cast("bigint") * sign, F.lit(0).cast("bigint"), F.lit(sign).cast("bigint")
    named = lambda df, keys, **sums: df.select(*keys, *[c.alias(n) for n, c in sums.items()])
    shop, depot, product = _KEYS.values()
    return {
        "shop_stock": named(v.issues, shop, stock=q, in_lines=one, lines=one).unionByName(
            named(v.sales, shop, stock=-q, in_lines=zero, lines=one)
        ),
        "depot_stock": named(v.receipts, depot, stock=q, in_lines=one, lines=one).unionByName(
            named(v.issues, depot, stock=-q, in_lines=zero, lines=one)
        ),
        "product_flows": named(
            v.receipts, product, in_qty=q, out_qty=zero, in_cents=line_cents("quantity", "value") * sign, lines=one
        ).unionByName(named(v.issues, product, in_qty=zero, out_qty=q, in_cents=zero, lines=one)),
    }


def _summed(part: str, rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*_KEYS[part]).agg(*[F.sum(c).cast("bigint").alias(c) for c in _SUMS[part]])
    return sums.filter(F.col("lines") != 0)


def _latest(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("product_id").agg(F.max("id").alias("last_id"), F.max_by("value", "id").alias("last_value"))


def build(t: Tables) -> State:
    """The state of the tables, counted from all lines."""
    v = _visible(t, t)
    parts = {part: _summed(part, rows) for part, rows in _moves(v, 1).items()}
    flows = parts["product_flows"].join(_latest(v.receipts), "product_id", "left")
    return State(parts["shop_stock"], parts["depot_stock"], flows)


def _touched(t: Tables, delta: Mapping[str, Delta]) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    """Per line table the touched lines as they were and as they are; per header table all headers as they are."""
    none = Delta()

    def ids(d: Delta, like: DataFrame) -> DataFrame:
        out = like.select("id").limit(0)
        for part in d:
            out = out if part is None else out.unionAll(part.select("id"))
        return cut(out.distinct())

    was, now, headers = {}, {}, {}
    for line, (header, fk) in LINE_HEADER.items():
        own, above = delta.get(line, none), delta.get(header, none)
        named, heads = ids(own, t[line]), ids(above, t[header])
        under = heads.select(F.col("id").alias(fk))
        stay = t[line].join(under, fk, "left_semi").join(named, "id", "left_anti").select(*t[line].columns)
        was[line] = t[line].join(named, "id", "left_semi").select(*t[line].columns).unionByName(stay)
        now[line] = stay if own.rows is None else stay.unionByName(own.rows.select(*stay.columns))
        kept = t[header].join(heads, "id", "left_anti").select(*t[header].columns)
        headers[header] = kept if above.rows is None else kept.unionByName(above.rows.select(*kept.columns))
    return was, now, headers


def advance(state: State, t: Tables, delta: Mapping[str, Delta]) -> State:
    """The state after a change; ``t`` are the tables before it."""
    was, now, headers = _touched(t, delta)
    out, into = _visible(was, t), _visible(now, headers)
    less, more = _moves(out, -1), _moves(into, 1)
    parts = {}
    for part, rows in state._asdict().items():
        columns = [*_KEYS[part], *_SUMS[part]]
        parts[part] = _summed(part, rows.select(*columns).unionByName(less[part]).unionByName(more[part]))

    lasts = state.product_flows.select("product_id", "last_id", "last_value").filter("last_id is not null")
    if not {"indetail", LINE_HEADER["indetail"][0]} & set(delta):  # no receipt is touched
        return State(parts["shop_stock"], parts["depot_stock"], parts["product_flows"].join(lasts, "product_id", "left"))

    # a product whose latest receipt line was touched is searched again, among its own lines
    gone = out.receipts.select(F.col("id").alias("last_id"), "product_id")
    again = cut(lasts.join(gone, ["last_id", "product_id"], "left_semi").select("product_id"))
    named = was["indetail"].select("id")
    rest = t["indetail"].join(again, "product_id", "left_semi").join(named, "id", "left_anti").select(*t["indetail"].columns)
    found = lines_of(rest, "inid_id", headers["instream"].filter(visible())).select("product_id", F.col("id").alias("last_id"), F.col("value").alias("last_value"))
    put = into.receipts.select("product_id", F.col("id").alias("last_id"), F.col("value").alias("last_value"))
    all_lasts = lasts.join(again, "product_id", "left_anti").unionByName(found).unionByName(put)
    latest = all_lasts.groupBy("product_id").agg(F.max_by("last_value", "last_id").alias("last_value"), F.max("last_id").alias("last_id"))
    flows = parts["product_flows"].join(latest.select("product_id", "last_id", "last_value"), "product_id", "left")
    return State(parts["shop_stock"], parts["depot_stock"], flows)


# -- what the state answers ------------------------------------------------------------


def shop_product_stock(state: State) -> DataFrame:
    """As ``stock.shop_product_stock``."""
    return state.shop_stock.filter(F.col("in_lines") > 0).select("shop_id", "product_id", "stock")


def depot_product_stock(state: State) -> DataFrame:
    """As ``stock.depot_product_stock``."""
    return state.depot_stock.filter(F.col("in_lines") > 0).select("depot_id", "product_id", "stock")


def product_summary(state: State, products: DataFrame) -> DataFrame:
    """As ``cost.product_summary``."""
    zero = F.lit(0).cast("bigint")
    in_qty, out_qty = F.coalesce("in_qty", zero), F.coalesce("out_qty", zero)
    rows = products.select(F.col("id").alias("product_id")).join(state.product_flows, "product_id", "left")
    cost = F.when(F.col("last_id").isNotNull(), half_even_div(F.col("in_cents"), F.col("in_qty")))
    return rows.select(
        "product_id", money(F.coalesce(cost, zero)).alias("avg_cost"), (in_qty - out_qty).alias("on_hand"), "last_value",
        in_qty.alias("in_qty"), out_qty.alias("out_qty"),
    )
