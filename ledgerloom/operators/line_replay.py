"""Edits of ledger lines that name some line more than once, replayed in order.

An edit starts from what the accepted edits before it left of its line, so its effect on stock is not
known before they are decided. Spark shuffles and sorts the rows by product and ``seq``; a task
streams through its products and holds only what is in stock of the current one and how its edited lines stand.

``rows``: per product first the stock of its depots (``seq`` NULL, ``depot_id``, ``quantity``) and, for issues,
how many lines with a positive quantity each issue has from a depot (``place_id`` set), then the edits: ``line_id``,
``place_id`` (the document), ``quantity`` and ``depot_id`` wanted, ``old_quantity``, ``old_depot`` and ``old_value`` as stored,
``value`` wanted, ``counts`` (the document is visible).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

COLUMNS = [
    "product_id", "seq", "line_id", "place_id", "depot_id", "quantity", "old_depot", "old_quantity", "old_value", "value", "counts",
]
DECIDED = "seq bigint, accepted boolean, short boolean, was_quantity bigint, was_depot bigint, was_value string"


def _replay(issues: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["product_id", "seq", "line_id", "place_id", "depot_id", "quantity", "old_depot", "old_quantity", "old_value", "value", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, stock, room, lines = None, {}, {}, {}
        schema = pa.schema(
            [("seq", pa.int64()), ("accepted", pa.bool_()), ("short", pa.bool_()), ("was_quantity", pa.int64()),
             ("was_depot", pa.int64()), ("was_value", pa.string())]
        )
        for batch in batches:
            out = []
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                own, seq, line, place, depot, wanted, old_depot, old_quantity, old_value, value, counts = row
                if own != product:
                    product, stock, room, lines = own, {}, {}, {}
                if seq is None:
                    (stock if place is None else room)[depot if place is None else (place, depot)] = wanted
                    continue
                was, at, priced = lines.get(line, (old_quantity, old_depot, old_value))
                moved = at != depot
                if issues:
                    short = wanted - was > stock.get(depot, 0)
                    taken = room.get((place, depot), 0) - (0 if moved or was <= 0 else 1)
                    accepted = not short and taken <= 0
                else:
                    less = was - wanted
                    short = less > sum(stock.values())
                    accepted = not short and less <= stock.get(depot, 0)
                out.append((seq, accepted, short, was, at, priced))
                if not accepted:
                    continue
                lines[line] = wanted, depot, value
                if issues:
                    if counts and depot in stock:
                        stock[depot] -= wanted if moved else wanted - was
                    if counts and moved and at in stock:
                        stock[at] += was
                    room[place, at] = room.get((place, at), 0) - (was > 0)
                    room[place, depot] = room.get((place, depot), 0) + (wanted > 0)
                elif counts:
                    stock[at] = stock.get(at, 0) - was
                    stock[depot] = stock.get(depot, 0) + wanted
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def replay_edits(rows: DataFrame, issues: bool) -> DataFrame:
    """Per edit: accepted, short (of stock) and the line's quantity, depot and value just before it."""
    ordered = rows.select(*COLUMNS).repartition("product_id").sortWithinPartitions("product_id", "seq")
    return ordered.mapInArrow(_replay(issues), DECIDED)
