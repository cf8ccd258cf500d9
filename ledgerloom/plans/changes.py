"""Ledger change jobs.

Each job takes the current tables and a batch of changes and returns a
``ChangeResult``: the new tables (nothing is written in place), the changes it refused
with a reason, and the audit entries. Changes carry ``seq``, their order of submission;
jobs whose checks depend on stock decide them strictly in that order.

A batch may change one row any number of times. A change is judged by its own rules first, and
what it starts from is what the accepted changes before it left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions.dates import parse_moment
from ledgerloom.functions.predicates import visible
from ledgerloom.functions.text import squash
from ledgerloom.operators import stock
from ledgerloom.operators.admission import admit_in_order
from ledgerloom.operators.cost import product_summary
from ledgerloom.operators.lookup import fk_lookup, visible_lines
from ledgerloom.operators.ownership import grant_in_order
from ledgerloom.operators.line_replay import COLUMNS, replay_edits
from ledgerloom.operators.running import id_block, number_by_range, running_total
from ledgerloom.plans import quality
from ledgerloom.plans.catalog import product_form_categories
from ledgerloom.schemas import TABLES, conform
from ledgerloom.session import cut
from ledgerloom.sources.documents import order_doc_lines
from ledgerloom.sources.snapshots import Delta
from ledgerloom.sources.tables import Tables


class ChangeResult(NamedTuple):
    tables: Tables
    rejected: DataFrame
    audit: DataFrame | None = None
    added: DataFrame | None = None
    #: accepted changes that a later accepted one to the same row replaced
    superseded: DataFrame | None = None
    #: per table the rows added or changed and the ids deleted, for ``snapshots.commit`` and ``maintained.advance``
    delta: Mapping[str, Delta] = {}


# -- shared steps ----------------------------------------------------------------------


def _as_tables(t: Mapping[str, DataFrame]) -> Tables:
    return t if isinstance(t, Tables) else Tables({n: (lambda df=df: df) for n, df in t.items()})


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _next_id(df: DataFrame) -> Column:
    """One more than the largest id, as a scalar subquery."""
    return F.coalesce(df.agg(F.max("id").alias("m")).scalar(), _zero())


def _assign_ids(new: DataFrame, stored: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Give ``new`` rows the ids after the stored ones, in ``order``."""
    numbered = number_by_range(new, order, "_n")
    return numbered.withColumn("id", F.col("_n") + _next_id(stored)).drop("_n")


def _split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with one)."""
    marked = df.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def _first_reason(rules: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(broken, F.lit(code)) for code, broken in rules.items()])


def _repeated(df: DataFrame, key: str) -> DataFrame:
    """Mark changes to a row an earlier change of the batch already names."""
    first = F.min("seq").over(Window.partitionBy(key))
    return df.withColumn("repeated", F.coalesce((F.col("seq") > first) & F.col(key).isNotNull(), F.lit(False)))


def _last_of_each(good: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Of accepted changes: the last one to each row, and those it replaced."""
    named = good.filter(F.col(key).isNotNull())
    marked = named.withColumn("_last", F.max("seq").over(Window.partitionBy(key)))
    return (
        marked.filter(F.col("seq") == F.col("_last")).drop("_last"),
        marked.filter(F.col("seq") < F.col("_last")).select("seq", F.col(key).alias("id")),
    )


def _named(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored lines that a batch names, picked before anything is looked up for them."""
    return lines.join(changes.select("id").distinct(), "id", "left_semi")


def render_log(old: DataFrame, audit: DataFrame) -> DataFrame:
    """Prepend audit entries, newest first, to the ``log`` text of the headers ``old``.

    The audit rows are the record; jobs leave ``log`` alone. Render the headers to show:
    each one's entries become a single text cell.
    """
    audit = audit.join(old.select(F.col("id").alias("header_id")), "header_id", "left_semi")
    entries = audit.groupBy("header_id").agg(F.collect_list(F.struct("seq", "entry")).alias("e"))
    text = F.array_join(F.transform(F.reverse(F.array_sort("e")), lambda x: x["entry"]), "")
    entries = entries.select(F.col("header_id").alias("_hid"), text.alias("_new"))
    joined = old.join(entries, F.col("id") == F.col("_hid"), "left")
    log = F.when(F.col("_new").isNull(), F.col("log")).otherwise(
        F.concat("_new", F.coalesce("log", F.lit("")))
    )
    return joined.withColumn("log", log).select(*old.columns)


def _entry(wording: str, as_of: date, operator: Column | str, *parts: Column) -> Column:
    """An audit entry: one of the fixed wordings, filled in."""
    operator = F.lit(operator) if isinstance(operator, str) else operator
    return F.format_string(wording, F.lit(str(as_of)), operator, *parts)


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# -- hiding and upserts ----------------------------------------------------------------


def soft_delete(t: Mapping[str, DataFrame], table: str, ids: DataFrame) -> ChangeResult:
    """Hide the rows of ``table`` named in ``ids``; unknown ids are refused."""
    stored = t[table]
    named = ids.select(F.col("id").alias("_del")).distinct()
    df = stored.join(named, F.col("id") == F.col("_del"), "left")
    new = df.withColumn("hidden", F.col("hidden") | F.col("_del").isNotNull()).select(*stored.columns)
    unknown = named.join(stored.select("id"), F.col("_del") == F.col("id"), "left_anti")
    rejected = unknown.select(F.col("_del").alias("id"), F.lit("unknown_id").alias("reason"))
    rows = stored.join(named, F.col("id") == F.col("_del"), "left_semi").filter(~F.col("hidden")).withColumn("hidden", F.lit(True))
    return ChangeResult(_as_tables(t).replaced(**{table: new}), rejected, delta={table: Delta(rows.select(*stored.columns))})


def _upsert(
    t: Mapping[str, DataFrame],
    table: str,
    changes: DataFrame,
    fields: Sequence[str],
    rules: dict[str, Column],
    insert_defaults: dict[str, Column] | None = None,
    unique: str | None = None,
) -> ChangeResult:
    """Insert changes without id, update the others' ``fields`` where a value differs.

    Every accepted change sets all ``fields``, so the last accepted one to a row decides. A value of the
    column ``unique`` is refused where another row has it at that point of the batch (see ``ownership``).
    """
    stored = t[table]
    known = stored.select(F.col("id").alias("_known"))
    df = changes.join(known, F.col("id") == F.col("_known"), "left")
    reason = _first_reason({**rules, "unknown_id": F.col("id").isNotNull() & F.col("_known").isNull()})
    df = df.withColumn("reason", reason)
    if unique:
        df = _refuse_taken(df, stored, unique)
    df = cut(df)
    good, bad = df.filter(F.col("reason").isNull()).drop("reason"), df.filter(F.col("reason").isNotNull())
    types = TABLES[table]

    last, superseded = _last_of_each(good)
    updates = last.select(
        F.col("id").alias("_uid"), *[F.col(f).cast(types[f]).alias(f"_u_{f}") for f in fields]
    )
    joined = stored.join(updates, F.col("id") == F.col("_uid"), "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_u_{f}"))
    changed = F.col("_uid").isNotNull() & differs
    kept = joined.select(
        *[(F.when(changed, F.col(f"_u_{f}")).otherwise(F.col(f)) if f in fields else F.col(f)).alias(f)
          for f in stored.columns]
    )

    inserts = good.filter(F.col("id").isNull()).drop("id")
    inserts = _assign_ids(inserts, stored, [F.col("seq")])
    for name, value in (insert_defaults or {}).items():
        inserts = inserts.withColumn(name, value)
    inserted = conform(inserts, table)
    rows = stored.join(updates, F.col("id") == F.col("_uid")).filter(differs).select(
        *[F.col(f"_u_{f}").alias(f) if f in fields else F.col(f) for f in stored.columns]
    )
    return ChangeResult(
        _as_tables(t).replaced(**{table: kept.unionByName(inserted)}),
        bad.select("seq", "id", "reason"),
        added=inserts.select("seq", "id"),
        superseded=superseded,
        delta={table: Delta(conform(rows, table).unionByName(inserted))},
    )


def _refuse_taken(df: DataFrame, stored: DataFrame, column: str) -> DataFrame:
    """Set the reason ``duplicate_<column>`` where another row has the value just then.

    A row gives its value up with its next accepted change. An empty value is nobody's.
    """
    df = cut(df)
    row = F.coalesce("id", -F.col("seq") - 1)  # a new row has no id yet
    filled = F.nullif(F.col(column), F.lit(""))
    claims = df.filter(F.col("reason").isNull()).select("seq", row.alias("row"), F.coalesce(filled, F.concat(F.lit("\0"), row.cast("string"))).alias("value"))
    held = stored.filter(filled.isNotNull()).select(F.col("id").alias("row"), F.col(column).alias("value"))
    df = df.join(grant_in_order(claims, held), "seq", "left")
    taken = F.when(~F.coalesce("granted", F.lit(True)), F.lit(f"duplicate_{column}"))
    return df.withColumn("reason", F.coalesce("reason", taken)).drop("granted")


def upsert_headers(
    t: Mapping[str, DataFrame],
    table: str,
    changes: DataFrame,
    *,
    returned: bool = False,
    head_office: str = K.HEAD_OFFICE,
) -> ChangeResult:
    """Insert or edit receipt (``instream``) or issue (``outstream``) headers.

    ``returned`` says whether new ``outstream`` headers are returns. Codes are unique.
    """
    kind = "in" if table == "instream" else "out"
    party = "supplier" if kind == "in" else "shop_id"
    fields = ["code", party, "date", "keeper_id", "staff1_id", "hidden", "note"]
    df, rules = quality.linked_header_rules(changes, kind, t["staff"], t["shop"], head_office)
    new = {"hidden": F.lit(False)} | ({"returned": F.lit(returned)} if kind == "out" else {})
    return _upsert(t, table, df, fields, rules, insert_defaults=new, unique="code")


def add_bound_issues(
    t: Mapping[str, DataFrame], changes: DataFrame, *, returned: bool = False, head_office: str = K.HEAD_OFFICE
) -> ChangeResult:
    """Add issue headers, each with a copy of the lines of the receipt named by ``inid_id``, if any.

    A header whose receipt is not a visible one is refused as ``unknown_receipt``.
    """
    receipts = t["instream"].filter(visible()).select(F.col("id").alias("_receipt"))
    df = changes.withColumn("id", F.lit(None).cast("bigint")).join(receipts, F.col("inid_id") == F.col("_receipt"), "left")
    lost = F.col("inid_id").isNotNull() & F.col("_receipt").isNull()
    df = cut(df.withColumn("_lost", lost))
    heads = upsert_headers(t, "outstream", df.filter(~F.col("_lost")).drop("_lost", "_receipt"), returned=returned, head_office=head_office)
    added = cut(heads.added)
    bound = added.join(df.filter(F.col("inid_id").isNotNull()).select("seq", "inid_id"), "seq")
    lines = copy_receipt_to_issue(heads.tables, bound.select(F.col("id").alias("outid_id"), "inid_id"))
    refused = df.filter("_lost").select("seq", "id", F.lit("unknown_receipt").alias("reason"))
    return ChangeResult(lines.tables, heads.rejected.unionByName(refused), added=added, delta={**heads.delta, **lines.delta})


def upsert_customers(t: Mapping[str, DataFrame], changes: DataFrame) -> ChangeResult:
    """Insert or fully update customers; ``shop_id`` is the operator's shop."""
    fields = ["name", "code", "telephone", "shop_id", "joindate", "address", "note"]
    return _upsert(
        t, "customer", changes, fields, quality.customer_rules(), insert_defaults={"hidden": F.lit(False)}
    )


def upsert_products(t: Mapping[str, DataFrame], changes: DataFrame) -> ChangeResult:
    """Insert or update products; their category must be one that the product form offers."""
    fields = ["name", "barcode", "category_id", "size", "hidden", "note"]
    known = product_form_categories(t).select(F.col("id").alias("_cat"))
    df = changes.join(known, F.col("category_id") == F.col("_cat"), "left")
    rules = {**quality.product_rules(), "category": F.col("_cat").isNull()}
    return _upsert(t, "products", df, fields, rules, insert_defaults={"hidden": F.lit(False)})


def upsert_remits(t: Mapping[str, DataFrame], changes: DataFrame) -> ChangeResult:
    fields = ["supplier", "amount", "staff_id", "date", "hidden", "note"]
    levels = t["staff"].select(F.col("id").alias("_sid"), F.col("level").alias("_level"))
    df = changes.join(levels, F.col("staff_id") == F.col("_sid"), "left")
    rules = {**quality.remit_rules(), "staff": F.coalesce(F.col("_level") >= K.LEVEL_LEFT, F.lit(True))}
    return _upsert(t, "remit", df, fields, rules, insert_defaults={"hidden": F.lit(False)})


# -- edits that start from one another -------------------------------------------------


def _mark_successive(df: DataFrame, product: str) -> tuple[DataFrame, bool]:
    """Flag the edits of products of which some line is edited more than once, and say if there are any; kept, as it is used often."""
    ok = F.col("static").isNull()
    df = cut(df.withColumn("_twice", ok & (F.count(F.when(ok, 1)).over(Window.partitionBy("id", product)) > 1)))
    again = cut(df.filter("_twice").select(F.col(product).alias("_again")).distinct())
    df = df.drop("_twice")
    if again.isEmpty():
        return df.withColumn("successive", F.lit(False)), False
    df = df.join(again, F.col(product) == F.col("_again"), "left")
    return cut(df.withColumn("successive", F.col("_again").isNotNull()).drop("_again")), True


def _replayed(
    edits: DataFrame, stocks: DataFrame, document: str, old_value: str | None, value: str | None, issues: bool
) -> DataFrame:
    """Verdicts of successive edits; ``stocks``: product_id, depot_id, capacity, and outid_id for filled places."""
    text = lambda c: (F.lit(None) if c is None else F.col(c)).cast("string")
    rows = edits.select(
        "product_id", "seq", F.col("id").alias("line_id"), F.col(document).alias("place_id"), "depot_id",
        F.col("new_qty").alias("quantity"), "old_depot", F.col("old_qty").alias("old_quantity"),
        text(old_value).alias("old_value"), text(value).alias("value"), "counts",
    )
    place = F.col("outid_id") if "outid_id" in stocks.columns else F.lit(None)
    start = stocks.select(
        "product_id", "depot_id", F.col("capacity").cast("bigint").alias("quantity"), place.cast("bigint").alias("place_id")
    )
    return replay_edits(rows.unionByName(start, allowMissingColumns=True).select(*COLUMNS), issues)


def _with_verdicts(df: DataFrame, verdict: DataFrame, replayed: DataFrame | None) -> DataFrame:
    """Edits with ``accepted`` and ``short``, and the line as it stood just before each. The verdicts are kept."""
    if replayed is None:
        return df.join(cut(verdict.select("seq", "accepted", "short")), "seq", "left")
    same = [F.lit(None).cast(k).alias(n) for n, k in (("was_quantity", "bigint"), ("was_depot", "bigint"), ("was_value", "string"))]
    both = verdict.select("seq", "accepted", "short", *same).unionByName(replayed)
    df = df.join(cut(both), "seq", "left")
    df = df.withColumn("old_qty", F.coalesce("was_quantity", "old_qty")).withColumn("old_depot", F.coalesce("was_depot", "old_depot"))
    if "old_value" in df.columns:
        df = df.withColumn("old_value", F.coalesce(F.col("was_value").cast("decimal(8,2)"), "old_value"))
    return df.drop("was_quantity", "was_depot", "was_value")


# -- receipts --------------------------------------------------------------------------


def add_receipt_lines(t: Mapping[str, DataFrame], changes: DataFrame) -> ChangeResult:
    """Insert receipt lines given as text (value, quantity, note)."""
    df = changes
    for fk, table in (("inid_id", "instream"), ("product_id", "products"), ("depot_id", "depot")):
        known = t[table].select(F.col("id").alias(f"_{fk}"))
        df = df.join(known, F.col(fk) == F.col(f"_{fk}"), "left")
    rules = {
        **quality.receipt_line_rules(),
        "unknown_header": F.col("_inid_id").isNull(),
        "unknown_product": F.col("_product_id").isNull(),
        "unknown_depot": F.col("_depot_id").isNull(),
    }
    good, bad = _split(df, _first_reason(rules))
    good = good.withColumn("quantity", F.col("quantity").try_cast("bigint"))
    rows = _assign_ids(good, t["indetail"], [F.col("seq")])
    lines = conform(rows, "indetail")
    return ChangeResult(
        _as_tables(t).replaced(indetail=t["indetail"].unionByName(lines)), bad.select("seq", "reason"),
        added=rows.select("seq", "id"), delta={"indetail": Delta(lines)},
    )


def _receipt_line_state(t: Mapping[str, DataFrame], changes: DataFrame) -> DataFrame:
    """The receipt lines that a batch names with the visibility of their header."""
    heads = t["instream"].select(F.col("id").alias("inid_id"), visible().alias("counts"))
    return _named(t["indetail"], changes).select(
        F.col("id").alias("line_id"), "inid_id", "product_id", "depot_id",
        F.col("quantity").cast("bigint").alias("old_qty"), F.col("value").alias("old_value"),
    ).join(heads, "inid_id")


def delete_receipt_lines(
    t: Mapping[str, DataFrame], changes: DataFrame, *, as_of: date, operator: str = ""
) -> ChangeResult:
    """Delete receipt lines while received stays strictly above issued; changes: (seq, id).

    Stock only falls in such a batch, so a further request for a line meets a line that is gone, or
    fails for stock again.
    """
    lines = _receipt_line_state(t, changes)
    df = _repeated(changes.select("seq", "id"), "id").join(
        lines, F.col("id") == F.col("line_id"), "left"
    )
    df = cut(df)
    eligible = F.col("line_id").isNotNull() & ~F.col("repeated")
    claims = df.filter(F.col("line_id").isNotNull()).select(
        "seq", "product_id", F.col("old_qty").alias("need"),
        F.when(F.col("counts"), F.col("old_qty")).otherwise(_zero()).alias("delta"),
        eligible.alias("eligible"),
    )
    asked = claims.select(F.col("product_id").alias("id"))
    capacity = product_summary(t, asked).select(
        "product_id", (F.col("in_qty") - F.col("out_qty") - 1).alias("capacity")
    )
    verdict = admit_in_order(claims, ["product_id"], capacity, ["product_id"]).select("seq", "accepted")
    df = cut(df.join(verdict, "seq", "left"))
    went = df.filter("accepted").select(F.col("id").alias("_went"))
    df = df.join(went, F.col("id") == F.col("_went"), "left")
    reason = _first_reason(
        {
            "unknown_id": F.col("line_id").isNull() | (F.col("repeated") & F.col("_went").isNotNull()),
            "stock_issued": ~F.coalesce("accepted", F.lit(False)),
        }
    )
    good, bad = _split(df, reason)
    gone = good.select(F.col("id").alias("_gone"))
    new = t["indetail"].join(gone, F.col("id") == F.col("_gone"), "left_anti")
    named = fk_lookup(fk_lookup(good, "product_id", t["products"], pname="name"), "depot_id", t["depot"], dname="name")
    audit = named.select(
        F.col("inid_id").alias("header_id"), "seq",
        _entry(
            K.AUDIT_DELETE_RECEIPT, as_of, operator, F.col("pname"), _s("old_qty"), _s("old_value"), F.col("dname")
        ).alias("entry"),
    )
    tables = _as_tables(t).replaced(indetail=new)
    delta = {"indetail": Delta(deleted=gone.select(F.col("_gone").alias("id")))}
    return ChangeResult(tables, bad.select("seq", "id", "reason"), audit, delta=delta)


def edit_receipt_lines(
    t: Mapping[str, DataFrame], changes: DataFrame, *, as_of: date, operator: str = ""
) -> ChangeResult:
    """Change value, quantity, depot and place of receipt lines.

    changes: seq, id, value and quantity as text, depot_id, depotdetail. A decrease may
    exceed neither the product's stock nor its stock in the depot named. An accepted edit
    is audited even if nothing differs.
    """
    lines = _receipt_line_state(t, changes).withColumnRenamed("depot_id", "old_depot")
    known = t["depot"].select(F.col("id").alias("_depot"), F.col("name").alias("dname"))
    df = (
        changes.select("seq", "id", "value", "quantity", "depot_id", "depotdetail")
        .join(lines, F.col("id") == F.col("line_id"), "left")
        .join(known, F.col("depot_id") == F.col("_depot"), "left")
    )
    rules = quality.receipt_line_rules()
    static = _first_reason(
        {
            "unknown_id": F.col("line_id").isNull(),
            "unknown_depot": F.col("_depot").isNull(),
            "value": rules["value"],
            "quantity": rules["quantity"],
        }
    )
    df, successive = _mark_successive(df.withColumn("static", static).drop("line_id", "_depot"), "product_id")
    df = df.withColumn("new_qty", F.col("quantity").try_cast("bigint")).withColumn(
        "new_value", F.col("value").try_cast("decimal(8,2)")
    )

    ok = df.filter(F.col("static").isNull() & ~F.col("successive"))
    less, counts, none = F.col("old_qty") - F.col("new_qty"), F.col("counts"), F.lit(None).cast("bigint")
    moved = F.col("old_depot") != F.col("depot_id")
    per_product = ok.select(
        "seq", "product_id", F.lit(-1).cast("bigint").alias("depot_id"), less.alias("need"),
        F.when(counts, less).otherwise(_zero()).alias("delta"),
    )
    per_target = ok.select(
        "seq", "product_id", "depot_id", less.alias("need"),
        F.when(~counts, _zero()).when(moved, -F.col("new_qty")).otherwise(less).alias("delta"),
    )
    per_source = ok.filter(moved & counts).select(
        "seq", "product_id", F.col("old_depot").alias("depot_id"), none.alias("need"), F.col("old_qty").alias("delta")
    )
    claims = per_product.unionByName(per_target).unionByName(per_source).withColumn("eligible", F.lit(True))
    q = F.col("quantity").cast("bigint")
    about = stock.about_products(t, df.filter(F.col("static").isNull()))
    receipts = stock.visible_receipts(about).select("product_id", "depot_id", q.alias("q"))
    issues = stock.visible_issues(about).select("product_id", "depot_id", (-q).alias("q"))
    by_depot = cut(receipts.unionByName(issues).groupBy("product_id", "depot_id").agg(F.sum("q").alias("capacity")))
    by_product = by_depot.groupBy("product_id").agg(F.sum("capacity").alias("capacity")).select(
        "product_id", F.lit(-1).cast("bigint").alias("depot_id"), "capacity"
    )
    judged = admit_in_order(
        claims, ["product_id", "depot_id"], by_depot.unionByName(by_product), ["product_id"]
    )
    # a verdict is about the whole edit, and each edit claims its product's stock
    verdict = judged.filter(F.col("depot_id") == -1).groupBy("seq").agg(
        F.min("accepted").alias("accepted"), F.max("short").alias("short")
    )
    replayed = None
    if successive:
        edits = df.filter(F.col("static").isNull() & F.col("successive"))
        stocks = by_depot.join(edits.select("product_id").distinct(), "product_id", "left_semi")
        replayed = _replayed(edits, stocks, "inid_id", "old_value", "new_value", issues=False)
    df = _with_verdicts(df, verdict, replayed)
    reason = F.coalesce(
        F.col("static"),
        F.when(F.col("accepted"), None).when(F.col("short"), "below_issued").otherwise("below_issued_in_depot"),
    )
    good, bad = _split(df, reason)
    old = fk_lookup(fk_lookup(good, "product_id", t["products"], pname="name"), "old_depot", t["depot"], oname="name")
    audit = old.select(
        F.col("inid_id").alias("header_id"), "seq",
        _entry(
            K.AUDIT_EDIT_RECEIPT, as_of, operator, F.col("pname"), _s("old_qty"), _s("old_value"), F.col("oname"),
            _s("quantity"), _s("value"), F.col("dname"),
        ).alias("entry"),
    )
    last, superseded = _last_of_each(good)
    edits = last.select(
        F.col("id").alias("_eid"), F.col("new_qty").cast("int").alias("_q"), F.col("new_value").alias("_v"),
        F.col("depot_id").alias("_d"), F.col("depotdetail").alias("_p"),
    )
    hit = F.col("_eid").isNotNull()
    columns = [
        "id", "inid_id", "product_id",
        F.when(hit, F.col("_v")).otherwise(F.col("value")).alias("value"),
        F.when(hit, F.col("_q")).otherwise(F.col("quantity")).alias("quantity"),
        F.when(hit, F.col("_d")).otherwise(F.col("depot_id")).alias("depot_id"),
        F.when(hit, F.col("_p")).otherwise(F.col("depotdetail")).alias("depotdetail"),
    ]
    new, rows = (t["indetail"].join(edits, F.col("id") == F.col("_eid"), how).select(*columns) for how in ("left", "inner"))
    tables = _as_tables(t).replaced(indetail=new)
    delta = {"indetail": Delta(rows)}
    return ChangeResult(tables, bad.select("seq", "id", "reason"), audit, superseded=superseded, delta=delta)


# -- issues and returns ----------------------------------------------------------------


def copy_receipt_to_issue(t: Mapping[str, DataFrame], bindings: DataFrame) -> ChangeResult:
    """Copy the lines of a visible receipt into a stored issue; bindings: (outid_id, inid_id)."""
    heads = t["instream"].filter(visible()).select(F.col("id").alias("_in"))
    issues = t["outstream"].select(F.col("id").alias("_out"))
    df = bindings.join(heads, F.col("inid_id") == F.col("_in"), "left").join(
        issues, F.col("outid_id") == F.col("_out"), "left"
    )
    good, bad = _split(
        df, _first_reason({"unknown_issue": F.col("_out").isNull(), "unknown_receipt": F.col("_in").isNull()})
    )
    rows = t["indetail"].select(F.col("id").alias("_src"), "inid_id", "product_id", "quantity", "depot_id")
    rows = rows.join(good.select("outid_id", "inid_id"), "inid_id")
    rows = _assign_ids(rows, t["outdetail"], [F.col("outid_id"), F.col("_src")])
    lines = conform(rows, "outdetail")
    return ChangeResult(
        _as_tables(t).replaced(outdetail=t["outdetail"].unionByName(lines)), bad.select("outid_id", "inid_id", "reason"),
        added=lines, delta={"outdetail": Delta(lines)},
    )


def add_issue_lines(t: Mapping[str, DataFrame], changes: DataFrame, *, returned: bool = False) -> ChangeResult:
    """Insert issue lines (seq, outid_id, product_id, depot_id, quantity as text).

    A return stores the negated quantity. Stock is not checked. ``added`` shows the
    shop's stock of the product right after each line.
    """
    heads = t["outstream"].select(F.col("id").alias("_out"), "shop_id", visible().alias("counts"))
    df = changes.join(heads, F.col("outid_id") == F.col("_out"), "left")
    for fk, table in (("product_id", "products"), ("depot_id", "depot")):
        known = t[table].select(F.col("id").alias(f"_{fk}"))
        df = df.join(known, F.col(fk) == F.col(f"_{fk}"), "left")
    rules = {
        **quality.issue_line_rules(),
        "unknown_header": F.col("_out").isNull(),
        "unknown_product": F.col("_product_id").isNull(),
        "unknown_depot": F.col("_depot_id").isNull(),
    }
    good, bad = _split(df, _first_reason(rules))
    number = F.col("quantity").try_cast("bigint")
    rows = good.withColumn("quantity", -number if returned else number)
    rows = _assign_ids(rows, t["outdetail"], [F.col("seq")])
    new = t["outdetail"].unionByName(conform(rows, "outdetail"))

    # Stock after each line = stock before the batch + visible lines added so far.
    moved = F.when(F.col("counts"), F.col("quantity")).otherwise(_zero())
    after = running_total(
        rows.select("seq", "id", "shop_id", "product_id", "quantity", "counts"),
        ["shop_id", "product_id"], [id_block("seq")], [F.col("seq")],
        {"_so_far": moved, "_lines": F.col("counts").cast("bigint")},
    ).join(stock.shop_product_stock(t, rows), ["shop_id", "product_id"], "left")
    # Until the shop has an issue line of the product its stock shows as 0; sales made
    # earlier count from the first one on.
    sold = (
        stock.visible_sales(stock.about_products(t, rows), shop_id="shop_id")
        .groupBy("shop_id", "product_id")
        .agg(F.sum(F.col("quantity").cast("bigint")).alias("_sold"))
    )
    after = after.join(sold, ["shop_id", "product_id"], "left")
    before = F.coalesce(F.col("stock"), -F.col("_sold"), _zero())
    shown = F.when(F.col("stock").isNull() & (F.col("_lines") == 0), _zero()).otherwise(before + F.col("_so_far"))
    added = after.select("seq", "id", shown.alias("shop_stock"))
    delta = {"outdetail": Delta(conform(rows, "outdetail"))}
    return ChangeResult(_as_tables(t).replaced(outdetail=new), bad.select("seq", "reason"), added=added, delta=delta)


def _issue_line_state(t: Mapping[str, DataFrame], changes: DataFrame) -> DataFrame:
    """The issue lines that a batch names with the visibility of their header."""
    heads = t["outstream"].select(F.col("id").alias("outid_id"), visible().alias("counts"))
    return _named(t["outdetail"], changes).select(
        F.col("id").alias("line_id"), "outid_id", F.col("product_id").alias("old_product"),
        F.col("depot_id").alias("old_depot"), F.col("quantity").cast("bigint").alias("old_qty"),
    ).join(heads, "outid_id")


def _replayed_issues(t: Mapping[str, DataFrame], df: DataFrame, depots: DataFrame) -> DataFrame:
    """Verdicts of the successive edits among ``df``; ``depots``: the stock of (depot_id, old_product)."""
    edits = df.filter(F.col("static").isNull() & F.col("successive")).withColumnRenamed("old_product", "product_id")
    touched = edits.select("product_id").distinct()
    held = (
        t["outdetail"].filter(F.col("quantity") > 0)
        .join(touched, "product_id", "left_semi")
        .join(edits.select("outid_id").distinct(), "outid_id", "left_semi")
        .groupBy("product_id", "outid_id", "depot_id").agg(F.count("*").alias("capacity"))
    )
    stocks = depots.withColumnRenamed("old_product", "product_id").join(touched, "product_id", "left_semi")
    stocks = stocks.unionByName(held, allowMissingColumns=True)
    return _replayed(edits, stocks, "outid_id", None, None, issues=True)


def edit_issue_lines(
    t: Mapping[str, DataFrame], changes: DataFrame, *, as_of: date, operator: str = "", returned: bool = False
) -> ChangeResult:
    """Change quantity and depot of issue lines (seq, id, depot_id, quantity as text).

    The new quantity may not exceed the depot's stock plus the old quantity, and the
    issue may not already hold the product from that depot. Both checks see all earlier
    accepted changes. An accepted edit of an issue is audited even if nothing differs, of
    a return only if something does.
    """
    lines = _issue_line_state(t, changes)
    known = t["depot"].select(F.col("id").alias("_depot"), F.col("name").alias("dname"))
    df = (
        changes.select("seq", "id", "depot_id", "quantity")
        .join(lines, F.col("id") == F.col("line_id"), "left")
        .join(known, F.col("depot_id") == F.col("_depot"), "left")
    )
    static = _first_reason(
        {
            "unknown_id": F.col("line_id").isNull(),
            "unknown_depot": F.col("_depot").isNull(),
            "quantity": quality.bad_quantity("quantity"),
        }
    )
    number = F.col("quantity").try_cast("bigint")
    df, successive = _mark_successive(df.withColumn("static", static).drop("line_id", "_depot"), "old_product")
    df = df.withColumn("new_qty", -number if returned else number)

    ok = df.filter(F.col("static").isNull() & ~F.col("successive"))
    moved = F.col("old_depot") != F.col("depot_id")
    none = F.lit(None).cast("bigint")
    one = lambda test: F.when(test, 1).otherwise(0).cast("bigint")

    # Stock of (depot, product). Without a visible receipt there the stock reads 0
    # whatever was issued, so such places take no deltas.
    asked = df.filter(F.col("static").isNull()).select(F.col("old_product").alias("product_id"))
    depots = cut(stock.depot_product_stock(t, asked).select(
        "depot_id", F.col("product_id").alias("old_product"), F.col("stock").alias("capacity")
    ))
    header0 = F.lit(-1).cast("bigint")
    shift = F.when(moved, F.col("new_qty")).otherwise(F.col("new_qty") - F.col("old_qty"))
    take = ok.select(
        "seq", header0.alias("outid_id"), "old_product", "depot_id",
        (F.col("new_qty") - F.col("old_qty")).alias("need"),
        F.when(F.col("counts"), shift).otherwise(_zero()).alias("delta"),
    )
    give = ok.filter(moved & F.col("counts")).select(
        "seq", header0.alias("outid_id"), "old_product", F.col("old_depot").alias("depot_id"),
        none.alias("need"), (-F.col("old_qty")).alias("delta"),
    )
    quantities = take.unionByName(give).withColumn("only_listed", F.lit(True))

    # A place (issue, product, depot) has room for one line with a positive quantity. The operator reads a missing
    # capacity as 0, so lines there count from 0 down and entering needs one less; a line without a product has no room.
    spare = F.when(F.col("old_product").isNotNull(), 1).otherwise(0)
    was, will = one(F.col("old_qty") > 0), one(F.col("new_qty") > 0)
    enter = ok.select(
        "seq", "outid_id", "old_product", "depot_id",
        (1 - spare - F.when(moved, _zero()).otherwise(was)).cast("bigint").alias("need"),
        (will - F.when(moved, _zero()).otherwise(was)).alias("delta"),
    )
    leave = ok.filter(moved).select(
        "seq", "outid_id", "old_product", F.col("old_depot").alias("depot_id"), none.alias("need"), (-was).alias("delta")
    )
    room = (
        t["outdetail"].filter(F.col("quantity") > 0)
        .join(ok.select("outid_id").distinct(), "outid_id", "left_semi")
        .groupBy("outid_id", F.col("product_id").alias("old_product"), "depot_id")
        .agg((-F.count("*")).alias("capacity"))
    )
    places = enter.unionByName(leave).withColumn("only_listed", F.lit(False))
    claims = quantities.unionByName(places).withColumn("eligible", F.lit(True))
    capacity = depots.withColumn("outid_id", header0).unionByName(room)
    judged = admit_in_order(claims, ["outid_id", "old_product", "depot_id"], capacity, ["old_product"])
    # a verdict is about the whole edit, and each edit claims stock of a depot
    verdict = judged.filter(F.col("outid_id") == -1).groupBy("seq").agg(
        F.min("accepted").alias("accepted"), F.max("short").alias("short")
    )
    replayed = _replayed_issues(t, df, depots) if successive else None
    df = _with_verdicts(df, verdict, replayed)
    reason = F.coalesce(
        F.col("static"),
        F.when(F.col("accepted"), None).when(F.col("short"), "over_depot_stock").otherwise("already_in_issue"),
    )
    good, bad = _split(df, reason)

    moved = F.col("old_depot") != F.col("depot_id")
    logged = good if not returned else good.filter(moved | (F.col("old_qty") != F.col("new_qty")))
    old = fk_lookup(fk_lookup(logged, "old_product", t["products"], pname="name"), "old_depot", t["depot"], oname="name")
    audit = old.select(
        F.col("outid_id").alias("header_id"), "seq",
        _entry(
            K.AUDIT_EDIT_ISSUE, as_of, operator, F.col("pname"), _s("old_qty"), F.col("oname"), _s("new_qty"), F.col("dname")
        ).alias("entry"),
    )
    last, superseded = _last_of_each(good)
    edits = last.select(
        F.col("id").alias("_eid"), F.col("new_qty").cast("int").alias("_q"), F.col("depot_id").alias("_d")
    )
    columns = [
        "id", "outid_id", "product_id",
        F.coalesce("_q", "quantity").alias("quantity"), F.coalesce("_d", "depot_id").alias("depot_id"),
    ]
    new, rows = (t["outdetail"].join(edits, F.col("id") == F.col("_eid"), how).select(*columns) for how in ("left", "inner"))
    tables = _as_tables(t).replaced(outdetail=new)
    delta = {"outdetail": Delta(rows)}
    return ChangeResult(tables, bad.select("seq", "id", "reason"), audit, superseded=superseded, delta=delta)


def delete_issue_lines(
    t: Mapping[str, DataFrame], changes: DataFrame, *, as_of: date, operator: str = ""
) -> ChangeResult:
    """Set the quantity of issue lines to 0; changes: (seq, id). A further request finds 0 there."""
    lines = _issue_line_state(t, changes)
    df = _repeated(changes.select("seq", "id"), "id").join(lines, F.col("id") == F.col("line_id"), "left")
    df = df.withColumn("old_qty", F.when(F.col("repeated"), _zero()).otherwise(F.col("old_qty")))
    good, bad = _split(cut(df), _first_reason({"unknown_id": F.col("line_id").isNull()}))
    named = fk_lookup(
        fk_lookup(good, "old_product", t["products"], pname="name"), "old_depot", t["depot"], dname="name"
    )
    audit = named.select(
        F.col("outid_id").alias("header_id"), "seq",
        _entry(
            K.AUDIT_DELETE_ISSUE, as_of, operator, F.col("pname"), _s("old_qty"), F.col("dname")
        ).alias("entry"),
    )
    gone = good.select(F.col("id").alias("_gone")).distinct()
    joined = t["outdetail"].join(gone, F.col("id") == F.col("_gone"), "left")
    new = joined.select(
        "id", "outid_id", "product_id",
        F.when(F.col("_gone").isNotNull(), F.lit(0)).otherwise(F.col("quantity")).alias("quantity"), "depot_id",
    )
    rows = t["outdetail"].join(gone, F.col("id") == F.col("_gone"), "left_semi").withColumn("quantity", F.lit(0))
    tables = _as_tables(t).replaced(outdetail=new)
    return ChangeResult(tables, bad.select("seq", "id", "reason"), audit, delta={"outdetail": Delta(rows)})


# -- orders ----------------------------------------------------------------------------


def _discount(text: Column) -> Column:
    """Submitted discount; none means 0."""
    return F.coalesce(F.nullif(squash(text), F.lit("")), F.lit("0")).try_cast("decimal(8,2)")


def _line_rules() -> dict[str, Column]:
    return {"line_id": quality.bad_id("line_id"), **quality.order_line_rules()}


def _doc_lines(t: Mapping[str, DataFrame], orders: DataFrame, *carry: str) -> DataFrame:
    """Document lines with their rule checks; ``line_error`` is the first broken one."""
    known = t["products"].select(F.col("id").alias("product_id"))
    lines = order_doc_lines(orders, "seq", *carry)
    lines = lines.withColumn("_pid", F.col("product").try_cast("bigint")).join(
        known, F.col("_pid") == F.col("product_id"), "left"
    )
    rules = {**_line_rules(), "unknown_product": F.col("product_id").isNull()}
    return lines.withColumn("line_error", _first_reason(rules)).drop("_pid")


def apply_new_orders(t: Mapping[str, DataFrame], docs: DataFrame) -> ChangeResult:
    """Book new orders against shop stock, first come first served.

    ``docs``: seq, shop_id, staff_id, moment and the fields of ``documents.parse_orders``.
    An order is booked whole or not at all: every line must be valid and in stock after
    the booked orders before it and its own earlier lines. Since quantities are positive,
    that is the same as the order's total per product being in stock, so the admission
    works on those totals.
    """
    customers = t["customer"].select(F.col("id").alias("customer_id"))
    heads = docs.withColumn("_cid", F.col("customer").try_cast("bigint")).join(
        customers, F.col("_cid") == F.col("customer_id"), "left"
    )
    header_error = _first_reason(
        {
            **quality.order_rules(),
            "unknown_customer": (F.col("customer") != "") & F.col("customer_id").isNull(),
        }
    )
    heads = cut(heads.withColumn("header_error", header_error).drop("_cid"))
    lines = cut(_doc_lines(t, heads, "shop_id", "header_error"))

    # Lines after an order's first invalid one are never looked at.
    bad = lines.filter(F.col("line_error").isNotNull()).groupBy("seq").agg(
        F.min("line_no").alias("bad_line"), F.min_by("line_error", "line_no").alias("bad_error")
    )
    lines = lines.join(bad, "seq", "left")
    tried = lines.filter(
        F.col("header_error").isNull() & (F.col("bad_line").isNull() | (F.col("line_no") < F.col("bad_line")))
    ).withColumn("qty", F.col("quantity").try_cast("bigint"))
    claims = tried.groupBy("seq", "shop_id", "product_id").agg(
        F.sum("qty").alias("need"), F.sum("qty").alias("delta"), F.min(F.col("bad_line").isNull()).alias("eligible")
    )
    claims = cut(claims)
    capacity = stock.shop_product_stock(t, claims).withColumnRenamed("stock", "capacity")
    judged = cut(admit_in_order(claims, ["shop_id", "product_id"], capacity, ["shop_id"]))
    verdict = judged.groupBy("seq").agg(F.min("accepted").alias("accepted"))

    # Which line of a refused order ran out of stock first.
    refused = tried.join(judged.filter(~F.col("accepted")).select("seq", "product_id", "available"), ["seq", "product_id"])
    refused = running_total(
        refused, ["seq", "product_id"], [id_block("line_no")], [F.col("line_no")], {"_used": F.col("qty")}
    )
    short = refused.filter(F.col("_used") > F.col("available")).groupBy("seq").agg(F.min("line_no").alias("short_line"))

    orders = heads.join(verdict, "seq", "left").join(bad, "seq", "left").join(short, "seq", "left")
    reason = F.coalesce(
        F.col("header_error"),
        F.when(F.col("short_line").isNotNull(), "over_stock"),
        F.col("bad_error"),
    )
    orders = orders.withColumn("line_no", F.when(F.col("header_error").isNull(), F.coalesce("short_line", "bad_line")))
    good, rejected = _split(orders, reason)
    good = _assign_ids(good, t["sellorder"], [F.col("seq")])
    good = good.withColumn(
        "discount", _discount(F.col("discount"))
    ).withColumn("date", F.col("moment")).withColumn("hidden", F.lit(False))
    rows = tried.join(good.select("seq", F.col("id").alias("oid_id")), "seq")
    rows = _assign_ids(
        rows.select("oid_id", "seq", "line_no", "product_id", F.col("qty").alias("quantity"), "price"),
        t["sellorderdetail"],
        [F.col("seq"), F.col("line_no")],
    )
    heads, lines = conform(good, "sellorder"), conform(rows, "sellorderdetail")
    tables = _as_tables(t).replaced(
        sellorder=t["sellorder"].unionByName(heads), sellorderdetail=t["sellorderdetail"].unionByName(lines)
    )
    delta = {"sellorder": Delta(heads), "sellorderdetail": Delta(lines)}
    return ChangeResult(tables, rejected.select("seq", "reason", "line_no"), added=good.select("seq", "id"), delta=delta)


def apply_order_edits(t: Mapping[str, DataFrame], docs: DataFrame, *, as_of: date) -> ChangeResult:
    """Edit or hide stored orders; ``docs``: seq and the fields of ``documents.parse_orders``.

    A named line gets the new price and quantity, a line without id is added, a stored
    line the document does not name is dropped. An edited order becomes visible. Stock is
    not checked. Of several accepted documents of one order the last sets the header; a stored line
    stays only if each of them names it, and only the last one's added lines are left.
    """
    orders = t["sellorder"]
    known = orders.select(F.col("id").alias("order_id"))
    products = t["products"].select(F.col("id").alias("product_id"))
    heads = docs.withColumn("_oid", F.col("id").try_cast("bigint")).join(
        known, F.col("_oid") == F.col("order_id"), "left"
    )
    heads = cut(heads.drop("_oid"))
    hide = F.col("hidden") == "1"
    bad_id = ~F.col("id").rlike(K.RE_ID)
    field_error = _first_reason({n: r for n, r in quality.order_edit_rules(as_of).items() if n != "id"})
    # Only the lines that break a rule leave the look-up of products.
    checked = order_doc_lines(heads, "seq").select(
        "seq", "line_no", F.col("product").try_cast("bigint").alias("_pid"), _first_reason(_line_rules()).alias("line_error")
    )
    faulty = checked.join(products, (F.col("_pid") == F.col("product_id")) & F.col("line_error").isNull(), "left_anti")
    bad = faulty.withColumn("line_error", F.coalesce("line_error", F.lit("unknown_product"))).groupBy("seq").agg(
        F.min("line_no").alias("line_no"), F.min_by("line_error", "line_no").alias("bad_error")
    )
    reason = F.coalesce(
        F.when(bad_id, "id"),
        F.when(F.col("order_id").isNull(), "unknown_id"),
        F.when(~hide, F.coalesce(F.col("bad_error"), field_error)),
    )
    heads = heads.join(bad, "seq", "left").select(
        "seq", "id", "order_id", hide.alias("hide"), "code", "discount", "date", "note", "lines", "line_no", reason.alias("reason")
    )
    # documents travel whole to here, so their lines are only dealt out by what they are joined on
    edits = F.coalesce(F.col("reason").isNull() & ~F.col("hide"), F.lit(False))
    wanted = F.col("seq").isNotNull() & F.max(edits).over(Window.partitionBy("seq"))
    heads = cut(heads.withColumn("lines", F.when(wanted, F.col("lines"))))
    good, rejected = heads.filter(F.col("reason").isNull()).drop("reason", "lines"), heads.filter(F.col("reason").isNotNull())

    moment = parse_moment(F.col("date"))
    fields = F.struct(
        F.col("code").alias("_code"), _discount(F.col("discount")).alias("_discount"), F.col("note").alias("_note"),
    )
    shown = F.when(~F.col("hide"), F.col("seq"))
    named = good.groupBy(F.col("order_id").alias("_oid")).agg(
        F.max_by("hide", "seq").alias("_hide"), F.max_by(F.when(~F.col("hide"), fields), shown).alias("_set"),
        F.max(shown).alias("_last"),
        # a document without a date leaves the one before it
        F.max_by(moment, F.when(moment.isNotNull(), shown)).alias("_dated"),
    ).select("_oid", "_hide", "_last", "_dated", "_set.*")
    edited = F.col("_last").isNotNull()
    columns = [
        "id",
        F.when(edited, F.col("_code")).otherwise(F.col("code")).alias("code"),
        "customer_id", "shop_id", "staff_id",
        F.when(edited, F.col("_discount")).otherwise(F.col("discount")).alias("discount"),
        F.coalesce("_dated", "date").alias("date"),
        F.coalesce("_hide", "hidden").alias("hidden"),
        F.when(edited, F.col("_note")).otherwise(F.col("note")).alias("note"),
    ]
    new_orders, set_orders = (orders.join(named, F.col("id") == F.col("_oid"), how).select(*columns) for how in ("left", "inner"))

    open_orders = good.filter(~F.col("hide") & F.col("seq").isNotNull()).groupBy(F.col("order_id").alias("_edited")).agg(
        F.count("*").alias("_edits"), F.max("seq").alias("_last")
    )
    open_orders = cut(open_orders)
    wanted = order_doc_lines(heads, "seq", "order_id")
    # Any document may name a line and its last mention sets the values; but a line of an
    # edited order stays only when its own order's documents name it, each of them.
    mentions = wanted.filter(F.col("line_id") != "").select(
        F.col("line_id").try_cast("bigint").alias("_lid"), "order_id", "seq", "line_no",
        F.col("quantity").try_cast("int").alias("_q"), F.col("price").try_cast("decimal(8,2)").alias("_p"),
    )
    at = F.struct("seq", "line_no")
    updates = mentions.groupBy("_lid").agg(F.max_by("_q", at).alias("_q"), F.max_by("_p", at).alias("_p"))
    own = mentions.select("_lid", "order_id", "seq").distinct().groupBy(
        F.col("_lid").alias("_nid"), F.col("order_id").alias("_noid")
    ).agg(F.count("*").alias("_named"))
    # A range of one id, not an equation: the lines are joined by their own id and stay where they are.
    of_its_order = (F.col("id") == F.col("_nid")) & F.col("oid_id").between(F.col("_noid"), F.col("_noid"))
    stored = (
        t["sellorderdetail"]
        .join(updates, F.col("id") == F.col("_lid"), "left")
        .join(own, of_its_order, "left")
        .join(open_orders.drop("_last"), F.col("oid_id") == F.col("_edited"), "left")
    )
    dropped = F.col("_edited").isNotNull() & (F.coalesce("_named", F.lit(0)) < F.col("_edits"))
    columns = [
        "id", "oid_id", "product_id",
        F.coalesce("_q", "quantity").alias("quantity"), F.coalesce("_p", "price").alias("price"),
    ]
    kept, set_lines = stored.filter(~dropped).select(*columns), stored.filter(~dropped & F.col("_lid").isNotNull()).select(*columns)
    added = wanted.filter(F.col("line_id") == "").join(open_orders.select(F.col("_last").alias("seq")), "seq", "left_semi")
    rows = added.join(products, F.col("product").try_cast("bigint") == F.col("product_id")).select(
        F.col("order_id").alias("oid_id"), "seq", "line_no", "product_id", "quantity", "price"
    )
    rows = _assign_ids(rows, t["sellorderdetail"], [F.col("seq"), F.col("line_no")])
    lines = conform(rows, "sellorderdetail")
    tables = _as_tables(t).replaced(sellorder=new_orders, sellorderdetail=kept.unionByName(lines))
    delta = {
        "sellorder": Delta(set_orders), "sellorderdetail": Delta(set_lines.unionByName(lines), stored.filter(dropped).select("id"))
    }
    return ChangeResult(tables, rejected.select("seq", "id", "reason", "line_no"), delta=delta)


# -- categories ------------------------------------------------------------------------


def apply_category_tree(t: Mapping[str, DataFrame], nodes: DataFrame) -> ChangeResult:
    """Bring the stored categories in line with a submitted tree.

    ``nodes``: ordinal (list order), id, name, pId. Stored ids in the list are renamed
    and re-parented, if their parent is stored; stored ids not in the list are hidden
    together with their products; other nodes are added, in list order, once their parent
    is stored or was added before them. Only the first of equal new ids is added.
    """
    stored = t["category"]
    ids = stored.select(F.col("id").alias("_old"))
    nodes = cut(nodes.join(ids, F.col("id") == F.col("_old"), "left"))

    # The last mention of a stored id wins among those that can be applied.
    parents = stored.select(F.col("id").alias("_par"))
    updates = (
        nodes.filter(F.col("_old").isNotNull())
        .join(parents, F.col("pId") == F.col("_par"), "left")
        .filter(F.col("pId").isNull() | F.col("_par").isNotNull())
        .groupBy("_old")
        .agg(F.max_by(F.struct("name", "pId"), "ordinal").alias("_u"))
    )
    listed = nodes.filter(F.col("_old").isNotNull()).select(F.col("_old").alias("_listed")).distinct()
    joined = stored.join(updates, F.col("id") == F.col("_old"), "left").join(
        listed, F.col("id") == F.col("_listed"), "left"
    )
    hit, gone = F.col("_u").isNotNull(), F.col("_listed").isNull()
    kept = joined.select(
        "id",
        F.when(hit, F.col("_u.name")).otherwise(F.col("name")).alias("name"),
        F.when(hit, F.col("_u.pId")).otherwise(F.col("pid_id")).alias("pid_id"),
        (F.col("hidden") | gone).alias("hidden"),
    )
    hidden_ids = ids_gone(stored, listed)
    products = t["products"].join(hidden_ids, F.col("category_id") == F.col("_gone"), "left")
    products = products.withColumn("hidden", F.col("hidden") | F.col("_gone").isNotNull()).select(
        *t["products"].columns
    )

    # New nodes, level by level below what is stored: one join per level of depth.
    fresh = nodes.filter(F.col("_old").isNull() & F.col("id").isNotNull())
    fresh = fresh.groupBy("id").agg(F.min_by(F.struct("ordinal", "name", "pId"), "ordinal").alias("n")).select(
        "id", "n.ordinal", "n.name", "n.pId"
    )
    rooted = fresh.join(parents, F.col("pId") == F.col("_par"), "left_semi")
    level = cut(rooted.withColumn("under_new", F.lit(False)))
    added = level
    while not level.isEmpty():
        above = level.select(F.col("id").alias("_pid"), F.col("ordinal").alias("_pord"))
        below = fresh.join(above, F.col("pId") == F.col("_pid")).filter(F.col("ordinal") > F.col("_pord"))
        level = cut(below.select(*fresh.columns, F.lit(True).alias("under_new")))
        added = added.unionByName(level)
    added = _assign_ids(added.withColumnRenamed("id", "temp_id"), stored, [F.col("ordinal")])
    real = added.filter(F.lit(True)).select(F.col("temp_id").alias("_temp"), F.col("id").alias("_real"))
    inserted = added.join(real, F.col("under_new") & (F.col("pId") == F.col("_temp")), "left").select(
        "id", "name", F.coalesce("_real", "pId").alias("pid_id"), F.lit(False).alias("hidden")
    )
    refused = fresh.join(added.select(F.col("temp_id").alias("_t")), F.col("id") == F.col("_t"), "left_anti")
    tables = _as_tables(t).replaced(category=kept.unionByName(inserted), products=products)
    set_nodes = kept.join(updates.select("_old").unionAll(hidden_ids.select("_gone")), F.col("id") == F.col("_old"), "left_semi")
    shelved = t["products"].join(hidden_ids, F.col("category_id") == F.col("_gone"), "left_semi").withColumn("hidden", F.lit(True))
    return ChangeResult(
        tables,
        refused.select("id", F.lit("unknown_parent").alias("reason")),
        added=added.select("temp_id", "id"),
        delta={"category": Delta(conform(set_nodes.unionByName(inserted), "category")), "products": Delta(shelved)},
    )


def ids_gone(stored: DataFrame, listed: DataFrame) -> DataFrame:
    return stored.select(F.col("id").alias("_gone")).join(
        listed, F.col("_gone") == F.col("_listed"), "left_anti"
    )
