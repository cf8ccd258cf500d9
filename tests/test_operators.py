"""Building blocks on small hand-made inputs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, labels, money, text
from ledgerloom.operators import dense, paging, sets
from ledgerloom.operators.running import id_block, number_rows, running_total


def test_running_total_equals_window(spark):
    rows = [(k, i, (i * 7) % 5) for k in ("a", "b") for i in range(50)] + [("hot", i, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    got = running_total(df, ["k"], [id_block("i", 5), id_block("i", 2)], [F.col("i")], {"s": F.col("v")}).collect()
    want, sums = {}, {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[k, i] = sums[k]
    assert {(r.k, r.i): r.s for r in got} == want


def test_number_rows_descending_from_two(spark):
    df = spark.range(100).toDF("i")
    got = number_rows(df, [F.col("i").desc()], [-id_block("i", 3)], start=2).collect()
    assert {r.i: r.row_no for r in got} == {i: 101 - i for i in range(100)}


def test_deep_page_equals_shallow(spark, monkeypatch):
    df = spark.range(500).toDF("id")
    order, levels = [F.col("id").desc()], [-id_block("id", 4)]
    shallow = [r.id for r in paging.page_slice(df, order, 7).collect()]
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 0)
    deep = [r.id for r in paging.page_slice(df, order, 7, levels=levels).collect()]
    assert deep == shallow == list(range(379, 359, -1))


@pytest.mark.parametrize("page, want", [("2", 2), ("x", 1), (0, 1), (-3, 1), (None, 1), (5, 5)])
def test_clean_page(page, want):
    assert paging.clean_page(page) == want


def test_page_window(spark):
    df = spark.createDataFrame([(p,) for p in (1, 4, 5, 9, 40)], "p bigint")
    rows = df.select("p", paging.page_window(F.col("p"), F.lit(10).cast("bigint")).alias("w")).collect()
    pages = list(range(1, 11))
    for r in rows:  # five shown before and up to four after, in list slices
        want = pages[r.p - 5 : r.p + 4] if r.p >= 5 else pages[0 : r.p + 4]
        assert r.w == want


def test_half_even_and_means(spark):
    cases = [(5, 2), (7, 2), (1, 3), (2, 3), (0, 4), (25, 10), (35, 10), (-5, 2), (10**15 + 1, 2)]
    df = spark.createDataFrame(cases, "n bigint, d bigint")
    rows = df.select(
        "n", "d", money.half_even_div(F.col("n"), F.col("d")).alias("e"),
        money.mean_whole(F.col("n"), F.col("d")).alias("w"), money.mean_millionths(F.col("n"), F.col("d")).alias("m"),
    ).collect()
    from fractions import Fraction

    for r in rows:
        assert r.e == round(Fraction(r.n, r.d))
        if r.n >= 0:
            assert r.w * 10**6 + r.m == r.n * 10**6 // r.d


def test_half_even_div_by_zero(spark):
    df = spark.createDataFrame([(5, 0)], "n bigint, d bigint")
    assert df.select(money.half_even_div(F.col("n"), F.col("d")).alias("e")).first().e is None


def test_half_up_cents(spark):
    df = spark.createDataFrame([("1.5",), ("1.499999",), ("-1.5",), ("0",)], "v string")
    value = F.col("v").cast("decimal(38,6)")
    assert [r.c for r in df.select(money.half_up_cents(value).alias("c")).collect()] == [2, 1, -2, 0]


def test_share_of_cost_is_exact_for_large_stocks(spark):
    from fractions import Fraction

    cases = [(10**9, 10, 3), (10**12, 10**15, 7), (-(10**9), 20, 3), (1, 1, 3), (9 * 10**12, 99_999_999, 10**9 + 7), (0, 5, 3)]
    df = spark.createDataFrame(cases, "q bigint, paid bigint, got bigint")
    for r in df.select("*", money.share_of_cost(F.col("q"), F.col("paid"), F.col("got")).alias("v")).collect():
        assert abs(Fraction(r.v) - Fraction(r.q * r.paid, r.got)) <= Fraction(1, 10**6)


def test_text(spark):
    df = spark.createDataFrame([("a　b\tC ", "50%_off", None)], "s string, p string, n string")
    row = df.select(
        text.squash(F.col("s")).alias("squash"),
        text.icontains(F.col("p"), "%_OFF").alias("wild"),
        text.icontains(F.col("p"), "5_%").alias("literal"),
        text.icontains(F.col("n"), "").alias("null"),
        text.raw_like(F.col("p"), "50__OFF").alias("under"),
        text.raw_like(F.col("p"), "50\\%_off").alias("backslash"),
        text.icontains(F.lit("É"), "é").alias("ascii_only"),
        text.size_array(F.lit("230,x")).alias("size"),
        text.strip_tags(F.lit("<a href='x'>t</a>")).alias("tags"),
        text.pipe_row(F.lit("a"), F.col("n"), F.lit(3)).alias("pipe"),
    ).first()
    assert row.squash == "abC"
    assert (row.wild, row.literal, row.null, row.under, row.backslash, row.ascii_only) == (
        True, False, None, True, False, False,
    )
    assert row["size"] == [230, None] and row.tags == "t" and row.pipe == "a|None|3"


def test_dates(spark):
    df = spark.createDataFrame([("2012-02-29 08:30:00",), ("2013-02-29 08:30:00",), ("soon",)], "s string")
    assert [str(r.m) for r in df.select(dates.parse_moment(F.col("s")).alias("m")).collect()] == [
        "2012-02-29 08:30:00", "None", "None",
    ]
    slot = df.limit(1).select(dates.day_offset(F.lit("2012-02-28").cast("date"), date(2012, 3, 1)).alias("o")).first().o
    assert slot == -3


def test_labels(spark):
    row = spark.range(1).select(
        labels.level_label(F.lit(99)).alias("left"), labels.level_label(F.lit(50)).alias("none"),
        labels.supplier_label(F.lit(2)).alias("supplier"), labels.status_label(F.lit(True)).alias("status"),
        labels.category_label(F.lit("b"), F.lit(None).cast("string")).alias("root"),
    ).first()
    assert row == ("离职", None, "优家", "已删除", "b")


def test_dense_grid(spark):
    shops = spark.createDataFrame([(1,), (2,)], "shop_id bigint")
    facts = spark.createDataFrame([(1, date(2001, 7, 31), 5)], "shop_id bigint, day date, v bigint")
    rows = dense.fill_days(shops, "shop_id", facts, "v", "2001-08-01", 3).collect()
    assert len(rows) == 6 and sum(r.v for r in rows) == 5


def test_sets(spark):
    old, new = spark.range(0, 5), spark.range(3, 8)
    assert sorted(r.id for r in sets.ids_kept(old, new).collect()) == [3, 4]
    assert sorted(r.id for r in sets.ids_removed(old, new).collect()) == [0, 1, 2]
    assert sorted(r.id for r in sets.ids_added(old, new).collect()) == [5, 6, 7]


@pytest.mark.parametrize("ranked_rows", [1000, 0])
def test_top_k_per(spark, monkeypatch, ranked_rows):
    monkeypatch.setattr(paging, "RANKED_ROWS", ranked_rows)
    df = spark.range(300).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 7).alias("v"))
    top = paging.top_k_per(df, ["k"], 5, F.col("v").desc(), F.col("id"), levels=[-F.col("v"), id_block("id", 4)])
    if ranked_rows:
        assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    want = set()
    for k in range(3):
        want |= {i for _, i in sorted((-(i % 7), i) for i in range(300) if i % 3 == k)[:5]}
    assert {r.id for r in top.collect()} == want


def test_roles(spark):
    from ledgerloom.functions import predicates
    from ledgerloom.plans.catalog import is_duplicate

    assert predicates.dashboard_days(6, 60) == 60 and predicates.dashboard_days(5, 500) == 500
    assert predicates.dashboard_days(6, 120, wide=True) == 120
    for days, wide in ((61, False), (121, True)):
        with pytest.raises(ValueError):
            predicates.dashboard_days(6, days, wide)
    assert predicates.sees_depots(4) and not predicates.sees_depots(5)
    orders = spark.createDataFrame([(1,), (2,)], "shop_id bigint")
    shops = lambda test: {r.shop_id for r in orders.filter(test).collect()}
    assert shops(predicates.orders_in_scope(4, 1)) == {1, 2} and shops(predicates.orders_in_scope(5, 1)) == {1}
    assert shops(predicates.orders_in_scope(6, 1, requested=2)) == {2}
    assert [shops(predicates.editable_orders(level, 1)) for level in (2, 3, 5, 6)] == [{1}, set(), {1}, set()]
    counts = spark.createDataFrame([(0,), (1,), (2,)], "c int")
    assert [r.d for r in counts.select(is_duplicate(F.col("c"), editing=True).alias("d")).collect()] == [False, False, True]
