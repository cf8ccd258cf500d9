"""Unique values that rows claim and give up, decided in the order of the claims.

A row holds at most one value at a time. A claim (``seq``, ``row``, ``value``) is granted if no other row holds the value
just then; the row gives up what it held before. A refused claim changes nothing.

Most values are asked for by one row only and none of this matters. For the others, each round knows of every contested
value who holds it since when, and until when at the latest that is certain: up to the holder's next claim of another value
that is not refused yet. Claims of others in that time are refused. If that next claim is granted, or nobody held the
value, the first claim after it is granted and its row is the next holder. So each round moves every value on by one holder,
and always decides the first open claim. When a round decides less than ``LEAST_DECIDED`` of the open claims,
a task streams through what is left in order, holding the rows and values of the rest only.

Deciding is eager: calling this starts jobs even if only the plan of the result is wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

_OPEN, _GRANTED, _REFUSED = 0, 1, 2

#: rounds end when one decides less than this share of the open claims
LEAST_DECIDED = 0.1

_EVENT = "seq bigint, granted boolean"


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seq: first what rows hold (no seq), then their claims, of which some are granted already."""
    held, holders, granted = {}, {}, 1
    for batch in batches:
        seqs, verdicts = [], []
        for seq, row, value, status in zip(*(batch.column(n).to_pylist() for n in ("seq", "row", "value", "status"))):
            if seq is not None and status != granted:
                verdicts.append(not (holders.get(value, set()) - {row}))
                seqs.append(seq)
                if not verdicts[-1]:
                    continue
            if row in held:
                holders[held[row]].discard(row)
            held[row] = value
            holders.setdefault(value, set()).add(row)
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(verdicts, pa.bool_())], ["seq", "granted"])


def _round(work: DataFrame, holders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and holders after one round. ``holders``: value, row, since (-1: stored), one for each held value."""
    live = work.filter(F.col("status") != _REFUSED)
    moves = live.select(F.col("row").alias("_row"), F.col("value").alias("_to"), F.col("seq").alias("_at"), F.col("status").alias("_how"))
    ends = holders.join(
        moves, (F.col("row") == F.col("_row")) & (F.col("_at") > F.col("since")) & (F.col("_to") != F.col("value")), "left"
    ).groupBy("value", "row", "since").agg(F.min("_at").alias("until"), F.min_by("_how", "_at").alias("how"))
    ends = ends.withColumnRenamed("row", "holder")
    is_open = (F.col("status") == _OPEN) & ~F.col("stuck")
    within = (F.col("seq") > F.col("since")) & (F.col("until").isNull() | (F.col("seq") < F.col("until")))
    released = F.col("holder").isNull() | ((F.col("how") == _GRANTED) & (F.col("seq") > F.col("until")))
    claims = work.join(ends, "value", "left")
    first = claims.filter(is_open & released).groupBy("value").agg(F.min("seq").alias("_first"))
    claims = claims.join(first, "value", "left")
    status = (
        F.when(~is_open, F.col("status"))
        .when(F.coalesce(within, F.lit(False)), F.when(F.col("row") == F.col("holder"), _GRANTED).otherwise(_REFUSED))
        .when(F.col("seq") == F.col("_first"), _GRANTED)
        .otherwise(_OPEN)
    )
    claims = cut(claims.withColumn("_now", status))
    next_holders = claims.filter(F.col("seq") == F.col("_first")).select("value", "row", F.col("seq").alias("since"))
    kept = holders.join(next_holders.select("value"), "value", "left_anti").unionByName(next_holders)
    return claims.select("seq", "row", "value", "stuck", F.col("_now").alias("status")), cut(kept)


def grant_in_order(claims: DataFrame, stored: DataFrame) -> DataFrame:
    """``seq`` and ``granted`` of every claim.

    ``claims``: seq (BIGINT, one value per claim), row and value; ``stored``: row and value as held before, at most one value
    per row. Of stored rows only those matter that claim something or hold a value that is claimed.
    """
    claims = cut(claims.select("seq", "row", "value"))
    said = claims.select("value", "row", F.lit(True).alias("_claimed")).unionByName(
        stored.select("value", "row", F.lit(False).alias("_claimed"))
    )
    asked = said.groupBy("value").agg(F.min("row").alias("_low"), F.max("row").alias("_high"), F.max("_claimed").alias("_claimed"))
    contested = cut(asked.filter(F.col("_claimed") & (F.col("_low") != F.col("_high"))).select("value"))
    everyone = claims.select("seq", F.lit(True).alias("granted"))
    if contested.isEmpty():
        return everyone

    # rows that may hold a contested value at some time, with all of their claims
    involved = claims.join(contested, "value", "left_semi").select("row").unionAll(
        stored.join(contested, "value", "left_semi").select("row")
    ).distinct()
    involved = cut(involved)
    start = cut(stored.select("row", "value").join(involved, "row", "left_semi"))
    # a stored value of several rows is left to the replay, which keeps sets of holders
    several = start.groupBy("value").agg(F.count("*").alias("_n")).filter("_n > 1").select("value")
    several = cut(several.join(contested, "value", "left_semi"))
    work = claims.join(involved, "row", "left_semi").join(contested.withColumn("_open", F.lit(True)), "value", "left")
    work = work.join(several.withColumn("_stuck", F.lit(True)), "value", "left").select(
        "seq", "row", "value", F.col("_stuck").isNotNull().alias("stuck"), F.when(F.col("_open"), _OPEN).otherwise(_GRANTED).alias("status")
    )
    done = cut(work)
    holders = start.join(contested, "value", "left_semi").join(several, "value", "left_anti")
    holders = cut(holders.select("value", "row", F.lit(-1).cast("bigint").alias("since")))
    still_open = (F.col("status") == _OPEN) & ~F.col("stuck")
    left, before = done.filter(still_open).count(), None
    while left and (before is None or left < before and left <= (1 - LEAST_DECIDED) * before):
        done, holders = _round(done, holders)
        left, before = done.filter(still_open).count(), left
    verdict = done.filter(F.col("status") != _OPEN).select("seq", (F.col("status") == _GRANTED).alias("granted"))
    rest = done.filter(F.col("status") == _OPEN)
    if not rest.isEmpty():
        values = rest.select("value").distinct()
        rows = done.join(values, "value", "left_semi").select("row").unionAll(
            start.join(values, "value", "left_semi").select("row")
        ).distinct()
        events = done.filter(F.col("status") != _REFUSED).drop("stuck").join(rows, "row", "left_semi").unionByName(
            start.join(rows, "row", "left_semi").select(F.lit(None).cast("bigint").alias("seq"), "row", "value", F.lit(_GRANTED).alias("status"))
        )
        ordered = events.select("seq", "row", "value", "status").repartition(1).sortWithinPartitions(F.col("seq").asc_nulls_first())
        verdict = verdict.unionByName(ordered.mapInArrow(_replay, _EVENT))
    verdict = cut(verdict)
    return everyone.join(verdict.select("seq"), "seq", "left_anti").unionByName(verdict)
