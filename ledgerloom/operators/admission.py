"""First-come-first-served admission of requests that compete for shared quantities.

Requests are decided in ``seq`` order. A request names one or more resources; on each it
may *need* a quantity to be available and, once accepted, takes ``delta`` away (a
negative delta gives back). It is accepted when every need is met by the capacity minus
what earlier accepted requests took, and otherwise takes nothing.

Whether one request is accepted can hinge on every earlier one of its *component* (say a
shop, when a request only touches that shop's products), so a single windowed sum is
wrong. Components are independent. One of bounded size is replayed row by row: Spark
shuffles and sorts the claims, and a task streams through its components holding only
the current one's taken quantities. A larger one, which would keep one task busy
while the others wait, is narrowed down first: what
earlier requests may have taken lies between two running sums, as undecided ones count
fully in the one and not at all in the other. A request that fits even under the higher
sum is accepted, one that does not fit even under the lower is rejected, the rest wait
for the next round. The first undecided request has equal bounds, so every round decides
some and the result is exactly the sequential one. As soon as what is left of a
component is small enough, or a round decides too small a share, the rest is replayed.

Deciding is eager: calling this starts jobs even if only the plan of the result is wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.running import id_block, running_total
from ledgerloom.session import cut

_OPEN, _ACCEPTED, _REJECTED = 0, 1, 2
#: no claim, but what there is of a resource; such rows come before the claims of their component
_CAPACITY = -1

#: components with up to this many claims are replayed in one task
REPLAY_ROWS = 1_000_000

#: narrowing ends when a round decides less than this share of the open claims; a task then
#: streams through what is left, which takes time but, holding only what was taken, no memory
LEAST_DECIDED = 0.1

#: components are counted in so many groups first, and one by one only in groups with enough claims
_GROUPS = 4096


def _replay(keys: list[str], component: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function deciding claims that arrive sorted by component and ``seq``, after the capacities of the component.

    It is built as a closure, so it travels to the executors by value.
    """
    accepted_status, capacity_status = _ACCEPTED, _CAPACITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {c: [] for c in ["seq", *keys, "accepted", "available", "short"]}
        taken: dict[tuple, int] = {}
        listed: dict[tuple, list[int]] = {}
        current, request, own = None, [], None
        schema = None

        def decide() -> None:
            # `left` already lacks what earlier rounds took before this very claim
            available = [left - taken.get(key, 0) for _, key, left, *_ in request]
            short = [need is not None and need > have for have, (*_, need, _, _, _) in zip(available, request)]
            won = any(r[-1] == accepted_status for r in request) or (all(r[-2] for r in request) and not any(short))
            for (seq, key, _, _, delta, *_), have, lacks in zip(request, available, short):
                if won:
                    taken[key] = taken.get(key, 0) + delta
                for name, value in zip(out, (seq, *key, won, have, lacks)):
                    out[name].append(value)

        for batch in batches:
            schema = schema or pa.schema(
                [batch.schema.field(c).with_nullable(True) for c in ("seq", *keys)]
                + [("accepted", pa.bool_()), ("available", pa.int64()), ("short", pa.bool_())]
            )
            column = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            places = zip(*[column[c] for c in component])
            claims = zip(
                column["seq"], zip(*[column[k] for k in keys]),
                *[column[c] for c in ("left", "need", "delta", "eligible", "only_listed", "status")],
            )
            for place, claim in zip(places, claims):
                if current != (place, claim[0]):
                    decide()
                    request = []
                    current = (place, claim[0])
                if own is None or own != (place,):
                    own = (place,)
                    taken.clear()
                    listed.clear()
                seq, key, left, need, delta, eligible, only_listed, status = claim
                if status == capacity_status:
                    listed.setdefault(key, []).append(left)
                    continue
                if only_listed and key not in listed:
                    delta = 0
                for have in listed.get(key, (0,)):
                    request.append((seq, key, left + have, need, delta, eligible, status))
            yield pa.RecordBatch.from_pydict(out, schema)
            out = {c: [] for c in out}
        if request:
            decide()
            yield pa.RecordBatch.from_pydict(out, schema)

    return run


def _bounding_round(work: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Judge open claims by the bounds on what earlier open requests take.

    Requests accepted in the round before are folded into ``left`` and leave.
    """
    zero = F.lit(0).cast("bigint")
    is_open, delta = F.col("status") == _OPEN, F.col("delta")
    sums = running_total(
        work, keys, [id_block("seq")], [F.col("seq")],
        {
            "_taken": F.when(~is_open, delta).otherwise(zero),
            "_most": F.when(is_open, F.greatest(delta, zero)).otherwise(zero),
            "_least": F.when(is_open, F.least(delta, zero)).otherwise(zero),
        },
    ).filter(is_open)
    left = F.col("left") - F.col("_taken")
    high = F.col("_most") - F.greatest(delta, zero)
    low = F.col("_least") - F.least(delta, zero)
    judged = sums.select(
        *columns,
        left.alias("left"),
        F.coalesce(F.col("need") <= left - high, F.lit(True)).alias("_fits"),
        F.coalesce(F.col("need") > left - low, F.lit(False)).alias("_fails"),
    )
    verdicts = judged.groupBy("seq").agg(F.min("_fits").alias("_all_fit"), F.max("_fails").alias("_any_fails"))
    status = F.when(F.col("_any_fails"), _REJECTED).when(F.col("_all_fit"), _ACCEPTED).otherwise(_OPEN)
    return judged.drop("_fits", "_fails").join(verdicts.select("seq", status.alias("status")), "seq")


def admit_in_order(
    claims: DataFrame,
    keys: Sequence[str],
    capacity: DataFrame,
    component: Sequence[str],
    replay_rows: int = REPLAY_ROWS,
) -> DataFrame:
    """Decide all requests.

    ``claims``: one row per request and resource -- ``seq`` (BIGINT, one value per
    request), the resource ``keys``, ``need`` (NULL: no condition), ``delta``, and
    ``eligible`` (false: already refused on other grounds, takes nothing; so is a claim without ``delta``).
    Claims may have a column ``only_listed``: where it is true, a resource that ``capacity`` lacks stays at 0 whatever is taken.
    They are read more than once, so keep them if they cost much to make.
    ``capacity``: resource ``keys`` and ``capacity``; a missing resource has 0.
    ``component``: those of the keys that all resources of a request share.

    Returns per claim ``accepted`` (of the whole request), ``available`` (what was left of
    the resource when the request came up) and ``short`` (the need was above that).
    """
    keys, component = list(keys), list(component)
    zero = F.lit(0).cast("bigint")
    columns = ["seq", *keys, "need", "delta", "eligible", "only_listed"]
    types = dict(claims.dtypes)
    decided_schema = ", ".join(
        ["seq bigint", *[f"{k} {types[k]}" for k in keys], "accepted boolean", "available bigint", "short boolean"]
    )

    def big_components(df: DataFrame) -> DataFrame:
        sizes = df.groupBy(*component).agg(F.count("*").alias("_size"))
        return sizes.filter(F.col("_size") > replay_rows).select(*component)

    def replay(df: DataFrame) -> DataFrame:
        df = df.select("seq", *keys, "need", "delta", "eligible", "only_listed", "left", "status")
        # by a hash of its own: a shuffle by the component itself is left out where rows lie by it already, and such rows may be read otherwise in the end
        ordered = df.repartition(F.xxhash64(*component)).sortWithinPartitions(*component, F.col("status") != _CAPACITY, "seq")
        return ordered.mapInArrow(_replay(keys, component), decided_schema)

    def replay_with(df: DataFrame, capacity: DataFrame) -> DataFrame:
        held = capacity.dropna(subset=keys).select(*keys, "left", F.lit(_CAPACITY).alias("status"))
        held = held.select(*[F.col(k).cast(types[k]).alias(k) for k in keys], "left", "status")
        return replay(df.withColumn("left", zero).unionByName(held, allowMissingColumns=True))

    only_listed = F.col("only_listed") if "only_listed" in claims.columns else F.lit(False)
    claims = claims.select(
        "seq", *keys, F.col("need").cast("bigint").alias("need"),
        F.coalesce(F.col("delta").cast("bigint"), zero).alias("delta"),
        (F.col("eligible") & F.col("delta").isNotNull()).alias("eligible"),
        only_listed.alias("only_listed"), F.lit(_OPEN).alias("status"),
    )
    capacity = capacity.select(*keys, F.coalesce(F.col("capacity").cast("bigint"), zero).alias("left"))
    group = F.pmod(F.xxhash64(*component), F.lit(_GROUPS)).alias("_group")
    groups = claims.groupBy(group).agg(F.count("*").alias("_size")).filter(F.col("_size") > replay_rows)
    groups = cut(groups.select("_group"))
    if groups.isEmpty():
        return replay_with(claims, capacity)
    big = cut(big_components(claims.withColumn("_group", group).join(groups, "_group", "left_semi")))
    if big.isEmpty():
        return replay_with(claims, capacity)
    done = replay_with(claims.join(big, component, "left_anti"), capacity.join(big, component, "left_anti"))
    large = claims.join(big, component, "left_semi").join(capacity, keys, "left")
    large = cut(
        large.withColumn("delta", F.when(F.col("only_listed") & F.col("left").isNull(), zero).otherwise(F.col("delta")))
        .withColumn("left", F.coalesce("left", zero)).withColumn("only_listed", F.lit(False))
    )
    accepted = large.select("seq").limit(0)
    work = large.filter("eligible")
    open_claims = work.filter(F.col("status") == _OPEN).count()
    while open_claims:
        judged = cut(_bounding_round(work, keys, columns))
        won = judged.filter(F.col("status") == _ACCEPTED).select("seq")
        rest = judged.filter(F.col("status") != _REJECTED)
        left = rest.filter(F.col("status") == _OPEN).count()
        if left > (1 - LEAST_DECIDED) * open_claims:
            small, work = rest, rest.limit(0)
            left = 0
        else:
            big = cut(big_components(rest))
            small, work = rest.join(big, component, "left_anti"), rest.join(big, component, "left_semi")
            left = work.filter(F.col("status") == _OPEN).count() if left else 0
        replayed = replay(small).filter("accepted").select("seq")
        accepted = cut(accepted.unionByName(won).unionByName(replayed).distinct())
        open_claims = left
    accepted = accepted.withColumn("accepted", F.lit(True))
    result = large.join(accepted, "seq", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    taken = F.when(F.col("accepted"), F.col("delta")).otherwise(zero)
    result = running_total(result, keys, [id_block("seq")], [F.col("seq")], {"_taken": taken})
    result = result.withColumn("available", F.col("left") - (F.col("_taken") - taken))
    short = F.coalesce(F.col("need") > F.col("available"), F.lit(False))
    return done.unionByName(result.select("seq", *keys, "accepted", "available", short.alias("short")))
