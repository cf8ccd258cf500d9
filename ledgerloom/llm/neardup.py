"""Near-duplicates by circulant MinHash, banding and exact verification.

1. *Sketch.* A document's set is its distinct word shingles, as 64-bit hashes. Two permutations of a large
   circle of positions make the whole signature: the first scatters the shingles over the circle, the
   second, shifted round by k positions, gives the k-th coordinate as its minimum over the set. The values of
   all shifts for one position lie side by side, so a set's signature is a minimum of slices.
2. *Classes.* Documents with the same set are one class, named by its smallest id; groups of copies of any
   size are summed up in parts and go on as one row.
3. *Bands.* ``BANDS`` bands of ``ROWS`` coordinates. At similarity 0.8 a pair shares no band with a
   chance of (1 - 0.8**4)**32, about 5 in 100 million.
4. *Pivots.* In every bucket one member is the pivot (by one of two orders) and is paired with the
   others, so candidates grow with the bucket and not with its square. Their similarity is computed
   on the full sets; links make components.
5. *The rest.* Components that still share a bucket form a cluster. Each member that stands outside its bucket's
   largest component is compared with every member of its cluster: members and those left over are dealt
   into blocks of a bounded number of shingles, and a task that holds a block of each counts all common
   shingles at once from an inverted index of the block. Only links that join components leave the task, never
   pairs. So every pair in a bucket is either in one component already or compared on its full sets.

Full sets are only made for documents that some candidate pair names.

Defined results: a null or empty text, or one of white space, has no set: 0 shingles, linked with nothing. Fewer words
than a shingle: the whole sequence is the one shingle. Rows repeated under one id are one document whose
links add up, and each row gets the same component. A null id links with nothing: component null, kept. Very
long texts are whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_value, process_state
from ledgerloom.llm.components import connected
from ledgerloom.session import cut

SHINGLE_WORDS = 5
#: similarity as a fraction: linked where intersection * OF >= union * AT_LEAST
AT_LEAST, OF = 80, 100

CIRCLE = 1 << 20
BANDS, ROWS = 32, 4
#: orders by which buckets pick their pivots
PIVOT_ORDERS = 2
#: shingles of the sets that a block of a cluster holds
BLOCK_SHINGLES = 1 << 16

_SEED = 7919
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, kept per process and grown as texts need."""
    return process_state("word_hash_powers").setdefault("both", (np.ones(1, np.uint64), np.ones(1, np.uint64)))


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers()
    if len(up) < n:
        size = 1 << max(16, n.bit_length())
        base = 0x9E3779B97F4A7C15
        both = tuple(
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
            for b in (base, pow(base, -1, 1 << 64))
        )
        process_state("word_hash_powers")["both"] = both
        up, down = both
    return up, down


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, in order."""
    raw = np.frombuffer(text.lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = ~_SPACE[raw]
    edge = np.diff(inside, prepend=False, append=False)
    begin, end = np.flatnonzero(edge)[::2], np.flatnonzero(edge)[1::2]
    up, down = _powers_up_to(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    return _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(text or b"")
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    size = min(size, len(words))
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = _mixed(mixed * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return np.unique(mixed)


def _circle() -> tuple[np.ndarray, np.ndarray]:
    """The two permutations; the second as rows of the values that the shifts bring to each position."""
    held = process_state("circulant_minhash")
    if "pair" not in held:
        drawn = np.random.default_rng(_SEED)
        scatter = drawn.permutation(CIRCLE).astype(np.int32)
        ring = drawn.permutation(CIRCLE).astype(np.int32)
        k = BANDS * ROWS
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: k - 1]]), k)
        held["pair"] = scatter, rows
    return held["pair"]


def signature(shingles: np.ndarray) -> np.ndarray:
    """All BANDS * ROWS minima of a set."""
    scatter, rows = _circle()
    at = np.unique(scatter[(shingles & np.uint64(CIRCLE - 1)).astype(np.int64)])
    out = rows[at[:4096]].min(axis=0)
    for i in range(4096, len(at), 4096):
        np.minimum(out, rows[at[i : i + 4096]].min(axis=0), out=out)
    return out


def _sketcher(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "set_a", "set_b", "bands"]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                own = shingle_set(text, size)
                row = (doc_id, 0, None, None, None)
                if len(own):
                    sign = signature(own)
                    salted = sign.reshape(BANDS, ROWS).astype(np.uint64)
                    bands = np.arange(BANDS, dtype=np.uint64)
                    for i in range(ROWS):
                        bands = _mixed(bands * np.uint64(0xD6E8FEB86659FD93) + salted[:, i])
                    # two independent 64-bit sums name the set
                    name = _mixed(own).sum(dtype=np.uint64), _mixed(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                    row = (doc_id, len(own), *(int(np.int64(x.astype(np.int64))) for x in name), bands.astype(np.int64).tolist())
                for column, value in zip(columns, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Set size, set name and band hashes of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    return rows.mapInArrow(_sketcher(size), schema)


def _set_maker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            names = np.array([_mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "name", "shingles"]
            )

    return run


def _verifier(at_least: int, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                small, large = sorted((a, b), key=len)
                same = 0
                if len(small) * of >= len(large) * at_least:
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    same = int((large[at] == small).sum())
                keep.append(same * of >= (len(a) + len(b) - same) * at_least and same > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, at_least: int, of: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough on their full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_of_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_of_a", "_of_b")
    return both.mapInArrow(_verifier(at_least, of), "a long, b long")


def _sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return texts.mapInArrow(_set_maker(size), "id long, name long, shingles binary").dropDuplicates(["id", "name"])


def _cluster_linker(at_least: int, of: int):
    """Rows (cluster, part, with_part, left_over, id, component, more, shingles), sorted by the first four, to links.

    A part's members come before those left over; ``more`` marks members that are left over as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        members: list[tuple] = []
        rest: list[tuple] = []
        found: list[tuple[int, int]] = []
        key = None

        def flush() -> None:
            if members and rest:
                ids = np.array([m[0] for m in members])
                component = np.array([m[1] for m in members])
                more = np.array([m[2] for m in members])
                sizes = np.array([len(m[3]) for m in members])
                flat = np.concatenate([m[3] for m in members])
                holder = np.repeat(np.arange(len(members)), sizes)
                order = np.argsort(flat, kind="stable")
                values, begin = np.unique(flat[order], return_index=True)
                end = np.append(begin[1:], len(flat))
                holder = holder[order]
                up: dict[int, int] = {}

                def top(c: int) -> int:
                    while up.get(c, c) != c:
                        c = up[c]
                    return c

                for own_id, own_component, _, own in rest:
                    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                    at = at[values[at] == own]
                    count = end[at] - begin[at]
                    if not len(count):
                        continue
                    skip = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                    same = np.bincount(holder[skip + np.arange(count.sum())], minlength=len(members))
                    near = same * of >= (sizes + len(own) - same) * at_least
                    near &= (component != own_component) & ~(more & (ids <= own_id))
                    for other in set(component[near].tolist()):
                        x, y = top(own_component), top(other)
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            found.append((own_component, other))
            members.clear()
            rest.clear()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for cluster, part, with_part, left_over, own_id, component, more, shingles in zip(*columns):
                if (cluster, part, with_part) != key:
                    flush()
                    key = cluster, part, with_part
                (rest if left_over else members).append((own_id, component, more, np.frombuffer(shingles, np.uint64)))
            yield _links_batch(found)
            found.clear()
        flush()
        yield _links_batch(found)

    return run


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _links_in_clusters(rest: DataFrame, sizes: DataFrame, sets: DataFrame, at_least: int, of: int) -> DataFrame:
    """Links between components that share a bucket. ``rest``: (id, component, main) of all members of such buckets.

    Blocks are drawn up from ids and set sizes; the sets join last.
    """
    touching = rest.filter("component <> main").select(F.col("main").alias("a"), F.col("component").alias("b")).distinct()
    clusters = connected(touching).select(F.col("id").alias("component"), F.col("component").alias("cluster"))
    people = rest.groupBy("id").agg(F.any_value("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("more"))
    largest = sizes.groupBy("id").agg(F.max("size").alias("size"))
    people = cut(people.join(clusters, "component").join(largest, "id"))
    parts = people.groupBy("cluster").agg(
        F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("_n"),
        F.ceil(F.sum(F.when(F.col("more"), F.col("size"))) / BLOCK_SHINGLES).cast("int").alias("_m"),
    )
    people = people.join(parts.filter("_m > 0"), "cluster")
    own, other = F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"), F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.col("_m")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_member = F.transform(every("_m"), lambda m: F.struct(own.alias("part"), m.alias("with_part"), F.lit(False).alias("left_over")))
    as_rest = F.transform(every("_n"), lambda n: F.struct(n.alias("part"), other.alias("with_part"), F.lit(True).alias("left_over")))
    roles = F.when(F.col("more"), F.concat(as_member, as_rest)).otherwise(as_member)
    dealt = people.select("cluster", F.explode(roles).alias("r"), "id", "component", "more").join(sets.select("id", "shingles"), "id")
    group = ["cluster", "part", "with_part"]
    dealt = dealt.select("cluster", "r.*", "id", "component", "more", "shingles").repartition(*group)
    return dealt.sortWithinPartitions(*group, "left_over").mapInArrow(_cluster_linker(at_least, of), "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, at_least: int = AT_LEAST, of: int = OF
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text)."""
    sketched = cut(sketches(docs, shingle_words))
    named = sketched.filter("doc_id is not null and set_a is not null")
    # one class per set; what a set's rows carry is the same, so any will do
    classes = cut(
        named.groupBy("set_a", "set_b").agg(
            F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("size"),
        )
    )
    banded = classes.select("id", F.posexplode("bands").alias("band", "key"))
    # the pivot of a bucket: the least id under a mask; few masks, so buckets of one group share their pivots
    drawn = np.random.default_rng(_SEED).integers(0, 1 << 62, PIVOT_ORDERS)
    mask = F.element_at(F.array(*(F.lit(int(m)) for m in drawn)), F.col("band") % PIVOT_ORDERS + 1)
    pivots = banded.groupBy("band", "key").agg(F.min(F.col("id").bitwiseXOR(mask)).alias("_least"), F.count("*").alias("_n"))
    pivots = pivots.filter("_n > 1").select("band", "key", F.col("_least").bitwiseXOR(mask).alias("pivot"))
    buckets = cut(banded.join(pivots, ["band", "key"]))
    ordered = F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")
    pairs = cut(buckets.filter("pivot <> id").select(*ordered).distinct())
    named_ids = buckets.select("id").distinct()
    sets = cut(_sets_of(named_ids, docs, shingle_words))
    # rows and their classes; the texts of one id are one document, so they are linked
    assigned = sketched.select("doc_id", "n_shingles", "set_a", "set_b").join(
        classes.select("set_a", "set_b", F.col("id").alias("_class")), ["set_a", "set_b"], "left"
    )
    assigned = cut(assigned.select("doc_id", "n_shingles", "_class"))
    texts = assigned.filter("doc_id is not null").groupBy("doc_id").agg(F.min("_class").alias("a"), F.max("_class").alias("_most"))
    repeated = assigned.join(texts.filter("a <> _most").select("doc_id", "a"), "doc_id").select("a", F.col("_class").alias("b"))
    first = connected(_links(pairs, sets, at_least, of).unionAll(repeated.filter("b is not null")))

    # buckets with several components left
    member = buckets.select("band", "key", "id").join(first, "id", "left")
    member = cut(member.select("band", "key", "id", F.coalesce("component", "id").alias("component")))
    parts = member.groupBy("band", "key", "component").agg(F.count("*").alias("_n"))
    open_ = parts.groupBy("band", "key").agg(F.max_by("component", F.struct("_n", "component")).alias("main"), F.count("*").alias("_parts"))
    open_ = open_.filter("_parts > 1").select("band", "key", "main")
    rest = member.join(open_, ["band", "key"]).select("id", "component", "main")
    second = connected(_links_in_clusters(cut(rest), classes.select("id", "size"), sets, at_least, of))

    whole = first.join(second.select(F.col("id").alias("component"), F.col("component").alias("_over")), "component", "left")
    whole = whole.select("id", F.coalesce("_over", "component").alias("component")).unionAll(
        second.join(first, "id", "left_anti").select("id", "component")
    )
    done = assigned.join(whole.select(F.col("id").alias("_class"), "component"), "_class", "left")
    component = F.coalesce("component", "_class", "doc_id")
    return done.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_first(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, at_least: int = AT_LEAST, of: int = OF
) -> DataFrame:
    """The documents whose id is the smallest of their group, with all of their columns.

    Only ids that go are joined, and a document with a null id stays. Rows repeated under a kept id stay.
    """
    gone = near_duplicates(docs, shingle_words, at_least, of).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


by_value(__name__)
