"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

1. *Cut.* Each document becomes ids plus an end id; a longer one than a sequence is cut into full pieces and a rest.
2. *Plan.* Only the number of pieces of each length matters, at most ``capacity`` numbers however large the
   corpus is. From that histogram the plan is drawn bin by bin: the longest piece left is set, and a subset-sum
   dynamic program over the lengths left, with the reachable fillings as the bits of one integer, finds
   the fullest feasible combination. It is removed as often as the histogram allows. Every pattern uses
   up a length or nearly so, so there are some thousand patterns at most.
3. *Place.* Pieces of one length are interchangeable: the k-th of them takes the k-th place that the plan has for
   that length. Pieces are numbered within (length, hash) groups with the groups' sizes added up, so
   a length that a third of all pieces share is spread over many tasks.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; texts of any
length are tokenised whole; an empty table gives no rows; rows with a null ``doc_id`` are packed too. Other
columns are not read. Sequences have no gaps, the numbers of sequences are dense from 0.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import TwoGenerations, by_value, process_state
from ledgerloom.session import cut

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_CACHED_WORDS = 400_000
#: pieces of one length are numbered in groups of about so many, and in so many groups at least
_GROUP_ROWS, _LEAST_GROUPS = 65_536, 64


class WordTokenizer:
    """Ids of whole texts from the ids of their words, each of which the tokenizer sees once.

    This holds for a byte-level tokenizer that lower-cases, ends words at white space and drops it. Texts in which a word's
    ids could depend on more than the word (its special tokens, unusual white space, forms that
    normalisation changes) go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for a word of lower-case letters, normalising and cutting leave it as it is
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = TwoGenerations(_CACHED_WORDS)

    def _by_words(self, text: str) -> bool:
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or any(s in text for s in self.special):
            return False
        if text.isascii():
            return True
        odd = any(c in text for c in "᠎İΣͅ")
        return not odd and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", text.lower())

    def _learn(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words with a final comma or stop are put together from the rest and that."""
        stem_of = {w: w[:-1] if w[-1] in ".," and w[:-1].isalpha() else w for w in words}
        ids = {s: found for s in {*stem_of.values(), ".", ","} if (found := self.known.get(s)) is not None}
        new = {*stem_of.values(), ".", ","}.difference(ids)
        letters = {w for w in new if w.isalpha()}
        for tokenizer, own in ((self.plain, list(letters)), (self.tokenizer, list(new - letters))):
            for word, found in zip(own, tokenizer.encode_batch_fast(own, add_special_tokens=False)):
                ids[word] = np.asarray(found.ids, "<u4").tobytes()
                yield word, ids[word]
        for word, stem in stem_of.items():
            if word != stem:
                yield word, ids[stem] + ids[word[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        words = [t.lower().split() if self._by_words(t) else None for t in texts]
        known = self.known.holding(set().union(*filter(None, words)), self._learn)
        return [
            b"".join(map(known.__getitem__, ws)) if ws is not None
            else np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for t, ws in zip(texts, words)
        ]


def _cutter(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = process_state("word_tokenizers")
        tokenizer = held.get(path) or held.setdefault(path, WordTokenizer(path))
        end, width = np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode(texts)):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), width)):
                        own = ids[start : start + width]
                        for column, value in zip(out, (doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own))):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_cutter(tokenizer_path, capacity, end_id), PIECES)


def _fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the lengths (descending) with the largest sum up to ``room``: length to how many."""
    goal, mask = 1 << room, (1 << (room + 1)) - 1
    bits, steps = 1, []
    for length in lengths:
        left = min(counts[length], room // length)
        n = 1
        while left:
            n = min(n, left)
            steps.append((length, n, bits))
            bits |= (bits << (length * n)) & mask
            left -= n
            n *= 2
        if bits & goal:
            break
    at, taken = bits.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + n
            at -= length * n
    return taken


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, how many bins of it), until no piece is left."""
    counts = {length: n for length, n in histogram.items() if n}
    plan = []
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        counts[longest] -= 1
        combination = _fullest([x for x in lengths if x <= capacity - longest], counts, capacity - longest)
        counts[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in combination.items())
        for length, n in combination.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        plan.append((combination, times))
    return plan


def _placer(plan: list[tuple[dict[int, int], int]]):
    """Fills in sequence and offset of numbered pieces: (length, number) falls into one stretch of the plan."""
    rows, used, bins = [], {}, 0
    for combination, times in plan:
        offset = 0
        for length, n in sorted(combination.items(), reverse=True):
            begin = used.get(length, 0)
            rows.append((length, begin, bins, times, offset))
            used[length] = begin + n * times
            offset += n * length
        bins += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        keys = np.rec.fromarrays([table[:, 0], table[:, 1]], names="length,begin")
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            number = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, np.rec.fromarrays([length, number], names="length,begin"), "right") - 1
            nth = number - table[at, 1]
            sequence = table[at, 2] + nth % table[at, 3]
            offset = table[at, 4] + nth // table[at, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with the sequence and offset each is placed at.

    The pieces (numbers only, no ids) are kept on shared storage, as they are counted before they are placed.
    """
    pieces = cut(cut_pieces(docs, tokenizer_path, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = max(_LEAST_GROUPS, -(-max(histogram.values(), default=0) // _GROUP_ROWS))
    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int")
    pieces = pieces.withColumn("_group", group)
    sizes = pieces.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("_own", F.row_number().over(own)).join(sizes, ["length", "_group"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_own") + F.col("_before") - 1).cast("long").alias("number")
    )
    return numbered.mapInArrow(_placer(plan_bins(histogram, capacity)), PIECES + ", sequence_id long, offset long")


by_value(__name__)
