"""Spelling variants of words, found with a variable-length gram index.

*Vocabulary.* Words of whole texts with how often they occur, counted within tasks before they are shuffled.

*Gram dictionary.* All substrings of 2 to ``LONGEST_GRAM`` - 1 letters are counted over the vocabulary. The frequent ones, by a
threshold that grows with the vocabulary so that at most ``FREQUENT_GRAMS`` can reach it, are those worth extending: a gram ends at
the first letter that makes it infrequent. Whether it ends depends on its own letters only.

*Decomposition.* A word is read from both ends into grams, each as long as it must be to be infrequent, up to a cap:
two grams from the left (the second starts where the first ends) and two from the right. One edit changes only
the grams it falls into or before which it shifts the reading.

*Affected grams.* Caps depend on the length of the shorter word of a pair, and are such that the two left grams do not
reach into the first right one, nor the two right grams into the first left one. A word whose inner grams do not overlap
either has at most one gram that an edit changes: three of four are shared, so its two left or its two right
grams are whole in the other word too. Where they overlap, an edit may change two, and the two outer grams may be all that is
left. The bound is worked out for each word (``most_affected``).

*List merging.* The lists of words with a gram are merged two by two, as a join on both grams of a pair, within one class
of lengths: left with left, right with right, and, only for words whose bound is two, outer with outer. No list of a
frequent gram is read alone. The words that meet are verified with the exact distance.

Forms are followed to their roots by pointer jumping: as each form is ``RATIO`` times as frequent as its word, the
number of steps is known beforehand.

Defined results: null and empty texts have no words; a null ``doc_id`` is written as nothing in what is hashed; repeated
rows count each; very long words are words; ties go to the word that is smaller in code-point order; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_value
from ledgerloom.session import cut

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
#: one run in so many has a letter deleted, by its hash
DELETED_EVERY = 31
LONGEST_GRAM = 7
FREQUENT_GRAMS = 65_536

_HELD = 200_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _flushed(counts: Counter, names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], list(names))


def _word_counter(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        # shorter runs cannot give words, as letters only go
        runs = re.compile(f"[{LETTERS}]{{{least},}}").findall
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                own: Counter = Counter()
                for word, n in Counter(runs(text or "")).items():
                    own[word.lower() if word.isascii() else word.translate(_LOWER)] += n
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % DELETED_EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) > _HELD:
                    yield _flushed(counts, ("word", "n"))
                    counts.clear()
        if counts:
            yield _flushed(counts, ("word", "n"))

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of every word of (doc_id, text), kept on shared storage."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_word_counter(least_letters), "word string, n long")
    return cut(found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


def _gram_counter(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            for size in range(2, LONGEST_GRAM):
                counts.update([word[i : i + size] for i in range(len(word) - size + 1)])
            if len(counts) > _HELD:
                yield _flushed(counts, ("gram", "n"))
                counts.clear()
    if counts:
        yield _flushed(counts, ("gram", "n"))


def frequent_grams(words: DataFrame, at_most: int = FREQUENT_GRAMS) -> frozenset[str]:
    """The grams worth extending: no more than ``at_most``, as each has more than that share of all occurrences."""
    counts = cut(words.select("word").mapInArrow(_gram_counter, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r["gram"] for r in counts.filter(F.col("n") > total / at_most).select("gram").collect())


def caps(length: int) -> tuple[int, int]:
    """The longest outer and inner grams of words of this length (the shorter one's of a pair)."""
    outer = min((length + 1) // 3, LONGEST_GRAM)
    return outer, min(length - 2 * outer, LONGEST_GRAM)


def decompose(word: str, frequent: frozenset[str], outer: int, inner: int) -> tuple[int, int, int, int]:
    """Where the first and second gram from the left end, and where the second and first from the right begin."""
    ends, at = [], 0
    for cap in (outer, inner):
        end = at + min(2, cap)
        while end - at < cap and word[at:end] in frequent:
            end += 1
        ends.append(end)
        at = end
    begins, at = [], len(word)
    for cap in (outer, inner):
        begin = at - min(2, cap)
        while at - begin < cap and word[begin:at] in frequent:
            begin -= 1
        begins.append(begin)
        at = begin
    return ends[0], ends[1], begins[1], begins[0]


def most_affected(left2: int, right2: int) -> int:
    """How many of a word's four grams one edit can change: two where the inner grams overlap, else one."""
    return 2 if left2 > right2 else 1


def _lister(frequent: frozenset[str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            keys, longer, words = [], [], []
            for word in batch.column(0).to_pylist():
                # once for partners of this length or longer, once as the longer word of a pair
                for length in (len(word), len(word) - 1):
                    if length >= least:
                        left, left2, right2, right = decompose(word, frequent, *caps(length))
                        own = [f"l{length} {word[:left]} {word[left:left2]}", f"r{length} {word[right2:right]} {word[right:]}"]
                        if most_affected(left2, right2) > 1:
                            own.append(f"o{length} {word[:left]} {word[right:]}")
                        keys.extend(own)
                        longer.extend([length < len(word)] * len(own))
                        words.extend([word] * len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(longer, pa.bool_()), pa.array(words, pa.string())], ["key", "longer", "word"]
            )

    return run


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """word and near: every pair of words that differ by exactly one letter inserted, deleted or replaced, both ways."""
    if least_letters < 4:
        raise ValueError("grams from both ends need words of four letters or more")
    frequent = frequent_grams(words)
    lists = words.select("word").mapInArrow(_lister(frequent, least_letters), "key string, longer boolean, word string")
    short = lists.filter(~F.col("longer")).select("key", F.col("word").alias("a"))
    both = lists.select("key", F.col("word").alias("b"), F.col("longer").alias("_longer"))
    met = short.join(both, "key").filter((F.col("_longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    pairs = cut(met.select("a", "b").distinct())
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"))
    )


def _roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """word and root for words with a form. A chain of forms has at most log(most) steps, and every round doubles its reach."""
    reach, steps = 1, max(1, math.floor(math.log(max(most, ratio), ratio)) + 1)
    roots = forms.select("word", F.col("form").alias("root"))
    while reach < steps:
        onward = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        roots = cut(roots.join(onward, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")))
        reach *= 2
    return roots


def variants(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of (doc_id, text).

    A word's form is its most frequent near word if that is at least ``ratio`` (2 or more) times as frequent.
    """
    words = vocabulary(docs, least_letters, least_count)
    near = near_words(words, least_letters).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    found = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    found = found.withColumn("form_n", F.when(form_n >= ratio * F.col("n"), form_n))
    found = cut(
        found.select(
            "word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
        )
    )
    most = found.agg(F.max("n")).first()[0] or 1
    roots = _roots(found.filter("form is not null"), most, ratio)
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


by_value(__name__)
