"""Toxicity classifier, regularised by counterfactuals.

Logistic regression on which words and word beginnings a text has. For every labelled text that names
a group, the identity terms are swapped with those of another group, and the training loss grows
with the square of the difference of the two scores. So a term that only says whom a text speaks
of cannot carry weight, and neutral mentions of a group do not turn into false positives.

Training takes a bounded sample of labelled rows: ``max_rows``, half of them at most of each label,
those with the smallest hash of their id. Both labels are counted over all usable rows, and each sampled row weighs
as many rows as it stands for, so scores follow the share of toxic labels, not how many rows were left out. Their features are made in parallel, one task fits the weights,
and the model is at most ``MAX_FEATURES`` numbers, an eighth of the sample's rows if that is less. Scoring is one pass over whole texts without a shuffle.

Defined results: a null or empty text gets the model's base score; labels that are null are not used,
a row labelled twice counts as toxic if either label is; without any label, or with labels of one kind
only, every text gets the share of toxic labels (0 if there is none); repeated rows get the same score;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_value, text_of

#: Identity terms that are swapped: each row's terms stand for one another.
IDENTITY_TERMS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("she", "he"), ("mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "atheist"), ("muslims", "christians", "jews", "hindus", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("trans", "cis"),
    ("immigrant", "native"), ("immigrants", "natives"), ("disabled", "healthy"), ("old", "young"),
    ("frau", "mann"), ("frauen", "männer"), ("femme", "homme"), ("femmes", "hommes"), ("mujer", "hombre"),
    ("mujeres", "hombres"), ("musulman", "chrétien", "juif"), ("musulmán", "cristiano", "judío"),
)

MAX_ROWS = 8_000
MAX_FEATURES = 4_096
PREFIXES = (4, 5, 6)
LEAST_DOCS = 3
SWAP_PENALTY = 1.0
DECAY = 2e-4
STEPS = 500
RATE = 0.1
TOXIC_AT = 0.3

_SWAP = {row[i]: row[(i + 1) % len(row)] for row in IDENTITY_TERMS for i in range(len(row))}
_NOT_WORD = str.maketrans({i: " " for i in range(128) if not chr(i).isalnum()})


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().translate(_NOT_WORD).split())


def features_of(word: str) -> list[int]:
    """A word's features: itself and its first letters, as 32-bit hashes."""
    names = [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in names]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """(label, text) to (label, features, features after the swap or null)."""
    kind = pa.list_(pa.int64())
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            plain, swapped = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                plain.append(sorted({f for w in words for f in features_of(w)}))
                other = {_SWAP.get(w, w) for w in words} if not words.isdisjoint(_SWAP) else None
                swapped.append(None if other is None else sorted({f for w in other for f in features_of(w)}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(plain, kind), pa.array(swapped, kind)], ["label", "plain", "swapped"]
            )


def fit_weights(
    labels: np.ndarray, plain: list[np.ndarray], swapped: list[np.ndarray | None], counts_as: np.ndarray | None = None
) -> dict[int, float]:
    """Weights by feature hash; -1 has the bias. Deterministic for the same rows in any order.

    ``counts_as`` has the number of rows that each row stands for, 1 if it is not given.
    """
    n = len(labels)
    if counts_as is None:
        counts_as = np.ones(n)
    whole, positive = float(counts_as.sum()), float((counts_as * labels).sum())
    if not n or labels.min() == labels.max():
        share = float(labels[0]) if n else 0.0
        return {-1: math.log(max(share, 1e-9) / max(1 - share, 1e-9))}
    # the features that tell the labels apart best
    flat = np.concatenate(plain)
    sizes = [len(p) for p in plain]
    names, inverse = np.unique(flat, return_inverse=True)
    docs = np.bincount(inverse, weights=np.repeat(counts_as, sizes), minlength=len(names))
    toxic = np.bincount(inverse, weights=np.repeat(counts_as * labels, sizes), minlength=len(names))
    gain = (toxic - docs * positive / whole) ** 2 / np.maximum(docs, 1)
    fit_for = np.flatnonzero(np.bincount(inverse, minlength=len(names)) >= min(LEAST_DOCS, max(1, n // 100)))
    most = min(MAX_FEATURES, max(64, n // 8))
    names = np.sort(names[fit_for[np.argsort(-gain[fit_for], kind="stable")[:most]]])
    if not len(names):
        return {-1: math.log(positive / (whole - positive))}

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        known = names[at] == flat
        return row[known], at[known]

    row, col = matrix(plain)
    share = counts_as / whole
    pairs = [i for i, s in enumerate(swapped) if s is not None]
    row_a, col_a = matrix([plain[i] for i in pairs])
    row_b, col_b = matrix([swapped[i] for i in pairs])
    pull = 2 * SWAP_PENALTY * counts_as[pairs] / counts_as[pairs].sum() if pairs else None
    w = np.zeros(len(names) + 1)  # the last is the bias
    w[-1] = math.log(positive / (whole - positive))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        error = (1 / (1 + np.exp(-(np.bincount(row, w[col], n) + w[-1]))) - labels) * share
        slope = np.append(np.bincount(col, error[row], len(names)) + DECAY * w[:-1], error.sum())
        if pairs:
            apart = np.bincount(row_a, w[col_a], len(pairs)) - np.bincount(row_b, w[col_b], len(pairs))
            apart *= pull
            slope[:-1] += np.bincount(col_a, apart[row_a], len(names)) - np.bincount(col_b, apart[row_b], len(names))
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        w -= RATE * (1 - t / (STEPS + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    w, bias = w[:-1], float(w[-1])
    return {int(f): float(v) for f, v in zip(names, w) if v} | {-1: bias}


def _fitter(stands_for: dict[float, float]):
    """Fits the rows, of which each counts as many as its label's number in ``stands_for``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        # features stay in arrays: as lists of numbers they would take several times the memory
        as_array = lambda x: np.array(x.values.to_numpy()) if x.is_valid else None
        rows = [(label, *map(as_array, own)) for b in batches for label, *own in zip(b.column(0).to_pylist(), b.column(1), b.column(2))]
        rows.sort(key=lambda r: (r[0], r[1].tobytes(), b"" if r[2] is None else r[2].tobytes()))
        model = fit_weights(
            np.asarray([r[0] for r in rows], float), [r[1] for r in rows], [r[2] for r in rows],
            np.asarray([stands_for[r[0]] for r in rows], float),
        )
        yield pa.RecordBatch.from_pydict({"feature": list(model), "weight": list(model.values())})

    return run


def fitting_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, dict[float, float]]:
    """label and text of at most ``max_rows`` labelled ids, and how many ids one row of each label stands for.

    An id gives one row, however often it is labelled or repeated: toxic if any of its labels says so, with the
    smallest of its texts.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("label"))
    stands_for = {r["label"]: max(1.0, r["count"] / (max_rows // 2)) for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    sample = None
    for label in (0.0, 1.0):
        part = known.filter(F.col("label") == label).orderBy(order, "doc_id").limit(max_rows // 2)
        sample = part if sample is None else sample.unionAll(part)
    texts = docs.select("doc_id", text_of().alias("text"))
    met = texts.join(F.broadcast(sample), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text"), stands_for


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict[int, float]:
    """Fits on documents (doc_id, text) with labels (doc_id, toxic), leaving out the held-out rows.

    At most ``max_rows`` labelled ids are used, one text each, so what is broadcast, gathered and fitted is bounded; each counts
    as its label's number of ids over the number taken.
    """
    rows, stands_for = fitting_rows(docs, labels, max_rows)
    featured = rows.mapInArrow(_featured, "label double, plain array<long>, swapped array<long>")
    fitted = featured.repartition(1).mapInArrow(_fitter(stands_for), "feature long, weight double")
    return {r["feature"]: r["weight"] for r in fitted.collect()} or {-1: math.log(1e-9)}


def _scorer(model: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        weights, bias = dict(model), model[-1]
        of_word: dict[str, tuple[int, ...]] = {}
        for whole in batches:
            scores = []
            for at in range(0, whole.num_rows, 512):
                for text in whole.column(1).slice(at, 512).to_pylist():
                    active: set[int] = set()
                    for word in words_of(text):
                        known = of_word.get(word)
                        if known is None:
                            if len(of_word) >= 100_000:
                                of_word.clear()
                            known = of_word[word] = tuple(f for f in features_of(word) if f in weights)
                        if known:
                            active.update(known)
                    z = bias + math.fsum(weights[f] for f in active)
                    scores.append(1 / (1 + math.exp(-min(max(z, -700.0), 700.0))))
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict[int, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, score double")


def reject(docs: DataFrame, model: dict[int, float], toxic_at: float = TOXIC_AT) -> DataFrame:
    """The documents that the model does not reject, with all of their columns."""
    run = _scorer(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"])
            for scored in run(iter([pair])):
                clean = [s < toxic_at for s in scored.column(1).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


by_value(__name__)
