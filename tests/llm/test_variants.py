"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import variants
from ledgerloom.llm.queries import QUERIES


def words_of(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def apart_by_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    at = next((i for i, x in enumerate(short) if x != long[i]), len(short))
    return short[at:] == long[at + 1 :]


def brute(docs):
    words = words_of(docs)
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for n, own in by_length.items():
        for a, b in itertools.chain(itertools.combinations(own, 2), itertools.product(own, by_length.get(n + 1, []))):
            if apart_by_one(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(docs)
    got = QUERIES["op13_spelling_variants"](spark, sf_dir)
    assert found(got) == expected and len(expected) > 1000 and any(v[0] for v in expected.values())


def made(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé"])
@pytest.mark.parametrize("frequent", [variants.FREQUENT_GRAMS, 20])
def test_dense_words(spark, monkeypatch, letters, frequent):
    """Words over few letters: most grams are frequent and nearly every word has neighbours."""
    monkeypatch.setattr(variants.frequent_grams, "__defaults__", (frequent,))
    rng = random.Random(f"{letters}{frequent}")
    docs = []
    for i in range(60):
        words = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 8, 9, 10, 13]))) for _ in range(30)]
        docs.append((i, " ".join(words * rng.choice([1, 2, 30]))))
    docs += [(100, "abababa " * 4000 + "abababab " * 300 + "ababababa " * 20), (None, "ABababa ÀBCDEFG àbcdefg ÀBCDEFG"), (None, None), (5, "")]
    assert found(variants.variants(made(spark, docs))) == brute(docs)


def test_chains_reach_their_root(spark):
    steps = [("abcdefgh", 2), ("abcdefghi", 20), ("abcdefghij", 200), ("abcdefghijk", 2000), ("abcdefghijkl", 20000)]
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(steps)]
    got = found(variants.variants(made(spark, docs)))
    assert got == brute(docs)
    assert got["abcdefgh"][1] == "abcdefghijkl"


def test_every_edit_leaves_a_listed_pair():
    """Whatever the letters after an edit: one of the pairs that both words list is the same in both."""
    rng = random.Random(9)
    for _ in range(4000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(7, 24)))
        at, letter = rng.randrange(len(word) + 1), rng.choice("abcd")
        other = rng.choice([word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])
        if other == word:
            continue
        frequent = frozenset(w[i : i + n] for w in (word, other) for i in range(len(w)) for n in range(2, 7) if rng.random() < 0.7)
        cap = variants.caps(min(len(word), len(other)))
        lists = []
        for w in (word, other):
            left, left2, right2, right = variants.decompose(w, frequent, *cap)
            assert left2 <= right and left <= right2
            own = {("l", w[:left], w[left:left2]), ("r", w[right2:right], w[right:])}
            if variants.most_affected(left2, right2) > 1:
                own.add(("o", w[:left], w[right:]))
            lists.append(own)
        assert lists[0] & lists[1], (word, other)


def test_frequent_grams_are_bounded(spark):
    rng = random.Random(2)
    words = [("".join(rng.choice("ab") for _ in range(9)), 2) for _ in range(300)]
    df = spark.createDataFrame(words, "word string, n long").dropDuplicates(["word"])
    assert 0 < len(variants.frequent_grams(df, 25)) <= 25


def test_odd_tables(spark):
    assert variants.variants(made(spark, [])).collect() == []
    long = "x" * 30_000 + "y"
    docs = [(1, f"{long} {long}"), (2, f"{long}z"), (2, f"{long}z"), (3, "short words only")]
    assert found(variants.variants(made(spark, docs).selectExpr("*", "1 as word", "2 as n", "3 as near"))) == brute(docs)
    with pytest.raises(ValueError):
        variants.near_words(spark.createDataFrame([("abc", 2)], "word string, n long"), least_letters=3)
