"""Byte-level BPE against the library that the rank file is made for."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import bytepairs
from ledgerloom.llm.common import TwoGenerations
from ledgerloom.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def model():
    return bytepairs.BytePairs(PATH, PATTERN)


def ids_of(model, texts):
    return [np.frombuffer(b"".join(i for i, _ in own), "<u4").tolist() for own in model.encode(texts)]


def test_query_equals_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        shown = " ".join(map(str, ids)).encode()
        expected[doc_id] = (len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    got = QUERIES["op12_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(docs) and {r[0]: tuple(r)[1:] for r in got} == expected


def test_odd_texts_equal_library(model, library):
    rng = random.Random(3)
    spaces = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　​'stremvlldaZ09.,!<|endoftext|>éÀ中"
    points = [c for c in [*range(0x3400), *range(0x1F000, 0x1F900)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choice(spaces) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice(points)) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    assert ids_of(model, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces(model, library):
    rng = random.Random(4)
    texts = ["x" * 30_000, "ab" * 20_000, "a" * 1024, "b" * 1025, "".join(rng.choice("abcdeé") for _ in range(20_000)), "é" * 700]
    assert ids_of(model, texts) == [library.encode_ordinary(t) for t in texts]
    piece = "".join(rng.choice("theinatscou") for _ in range(900)).encode()
    assert model._merge_long(piece).tolist() == model._merge_rows([piece], 1024)[0].tolist()


def test_pair_table(model):
    keys = np.array(list(model.pairs), np.int64)
    assert (model.table.rank(keys[:, 0], keys[:, 1]) == np.array(list(model.pairs.values()))).all()
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, model.pad + 1, (2, 20_000))
    expected = [model.pairs.get(p, bytepairs._NONE) for p in zip(a.tolist(), b.tolist())]
    assert model.table.rank(a, b).tolist() == expected


def test_encode_and_decode_frames(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "ünï"), (4, "a" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    encoded = bytepairs.encode(docs, PATH, PATTERN)
    assert sorted((r.doc_id or 0, r.ids) for r in encoded.collect()) == sorted((i or 0, library.encode_ordinary(t or "")) for i, t in rows)
    back = bytepairs.decode(encoded, PATH, PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in back) == sorted((i or 0, (t or "").encode()) for i, t in rows)
    assert bytepairs.encode(docs.limit(0), PATH, PATTERN).collect() == [] == bytepairs.digest(docs.limit(0), PATH, PATTERN).collect()


def test_two_generations():
    asked = []

    def learn(words):
        asked.extend(words)
        return [(w, w.upper()) for w in words]

    held = TwoGenerations(3)
    for word in "a b c d a e f a g h i a".split():
        assert held.holding({word, "z"}, learn)[word] == word.upper()
    assert asked.count("z") == 1 and asked.count("a") == 1 and len(held.young) <= 5
