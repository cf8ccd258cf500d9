"""Byte-level BPE encoding and decoding by batched merges.

The ranks come from a public ``.tiktoken`` file, the pattern that cuts a text into pieces with it. A piece that is a token
itself is that token. All others start as the tokens of their bytes and are merged: pieces of about one length in
bytes form a padded matrix of ids, one row each. In a round every row merges its leftmost pair of the lowest rank;
ranks of pairs are looked up in an open-addressing hash table, all rows at once, and only the two pairs beside a merge
anew. As each row loses one id, the matrix is compacted to one column less; rows without a pair left go out.

Matrices have a bounded number of cells. A piece longer than ``MATRIX_BYTES`` would take as many rounds over its whole width
as it has bytes; such a piece is merged in the same order from a heap instead. Each distinct piece is worked
out once and looked up after that, in two generations of bounded size. Encoding is one pass in Spark's tasks, without a shuffle.

Defined results: a null or empty text has no ids and decodes to no bytes; special tokens' strings are ordinary text;
repeated rows get the same ids; very long texts and pieces are read whole; a null ``doc_id`` stays null; an empty
table gives no rows; other columns are not read. Decoding takes ids of the file only and fails on others; null ids are none.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import TwoGenerations, by_value, process_state

MATRIX_BYTES = 1024

_CELLS = 1 << 18
_CACHED_PIECES = 300_000
_NONE = np.iinfo(np.int32).max
#: What the classes of a pattern hold of ASCII; with them the faster engine reads a text of ASCII alone.
_ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}


class PairTable:
    """(left id, right id) -> rank of the two together, for arrays of pairs."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.full(self.mask + 1, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(self.mask + 1, _NONE, np.int32)
        self.probes, at, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):
            here = at[left]
            free = self.ranks[here] == _NONE
            placed = np.unique(here[free], return_index=True)[1]
            own = left[free][placed]
            self.keys[at[own]], self.ranks[at[own]] = keys[own], ranks[own]
            left = np.setdiff1d(left, own, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        found = np.where(self.keys[at] == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((found == _NONE) & (self.ranks[at] != _NONE))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            here = at[open_]
            hit = self.keys[here] == keys[open_]
            found[open_[hit]] = self.ranks[here[hit]]
            open_ = open_[~hit & (self.ranks[here] != _NONE)]
        return found


class BytePairs:
    """The ranks of a file, ready for encoding and decoding."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.pad = max(self.tokens) + 1
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("needs a rank for every byte")
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.any_text = regex.compile(pattern)
        self.ascii_text = re.compile(_ascii_pattern(pattern), re.ASCII)
        self.known = TwoGenerations(_CACHED_PIECES)

    def cut(self, text: str) -> list[str]:
        return (self.ascii_text if text.isascii() else self.any_text).findall(text)

    def _merge_rows(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """The ids of pieces of at most ``width`` bytes."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.full((len(rows), width), self.pad, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = self.table.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        which, out = np.arange(len(rows)), [None] * len(rows)
        while len(which):
            lanes = np.arange(len(which))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(which), np.int64)
            least = ranks[lanes, at] if ranks.shape[1] else np.full(len(which), _NONE)
            done = least == _NONE
            if done.any():
                for r, own in zip(which[done].tolist(), ids[done]):
                    out[r] = own[own != self.pad]
                going = ~done
                which, ids, ranks, at, least = which[going], ids[going], ranks[going], at[going], least[going]
                lanes = np.arange(len(which))
                if not len(which):
                    break
            ids[lanes, at] = least
            wide = ids.shape[1]
            stays = np.arange(wide) != at[:, None] + 1
            ids = ids[stays].reshape(-1, wide - 1)
            ranks = ranks[np.arange(wide - 1) != at[:, None]].reshape(-1, wide - 2)
            for beside in (at - 1, at):
                rows_ = np.flatnonzero((beside >= 0) & (beside < wide - 2))
                place = beside[rows_]
                ranks[rows_, place] = self.table.rank(ids[rows_, place], ids[rows_, place + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of pairs, and links to the ids that are left."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n, get = len(ids), self.pairs.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([i for i in ids if i >= 0], np.int32)

    def _learn(self, pieces: list[str]) -> Iterator[tuple[str, tuple[bytes, str]]]:
        """Each piece with its ids as bytes and as decimal text."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            own = piece.encode()
            whole = self.ids.get(own)
            if whole is not None:
                yield piece, (np.asarray([whole], "<u4").tobytes(), str(whole))
            elif len(own) > MATRIX_BYTES:
                yield piece, _written(self._merge_long(own))
            else:
                buckets.setdefault(_width(len(own)), []).append((piece, own))
        for width, members in buckets.items():
            step = max(1, _CELLS // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for (piece, _), ids in zip(part, self._merge_rows([own for _, own in part], width)):
                    yield piece, _written(ids)

    def encode(self, texts: list[str]) -> list[list[tuple[bytes, str]]]:
        """Of each text's pieces: the ids as little-endian unsigned 32-bit numbers and as decimal text."""
        pieces = [self.cut(t) for t in texts]
        known = self.known.holding(set().union(*pieces), self._learn)
        return [list(map(known.__getitem__, own)) for own in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _ascii_pattern(pattern: str) -> str:
    """The pattern with plain ranges for its letter and number classes, inside and outside of brackets."""
    out, depth = [], 0
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.DOTALL):
        depth += (part == "[") - (part == "]")
        plain = _ASCII.get(part)
        out.append(part if plain is None else plain if depth else f"[{plain}]")
    return "".join(out)


def _written(ids: np.ndarray) -> tuple[bytes, str]:
    return ids.astype("<u4").tobytes(), " ".join(map(str, ids.tolist()))


def _width(length: int) -> int:
    """The width of the bucket for a length: steps of about an eighth."""
    step = max(2, 1 << max(0, length.bit_length() - 3))
    return -(-length // step) * step


def ranks_of(path: str, pattern: str) -> BytePairs:
    """The ranks, read once per worker process."""
    held = process_state("byte_pairs")
    return held.get((path, pattern)) or held.setdefault((path, pattern), BytePairs(path, pattern))


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = ranks_of(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [b"".join(i for i, _ in own) for own in model.encode([t or "" for t in part.column(1).to_pylist()])]
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return run


def _decoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = ranks_of(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [model.decode(np.asarray(i or [], "<u4").tobytes()) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    return run


def _digester(path: str, pattern: str):
    """Ids and what they decode to, digested in the task that made them: ids are not moved to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = ranks_of(path, pattern)
        for batch in batches:
            columns: list[list] = [[], [], []]
            for at in range(0, batch.num_rows, 256):
                for own in model.encode([t or "" for t in batch.slice(at, 256).column(1).to_pylist()]):
                    ids = b"".join([i for i, _ in own])
                    written = " ".join([w for _, w in own])
                    columns[0].append(len(ids) // 4)
                    columns[1].append(sha256(written.encode()).hexdigest())
                    columns[2].append(sha256(model.decode(ids)).hexdigest())
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encoder(path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that the ids of every row of (doc_id, ids) stand for."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoder(path, pattern), "doc_id long, bytes binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: how many ids, the digest of their decimal text and that of the bytes they decode to."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_digester(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


by_value(__name__)
