"""SentencePiece encoding and decoding by batched Viterbi.

The pieces and their scores come from a public ``.model`` file. A text is segmented so that the sum of its
pieces' scores is largest (the unigram model); of equal segmentations the one whose last piece is longest,
from the end on. A character that no piece has costs more than any piece and is written as the
byte pieces of its UTF-8 form.

No piece has a space sign behind another character, so words are segmented apart. Each word is worked out
once and looked up after that. New words of one length advance together: prefix hashes of the whole block give the
hash of every substring, which is looked for among the sorted hashes of the pieces of that length; for each end
position the best start of all words is one vectorised maximum, which is the backpointer. Blocks have a bounded
number of cells, so one word of any length fits as well.

Encoding is one pass in Spark's tasks, without a shuffle.

Defined results: a null or empty text has no ids and decodes to the empty text; a text that has the space
sign U+2581 itself decodes to a space there, as that is what the sign stands for; repeated rows get the same ids;
very long texts and words are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_value, process_state

SPACE = "▁"
#: scores at or below this stand for "no score"; such a piece counts just below the lowest real score
PLACEHOLDER = -1e8

_CELLS = 1 << 16
_CACHED_WORDS = 400_000
_BASE = 0x9E3779B97F4A7C15


class PieceModel:
    """The piece table of a model file, ready for lookups."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        table = SentencePieceProcessor(model_file=path)
        size = table.get_piece_size()
        self.pieces = [table.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(size) if table.is_byte(i)}
        special = {i for i in range(size) if table.is_byte(i) or table.is_control(i) or table.is_unknown(i) or table.is_unused(i)}
        plain = [(p, table.get_score(i), i) for i, p in enumerate(self.pieces) if i not in special and p]
        if len(self.byte_id) != 256 or any(SPACE in p.lstrip(SPACE) for p, _, _ in plain):
            raise ValueError("needs a piece for every byte, and space signs at the start of pieces only")
        lowest = min(s for _, s, _ in plain if s > PLACEHOLDER)
        plain = [(p, s if s > PLACEHOLDER else lowest - 1.0, i) for p, s, i in plain]
        self.unknown_score = min(s for _, s, _ in plain) - 10.0
        self.longest = max(len(p) for p, _, _ in plain)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            own = [(p, s, i) for p, s, i in plain if len(p) == n]
            if own:
                points = np.frombuffer("".join(p for p, _, _ in own).encode("utf-32-le"), "<u4").reshape(-1, n)
                hashes = self._prefix_hashes(points)[:, n]
                order = np.argsort(hashes)
                if len(np.unique(hashes)) < len(own):
                    raise ValueError("two pieces have one hash")
                scores, ids = np.array([s for _, s, _ in own]), np.array([i for _, _, i in own])
                self.by_length[n] = hashes[order], scores[order], ids[order]
        self.power = np.array([pow(_BASE, n, 1 << 64) for n in range(self.longest + 1)], np.uint64)
        in_pieces = {c for p, _, _ in plain for c in p}
        self.breaks = "".join(c for c in "\n\t\r" if c not in in_pieces)
        self.known: dict[str, bytes] = {}
        self.as_bytes = [b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in self.byte_id.items():
            self.as_bytes[i] = bytes([b])
        kept_apart = re.escape(self.breaks)
        self.word = re.compile(f"[{kept_apart}]|{SPACE}+[^{SPACE}{kept_apart}]*|[^{SPACE}{kept_apart}]+" if kept_apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    @staticmethod
    def _prefix_hashes(points: np.ndarray) -> np.ndarray:
        """Polynomial hashes of every row's prefixes, modulo 2**64."""
        out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
        base = np.uint64(_BASE)
        for i in range(points.shape[1]):
            out[:, i + 1] = out[:, i] * base + (points[:, i].astype(np.uint64) + np.uint64(1))
        return out

    def _segment(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length: Viterbi over blocks of end positions."""
        rows, length, wide = len(words), len(words[0]), self.longest
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(rows, length)
        back = np.zeros((length + 1, rows), np.int8)
        found = np.zeros((length + 1, rows), np.int32)
        best = np.full((wide, rows), -np.inf)  # of the last positions before the block
        best[-1] = 0.0
        block = max(1, _CELLS // rows)
        lanes = np.arange(rows)
        for first in range(1, length + 1, block):
            last = min(length, first + block - 1)
            left = max(0, first - wide)
            hashes = self._prefix_hashes(points[:, left:last])
            score = np.full((last - first + 1, wide, rows), -np.inf)
            which = np.full((last - first + 1, wide, rows), -1, np.int32)
            for n in range(1, min(wide, last) + 1):
                from_end = max(first, n)
                ends = np.arange(from_end, last + 1) - left
                if n in self.by_length and len(ends):
                    keys, scores, ids = self.by_length[n]
                    sub = hashes[:, ends] - hashes[:, ends - n] * self.power[n]
                    at = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
                    hit = keys[at] == sub
                    score[from_end - first :, wide - n] = np.where(hit, scores[at], -np.inf).T
                    which[from_end - first :, wide - n] = np.where(hit, ids[at], -1).T
            alone = score[:, wide - 1]
            alone[np.isneginf(alone)] = self.unknown_score
            for end in range(first, last + 1):
                sums = best + score[end - first]
                start = sums.argmax(axis=0)  # the first maximum has the longest piece
                back[end] = wide - start
                found[end] = which[end - first, start, lanes]
                best = np.concatenate([best[1:], sums[start, lanes][None]])
        ends_piece = np.zeros((length + 1, rows), bool)
        at = np.full(rows, length)
        for end in range(length, 0, -1):
            here = at == end
            ends_piece[end] = here
            at = np.where(here, end - back[end].astype(np.int64), at)
        mask, ids = ends_piece.T, found.T
        counts, flat = mask.sum(axis=1), ids[mask]
        if (flat >= 0).all():
            data, out, begin = flat.astype("<u4").tobytes(), [], 0
            for n in counts.tolist():
                out.append(data[begin : begin + 4 * n])
                begin += 4 * n
            return out
        out = []
        for r, word in enumerate(words):
            own: list[int] = []
            for end in np.flatnonzero(mask[r]).tolist():
                piece = ids[r, end]
                own.extend([piece] if piece >= 0 else [self.byte_id[b] for b in word[end - 1].encode("utf-8", "surrogatepass")])
            out.append(np.asarray(own, "<u4").tobytes())
        return out

    def _learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, own in by_length.items():
            step = max(1, _CELLS // length)
            for at in range(0, len(own), step):
                self.known.update(zip(own[at : at + step], self._segment(own[at : at + step])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > _CACHED_WORDS:
            self.known.clear()
        known = self.known
        words = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if new := {w for ws in words for w in ws if w not in known}:
            self._learn(new)
        return [b"".join(map(known.__getitem__, ws)) for ws in words]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.as_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


def model_of(path: str) -> PieceModel:
    """The model, read once per worker process."""
    held = process_state("piece_models")
    return held.get(path) or held.setdefault(path, PieceModel(path))


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = model.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [model.decode(np.asarray(i or [], "<u4").tobytes()) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _digester(path: str):
    """Ids and what they decode to, digested in the task that made them: ids are not moved to be counted."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = model_of(path)
        low, high = min(model.byte_id.values()), max(model.byte_id.values())
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.slice(at, 256).column(1).to_pylist()]
                for text, ids in zip(texts, model.encode(texts)):
                    numbers = np.frombuffer(ids, "<u4")
                    same = model.decode(ids) == text.replace(SPACE, " ")
                    in_bytes = int(((numbers >= low) & (numbers <= high)).sum())
                    for column, value in zip(columns, (len(numbers), in_bytes, zlib.crc32(ids), same)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"],
            )

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids of every row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encoder(model_path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids)."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoder(model_path), "doc_id long, text string")


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row: how many ids, how many of them bytes, the ids' crc32 and whether they decode to the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_digester(model_path), "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")


by_value(__name__)
