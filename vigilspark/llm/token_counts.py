"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A piece vocabulary (SentencePiece BPE with byte fallback) gives every mergeable string a score.
The text's symbols form a linked list; a heap holds the adjacent pairs that are pieces, best score
first and leftmost first among equals; a popped pair whose symbols have changed since is skipped.
The count is the initial symbols minus the merges, where a symbol that is no piece counts as its
UTF-8 bytes. No piece has a space mark after another symbol, so no merge crosses the start of a
word: words are counted one by one and repeated words are looked up.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, per_document, texts_of

SPACE = "▁"
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5
#: Words remembered by a worker.
MEMO = 400_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            else:
                size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    scores: dict[str, float]
    dummy_prefix: bool

    @staticmethod
    def parse(data: bytes) -> "PieceModel":
        """Reads a .model file; raises on what this counter doesn't cover (other types, character maps)."""
        scores: dict[str, float] = {}
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, NORMAL)
                if kind in (USER_DEFINED, UNUSED):
                    raise ValueError("user-defined and unused pieces are not supported")
                if kind == NORMAL:
                    scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0]
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("a BPE model with byte fallback is needed")
        if normalizer.get(2, b"") or normalizer.get(4, 1):
            raise ValueError("a model that keeps characters and white space as they are is needed")
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("a piece crosses the start of a word")
        return PieceModel(scores, bool(normalizer.get(3, 1)))


def count_symbols(text: str, scores: dict[str, float]) -> int:
    """Tokens of one stretch of text that merges don't leave."""
    n = len(text)
    if text in scores and n <= 2:
        return 1
    following = list(range(1, n + 1))
    previous = list(range(-1, n - 1))
    get = scores.get
    heap = []
    for i in range(n - 1):
        score = get(text[i : i + 2])
        if score is not None:
            heap.append((-score, i, i + 2))
    heapify(heap)
    merges = 0
    dead = bytearray(n)
    while heap:
        _, i, end = heappop(heap)
        if dead[i]:
            continue
        j = following[i]
        if j >= n or following[j] != end:
            continue  # stale: one of both has grown since
        merges += 1
        dead[j] = 1
        following[i] = end
        if end < n:
            previous[end] = i
            score = get(text[i : following[end]])
            if score is not None:
                heappush(heap, (-score, i, following[end]))
        before = previous[i]
        if before >= 0:
            score = get(text[before:end])
            if score is not None:
                heappush(heap, (-score, before, end))
    total, i = n - merges, 0
    while i < n:
        end = following[i]
        if end == i + 1 and text[i] not in scores:
            total += len(text[i].encode()) - 1
        i = end
    return total


class Counter:
    def __init__(self, model: PieceModel, memo: int = MEMO):
        self.scores, self.dummy = model.scores, model.dummy_prefix
        inside = set("".join(p for p in self.scores if len(p) > 1))
        #: Line breaks and tabs that never merge part a word without changing its count.
        self.parts = [c for c in "\n\t" if c not in inside and c not in self.scores]
        self.words = Memo(self._word, memo)
        self.runs = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def _word(self, word: str) -> int:
        pieces, alone = [word], 0
        for c in self.parts:
            cut = [x for p in pieces for x in p.split(c)]
            alone += len(cut) - len(pieces)
            pieces = cut
        return alone + sum(count_symbols(p, self.scores) for p in pieces if p)

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
        return sum(map(self.words.__getitem__, self.runs.findall(marked)))


_COUNTERS: dict[bytes, Counter] = {}


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO
) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``).

    A null text is the empty text: 0 bytes, 0 tokens. Rows are kept as they come, repeated and null
    ids included; other columns of ``docs`` are ignored. Nothing is shuffled; long words cost
    n log n. The vocabulary file is read by the driver and sent to the tasks (its size is that of
    the vocabulary, not of the data).
    """
    with open(model_path, "rb") as f:
        data = f.read()
    PieceModel.parse(data)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def start():
        key = shared.value
        counter = _COUNTERS.get(key) or _COUNTERS.setdefault(key, Counter(PieceModel.parse(key), memo))

        def of(texts: list[str]) -> dict:
            counts = list(map(counter.count, texts))
            return {
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
                "over_limit": pa.array([c > limit for c in counts], pa.bool_()),
            }

        return of

    return per_document(texts_of(docs, id_col, text_col), start, "n_bytes bigint, n_tokens bigint, over_limit boolean")
