"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are linked lists of byte runs. For each merge rank a bucket holds the list positions
whose pair has that rank; a bitmap of two levels, words of 256 ranks under one word with a bit for each
of them, tells which buckets hold something, so the next rank is a find-first-set on each level and
neither a heap of all pairs nor a scan is needed, however long a pre-token is. An entry whose pair has
changed since is stale and skipped. Pre-tokens that are new to a worker share one list and one queue.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import per_document, texts_of

#: White space as the Unicode property has it; the control characters 1C-1F are not in it.
BLANK = r"\x09-\x0d\x20\x85\xa0  -     　"
#: Pre-tokens whose ids a worker remembers.
MEMO = 800_000
#: A longer pre-token is not remembered.
MEMO_CHARS = 200
#: Code points of texts that are split at once, bytes of pre-tokens merged together, and ids that are decoded at once.
PART, TOGETHER, IDS = 1 << 20, 1 << 18, 1 << 18
#: From so many bytes on a linked list is kept in arrays.
LONG = 1 << 20


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.ranks, self.most = ranks, memo
        #: The rank queue, empty between calls: positions by rank, and bits of the ranks that have some, 256 in a word.
        self.bucket: dict[int, list[int]] = {}
        self.low = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.bits = [1 << i for i in range(max(256, len(self.low)))]
        #: All tokens' bytes, one after the other, with where each begins and its length.
        tokens = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: Ranks of single bytes and of pairs of bytes; -1: none.
        self.ones, self.twos = np.full(256, -1, np.int64), np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.ones[token[0]] = rank
            elif len(token) == 2:
                self.twos[token[0] << 8 | token[1]] = rank
        own = pattern.replace(r"[^\s", f"[^{BLANK}").replace(r"\S", f"[^{BLANK}]").replace(r"\s", f"[{BLANK}]")
        self.split = regex.compile(own).findall
        #: With such a pattern a white-space character between two visible ones begins a match, whatever surrounds it.
        self.by_word = pattern.endswith(r"| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+") and r"\n" not in pattern
        self.border = re.compile(f"(?<=[^{BLANK}])[{BLANK}](?=[^{BLANK}])").search
        #: Ids of pre-tokens asked for since half the memory was full last, and of those before.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return np.frombuffer(self.merge_all([piece])[0], "<u4").tolist()

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers.

        The pre-tokens stand one after the other in one linked list, without pairs across their borders, and share the
        queue: the order of merges matters only within each. Entries of a rank are worked on from the
        left; if a merge makes a pair of a lower rank, that one's turn comes first. The queue is written out in place.
        """
        data = b"".join(pieces)
        n = len(data)
        if not n:
            return [b""] * len(pieces)
        octets = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        first = np.zeros(n + 1, np.uint8)
        first[ends] = first[0] = 1
        rank_at = np.full(n, -1, np.int64)
        rank_at[:-1] = self.twos[octets[:-1].astype(np.int64) << 8 | octets[1:]]
        rank_at[first[1:] == 1] = -1
        order = np.argsort(rank_at, kind="stable")[np.count_nonzero(rank_at < 0) :]
        cuts = np.flatnonzero(np.diff(rank_at[order], prepend=-1))
        bucket = self.bucket
        if len(order):
            bucket.update((r, p.tolist()) for r, p in zip(rank_at[order[cuts]].tolist(), np.split(order, cuts[1:])))
        # a long list is kept in an array: its numbers are no objects then
        kept = (lambda x: x.tolist()) if n < LONG else (lambda x: array("q", x.tobytes()))
        following, previous, pair = kept(np.arange(1, n + 1)), kept(np.arange(-1, n - 1)), kept(rank_at)
        token, first, gone = kept(self.ones[octets]), first.tobytes(), bytearray(n)
        get, low, bit, top = self.ranks.get, self.low, self.bits, 0
        for rank in bucket:
            low[rank >> 8] |= bit[rank & 255]
            top |= bit[rank >> 8]
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << 8) + (bits & -bits).bit_length() - 1
            entries = bucket.pop(rank)
            bits &= bits - 1
            low[word] = bits
            if not bits:
                top &= top - 1
            if len(entries) > 1:
                entries.sort()
            for at, i in enumerate(entries):
                if pair[i] != rank:
                    continue  # stale
                lower = False
                j = following[i]
                end = following[i] = following[j]
                gone[j], token[i] = 1, rank
                pair[j] = pair[i] = -1
                if not first[end]:
                    previous[end] = i
                    new = get(data[i : following[end]])
                    if new is not None:
                        pair[i] = new
                        lower = new < rank
                        if new in bucket:
                            bucket[new].append(i)
                        else:
                            bucket[new] = [i]
                            low[new >> 8] |= bit[new & 255]
                            top |= bit[new >> 8]
                if not first[i]:
                    i = previous[i]
                    new = get(data[i:end])
                    if new is None:
                        pair[i] = -1
                    elif pair[i] != new:
                        pair[i] = new
                        lower = lower or new < rank
                        if new in bucket:
                            bucket[new].append(i)
                        else:
                            bucket[new] = [i]
                            low[new >> 8] |= bit[new & 255]
                            top |= bit[new >> 8]
                if lower and at + 1 < len(entries):
                    bucket[rank] = entries[at + 1 :]
                    low[word] |= bit[rank & 255]
                    top |= bit[word]
                    break
        alive = np.frombuffer(gone, np.uint8) == 0
        ids = np.array(token, np.int64)[alive].astype("<u4").tobytes()
        stops = (4 * np.cumsum(alive))[ends - 1] if all(pieces) else np.concatenate([[0], 4 * np.cumsum(alive)])[ends]
        stops = stops.tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def _parts(self, text: str) -> Iterator[str]:
        """The text in parts that no match crosses, so that a long text's pre-tokens are never all in memory."""
        at = 0
        while self.by_word and len(text) - at > PART:
            cut = self.border(text, at + PART)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        data = [p.encode() for p in new]
        at, size = 0, 0
        for k, piece in enumerate(data):
            size += len(piece)
            if size >= TOGETHER or k + 1 == len(data):
                found.update(zip(new[at : k + 1], self.merge_all(data[at : k + 1])))
                at, size = k + 1, 0
        return found

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        """Ids of the pre-tokens of each list; short ones are remembered."""
        used = set().union(*split)
        new = used.difference(self.known)
        if len(self.known) + len(new) > self.most // 2:
            self.before, self.known, new = self.known, {}, used
        again = set(filter(self.before.__contains__, new))  # intersection() would go through all that is remembered
        self.known.update(zip(again, map(self.before.__getitem__, again)))
        learned = self._learn(list(new - again)) if len(new) > len(again) else {}
        self.known.update(learned)
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
        for piece in [p for p in learned if len(p) > MEMO_CHARS]:
            del self.known[piece]
        if len(self.known) > self.most:
            self.known = {}  # one batch may hold more than is to be remembered
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; texts are split a few at a time, long ones part by part."""
        out: list[bytes] = []
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) > PART:
                out += self._ids(waiting)
                waiting, size = [], 0
                out.append(b"".join(self._ids([self.split(part)])[0] for part in self._parts(text)))
                continue
            waiting.append(self.split(text))
            size += len(text)
            if size > PART:
                out += self._ids(waiting)
                waiting, size = [], 0
        return out + self._ids(waiting)

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        every, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(every), IDS):
            part = every[k : k + IDS]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.flat[np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


_CODECS: dict[tuple[bytes, str], Codec] = {}


def encode_and_decode(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    memo: int = MEMO,
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the
    bytes that the ids decode to; both in lowercase hex. Special tokens are ordinary text. A null
    text is the empty text: no ids, the digest of nothing. Rows are kept as they come, repeated and
    null ids included; other columns are ignored. Nothing is shuffled.
    """
    with open(rank_path, "rb") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((data, pattern))

    def start():
        key = shared.value
        codec = _CODECS.get(key) or _CODECS.setdefault(key, Codec(load_ranks(key[0]), key[1], memo))

        def of(texts: list[str]) -> dict:
            ids = codec.encode_many(texts)
            out = {
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
            }
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            return out

        return of

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return per_document(texts_of(docs, id_col, text_col), start, schema)
