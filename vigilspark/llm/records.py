"""Token ids as length-delimited binary records with masked checksums, and an offset index.

A shard is a sequence of records: length (8 bytes), masked CRC-32C of the length (4), data, masked
CRC-32C of the data (4), all little-endian, as the common TFRecord readers expect. The data are a
document's ids as little-endian unsigned integers of the index's width. The index, a Parquet table
beside the shards, has one row a record with its shard, offset and length, so records can be read
in any order.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage, stage_root
from .common import small_side, texts_of

HEAD, TAIL = 12, 4
#: Fixed value of the record format: added to a rotated checksum.
MASK = 0xA282EAD8
#: Fixed value: the reflected polynomial of CRC-32C.
POLYNOMIAL = 0x82F63B78
#: Bytes of a piece whose checksum is formed by itself.
PIECE = 256
#: Words that a worker remembers, and cores (words without case and marks).
MEMO = 900_000
CORES = 400_000


def _table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1).astype(np.uint32)
    return crc


TABLE = _table()
#: What the lower 16 bits of a register become when two zero bytes follow.
TABLE_2 = TABLE[TABLE[np.arange(1 << 16) & 255] & 255 ^ np.arange(1 << 16) >> 8] ^ (TABLE[np.arange(1 << 16) & 255] >> np.uint32(8))


def _after_zeros(n: int) -> np.ndarray:
    """4 x 256: what each byte of a register becomes when n zero bytes follow."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(n):
            register = TABLE[register & 255] ^ (register >> np.uint32(8))
        out[k] = register
    return out


SHIFT = _after_zeros(PIECE).tolist()


def crc32c(records: list[bytes]) -> list[int]:
    """Unmasked CRC-32C of each record; all records' pieces are worked on together, two bytes at a time."""
    counts = [max(1, -(-len(r) // PIECE)) for r in records]
    rows = np.zeros((sum(counts), PIECE), np.uint8)
    flat, at = rows.reshape(-1), 0
    for record, n in zip(records, counts):
        end = (at + n) * PIECE  # zeros in front don't change a register that begins at 0
        if record:
            flat[end - len(record) : end] = np.frombuffer(record, np.uint8)
        at += n
    register = np.zeros(len(rows), np.uint32)
    for column in np.ascontiguousarray(rows.view("<u2").T):
        register = TABLE_2[(register ^ column) & 0xFFFF] ^ (register >> np.uint32(16))
    pieces, at, found = register.tolist(), 0, []
    s0, s1, s2, s3 = SHIFT
    starts: dict[int, int] = {}
    for record, n in zip(records, counts):
        crc = pieces[at]
        for piece in pieces[at + 1 : at + n]:
            crc = s0[crc & 255] ^ s1[crc >> 8 & 255] ^ s2[crc >> 16 & 255] ^ s3[crc >> 24] ^ piece
        at += n
        # the register begins with ones: their effect depends on the length only
        size = len(record)
        if size not in starts:
            starts[size] = _ones_after(size)
        found.append(crc ^ starts[size] ^ 0xFFFFFFFF)
    return found


def _ones_after(n: int) -> int:
    crc = 0xFFFFFFFF
    s0, s1, s2, s3 = SHIFT
    for _ in range(n // PIECE):
        crc = s0[crc & 255] ^ s1[crc >> 8 & 255] ^ s2[crc >> 16 & 255] ^ s3[crc >> 24]
    table = TABLE_LIST
    for _ in range(n % PIECE):
        crc = table[crc & 255] ^ (crc >> 8)
    return crc


TABLE_LIST = TABLE.tolist()


def _length_mark(size: int) -> tuple[bytes, bytes]:
    """A length and its masked checksum."""
    data, crc = size.to_bytes(8, "little"), 0xFFFFFFFF
    for byte in data:
        crc = TABLE_LIST[(crc ^ byte) & 255] ^ (crc >> 8)
    return data, masked(crc ^ 0xFFFFFFFF).to_bytes(4, "little")


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def framed(records: list[bytes]) -> list[bytes]:
    return [b"".join((*_length_mark(len(r)), r, masked(crc).to_bytes(4, "little"))) for r, crc in zip(records, crc32c(records))]


def unframed(frames: list[bytes]) -> list[bytes]:
    """The records' data; raises where a length or checksum is wrong."""
    records = [f[HEAD:-TAIL] for f in frames]
    for f, r, crc in zip(frames, records, crc32c(records)):
        if f[:HEAD] != b"".join(_length_mark(len(r))) or int.from_bytes(f[-TAIL:], "little") != masked(crc):
            raise ValueError("a record's length or checksum is wrong")
    return records


class Encoder:
    """The tokenizer's ids of a text; words between ASCII white space are encoded once and remembered.

    Fit for tokenizers whose pre-tokens never hold white space. If also every pre-token's last token
    has a mark of its own (a word-end suffix), plain Latin words are handed to the library many at a
    time, parted by blanks, and their ids are parted at the marks.
    """

    #: Marks after a plain word, which form a pre-token of their own and can't be part of a special token.
    MARKS = b".,;:!?*$%&#"
    #: Plain words: Latin letters (without the one whose small form is no single letter).
    PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch
    TOGETHER = 500

    def __init__(self, definition: str, width: int, memo: int = MEMO):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.kind, self.memo = Tokenizer.from_str(definition), f"<u{width}", memo
        self.width = width
        #: Words since half the memory was full last, and those before.
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}
        #: The same for cores, so that a word in another case or with another mark isn't encoded anew.
        self.cores: dict[bytes, bytes] = {}
        self.cores_before: dict[bytes, bytes] = {}
        parts = json.loads(definition)
        suffix = parts["model"].get("end_of_word_suffix")
        self.last = None
        if suffix and not any(w.isalpha() for w in (t["content"] for t in parts["added_tokens"])):
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.joined, self.lowers = Tokenizer.from_str(definition), False
        self.special = [t["content"].lower().encode() for t in parts["added_tokens"]]
        steps = (parts.get("normalizer") or {}).get("normalizers", [])
        if [step["type"] for step in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " ":
            self.joined.normalizer = normalizers.Lowercase()  # composed words between single blanks: the other steps change nothing
            self.lowers = True

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of plain words."""
        texts = [" ".join(words[k : k + self.TOGETHER]) for k in range(0, len(words), self.TOGETHER)]
        found: list[bytes] = []
        for e in self.joined.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, self.kind)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.width).tolist()
            data = ids.tobytes()
            found += [data[a:b] for a, b in zip([0, *ends], ends)]
        return found if len(found) == len(words) else self._alone(words)

    def _learn(self, new: set[bytes]) -> None:
        others, plain, cores, marks = [], [], [], []
        for word in new:
            core = word.rstrip(self.MARKS)
            if self.last is not None and (core.isalpha() or core and self._latin(core.decode())):
                plain.append(word)
                marks.append(word[len(core) :])
                cores.append(core if not self.lowers else core.lower() if core.isascii() else core.decode().lower().encode())
            else:
                others.append(word)
        self.words.update(zip(others, self._alone([w.decode() for w in others])))
        tails = list(set(marks) - self.tails.keys())
        self.tails.update(zip(tails, self._alone([t.decode() for t in tails])))
        used = set(cores)
        if len(self.cores) + len(used) > CORES // 2:
            self.cores_before, self.cores = self.cores, {}
        again = list(filter(self.cores_before.__contains__, used))
        self.cores.update(zip(again, map(self.cores_before.__getitem__, again)))
        distinct = list(used.difference(self.cores))
        self.cores.update(zip(distinct, self._together([c.decode() for c in distinct])))
        self.words.update(zip(plain, map(add, map(self.cores.__getitem__, cores), map(self.tails.__getitem__, marks))))
        if len(self.cores) > CORES:
            self.cores = {}  # as for words

    def _latin(self, text: str) -> bool:
        return self.PLAIN(text) is not None and unicodedata.is_normalized("NFC", text)

    def _words(self, text: str) -> list[bytes]:
        """The text's words, in lower case where the tokenizer lowers them anyway: not with marks that combine with
        a small letter only, and not if that would make a special token."""
        data = text.encode()
        if self.lowers:
            lowered = data.lower()
            if not (b"\xcc" in lowered or b"\xcd" in lowered or any(t in lowered for t in self.special)):
                return lowered.split()
        return data.split()

    def ids(self, texts: list[str]) -> list[bytes]:
        split = list(map(self._words, texts))
        used = set().union(*split)
        new = used.difference(self.words)
        if len(self.words) + len(new) > self.memo // 2:
            self.before, self.words, new = self.words, {}, used
        again = set(filter(self.before.__contains__, new))  # intersection() would go through all that is remembered
        self.words.update(zip(again, map(self.before.__getitem__, again)))
        if len(new) > len(again):
            self._learn(new - again)
        found = self.words.__getitem__
        out = [b"".join(map(found, ws)) for ws in split]
        if len(self.words) > self.memo:
            self.words = {}  # one batch of long texts may hold more words than are to be remembered
        return out


_ENCODERS: dict[str, Encoder] = {}


def write_records(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None
) -> DataFrame:
    """Writes shards and index below ``path``; returns the index (doc_id, shard, offset, length, n_tokens, width).

    Texts are range-partitioned by doc_id, sorted, encoded and written, so shard order and order within
    a shard are ascending doc_id (null ids first, equal ids by their text). A null text is the empty
    text: only the end id. An empty table gives an empty index and no shard. Shards are written under a task's
    own name and moved, so a repeated task leaves one whole shard, and the index names it.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    from tokenizers import Tokenizer

    size = Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True)
    width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(definition)
    id_type = docs.schema[id_col].dataType.simpleString()
    last = np.array([end_id], f"<u{width}").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = shared.value
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(key, width))
        fs, root = pa.fs.FileSystem.from_uri(_uri(path))
        shard, out, at = None, None, 0
        temporary = f"{root}/_{uuid.uuid4().hex}"
        index = []
        for batch in batches:
            if out is None:
                from pyspark import TaskContext

                shard = TaskContext.get().partitionId()
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(temporary, compression=None)
            records = [x + last for x in encoder.ids(batch.column(1).to_pylist())]
            offsets = []
            for record in framed(records):
                out.write(record)
                offsets.append(at)
                at += len(record)
            index.append(
                pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([shard] * len(records), pa.int32()),
                        pa.array(offsets, pa.int64()),
                        pa.array(map(len, records), pa.int64()),
                        pa.array([len(r) // width for r in records], pa.int64()),
                        pa.array([width] * len(records), pa.int32()),
                    ],
                    names=["doc_id", "shard", "offset", "length", "n_tokens", "width"],
                )
            )
        if out is not None:
            out.close()
            target = f"{root}/{_shard(shard)}"
            if fs.get_file_info(target).type != pa.fs.FileType.NotFound:
                fs.delete_file(target)  # of an attempt that was repeated; not every store replaces on a move
            fs.move(temporary, target)
            yield from index  # only once the shard is whole

    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the texts are shuffled, not their ids: the sample for the ranges would else encode everything twice
    ordered = texts_of(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(write, f"doc_id {id_type}, shard int, offset bigint, length bigint, n_tokens bigint, width int")
    written.write.mode("error").parquet(f"{path}/index")
    return spark.read.schema(written.schema).parquet(f"{path}/index")


def _uri(path: str) -> str:
    return path if ":" in path else f"file://{path}"


def _shard(number: int) -> str:
    return f"shard-{number:06d}.rec"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, data, width) of every record, read by the index from the shards.

    ``start`` is the number of ids in all records before it. Checksums and lengths are verified. The
    records are dealt out evenly, whatever the shards' sizes; the counts before each shard are one
    row a shard.
    """
    index = spark.read.parquet(f"{path}/index")
    id_type = index.schema["doc_id"].dataType.simpleString()
    totals = stage(index.groupBy("shard").agg(F.sum("n_tokens").alias("total")), "totals")
    before = totals.select(
        F.col("shard").alias("its"), F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    placed = placed.join(small_side(before, totals.count()), F.col("shard") == F.col("its")).select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "shard", "offset", "length", "width"
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(_uri(path))
        name, file = None, None
        for batch in batches:
            frames = []
            for shard, offset, length in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{root}/{_shard(shard)}")
                file.seek(offset)
                frames.append(file.read(HEAD + length + TAIL))
            data = pa.array(unframed(frames), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), data, batch.column(6)], names=["doc_id", "start", "n_tokens", "data", "width"])
        if file is not None:
            file.close()

    spread = placed.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    return spread.mapInArrow(fetch, f"doc_id {id_type}, start bigint, n_tokens bigint, data binary, width int")


def record_digests(records: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): crc32 of a record's ids as little-endian unsigned 32-bit integers."""
    id_type = records.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, widths = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(data, widths)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return records.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def records_folder(spark: SparkSession) -> str:
    return f"{stage_root(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
