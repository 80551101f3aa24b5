"""Encoders and counters against the libraries whose results they must give."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from vigilspark.llm.byte_bpe import Codec, encode_and_decode, load_ranks
from vigilspark.llm.queries import BYTE_BPE, PIECE_BPE, WORD_BPE
from vigilspark.llm.records import Encoder, crc32c, framed, read_records, record_digests, unframed, write_records
from vigilspark.llm.token_counts import Counter, PieceModel, token_counts

PARTS = [
    " ", "\n", "\t", "a", "b", "é", "ß", "1", "'s", "'", "the", "  ", "\x1c", "　", "\xa0", "日本", "😀", "!", "ſ", "\r\n", "é", "\x85",
    "​", "Don't", "<|endoftext|>", "<|EndOfText|>", "Σ", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "\0", "İ", "́",
]


def texts(n=1500):
    draw = random.Random(5)
    return ["".join(draw.choices(PARTS, k=draw.randint(0, 14))) for _ in range(n)] + [t or "" for t in ODD]


@pytest.fixture(scope="module")
def ranks():
    with open(P.path(BYTE_BPE), "rb") as f:
        return load_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(ranks, reference):
    codec = Codec(ranks, P.PATTERN, memo=50)  # a small memory, so that it is emptied many times
    long = ["a" * 20_000, "ab" * 5000, " " * 3000, "é" * 3000, "abcabcd" * 999, "AAAAAAAAbbbb" * 700]
    for text in texts() + long:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), text[:40]
        assert codec.decode(ids) == text.encode()
    assert not codec.bucket and not any(codec.low)  # the queue ends empty
    every = texts() + long
    assert codec.encode_many(every) == [codec.encode(t) for t in every]


def test_a_long_text_is_split_in_parts(ranks, reference, monkeypatch):
    monkeypatch.setattr("vigilspark.llm.byte_bpe.PART", 50)
    monkeypatch.setattr("vigilspark.llm.byte_bpe.LONG", 30)
    codec = Codec(ranks, P.PATTERN)
    draw = random.Random(9)
    for text in ["".join(draw.choices(PARTS, k=300)) for _ in range(60)] + ["a b " * 100, "x" * 400, " \n a" * 90]:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text), text[:40]


def test_more_ranks_than_two_bytes_hold():
    """A vocabulary of 100,000 ranks; the upper word of the queue grows with it."""
    draw = random.Random(3)
    ranks = {bytes([k]): k for k in range(256)}
    known = list(ranks)
    while len(ranks) < 100_000:
        ranks.setdefault(new := draw.choice(known) + draw.choice(known), len(ranks))
        if len(new) < 6:
            known.append(new)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = Codec(ranks, P.PATTERN)
    for _ in range(30):
        text = "".join(chr(draw.randrange(32, 500)) for _ in range(200))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_byte_bpe_with_another_pattern(ranks):
    pattern = r"\p{L}+|\s+|[^\s\p{L}]"
    codec = Codec(ranks, pattern)
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in texts(300):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == other.encode_ordinary(text), text


def test_byte_bpe_documents(spark, odd_documents, no_documents, reference):
    found = encode_and_decode(odd_documents, P.path(BYTE_BPE), P.PATTERN, with_ids=True).collect()
    wanted = []
    for row in odd_documents.select("doc_id", "text").collect():
        ids = reference.encode_ordinary(row["text"] or "")
        wanted.append((row["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert encode_and_decode(no_documents, P.path(BYTE_BPE), P.PATTERN).count() == 0


@pytest.mark.parametrize("memo", [20, 100_000])
def test_counts_equal_the_library(memo):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path(PIECE_BPE))
    with open(P.path(PIECE_BPE), "rb") as f:
        counter = Counter(PieceModel.parse(f.read()), memo)
    for text in texts() + ["a" * 20_000, "ab" * 5000, " " * 3000, "é" * 3000, "日" * 999]:
        assert counter.count(text) == len(library.encode(text)), text[:40]


def test_counts_of_documents(spark, odd_documents, no_documents):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path(PIECE_BPE))
    found = token_counts(odd_documents, P.path(PIECE_BPE), limit=100).collect()
    wanted = [(r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "")), n > 100) for r in odd_documents.collect()]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert token_counts(no_documents, P.path(PIECE_BPE)).count() == 0


def test_checksums():
    assert crc32c([b"123456789", b"", b"a"]) == [0xE3069283, 0, 0xC1D04330]  # published check values
    blocks = [bytes(range(256)) * k + b"tail" for k in (1, 2, 5)]
    assert unframed(framed(blocks)) == blocks
    broken = bytearray(framed(blocks)[0])
    broken[20] ^= 1
    with pytest.raises(ValueError, match="wrong"):
        unframed([bytes(broken)])


@pytest.mark.parametrize("which", ["odd", "plain", "none"])
def test_record_files(spark, odd_documents, no_documents, tmp_path, which):
    library = Tokenizer.from_file(P.path(WORD_BPE))
    plain = spark.createDataFrame([(i * 7 % 101, t) for i, t in enumerate(texts(90))], "doc_id bigint, text string")
    docs = {"odd": odd_documents, "plain": plain, "none": no_documents}[which]
    folder = str(tmp_path / "records")
    write_records(docs, folder, P.path(WORD_BPE), 2, shards=5)
    records = read_records(spark, folder)
    found = sorted(map(tuple, record_digests(records).collect()), key=lambda r: r[1])
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    wanted, at = [], 0
    for row in rows:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids + [2]
        wanted.append((row["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == wanted


def test_rank_file_lines():
    assert load_ranks(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"ab") + b" 1\n") == {b"a": 0, b"ab": 1}


def test_lowered_words_give_the_librarys_ids():
    """Case, marks that combine with small letters only, and special tokens in other cases."""
    with open(P.path(WORD_BPE), encoding="utf-8") as f:
        definition = f.read()
    library, encoder = Tokenizer.from_str(definition), Encoder(definition, 2, 60)
    draw = random.Random(8)
    parts = [*PARTS, "H̱", "J̌ALO", "ÁB", "<|ENDOFTEXT|>", "<|startoftext|>", "ÉCOLE", "Word", "WORD,", "word.", "ŸES", "ẞ", "Ω"]
    every = [" ".join(draw.choices(parts, k=draw.randint(0, 8))) for _ in range(800)]
    found = [np.frombuffer(x, "<u2").tolist() for k in range(0, 800, 40) for x in encoder.ids(every[k : k + 40])]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in every]
