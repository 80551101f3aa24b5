"""Secret scans: pattern hits, plus encoded keys and tokens confirmed by their structure.

Patterns find assignments, cloud access ids and long hex runs. Runs of base64 or hex are decoded and
reported only if their inside is that of a key or token: DER keys whose nested lengths add up,
length-prefixed SSH key fields, or signed tokens whose header is a JSON object that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_document, texts_of

#: Kinds in the order in which spans that start together are listed; the first three are patterns.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
#: Part of the contract: an assignment's group 2, an access id and a hex run have so many characters at least.
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# greedy runs: a shorter run has no longer part, so asking for the length here drops what fails, and no more
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Where a key can begin: at a run's start (the letter of a written line end is no part of it), with the first
#: bytes of a sequence, a private-key container or a public key's type, in base64 or hex.
_STARTS = r"(?:M[A-P]|30|b3Bl|6[fF]70|AAAA[BCE]|000000)[A-Za-z0-9+/_-]{11,}"
START = re.compile(rf"(?<![A-Za-z0-9+/_-]){_STARTS}|(?<=\\[nr]){_STARTS}")
#: The lines of a wrapped block, and what ends a line, also as JSON and env files write it; the next may be indented.
LINE = re.compile(r"(?!-----)[A-Za-z0-9+/_-]+")
LINE_END = re.compile(r"(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*")
#: Characters at a key's start that tell whether it can be one, and the bytes that a key takes at least.
HEAD, LEAST = 48, 40
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
#: Fields that a public key has at least, by its type.
FIELDS = dict(zip(SSH_TYPES, (3, 5, 2, 3, 3, 3)))
#: Public-key standards 5 and 12, under which encrypted private keys name their algorithm.
ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))
OPENSSH = b"openssh-key-v1\0"
SEQUENCE, INTEGER, BITS, OCTETS, OID = 0x30, 0x02, 0x03, 0x04, 0x06


def _unbase64(text: str) -> bytes | None:
    """Bytes of a base64 or base64url text, padded or not."""
    body = re.sub(r"[\r\n]", "", text).rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly; None if the lengths don't add up."""
    found = []
    while at < end:
        if end - at < 2:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 128:
            n = size & 127
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 128:
                return None
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    """A private or public key: PKCS#1, SEC1, PKCS#8 (encrypted or not) or subject public key, with all lengths adding up."""
    if len(data) < LEAST or data[0] != SEQUENCE:
        return False
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    parts = der_items(data, outer[0][1], outer[0][2])
    if not parts or len(parts) < 2:
        return False
    tags = [tag for tag, _, _ in parts]
    if tags[0] == INTEGER:
        if set(tags) == {INTEGER}:  # RSA or DSA numbers, private or public
            return len(tags) in (2, 6, 9) and max(b - a for _, a, b in parts) >= 32
        if tags[1] == OCTETS:  # SEC1
            return data[parts[0][1] : parts[0][2]] == b"\x01" and parts[1][2] - parts[1][1] in (20, 24, 28, 32, 48, 66)
        if len(tags) >= 3 and tags[1] == SEQUENCE and tags[2] == OCTETS:  # PKCS#8
            return _has_algorithm(data, parts[1])
        return False
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8
        inside = der_items(data, parts[0][1], parts[0][2])
        return bool(inside) and inside[0][0] == OID and data[inside[0][1] : inside[0][2]].startswith(ENCRYPTED)
    return tags == [SEQUENCE, BITS] and _has_algorithm(data, parts[0])


def _has_algorithm(data: bytes, part: tuple[int, int, int]) -> bool:
    inside = der_items(data, part[1], part[2])
    return bool(inside) and inside[0][0] == OID and inside[0][2] - inside[0][1] >= 3


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that begin with a key type and fill the data, or a private-key container."""
    if data.startswith(OPENSSH):
        at, fields = len(OPENSSH), 0
        while fields < 3 and at + 4 <= len(data):
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            fields += 1
        return fields == 3 and at <= len(data)
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if size > len(data) - at - 4:
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and fields[0] in SSH_TYPES and all(fields[1:])


def is_signed_token(text: str) -> bool:
    """header.payload.signature with a JSON header that names an algorithm and a JSON object inside."""
    head, body, _ = text.split(".", 2)
    try:
        header = json.loads(_unbase64(head) or b"")
        payload = json.loads(_unbase64(body) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def _decoded(text: str) -> Iterator[tuple[int, int, str]]:
    if "eyJ" in text:
        for m in JWT.finditer(text):
            if is_signed_token(m[0]):
                yield m.start(), m.end(), "jwt"
    covered = 0
    for m in START.finditer(text):
        found = _key_at(text, *m.span()) if m.start() >= covered else None
        if found:
            covered = found[0]
            yield m.start(), *found


def _lines(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, end with padding) of the block's lines: lines of equal length and one last, shorter line, as keys are wrapped."""
    full = end - start
    while True:
        padded = end + (2 if text.startswith("==", end) else text.startswith("=", end))
        yield start, end, padded
        gap = LINE_END.match(text, end) if padded == end and end - start == full else None
        line = LINE.match(text, gap.end()) if gap else None
        if not line or len(line[0]) > full:
            return
        start, end = line.span()


def _key_at(text: str, start: int, end: int) -> tuple[int, str] | None:
    """(end, kind) of the key that begins at ``start`` and ends with a line.

    Lengths inside the key tell how many lines it takes, and no more are looked at. Only a private-key
    container, whose end isn't told by its head, takes the whole block or as many of its lines as confirm it.
    """
    for decode, bits, unit in ((_unhex, 4, 2), (_unbase64, 6, 4)):
        shown = min(end - start, HEAD)
        head = decode(text[start : start + shown - shown % unit]) or b""
        if len(head) < 6:
            continue
        if head.startswith(OPENSSH[: len(head)]):
            lines = list(_lines(text, start, end))
            body = "".join(text[a:b] for a, b, _ in lines)
            for a, b, padded in reversed(lines):
                if kind := _key_kind(decode(body)):
                    return padded, kind
                body = body[: len(body) - (b - a)]
            continue
        if not _may_be_key(head):
            continue
        parts, chars, (ends, known) = [], 0, _ends(head)
        for a, b, padded in _lines(text, start, end):
            parts.append(text[a:b])
            chars += b - a
            while head[0] != SEQUENCE and chars * bits // 8 >= known + 4:  # a further length has come in sight
                body = "".join(parts)
                ends, more = _ends(decode(body[: len(body) - len(body) % unit]) or b"")
                if more == known:
                    break
                known = more
            if any(chars == -(-8 * size // bits) for size in ends):
                kind = _key_kind(decode("".join(parts)))
                if kind:
                    return padded, kind
            if (len(text) - start) * bits < 8 * known or (head[0] == SEQUENCE and chars * bits >= 8 * known):
                break
    return None


def _may_be_key(head: bytes) -> bool:
    """A sequence that begins with a number or a sequence, or the length and name of a public key's type."""
    if head[0] == SEQUENCE:
        n = head[1] & 127 if head[1] >= 128 else 0
        return n <= 4 and _der_size(head) >= LEAST and head[2 + n : 3 + n] in (bytes([INTEGER]), bytes([SEQUENCE]), b"")
    return any((len(t).to_bytes(4, "big") + t).startswith(head[: 4 + len(t)]) for t in SSH_TYPES)


def _ends(data: bytes) -> tuple[list[int], int]:
    """Where the key may end, and how far its lengths are known: a sequence's end, or those of a public key's
    fields from the number on that its type has."""
    if data[:1] == bytes([SEQUENCE]):
        return [_der_size(data)], _der_size(data)
    at, ends = 0, []
    while at + 4 <= len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        ends.append(at)
    name = data[4 : ends[0]] if ends and ends[0] <= len(data) else b""
    return ends[FIELDS[name] - 1 :] if name in FIELDS else [], at


def _der_size(head: bytes) -> int:
    """Bytes of the outer value with its tag and length."""
    n = head[1] & 127 if head[1] >= 128 else 0
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def _unhex(text: str) -> bytes | None:
    if len(text) % 2 or not re.fullmatch(r"[0-9A-Fa-f]+", text):
        return None
    return bytes.fromhex(text)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern hits, in order of start, then kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def all_spans(text: str, base: list[tuple[int, int, str]] | None = None) -> list[tuple[int, int, str]]:
    return sorted([*(base_spans(text) if base is None else base), *_decoded(text)], key=_order)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each covered stretch replaced by its first span's kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans and, if asked for, the redacted text.

    base_sha256 is the digest of the pattern hits as kind:start:end (code points, end exclusive), in
    order of start, then kind, joined by commas; spans lists all hits likewise, the confirmed ones
    (jwt, der, ssh) included. A null text is the empty text: counts 0, the digest of nothing, no
    spans. Rows are kept as they come, repeated and null ids included; other columns are ignored.
    Nothing is shuffled; each pattern passes over a text once.
    """

    def start():
        def of(texts: list[str]) -> dict:
            base = list(map(base_spans, texts))
            every = [all_spans(t, b) for t, b in zip(texts, base)]
            joined = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
            out = {f"n_{k}": pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]}
            out |= {
                "base_sha256": pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
                "spans": pa.array([joined(b) for b in every], pa.string()),
            }
            if with_text:
                out["redacted"] = pa.array([redacted(t, s) for t, s in zip(texts, every)], pa.string())
            return out

        return of

    schema = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string" + ", redacted string" * with_text
    return per_document(texts_of(docs, id_col, text_col), start, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``documents`` with secrets replaced in the text and n_chars counted anew; every row and column stays.

    A null text stays null. Rows without a hit are unchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = batch.column(k).to_pylist()
            clean = [t if t is None else redacted(t, all_spans(t)) for t in texts]
            yield batch.set_column(k, batch.schema.field(k), pa.array(clean, batch.schema.field(k).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", _counted(docs)) if "n_chars" in docs.columns else out


def _counted(docs: DataFrame) -> Column:
    return F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
