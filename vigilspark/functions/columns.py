"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(prefix: str, *parts: Column | str, length: int = 16) -> Column:
    """Deterministic key: prefix plus the first hex digits of sha256 over the text."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def present(value: Column) -> Column:
    """True when a text is neither null nor empty (never null itself)."""
    return F.coalesce(value != "", F.lit(False))


def words_in(text: Column, words: Sequence[str]) -> Column:
    """True when the text contains any of the words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def json_list(values: Column) -> Column:
    """JSON text of an array."""
    return F.to_json(values)


def iso_text(ts: Column) -> Column:
    """ISO-8601 text of a UTC timestamp; fraction only when there is one."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(base, fraction, F.lit("+00:00"))
