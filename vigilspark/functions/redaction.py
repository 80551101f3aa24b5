"""Redaction of credentials in free text and in key/value maps.

One alternation replaces a whole keyword list in a single pass. That equals replacing the
keywords one after the other because the only overlap between two keywords of a list is
``secret``/``token`` (shared "t") and ``auth``/``authorization``; in both cases the keyword
that is earlier in the list also starts first in the text. ``tests/test_redaction.py``
checks this against one-by-one replacement.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

# kind -> (keywords, whether "key = value" pairs go first, whether the text is trimmed)
_KINDS = {
    "telemetry": (fv.TELEMETRY_KEYWORDS, True, False),
    "case": (fv.CASE_KEYWORDS, False, True),
    "response": (fv.RESPONSE_KEYWORDS, True, True),
    "report": (fv.CASE_KEYWORDS, False, True),
}
_BLANK = r"[\s\u001c-\u001f\u0085 ]"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+\z", "")


def redact(text: Column, kind: str = "telemetry", max_len: int | None = None) -> Column:
    """Replace credential pairs and keywords; the text is cut only where a length is given."""
    keywords, pairs, trimmed = _KINDS[kind]
    out = strip(text) if trimmed else text
    if pairs:
        out = F.regexp_replace(out, "(?iU)" + fv.PAIR_PATTERN, fv.REDACTED)
    out = F.regexp_replace(out, "(?iu)" + "|".join(keywords), fv.REDACTED)
    if trimmed:
        out = F.coalesce(out, F.lit(""))
    return out if max_len is None else F.substring(out, 1, max_len)


def _sensitive_key(key: Column) -> Column:
    return F.lower(key).rlike("|".join(fv.TELEMETRY_KEYWORDS))


#: A JSON string, a key with a sensitive word in it, and values: scalars, and containers up to four levels deep.
_STRING = r'"(?:[^"\\]|\\.)*+"'
_KEY = r'("(?:[^"\\]|\\.)*?(?:' + "|".join(fv.TELEMETRY_KEYWORDS) + r')(?:[^"\\]|\\.)*+"\s*:\s*)'
_SCALAR = rf"(?:{_STRING}|[^\s,\[\]{{}}\"]++)"


def _container(levels: int) -> str:
    inside = rf'(?:{_STRING}|[^"\[\]{{}}]' + (f"|{_container(levels - 1)}" if levels > 1 else "") + ")*+"
    return rf"(?:\{{{inside}\}}|\[{inside}\])"


def redact_json(text: Column) -> Column:
    """Redact JSON text at any depth, lists included: what stands under a sensitive key goes entirely.

    Where a container under a sensitive key is nested too deep to be told from what follows it, the
    whole text goes.
    """
    flags, put = "(?i)", f'$1"{fv.REDACTED}"'
    out = F.regexp_replace(text, flags + _KEY + _SCALAR, put)
    out = F.regexp_replace(out, flags + _KEY + _container(4), put)
    out = F.when(out.rlike(flags + _KEY + r"[\[{]"), F.lit(fv.REDACTED)).otherwise(out)
    return redact(out)


def redact_value(text: Column) -> Column:
    """Redact a value that may be JSON."""
    return F.when(F.ltrim(text).rlike(r"^[\[{]"), redact_json(text)).otherwise(redact(text))


def redact_map(values: Column) -> Column:
    """Redact a MAP<STRING,STRING>: values under a sensitive key go entirely, JSON values at any depth."""
    return F.transform_values(
        values,
        lambda k, v: F.when(_sensitive_key(k), F.lit(fv.REDACTED)).otherwise(redact_value(v)),
    )


def last_of_each_key(entries: Column) -> Column:
    """Entries whose key doesn't come again later, as a map needs them."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))


def flatten_json(text: Column, depth: int = 3) -> Column:
    """JSON object text -> array of (path, value) entries, nested objects by dotted path.

    Objects below ``depth`` and lists stay JSON text.
    """
    entries = F.coalesce(
        F.map_entries(F.from_json(text, "map<string,string>")),
        F.array().cast("array<struct<key:string,value:string>>"),
    )
    if depth <= 1:
        return entries

    def expand(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        nested = F.transform(
            flatten_json(value, depth - 1),
            lambda e: F.struct(F.concat_ws(".", key, e["key"]).alias("key"), e["value"].alias("value")),
        )
        plain = F.array(F.struct(key.alias("key"), value.alias("value")))
        return F.when(F.ltrim(value).startswith("{"), nested).otherwise(plain)

    return F.flatten(F.transform(entries, expand))
