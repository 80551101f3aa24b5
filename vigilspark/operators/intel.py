"""Indicators and threat intelligence."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import short_id
from ..functions.redaction import strip

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}\z"


def ipv4(value: Column) -> Column:
    """The address if the text is one (no leading zeros), else null."""
    text = strip(value)
    return F.when(text.rlike(_IPV4), text)


@F.pandas_udf(T.StringType())
def _canonical_ipv6(values: pd.Series) -> pd.Series:
    """Canonical IPv6 text, one Arrow batch at a time; null in, null out."""

    def canonical(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return str(ipaddress.IPv6Address(text))
        except ValueError:
            return None

    return values.map(canonical, na_action="ignore").astype(object)


def with_ipv6(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the canonical text of an IPv6 address in column ``value``, else null.

    Only values with a colon reach Python; the others go over as nulls.
    """
    candidate = F.when(F.contains(F.col(value), F.lit(":")), strip(F.col(value)))
    return df.withColumn(out, _canonical_ipv6(candidate))


def domain(value: Column) -> Column:
    text = F.regexp_replace(F.lower(strip(value)), r"\.+\z", "")
    return F.when((F.char_length(text) <= fv.MAX_DOMAIN_LENGTH) & text.rlike(fv.DOMAIN_PATTERN), text)


def url(value: Column) -> Column:
    """http(s) URL: scheme plus 1..2000 characters without white space."""
    text = strip(value)
    body = F.regexp_replace(text, "(?i)^https?://", "")
    fits = F.char_length(body).between(1, 2000) & (F.char_length(text) <= fv.MAX_INDICATOR_LENGTH)
    return F.when(text.rlike(r"(?iU)^https?://[^\s]+\z") & fits, text)


def hash_kind(value: Column) -> Column:
    text = strip(value)
    return F.when(text.rlike(r"^[a-fA-F0-9]+\z"), F.when(F.char_length(text) == 64, "sha256").when(
        F.char_length(text) == 40, "sha1").when(F.char_length(text) == 32, "md5"))


def credential_like(value: Column) -> Column:
    return value.rlike("(?i)" + fv.CREDENTIAL_PATTERN)


def allowed_field(key: Column, value: Column) -> Column:
    """Approved, non-blank, bounded and not credential-like."""
    keys = fv.IP_KEYS + fv.DOMAIN_KEYS + fv.URL_KEYS + fv.HASH_KEYS
    return F.coalesce(
        key.isin(*keys) & (strip(value) != "") & (F.char_length(value) <= fv.MAX_INDICATOR_LENGTH)
        & ~credential_like(value) & ~credential_like(key),
        F.lit(False),
    )


def ioc_id(ioc_type: Column, value: Column) -> Column:
    return short_id("ioc-", "ioc:", ioc_type, ":", value)


def extract_iocs(events: DataFrame, *keep: str) -> DataFrame:
    """One row per valid indicator of an event, in scan order (``position``).

    Scan order: source ip, destination ip, then metadata by key.
    """
    direct = [
        F.when(F.coalesce((F.col(c) != "") & ~credential_like(F.col(c)), F.lit(False)),
               F.struct(F.lit(p).alias("position"), F.lit(c).alias("field"), F.lit("source_ip").alias("key"), F.col(c).alias("value")))
        for p, c in enumerate(("source_ip", "destination_ip"))
    ]
    entries = F.filter(F.array_sort(F.map_entries("metadata")), lambda e: allowed_field(e["key"], e["value"]))
    listed = F.transform(
        entries,
        lambda e, i: F.struct(
            (i + 2).alias("position"), F.concat(F.lit("metadata:"), e["key"]).alias("field"), e["key"].alias("key"),
            e["value"].alias("value"),
        ),
    )
    found = events.select(
        "event_id", *keep,
        F.explode(F.concat(F.array_compact(F.array(*direct)), F.coalesce(listed, F.array()))).alias("f"),
    ).select("event_id", *keep, "f.*")
    return classify_iocs(found)


def classify_iocs(found: DataFrame) -> DataFrame:
    """Type and normal form of candidate rows (``key``, ``value``); invalid ones go."""
    key, value = F.col("key"), F.col("value")
    columns = found.columns
    found = with_ipv6(found.withColumn("_address", F.when(key.isin(*fv.IP_KEYS), value)), "_address", "_ipv6")
    v4, v6 = ipv4(value), F.col("_ipv6")
    kind = (
        F.when(key.isin(*fv.IP_KEYS), F.when(v4.isNotNull(), "ipv4").when(v6.isNotNull(), "ipv6"))
        .when(key.isin(*fv.DOMAIN_KEYS), F.when(domain(value).isNotNull(), "domain"))
        .when(key.isin(*fv.URL_KEYS), F.when(url(value).isNotNull(), "url"))
        .when(key.isin(*fv.HASH_KEYS), hash_kind(value))
    )
    normal = (
        F.when(key.isin(*fv.IP_KEYS), F.coalesce(v4, v6))
        .when(key.isin(*fv.DOMAIN_KEYS), domain(value))
        .when(key.isin(*fv.URL_KEYS), url(value))
        .otherwise(F.upper(strip(value)))
    )
    typed = found.withColumn("ioc_type", kind).where("ioc_type is not null").withColumn("normalized_value", normal)
    return typed.select(*columns, "ioc_type", "normalized_value")


def dedup_iocs(iocs: DataFrame, *scope: str) -> DataFrame:
    """First indicator per (type, normal form) within the scope columns."""
    return (
        iocs.groupBy(*scope, "ioc_type", "normalized_value")
        .agg(F.min(F.struct("event_id", "position", "field", "value")).alias("first"))
        .select(
            *scope, ioc_id(F.col("ioc_type"), F.col("normalized_value")).alias("ioc_id"), "ioc_type",
            "normalized_value", strip(F.col("first.value")).alias("value"),
            F.concat_ws(":", F.lit("event"), "first.event_id", "first.field").alias("source_context"),
        )
    )


def incident_iocs(members: DataFrame, events: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Indicators of every incident's events; with ``alerts`` also of alert evidence.

    Indicators are extracted once per event, however many incidents the event belongs to.
    """
    # dealt by event once, for the distinct pairs and the join
    pairs = members.select("incident_id", "event_id").repartition("event_id").distinct()
    found = pairs.join(extract_iocs(events), "event_id")
    if alerts is not None:
        own = alerts.select(
            "event_id", F.col("evidence").alias("metadata"), F.lit(None).cast("string").alias("source_ip"),
            F.lit(None).cast("string").alias("destination_ip"), "alert_id",
        )
        extra = members.select("incident_id", "alert_id").join(
            extract_iocs(own, "alert_id").withColumn("position", F.col("position") + 1000).drop("event_id"), "alert_id"
        ).withColumnRenamed("alert_id", "event_id").withColumn("event_id", F.concat(F.lit("~alert:"), "event_id"))
        found = found.unionByName(extra.select(*found.columns))
    return dedup_iocs(found, "incident_id")


def _lookup_group(ioc_type: Column) -> Column:
    """IPv6 is looked up among IPv4; all hashes share one list."""
    return F.when(ioc_type.isin("ipv4", "ipv6"), "ipv4").when(
        ioc_type.isin("sha256", "sha1", "md5", "hash"), "hash"
    ).otherwise(ioc_type)


_GRAM = 12


def _best() -> Column:
    """Malicious wins over benign."""
    rank = F.when(F.col("classification") == "malicious", 0).otherwise(1)
    return F.min(F.struct(rank.alias("rank"), "classification", "threat_category")).alias("hit")


def match_urls(urls: DataFrame, feed: DataFrame) -> DataFrame:
    """(url, hit) for URLs that contain a known domain anywhere.

    An equi-join on the first letters of the domain finds candidates, ``contains`` decides.
    Known domains may be many: nothing is compared with everything.
    """
    known = feed.where("ioc_type = 'domain'").withColumn("gram", F.substring("ioc_value", 1, _GRAM))
    short = [r[0] for r in known.select(F.char_length("gram").alias("n")).distinct().where(f"n < {_GRAM}").collect()]
    text = F.col("normalized_value")

    def pieces(n: int) -> Column:
        places = F.sequence(F.lit(1), F.char_length(text) - n + 1)
        return F.when(
            F.char_length(text) >= n, F.transform(places, lambda i: F.substring(text, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[pieces(n) for n in sorted({*short, _GRAM})]))
    return (
        urls.select("normalized_value").distinct()
        .withColumn("gram", F.explode(F.array_distinct(grams)))
        .join(known.select("gram", "ioc_value", "classification", "threat_category"), "gram")
        .where(F.contains("normalized_value", F.col("ioc_value")))
        .groupBy("normalized_value").agg(_best())
    )


def ti_lookup(iocs: DataFrame, feed: DataFrame) -> DataFrame:
    """Classification of every indicator; not found means unknown.

    The feed is joined on its value; Spark broadcasts it only if its size allows.
    """
    exact = (
        feed.withColumn("lookup", _lookup_group(F.col("ioc_type")))
        .withColumn("normalized_value", F.col("ioc_value")).groupBy("lookup", "normalized_value").agg(_best())
    )
    by_url = match_urls(iocs.where("ioc_type = 'url'"), feed).withColumn("lookup", F.lit("url"))
    known = exact.where("lookup <> 'url'").unionByName(by_url)
    return (
        iocs.withColumn("lookup", _lookup_group(F.col("ioc_type")))
        .join(known, ["lookup", "normalized_value"], "left")
        .withColumn("classification", F.coalesce("hit.classification", F.lit("unknown")))
        .withColumn(
            "threat_category",
            F.when(
                F.col("classification") == "malicious",
                F.when((F.col("ioc_type") != "url") & (F.col("hit.threat_category") != ""), F.col("hit.threat_category"))
                .otherwise("malicious_activity"),
            ).otherwise(""),
        )
        .drop("lookup", "hit")
    )


def enrich_incidents(iocs: DataFrame, feed: DataFrame, provider: str = fv.FEED_NAME, now: Column | None = None) -> DataFrame:
    """One result row per (incident, indicator)."""
    moment = F.current_timestamp() if now is None else now
    kind = F.col("classification")
    found = kind != "unknown"
    text = F.when(
        kind == "malicious",
        F.concat(
            F.lit("Synthetic development intelligence classifies this "), "ioc_type",
            F.lit(" indicator as malicious with high confidence. Category: "), "threat_category",
            F.lit(". This is test data only."),
        ),
    ).when(
        kind == "benign",
        F.concat(
            F.lit("Synthetic development intelligence classifies this "), "ioc_type",
            F.lit(" indicator as benign with high confidence. This is test data only."),
        ),
    ).otherwise(
        F.concat(
            F.lit("No matching intelligence was found for this "), "ioc_type",
            F.lit(" indicator in the synthetic development dataset."),
        )
    )
    return ti_lookup(iocs, feed).select(
        short_id("ti-", "ti:", F.col("incident_id"), ":", F.col("normalized_value")).alias("enrichment_id"),
        "incident_id", "ioc_type", F.col("normalized_value").alias("ioc_value"), "classification",
        F.when(kind == "malicious", 94).when(kind == "benign", 90).otherwise(0).alias("confidence"),
        kind.alias("reputation"), "threat_category", F.lit(provider).alias("provider"),
        F.when(kind == "malicious", 3).when(kind == "benign", 2).otherwise(0).alias("source_count"),
        F.when(found, moment).alias("first_seen"), F.when(found, moment).alias("last_seen"),
        F.when(kind == "malicious", F.array(F.lit("synthetic"), F.col("threat_category")))
        .when(kind == "benign", F.array(F.lit("synthetic"), F.lit("clean")))
        .otherwise(F.array(F.lit("synthetic"))).alias("tags"),
        text.alias("explanation"), moment.alias("lookup_timestamp"),
    )


def ti_summary(enrichments: DataFrame) -> DataFrame:
    """Counts per incident by classification."""
    kind = F.lower("classification")
    return enrichments.groupBy("incident_id").agg(
        F.count("*").alias("total_indicators"),
        F.count_if(kind == "malicious").alias("malicious_count"),
        F.count_if(kind == "suspicious").alias("suspicious_count"),
        F.count_if(kind == "benign").alias("benign_count"),
        F.count_if(~kind.isin("malicious", "suspicious", "benign")).alias("unknown_count"),
    )


def find_by_ioc(enrichments: DataFrame, ioc_type: str, value: str, limit: int | None = None) -> DataFrame:
    """Results for one indicator, newest first."""
    found = (
        enrichments.where((F.col("ioc_type") == ioc_type) & (F.col("ioc_value") == value))
        .orderBy(F.col("lookup_timestamp").desc(), "enrichment_id")
    )
    return found if limit is None else found.limit(limit)
