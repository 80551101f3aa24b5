"""Alerts from rule hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import short_id
from .detect import BUILTIN_RULES, DetectionRule, detect

ALERT_COLUMNS = [
    "alert_id", "event_id", "timestamp", "rule_id", "rule_name", "rule_order", "severity", "description",
    "source", "evidence", "mitre_techniques", "status",
]
ENTITY_COLUMNS = ["host", "user", "source_ip", "destination_ip"]


def build_alerts(hits: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One alert per hit; the key is derived from (event, rule), so reruns give the same rows.

    ``keep`` names event columns to carry along, which spares the later join on event_id
    when alerts are built from their events in the same job.
    """
    return hits.select(
        short_id("alert-", F.col("event_id"), ":", F.col("rule_id")).alias("alert_id"),
        *[c for c in ALERT_COLUMNS if c not in ("alert_id", "status")],
        F.lit("new").alias("status"),
        *keep,
    )


def dedup_alerts(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per (event, rule); rows already stored are left out."""
    unique = new.dropDuplicates(["alert_id"])
    return unique if stored is None else unique.join(stored.select("alert_id"), "alert_id", "left_anti")


def alerts_with_entities(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Stored alerts with the entities of their event; a missing event gives null entities."""
    return alerts.join(events.select("event_id", *ENTITY_COLUMNS), "event_id", "left")


def correlatable_alerts(events: DataFrame, rules: Sequence[DetectionRule] = BUILTIN_RULES) -> DataFrame:
    """Alerts with entities straight from the events: same rows as the join, without it."""
    return build_alerts(detect(events, rules), keep=ENTITY_COLUMNS)
