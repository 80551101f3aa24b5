"""Lookups, top-k lists and overviews."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(df: DataFrame, time: str, limit: int | None = None, since: Column | None = None, tie: str | None = None) -> DataFrame:
    """Newest rows first; all of them, or the ``limit`` newest."""
    if since is not None:
        df = df.where(F.col(time) >= since)
    order = [F.col(time).desc()] + ([F.col(tie)] if tie else [])
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def filtered(df: DataFrame, **equal: object) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def list_correlations(
    correlations: DataFrame, members: DataFrame, status: str | None = None, alert_id: str | None = None,
    event_id: str | None = None, limit: int | None = None,
) -> DataFrame:
    """An alert or event id is looked up in the member table (pushed-down filter)."""
    out = filtered(correlations, status=status)
    for column, value in (("alert_id", alert_id), ("event_id", event_id)):
        if value is not None:
            out = out.join(members.where(F.col(column) == value).select("correlation_id").distinct(), "correlation_id", "left_semi")
    return recent(out, "last_seen", limit, tie="correlation_id")


def list_incidents(
    incidents: DataFrame, status: str | None = None, correlation_id: str | None = None, min_severity: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """K03."""
    out = filtered(incidents, status=status)
    if correlation_id is not None:
        out = out.where(F.array_contains("correlation_ids", correlation_id))
    if min_severity is not None:
        out = out.where(F.col("severity") >= min_severity)
    return recent(out, "updated_at", limit, tie="incident_id")


def latest_per(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Newest row per key, combined on the map side."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(time, tie)).alias("r")).select("r.*")


def list_cases(
    cases: DataFrame, status: str | None = None, priority: str | None = None, assignee: str | None = None, limit: int | None = None
) -> DataFrame:
    """K05."""
    return recent(filtered(cases, status=status, priority=priority, assignee=assignee), "updated_at", limit, tie="case_id")


def list_activities(activities: DataFrame, dataset_id: str | None = None, actor: str | None = None, limit: int | None = None) -> DataFrame:
    """K06."""
    return recent(filtered(activities, dataset_id=dataset_id, actor=actor), "timestamp", limit, tie="activity_id")


def list_responses(responses: DataFrame, incident_id: str | None = None, limit: int | None = None) -> DataFrame:
    """K07."""
    return recent(filtered(responses, incident_id=incident_id), "requested_at", limit, tie="action_id")


def audit_trail(audit: DataFrame, target: str | None = None) -> DataFrame:
    """Oldest first."""
    return filtered(audit, target=target).orderBy("timestamp", "audit_id")


def dataset_of(text: Column) -> Column:
    """Dataset id in an entity key or tag, null without one."""
    found = F.regexp_extract(text, r"dataset:(.+)$", 1)
    return F.when(found != "", found)


def dataset_overview(
    catalog: DataFrame, activities: DataFrame, alerts: DataFrame, correlations: DataFrame, incidents: DataFrame,
    risks: DataFrame, enrichments: DataFrame, cases: DataFrame, responses: DataFrame,
) -> DataFrame:
    """Totals per dataset. Every table is reduced by dataset before anything is joined.

    Incidents of a dataset are those tagged with exactly its id.
    """
    incident_key = incidents.select("incident_id", F.explode("tags").alias("tag")).select(
        "incident_id", dataset_of(F.col("tag")).alias("dataset_id")
    ).where("dataset_id is not null").distinct()

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("dataset_id").agg(F.count("*").alias(name))

    parts: Mapping[str, DataFrame] = {
        "activities": count(activities, "activities"),
        "alerts": count(alerts.select(F.col("evidence").getItem("dataset_id").alias("dataset_id")).where("dataset_id is not null"), "alerts"),
        "correlations": count(correlations.select(dataset_of(F.col("entity_key")).alias("dataset_id")).where("dataset_id is not null"), "correlations"),
        "incidents": count(incident_key, "incidents"),
        "risks": risks.join(incident_key, "incident_id").groupBy("dataset_id").agg(
            F.count("*").alias("risk_assessments"), F.max("risk_score").alias("max_risk_score")
        ),
        "intel": enrichments.join(incident_key, "incident_id").groupBy("dataset_id").agg(
            F.count("*").alias("indicators"), F.count_if(F.col("classification") == "malicious").alias("malicious_indicators")
        ),
        "cases": count(
            cases.select("case_id", F.explode("tags").alias("tag"))
            .select("case_id", dataset_of(F.col("tag")).alias("dataset_id")).where("dataset_id is not null").distinct(),
            "cases",
        ),
        "responses": count(responses.join(incident_key, "incident_id"), "responses"),
    }
    out = catalog
    for part in parts.values():
        out = out.join(part, "dataset_id", "left")
    return out.na.fill(0)


def incident_workspace(
    incidents: DataFrame, risks: DataFrame, intel_summary: DataFrame, investigations: DataFrame, cases: DataFrame,
    responses: DataFrame,
) -> DataFrame:
    """Everything about an incident in one row; any part may be missing."""
    risk = latest_per(risks, "incident_id", "scored_at", "assessment_id").select("incident_id", "assessment_id", "risk_score", "risk_level")
    report = latest_per(investigations.select("incident_id", "investigation_id", "confidence", "generated_at"), "incident_id", "generated_at", "investigation_id")
    case = cases.select("case_id", F.explode("incident_ids").alias("incident_id"), F.col("status").alias("case_status"), "priority")
    case = case.groupBy("incident_id").agg(F.min(F.struct("case_id", "case_status", "priority")).alias("c")).select("incident_id", "c.*")
    actions = responses.groupBy("incident_id").agg(
        F.count("*").alias("responses"), F.count_if(F.col("status") == "proposed").alias("proposed_responses")
    )
    out = incidents.select("incident_id", "title", "severity", "status", "alert_count", "event_count", "first_seen", "last_seen")
    for part in (
        risk, intel_summary.select("incident_id", "total_indicators", "malicious_count"),
        report.select("incident_id", "investigation_id", "confidence"), case, actions,
    ):
        out = out.join(part, "incident_id", "left")
    return out


def pipeline_result(
    events: DataFrame, alerts: DataFrame, outcomes: DataFrame, enrichments: DataFrame, risks: DataFrame, incident_ids: DataFrame
) -> DataFrame:
    """Per event what processing it led to.

    ``incident_ids`` maps correlation_id to incident_id. Counts, not id lists: one event
    can touch several correlations, and their ids are in ``outcomes``.
    """
    touched = outcomes.join(incident_ids, "correlation_id")
    iocs = enrichments.groupBy("incident_id").agg(F.count("*").alias("iocs"))
    per_event = (
        touched.join(risks.select("incident_id", "risk_score", "risk_level"), "incident_id", "left")
        .join(iocs, "incident_id", "left")
        .groupBy("event_id")
        .agg(
            F.count_if(F.col("outcome") == "created").alias("correlations_created"),
            F.count_if(F.col("outcome") == "updated").alias("correlations_updated"),
            F.coalesce(F.sum("iocs"), F.lit(0)).alias("iocs_extracted"),
            F.max(F.struct("incident_id", "risk_score", "risk_level")).alias("last"),
        )
    )
    hits = alerts.groupBy("event_id").agg(F.count("*").alias("detection_matches"))
    return (
        events.select("event_id").join(hits, "event_id", "left").join(per_event, "event_id", "left")
        .select(
            "event_id", F.coalesce("detection_matches", F.lit(0)).alias("detection_matches"),
            F.coalesce("correlations_created", F.lit(0)).alias("correlations_created"),
            F.coalesce("correlations_updated", F.lit(0)).alias("correlations_updated"),
            F.coalesce("iocs_extracted", F.lit(0)).alias("iocs_extracted"),
            F.col("last.risk_score").alias("last_risk_score"), F.col("last.risk_level").alias("last_risk_level"),
        )
    )
