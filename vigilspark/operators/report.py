"""Investigation reports (V01-V08): deterministic text from stored facts.

Alerts and events of an incident are cut to their first few by id with a ranking filter.
Spark limits the groups before the shuffle, so an incident with many members sends only
those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import redact, short_id

FIRST_ALERTS = 10
FIRST_EVENTS = 15
FIRST_TECHNIQUES = 10


def _first_by_id(members: DataFrame, key: str, limit: int) -> DataFrame:
    ids = members.select("incident_id", key).distinct()
    rank = F.row_number().over(Window.partitionBy("incident_id").orderBy(key))
    return ids.withColumn("position", rank).where(F.col("position") <= limit)


def report_context(
    incidents: DataFrame, members: DataFrame, alerts: DataFrame, events: DataFrame, risks: DataFrame | None = None,
    intel_summary: DataFrame | None = None,
) -> DataFrame:
    """One bounded, redacted row of facts per incident."""
    first_alerts = (
        _first_by_id(members, "alert_id", FIRST_ALERTS)
        .join(alerts.select("alert_id", "rule_id", "rule_name", F.col("severity").alias("alert_severity")), "alert_id")
        .groupBy("incident_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            "position", "alert_id", "rule_id", redact(F.col("rule_name"), "report", 128).alias("rule_name"),
            "alert_severity",
        ))).alias("alerts_summary"))
    )
    first_events = (
        _first_by_id(members, "event_id", FIRST_EVENTS)
        .join(events.select("event_id", "timestamp", "event_type", "message", "source"), "event_id")
        .groupBy("incident_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            "position", "timestamp", redact(F.col("event_type"), "report", 64).alias("event_type"),
            redact(F.coalesce(F.when(F.col("message") != "", F.col("message")), F.concat(F.lit("Event "), "event_id")), "report", 256).alias("description"),
            F.col("source").alias("source_entity"),
        ))).alias("timeline_events"))
    )
    ctx = incidents.join(first_alerts, "incident_id", "left").join(first_events, "incident_id", "left")
    if risks is None:
        ctx = ctx.withColumn("risk_score", F.lit(None).cast("int")).withColumn("risk_level", F.lit(None).cast("string"))
    else:
        latest = risks.groupBy("incident_id").agg(
            F.max_by(F.struct("risk_score", "risk_level"), F.struct("scored_at", "assessment_id")).alias("r")
        )
        ctx = ctx.join(latest.select("incident_id", "r.*"), "incident_id", "left")
    zero = ["total_indicators", "malicious_count", "suspicious_count", "benign_count", "unknown_count"]
    if intel_summary is None:
        for c in zero:
            ctx = ctx.withColumn(c, F.lit(0).cast("bigint"))
    else:
        ctx = ctx.join(intel_summary.select("incident_id", *zero), "incident_id", "left").na.fill(0, zero)
    ev = F.col("evidence").getItem
    raw_entity = F.coalesce(*[F.when(ev(k) != "", ev(k)) for k in ("entity_key", "entity_id", "host")])
    entity = F.when(raw_entity.isNotNull(), redact(raw_entity, "report", 128))
    is_dataset = (F.coalesce(ev("dataset_id"), F.lit("")) != "") | F.exists("tags", lambda t: F.lower(t).contains("dataset"))
    columns = F.coalesce(F.from_json(ev("sensitive_columns"), "array<string>"), F.array().cast("array<string>"))
    dataset = F.when(is_dataset, F.struct(
        ev("dataset_id").alias("dataset_id"),
        F.coalesce(ev("dataset_name"), ev("dataset_id"), F.lit("unknown")).alias("dataset_name"),
        ev("actor").alias("actor"),
        F.coalesce(ev("dataset_sensitivity"), ev("sensitivity")).alias("sensitivity"),
        F.coalesce(ev("records_accessed").try_cast("bigint"), F.lit(0)).alias("records"),
        columns.alias("sensitive_columns"),
        ev("export_destination").alias("export_destination"),
        F.coalesce(ev("operations"), F.lit("[]")).alias("operations"),
    ))
    return ctx.select(
        "incident_id", redact(F.col("title"), "report", 256).alias("incident_title"), "severity", "status", "created_at",
        entity.alias("entity_id"), "alert_count",
        F.coalesce("alerts_summary", F.array()).alias("alerts_summary"),
        F.slice("mitre_techniques", 1, FIRST_TECHNIQUES).alias("mitre_techniques"),
        *zero, "risk_score", "risk_level",
        F.coalesce("timeline_events", F.array()).alias("timeline_events"), dataset.alias("dataset"),
    )


def _finding(kind: str, description: Column, *evidence: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("finding_type"), description.alias("description"), F.array(*evidence).alias("evidence")
    )


def _s(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _none(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def report_findings() -> list[Column]:
    """What every report states, before the dataset part."""
    count, entity = F.col("alert_count"), F.col("entity_id")
    names = F.array_join(F.transform("alerts_summary", lambda a: a["rule_name"]), ", ")
    observed = F.struct(
        F.lit("OBSERVED").alias("finding_type"),
        _s("Observed ", count, " alert(s) across incident: ", F.when(names != "", names).otherwise("None"), ".").alias("description"),
        F.concat(
            F.array(_s("alert_count=", count)),
            F.transform(F.slice("alerts_summary", 1, 5), lambda a: F.concat(F.lit("rule:"), a["rule_id"])),
        ).alias("evidence"),
    )
    bad, odd = F.col("malicious_count"), F.col("suspicious_count")
    techniques = F.array_join("mitre_techniques", ", ")
    inferred = (
        F.when(F.size("mitre_techniques") > 0, _finding(
            "INFERRED",
            _s("Observed telemetry patterns align with mapped MITRE ATT&CK technique(s): ", techniques, "."),
            _s("techniques=", techniques)))
        .when(count > 1, _finding(
            "INFERRED",
            F.lit("Multiple alerts correlated against the same entity within a short time window indicate a coordinated "
                  "sequence of suspicious activities."),
            _s("alert_count=", count)))
        .otherwise(_finding(
            "INFERRED",
            F.lit("Single-event alert requires baseline entity profiling to verify whether this is an anomaly or typical "
                  "user behavior."),
            F.lit("alert_count=1")))
    )
    return [
        observed,
        F.when(entity.isNotNull(), _finding(
            "OBSERVED", _s("Primary affected entity identified as '", entity, "'."), _s("entity_id=", entity))),
        F.when((bad > 0) | (odd > 0), _finding(
            "OBSERVED",
            _s("Threat intelligence confirmed ", bad, " malicious and ", odd,
               " suspicious indicator(s) associated with incident telemetry."),
            _s("malicious=", bad), _s("suspicious=", odd))),
        inferred,
    ]


def _py_list(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))


def report_dataset_findings() -> list[Column]:
    """The dataset part and the closing recommendation."""
    d = F.col("dataset")
    name, actor, records, columns = d["dataset_name"], _none(d["actor"]), d["records"], d["sensitive_columns"]
    level, target = _none(d["sensitivity"]), d["export_destination"]
    has, to = d.isNotNull(), F.coalesce(target != "", F.lit(False))
    grouped = F.format_number(records, 0)
    return [
        F.when(has, _finding(
            "OBSERVED",
            F.concat(
                _s("Actor '", actor, "' performed operations ", d["operations"], " on dataset '", name, "' (sensitivity: ",
                   level, "), accessing ", grouped, " records"),
                F.when(F.size(columns) > 0, F.concat(F.lit(" including sensitive columns: "), _py_list(columns))).otherwise(""),
                F.lit("."),
            ),
            _s("dataset=", name), _s("sensitivity=", level), _s("records_accessed=", records),
            _s("sensitive_columns=", _py_list(columns)), _s("actor=", actor))),
        F.when(has & to, _finding(
            "OBSERVED",
            _s("Dataset '", name, "' was exported to destination: '", target,
               "'. This may represent data staging for exfiltration."),
            _s("export_destination=", target), _s("dataset=", name))),
        F.when(has & (to | ((records > 10000) & (F.size(columns) > 0))), _finding(
            "INFERRED",
            _s("The sequence of bulk sensitive data access followed by export from '", name,
               "' is consistent with a data exfiltration pattern (MITRE T1530, T1567). Actor '", actor, "' accessed ",
               grouped, " records including PII/financial fields before export."),
            F.lit("pattern=access+export_sequence"), F.lit("mitre=T1530,T1567"), _s("records=", records))),
        F.when(has, _finding(
            "RECOMMENDED",
            _s("Analyst should restrict access to '", name, "' and review actor '", actor,
               "' session logs. Consider proposing restrict_dataset_access simulation response and revoking actor "
               "credentials if unauthorized access is confirmed. ANALYST APPROVAL REQUIRED for any real action. This is "
               "advisory only."),
            F.lit("advisory_guidance"), F.lit("simulation_only")))
        .otherwise(_finding(
            "RECOMMENDED",
            F.lit("Analyst should inspect raw endpoint logs, review process trees, and verify user authorization for "
                  "identified activities."),
            F.lit("advisory_guidance"))),
    ]


def report_timeline() -> Column:
    """V04."""
    listed = F.transform("timeline_events", lambda e: F.struct(
        e["timestamp"].alias("timestamp"), e["event_type"].alias("event_type"), e["description"].alias("description"),
        F.coalesce(F.when(e["source_entity"] != "", e["source_entity"]), F.col("entity_id")).alias("source_entity"),
    ))
    fallback = F.array(F.struct(
        F.col("created_at").alias("timestamp"), F.lit("incident_created").alias("event_type"),
        _s("Incident ", F.col("incident_id"), " created with initial title: ", F.col("incident_title")).alias("description"),
        F.col("entity_id").alias("source_entity"),
    ))
    return F.when(F.size("timeline_events") > 0, listed).otherwise(fallback)


def report_gaps() -> Column:
    """V05, first half."""
    found = F.array_compact(F.array(
        F.when(F.col("total_indicators") == 0, "No IOCs were extracted or enriched from incident telemetry."),
        F.when(F.size("alerts_summary") == 0, "Alert details could not be retrieved from evidence store."),
        F.when(F.col("entity_id").isNull(), "No specific host or entity identifier linked to incident."),
    ))
    return F.when(F.size(found) > 0, found).otherwise(
        F.array(F.lit("Network flow metadata and full memory dumps are currently uncollected."))
    )


def report_next_steps() -> Column:
    """V05, second half."""
    return F.array_compact(F.array(
        _s("Review alerts and evidence for entity '", F.coalesce("entity_id", F.lit("unknown")), "'."),
        F.lit("Validate user session authenticity and check for concurrent anomalous logins."),
        F.lit("Verify whether any process execution originated from untrusted directories or scripts."),
        F.when(F.col("malicious_count") > 0,
               "Prioritize host containment review due to confirmed malicious indicators."),
    ))


def report_actions() -> Column:
    """Proposals only, all need approval."""
    target = F.coalesce("entity_id", F.lit("unassigned_host"))
    d = F.col("dataset")

    def action(kind: str, description: Column, entity: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("action_type"), description.alias("description"), entity.alias("target_entity"),
            F.lit(True).alias("analyst_approval_required"), F.lit(True).alias("inert_proposed_only"),
        )

    on_data = F.array_compact(F.array(
        action(
            "restrict_dataset_access",
            _s("SIMULATION ONLY: Propose restricting access to '", d["dataset_name"],
               "' to read-only / quarantine mode. No real permissions, ACLs, or files would be modified without analyst "
               "approval. ANALYST APPROVAL REQUIRED."),
            d["dataset_name"]),
        F.when(F.coalesce(d["actor"] != "", F.lit(False)), action(
            "revoke_credentials",
            _s("Propose credential revocation for actor '", _none(d["actor"]),
               "' if unauthorized dataset access is confirmed. ANALYST APPROVAL REQUIRED."),
            d["actor"])),
    ))
    on_host = F.array(
        action("isolate_endpoint",
               _s("Propose network isolation for endpoint '", target, "' to contain lateral spread pending investigation."),
               target),
        action("quarantine_file",
               F.lit("Propose suspicious binary quarantine if artifacts or malicious hashes are confirmed on host."), target),
        action("revoke_credentials",
               F.lit("Propose credential revocation and forced password reset for impacted user accounts."), target),
    )
    return F.when(d.isNotNull(), on_data).otherwise(on_host)


def report_confidence() -> Column:
    """V07."""
    total = (
        F.lit(0.5) + F.when(F.col("alert_count") > 0, 0.15).otherwise(0.0)
        + F.when(F.size("mitre_techniques") > 0, 0.15).otherwise(0.0)
        + F.when(F.col("total_indicators") > 0, 0.10).otherwise(0.0)
        + F.when(F.col("entity_id").isNotNull(), 0.05).otherwise(0.0)
    )
    return F.round(F.least(F.lit(1.0), total), 2)


def report_summary(actions: Column) -> Column:
    """V08."""
    mitre = F.when(
        F.size("mitre_techniques") > 0,
        F.concat(F.lit(" mapped to MITRE techniques ("), F.array_join("mitre_techniques", ", "), F.lit(")")),
    ).otherwise("")
    risk = F.when(
        F.col("risk_score").isNotNull(),
        _s(" with ML risk assessment ", F.col("risk_level"), " (score: ", F.col("risk_score"), ")"),
    ).otherwise("")
    return _s(
        "Automated AI investigation for incident ", F.col("incident_id"), " ('", F.col("incident_title"), "'). Entity '",
        F.coalesce("entity_id", F.lit("unknown")), "' was involved in ", F.col("alert_count"), " alert(s)", mitre, risk,
        ". Threat intel reported ", F.col("malicious_count"),
        " malicious indicator(s). Analysis recommends immediate analyst verification and proposes ", F.size(actions),
        " inert containment actions.",
    )


def investigation_id(incident_id: Column) -> Column:
    return short_id("inv-", "inv:", incident_id)


def investigate(
    context: DataFrame, stored: DataFrame | None = None, force: bool = False, now: Column | None = None
) -> DataFrame:
    """One report per incident; incidents that already have one are skipped unless forced."""
    if stored is not None and not force:
        context = context.join(stored.select("incident_id"), "incident_id", "left_anti")
    actions = report_actions()
    return context.select(
        investigation_id(F.col("incident_id")).alias("investigation_id"), "incident_id",
        report_summary(actions).alias("summary"), report_confidence().alias("confidence"),
        F.array_compact(F.array(*report_findings(), *report_dataset_findings())).alias("findings"),
        report_timeline().alias("timeline"), "mitre_techniques",
        F.struct("total_indicators", "malicious_count", "suspicious_count", "benign_count", "unknown_count").alias("threat_intel_summary"),
        report_gaps().alias("investigation_gaps"), report_next_steps().alias("recommended_next_steps"),
        actions.alias("possible_response_actions"), F.lit("local_dev").alias("provider"),
        F.lit("heuristic_deterministic_v1").alias("model_name"),
        (F.current_timestamp() if now is None else now).alias("generated_at"),
    )
