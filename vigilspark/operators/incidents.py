"""Incidents from correlations (I01-I05). Alert and event ids stay in member tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import iso_text, short_id


def incident_id(correlation_id: Column) -> Column:
    return short_id("inc-", "incident:", correlation_id)


def incident_description() -> Column:
    """Summary text from the columns of a correlation row."""
    techniques = F.when(F.size("mitre_techniques") > 0, F.array_join("mitre_techniques", ", ")).otherwise("None")
    return F.concat(
        F.lit("Correlated security incident ("), "correlation_type", F.lit(") affecting "), "entity_key",
        F.lit(". Encompasses "), F.col("alert_count").cast("string"), F.lit(" alert(s) observed between "),
        F.coalesce(iso_text(F.col("first_seen")), F.lit("unknown")), F.lit(" and "),
        F.coalesce(iso_text(F.col("last_seen")), F.lit("unknown")),
        F.lit(". MITRE ATT&CK techniques: "), techniques,
        F.lit(". Initial severity: "), F.col("severity").cast("string"), F.lit("/15."),
    )


def build_incidents(correlations: DataFrame, now: Column | None = None) -> DataFrame:
    """One incident per correlation."""
    moment = F.current_timestamp() if now is None else now
    return correlations.select(
        incident_id(F.col("correlation_id")).alias("incident_id"),
        F.concat(F.lit("Security Incident: "), "title").alias("title"),
        incident_description().alias("description"),
        F.greatest(F.lit(0), F.least(F.lit(15), "severity")).cast("int").alias("severity"),
        F.lit("open").alias("status"),
        moment.alias("created_at"),
        moment.alias("updated_at"),
        F.array("correlation_id").alias("correlation_ids"),
        "first_seen", "last_seen", "alert_count", "event_count", "mitre_techniques",
        F.create_map(
            F.lit("correlation_type"), F.col("correlation_type"), F.lit("entity_key"), F.col("entity_key"),
            F.lit("alert_count"), F.col("alert_count").cast("string"),
        ).alias("evidence"),
        F.array("correlation_type", "entity_key").alias("tags"),
    )


def incident_members(members: DataFrame) -> DataFrame:
    """Members of incidents: the members of their correlation."""
    return members.withColumn("incident_id", incident_id(F.col("correlation_id")))


def merge_incidents(
    stored: DataFrame, stored_members: DataFrame, incidents: DataFrame, members: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Fold newer correlation state into stored incidents.

    Ids and techniques are united, the time span widens, status and creation time stay,
    title, description and severity follow the correlation.
    """
    key = ["incident_id", "alert_id", "event_id"]
    # dealt by event once: the same rows are made distinct and then counted
    all_members = stored_members.select(*key).unionByName(members.select(*key)).repartition("incident_id", "event_id").distinct()
    counts = (
        all_members.groupBy("incident_id", "event_id").agg(F.count("*").alias("n"))
        .groupBy("incident_id").agg(F.sum("n").alias("alert_count"), F.count("*").alias("event_count"))
    )
    o, n = F.col, F.col
    old = stored.withColumn("_old", F.lit(True)).alias("o")
    new = incidents.withColumn("_new", F.lit(True)).alias("n")
    empty = F.array().cast("array<string>")

    def newest(c: str) -> Column:
        return F.when(F.col("_new"), n(f"n.{c}")).otherwise(o(f"o.{c}")).alias(c)

    def kept(c: str) -> Column:
        return F.when(F.col("_old"), o(f"o.{c}")).otherwise(n(f"n.{c}")).alias(c)

    merged = old.join(new, "incident_id", "full_outer").select(
        "incident_id", newest("title"), newest("description"), newest("severity"), kept("status"), kept("created_at"),
        newest("updated_at"), newest("correlation_ids"),
        F.least("o.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
        F.array_sort(F.array_union(F.coalesce("o.mitre_techniques", empty), F.coalesce("n.mitre_techniques", empty))).alias("mitre_techniques"),
        newest("evidence"), newest("tags"),
    )
    merged = merged.join(counts, "incident_id", "left").withColumn(
        "evidence",
        F.map_concat(
            F.map_filter("evidence", lambda k, _: k != "alert_count"),
            F.create_map(F.lit("alert_count"), F.col("alert_count").cast("string")),
        ),
    )
    return merged.select(*incidents.columns), all_members


def set_incident_status(incidents: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply the latest requested status per incident; also return the audit of changes.

    ``changes``: incident_id, ts, status, actor. Any status may follow any other.
    """
    latest = changes.groupBy("incident_id").agg(
        F.max_by(F.struct("status", "ts"), F.struct("ts", "status")).alias("c")
    )
    updated = incidents.join(latest, "incident_id", "left").select(
        *[
            F.coalesce("c.status", "status").alias("status") if c == "status"
            else F.coalesce("c.ts", "updated_at").alias("updated_at") if c == "updated_at"
            else F.col(c)
            for c in incidents.columns
        ]
    )
    audit = changes.join(incidents.select("incident_id", F.col("status").alias("old_status")), "incident_id").select(
        F.col("ts").alias("timestamp"), "actor", F.lit("incident.status_updated").alias("action"),
        F.col("incident_id").alias("target"), F.lit("accepted").alias("result"),
        F.to_json(F.struct("incident_id", F.col("status").alias("new_status"))).alias("metadata_json"), "old_status",
    )
    return updated, audit


def incident_by_correlation(incidents: DataFrame, correlation_id: str) -> DataFrame:
    return incidents.where(F.array_contains("correlation_ids", correlation_id))
