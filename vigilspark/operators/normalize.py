"""Normalization (N01-N17): raw telemetry to normalized events. Projections only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import present, redact, redact_map
from ..functions.redaction import _sensitive_key, flatten_json, last_of_each_key, redact_value

EVENT_COLUMNS = [
    "event_id", "timestamp", "source", "event_type", "severity", "message", "host", "user", "source_ip",
    "destination_ip", "metadata",
]


# --- N01-N05 ----------------------------------------------------------------------------


def parse_event_time(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP; no zone means UTC (session zone must be UTC)."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z", "+00:00"))


def severity_from_name(text: Column) -> Column:
    """Severity word to number; a missing value is 0, an unknown word is null."""
    word = F.lower(F.trim(text))
    out = F.when(text.isNull(), F.lit(0))
    for name, level in fv.SEVERITY_NAMES.items():
        out = out.when(word == name, F.lit(level))
    return out.cast("int")


def fold_extra_fields(df: DataFrame, known: Sequence[str] = tuple(EVENT_COLUMNS)) -> DataFrame:
    """Columns outside the event contract move into ``metadata`` and win over its keys."""
    extra = [c for c in df.columns if c not in known]
    if not extra:
        return df
    pairs: list[Column] = []
    for c in extra:
        pairs += [F.lit(c), F.col(c).cast("string")]
    kept = F.map_filter(
        F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*extra)
    )
    return df.withColumn("metadata", F.map_concat(kept, F.create_map(*pairs))).drop(*extra)


class Validated(NamedTuple):
    good: DataFrame
    rejected: DataFrame


Check = tuple[str, Callable[[], Column]]


def event_checks() -> list[Check]:
    """Checks of the normalized-event contract, by name."""
    checks: list[Check] = []
    for name, (low, high, required) in fv.EVENT_TEXT_LIMITS.items():
        def bad(name=name, low=low, high=high, required=required) -> Column:
            length = F.char_length(F.col(name))
            wrong = (length < low) | (length > high)
            return F.coalesce(wrong, F.lit(required))
        checks.append((name, bad))
    checks.append(("timestamp", lambda: F.col("timestamp").isNull()))
    checks.append(("severity", lambda: F.coalesce(~F.col("severity").between(0, 15), F.lit(True))))
    return checks


def activity_checks() -> list[Check]:
    """Checks of the dataset-activity contract."""
    def text(name: str, high: int, required: bool) -> Check:
        return name, lambda: F.coalesce(
            (F.char_length(name) > high) | ((F.char_length(name) < 1) & F.lit(required)), F.lit(required)
        )

    def counter(name: str) -> Check:
        return name, lambda: F.coalesce(F.col(name) < 0, F.lit(False))

    return [
        text("activity_id", 256, True), text("dataset_id", 256, True), text("dataset_name", 256, True),
        text("actor", 256, True), text("actor_host", 256, False), text("source_ip", 64, False),
        text("destination_ip", 64, False), text("export_destination", 512, False),
        ("timestamp", lambda: F.col("timestamp").isNull()),
        ("operation", lambda: F.coalesce(~F.col("operation").isin(*fv.ACTIVITY_OPERATIONS), F.lit(True))),
        counter("records_accessed"), counter("records_modified"), counter("export_size_bytes"),
    ]


def failed_checks(checks: Sequence[Check]) -> Column:
    return F.array_compact(F.array(*[F.when(bad(), F.lit(name)) for name, bad in checks]))


def validate_rows(df: DataFrame, checks: Sequence[Check]) -> Validated:
    """Rows that pass, and rows that fail with the names of the failed checks."""
    checked = df.withColumn("failed_checks", failed_checks(checks))
    return Validated(
        checked.where(F.size("failed_checks") == 0).drop("failed_checks"),
        checked.where(F.size("failed_checks") > 0),
    )


def dedup_events(new: DataFrame, arrival: Sequence[str], stored: DataFrame | None = None) -> DataFrame:
    """First row per event id wins; ids that are already stored are dropped.

    ``min_by`` keeps one row per id on the map side, so copies of one id never meet in one
    task in full.
    """
    if stored is not None:
        new = new.join(stored.select("event_id"), "event_id", "left_anti")
    row = F.struct(*new.columns)
    order = F.struct(*arrival)
    return new.groupBy("event_id").agg(F.min_by(row, order).alias("r")).select("r.*")


# --- N06-N10: SIEM agent alerts ---------------------------------------------------------

WAZUH_SCHEMA = (
    "id string, _id string, timestamp string, "
    "rule struct<id:string, level:string, description:string, groups:array<string>, mitre:struct<id:string>>, "
    "agent struct<id:string, name:string, hostname:string>, manager struct<name:string>, host string, "
    "srcip string, dstip string, srcuser string, dstuser string, data string"
)


def first_text(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def wazuh_level_bucket(level: Column) -> Column:
    value = F.floor(level.try_cast("double")).try_cast("int")
    return F.when(value >= 12, 12).when(value >= 8, 10).when(value >= 4, 6).otherwise(3)


def wazuh_event_type(groups: Column, win_event_id: Column) -> Column:
    lowered = F.coalesce(F.transform(groups, lambda g: F.lower(g)), F.array().cast("array<string>"))

    def has(*names: str) -> Column:
        return F.arrays_overlap(lowered, F.array(*[F.lit(n) for n in names]))

    return (
        F.when(has("authentication_failed", "authentication_failure", "invalid_login"), "authentication_failure")
        .when(has("authentication_success"), "authentication_success")
        .when(has("privilege_escalation", "sudo"), "privilege_escalation")
        .when(has("network", "firewall"), "network_connection")
        .when(has("process", "sysmon_process"), "process_start")
        .when(has("file"), "file_read")
        .when(win_event_id == "1", "process_start")
        .when(win_event_id == "3", "network_connection")
        .when(win_event_id.isin("4625", "4776"), "authentication_failure")
        .otherwise("wazuh_alert")
    )


def wazuh_event_id(raw_id: Column, other_id: Column, timestamp: Column, rule_id: Column) -> Column:
    """Agent's own id; without one a stable hash of time and rule."""
    own = first_text(raw_id, other_id)
    seed = F.concat_ws(":", F.coalesce(timestamp, F.lit("")), F.coalesce(rule_id, F.lit("0")))
    return F.coalesce(
        F.concat(F.lit("wazuh-alert-"), own), F.concat(F.lit("wazuh-synth-"), F.substring(F.sha2(seed, 256), 1, 8))
    )


def mitre_as_array(raw: Column) -> Column:
    """Technique ids given as one text or as a JSON list."""
    empty = F.array().cast("array<string>")
    return F.when(raw.isNull(), empty).when(
        F.ltrim(raw).startswith("["), F.coalesce(F.from_json(raw, "array<string>"), empty)
    ).otherwise(F.array(raw))


def wazuh_to_events(raw: DataFrame) -> DataFrame:
    """Agent alerts (``WAZUH_SCHEMA``; ``data`` is the payload's JSON text) to events."""
    def data(path: str) -> Column:
        return F.get_json_object("data", f"$.{path}")

    rule_id = F.coalesce("rule.id", F.lit(""))
    host = first_text(F.col("agent.name"), F.col("agent.hostname"), F.col("host"))
    user = first_text(
        F.col("dstuser"), F.col("srcuser"), data("dstuser"), data("srcuser"), data("win.eventdata.targetUserName")
    )
    source_ip = first_text(F.col("srcip"), data("srcip"), data("source_ip"), data("win.eventdata.ipAddress"))
    target_ip = first_text(F.col("dstip"), data("dstip"), data("destination_ip"), data("win.eventdata.destinationIp"))
    message = F.concat(
        F.lit("["), rule_id, F.lit("] "), F.coalesce("rule.description", F.lit("Wazuh security alert")),
        F.coalesce(F.concat(F.lit(" (host: "), host, F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" (user: "), user, F.lit(")")), F.lit("")),
    )
    payload = F.transform(
        flatten_json(F.col("data")),
        lambda e: F.struct(
            F.concat(F.lit("wazuh_data."), e["key"]).alias("key"),
            F.when(_sensitive_key(e["key"]), F.lit(fv.REDACTED)).otherwise(redact_value(e["value"])).alias("value"),
        ),
    )
    base = F.create_map(
        F.lit("wazuh_rule_id"), rule_id,
        F.lit("wazuh_rule_level"), F.col("rule.level"),
        F.lit("wazuh_rule_groups"), F.to_json(F.coalesce("rule.groups", F.array().cast("array<string>"))),
        F.lit("wazuh_agent_id"), F.col("agent.id"),
        F.lit("wazuh_manager_name"), F.col("manager.name"),
        F.lit("mitre_techniques"), F.to_json(mitre_as_array(F.col("rule.mitre.id"))),
    )
    return raw.select(
        wazuh_event_id(F.col("id"), F.col("_id"), F.col("timestamp"), F.col("rule.id")).alias("event_id"),
        F.coalesce(parse_event_time(F.when(F.col("timestamp") != "", F.col("timestamp"))), F.when(F.coalesce("timestamp", F.lit("")) == "", F.current_timestamp())).alias("timestamp"),
        F.lit("wazuh").alias("source"),
        wazuh_event_type(F.col("rule.groups"), F.coalesce(data("win.system.eventID"), F.lit(""))).alias("event_type"),
        wazuh_level_bucket(F.col("rule.level")).cast("int").alias("severity"),
        redact(message).alias("message"),
        redact(host).alias("host"), redact(user).alias("user"),
        redact(source_ip).alias("source_ip"), redact(target_ip).alias("destination_ip"),
        F.map_concat(base, F.map_from_entries(last_of_each_key(payload))).alias("metadata"),
    )


# --- N14-N17: dataset activities --------------------------------------------------------


def activity_operation(operation: Column) -> Column:
    return F.substring_index(F.coalesce(operation, F.lit("dataset_read")), ".", -1)


def activity_event_type(operation: Column) -> Column:
    op = activity_operation(operation)
    return (
        F.when(op.isin("bulk_access", "bulk_read"), "dataset_bulk_access")
        .when(op == "sensitive_column_access", op)
        .when(op.isin("schema_changed", "schema_change"), "dataset_schema_changed")
        .when(~op.startswith("dataset_"), F.concat(F.lit("dataset_"), op))
        .otherwise(op)
    )


def activity_severity(
    operation: Column, accessed: Column, modified: Column, has_sensitive: Column, sensitivity: Column
) -> Column:
    op, level = F.lower(operation), F.upper(sensitivity)
    top = level.isin("CRITICAL", "HIGH")
    return (
        F.when(op.isin("dataset_exported", "export"), F.when(top | (accessed >= 5000), 10).otherwise(7))
        .when(op.isin("dataset_deleted", "delete"), F.when(top, 11).otherwise(8))
        .when(
            op.isin("dataset_modified", "modify"),
            F.when(modified >= 10000, 11).when(modified >= 1000, 7).otherwise(4),
        )
        .when(op.isin("schema_changed", "schema_change"), F.when(top, 8).otherwise(6))
        .when(
            op.isin("bulk_access", "bulk_read"),
            F.when((level == "CRITICAL") | has_sensitive, 10).when(accessed >= 50000, 8).otherwise(6),
        )
        .when(op == "sensitive_column_access", F.when(level == "CRITICAL", 9).otherwise(7))
        .otherwise(3)
    ).cast("int")


def event_dedup_key_activity(activity_id: Column, *fallback: Column) -> Column:
    """Activity id; without one a stable hash of the row."""
    own = F.when(activity_id != "", activity_id)
    if not fallback:
        return F.concat(F.lit("dset-act-"), own)
    seed = F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fallback])
    return F.concat(F.lit("dset-act-"), F.coalesce(own, F.substring(F.sha2(seed, 256), 1, 8)))


def activity_to_events(activities: DataFrame) -> DataFrame:
    """Dataset activities to events."""
    op = activity_operation(F.col("operation"))
    kind = activity_event_type(F.col("operation"))
    dataset_id = F.coalesce("dataset_id", F.lit("unknown_dataset"))
    dataset_name = F.coalesce("dataset_name", dataset_id)
    actor = F.coalesce(first_text(F.col("actor")), F.lit("unknown_actor"))
    host = F.coalesce(first_text(F.col("actor_host")), F.lit("workstation-01"))
    accessed = F.coalesce("records_accessed", F.lit(0))
    modified = F.coalesce("records_modified", F.lit(0))
    columns = F.coalesce("sensitive_columns", F.array().cast("array<string>"))
    context = F.coalesce("context", F.create_map().cast("map<string,string>"))
    sensitivity = F.coalesce(F.get(F.map_values(F.map_filter(context, lambda k, _: k == "sensitivity")), 0), F.lit("LOW"))
    records = F.when(accessed != 0, accessed).otherwise(modified)
    message = F.concat(
        F.lit("["), dataset_name, F.lit("] "), F.upper(kind), F.lit(" by actor '"), actor, F.lit("' (records: "),
        records.cast("string"), F.lit(", sensitive_cols: "), F.size(columns).cast("string"), F.lit(")"),
        F.coalesce(F.concat(F.lit(" exported to "), first_text(F.col("export_destination"))), F.lit("")),
    )
    metadata = F.create_map(
        F.lit("dataset_id"), dataset_id,
        F.lit("dataset_name"), dataset_name,
        F.lit("dataset_operation"), op,
        F.lit("records_accessed"), accessed.cast("string"),
        F.lit("records_modified"), modified.cast("string"),
        F.lit("sensitive_columns"), F.to_json(F.transform(columns, lambda c: redact(c))),
        F.lit("export_size_bytes"), F.coalesce("export_size_bytes", F.lit(0)).cast("string"),
        F.lit("export_destination"), redact(F.col("export_destination")),
        F.lit("sensitivity"), sensitivity,
        F.lit("context"), F.to_json(redact_map(context)),
    )
    return activities.select(
        event_dedup_key_activity(
            F.col("activity_id"), F.col("timestamp"), F.col("dataset_id"), F.col("operation"), F.col("actor")
        ).alias("event_id"),
        F.coalesce("timestamp", F.current_timestamp()).alias("timestamp"),
        F.lit(fv.DATASET_SOURCE).alias("source"),
        kind.alias("event_type"),
        activity_severity(op, accessed, modified, F.size(columns) > 0, sensitivity).alias("severity"),
        redact(message).alias("message"),
        redact(host).alias("host"), redact(actor).alias("user"),
        redact(F.col("source_ip")).alias("source_ip"), redact(F.col("destination_ip")).alias("destination_ip"),
        metadata.alias("metadata"),
    )
