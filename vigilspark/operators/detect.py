"""Detection rules as column predicates (D01-D12) and the custom-rule hook.

A rule is a predicate plus an evidence map, both plain Columns. ``detect`` evaluates all
rules in one scan: one array of hits per event, exploded. No union, no shuffle, no UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import present, words_in

Expr = Callable[[], Column]


@dataclass(frozen=True)
class DetectionRule:
    """A detection rule over normalized events.

    ``severity`` is the fixed severity of the rule's alerts; ``None`` means the event's own,
    which then lies in ``severity_levels``.
    """

    rule_id: str
    name: str
    description: str
    severity: int | None
    predicate: Expr
    evidence: dict[str, Expr] = field(default_factory=dict)
    mitre: tuple[str, ...] = ()
    severity_levels: tuple[int, ...] = tuple(range(16))

    def matches(self) -> Column:
        return F.coalesce(self.predicate(), F.lit(False))

    def evidence_map(self) -> Column:
        pairs: list[Column] = []
        for key, value in self.evidence.items():
            pairs += [F.lit(key), value().cast("string")]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def meta(key: str) -> Column:
    return F.col("metadata").getItem(key)


def _number(key: str) -> Column:
    return F.coalesce(meta(key).try_cast("bigint"), F.lit(0).cast("bigint"))


def _col(name: str) -> Expr:
    return lambda: F.col(name)


def _meta(key: str) -> Expr:
    return lambda: meta(key)


def _text(value: object) -> Expr:
    return lambda: F.lit(value)


def _indicators() -> Column:
    message = F.lower("message")
    found = [F.when(message.contains(w), F.lit(w)) for w in fv.PROCESS_INDICATORS]
    return F.array_compact(F.array(*found))


def _dataset(condition: Expr) -> Expr:
    return lambda: (F.col("source") == fv.DATASET_SOURCE) & condition()


def _is(types: Sequence[str]) -> Column:
    return F.col("event_type").isin(*types)


def _sensitive_columns() -> Column:
    return F.from_json(meta("sensitive_columns"), "array<string>")


def _sensitive_count() -> Column:
    return F.greatest(F.size(F.coalesce(_sensitive_columns(), F.array().cast("array<string>"))), F.lit(0))


def _unusual_actor() -> Column:
    return words_in(F.lower(F.coalesce("user", F.lit(""))), fv.UNUSUAL_ACTOR_PARTS)


def _external_ip() -> Column:
    ip = F.coalesce("source_ip", F.lit(""))
    internal = F.lit(False)
    for prefix in fv.INTERNAL_PREFIXES:
        internal = internal | ip.startswith(prefix)
    return (ip != "") & ~internal


BUILTIN_RULES: tuple[DetectionRule, ...] = (
    DetectionRule(
        "builtin-001", "High Severity Event",
        "Detects events with severity at or above the high-severity threshold (10).",
        None, lambda: F.col("severity") >= fv.HIGH_SEVERITY,
        {"matched_field": _text("severity"), "matched_value": _col("severity"), "threshold": _text(fv.HIGH_SEVERITY)},
        severity_levels=tuple(range(fv.HIGH_SEVERITY, 16)),
    ),
    DetectionRule(
        "builtin-002", "Suspicious Process Execution",
        "Detects process-start events referencing suspicious paths or encoded commands.",
        10, lambda: (F.col("event_type") == "process_start") & words_in(F.lower("message"), fv.PROCESS_INDICATORS),
        {"matched_field": _text("message"), "event_type": _col("event_type"),
         "indicators_matched": lambda: F.to_json(_indicators()), "host": _col("host")},
        ("T1059",),
    ),
    DetectionRule(
        "builtin-003", "Authentication Failure", "Detects authentication or login failure events.",
        6, lambda: _is(fv.AUTH_FAILURE_TYPES),
        {"matched_field": _text("event_type"), "event_type": _col("event_type"), "user": _col("user"),
         "source_ip": _col("source_ip"), "host": _col("host")},
        ("T1110",),
    ),
    DetectionRule(
        "builtin-004", "Network Connection Anomaly",
        "Detects network connection events with a recorded destination address.",
        6, lambda: (F.col("event_type") == "network_connection") & present(F.col("destination_ip")),
        {"matched_field": _text("event_type"), "event_type": _col("event_type"),
         "destination_ip": _col("destination_ip"), "source_ip": _col("source_ip"), "host": _col("host")},
        ("T1071",),
    ),
    DetectionRule(
        "builtin-005", "Privilege Escalation Indicator",
        "Detects events indicating potential privilege escalation activity.",
        12, lambda: _is(fv.PRIVILEGE_TYPES) | F.lower("message").contains("privilege"),
        {"matched_field": lambda: F.when(_is(fv.PRIVILEGE_TYPES), "event_type").otherwise("message"),
         "event_type": _col("event_type"), "type_match": lambda: _is(fv.PRIVILEGE_TYPES),
         "message_match": lambda: F.lower("message").contains("privilege"),
         "user": _col("user"), "host": _col("host")},
        ("T1548",),
    ),
    DetectionRule(
        "dataset-001", "Bulk Sensitive Dataset Access",
        "Detects bulk dataset reads accessing a large record volume (>= 10000) or flagged as bulk_access operation.",
        8, _dataset(lambda: _is(fv.BULK_TYPES) | (_number("records_accessed") >= fv.BULK_RECORDS)),
        {"dataset_id": _meta("dataset_id"), "dataset_name": _meta("dataset_name"),
         "records_accessed": lambda: _number("records_accessed"), "bulk_threshold": _text(fv.BULK_RECORDS),
         "is_bulk_op": lambda: _is(fv.BULK_TYPES), "actor": _col("user"), "host": _col("host")},
        ("T1530",),
    ),
    DetectionRule(
        "dataset-002", "Sensitive Column Access",
        "Detects dataset access events that touch sensitive or PII-tagged columns.",
        9, _dataset(lambda: (_sensitive_count() > 0) | (F.col("event_type") == "sensitive_column_access")),
        {"dataset_id": _meta("dataset_id"), "dataset_name": _meta("dataset_name"),
         "sensitive_columns": lambda: F.coalesce(meta("sensitive_columns"), F.lit("[]")),
         "sensitive_column_count": _sensitive_count,
         "dataset_sensitivity": lambda: F.upper(F.coalesce(meta("sensitivity"), F.lit("LOW"))),
         "actor": _col("user"), "host": _col("host")},
        ("T1530",),
    ),
    DetectionRule(
        "dataset-003", "Suspicious Dataset Export",
        "Detects dataset export operations that may represent data staging or exfiltration.",
        10, _dataset(lambda: _is(fv.EXPORT_TYPES) | present(meta("export_destination")) | present(F.col("destination_ip"))),
        {"dataset_id": _meta("dataset_id"), "dataset_name": _meta("dataset_name"),
         "export_destination": _meta("export_destination"),
         "export_size_bytes": lambda: F.coalesce(meta("export_size_bytes"), F.lit("0")),
         "records_accessed": lambda: F.coalesce(meta("records_accessed"), F.lit("0")),
         "destination_ip": _col("destination_ip"), "actor": _col("user")},
        ("T1567",),
    ),
    DetectionRule(
        "dataset-004", "Unusual or New Dataset Actor",
        "Detects dataset access from actors with unusual identifiers or source IPs that look atypical "
        "(e.g., external, loopback, test accounts).",
        7, _dataset(lambda: _unusual_actor() | _external_ip()),
        {"dataset_id": _meta("dataset_id"), "actor": _col("user"),
         "source_ip": lambda: F.coalesce("source_ip", F.lit("")),
         "is_unusual_actor": _unusual_actor, "is_external_ip": _external_ip},
    ),
    DetectionRule(
        "dataset-005", "Mass Dataset Modification",
        "Detects bulk modification or deletion of dataset records (>= 5000 records affected).",
        11, _dataset(lambda: _is(fv.MODIFY_TYPES)
                     & (F.greatest(_number("records_modified"), _number("records_accessed")) >= fv.MASS_MODIFY_RECORDS)),
        {"dataset_id": _meta("dataset_id"), "dataset_name": _meta("dataset_name"),
         "records_modified": lambda: _number("records_modified"),
         "records_accessed": lambda: _number("records_accessed"), "operation": _col("event_type"),
         "actor": _col("user"), "threshold": _text(fv.MASS_MODIFY_RECORDS)},
        ("T1485",),
    ),
    DetectionRule(
        "dataset-006", "Unexpected Dataset Schema Change",
        "Detects schema changes to tracked datasets, which may indicate tampering or unauthorized modification.",
        8, _dataset(lambda: _is(fv.SCHEMA_TYPES)),
        {"dataset_id": _meta("dataset_id"), "dataset_name": _meta("dataset_name"), "actor": _col("user"),
         "host": _col("host"), "event_type": _col("event_type")},
        ("T1098",),
    ),
)


def detect(events: DataFrame, rules: Sequence[DetectionRule] = BUILTIN_RULES) -> DataFrame:
    """All rule hits of all events, in registry order; the event columns are kept.

    Only rule numbers are exploded. What a hit says is looked up afterwards, so columns
    nobody asks for (evidence maps above all) are never built.
    """
    numbers = F.array_compact(F.array(*[F.when(r.matches(), F.lit(i)) for i, r in enumerate(rules)]))
    number = F.col("rule_order")

    def fixed(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), number)

    def chosen(values: list[Column]) -> Column:
        out = F.when(number == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            out = out.when(number == i, value)
        return out

    severity = chosen([F.col("severity") if r.severity is None else F.lit(r.severity) for r in rules])
    techniques = F.get(
        F.array(*[F.array(*[F.lit(m) for m in r.mitre]) if r.mitre else F.array().cast("array<string>") for r in rules]),
        number,
    )
    return events.withColumn("rule_order", F.explode(numbers)).select(
        *[F.col(c).alias("event_severity") if c == "severity" else F.col(c) for c in events.columns],
        fixed([r.rule_id for r in rules]).alias("rule_id"),
        fixed([r.name for r in rules]).alias("rule_name"),
        "rule_order",
        severity.cast("int").alias("severity"),
        fixed([r.description for r in rules]).alias("description"),
        techniques.alias("mitre_techniques"),
        chosen([r.evidence_map() for r in rules]).alias("evidence"),
    )


def detect_one(events: DataFrame, rule_id: str, rules: Sequence[DetectionRule] = BUILTIN_RULES) -> DataFrame:
    """Hits of a single rule."""
    return detect(events, [r for r in rules if r.rule_id == rule_id])
