"""Case and response logs.

A requested status is accepted or not depending on all earlier decisions, so a log is
replayed per case, as a parallel prefix (``replay.py``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import redact, short_id
from .replay import replay

# --- L01 seed ---------------------------------------------------------------------------


def case_id(incident_id: Column) -> Column:
    return short_id("case-", "case:", incident_id)


def case_priority(severity: Column) -> Column:
    return (
        F.when(severity >= 12, "critical").when(severity >= 8, "high").when(severity >= 4, "medium").otherwise("low")
    )


def seed_cases(
    incidents: DataFrame, dataset_name: str = "dataset", tags: Sequence[str] = (), investigations: DataFrame | None = None,
    now: Column | None = None,
) -> DataFrame:
    """One open case per incident; tags are the given ones plus the incident's."""
    moment = F.current_timestamp() if now is None else now
    given = F.array(*[redact(F.lit(t), "case", 64) for t in tags]) if tags else F.array().cast("array<string>")
    added = F.transform(
        F.filter("tags", lambda t: ~F.array_contains(given, t)), lambda t: redact(t, "case", 64)
    )
    if investigations is None:
        linked, links = incidents.withColumn("_inv", F.lit(None).cast("string")), F.array().cast("array<string>")
    else:
        latest = investigations.groupBy("incident_id").agg(
            F.max_by("investigation_id", F.struct("generated_at", "investigation_id")).alias("_inv")
        )
        linked = incidents.join(latest, "incident_id", "left")
        links = F.array_compact(F.array("_inv"))
    return linked.select(
        case_id(F.col("incident_id")).alias("case_id"),
        redact(F.lit(f"Dataset security case: {dataset_name}"), "case", 256).alias("title"),
        redact(F.concat(
            F.lit("Dataset security activity generated incident "), "incident_id",
            F.lit(". Review the linked alerts, correlations, risk assessment, and export activity."),
        ), "case", 5000).alias("description"),
        "severity", case_priority(F.col("severity")).alias("priority"), F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("assignee"), moment.alias("created_at"), moment.alias("updated_at"),
        F.coalesce("first_seen", moment).alias("first_seen"), F.coalesce("last_seen", moment).alias("last_seen"),
        F.array("incident_id").alias("incident_ids"), links.alias("investigation_ids"),
        F.concat(given, added).alias("tags"),
    )


# --- L02-L04 replay ---------------------------------------------------------------------


class Machine:
    """Status machine as two tables over (state, request code)."""

    def __init__(self, transitions: Mapping[str, Sequence[str]], start: str, noop_same: bool, resolution: bool):
        self.statuses = list(transitions)
        self.resolution = resolution
        self.start = self._state(start, False)
        self.codes = list(self.statuses) + (["resolve", "resolve_without_summary"] if resolution else [])
        self.next: list[int] = []
        self.verdict: list[str] = []
        for state in range(len(self.statuses) * (2 if resolution else 1)):
            status, resolved = self._parts(state)
            for code in self.codes:
                target, verdict = self._step(transitions, status, resolved, code, noop_same)
                self.next.append(target if verdict == "accepted" else state)
                self.verdict.append(verdict)
        self.states = range(len(self.next) // len(self.codes))

    def _state(self, status: str, resolved: bool) -> int:
        return self.statuses.index(status) * 2 + int(resolved) if self.resolution else self.statuses.index(status)

    def _parts(self, state: int) -> tuple[str, bool]:
        return (self.statuses[state // 2], bool(state % 2)) if self.resolution else (self.statuses[state], False)

    def _step(self, transitions, status: str, resolved: bool, code: str, noop_same: bool) -> tuple[int, str]:
        if code.startswith("resolve_") or (code == "resolve" and status not in ("in_progress", "pending")):
            return -1, "rejected"
        if code == "resolve":
            return self._state("resolved", True), "accepted"
        if code == status and noop_same:
            return -1, "unchanged"
        if code not in transitions[status] or (self.resolution and code == "closed" and not resolved):
            return -1, "rejected"
        return self._state(code, resolved), "accepted"

    def status_of(self, state: Column) -> Column:
        names = [self._parts(s)[0] for s in self.states]
        return F.get(F.array(*[F.lit(n) for n in names]), state)


CASE_MACHINE = Machine(fv.CASE_TRANSITIONS, "open", True, True)
RESPONSE_MACHINE = Machine(fv.RESPONSE_TRANSITIONS, "proposed", False, False)


def _coded(changes: DataFrame, machine: Machine) -> DataFrame:
    request = F.lower(F.trim("requested_status"))
    if machine.resolution:
        summary = redact(F.coalesce("summary", F.lit("")), "case", 3000)
        request = F.when(request == "resolve", F.when(summary != "", "resolve").otherwise("resolve_without_summary")).otherwise(request)
    code = F.array_position(F.array(*[F.lit(c) for c in machine.codes]), request) - 1
    return changes.select("entity_id", "ts", "seq", "requested_status", F.coalesce(code, F.lit(-1)).cast("int").alias("code"))


def replay_log(changes: DataFrame, machine: Machine) -> tuple[DataFrame, DataFrame]:
    """(every request with old status, new status and verdict; end status per entity).

    ``changes``: entity_id, ts, seq, requested_status and, for cases, summary. ``seq``
    orders requests of the same moment. Unknown statuses, null included, are rejected.
    """
    width = len(machine.codes)
    done = replay(_coded(changes, machine), "entity_id", ["ts", "seq", "code"], "code", machine.next, width, machine.start)
    verdicts = F.array(*[F.lit(v) for v in machine.verdict])
    verdict = F.when(F.col("code") >= 0, F.get(verdicts, F.col("_old") * width + F.col("code"))).otherwise("rejected")
    decided = done.rows.select(
        "entity_id", "ts", "seq", "requested_status", machine.status_of(F.col("_old")).alias("old_status"),
        machine.status_of(F.col("_new")).alias("new_status"), verdict.alias("verdict"),
    )
    return decided, done.final.select("entity_id", machine.status_of(F.col("state")).alias("status"))


def validate_case_transitions(changes: DataFrame) -> DataFrame:
    """Verdict on every requested case status."""
    return replay_log(changes, CASE_MACHINE)[0]


def validate_response_transitions(changes: DataFrame) -> DataFrame:
    """Verdict on every requested response status."""
    return replay_log(changes, RESPONSE_MACHINE)[0]


def current_state(changes: DataFrame, machine: Machine = CASE_MACHINE) -> DataFrame:
    """End status per entity; with an ``assignee`` column also the latest assignee."""
    final = replay_log(changes, machine)[1]
    if "assignee" not in changes.columns:
        return final
    latest = changes.where("assignee is not null").groupBy("entity_id").agg(
        F.max_by("assignee", F.struct("ts", "seq")).alias("assignee")
    )
    return final.join(latest, "entity_id", "left")


def resolutions(changes: DataFrame, decided: DataFrame) -> DataFrame:
    """Resolution per case, that of the last accepted resolve request; cases without one give no row."""
    kept = decided.where("lower(trim(requested_status)) = 'resolve' and verdict = 'accepted'").select("entity_id", "ts", "seq")
    return changes.join(kept, ["entity_id", "ts", "seq"]).groupBy("entity_id").agg(
        F.max_by(
            F.struct(redact(F.col("summary"), "case", 3000).alias("summary"), F.col("actor").alias("resolved_by"), F.col("ts").alias("resolved_at")),
            F.struct("ts", "seq"),
        ).alias("resolution")
    )


# --- L05-L09 ----------------------------------------------------------------------------


def evidence_id(case: Column, kind: Column, key: Column) -> Column:
    return short_id("evref-", case, ":", kind, ":", key)


def link_evidence(links: DataFrame) -> DataFrame:
    """One reference per (case, type, key), the earliest request wins.

    ``links``: case_id, evidence_type, reference_key, description, added_by, added_at.
    """
    return (
        links.groupBy("case_id", "evidence_type", "reference_key")
        .agg(F.min(F.struct("added_at", "added_by", "description")).alias("first"))
        .select(
            evidence_id(F.col("case_id"), F.col("evidence_type"), F.col("reference_key")).alias("evidence_id"),
            "case_id", "evidence_type", "reference_key",
            redact(F.col("first.description"), "case", 1000).alias("description"),
            redact(F.col("first.added_by"), "case", 256).alias("added_by"), F.col("first.added_at").alias("added_at"),
        )
    )


def linked_ids(evidence: DataFrame) -> DataFrame:
    """(case, incident or investigation) pairs that links add to a case."""
    return evidence.where(F.col("evidence_type").isin("incident", "investigation")).select(
        "case_id", "evidence_type", "reference_key"
    )


def case_notes(notes: DataFrame, limit: int | None = None) -> DataFrame:
    """Redacted notes, oldest first, with their position; all, or the first ``limit`` of each case. Empty ones go."""
    clean = notes.withColumn("content", redact(F.col("content"), "case")).where("content <> ''").withColumn(
        "author", redact(F.col("author"), "case", 256)
    )
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("created_at", "note_id"))
    ranked = clean.withColumn("position", rank)
    return ranked if limit is None else ranked.where(F.col("position") <= limit)


def case_timeline(audit: DataFrame, case: str | None = None) -> DataFrame:
    """Described audit entries of cases, oldest first."""
    meta = lambda key: F.get_json_object("metadata_json", f"$.{key}")
    none = lambda c: F.coalesce(c, F.lit("None"))
    a = F.col("action")
    text = (
        F.when(a == "case.created", F.concat(F.lit("Case created with priority "), F.coalesce(meta("priority"), F.lit("medium"))))
        .when(a == "case.status_changed", F.concat(F.lit("Status changed from "), none(meta("old_status")), F.lit(" to "), none(meta("new_status"))))
        .when(a == "case.assigned", F.concat(F.lit("Case assigned to "), none(meta("assignee"))))
        .when(a == "case.resolved", F.concat(F.lit("Case resolved: "), F.coalesce(meta("summary"), F.lit(""))))
        .when(a == "case.closed", F.lit("Case closed"))
        .when(a == "case.note_added", F.concat(F.lit("Analyst note added by "), "actor"))
        .when(a == "case.evidence_linked", F.concat(F.lit("Evidence linked: "), none(meta("evidence_type")), F.lit(" ("), none(meta("reference_key")), F.lit(")")))
        .when(a == "case.incident_linked", F.concat(F.lit("Incident "), none(meta("incident_id")), F.lit(" linked")))
        .when(a == "case.investigation_linked", F.concat(F.lit("AI Investigation "), none(meta("investigation_id")), F.lit(" linked")))
        .otherwise(F.concat(F.lit("Action '"), a, F.lit("' performed by "), "actor"))
    )
    wanted = audit.where(F.col("target").startswith("case-") if case is None else F.col("target") == case)
    out = wanted.select(
        F.col("target").alias("case_id"), "timestamp", "action", "actor", F.substring(text, 1, 1000).alias("description"),
        F.from_json("metadata_json", "map<string,string>").alias("metadata"),
    )
    return out.orderBy("case_id", "timestamp") if case is None else out.orderBy("timestamp")


def response_id(incident_id: Column, action_type: Column) -> Column:
    return short_id("resp-", "response:", incident_id, ":", action_type)


def propose_responses(
    incidents: DataFrame, requested: DataFrame | None = None, stored: DataFrame | None = None, now: Column | None = None
) -> DataFrame:
    """Proposed actions, once per (incident, type).

    ``requested`` (incident_id, action_type) defaults to every allowed type for every
    incident; types outside the allowed list are left out.
    """
    moment = F.current_timestamp() if now is None else now
    if requested is None:
        asked = incidents.withColumn("action_type", F.explode(F.array(*[F.lit(t) for t in fv.RESPONSE_TYPES])))
    else:
        asked = incidents.join(
            requested.where(F.col("action_type").isin(*fv.RESPONSE_TYPES)).dropDuplicates(["incident_id", "action_type"]),
            "incident_id",
        )
    tag = F.get(F.filter("tags", lambda t: t.contains("dataset:ds-")), 0)
    target = F.when(F.col("action_type") == "restrict_dataset_access", F.concat(F.lit("dataset:"), F.get(F.split(tag, "dataset:"), 1)))
    out = asked.select(
        response_id(F.col("incident_id"), F.col("action_type")).alias("action_id"), "incident_id", "action_type",
        F.lit("proposed").alias("status"), moment.alias("requested_at"), F.lit(None).cast("string").alias("approved_by"),
        F.lit(None).cast("timestamp").alias("executed_at"), F.concat(F.lit("Target: "), target).alias("result"),
    )
    return out if stored is None else out.join(stored.select("action_id"), "action_id", "left_anti")


def case_view(cases: DataFrame, notes: DataFrame, evidence: DataFrame, shown: int | None = None) -> DataFrame:
    """Cases with their notes nested (all, or the first ``shown``), and all notes and evidence references counted.

    Notes and evidence can be many, so in full they stay tables of their own (``case_notes``, ``link_evidence``).
    """
    note = F.struct("created_at", "note_id", "author", "content")
    shown = case_notes(notes).groupBy("case_id").agg(
        F.count("*").alias("note_count"),
        F.array_sort(F.collect_list(note if shown is None else F.when(F.col("position") <= shown, note))).alias("notes"),
    )
    refs = (
        evidence.groupBy("case_id", "evidence_type").agg(F.count("*").alias("n"))
        .groupBy("case_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("evidence_type", "n")))).alias("evidence_counts"))
    )
    return cases.join(shown, "case_id", "left").join(refs, "case_id", "left")
