"""Derived tables of one input folder, as a run of the whole analysis would leave them.

Tables that many queries read are written once to the session's shared folder (``stage``)
and read back; everything else stays lazy. All of it derives from the given tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import short_id
from ..operators import alerts as A
from ..operators import assess as Q
from ..operators import correlate as C
from ..operators import incidents as I
from ..operators import intel as T
from ..operators import lifecycle as L
from ..operators import normalize as N
from ..operators import profile as P
from ..operators import report as V
from ..operators import risk as R
from ..session import stage
from ..sources import sinks
from ..sources.bridge import table, to_security_events
from ..sources.readers import read_ti_feed

_OPEN: dict[tuple[str, str], "Workspace"] = {}


def open_workspace(spark: SparkSession, sf_dir: str) -> "Workspace":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]


def activities_from_events(raw: DataFrame) -> DataFrame:
    """Raw dataset activities from the ``events`` table; one per row."""
    n, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    names = [
        "dataset_opened", "dataset_read", "sensitive_column_access", "bulk_access", "dataset_modified",
        "dataset_copied", "dataset_exported", "dataset_deleted", "schema_changed",
    ]
    return raw.select(
        F.concat(F.lit("act-"), n).alias("activity_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("ds-"), u % 3).alias("dataset_id"),
        F.concat(F.lit("table "), u % 3).alias("dataset_name"),
        F.element_at(F.array(*[F.lit(x) for x in names]), (n % 9 + 1).cast("int")).alias("operation"),
        F.when(u % 10 == 0, "").otherwise(F.concat(F.lit("user-"), u % 20)).alias("actor"),
        F.when(u % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("host-"), u % 5)).alias("actor_host"),
        F.concat(F.lit("10.0.0."), u % 250).alias("source_ip"),
        F.when(n % 9 == 6, "203.0.113.88").alias("destination_ip"),
        (k * 200).alias("records_accessed"),
        F.when(n % 9 == 4, k * 150).otherwise(0).alias("records_modified"),
        F.when(n % 9 == 2, F.array(F.lit("email"), F.lit("user_token"))).otherwise(F.array().cast("array<string>")).alias("sensitive_columns"),
        F.when(n % 9 == 6, k * 1000000).otherwise(0).alias("export_size_bytes"),
        F.when(n % 9 == 6, F.concat(F.lit("ftp://host/?token="), n)).alias("export_destination"),
        F.create_map(F.lit("sensitivity"), F.when(u % 3 == 0, "CRITICAL").when(u % 3 == 1, "HIGH").otherwise("LOW")).alias("context"),
    )


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def events(self) -> DataFrame:
        return to_security_events(self.table("events"))

    @property
    def activities(self) -> DataFrame:
        return activities_from_events(self.table("events"))

    @property
    def live_alerts(self) -> DataFrame:
        """Alerts computed from the events, without a stored table."""
        return A.correlatable_alerts(self.events)

    @cached_property
    def alerts(self) -> DataFrame:
        return stage(self.live_alerts, "alerts")

    @cached_property
    def correlated(self) -> C.Correlations:
        found = C.correlate(self.alerts)
        return found._replace(correlations=stage(found.correlations, "correlations"))

    @cached_property
    def outcomes(self) -> DataFrame:
        return stage(self.correlated.outcomes, "outcomes")

    @property
    def correlations(self) -> DataFrame:
        return self.correlated.correlations

    @property
    def members(self) -> DataFrame:
        return self.correlated.members

    @property
    def incidents(self) -> DataFrame:
        return I.build_incidents(self.correlations, now=F.col("last_seen"))

    @property
    def incident_members(self) -> DataFrame:
        return I.incident_members(self.members)

    @cached_property
    def risks(self) -> DataFrame:
        scored = R.score_incidents(self.incidents, self.correlations, now=F.col("last_seen"))
        return stage(scored, "risks")

    @property
    def feed(self) -> DataFrame:
        return read_ti_feed(self.spark)

    @cached_property
    def iocs(self) -> DataFrame:
        return stage(T.incident_iocs(self.incident_members, self.events), "iocs")

    @cached_property
    def enrichments(self) -> DataFrame:
        at = F.lit("2024-02-01 00:00:00").cast("timestamp")
        return stage(T.enrich_incidents(self.iocs, self.feed, now=at), "enrichments")

    @cached_property
    def intel_summary(self) -> DataFrame:
        return stage(T.ti_summary(self.enrichments), "intel-summary")

    def renamed_tables(self) -> dict[str, tuple[DataFrame, list[str]]]:
        """Star-schema tables under names as they occur in business data."""
        customer = self.table("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
            F.col("c_nationkey").alias("national_id"), F.col("c_acctbal").alias("account_number"),
            F.col("c_mktsegment").alias("segment"),
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("order_no"), F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("secret"), F.col("o_totalprice").alias("payment"),
            F.col("o_orderdate").alias("ordered_at"), F.col("o_orderpriority").alias("export"),
        )
        supplier = self.table("supplier").select(
            F.col("s_suppkey").alias("key"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("base_salary"),
        )
        conversations = self.table("conversations").select(
            "conv_id", "turn", F.col("role").alias("email"), F.when(F.col("turn") > 0, F.col("text")).alias("phone"),
        )
        return {
            "customer": (customer, ["customer_id"]), "orders": (orders, ["order_no"]),
            "supplier": (supplier, ["key"]), "conversations": (conversations, ["conv_id", "turn"]),
        }

    @cached_property
    def column_profiles(self) -> DataFrame:
        """Column profiles of the renamed tables over all their rows."""
        out = None
        for name, (df, order) in self.renamed_tables().items():
            one = P.profile_columns(df, order, sample_rows=None).withColumn("table_name", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return stage(out, "column-profiles")

    @cached_property
    def catalog(self) -> DataFrame:
        assets = [
            P.profile_dataset(df, f"{name}.parquet", "parquet", order, sample_rows=None)
            for name, (df, order) in self.renamed_tables().items()
        ]
        return stage(P.profile_catalog(assets), "catalog")

    @cached_property
    def assessments(self) -> DataFrame:
        return stage(Q.assess_datasets(self.catalog, now=F.lit("2024-02-01").cast("timestamp")), "assessments")

    @cached_property
    def report_context(self) -> DataFrame:
        return stage(
            V.report_context(
                self.incidents, self.incident_members, self.alerts, self.events, self.risks, self.intel_summary
            ),
            "report-context",
        )

    @property
    def investigations(self) -> DataFrame:
        return V.investigate(self.report_context, now=F.col("created_at"))

    @property
    def cases(self) -> DataFrame:
        return L.seed_cases(
            self.incidents, "bridge", ["dataset:ds-0", "api_token review"], now=F.col("last_seen")
        )

    @property
    def responses(self) -> DataFrame:
        return L.propose_responses(self.incidents, now=F.col("last_seen"))

    def case_changes(self) -> DataFrame:
        """Requested case changes from the ``events`` table."""
        n = F.col("event_id")
        asked = ["in_progress", "pending", "resolve", "closed", "in_progress", "resolved", "open"]
        return self.table("events").select(
            F.concat(F.lit("case-"), F.col("user_id") % 97).alias("entity_id"),
            F.col("ts").cast("timestamp").alias("ts"), n.alias("seq"),
            F.element_at(F.array(*[F.lit(x) for x in asked]), (n % 7 + 1).cast("int")).alias("requested_status"),
            F.when(n % 14 == 2, "done").otherwise(" ").alias("summary"),
            F.concat(F.lit("analyst-"), n % 4).alias("actor"),
            F.when(n % 5 == 0, F.concat(F.lit("analyst-"), n % 3)).alias("assignee"),
        )

    def response_changes(self) -> DataFrame:
        n = F.col("event_id")
        asked = ["approved", "executed", "failed", "rejected"]
        return self.table("events").select(
            F.concat(F.lit("resp-"), F.floor(n / 3)).alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"),
            n.alias("seq"),
            F.element_at(F.array(*[F.lit(x) for x in asked]), (n * 7 % 11 % 4 + 1).cast("int")).alias("requested_status"),
        )

    def case_notes(self) -> DataFrame:
        n = F.col("conv_id")
        return self.table("conversations").select(
            F.concat(F.lit("case-"), n % 97).alias("case_id"), F.concat(F.lit("note-"), n, F.lit("-"), "turn").alias("note_id"),
            F.concat(F.lit("author "), "role").alias("author"), F.col("text").alias("content"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=(n * 60 + F.col("turn")))).alias("created_at"),
        )

    def evidence_links(self) -> DataFrame:
        n = F.col("event_id")
        kinds = ["event", "alert", "incident", "investigation"]
        return self.table("events").select(
            F.concat(F.lit("case-"), F.col("user_id") % 97).alias("case_id"),
            F.element_at(F.array(*[F.lit(x) for x in kinds]), (n % 4 + 1).cast("int")).alias("evidence_type"),
            F.concat(F.lit("ref-"), n % 40).alias("reference_key"), F.lit("linked with token").alias("description"),
            F.concat(F.lit("analyst-"), n % 4).alias("added_by"), F.col("ts").cast("timestamp").alias("added_at"),
        )

    def audit(self) -> DataFrame:
        """Audit rows of cases from the ``events`` table, all action kinds."""
        n = F.col("event_id")
        actions = [
            "case.created", "case.status_changed", "case.assigned", "case.resolved", "case.closed", "case.note_added",
            "case.evidence_linked", "case.incident_linked", "case.investigation_linked", "case.updated",
        ]
        meta = F.to_json(F.struct(
            F.lit("high").alias("priority"), F.lit("open").alias("old_status"), F.lit("in_progress").alias("new_status"),
            F.concat(F.lit("analyst-"), n % 3).alias("assignee"), F.lit("all good").alias("summary"),
            F.lit("alert").alias("evidence_type"), F.concat(F.lit("ref-"), n % 40).alias("reference_key"),
            F.concat(F.lit("inc-"), n % 9).alias("incident_id"),
        ))
        return self.table("events").select(
            short_id("audit-", n.cast("string")).alias("audit_id"), F.col("ts").cast("timestamp").alias("timestamp"),
            F.concat(F.lit("analyst-"), n % 4).alias("actor"),
            F.element_at(F.array(*[F.lit(x) for x in actions]), (n % 10 + 1).cast("int")).alias("action"),
            F.concat(F.lit("case-"), F.col("user_id") % 97).alias("target"), F.lit("accepted").alias("result"),
            meta.alias("metadata_json"),
        )

    def measurements(self) -> DataFrame:
        """(key, ts, value) rows of the events table."""
        return self.table("events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value")

    def scored_documents(self) -> DataFrame:
        """Labels with a score from the length of their document."""
        docs = self.table("documents").select("doc_id", "n_chars")
        return self.table("labels").join(docs, "doc_id").select(
            F.col("doc_id").alias("id"), F.col("quality").alias("label"),
            (F.pmod(F.col("n_chars"), F.lit(101)) / 100).alias("score"),
            F.when(F.pmod(F.col("n_chars"), F.lit(101)) >= 50, 1).otherwise(0).alias("prediction"),
        )


__all__ = ["Workspace", "activities_from_events", "open_workspace", "sinks", "Column", "N"]
