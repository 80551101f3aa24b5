"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import correlate as C
from ..operators import incidents as I
from ..sources.bridge import security_events
from . import queries_cases, queries_intake, queries_views  # noqa: F401  (register themselves)
from .registry import oracle_sql, queries

__all__ = ["flagship", "oracle_sql", "queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rule = next(r for r in C.endpoint_rules() if r.correlation_type == "process_network_sequence")
    found = C.correlate(A.correlatable_alerts(security_events(spark, sf_dir)), [rule])
    return I.build_incidents(found.correlations, now=F.col("last_seen")).select(
        "incident_id", "title", "severity", "first_seen", "last_seen", "alert_count", "event_count", "mitre_techniques"
    )
