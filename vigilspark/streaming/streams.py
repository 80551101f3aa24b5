"""Streaming forms (X01-X06). The batch functions run unchanged on streams where they are
stateless; correlation runs per micro-batch on the new alerts and the last two windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.alerts import ENTITY_COLUMNS, build_alerts
from ..operators.correlate import CorrelationRule, Correlations, all_rules, correlate, correlate_increment
from ..operators.detect import BUILTIN_RULES, DetectionRule, detect
from ..operators.lookup import latest_per
from ..sources.buckets import BUCKETS, BucketTable

MAX_WINDOW = "3600 seconds"


def stream_dedup(events: DataFrame, lateness: str = MAX_WINDOW) -> DataFrame:
    """An event id that comes again within the watermark is ignored."""
    return events.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])


def stream_detect(events: DataFrame, rules: Sequence[DetectionRule] = BUILTIN_RULES) -> DataFrame:
    """Alerts with entities as events arrive. Stateless, append mode."""
    return build_alerts(detect(events, rules), keep=ENTITY_COLUMNS)


class BatchLog:
    """Append-only table, one folder per micro-batch; writing a batch again replaces it."""

    def __init__(self, path: str):
        self.path = path

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession, schema: T.StructType | str, before: int | None = None) -> DataFrame:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        try:
            df = spark.read.schema(full).option("basePath", self.path).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], full)
        return df if before is None else df.where(F.col("batch") < before)


MEMBER_SCHEMA = (
    "correlation_id string, correlation_type string, entity_key string, alert_id string, event_id string, "
    "timestamp timestamp, rule_id string, severity int, dataset_id string"
)
CORRELATION_SCHEMA = (
    "correlation_id string, rule_id string, correlation_type string, entity_key string, title string, "
    "description string, severity int, status string, first_seen timestamp, last_seen timestamp, alert_count bigint, "
    "event_count bigint, trigger_count bigint, mitre_techniques array<string>, evidence map<string,string>, "
    "founding_alert_id string, founding_event_id string"
)
OUTCOME_SCHEMA = "event_id string, correlation_id string, outcome string"


class CorrelationSink:
    """Keeps correlations up to date from a stream of alerts.

    Event time defines the order, and alerts may come up to ``lateness`` seconds behind the newest
    one (X04). Alerts older than the newest by more than that are closed: their correlations are
    logged and don't change any more. Those after the mark are pending; ``current`` and
    ``current_members`` add what they do so far. An alert that comes behind the mark is kept in
    ``late``; ``replayed`` correlates everything anew with them.

    Logs below ``path``: alerts, marks (one row a batch), correlations (every change; the newest row
    per id is the current one), members, outcomes and late.
    """

    def __init__(
        self, path: str, rules: Sequence[CorrelationRule] | None = None,
        detection: Sequence[DetectionRule] = BUILTIN_RULES, lateness: int = 3600,
    ):
        self.rules = all_rules(detection) if rules is None else list(rules)
        self.detection, self.lateness = detection, lateness
        self.alerts, self.correlations = BatchLog(f"{path}/alerts"), BatchLog(f"{path}/correlations")
        self.members, self.outcomes = BatchLog(f"{path}/members"), BatchLog(f"{path}/outcomes")
        self.late, self.marks = BatchLog(f"{path}/late"), BatchLog(f"{path}/marks")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # an id seen twice in the batch counts once; ids already stored are dropped
        batch = batch.dropDuplicates(["alert_id"])
        span = batch.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).first()
        if span["hi"] is None:
            return
        closed = self._mark(spark, before=batch_id)
        same_time = self.alerts.read(spark, batch.schema, before=batch_id).where(F.col("timestamp").between(F.lit(span["lo"]), F.lit(span["hi"])))
        fresh = batch.join(same_time.select("alert_id"), "alert_id", "left_anti")
        on_time = F.lit(True) if closed is None else F.col("timestamp") >= F.lit(closed)
        self.late.write(fresh.where(~on_time), batch_id)
        self.alerts.write(fresh.where(on_time), batch_id)
        mark = F.lit(span["hi"]) - F.make_dt_interval(secs=F.lit(self.lateness))
        marks = spark.range(1).select((mark if closed is None else F.greatest(mark, F.lit(closed))).alias("mark"))
        self.marks.write(marks, batch_id)
        stored = self.alerts.read(spark, batch.schema, before=batch_id + 1).drop("batch")
        past = F.lit(False) if closed is None else F.col("timestamp") < F.lit(closed)
        ready = stored.where(~past & (F.col("timestamp") < F.lit(self._mark(spark, before=batch_id + 1))))
        done = correlate_increment(
            ready, stored.where(past), self._logged(spark, before=batch_id),
            self.members.read(spark, MEMBER_SCHEMA, before=batch_id).drop("batch"), self.rules, self.detection,
        )
        if done is None:
            return
        self.members.write(done.members, batch_id)
        self.correlations.write(done.correlations, batch_id)
        self.outcomes.write(done.outcomes, batch_id)

    def _mark(self, spark: SparkSession, before: int | None = None):
        """Alerts before this time are closed."""
        return self.marks.read(spark, "mark timestamp", before).agg(F.max("mark").alias("mark")).first()["mark"]

    def _logged(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        log = self.correlations.read(spark, CORRELATION_SCHEMA, before)
        return latest_per(log, "correlation_id", "batch", "correlation_id").drop("batch")

    def _pending(self, spark: SparkSession) -> Correlations | None:
        """What the alerts after the mark do to the closed correlations."""
        mark = self._mark(spark)
        if mark is None:
            return None
        alerts = spark.read.option("basePath", self.alerts.path).parquet(self.alerts.path).drop("batch")
        return correlate_increment(
            alerts.where(F.col("timestamp") >= F.lit(mark)), alerts.where(F.col("timestamp") < F.lit(mark)), self._logged(spark),
            self.members.read(spark, MEMBER_SCHEMA).drop("batch"), self.rules, self.detection,
        )

    def current(self, spark: SparkSession) -> DataFrame:
        """Current correlations: the closed ones and what is pending."""
        logged, pending = self._logged(spark), self._pending(spark)
        if pending is None:
            return logged
        changed = pending.correlations
        return logged.join(changed.select("correlation_id"), "correlation_id", "left_anti").unionByName(changed.select(*logged.columns))

    def current_members(self, spark: SparkSession) -> DataFrame:
        logged, pending = self.members.read(spark, MEMBER_SCHEMA).drop("batch"), self._pending(spark)
        return logged if pending is None else logged.unionByName(pending.members.select(*logged.columns))

    def replayed(self, spark: SparkSession) -> Correlations:
        """Correlations of all alerts, the late ones included; nothing stored is changed."""
        logs = [spark.read.option("basePath", log.path).parquet(log.path).drop("batch") for log in (self.alerts, self.late)]
        return correlate(logs[0].unionByName(logs[1]), self.rules, self.detection)


def stream_correlate(alerts: DataFrame, sink: CorrelationSink, checkpoint: str) -> DataStreamWriter:
    """Start with ``.trigger(...)`` of your choice and ``.start()``."""
    return alerts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def stream_upsert(
    df: DataFrame, path: str, key: str, mutable: Sequence[str], checkpoint: str, buckets: int = BUCKETS, order: str | None = None
) -> DataStreamWriter:
    """Every micro-batch is merged into the table's touched buckets; one that is run again changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        BucketTable(batch.sparkSession, path, key, df.schema, buckets).merge(batch, batch_id, mutable, order)

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def stream_windows(
    alerts: DataFrame, seconds: int, slide: int | None = None, entity: Callable | None = None, lateness: str = MAX_WINDOW
) -> DataFrame:
    """Alerts per rule and entity in fixed or sliding windows."""
    who = F.coalesce("host", F.lit("")) if entity is None else entity()
    span = F.window("timestamp", f"{seconds} seconds", f"{slide or seconds} seconds")
    return (
        alerts.withWatermark("timestamp", lateness).groupBy(span, "rule_id", who.alias("entity")).agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rule_id", "entity", "n")
    )


def stream_sessions(alerts: DataFrame, gap_seconds: int, entity: Callable | None = None, lateness: str = MAX_WINDOW) -> DataFrame:
    """Runs of alerts per rule and entity without a gap; the native form of C01."""
    who = F.coalesce("user", F.lit("")) if entity is None else entity()
    return (
        alerts.withWatermark("timestamp", lateness)
        .groupBy(F.session_window("timestamp", f"{gap_seconds} seconds").alias("w"), "rule_id", who.alias("entity"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rule_id", "entity", "n")
    )
