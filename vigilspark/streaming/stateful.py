"""Correlation of an alert stream with keyed state.

The state of a (type, entity) is what the rules can still ask for: alerts that wait for the watermark, those
within one window of the newest one, and the open episode. Event-time timers release waiting
alerts in event order once the watermark has passed them, and clear the state a window after the
last one. A batch reads no history: its cost is its own alerts and the state of their entities.

Every trigger gives a row of the change log, every alert that joins an episode another; the log is
append-only, and the current correlations are an aggregate of it. The rules are those of the batch.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import short_id
from ..operators.correlate import KEY, CorrelationRule, all_rules, correlation_matches, participations
from ..operators.detect import BUILTIN_RULES, DetectionRule

ALERT = (
    "ts_us bigint, event_id string, rule_order int, alert_id string, rule_no int, level int, rule_id string, severity int, "
    "dataset_id string, dataset_name string, window_us bigint, asks array<int>"
)
NAMES = [c.split()[0] for c in ALERT.split(", ")]
RECENT = "ts_us bigint, event_id string, alert_id string, rule_no int, level int, rule_id string, severity int, dataset_id string, member boolean, window_us bigint"
OPEN = (
    "last_us bigint, first_us bigint, founding_alert_id string, founding_event_id string, alert_count bigint, event_count bigint, trigger_count bigint"
)
LOG = (
    "kind string, correlation_type string, entity_key string, founding_alert_id string, founding_event_id string, first_us bigint, "
    "alert_id string, event_id string, ts_us bigint, rule_id string, rule_order int, severity int, dataset_id string, dataset_name string, "
    "window_us bigint, partners bigint, matched array<struct<no:int,level:int>>, alert_count bigint, event_count bigint, trigger_count bigint, grew boolean"
)
LOG_NAMES = [c.split()[0] for c in LOG.replace("<no:int,level:int>", "").split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Recent:
    """Alerts within a window of the newest one, counted by kind (rule and level)."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows = deque(list(r) for r in rows)
        self.kinds = Counter((r[3], r[4]) for r in self.rows)
        self.restart(keep=True)

    def restart(self, keep: bool = False) -> None:
        """Sorts out who may still join; unless ``keep``, nobody is a member any more."""
        self.free: dict[int, list[list]] = {}
        self.events: set[str] = set()
        for row in self.rows:
            row[8] = keep and row[8]
            if row[8]:
                self.events.add(row[1])
            else:
                self.free.setdefault(row[3], []).append(row)

    def forget(self, before_us: int) -> None:
        while self.rows and self.rows[0][0] < before_us:
            row = self.rows.popleft()
            self.kinds[row[3], row[4]] -= 1

    def add(self, alert: Row) -> list:
        row = [alert.ts_us, alert.event_id, alert.alert_id, alert.rule_no, alert.level, alert.rule_id, alert.severity, alert.dataset_id, False, alert.window_us]
        self.rows.append(row)
        self.kinds[alert.rule_no, alert.level] += 1
        self.free.setdefault(alert.rule_no, []).append(row)
        return row

    def partners(self, alert: Row) -> dict[tuple, int]:
        own = (alert.rule_no, alert.level)
        found = {k: n - (k == own) for k, n in self.kinds.items() if k[0] in alert.asks}
        return {k: n for k, n in found.items() if n > 0}

    def join(self, alert: Row, row: list, before_us: int) -> list[list]:
        """Members that this trigger adds: alerts that it asks for, and itself."""
        new = [r for no in set(alert.asks) for r in self.free.pop(no, ()) if r[0] >= before_us and r is not row and not r[8]]
        new += [] if row[8] else [row]
        for r in new:
            r[8] = True
        return new


class CorrelateKey(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ALERT)
        self.recent = handle.getListState("recent", RECENT)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in NAMES) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [Row(*NAMES)(*r) for r in self.waiting.get()]
        ready = sorted((a for a in waiting if a.ts_us <= mark), key=lambda a: (a.ts_us, a.event_id, a.rule_order))
        later = [a for a in waiting if a.ts_us > mark]
        recent, episode = Recent(self.recent.get()), self.open.get() if self.open.exists() else None
        seen = {r[2] for r in recent.rows}
        for (at, _), siblings in groupby(ready, key=lambda a: (a.ts_us, a.event_id)):
            fresh = {a.alert_id: a for a in siblings if a.alert_id not in seen}  # an alert that comes again counts once
            recent_rows = []
            for alert in fresh.values():
                window = alert.window_us
                recent.forget(at - window)
                recent_rows.append((alert, recent.add(alert)))
            seen |= fresh.keys()
            for alert, row in recent_rows:
                partners = recent.partners(alert)
                if not partners:
                    continue
                if episode is None or episode[0] < at - window:
                    episode = None
                    recent.restart()
                added = recent.join(alert, row, at - window)
                if episode is None:
                    episode = (at, min(r[0] for r in added), min(r[2] for r in added), alert.event_id, 0, 0, 0)
                events = {r[1] for r in added} - recent.events
                recent.events |= events
                _, first, founder, event, alerts, n_events, triggers = episode
                episode = (at, first, founder, event, alerts + len(added), n_events + len(events), triggers + 1)
                yield from self._rows(key, alert, partners, episode, added)
        self._keep(recent, episode, later, mark)

    def _rows(self, key, alert: Row, partners: dict, episode: tuple, added: list[list]) -> Iterator[Row]:
        _, first, founder, event, alerts, events, triggers = episode
        log, common = Row(*LOG_NAMES), (*key, founder, event, first)
        kinds = sorted({*partners, (alert.rule_no, alert.level)}, key=lambda k: (k[0], k[1] is not None, k[1]))
        matched = [Row(no=no, level=level) for no, level in kinds]
        yield log(
            "trigger", *common, alert.alert_id, alert.event_id, alert.ts_us, alert.rule_id, alert.rule_order, alert.severity, alert.dataset_id,
            alert.dataset_name, alert.window_us, sum(partners.values()), matched, alerts, events, triggers, bool(added),
        )
        for ts_us, event_id, alert_id, _, _, rule_id, severity, dataset_id, *_ in added:
            yield log("member", *common, alert_id, event_id, ts_us, rule_id, None, severity, dataset_id, *[None] * 8)

    def _keep(self, recent: Recent, episode: tuple | None, later: list[Row], mark: int) -> None:
        """What alerts after the watermark may still ask for, and a timer for the next release or for the end of it all."""
        window = recent.rows[-1][9] if recent.rows else 0
        recent.forget(mark - window)
        if later:
            self.waiting.put([tuple(a) for a in later])
            self.handle.registerTimer(-(-min(a.ts_us for a in later) // 1000))
        else:
            self.waiting.clear()
        if recent.rows:
            self.recent.put([tuple(r) for r in recent.rows])
            self.handle.registerTimer((recent.rows[-1][0] + window) // 1000 + 1)
        else:
            self.recent.clear()
        if episode is not None and recent.rows and episode[0] >= mark - window:
            self.open.update(episode)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def correlation_log(
    alerts: DataFrame, rules: Sequence[CorrelationRule] | None = None, detection: Sequence[DetectionRule] = BUILTIN_RULES, lateness: int = 3600
) -> DataFrame:
    """The change log of a stream of alerts, which may come up to ``lateness`` seconds behind the newest one.

    Later ones are dropped by the watermark and counted in the query's progress. An alert id that comes again
    while its window is in the state counts once.
    """
    rules = all_rules(detection) if rules is None else list(rules)
    alerts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the store that keyed state needs
    parts = participations(alerts.withWatermark("timestamp", f"{lateness} seconds"), rules, detection, keep=())
    return parts.select(*KEY, "timestamp", *NAMES).groupBy(*KEY).transformWithState(
        statefulProcessor=CorrelateKey(), outputStructType=LOG, outputMode="Append", timeMode="EventTime"
    )


def stream_correlations(
    alerts: DataFrame, path: str, checkpoint: str, rules: Sequence[CorrelationRule] | None = None,
    detection: Sequence[DetectionRule] = BUILTIN_RULES, lateness: int = 3600,
) -> DataStreamWriter:
    """Appends the change log to Parquet files below ``path``, each row once; start with a trigger of your choice."""
    log = correlation_log(alerts, rules, detection, lateness)
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def _id() -> Column:
    return short_id("corr-", F.col("correlation_type"), ":", F.col("entity_key"), ":", F.col("founding_alert_id")).alias("correlation_id")


def current_correlations(
    log: DataFrame, rules: Sequence[CorrelationRule] | None = None, detection: Sequence[DetectionRule] = BUILTIN_RULES
) -> DataFrame:
    """One row per correlation, as the batch gives it: title and techniques of its first trigger, description and
    evidence of the last that added alerts, counts of the last."""
    rules = all_rules(detection) if rules is None else list(rules)
    kept = ["founding_alert_id", "founding_event_id", "first_us", "alert_count", "event_count", "trigger_count", "grew"]
    shown = log.where("kind = 'trigger'").withColumns({
        "timestamp": F.timestamp_micros("ts_us"), "bin": F.lit(0), "trigger_alerts": F.col("alert_count"),
    })
    found = correlation_matches(shown, rules, detection, keep=[*(c for c in kept if c != "alert_count"), "trigger_alerts"])
    order = F.struct("ts_us", "event_id", "rule_order")
    growing = F.when(F.col("grew"), order)
    return (
        found.withColumn("correlation_id", _id()).groupBy("correlation_id", *KEY, "founding_alert_id")
        .agg(
            F.min_by(F.struct("title", "mitre_techniques", F.col("correlation_rule_id").alias("rule_id"), "founding_event_id", "first_us"), order).alias("first"),
            F.max_by(F.struct("ts_us", F.col("trigger_alerts").alias("alert_count"), "event_count", "trigger_count"), F.struct("trigger_count", order)).alias("last"),
            F.max_by(F.struct("description", "evidence"), growing).alias("grown"), F.max("severity").alias("severity"),
        )
        .select(
            "correlation_id", "first.rule_id", *KEY, "first.title", "grown.description", "severity", F.lit("open").alias("status"),
            F.timestamp_micros("first.first_us").alias("first_seen"), F.timestamp_micros("last.ts_us").alias("last_seen"),
            "last.alert_count", "last.event_count", "last.trigger_count", "first.mitre_techniques", "grown.evidence", "founding_alert_id",
            "first.founding_event_id",
        )
    )


def current_members(log: DataFrame) -> DataFrame:
    """One row per alert of a correlation."""
    return log.where("kind = 'member'").select(
        _id(), *KEY, "alert_id", "event_id", F.timestamp_micros("ts_us").alias("timestamp"), "rule_id", "severity", "dataset_id"
    )
