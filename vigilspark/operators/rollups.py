"""Rollups for analysts (G01-G15). Aggregates with map-side combining, then small windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 12
HOUR_US = 3600 * 1_000_000


def half_up_percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5)).otherwise(0).cast("int")


def activity_trend_12(alerts: DataFrame, incidents: DataFrame, correlations: DataFrame) -> DataFrame:
    """Alerts, incidents and correlations in 12 equal spans of the whole period.

    Inputs have a ``timestamp`` column. A time on a border counts to the earlier span.
    """
    marks = (
        alerts.select("timestamp", F.lit("alerts").alias("kind"))
        .unionByName(incidents.select("timestamp", F.lit("incidents").alias("kind")))
        .unionByName(correlations.select("timestamp", F.lit("correlations").alias("kind")))
        .where("timestamp is not null").withColumn("t", F.unix_micros("timestamp"))
    )
    period = marks.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select(
        "lo", (F.greatest(F.col("hi") - F.col("lo"), F.lit(HOUR_US)) / BUCKETS).alias("width")
    )
    one = F.lit(1).alias("k")
    placed = marks.withColumn("k", one).join(F.broadcast(period.withColumn("k", one)), "k").withColumn(
        "bucket",
        F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.ceil((F.col("t") - F.col("lo")) / F.col("width")) - 1)).cast("int"),
    )
    counted = placed.groupBy("bucket").pivot("kind", ["alerts", "incidents", "correlations"]).agg(F.count(F.lit(1)))
    frame = period.select("lo", "width", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
    start = F.timestamp_micros(F.floor(F.col("lo") + F.col("bucket") * F.col("width")).cast("bigint"))
    return frame.join(counted, "bucket", "left").select(
        "bucket", F.concat(F.lpad(F.hour(start).cast("string"), 2, "0"), F.lit(":00")).alias("time"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("alerts", "incidents", "correlations")],
    )


def top_mitre(incidents: DataFrame, alerts: DataFrame, limit: int = 6) -> DataFrame:
    """Most frequent techniques with their share of the most frequent one."""
    counts = (
        incidents.select(F.explode("mitre_techniques").alias("technique"))
        .unionByName(alerts.select(F.explode("mitre_techniques").alias("technique")))
        .groupBy("technique").agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "technique").limit(limit)
    )
    return counts.withColumn("percent", half_up_percent(F.col("n"), F.max("n").over(Window.partitionBy())))


def severity_band(severity: Column) -> Column:
    return F.when(severity >= 12, "critical").when(severity >= 8, "high").when(severity >= 4, "medium").otherwise("low")


def severity_distribution(df: DataFrame) -> DataFrame:
    """Rows per band, empty bands included."""
    return _zero_filled(df.groupBy(severity_band(F.col("severity")).alias("level")).agg(F.count("*").alias("n")))


def _zero_filled(counts: DataFrame) -> DataFrame:
    levels = counts.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")])).alias("level")
    )
    return levels.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def severity_risk(severity: Column) -> Column:
    return F.least(F.lit(100), F.floor(severity / 15 * 100 + 0.5)).cast("int")


def risk_curve(risks: DataFrame, incidents: DataFrame, limit: int = 10) -> DataFrame:
    """The newest scores with peak and current; without any, severities stand in."""
    scored = risks.select(F.lit(0).alias("source"), F.col("scored_at").alias("at"), F.col("assessment_id").alias("id"), F.col("risk_score").alias("risk"))
    standing = incidents.select(F.lit(1).alias("source"), F.col("first_seen").alias("at"), F.col("incident_id").alias("id"), severity_risk(F.col("severity")).alias("risk"))
    # scores sort before stand-ins, so stand-ins only show when there are no scores
    both = scored.unionByName(standing)
    shown = both.orderBy("source", F.col("at").desc(), "id").limit(limit)
    everything = Window.partitionBy()
    order = Window.orderBy("source", F.col("at").desc(), "id")
    peak = both.groupBy("source").agg(F.max("risk").alias("peak_risk"))
    return (
        shown.withColumn("use", F.min("source").over(everything)).where("source = use")
        .withColumn("position", F.row_number().over(order))
        .join(peak, "source")
        .withColumn("current_risk", F.max_by("risk", "position").over(everything))
        .select("position", "id", "risk", F.lit(75).alias("threshold"), "peak_risk", "current_risk")
    )


def risk_level_distribution(risks: DataFrame) -> DataFrame:
    """G05."""
    return _zero_filled(risks.groupBy(F.lower("risk_level").alias("level")).agg(F.count("*").alias("n")))


def operation_counts(activities: DataFrame) -> DataFrame:
    """G06."""
    return activities.groupBy("operation").agg(F.count("*").alias("n"))


def sensitive_share(catalog: DataFrame) -> DataFrame:
    """G07."""
    found = F.size("sensitive_columns")
    return catalog.select(
        "dataset_id", found.alias("sensitive"), (F.col("column_count") - found).alias("other"),
        half_up_percent(found, F.col("column_count")).alias("sensitive_percent"),
        half_up_percent(F.col("column_count") - found, F.col("column_count")).alias("other_percent"),
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings per dataset in three groups."""
    s = F.col("severity")
    return findings.groupBy("dataset_id").agg(
        F.count_if(s.isin("CRITICAL", "HIGH")).alias("high"), F.count_if(s == "MEDIUM").alias("medium"),
        F.count_if(s.isin("LOW", "INFO")).alias("low"),
    )


def activity_volume_tail(activities: DataFrame, limit: int = 15) -> DataFrame:
    """The last activities, oldest first, with their volume (0 counts as 1)."""
    last = activities.orderBy(F.col("timestamp").desc(), F.col("activity_id").desc()).limit(limit)
    records = F.col("records_accessed")
    return last.select(
        "activity_id", "timestamp", F.when(F.coalesce(records, F.lit(0)) == 0, 1).otherwise(records).alias("volume")
    ).orderBy("timestamp", "activity_id")


def investigation_queue(cases: DataFrame, limit: int = 4) -> DataFrame:
    """Newest cases with their severity in percent."""
    return cases.orderBy(F.col("updated_at").desc(), "case_id").limit(limit).select(
        "case_id", "title", F.coalesce("assignee", F.lit("Unassigned")).alias("assignee"), "status",
        severity_risk(F.col("severity")).alias("severity_percent"), F.get("incident_ids", 0).alias("incident_id"),
    )


# G11-G15 take any (key, ts, value) table.


def load_duration(df: DataFrame, period: Column) -> DataFrame:
    """Totals per period, highest first, flagged from 80 % of the peak."""
    totals = df.groupBy(period.alias("period")).agg(F.sum("value").alias("load"))
    everything = Window.partitionBy()
    flagged = totals.withColumn("is_peak", F.col("load") >= F.max("load").over(everything) * 0.8)
    return flagged.select(
        "period", F.row_number().over(Window.orderBy(F.col("load").desc(), "period")).alias("position"), "load", "is_peak",
        F.count_if("is_peak").over(everything).alias("peak_periods"),
    )


def peak_hour_stats(df: DataFrame) -> DataFrame:
    """Hour with the highest total, average and lowest hourly total."""
    hours = df.groupBy(F.hour("ts").alias("hour")).agg(F.sum("value").alias("load"))
    return hours.agg(
        F.max_by("hour", F.struct(F.col("load"), -F.col("hour"))).alias("peak_hour"), F.max("load").alias("peak"),
        F.avg("load").alias("average"), F.min("load").alias("lowest"),
    )


def hour_weekday_heatmap(df: DataFrame) -> DataFrame:
    """7 x 24 cells with intensity, and the weekday, weekend and 9-17 h averages.

    Days count from Monday = 0. Cells without rows have value 0.
    """
    cells = df.groupBy(F.weekday("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.sum("value").alias("value"))
    grid = df.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    full = grid.join(cells, ["day", "hour"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    w = Window.partitionBy()
    low, high = F.min("value").over(w), F.max("value").over(w)
    day, hour = F.col("day"), F.col("hour")
    return full.select(
        "day", "hour", "value",
        F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(0.0).alias("intensity"),
        (F.sum(F.when(day < 5, F.col("value"))).over(w) / (5 * 24)).alias("weekday_avg"),
        (F.sum(F.when(day >= 5, F.col("value"))).over(w) / (2 * 24)).alias("weekend_avg"),
        F.avg(F.when(hour.between(9, 17), F.col("value"))).over(w).alias("working_hours_avg"),
    )


def share_of_total(df: DataFrame) -> DataFrame:
    """Value and share per key."""
    totals = df.groupBy("key").agg(F.sum("value").alias("value"))
    return totals.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy()))


def peak_summary(df: DataFrame) -> DataFrame:
    """Average, highest value and number of high-severity rows (``severity`` text)."""
    return df.agg(
        F.avg("value").alias("avg_peak"), F.max("value").alias("max_peak"),
        F.count_if(F.col("severity") == "high").alias("high_severity"),
    )


def series_summary(df: DataFrame) -> DataFrame:
    """Sum, average and maximum."""
    return df.agg(F.sum("value").alias("total"), F.avg("value").alias("average"), F.max("value").alias("maximum"))
