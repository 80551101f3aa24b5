import random

from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_correlation import alert, frame, random_stream
from vigilspark.operators import correlate as C
from vigilspark.streaming import streams as X

SHOWN = ["correlation_id", "correlation_type", "entity_key", "title", "description", "severity", "first_seen",
         "last_seen", "alert_count", "event_count", "trigger_count", "mitre_techniques", "founding_alert_id"]


def wide(spark, alerts):
    return frame(spark, alerts).withColumns({
        "rule_name": F.lit("r"), "description": F.lit("d"), "source": F.lit("s"), "status": F.lit("new"),
        "destination_ip": F.lit(None).cast("string"), "mitre_techniques": F.array().cast("array<string>"),
    })


def test_micro_batches_give_the_batch_result(spark, tmp_path):
    alerts = [a for f in ("builtin", "dataset") for s in range(6) for a in random_stream(f"{f}x{s}", f)]
    times = sorted({a["ts"] for a in alerts})
    borders = [times[len(times) * i // 3] for i in range(1, 3)] + [times[-1] + 1]
    source, left = tmp_path / "in", alerts
    for i, border in enumerate(borders):
        chunk, left = [a for a in left if a["ts"] < border], [a for a in left if a["ts"] >= border]
        wide(spark, chunk).coalesce(1).write.parquet(str(source / f"c{i}"))
    stream = (
        spark.readStream.schema(wide(spark, alerts[:1]).schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(source))
    )
    sink = X.CorrelationSink(str(tmp_path / "state"))
    X.stream_correlate(stream, sink, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sink.alerts.read(spark, stream.schema).select("batch").distinct().count() == 3
    whole = C.correlate(frame(spark, alerts))
    assert rows(sink.current(spark), *SHOWN) == rows(whole.correlations, *SHOWN)
    assert rows(sink.current_members(spark), "correlation_id", "alert_id") == rows(whole.members, "correlation_id", "alert_id")
    assert sink.late.read(spark, stream.schema).count() == 0


def test_late_alerts_count_within_the_lateness(spark, tmp_path):
    """Arrivals out of order by up to the lateness give the batch result; older ones are kept and replayed."""
    lateness = 1800
    alerts = [a for f in ("builtin", "dataset") for s in range(4) for a in random_stream(f"{f}late{s}", f)]
    rng = random.Random(8)
    arrived = sorted(alerts, key=lambda a: (a["ts"] + rng.randint(0, lateness), a["alert_id"]))
    sink = X.CorrelationSink(str(tmp_path / "state"), lateness=lateness)
    third = len(arrived) // 3 + 1
    for i in range(3):
        sink(wide(spark, arrived[i * third : (i + 1) * third]), i)
    whole = C.correlate(frame(spark, alerts))
    assert rows(sink.current(spark), *SHOWN) == rows(whole.correlations, *SHOWN)
    assert rows(sink.current_members(spark), "correlation_id", "alert_id") == rows(whole.members, "correlation_id", "alert_id")
    assert sink.late.read(spark, wide(spark, alerts[:1]).schema).count() == 0
    behind = alert("old", "builtin-003", -50_000, user="u", alert_id="a-old")
    sink(wide(spark, [behind]), 3)
    assert rows(sink.late.read(spark, wide(spark, [behind]).schema), "alert_id") == [("a-old",)]
    replayed = C.correlate(frame(spark, [*alerts, behind]))
    assert rows(sink.replayed(spark).correlations, *SHOWN) == rows(replayed.correlations, *SHOWN)


def events_stream(spark, tmp_path, repeat):
    from vigilspark.sources.bridge import security_events

    df = security_events(spark, "/root/testdata/sf0.001").where("event_id < 'evt-3'")
    for i in range(repeat):
        df.coalesce(1).write.parquet(str(tmp_path / f"e{i}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    return df, stream


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_events_sent_twice_count_once_and_detection_equals_batch(spark, tmp_path):
    from vigilspark.operators.alerts import correlatable_alerts

    df, stream = events_stream(spark, tmp_path, 2)
    out = run(X.stream_detect(X.stream_dedup(stream, "60 days")), "detected")
    assert rows(out, "alert_id", "rule_id", "host") == rows(correlatable_alerts(df), "alert_id", "rule_id", "host")


def test_window_counts_cover_all_alerts(spark, tmp_path):
    from vigilspark.operators.alerts import correlatable_alerts

    df, stream = events_stream(spark, tmp_path, 1)
    total = correlatable_alerts(df).count()
    counted = run(X.stream_windows(X.stream_detect(stream), 900), "windows", "complete")
    assert counted.agg(F.sum("n")).first()[0] == total
    sessions = X.stream_sessions(correlatable_alerts(df), 900)
    assert sessions.agg(F.sum("n")).first()[0] == total


def test_stream_upsert_replaces_mutable_columns_only(spark, tmp_path):
    from vigilspark.sources.buckets import BucketTable

    schema = "id string, a string, b string"
    for i, data in enumerate([[("1", "x", "x")], [("1", "y", "y"), ("2", "z", "z")]]):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    X.stream_upsert(stream, str(tmp_path / "t"), "id", ["b"], str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rows(BucketTable(spark, str(tmp_path / "t"), "id", stream.schema).read(), "id", "a", "b") == [("1", "x", "y"), ("2", "z", "z")]
