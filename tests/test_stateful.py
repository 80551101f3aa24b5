"""Correlation with keyed state against the batch."""

import random

import pytest

from tests.conftest import rows
from tests.test_correlation import alert, frame, random_stream
from tests.test_streaming import SHOWN, wide
from vigilspark.operators import correlate as C
from vigilspark.streaming import stateful as S

EVERY = [*SHOWN, "rule_id", "founding_event_id", "evidence"]


def streamed(spark, tmp_path, batches, lateness):
    """Files in order, one a micro-batch; the last ones only move the watermark past everything."""
    end = max(a["ts"] for b in batches for a in b) + 100_000
    beats = [[alert(f"beat{k}", "builtin-003", end + k, alert_id=f"beat{k}")] for k in range(2)]
    for i, batch in enumerate([*batches, *beats]):
        wide(spark, batch).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i:03d}"))
    schema = wide(spark, batches[0]).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = S.stream_correlations(stream, str(tmp_path / "log"), str(tmp_path / "check"), lateness=lateness).trigger(availableNow=True).start()
    query.awaitTermination()
    return S.read_log(spark, str(tmp_path / "log")), query


def evidence_as_rows(df):
    from pyspark.sql import functions as F

    return df.withColumn("evidence", F.array_sort(F.map_entries("evidence")))


@pytest.mark.parametrize("lateness, spread", [(0, 0), (1800, 1800)])
def test_stream_gives_the_batch_result(spark, tmp_path, lateness, spread):
    alerts = [a for f in ("builtin", "dataset") for s in range(4) for a in random_stream(f"{f}st{s}", f)]
    rng = random.Random(3)
    arrived = sorted(alerts, key=lambda a: (a["ts"] + (rng.randint(0, spread) if spread else 0), a["ts"], a["alert_id"]))
    cuts = [0]
    for k in range(1, 5):
        at = len(arrived) * k // 5
        while not spread and arrived[at]["ts"] == arrived[at - 1]["ts"]:
            at += 1  # in time order, alerts of one moment come together
        cuts.append(at)
    batches = [arrived[a:b] for a, b in zip(cuts, [*cuts[1:], len(arrived)])]
    batches.append(batches[-1][-3:])  # sent again
    log, query = streamed(spark, tmp_path, batches, lateness)
    whole = C.correlate(frame(spark, alerts))
    assert rows(evidence_as_rows(S.current_correlations(log)), *EVERY) == rows(evidence_as_rows(whole.correlations), *EVERY)
    assert rows(S.current_members(log), "correlation_id", "alert_id", "event_id", "dataset_id") == rows(whole.members, "correlation_id", "alert_id", "event_id", "dataset_id")


def test_state_is_bounded(spark, tmp_path):
    """One hot user over many windows: the state never holds more than a window of it, and nothing at the end."""
    batches = [[alert(f"e{b}x{k}", "builtin-003", b * 600 + k * 20, user="u", host="h", alert_id=f"a{b}x{k}") for k in range(30)] for b in range(12)]
    log, query = streamed(spark, tmp_path, batches, 0)
    counts = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert counts and max(counts[6:-3]) <= 2.5 * max(counts[2:5]) and counts[-1] <= 4
    whole = C.correlate(frame(spark, [a for b in batches for a in b]))
    assert rows(S.current_correlations(log), *SHOWN) == rows(whole.correlations, *SHOWN)
