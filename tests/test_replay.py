"""Logs replayed as a parallel prefix against one request at a time."""

import random

import pytest
from pyspark.sql import functions as F

from vigilspark.operators.lifecycle import CASE_MACHINE, RESPONSE_MACHINE, current_state, replay_log, resolutions, validate_case_transitions
from vigilspark.operators.replay import replay

SCHEMA = "entity_id string, ts timestamp, seq bigint, requested_status string, summary string, actor string"
ALLOWED = {
    "open": {"in_progress"}, "in_progress": {"pending", "resolved", "open"}, "pending": {"in_progress", "resolved"},
    "resolved": {"in_progress", "closed"}, "closed": {"in_progress"},
}


def one_by_one(rows):
    """(entity, seq) -> (old, new, verdict) by the rules of cases."""
    out, state, stored = {}, {}, set()
    for e, ts, seq, asked, summary, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        old = state.get(e, "open")
        asked = (asked or "").strip().lower()
        if asked == "resolve":
            fine = old in ("in_progress", "pending") and bool((summary or "").strip())
            new, verdict = ("resolved", "accepted") if fine else (old, "rejected")
            stored |= {e} if fine else set()
        elif asked == old:
            new, verdict = old, "unchanged"
        else:
            fine = asked in ALLOWED[old] and (asked != "closed" or e in stored)
            new, verdict = (asked, "accepted") if fine else (old, "rejected")
        state[e] = new
        out[e, seq] = (old, new, verdict)
    return out, state


def log(n, entities, seed):
    draw = random.Random(seed)
    asked = ["in_progress", "pending", "resolve", " Resolve ", "closed", "resolved", "OPEN", "unknown", None, "in_progress"]
    names = [f"case-{k}" for k in range(entities)]
    return [
        (draw.choice(names if draw.random() < 0.6 else names[:1]), 1_700_000_000 + draw.randint(0, n // 4), k, draw.choice(asked), draw.choice(["done", " ", None]), f"a{k}")
        for k in range(n)
    ]


def frame(spark, rows):
    df = spark.createDataFrame([(r[0], r[1], *r[2:]) for r in rows], "entity_id string, ts long, seq bigint, requested_status string, summary string, actor string")
    return df.withColumn("ts", F.col("ts").cast("timestamp")).repartition(5)


def test_cases_equal_one_by_one(spark):
    rows = log(4000, 30, 1)
    decided, final = replay_log(frame(spark, rows), CASE_MACHINE)
    wanted, state = one_by_one(rows)
    assert {(r["entity_id"], r["seq"]): (r["old_status"], r["new_status"], r["verdict"]) for r in decided.collect()} == wanted
    assert {r["entity_id"]: r["status"] for r in final.collect()} == state


@pytest.mark.parametrize("chunk_bits", [1, 3, 9])
def test_any_chunk_gives_the_same(spark, chunk_bits):
    """States count modulo 7 or jump; the hot entity crosses every chunk and partition."""
    draw = random.Random(chunk_bits)
    rows = [("hot" if k % 5 else f"e{k % 11}" if k % 10 else None, k, draw.choice([0, 1, 2, -1])) for k in range(1500)]
    table = [x for s in range(7) for x in ((s + 1) % 7, s * s % 7, 3)]
    done = replay(spark.createDataFrame(rows, "who string, at bigint, code int").repartition(4), "who", ["at"], "code", table, 3, 2, chunk_bits)
    state, wanted = {}, []
    for who, at, code in rows:
        old = state.get(who, 2)
        state[who] = table[old * 3 + code] if code >= 0 else old
        wanted.append((at, old, state[who]))
    assert sorted((r["at"], r["_old"], r["_new"]) for r in done.rows.collect()) == wanted
    assert {r["who"]: r["state"] for r in done.final.collect()} == state


def test_one_long_case_spreads(spark):
    """A case with all requests on one day is range partitioned by order, no chunk is longer than its bits allow, no Python runs."""
    n = 60_000
    asked = F.element_at(F.array(*map(F.lit, ["in_progress", "pending", "resolve", "closed"])), (F.col("id") % 4 + 1).cast("int"))
    rows = spark.range(n).select(
        F.lit("case-1").alias("entity_id"), (F.col("id") + 1_700_000_000).cast("timestamp").alias("ts"), F.col("id").alias("seq"),
        asked.alias("requested_status"), F.lit("done").alias("summary"), F.lit("a").alias("actor"),
    )
    decided, final = replay_log(rows, CASE_MACHINE)
    assert decided.count() == n and decided.where("verdict = 'accepted'").count() == n
    assert [r["status"] for r in final.collect()] == ["closed"]
    plan = decided._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan


def test_resolutions_and_odd_rows(spark):
    rows = [("a", 1, 1, "in_progress", None, "x"), ("a", 2, 2, " RESOLVE", "first", "x"), ("a", 3, 3, "in_progress", None, "x"), ("a", 4, 4, "resolve", "second", "y"), ("b", 1, 5, "resolve", "too early", "z")]
    changes = frame(spark, rows)
    found = resolutions(changes, validate_case_transitions(changes)).collect()
    assert [(r["entity_id"], r["resolution"]["summary"], r["resolution"]["resolved_by"]) for r in found] == [("a", "second", "y")]
    assert {r["entity_id"]: r["status"] for r in current_state(changes).collect()} == {"a": "resolved", "b": "open"}
    empty = changes.limit(0)
    assert replay_log(empty, CASE_MACHINE)[0].count() == 0 and replay_log(empty, RESPONSE_MACHINE)[1].count() == 0
    odd = frame(spark, [(None, 1, 1, "in_progress", None, "x"), (None, 1, 1, "in_progress", None, "x"), (None, 2, 2, None, None, None)])
    decided, final = replay_log(odd, CASE_MACHINE)
    assert sorted(r["verdict"] for r in decided.collect()) == ["accepted", "rejected", "unchanged"]
    assert [(r["entity_id"], r["status"]) for r in final.collect()] == [(None, "in_progress")]
