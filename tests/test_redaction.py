import json

import pytest
from pyspark.sql import functions as F

from vigilspark import fixed_values as fv
from vigilspark.functions import redact, redact_json, redact_map
from vigilspark.functions.redaction import _KINDS
from vigilspark.operators.normalize import WAZUH_SCHEMA, wazuh_to_events

TEXTS = [
    "password: hunter2, and token=abc", "SECRETTOKEN authorization bearer x", "api_key = 'k' api-key", "nothing here",
    "  cookie;session ", "secrettoken", "tokensecret", "", "authauthorization", "x" * 9000 + " password=tail",
]


@pytest.mark.parametrize("kind", sorted(_KINDS))
def test_one_pass_equals_keyword_by_keyword(spark, kind):
    words, pairs, trimmed = _KINDS[kind]
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    slow = F.trim("t") if trimmed else F.col("t")
    if pairs:
        slow = F.regexp_replace(slow, "(?iU)" + fv.PAIR_PATTERN, fv.REDACTED)
    for word in words:
        slow = F.regexp_replace(slow, "(?iu)" + word, fv.REDACTED)
    for row in df.select(redact(F.col("t"), kind).alias("fast"), slow.alias("slow")).collect():
        assert row["fast"] == row["slow"]


NESTED = [
    {"a": {"b": {"c": {"d": {"e": {"password": "hunter2"}}}}}},
    {"items": [{"password": "hunter2"}, [[{"x": {"api_token": ["hunter2", {"y": "hunter2"}]}}]]]},
    {"l": [{"secret": {"v": "hunter2", "w": [1, {"z": "hunter2"}]}}], "kept": "value"},
    {"l": [{"secret": {"1": {"2": {"3": {"4": {"5": {"6": "hunter2"}}}}}}}]},
    {"q": [{"my \"password\" is": "a \\ \" hunter2"}, {"n": None, "token": 12345}]},
]


def test_secrets_at_any_depth_and_in_lists(spark):
    df = spark.createDataFrame([(json.dumps(x),) for x in NESTED], "t string")
    for row in df.select(redact_json(F.col("t")).alias("r"), redact_map(F.create_map(F.lit("context"), F.col("t")))["context"].alias("m")).collect():
        assert "hunter2" not in row["r"] and "12345" not in row["r"] and row["r"] == row["m"]
    kept = df.where("t like '%kept%'").select(redact_json(F.col("t"))).first()[0]
    assert json.loads(kept)["kept"] == "value"


def test_agent_payloads(spark):
    data = [*map(json.dumps, NESTED), '{"a.b":"x","a":{"b":"y"}}', "[]", "not json", None]
    lines = [(json.dumps({"id": f"w{i}", "timestamp": "2026-01-01T00:00:00Z", "rule": {"id": "1", "level": 3}}), d) for i, d in enumerate(data)]
    raw = spark.createDataFrame(lines, "j string, d string").select(F.from_json("j", WAZUH_SCHEMA).alias("a"), "d").select("a.*", "d")
    events = {r["event_id"]: r["metadata"] for r in wazuh_to_events(raw.withColumn("data", F.col("d"))).collect()}
    assert len(events) == len(data)
    assert not any("hunter2" in (v or "") for m in events.values() for v in m.values())
    assert [m["wazuh_data.a.b"] for m in events.values() if "wazuh_data.a.b" in m] == ["y"]
