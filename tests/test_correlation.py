import random
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tests.conftest import rows
from tests.replay import replay
from vigilspark.operators import correlate as C
from vigilspark.operators.detect import BUILTIN_RULES, DetectionRule

ORDER = {r.rule_id: i for i, r in enumerate(BUILTIN_RULES)}
FIXED = {r.rule_id: r.severity for r in BUILTIN_RULES}
MITRE = {r.rule_id: list(r.mitre) for r in BUILTIN_RULES}
START = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = (
    "alert_id string, event_id string, timestamp timestamp, rule_id string, rule_order int, severity int, "
    "host string, user string, source_ip string, evidence map<string,string>"
)


def alert(event, rule, ts, host=None, user=None, ip=None, dataset=None, severity=None, alert_id=None):
    return {
        "alert_id": alert_id or f"al-{random.Random(event + rule).getrandbits(40):x}", "event_id": event, "ts": ts,
        "rule_id": rule, "rule_order": ORDER[rule], "severity": severity or FIXED[rule] or 10, "host": host,
        "user": user, "source_ip": ip, "dataset_id": dataset,
    }


def frame(spark, alerts):
    return spark.createDataFrame(
        [
            (a["alert_id"], a["event_id"], START + timedelta(seconds=a["ts"]), a["rule_id"], a["rule_order"],
             a["severity"], a["host"], a["user"], a["source_ip"],
             {"dataset_id": a["dataset_id"], "dataset_name": a["dataset_id"]})
            for a in alerts
        ],
        SCHEMA,
    )


def random_stream(seed, family):
    rng = random.Random(seed)
    rules = [r for r in ORDER if r.startswith(family)]
    out, t = [], 0
    for i in range(rng.randint(5, 45)):
        t += rng.choice([0, 0, 60, 300, 600, 900, 901, 1800, 2500, 4000])
        host = rng.choice([None, "", f"h{seed}-1", f"h{seed}-2"])
        user = rng.choice([None, "", f"u{seed}-1", f"u{seed}-2"])
        ip = rng.choice([None, f"ip{seed}"])
        data = rng.choice([None, f"d{seed}"])
        for rule in rng.sample(rules, rng.choice([1, 1, 1, 2, 3])):
            level = rng.randint(10, 15) if rule == "builtin-001" else None
            out.append(alert(f"e{seed}-{rng.randint(0, 9)}-{i}", rule, t, host, user, ip, data, level))
    return out


def test_equals_replay_on_random_streams(spark):
    streams = [random_stream(f"{f}{s}", f) for f in ("builtin", "dataset", "") for s in range(50)]
    expected, outcomes = [], set()
    for s in streams:
        done, touched = replay(s)
        expected += done
        outcomes |= touched
    got = C.correlate(frame(spark, [a for s in streams for a in s]))
    table = {r["correlation_id"]: r for r in got.correlations.collect()}
    members = {}
    for r in got.members.select("correlation_id", "alert_id").collect():
        members.setdefault(r[0], set()).add(r[1])
    assert len(table) == len(expected) > 400
    found = {(r["correlation_type"], r["entity_key"], r["founding_alert_id"]): r for r in table.values()}
    for c in expected:
        r = found[(c["type"], c["entity"], c["founder"])]
        ids = members[r["correlation_id"]]
        assert ids == c["ids"]
        assert r["alert_count"] == len(ids)
        assert r["severity"] == c["severity"]
        assert r["first_seen"] == (START + timedelta(seconds=c["first"])).replace(tzinfo=None)
        assert r["last_seen"] == (START + timedelta(seconds=c["last"])).replace(tzinfo=None)
        if c["type"] in ("auth_attack_sequence", "same_entity"):
            assert f"({c['n']})" in r["description"]
        if c["type"] == "data_exfiltration_sequence":
            assert f" {c['n'] - 1} access" in r["description"]
        if c["type"] in ("same_entity", "privilege_escalation_sequence"):
            techniques = {m for rule in c["first_rules"] for m in MITRE[rule]}
            if c["type"] != "same_entity":
                techniques.add("T1548")
            assert r["mitre_techniques"] == sorted(techniques)
            key = "distinct_rules" if c["type"] == "same_entity" else "rules_correlated"
            assert r["evidence"][key] == "[" + ",".join(f'"{x}"' for x in c["rules"]) + "]"
    by_id = {r["correlation_id"]: (r["correlation_type"], r["entity_key"], r["founding_alert_id"]) for r in table.values()}
    assert {(e, *by_id[c], o) for e, c, o in rows(got.outcomes)} == outcomes


def one(spark, alerts, kind):
    got = C.correlate(frame(spark, alerts))
    return got.correlations.where(F.col("correlation_type") == kind).collect()


def test_auth_pairs_inside_and_outside_the_window(spark):
    near = [alert("a", "builtin-003", 0, user="u", alert_id="a1"), alert("b", "builtin-003", 300, user="u", alert_id="a2")]
    (hit,) = one(spark, near, "auth_attack_sequence")
    assert (hit["entity_key"], hit["severity"], hit["alert_count"]) == ("user:u", 8, 2)
    assert hit["title"] == "Authentication Attack Sequence against user:u"
    far = [alert("a", "builtin-003", 0, user="u"), alert("b", "builtin-003", 1200, user="u")]
    assert one(spark, far, "auth_attack_sequence") == []
    other = [alert("a", "builtin-003", 0, user="u"), alert("b", "builtin-003", 300, user="v")]
    assert one(spark, other, "auth_attack_sequence") == []


def test_process_then_network_needs_one_host(spark):
    pair = [alert("a", "builtin-002", 0, host="h"), alert("b", "builtin-004", 600, host="h")]
    (hit,) = one(spark, pair, "process_network_sequence")
    assert hit["severity"] == 12 and hit["mitre_techniques"] == ["T1059", "T1071"]
    split = [alert("a", "builtin-002", 0, host="h"), alert("b", "builtin-004", 600, host="g")]
    assert one(spark, split, "process_network_sequence") == []


def test_third_failure_updates_the_same_correlation(spark):
    two = [alert(e, "builtin-003", t, user="u", alert_id=f"a{e}") for e, t in (("1", 0), ("2", 60))]
    three = two + [alert("3", "builtin-003", 120, user="u", alert_id="a3")]
    (before,) = one(spark, two, "auth_attack_sequence")
    got = C.correlate(frame(spark, three))
    (after,) = got.correlations.where("correlation_type = 'auth_attack_sequence'").collect()
    assert before["correlation_id"] == after["correlation_id"]
    assert (before["alert_count"], after["alert_count"]) == (2, 3)
    assert rows(got.outcomes, "event_id", "outcome") == [("2", "created"), ("3", "updated")]


def test_without_compat_techniques_are_the_union_of_members(spark):
    alerts = [alert("1", "builtin-001", 0, host="h"), alert("2", "builtin-003", 60, host="h"),
              alert("3", "builtin-004", 120, host="h")]
    kept = C.correlate(frame(spark, alerts)).correlations.where("correlation_type = 'same_entity'").collect()
    merged = C.correlate(frame(spark, alerts), compat=False).correlations.where("correlation_type = 'same_entity'").collect()
    assert kept[0]["mitre_techniques"] == ["T1110"]
    assert merged[0]["mitre_techniques"] == ["T1071", "T1110"]


def other_severities(seed, stream):
    rng = random.Random(f"severity {seed}")
    return [{**a, "severity": rng.randint(0, 15)} for a in stream]


def test_partners_are_told_by_rule_alone(spark):
    """Stored alerts of a re-tuned rule have severities that the rule no longer has."""
    streams = [other_severities(s, random_stream(f"x{s}", "")) for s in range(15)]
    expected = [c for s in streams for c in replay(s)[0]]
    found = C.correlate(frame(spark, [a for s in streams for a in s])).correlations.collect()
    got = {(r["correlation_type"], r["entity_key"], r["founding_alert_id"]): (r["alert_count"], r["severity"]) for r in found}
    assert got == {(c["type"], c["entity"], c["founder"]): (len(c["ids"]), c["severity"]) for c in expected}


def test_more_kinds_than_are_counted_side_by_side(spark):
    streams = [other_severities(s, random_stream(f"y{s}", "")) for s in range(8)]
    alerts = frame(spark, [a for s in streams for a in s])
    parts = C.participations(alerts, C.all_rules())
    columns = ["correlation_type", "alert_id", "partners", "matched"]
    assert rows(C.score_participations(parts, columns=3), *columns) == rows(C.score_participations(parts), *columns)


def test_eighty_detection_rules(spark):
    detection = [DetectionRule(f"own-{i:02d}", f"Rule {i}", "", 5, lambda: F.lit(True)) for i in range(80)]
    ids = [r.rule_id for r in detection]
    rule = C.CorrelationRule(
        "corr-own", "own_sequence", 600, lambda: F.col("host"), {i: tuple(x for x in ids if x != i) for i in ids},
        "Own {entity}", "{n} alerts", None,
    )
    alerts = [
        {"alert_id": f"a{i:02d}", "event_id": f"e{i:02d}", "ts": i, "rule_id": r, "rule_order": i, "severity": i % 16,
         "host": "h", "user": None, "source_ip": None, "dataset_id": None} for i, r in enumerate(ids)
    ]
    found = C.correlate(frame(spark, alerts), [rule], detection).correlations.collect()
    assert [(r["alert_count"], r["trigger_count"], r["severity"]) for r in found] == [(80, 79, 15)]


def test_an_alert_is_shuffled_once_with_its_columns(spark):
    alerts = frame(spark, [alert(f"e{i}", "builtin-003", 60 * i, host="h", user="u") for i in range(8)])
    plan = C.score_participations(C.participations(alerts, C.all_rules()))._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert keys and not any("alert_id" in k for k in keys)


def test_what_follows_from_the_time_is_not_shuffled(spark):
    alerts = frame(spark, [alert(f"e{i}", "builtin-003", 60 * i, host="h", user="u") for i in range(8)])
    parts = C.participations(alerts, C.all_rules())
    scored = C.score_participations(parts)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        plan = C.score_participations(parts)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "alert_id, alert_id#" in plan and "timestamp, timestamp#" not in plan and "bin, bin#" not in plan
    same = ["correlation_type", "alert_id", "timestamp", "ts_us", "bin"]
    assert scored.columns[: len(parts.columns)] == parts.columns and rows(scored, *same) == rows(parts, *same)


def test_members_and_totals_are_found_by_bin(spark, monkeypatch):
    told = [("builtin-003", 60 * i) for i in range(12)] + [("builtin-005", 400), ("builtin-002", 1900)]
    alerts = frame(spark, [alert(f"e{i:02d}", rule, ts, host="h", user="u") for i, (rule, ts) in enumerate(told)])
    staged, stage = {}, C.stage
    monkeypatch.setattr(C, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    C.correlate(alerts)
    key = ["correlation_type", "entity_key", "bin"]
    triggers = staged["scored"].where("is_trigger").select(*key).distinct()
    assert rows(staged["reach"], *key) == rows(triggers, *key)
    totals = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", C.score_participations(staged["participations"])._jdf.queryExecution().executedPlan().toString())
    assert any("bin" in t for t in totals) and not any("slot" in t for t in totals)


def test_arrival_numbers_follow_time_then_event(spark):
    told = [("b", "builtin-003", 60), ("b", "builtin-005", 60), ("a", "builtin-003", 60), ("c", "builtin-003", 4000), ("d", "builtin-003", 0)]
    alerts = frame(spark, [alert(e, rule, ts, host="h") for e, rule, ts in told])
    scored = C.score_participations(C.participations(alerts, C.all_rules())).where("correlation_type = 'same_entity'")
    assert rows(scored, "event_id", "rule_id", "seq") == [
        ("a", "builtin-003", 2), ("b", "builtin-003", 4), ("b", "builtin-005", 4), ("c", "builtin-003", 5), ("d", "builtin-003", 1),
    ]


def lambdas(plan):
    """The bodies of the lambda functions in a plan's text."""
    for at in re.finditer(r"lambdafunction\(", plan):
        depth = 1
        for i in range(at.end(), len(plan)):
            depth += {"(": 1, ")": -1}.get(plan[i], 0)
            if depth == 0:
                yield plan[at.end():i]
                break


def test_counts_are_not_formed_anew_for_every_kind(spark):
    alerts = frame(spark, [alert(f"e{i}", rule, 60 * i, host="h") for i, rule in enumerate(sorted(ORDER))])
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        scored = C.score_participations(C.participations(alerts, C.all_rules()))
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "oc0#" in plan and plan.count("filter(copies#") == 1
    assert not [body for body in lambdas(plan) if "oc0#" in body]


def test_every_alert_has_one_episode_in_its_bin_or_the_next(spark):
    told = [("a", "builtin-004", 0), ("b", "builtin-002", 1700), ("c", "builtin-004", 1900), ("d", "builtin-004", 9000), ("e", "builtin-002", 9100),
            ("f", "builtin-004", 9200), ("g", "builtin-004", 20000)]
    found = C.correlate(frame(spark, [alert(e, rule, ts, host="h") for e, rule, ts in told]))
    members = found.members.where("correlation_type = 'process_network_sequence'")
    assert rows(members, "event_id") == [("a",), ("b",), ("c",), ("d",), ("e",), ("f",)]
    assert sorted(r[0] for r in members.groupBy("correlation_id").count().select("count").collect()) == [3, 3]


def test_an_alert_without_rule_order_can_be_a_member(spark):
    told = [("a", "builtin-004", 0), ("b", "builtin-002", 600)]
    alerts = frame(spark, [alert(e, rule, ts, host="h") for e, rule, ts in told])
    alerts = alerts.withColumn("rule_order", F.when(F.col("event_id") != "a", F.col("rule_order")))
    members = C.correlate(alerts).members.where("correlation_type = 'process_network_sequence'")
    assert rows(members, "event_id") == [("a",), ("b",)]
