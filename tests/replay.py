"""One-event-at-a-time replay of the correlation rules, for checks on small streams."""

from collections import defaultdict

RULES = [
    # type, window, pairs, severity(n, match), description count kind
    ("auth_attack_sequence", 900, {"builtin-003": {"builtin-003"}}),
    ("process_network_sequence", 1800, {"builtin-002": {"builtin-004"}, "builtin-004": {"builtin-002"}}),
    ("privilege_escalation_sequence", 1800, {
        "builtin-005": {"builtin-002", "builtin-003"}, "builtin-002": {"builtin-005"}, "builtin-003": {"builtin-005"}}),
    ("same_entity", 1800, None),
    ("data_exfiltration_sequence", 1800, {"dataset-003": {"dataset-001", "dataset-002"}}),
    ("access_anomaly_sequence", 900, {"dataset-001": {"dataset-004"}, "dataset-002": {"dataset-004"}}),
    ("mass_modification_sequence", 3600, {"dataset-006": {"dataset-005"}}),
]
SPECIAL = [{"builtin-002", "builtin-004"}, {"builtin-005", "builtin-002"}, {"builtin-005", "builtin-003"}]


def entity(kind, a):
    user = f"user:{a['user']}" if a["user"] else None
    host = f"host:{a['host']}" if a["host"] else None
    ip = f"source_ip:{a['source_ip']}" if a["source_ip"] else None
    data = f"dataset:{a['dataset_id']}" if a["dataset_id"] else None
    if kind == "auth_attack_sequence":
        return user or ip or host
    if kind == "process_network_sequence":
        return host
    if kind == "privilege_escalation_sequence":
        return user or host
    if kind == "same_entity":
        return host or user
    if kind == "mass_modification_sequence":
        return data
    return (f"{user}:{data}" if user and data else None) or user or data or host


def pairs_with(kind, pairs, a, h):
    if pairs is not None:
        return h["rule_id"] in pairs.get(a["rule_id"], ())
    return h["rule_id"] != a["rule_id"] and {h["rule_id"], a["rule_id"]} not in SPECIAL


def severity(kind, n, found):
    if kind == "auth_attack_sequence":
        return min(15, 8 + 2 * (n - 2))
    if kind == "data_exfiltration_sequence":
        return min(15, 12 + n - 2)
    if kind == "same_entity":
        return max(x["severity"] for x in found)
    return {"process_network_sequence": 12, "privilege_escalation_sequence": 14,
            "access_anomaly_sequence": 11, "mass_modification_sequence": 12}[kind]


def replay(alerts):
    """alerts: dicts with ts (seconds), event_id, rule_id, rule_order, severity, entities."""
    by_event = defaultdict(list)
    for a in alerts:
        by_event[(a["ts"], a["event_id"])].append(a)
    stored, done, outcomes = [], [], set()
    for key in sorted(by_event):
        siblings = sorted(by_event[key], key=lambda a: a["rule_order"])
        stored += siblings
        for a in siblings:
            for kind, window, pairs in RULES:
                if pairs is not None and a["rule_id"] not in pairs:
                    continue
                who = entity(kind, a)
                if not who:
                    continue
                past = [h for h in stored if h is not a and a["ts"] - window <= h["ts"]
                        and entity(kind, h) == who and pairs_with(kind, pairs, a, h)]
                if not past:
                    continue
                found = past + [a]
                ids = {x["alert_id"] for x in found}
                rules = sorted({x["rule_id"] for x in found})
                open_ones = [c for c in done if c["type"] == kind and c["entity"] == who and c["last"] >= a["ts"] - window]
                if not open_ones:
                    c = {"type": kind, "entity": who, "founder": min(ids), "ids": ids, "last": a["ts"],
                         "first": min(x["ts"] for x in found), "severity": severity(kind, len(ids), found),
                         "n": len(ids), "rules": rules, "first_rules": rules}
                    done.append(c)
                    outcomes.add((a["event_id"], kind, who, c["founder"], "created"))
                    continue
                c = max(open_ones, key=lambda x: x["last"])
                if ids <= c["ids"]:
                    continue
                c["ids"] |= ids
                c["last"] = max(c["last"], a["ts"])
                c["severity"] = max(c["severity"], severity(kind, len(ids), found))
                c["n"], c["rules"] = len(ids), rules
                outcomes.add((a["event_id"], kind, who, c["founder"], "updated"))
    return done, outcomes
