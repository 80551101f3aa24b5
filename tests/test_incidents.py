from tests.conftest import rows
from tests.test_correlation import alert, frame
from vigilspark.operators import correlate as C
from vigilspark.operators import incidents as I
from vigilspark.operators import intel as T


def exchanges(df):
    """Keys by which a plan deals rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_merged_members_are_dealt_once(spark):
    alerts = frame(spark, [alert(f"e{i}", "builtin-003", 60 * i, host="h", user="u") for i in range(4)])
    found = C.correlate(alerts)
    incidents, members = I.build_incidents(found.correlations), I.incident_members(found.members)
    own = incidents.select("incident_id").selectExpr("incident_id", "'al-own' alert_id", "'e0' event_id")
    merged, every = I.merge_incidents(incidents, members.select(*own.columns).unionByName(own).unionByName(own), incidents, members)
    assert rows(merged, "alert_count", "event_count") == [(5, 4)]
    assert every.count() == 5
    by_event = [k for k in exchanges(merged) if "incident_id#" in k and "event_id#" in k]
    assert len(by_event) == 1 and "alert_id#" not in by_event[0]


def test_pairs_of_incident_and_event_are_dealt_once(spark):
    members = spark.createDataFrame([("i1", "e1"), ("i1", "e1"), ("i2", "e1"), ("i2", "e2")], "incident_id string, event_id string")
    events = spark.createDataFrame(
        [("e1", "10.0.0.1", None, {}), ("e2", "10.0.0.1", "10.0.0.2", {})],
        "event_id string, source_ip string, destination_ip string, metadata map<string,string>",
    )
    iocs = T.incident_iocs(members, events)
    assert rows(iocs, "incident_id", "normalized_value") == [("i1", "10.0.0.1"), ("i2", "10.0.0.1"), ("i2", "10.0.0.2")]
    keys = exchanges(iocs)
    assert keys and not [k for k in keys if "incident_id#" in k and "event_id#" in k]
