"""Queries S (sources, sinks), N (normalization), D (detection), A (alerts)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import redact, redact_map
from ..operators import alerts as A
from ..operators import detect as D
from ..operators import normalize as N
from ..session import stage_root
from ..sources import readers as S
from ..sources import sinks
from ..sources.buckets import BucketTable
from ..streaming.streams import stream_upsert
from .oracle_base import AL, EV, NAMES, RULES, stamp as us_stamp, with_
from .registry import joined, query, stamp
from .workspace import Workspace


def exported(ws: Workspace, df: DataFrame, fmt: str, name: str, **options) -> str:
    """Write rows in a text format to the shared folder, so a reader has something to read."""
    path = f"{stage_root(ws.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).format(fmt).save(path)
    return path


@query("s01_read_csv_headered", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def _(ws):
    df = ws.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return S.read_csv_headered(ws.spark, exported(ws, df, "csv", "csv", header=True))


@query("s02_read_json_auto", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def _(ws):
    df = ws.table("events").select("event_id", "event_type", "value")
    rows = S.read_json_auto(ws.spark, exported(ws, df, "json", "json"), single="lines")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s03_read_parquet_profile", "SELECT count(*) AS record_count FROM lineitem")
def _(ws):
    return S.read_parquet_profile(ws.spark, f"{ws.sf_dir}/lineitem.parquet").agg(F.count("*").alias("record_count"))


@query("s04_validate_files")
def _(ws):
    return S.validate_files(ws.spark, ws.sf_dir).drop("path")


@query("s04_file_verdicts", """SELECT * FROM (VALUES ('csv', true, ''), ('csv', false, 'json content in csv'), ('json', true, ''), ('json', false, 'not json'),
  ('parquet', true, ''), ('txt', false, 'unsupported extension')) AS t(extension, accepted, problem)""")
def _(ws):
    # tables written as what they are, as something else, and with nothing in them
    nations, regions = ws.table("nation").select("n_nationkey", "n_name"), ws.table("region").select("r_name")
    as_json, folder = nations.select(F.to_json(F.struct("*")).alias("value")), f"{stage_root(ws.spark).rstrip('/')}/verdicts-{uuid.uuid4().hex}"
    for k, (df, fmt, options) in enumerate([
        (nations, "csv", {"header": True}), (as_json, "csv", {"header": False, "quote": "", "sep": "\t"}), (nations, "json", {}), (nations, "parquet", {}),
        (regions, "text", {}),
    ]):
        df.write.options(**options).format(fmt).save(f"{folder}/{k}")
    regions.select(F.lit("a,b").alias("value")).write.option("extension", "json").format("csv").save(f"{folder}/9")
    return S.validate_files(ws.spark, folder).where("problem <> 'empty'").select("extension", "accepted", "problem").distinct()


WAZUH = """
SELECT event_id AS n, CASE WHEN event_id%10=9 THEN NULL ELSE 'w'||event_id END AS id, ts, event_id%17 AS lvl, 'rule text '||event_type AS descr,
  CASE event_type WHEN 'error' THEN ['syslog','Authentication_Failed'] WHEN 'click' THEN ['process'] WHEN 'view' THEN ['firewall'] WHEN 'signup' THEN ['sudo'] ELSE ['other'] END AS groups,
  user_id AS u FROM events"""


def wazuh_raw(ws: Workspace) -> DataFrame:
    """Agent alerts built from the events table, nested as the agent writes them."""
    n, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")

    def groups(*names):
        return F.array(*[F.lit(x) for x in names])

    return ws.table("events").select(
        F.when(n % 10 != 9, F.concat(F.lit("w"), n)).alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.struct(
            F.concat(F.lit("r"), n % 7).alias("id"), (n % 17).alias("level"),
            F.concat(F.lit("rule text "), t).alias("description"),
            F.when(t == "error", groups("syslog", "Authentication_Failed")).when(t == "click", groups("process"))
            .when(t == "view", groups("firewall")).when(t == "signup", groups("sudo")).otherwise(groups("other")).alias("groups"),
            F.struct(F.when(n % 2 == 0, F.array(F.lit("T1110"), F.lit("T1059"))).otherwise(F.array(F.lit("T1071"))).alias("id")).alias("mitre"),
        ).alias("rule"),
        F.struct(F.concat(F.lit("00"), u % 5).alias("id"), F.when(u % 3 != 0, F.concat(F.lit("agent-"), u % 5)).alias("name")).alias("agent"),
        F.struct(F.lit("mgr").alias("name")).alias("manager"),
        F.when(u % 2 == 0, "10.1.1.1").alias("srcip"),
        F.struct(
            F.concat(F.lit("10.2.0."), u % 250).alias("srcip"), F.concat(F.lit("user-"), u % 20).alias("dstuser"),
            F.lit("hunter2").alias("password"),
            F.struct(F.struct((n % 4).cast("string").alias("eventID")).alias("system"),
                     F.struct(F.lit("token=abc run").alias("commandLine")).alias("eventdata")).alias("win"),
        ).alias("data"),
    )


WAZUH_SQL = f"""WITH w AS ({WAZUH})
SELECT coalesce('wazuh-alert-'||id, 'wazuh-synth-'||substr(sha256(strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')||'Z:r'||(n%7)),1,8)) AS event_id,
  strftime(ts,'%Y-%m-%d %H:%M:%S.%f') AS "timestamp",
  CASE groups[1] WHEN 'syslog' THEN 'authentication_failure' WHEN 'process' THEN 'process_start' WHEN 'firewall' THEN 'network_connection'
    WHEN 'sudo' THEN 'privilege_escalation' ELSE CASE n%4 WHEN 1 THEN 'process_start' WHEN 3 THEN 'network_connection' ELSE 'wazuh_alert' END END AS event_type,
  CASE WHEN lvl>=12 THEN 12 WHEN lvl>=8 THEN 10 WHEN lvl>=4 THEN 6 ELSE 3 END AS severity,
  '[r'||(n%7)||'] '||descr||CASE WHEN u%3<>0 THEN ' (host: agent-'||(u%5)||')' ELSE '' END||' (user: user-'||(u%20)||')' AS message,
  coalesce(CASE WHEN u%3<>0 THEN 'agent-'||(u%5) END, '-') AS host, 'user-'||(u%20) AS "user",
  CASE WHEN u%2=0 THEN '10.1.1.1' ELSE '10.2.0.'||(u%250) END AS source_ip,
  '[REDACTED]' AS password, '[REDACTED] run' AS command,
  CASE WHEN n%2=0 THEN '["T1110","T1059"]' ELSE '["T1071"]' END AS mitre
FROM w"""


@query("s05_read_wazuh_alerts", "SELECT count(*) AS n, sum(event_id%17)::BIGINT AS levels FROM events")
def _(ws):
    raw = S.read_wazuh_alerts(ws.spark, exported(ws, wazuh_raw(ws), "json", "wazuh"))
    return raw.agg(F.count("*").alias("n"), F.sum(F.col("rule.level").cast("bigint")).alias("levels"))


@query("n06_wazuh_to_events", WAZUH_SQL)
def _(ws):
    raw = S.read_wazuh_alerts(ws.spark, exported(ws, wazuh_raw(ws), "json", "wazuh"))
    m = F.col("metadata")
    return N.wazuh_to_events(raw).select(
        "event_id", stamp("timestamp"), "event_type", "severity", "message", F.coalesce("host", F.lit("-")).alias("host"),
        "user", "source_ip", m["wazuh_data.password"].alias("password"),
        m["wazuh_data.win.eventdata.commandLine"].alias("command"), m["mitre_techniques"].alias("mitre"),
    )


ACT = """
act AS (
  SELECT event_id AS n, user_id AS u, ts, epoch_us(ts) AS us, 'act-'||event_id AS aid, 'ds-'||(user_id%3) AS ds, 'table '||(user_id%3) AS dn,
    (['dataset_opened','dataset_read','sensitive_column_access','bulk_access','dataset_modified','dataset_copied','dataset_exported','dataset_deleted','schema_changed'])[CAST(event_id%9 AS INTEGER)+1] AS op,
    CASE WHEN user_id%10=0 THEN '' ELSE 'user-'||(user_id%20) END AS actor,
    CASE WHEN user_id%4<>0 THEN 'host-'||(user_id%5) END AS ahost,
    200*CAST(regexp_extract(props,'[0-9]+') AS BIGINT) AS acc,
    CASE WHEN event_id%9=4 THEN 150*CAST(regexp_extract(props,'[0-9]+') AS BIGINT) ELSE 0 END AS mods,
    event_id%9=2 AS has_cols, CASE user_id%3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS lvl
  FROM events),
acts AS (
  SELECT act.*, CASE op WHEN 'bulk_access' THEN 'dataset_bulk_access' WHEN 'sensitive_column_access' THEN op WHEN 'schema_changed' THEN 'dataset_schema_changed' ELSE op END AS ety,
    CASE op WHEN 'dataset_exported' THEN CASE WHEN lvl<>'LOW' OR acc>=5000 THEN 10 ELSE 7 END
      WHEN 'dataset_deleted' THEN CASE WHEN lvl<>'LOW' THEN 11 ELSE 8 END
      WHEN 'dataset_modified' THEN CASE WHEN mods>=10000 THEN 11 WHEN mods>=1000 THEN 7 ELSE 4 END
      WHEN 'schema_changed' THEN CASE WHEN lvl<>'LOW' THEN 8 ELSE 6 END
      WHEN 'bulk_access' THEN CASE WHEN lvl='CRITICAL' OR has_cols THEN 10 WHEN acc>=50000 THEN 8 ELSE 6 END
      WHEN 'sensitive_column_access' THEN CASE WHEN lvl='CRITICAL' THEN 9 ELSE 7 END ELSE 3 END AS sev
  FROM act)"""


@query("s06_read_dataset_activity", with_(ACT) + "SELECT op AS operation, count(*) AS n, sum(acc)::BIGINT AS records FROM act GROUP BY 1")
def _(ws):
    rows = S.read_dataset_activity(ws.spark, exported(ws, ws.activities, "json", "activity"))
    return rows.groupBy("operation").agg(F.count("*").alias("n"), F.sum("records_accessed").alias("records"))


@query("s08_insert_if_absent", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labelled' END AS source FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT doc_id, 'labelled' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(ws):
    stored = ws.table("labels").select("doc_id", F.lit("labelled").alias("source"))
    return sinks.insert_if_absent(ws.table("documents").select("doc_id", "source"), stored, "doc_id").table


@query("s08_insert_outcomes", """SELECT CASE WHEN l.doc_id IS NULL THEN 'created' ELSE 'duplicate' END AS outcome, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def _(ws):
    stored = ws.table("labels").select("doc_id", F.lit("labelled").alias("source"))
    done = sinks.insert_if_absent(ws.table("documents").select("doc_id", "source"), stored, "doc_id")
    return done.outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


@query("s09_upsert", """SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'quality '||l.quality END AS source FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT doc_id, 'xx', 'quality '||quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(ws):
    new = ws.table("labels").select("doc_id", F.lit("xx").alias("lang"), F.concat(F.lit("quality "), "quality").alias("source"))
    return sinks.upsert(new, ws.table("documents").select("doc_id", "lang", "source"), "doc_id", ["source"]).table


@query("x05_stream_upsert", """SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'quality '||l.quality END AS source FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT doc_id, 'xx', 'quality '||quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(ws):
    # documents and labels as two micro-batches of one stream; the second changes the source of what is labelled
    folder = f"{stage_root(ws.spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    docs = ws.table("documents").select("doc_id", "lang", "source")
    labels = ws.table("labels").select("doc_id", F.lit("xx").alias("lang"), F.concat(F.lit("quality "), "quality").alias("source"))
    for part in (docs, labels):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = ws.spark.readStream.schema(docs.schema).parquet(f"{folder}/in")
        stream_upsert(stream, f"{folder}/table", "doc_id", ["source"], f"{folder}/check", buckets=64).trigger(availableNow=True).start().awaitTermination()
    return BucketTable(ws.spark, f"{folder}/table", "doc_id", docs.schema, 64).read()


@query("s10_append_audit", with_(EV, AL) + """SELECT 'alert.created' AS action, count(*) AS n, count(DISTINCT alert_id) AS targets FROM al
UNION ALL SELECT 'event.created', count(*), count(*) FROM ev""")
def _(ws):
    events = sinks.audit_rows(ws.events.select("event_id", F.lit("created").alias("outcome")), "event_id", "event")
    alerts = sinks.audit_rows(ws.live_alerts.select("alert_id", F.lit("created").alias("outcome")), "alert_id", "alert")
    log = sinks.append_audit([events, alerts])
    return log.groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets"))


# --- N ----------------------------------------------------------------------------------


@query("n01_parse_event_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS parsed FROM events")
def _(ws):
    n = F.col("event_id")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.when(n % 4 == 0, "Z").when(n % 4 == 1, "+00:00").when(n % 4 == 2, "+0000").otherwise("")
    parsed = N.parse_event_time(F.concat(base, zone))
    return ws.table("events").select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@query("n02_severity_from_name", """SELECT o_orderkey, coalesce(CASE lower(split_part(o_orderpriority,'-',2)) WHEN 'low' THEN 3 WHEN 'medium' THEN 6 WHEN 'high' THEN 10 WHEN 'critical' THEN 15 END, -1) AS severity FROM orders""")
def _(ws):
    word = F.concat(F.lit(" "), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), F.lit(" "))
    return ws.table("orders").select("o_orderkey", F.coalesce(N.severity_from_name(word), F.lit(-1)).alias("severity"))


@query("n03_fold_extra_fields", "SELECT 'o-'||o_orderkey AS event_id, o_orderstatus AS status, o_orderpriority AS priority, 'orders' AS kept FROM orders")
def _(ws):
    df = ws.table("orders").select(
        F.concat(F.lit("o-"), "o_orderkey").alias("event_id"),
        F.create_map(F.lit("o_orderstatus"), F.lit("old"), F.lit("origin"), F.lit("orders")).alias("metadata"),
        "o_orderstatus", "o_orderpriority",
    )
    m = F.col("metadata")
    return N.fold_extra_fields(df).select(
        "event_id", m["o_orderstatus"].alias("status"), m["o_orderpriority"].alias("priority"), m["origin"].alias("kept")
    )


@query("n04_validate_rows", """SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN length(text)<1 OR length(text)>10000 THEN 'message' END, CASE WHEN n_chars%20>15 THEN 'severity' END) AS failed FROM documents) WHERE failed<>''""")
def _(ws):
    df = ws.table("documents").select(
        "doc_id", F.concat(F.lit("d-"), "doc_id").alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
        "source", F.col("lang").alias("event_type"), (F.col("n_chars") % 20).cast("int").alias("severity"),
        F.col("text").alias("message"), *[F.lit(None).cast("string").alias(c) for c in ("host", "user", "source_ip", "destination_ip")],
    )
    return N.validate_rows(df, N.event_checks()).rejected.select("doc_id", joined("failed_checks", "failed"))


@query("n05_dedup_events", """SELECT 'o-'||l_orderkey AS event_id, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r=1""")
def _(ws):
    df = ws.table("lineitem").select(F.concat(F.lit("o-"), "l_orderkey").alias("event_id"), "l_linenumber", "l_partkey", "l_suppkey")
    return N.dedup_events(df, ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query("n07_wazuh_level_bucket", "SELECT l_orderkey, l_linenumber, CASE WHEN floor(l_quantity)>=12 THEN 12 WHEN floor(l_quantity)>=8 THEN 10 WHEN floor(l_quantity)>=4 THEN 6 ELSE 3 END AS bucket FROM lineitem")
def _(ws):
    return ws.table("lineitem").select("l_orderkey", "l_linenumber", N.wazuh_level_bucket(F.col("l_quantity").cast("string")).alias("bucket"))


@query("n08_wazuh_event_type", f"WITH x AS ({WAZUH_SQL}) SELECT event_type, count(*) AS n FROM x GROUP BY 1")
def _(ws):
    raw = wazuh_raw(ws)
    kind = N.wazuh_event_type(F.col("rule.groups"), F.col("data.win.system.eventID"))
    return raw.select(kind.alias("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("n09_wazuh_event_id", f"WITH x AS ({WAZUH_SQL}) SELECT event_id FROM x")
def _(ws):
    return wazuh_raw(ws).select(N.wazuh_event_id(F.col("id"), F.lit(None).cast("string"), F.col("timestamp"), F.col("rule.id")).alias("event_id"))


@query("n10_mitre_as_array", "SELECT event_id, CASE WHEN event_id%3=0 THEN 'T1' WHEN event_id%3=1 THEN 'T1,T2' ELSE '' END AS techniques FROM events")
def _(ws):
    n = F.col("event_id")
    raw = F.when(n % 3 == 0, "T1").when(n % 3 == 1, '["T1","T2"]')
    return ws.table("events").select("event_id", F.array_join(N.mitre_as_array(raw), ",").alias("techniques"))


def _redact_sql(text: str, words: list[str], pairs: bool, trimmed: bool) -> str:
    out = f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')" if trimmed else text
    if pairs:
        out = f"regexp_replace({out}, '(?i){fv.PAIR_PATTERN}', '[REDACTED]', 'g')"
    for word in words:
        out = f"regexp_replace({out}, '(?i){word}', '[REDACTED]', 'g')"
    return out


@query("n11_redact_text", f"SELECT 'd'||doc_id AS id, md5({_redact_sql('text', fv.TELEMETRY_KEYWORDS, True, False)}) AS digest FROM documents UNION ALL SELECT 'c'||conv_id||'-'||turn, md5({_redact_sql('text', fv.TELEMETRY_KEYWORDS, True, False)}) FROM conversations")
def _(ws):
    docs = ws.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    talk = ws.table("conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return docs.unionByName(talk).select("id", F.md5(redact(F.col("text"))).alias("digest"))


@query("n12_redact_map", f"SELECT conv_id, turn, '[REDACTED]' AS api_token, md5({_redact_sql('text', fv.TELEMETRY_KEYWORDS, True, False)}) AS body FROM conversations")
def _(ws):
    values = F.create_map(F.lit("API_Token"), F.col("role"), F.lit("body"), F.col("text"))
    out = redact_map(values)
    return ws.table("conversations").select("conv_id", "turn", out["API_Token"].alias("api_token"), F.md5(out["body"]).alias("body"))


for _kind, _words, _pairs in (("case", fv.CASE_KEYWORDS, False), ("response", fv.RESPONSE_KEYWORDS, True), ("report", fv.CASE_KEYWORDS, False)):
    @query(f"n13_redact_{_kind}", f"SELECT doc_id, md5({_redact_sql('text', _words, _pairs, True)}) AS digest FROM documents")
    def _(ws, kind=_kind):
        return ws.table("documents").select("doc_id", F.md5(redact(F.col("text"), kind)).alias("digest"))


@query("n14_activity_event_type", with_(ACT) + "SELECT aid AS activity_id, ety AS event_type FROM acts")
def _(ws):
    return ws.activities.select("activity_id", N.activity_event_type(F.concat(F.lit("DatasetOperation."), "operation")).alias("event_type"))


@query("n15_activity_severity", with_(ACT) + "SELECT aid AS activity_id, sev AS severity FROM acts")
def _(ws):
    level = F.col("context")["sensitivity"]
    value = N.activity_severity(F.col("operation"), F.col("records_accessed"), F.col("records_modified"), F.size("sensitive_columns") > 0, level)
    return ws.activities.select("activity_id", value.alias("severity"))


@query("n16_activity_to_events", with_(ACT) + f"""SELECT 'dset-act-'||aid AS event_id, {us_stamp('us')} AS "timestamp", ety AS event_type, sev AS severity,
  '['||dn||'] '||upper(ety)||' by actor '''||CASE WHEN actor='' THEN 'unknown_actor' ELSE actor END||''' (records: '||CASE WHEN acc<>0 THEN acc ELSE mods END
   ||', sensitive_cols: '||CASE WHEN has_cols THEN 2 ELSE 0 END||')'||CASE WHEN op='dataset_exported' THEN ' exported to ftp://host/?[REDACTED]' ELSE '' END AS message,
  coalesce(ahost,'workstation-01') AS host, CASE WHEN actor='' THEN 'unknown_actor' ELSE actor END AS "user",
  CASE WHEN has_cols THEN '["email","user_[REDACTED]"]' ELSE '[]' END AS cols FROM acts""")
def _(ws):
    return N.activity_to_events(ws.activities).select(
        "event_id", stamp("timestamp"), "event_type", "severity", "message", "host", "user", F.col("metadata")["sensitive_columns"].alias("cols")
    )


@query("n17_event_dedup_key_activity", "SELECT 'dset-act-act-'||event_id AS event_id FROM events")
def _(ws):
    return ws.activities.select(N.event_dedup_key_activity(F.col("activity_id")).alias("event_id"))


# --- D, A -------------------------------------------------------------------------------

for _no, (_rule, _condition) in enumerate(RULES.items(), 1):
    @query(f"d{_no:02d}_{_rule.replace('-', '_')}", with_(EV, AL) + f"SELECT event_id, severity, mitre AS mitre_techniques FROM al WHERE rule_id='{_rule}'")
    def _(ws, rule=_rule):
        return D.detect_one(ws.events, rule).select("event_id", "severity", joined("mitre_techniques"))


@query("d12_detect", with_(EV, AL) + "SELECT event_id, rule_id, rule_name, rule_order, severity, mitre AS mitre_techniques FROM al")
def _(ws):
    return D.detect(ws.events).select("event_id", "rule_id", "rule_name", "rule_order", "severity", joined("mitre_techniques"))


@query("d12_evidence", with_(EV) + """SELECT event_id, '["powershell -enc"]' AS indicators, '-' AS accessed FROM ev WHERE event_type='process_start' AND contains(message,'powershell -enc')
UNION ALL SELECT event_id, '-', CAST(records AS VARCHAR) FROM ev WHERE source='dataset_activity' AND (event_type='dataset_bulk_access' OR records>=10000)""")
def _(ws):
    hits = D.detect(ws.events, [r for r in D.BUILTIN_RULES if r.rule_id in ("builtin-002", "dataset-001")])
    e = F.col("evidence")
    return hits.select(
        "event_id", F.coalesce(e["indicators_matched"], F.lit("-")).alias("indicators"),
        F.coalesce(e["records_accessed"], F.lit("-")).alias("accessed"),
    )


@query("a01_build_alerts", with_(EV, AL) + f"SELECT alert_id, event_id, {us_stamp('us')} AS \"timestamp\", rule_id, rule_name, severity, source, 'new' AS status FROM al")
def _(ws):
    return A.build_alerts(D.detect(ws.events)).select(
        "alert_id", "event_id", stamp("timestamp"), "rule_id", "rule_name", "severity", "source", "status"
    )


@query("a02_dedup_alerts", with_(EV, AL) + "SELECT rule_id, count(*) AS n FROM al GROUP BY 1")
def _(ws):
    alerts = A.build_alerts(D.detect(ws.events))
    return A.dedup_alerts(alerts.unionByName(alerts)).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("a03_alerts_with_entities", with_(EV, AL) + "SELECT alert_id, host, usr AS \"user\", source_ip, coalesce(destination_ip,'-') AS destination_ip FROM al")
def _(ws):
    stored = A.build_alerts(D.detect(ws.events))
    return A.alerts_with_entities(stored, ws.events).select(
        "alert_id", "host", "user", "source_ip", F.coalesce("destination_ip", F.lit("-")).alias("destination_ip")
    )


@query("u01_custom_detection_rule", with_(EV) + "SELECT event_id, 'custom-001' AS rule_id, 5 AS severity FROM ev WHERE destination_ip='198.51.100.99'")
def _(ws):
    rule = D.DetectionRule("custom-001", "Known scanner", "Traffic to a known scanner.", 5, lambda: F.col("destination_ip") == "198.51.100.99", {"ip": lambda: F.col("destination_ip")})
    return D.detect(ws.events, [rule]).select("event_id", "rule_id", "severity")


@query("u05_custom_adapter", "SELECT 'doc-'||doc_id AS event_id, lang AS event_type FROM documents")
def _(ws):
    def adapter(raw: DataFrame) -> DataFrame:
        return raw.select(F.concat(F.lit("doc-"), "doc_id").alias("event_id"), F.col("lang").alias("event_type"))

    return S.from_adapter(ws.table("documents"), adapter)


_ = NAMES
