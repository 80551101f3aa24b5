"""Queries P (profiling), Q (assessment), V (reports), L (lifecycle), K (lookups), G (rollups), X (streaming forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import assess as Q
from ..operators import lifecycle as L
from ..operators import lookup as K
from ..operators import profile as P
from ..operators import report as V
from ..operators import rollups as G
from ..streaming import streams as X
from .oracle_base import AL, CO, EV, FEED, II, IN, IO, RK, stamp as us_stamp, with_
from .queries_intake import ACT, _redact_sql
from .registry import joined, query, stamp

BASE_I = with_(EV, AL, CO, IN)
BASE_R = with_(EV, AL, CO, IN, RK)
BASE_ALL = with_(EV, AL, CO, IN, RK, IO, FEED, II)

# --- P ----------------------------------------------------------------------------------

WORDS = """(['ssn','Credit-Card','api key','pan','passport number','passport','salary','bank_account','token','base_salary','medical_record',
 'email','phone','zip_code','dob','employee_id','customer_id','full_name','payment','member_id','colour','secret','transaction'])"""
WORD_SQL = f"""w AS (SELECT p_partkey, ({WORDS})[CAST(p_partkey%23 AS INTEGER)+1] AS nm FROM part)"""


@query("p01_classify_column_name", f"WITH {WORD_SQL}" + """ SELECT p_partkey, CASE nm WHEN 'ssn' THEN 'ssn' WHEN 'Credit-Card' THEN 'credit_card' WHEN 'api key' THEN 'secret' WHEN 'pan' THEN 'pan' WHEN 'passport' THEN 'passport'
 WHEN 'salary' THEN 'salary' WHEN 'bank_account' THEN 'account_id' WHEN 'token' THEN 'secret' WHEN 'medical_record' THEN 'financial' WHEN 'email' THEN 'email' WHEN 'phone' THEN 'phone' WHEN 'zip_code' THEN 'address' WHEN 'dob' THEN 'dob'
 WHEN 'employee_id' THEN 'employee_id' WHEN 'customer_id' THEN 'customer_id' WHEN 'full_name' THEN 'name' WHEN 'payment' THEN 'transaction' WHEN 'member_id' THEN 'personal_identifier' WHEN 'secret' THEN 'secret' WHEN 'transaction' THEN 'transaction' ELSE '-' END AS pii_type,
 CASE WHEN nm IN ('ssn','Credit-Card','api key','pan','passport','token','secret') THEN 'CRITICAL' WHEN nm IN ('salary','bank_account','medical_record') THEN 'HIGH'
  WHEN nm IN ('passport number','base_salary','colour') THEN 'LOW' ELSE 'MEDIUM' END AS sensitivity FROM w""")
def _(ws):
    names = [
        "ssn", "Credit-Card", "api key", "pan", "passport number", "passport", "salary", "bank_account", "token", "base_salary",
        "medical_record", "email", "phone", "zip_code", "dob", "employee_id", "customer_id", "full_name", "payment", "member_id",
        "colour", "secret", "transaction",
    ]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 23 + 1).cast("int"))
    kind = P.classify_column_name(name)
    return ws.table("part").select(
        "p_partkey", F.coalesce(kind["pii_type"], F.lit("-")).alias("pii_type"), F.coalesce(kind["sensitivity"], F.lit("LOW")).alias("sensitivity")
    )


@query("p02_classify_column_values", r"""SELECT c_custkey, CASE c_custkey%6 WHEN 0 THEN 'ssn' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'email' WHEN 3 THEN 'phone' WHEN 4 THEN 'secret' ELSE '-' END AS kind FROM customer""")
def _(ws):
    k = F.col("c_custkey")
    digits = F.right(F.lpad(k.cast("string"), 12, "0"), F.lit(4))
    value = (
        F.when(k % 6 == 0, F.concat(F.lit("123-45-"), digits))
        .when(k % 6 == 1, F.concat(F.lit("4111 1111-1111"), digits))
        .when(k % 6 == 2, F.concat(F.lit("user.n-"), k, F.lit("@mail.example")))
        .when(k % 6 == 3, F.concat(F.lit("+1 (555) 123-"), digits))
        .when(k % 6 == 4, F.concat(F.lit("AKIA000000000000"), digits))
        .otherwise(F.col("c_name"))
    )
    return ws.table("customer").select("c_custkey", F.coalesce(P.classify_value(value)["pii_type"], F.lit("-")).alias("kind"))


PROFILE = """
prof AS (
  SELECT 'customer' AS t, 0 AS pos, 'customer_id' AS nm, c_custkey::VARCHAR AS v FROM customer UNION ALL SELECT 'customer',1,'customer_name',c_name FROM customer
  UNION ALL SELECT 'customer',2,'national_id',c_nationkey::VARCHAR FROM customer UNION ALL SELECT 'customer',3,'account_number',c_acctbal::VARCHAR FROM customer
  UNION ALL SELECT 'customer',4,'segment',c_mktsegment FROM customer
  UNION ALL SELECT 'orders',0,'order_no',o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'orders',1,'user_id',o_custkey::VARCHAR FROM orders
  UNION ALL SELECT 'orders',2,'secret',o_orderstatus FROM orders UNION ALL SELECT 'orders',3,'payment',o_totalprice::VARCHAR FROM orders
  UNION ALL SELECT 'orders',4,'ordered_at',o_orderdate::VARCHAR FROM orders UNION ALL SELECT 'orders',5,'export',o_orderpriority FROM orders
  UNION ALL SELECT 'supplier',0,'key',s_suppkey::VARCHAR FROM supplier UNION ALL SELECT 'supplier',1,'label',s_name FROM supplier UNION ALL SELECT 'supplier',2,'base_salary',s_acctbal::VARCHAR FROM supplier
  UNION ALL SELECT 'conversations',0,'conv_id',conv_id::VARCHAR FROM conversations UNION ALL SELECT 'conversations',1,'turn',turn::VARCHAR FROM conversations
  UNION ALL SELECT 'conversations',2,'email',role FROM conversations UNION ALL SELECT 'conversations',3,'phone',CASE WHEN turn>0 THEN text END FROM conversations),
pf AS (
  SELECT t, pos, nm, count(*) AS n, count(*) FILTER (trim(coalesce(v,''))='') AS nulls, count(DISTINCT trim(v)) FILTER (trim(v)<>'') AS uniq,
    bool_and(regexp_matches(trim(v), '^[+-]?[0-9]+$')) FILTER (trim(v)<>'') AS ai, bool_and(regexp_matches(trim(v), '^[+-]?[0-9]+(\\.[0-9]*)?(e[+-]?[0-9]+)?$')) FILTER (trim(v)<>'') AS af
  FROM prof GROUP BY ALL),
pg AS (
  SELECT pf.*, round(nulls/n, 4) AS nr, round(1-uniq/(n-nulls), 4) AS dr, CASE WHEN ai THEN 'integer' WHEN af THEN 'float' ELSE 'string' END AS ity FROM pf)"""


@query("p03_infer_type", "WITH " + PROFILE + " SELECT t AS table_name, nm AS name, ity AS inferred_type FROM pg")
def _(ws):
    return ws.column_profiles.select("table_name", "name", "inferred_type")


@query("p04_column_stats", "WITH " + PROFILE + " SELECT t AS table_name, nm AS name, n::BIGINT AS sampled_rows, nr AS null_ratio, dr AS duplicate_ratio FROM pg")
def _(ws):
    return ws.column_profiles.select("table_name", "name", "sampled_rows", "null_ratio", "duplicate_ratio")


SHAPE = """
sh AS (
  SELECT * FROM (VALUES ('customer','account_number:double:customer_id:int64:customer_name:string:national_id:int32:segment:string',5,'CRITICAL','customer_id,customer_name,national_id,account_number'),
   ('orders','export:string:order_no:int64:ordered_at:timestamp[us]:payment:double:secret:string:user_id:int64',6,'CRITICAL','user_id,secret,payment'),
   ('supplier','base_salary:double:key:int64:label:string',3,'LOW',''),
   ('conversations','conv_id:int64:email:string:phone:string:turn:int64',4,'MEDIUM','email,phone')) v(t, sig, cc, lvl, sens)),
ca AS (
  SELECT sh.*, substr(sha256(sig),1,16) AS hash, 'ds-'||substr(sha256(t||'.parquet:'||substr(sha256(sig),1,16)),1,12) AS did,
    (SELECT max(n) FROM pg WHERE pg.t=sh.t) AS records FROM sh)"""


@query("p05_profile_dataset", "WITH " + PROFILE + "," + SHAPE + " SELECT did AS dataset_id, t AS name, hash AS schema_hash, records AS record_count, cc AS column_count, lvl AS sensitivity, sens AS sensitive_columns, true AS has_size FROM ca WHERE t='customer'")
def _(ws):
    df, order = ws.renamed_tables()["customer"]
    asset = P.profile_dataset(df, "customer.parquet", "parquet", order, sample_rows=None)
    return asset.select("dataset_id", "name", "schema_hash", "record_count", "column_count", "sensitivity", joined("sensitive_columns"), (F.col("size_bytes") > 0).alias("has_size"))


@query("p05_profile_sample", "WITH o AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)," + PROFILE.replace("FROM orders", "FROM o") + """
SELECT nm AS name, CASE nm WHEN 'order_no' THEN 'int64' WHEN 'user_id' THEN 'int64' WHEN 'payment' THEN 'double' WHEN 'ordered_at' THEN 'timestamp[us]' ELSE 'string' END AS data_type,
  ity AS inferred_type, nm IN ('user_id','secret','payment') AS is_sensitive, nr AS null_ratio, dr AS duplicate_ratio FROM pg WHERE t='orders'""")
def _(ws):
    # the sampling form of the operator: first 100 rows in key order
    df, order = ws.renamed_tables()["orders"]
    return P.profile_columns(df, order).select("name", "data_type", "inferred_type", "is_sensitive", "null_ratio", "duplicate_ratio")


@query("p06_profile_catalog", "WITH " + PROFILE + "," + SHAPE + " SELECT did AS dataset_id, t AS name, hash AS schema_hash, records AS record_count, cc AS column_count, lvl AS sensitivity, sens AS sensitive_columns FROM ca")
def _(ws):
    return ws.catalog.select("dataset_id", "name", "schema_hash", "record_count", "column_count", "sensitivity", joined("sensitive_columns"))


# --- Q ----------------------------------------------------------------------------------

SENS = "('customer_id','customer_name','national_id','account_number','user_id','secret','payment','email','phone')"
FIND = f"""
fi AS (
  SELECT t, 'find-secret-' AS f, 'CRITICAL' AS sev, nm, pos FROM pg WHERE nm='secret'
  UNION ALL SELECT t, 'find-highrisk-', 'HIGH', nm, pos FROM pg WHERE nm IN ('national_id','account_number')
  UNION ALL SELECT t, 'find-pii-', 'MEDIUM', nm, pos FROM pg WHERE nm IN ('customer_id','user_id','payment','email','phone')
  UNION ALL SELECT t, 'find-null-sensitive-', 'MEDIUM', nm, pos FROM pg WHERE nm IN {SENS} AND nr>=0.5
  UNION ALL SELECT t, 'find-dup-id-', 'LOW', nm, pos FROM pg WHERE nm IN {SENS} AND (nm IN ('customer_id','email','account_number') OR contains(nm,'id')) AND dr>=0.6
  UNION ALL SELECT t, 'find-schema-naming-', 'MEDIUM', nm, pos FROM pg WHERE nm='export'
  UNION ALL SELECT t, 'find-sensitivity-', 'CRITICAL', nm, pos FROM pg WHERE nm IN {SENS} AND t IN ('customer','orders')),
fg AS (SELECT did, t, f||substr(did,1,8) AS finding_id, sev, string_agg(nm, ',' ORDER BY pos) AS cols FROM fi JOIN ca USING (t) GROUP BY ALL),
sc AS (
  SELECT ca.did, ca.t, 100-coalesce(sum(CASE sev WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 3 ELSE 0 END),0) AS s0,
   count(*) FILTER (sev='CRITICAL') AS c, count(*) FILTER (sev='HIGH') AS h, count(*) FILTER (sev='MEDIUM') AS m, count(*) FILTER (sev='LOW') AS l
  FROM ca LEFT JOIN fg ON fg.did=ca.did GROUP BY ALL)"""
FULL = "WITH " + PROFILE + "," + SHAPE + "," + FIND + " "


def finding_query(name: str, prefix: str) -> None:
    @query(name, FULL + f"SELECT did AS dataset_id, finding_id, sev AS severity, cols AS affected_columns FROM fg WHERE finding_id LIKE '{prefix}%'")
    def _(ws):
        found = Q.finding_rows(ws.assessments).where(F.col("finding_id").startswith(prefix))
        return found.select("dataset_id", "finding_id", "severity", joined("affected_columns"))


for _name, _prefix in (
    ("q01_finding_secret_fields", "find-secret-"), ("q02_finding_high_risk_fields", "find-highrisk-"), ("q03_finding_pii_fields", "find-pii-"),
    ("q04_finding_null_heavy", "find-null-sensitive-"), ("q05_finding_duplicate_ids", "find-dup-id-"),
    ("q06_finding_untyped_sensitive", "find-schema-gap-"), ("q07_finding_wide_schema", "find-schema-wide-"),
    ("q08_finding_suspicious_names", "find-schema-naming-"), ("q09_finding_sensitivity_class", "find-sensitivity-"),
):
    finding_query(_name, _prefix)


@query("q10_assessment_checks", FULL + """SELECT did AS dataset_id, 12 AS checks, 1+3+CAST(NOT EXISTS(SELECT 1 FROM fg WHERE fg.did=ca.did AND finding_id LIKE 'find-secret%') AS INTEGER)
 +CAST(NOT EXISTS(SELECT 1 FROM fg WHERE fg.did=ca.did AND finding_id LIKE 'find-highrisk%') AS INTEGER)+CAST(NOT EXISTS(SELECT 1 FROM fg WHERE fg.did=ca.did AND finding_id LIKE 'find-pii%') AS INTEGER)
 +CAST(NOT EXISTS(SELECT 1 FROM fg WHERE fg.did=ca.did AND finding_id LIKE 'find-null%') AS INTEGER)+CAST(NOT EXISTS(SELECT 1 FROM fg WHERE fg.did=ca.did AND finding_id LIKE 'find-dup%') AS INTEGER)
 +1+1+CAST(lvl IN ('LOW','MEDIUM') AS INTEGER) AS passed FROM ca""")
def _(ws):
    rows = Q.check_rows(ws.assessments)
    return rows.groupBy("dataset_id").agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"))


SCORE = "greatest(0, least(100, s0))"


@query("q11_security_score", FULL + f"SELECT did AS dataset_id, CAST({SCORE} AS INTEGER) AS score, CASE WHEN s0>=80 THEN 'LOW' WHEN s0>=60 THEN 'MEDIUM' WHEN s0>=40 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM sc")
def _(ws):
    return ws.assessments.select("dataset_id", "score", "risk_level")


@query("q12_assess_datasets", FULL + "SELECT 'assess-'||substr(sha256(did),1,12) AS assessment_id, did AS dataset_id, t AS dataset_name, c AS critical_findings, h AS high_findings, m AS medium_findings, l AS low_findings FROM sc")
def _(ws):
    return Q.assess_datasets(ws.catalog).select(
        "assessment_id", "dataset_id", "dataset_name", "critical_findings", "high_findings", "medium_findings", "low_findings"
    )


# --- V ----------------------------------------------------------------------------------

CTX = """
fa AS (SELECT iid, alert_id, row_number() OVER (PARTITION BY iid ORDER BY alert_id) AS r FROM (SELECT DISTINCT 'inc-'||substr(sha256('incident:'||cid),1,16) AS iid, alert_id FROM mb)),
fe AS (SELECT iid, event_id, row_number() OVER (PARTITION BY iid ORDER BY event_id) AS r FROM imem),
isd AS (SELECT iid, contains(lower(ct||ent),'dataset') AS is_ds FROM inc),
ctx AS (
  SELECT rl.*, isd.is_ds, coalesce(ts.total,0) AS total, coalesce(ts.bad,0) AS bad, coalesce(ts.good,0) AS good, replace(replace(ititle,'Authentication','[REDACTED]entication'),'auth','[REDACTED]') AS rtitle,
    (SELECT string_agg(a.rule_id, ',' ORDER BY fa.r) FROM fa JOIN al a ON a.alert_id=fa.alert_id WHERE fa.iid=rl.iid AND fa.r<=10) AS first_rules,
    (SELECT string_agg(replace(a.rule_name,'Authentication','[REDACTED]entication'), ', ' ORDER BY fa.r) FROM fa JOIN al a ON a.alert_id=fa.alert_id WHERE fa.iid=rl.iid AND fa.r<=10) AS first_names
  FROM rl JOIN isd USING (iid) LEFT JOIN ts ON ts.iid=rl.iid)"""
BASE_V = with_(EV, AL, CO, IN, RK, IO, FEED, II, CTX)


@query("v01_report_context", BASE_V + "SELECT iid AS incident_id, rtitle AS incident_title, ent AS entity_id, first_rules, score AS risk_score, lvl AS risk_level, total AS total_indicators, bad AS malicious_count, is_ds AS is_dataset FROM ctx")
def _(ws):
    return ws.report_context.select(
        "incident_id", "incident_title", "entity_id", F.array_join("alerts_summary.rule_id", ",").alias("first_rules"), "risk_score", "risk_level",
        "total_indicators", "malicious_count", F.col("dataset").isNotNull().alias("is_dataset"),
    )


@query("v02_report_findings", BASE_V + """SELECT iid AS incident_id, 'Observed '||alert_count||' alert(s) across incident: '||first_names||'.' AS observed, 'Primary affected entity identified as '''||ent||'''.' AS entity,
 CASE WHEN techs<>'' THEN 'Observed telemetry patterns align with mapped MITRE ATT&CK technique(s): '||replace(techs,',',', ')||'.'
  ELSE 'Multiple alerts correlated against the same entity within a short time window indicate a coordinated sequence of suspicious activities.' END AS inferred FROM ctx""")
def _(ws):
    f = F.col("findings")
    inferred = F.get(F.filter(f, lambda x: x["finding_type"] == "INFERRED"), 0)["description"]
    return ws.investigations.select(
        "incident_id", F.get(f, 0)["description"].alias("observed"), F.get(f, 1)["description"].alias("entity"), inferred.alias("inferred")
    )


@query("v03_report_dataset_findings", BASE_V + """SELECT iid AS incident_id, 'Actor ''None'' performed operations [] on dataset ''unknown'' (sensitivity: None), accessing 0 records.' AS accessed FROM ctx WHERE is_ds""")
def _(ws):
    found = ws.investigations.select("incident_id", F.explode("findings").alias("f"))
    return found.where(F.col("f.description").startswith("Actor '")).select("incident_id", F.col("f.description").alias("accessed"))


@query("v04_report_timeline", BASE_V + f"""SELECT iid AS incident_id, fe.event_id AS event_key, {us_stamp('ev.us')} AS "timestamp" FROM fe JOIN ev ON ev.event_id=fe.event_id WHERE fe.r<=15""".replace("fe.event_id AS event_key, ", ""))
def _(ws):
    return ws.investigations.select("incident_id", F.explode("timeline").alias("t")).select("incident_id", F.col("t.timestamp").alias("timestamp")).select("incident_id", stamp("timestamp"))


@query("v05_report_gaps_next_steps", BASE_V + "SELECT iid AS incident_id, CASE WHEN total=0 THEN 'No IOCs were extracted or enriched from incident telemetry.' ELSE 'Network flow metadata and full memory dumps are currently uncollected.' END AS gaps, CASE WHEN bad>0 THEN 4 ELSE 3 END AS steps FROM ctx")
def _(ws):
    return ws.investigations.select("incident_id", joined("investigation_gaps", "gaps"), F.size("recommended_next_steps").alias("steps"))


@query("v06_report_actions", BASE_V + "SELECT iid AS incident_id, CASE WHEN is_ds THEN 'restrict_dataset_access' ELSE 'isolate_endpoint,quarantine_file,revoke_credentials' END AS actions FROM ctx")
def _(ws):
    return ws.investigations.select("incident_id", F.array_join("possible_response_actions.action_type", ",").alias("actions"))


@query("v07_report_confidence", BASE_V + "SELECT iid AS incident_id, CAST(round((0.70 + CASE WHEN techs<>'' THEN 0.15 ELSE 0 END + CASE WHEN total>0 THEN 0.10 ELSE 0 END)*100, 0) AS INTEGER) AS confidence FROM ctx")
def _(ws):
    return ws.report_context.select("incident_id", F.round(V.report_confidence() * 100, 0).cast("int").alias("confidence"))


@query("v08_report_summary", BASE_V + """SELECT 'inv-'||substr(sha256('inv:'||iid),1,16) AS investigation_id, 'Automated AI investigation for incident '||iid||' ('''||rtitle||'''). Entity '''||ent||''' was involved in '||alert_count||' alert(s)'
 ||CASE WHEN techs<>'' THEN ' mapped to MITRE techniques ('||replace(techs,',',', ')||')' ELSE '' END||' with ML risk assessment '||lvl||' (score: '||score||'). Threat intel reported '||bad
 ||' malicious indicator(s). Analysis recommends immediate analyst verification and proposes '||CASE WHEN is_ds THEN 1 ELSE 3 END||' inert containment actions.' AS summary FROM ctx""")
def _(ws):
    return ws.investigations.select("investigation_id", "summary")


# --- L ----------------------------------------------------------------------------------

CASE_PRIORITY = "CASE WHEN severity>=12 THEN 'critical' WHEN severity>=8 THEN 'high' WHEN severity>=4 THEN 'medium' ELSE 'low' END"


@query("l01_seed_cases", BASE_I + f"""SELECT 'case-'||substr(sha256('case:'||iid),1,16) AS case_id, {CASE_PRIORITY} AS priority, 'open' AS status, iid AS incident_ids,
 'dataset:ds-0,api_[REDACTED] review,'||replace(ct,'auth','[REDACTED]')||CASE WHEN ent='dataset:ds-0' THEN '' ELSE ','||ent END AS tags FROM inc""")
def _(ws):
    return ws.cases.select("case_id", "priority", "status", joined("incident_ids"), joined("tags"))


CASE_LOG = """lg AS (SELECT 'case-'||(user_id%97) AS eid, ts, event_id AS seq, (['in_progress','pending','resolve','closed','in_progress','resolved','open'])[CAST(event_id%7 AS INTEGER)+1] AS req, event_id%14=2 AS has FROM events),
nb AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY ts, seq) AS r FROM lg),
wk(eid, r, seq, req, old, nw, res, verdict) AS (
  SELECT eid, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', 'open', 'open', FALSE, '' FROM nb GROUP BY eid
  UNION ALL SELECT n.eid, n.r, n.seq, n.req, w.nw,
    CASE WHEN n.req='resolve' THEN CASE WHEN n.has AND w.nw IN ('in_progress','pending') THEN 'resolved' ELSE w.nw END
      WHEN (w.nw='open' AND n.req='in_progress') OR (w.nw='in_progress' AND n.req IN ('pending','resolved','open')) OR (w.nw='pending' AND n.req IN ('in_progress','resolved'))
        OR (w.nw='resolved' AND (n.req='in_progress' OR (n.req='closed' AND w.res))) OR (w.nw='closed' AND n.req='in_progress') THEN n.req ELSE w.nw END,
    w.res OR (n.req='resolve' AND n.has AND w.nw IN ('in_progress','pending')),
    CASE WHEN n.req='resolve' THEN CASE WHEN n.has AND w.nw IN ('in_progress','pending') THEN 'accepted' ELSE 'rejected' END WHEN n.req=w.nw THEN 'unchanged'
      WHEN (w.nw='open' AND n.req='in_progress') OR (w.nw='in_progress' AND n.req IN ('pending','resolved','open')) OR (w.nw='pending' AND n.req IN ('in_progress','resolved'))
        OR (w.nw='resolved' AND (n.req='in_progress' OR (n.req='closed' AND w.res))) OR (w.nw='closed' AND n.req='in_progress') THEN 'accepted' ELSE 'rejected' END
  FROM wk w JOIN nb n ON n.eid=w.eid AND n.r=w.r+1)"""


@query("l02_validate_case_transitions", f"WITH RECURSIVE {CASE_LOG} SELECT eid AS entity_id, seq, req AS requested_status, old AS old_status, nw AS new_status, verdict FROM wk WHERE r>0")
def _(ws):
    return L.validate_case_transitions(ws.case_changes()).drop("ts")


RESP_LOG = """lg AS (SELECT 'resp-'||CAST(floor(event_id/3) AS BIGINT) AS eid, ts, event_id AS seq, (['approved','executed','failed','rejected'])[CAST(event_id*7%11%4 AS INTEGER)+1] AS req FROM events),
nb AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY ts, seq) AS r FROM lg),
wk(eid, r, seq, req, old, nw, verdict) AS (
  SELECT eid, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', 'proposed', 'proposed', '' FROM nb GROUP BY eid
  UNION ALL SELECT n.eid, n.r, n.seq, n.req, w.nw,
   CASE WHEN (w.nw='proposed' AND n.req IN ('approved','rejected')) OR (w.nw='approved' AND n.req IN ('executed','failed')) THEN n.req ELSE w.nw END,
   CASE WHEN (w.nw='proposed' AND n.req IN ('approved','rejected')) OR (w.nw='approved' AND n.req IN ('executed','failed')) THEN 'accepted' ELSE 'rejected' END
  FROM wk w JOIN nb n ON n.eid=w.eid AND n.r=w.r+1)"""


@query("l03_validate_response_transitions", f"WITH RECURSIVE {RESP_LOG} SELECT eid AS entity_id, seq, req AS requested_status, old AS old_status, nw AS new_status, verdict FROM wk WHERE r>0")
def _(ws):
    return L.validate_response_transitions(ws.response_changes()).drop("ts")


@query("l04_current_state", f"WITH RECURSIVE {CASE_LOG} SELECT eid AS entity_id, arg_max(nw, r) AS status, (SELECT coalesce(arg_max('analyst-'||(event_id%3), (ts, event_id)), '-') FROM events WHERE event_id%5=0 AND 'case-'||(user_id%97)=eid) AS assignee FROM wk GROUP BY eid")
def _(ws):
    state = L.current_state(ws.case_changes())
    return state.select("entity_id", "status", F.coalesce("assignee", F.lit("-")).alias("assignee"))


@query("l04_resolutions", f"""WITH RECURSIVE {CASE_LOG} SELECT wk.eid AS entity_id, 'done' AS summary, 'analyst-'||(arg_max(seq, r)%4) AS resolved_by,
  strftime(arg_max(ts, r), '%Y-%m-%d %H:%M:%S.%f') AS resolved_at FROM wk JOIN events ON seq=event_id WHERE req='resolve' AND verdict='accepted' GROUP BY wk.eid""")
def _(ws):
    changes = ws.case_changes()
    found = L.resolutions(changes, L.validate_case_transitions(changes)).select("entity_id", "resolution.*")
    return found.withColumn("resolved_at", F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("l05_link_evidence", f"""SELECT 'evref-'||substr(sha256(c||':'||k||':'||f),1,16) AS evidence_id, c AS case_id, k AS evidence_type, f AS reference_key, 'linked with [REDACTED]' AS description, arg_min('analyst-'||(event_id%4), (ts, 'analyst-'||(event_id%4))) AS added_by
FROM (SELECT *, 'case-'||(user_id%97) AS c, (['event','alert','incident','investigation'])[CAST(event_id%4 AS INTEGER)+1] AS k, 'ref-'||(event_id%40) AS f FROM events) GROUP BY c, k, f""")
def _(ws):
    return L.link_evidence(ws.evidence_links()).drop("added_at")


NOTE_TEXT = _redact_sql("text", fv.CASE_KEYWORDS, False, True)


@query("l06_case_notes", f"""WITH n AS (SELECT 'case-'||(conv_id%97) AS case_id, 'note-'||conv_id||'-'||turn AS note_id, conv_id*60+turn AS tick, {NOTE_TEXT} AS content FROM conversations),
 k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY tick, note_id) AS position FROM n WHERE content<>'') SELECT case_id, note_id, position, md5(content) AS content FROM k""")
def _(ws):
    return L.case_notes(ws.case_notes()).select("case_id", "note_id", "position", F.md5("content").alias("content"))


@query("l07_case_timeline", f"""SELECT 'case-'||(user_id%97) AS case_id, {us_stamp('epoch_us(ts)')} AS "timestamp", CASE event_id%10 WHEN 0 THEN 'Case created with priority high' WHEN 1 THEN 'Status changed from open to in_progress'
 WHEN 2 THEN 'Case assigned to analyst-'||(event_id%3) WHEN 3 THEN 'Case resolved: all good' WHEN 4 THEN 'Case closed' WHEN 5 THEN 'Analyst note added by analyst-'||(event_id%4) WHEN 6 THEN 'Evidence linked: alert (ref-'||(event_id%40)||')'
 WHEN 7 THEN 'Incident inc-'||(event_id%9)||' linked' WHEN 8 THEN 'AI Investigation None linked' ELSE 'Action ''case.updated'' performed by analyst-'||(event_id%4) END AS description FROM events""")
def _(ws):
    return L.case_timeline(ws.audit()).select("case_id", stamp("timestamp"), "description")


@query("l08_propose_responses", BASE_I + """SELECT 'resp-'||substr(sha256('response:'||iid||':'||a),1,16) AS action_id, iid AS incident_id, a AS action_type,
 CASE WHEN a='restrict_dataset_access' AND contains(ent,'dataset:ds-') THEN 'Target: dataset:'||split_part(ent,'dataset:',2) ELSE '-' END AS result
FROM inc, (VALUES ('isolate_endpoint'),('quarantine_file'),('revoke_credentials'),('restrict_dataset_access')) v(a)""")
def _(ws):
    return ws.responses.select("action_id", "incident_id", "action_type", F.coalesce("result", F.lit("-")).alias("result"))


@query("l09_case_view", f"""WITH c AS (SELECT DISTINCT 'case-'||(user_id%97) AS case_id FROM events), n AS (SELECT 'case-'||(conv_id%97) AS case_id, count(*) AS notes,
  md5(string_agg('note-'||conv_id||'-'||turn||':'||{NOTE_TEXT}, ';' ORDER BY conv_id*60+turn, 'note-'||conv_id||'-'||turn)) AS digest FROM conversations WHERE {NOTE_TEXT}<>'' GROUP BY 1),
 e AS (SELECT 'case-'||(user_id%97) AS case_id, count(DISTINCT event_id%40) FILTER (event_id%4=2) AS incidents FROM events GROUP BY 1)
SELECT c.case_id, coalesce(n.notes,0) AS notes, coalesce(n.digest,'-') AS digest, coalesce(e.incidents,0) AS incidents FROM c LEFT JOIN n USING (case_id) LEFT JOIN e USING (case_id)""")
def _(ws):
    cases = ws.case_changes().select(F.col("entity_id").alias("case_id")).distinct()
    view = L.case_view(cases, ws.case_notes(), L.link_evidence(ws.evidence_links()))
    return view.select(
        "case_id", F.coalesce("note_count", F.lit(0)).alias("notes"),
        F.coalesce(F.md5(F.array_join(F.transform("notes", lambda n: F.concat(n["note_id"], F.lit(":"), n["content"])), ";")), F.lit("-")).alias("digest"),
        F.coalesce(F.try_element_at("evidence_counts", F.lit("incident")), F.lit(0)).alias("incidents"),
    )


# --- K ----------------------------------------------------------------------------------


@query("k01_recent_events", with_(EV) + "SELECT event_id FROM ev ORDER BY us DESC, event_id LIMIT 100")
def _(ws):
    return K.recent(ws.events, "timestamp", 100, tie="event_id").select("event_id")


@query("k01_recent_alerts_since", with_(EV, AL) + "SELECT alert_id FROM al WHERE tm>=TIMESTAMP '2024-01-20' ORDER BY us DESC, alert_id LIMIT 200")
def _(ws):
    since = F.lit("2024-01-20").cast("timestamp")
    return K.recent(ws.live_alerts, "timestamp", 200, since, "alert_id").select("alert_id")


@query("k02_list_correlations", with_(EV, AL, CO) + "SELECT cid AS correlation_id FROM co WHERE cid IN (SELECT cid FROM mb WHERE alert_id=(SELECT min(alert_id) FROM mb)) ORDER BY last_us DESC, cid")
def _(ws):
    first = ws.members.agg(F.min("alert_id")).first()[0]
    return K.list_correlations(ws.correlations, ws.members, status="open", alert_id=first).select("correlation_id")


@query("k03_list_incidents", BASE_I + "SELECT iid AS incident_id, CAST(severity AS INTEGER) AS severity FROM inc WHERE severity>=12 ORDER BY last_us DESC, iid")
def _(ws):
    return K.list_incidents(ws.incidents, status="open", min_severity=12).select("incident_id", "severity")


@query("k04_latest_per_incident", BASE_R + "SELECT iid AS incident_id, score AS risk_score FROM rl")
def _(ws):
    older = ws.risks.withColumn("scored_at", F.col("scored_at") - F.expr("INTERVAL 1 DAY")).withColumn("risk_score", F.lit(-1))
    return K.latest_per(ws.risks.unionByName(older), "incident_id", "scored_at", "assessment_id").select("incident_id", "risk_score")


@query("k05_list_cases", BASE_I + "SELECT 'case-'||substr(sha256('case:'||iid),1,16) AS case_id FROM inc WHERE severity>=12 ORDER BY last_us DESC, case_id")
def _(ws):
    return K.list_cases(ws.cases, status="open", priority="critical").select("case_id")


@query("k06_list_activities", with_(ACT) + "SELECT aid AS activity_id FROM act WHERE ds='ds-1' AND actor='user-4' ORDER BY us DESC, aid")
def _(ws):
    return K.list_activities(ws.activities, "ds-1", "user-4").select("activity_id")


@query("k07_list_responses", BASE_I + "SELECT 'resp-'||substr(sha256('response:'||iid||':'||a),1,16) AS action_id FROM inc, (VALUES ('isolate_endpoint'),('quarantine_file'),('revoke_credentials'),('restrict_dataset_access')) v(a) ORDER BY last_us DESC, action_id")
def _(ws):
    return K.list_responses(ws.responses).select("action_id")


@query("k08_audit_trail", f"SELECT 'audit-'||substr(sha256(CAST(event_id AS VARCHAR)),1,16) AS audit_id, {us_stamp('epoch_us(ts)')} AS \"timestamp\" FROM events WHERE user_id%97=5")
def _(ws):
    return K.audit_trail(ws.audit(), "case-5").select("audit_id", stamp("timestamp"))


DS_OF = "CASE WHEN contains({0},'dataset:') THEN split_part({0},'dataset:',2) END"


@query("k09_dataset_overview", with_(EV, AL, CO, IN, RK, IO, FEED, II, ACT) + f""", ik AS (SELECT iid, {DS_OF.format('ent')} AS ds, score, ct FROM rl WHERE contains(ent,'dataset:'))
SELECT d.ds AS dataset_id, (SELECT count(*) FROM act WHERE act.ds=d.ds) AS activities, (SELECT count(*) FROM al WHERE al.ds=d.ds) AS alerts, (SELECT count(*) FROM ik WHERE ik.ds=d.ds) AS correlations,
 (SELECT count(*) FROM ik WHERE ik.ds=d.ds) AS incidents, (SELECT count(*) FROM ik WHERE ik.ds=d.ds) AS risk_assessments, (SELECT coalesce(max(score),0) FROM ik WHERE ik.ds=d.ds) AS max_risk_score,
 (SELECT count(*) FROM enc JOIN ik USING (iid) WHERE ik.ds=d.ds) AS indicators, (SELECT count(*) FROM enc JOIN ik USING (iid) WHERE ik.ds=d.ds AND cls='malicious') AS malicious_indicators,
 4*(SELECT count(*) FROM ik WHERE ik.ds=d.ds) AS responses, CASE WHEN d.ds='ds-0' THEN (SELECT count(*) FROM inc) ELSE (SELECT count(*) FROM ik WHERE ik.ds=d.ds) END AS cases
FROM (SELECT DISTINCT ds FROM act) d""")
def _(ws):
    catalog = ws.activities.select("dataset_id").distinct()
    return K.dataset_overview(
        catalog, ws.activities, ws.alerts, ws.correlations, ws.incidents, ws.risks, ws.enrichments, ws.cases, ws.responses
    )


@query("k10_incident_workspace", BASE_V + """SELECT iid AS incident_id, score AS risk_score, lvl AS risk_level, total AS total_indicators, 'inv-'||substr(sha256('inv:'||iid),1,16) AS investigation_id,
 'case-'||substr(sha256('case:'||iid),1,16) AS case_id, 4 AS responses FROM ctx""")
def _(ws):
    view = K.incident_workspace(ws.incidents, ws.risks, ws.intel_summary, ws.investigations, ws.cases, ws.responses)
    return view.select("incident_id", "risk_score", "risk_level", F.coalesce("total_indicators", F.lit(0)).alias("total_indicators"), "investigation_id", "case_id", "responses")


@query("k11_pipeline_result", BASE_ALL + """, per AS (SELECT oc.event_id, count(*) FILTER (outcome='created') AS c, count(*) FILTER (outcome='updated') AS u, sum(coalesce(total,0))::BIGINT AS i, arg_max(score, rl.iid) AS s
  FROM oc JOIN rl ON rl.cid=oc.cid LEFT JOIN ts ON ts.iid=rl.iid GROUP BY 1)
SELECT ev.event_id, (SELECT count(*) FROM al WHERE al.event_id=ev.event_id) AS detection_matches, coalesce(per.c,0) AS correlations_created, coalesce(per.u,0) AS correlations_updated, coalesce(per.i,0) AS iocs_extracted, coalesce(per.s,-1) AS last_risk_score
FROM ev LEFT JOIN per ON per.event_id=ev.event_id""")
def _(ws):
    ids = ws.incidents.select(F.get("correlation_ids", 0).alias("correlation_id"), "incident_id")
    out = K.pipeline_result(ws.events, ws.alerts, ws.outcomes, ws.enrichments, ws.risks, ids)
    return out.select(
        "event_id", "detection_matches", "correlations_created", "correlations_updated", "iocs_extracted",
        F.coalesce("last_risk_score", F.lit(-1)).alias("last_risk_score"),
    )


# --- G ----------------------------------------------------------------------------------

ZERO = "(VALUES ('critical'),('high'),('medium'),('low')) l(level)"


@query("g01_activity_trend_12", BASE_I + """, mk AS (SELECT 'a' AS k, us AS t FROM al UNION ALL SELECT 'i', last_us FROM inc UNION ALL SELECT 'c', first_us FROM co),
 pe AS (SELECT min(t) AS lo, greatest(max(t)-min(t), 3600000000)/12 AS width FROM mk),
 bk AS (SELECT k, CAST(greatest(0, least(11, ceil((t-lo)/width)-1)) AS INTEGER) AS b FROM mk, pe)
SELECT CAST(s.b AS INTEGER) AS bucket, strftime(make_timestamp(CAST(floor(lo+s.b*width) AS BIGINT)), '%H:00') AS "time", count(*) FILTER (k='a') AS alerts, count(*) FILTER (k='i') AS incidents, count(*) FILTER (k='c') AS correlations
FROM range(12) s(b) CROSS JOIN pe LEFT JOIN bk ON bk.b=s.b GROUP BY ALL""")
def _(ws):
    return G.activity_trend_12(
        ws.alerts.select("timestamp"), ws.incidents.select(F.col("created_at").alias("timestamp")),
        ws.correlations.select(F.col("first_seen").alias("timestamp")),
    )


@query("g02_top_mitre", BASE_I + """, t AS (SELECT mitre AS m FROM al WHERE mitre<>'' UNION ALL SELECT unnest(string_split(techs, ',')) FROM inc WHERE techs<>''), c AS (SELECT m AS technique, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, technique LIMIT 6)
SELECT technique, n, CAST(floor(n/(SELECT max(n) FROM c)*100+0.5) AS INTEGER) AS percent FROM c""")
def _(ws):
    return G.top_mitre(ws.incidents, ws.alerts)


@query("g03_severity_distribution", with_(EV, AL) + f"SELECT level, count(al.alert_id) AS n FROM {ZERO} LEFT JOIN al ON level=CASE WHEN severity>=12 THEN 'critical' WHEN severity>=8 THEN 'high' WHEN severity>=4 THEN 'medium' ELSE 'low' END GROUP BY 1")
def _(ws):
    return G.severity_distribution(ws.live_alerts)


@query("g04_risk_curve", BASE_R + """, o AS (SELECT rid, score, row_number() OVER (ORDER BY last_us DESC, rid) AS position FROM rl)
SELECT position, rid AS id, score AS risk, (SELECT max(score) FROM rl) AS peak_risk, (SELECT score FROM o WHERE position=10) AS current_risk FROM o WHERE position<=10""")
def _(ws):
    return G.risk_curve(ws.risks, ws.incidents).drop("threshold")


@query("g05_risk_level_distribution", BASE_R + f"SELECT level, count(rl.rid) AS n FROM {ZERO} LEFT JOIN rl ON lvl=level GROUP BY 1")
def _(ws):
    return G.risk_level_distribution(ws.risks)


@query("g06_operation_counts", with_(ACT) + "SELECT op AS operation, count(*) AS n FROM act GROUP BY 1")
def _(ws):
    return G.operation_counts(ws.activities)


@query("g07_sensitive_share", "WITH " + PROFILE + "," + SHAPE + """, s AS (SELECT did, cc, CASE WHEN sens='' THEN 0 ELSE len(string_split(sens,',')) END AS n FROM ca)
SELECT did AS dataset_id, n AS sensitive, cc-n AS other, CAST(floor(n/cc*100+0.5) AS INTEGER) AS sensitive_percent, CAST(floor((cc-n)/cc*100+0.5) AS INTEGER) AS other_percent FROM s""")
def _(ws):
    return G.sensitive_share(ws.catalog)


@query("g08_finding_counts", FULL + "SELECT did AS dataset_id, count(*) FILTER (sev IN ('CRITICAL','HIGH')) AS high, count(*) FILTER (sev='MEDIUM') AS medium, count(*) FILTER (sev='LOW') AS low FROM fg GROUP BY 1")
def _(ws):
    return G.finding_counts(Q.finding_rows(ws.assessments))


@query("g09_activity_volume_tail", with_(ACT) + "SELECT aid AS activity_id, CASE WHEN acc=0 THEN 1 ELSE acc END AS volume FROM act ORDER BY us DESC, aid DESC LIMIT 15")
def _(ws):
    return G.activity_volume_tail(ws.activities).select("activity_id", "volume")


@query("g10_investigation_queue", BASE_I + "SELECT 'case-'||substr(sha256('case:'||iid),1,16) AS case_id, 'Unassigned' AS assignee, CAST(least(100, floor(severity/15*100+0.5)) AS INTEGER) AS severity_percent, iid AS incident_id FROM inc ORDER BY last_us DESC, case_id LIMIT 4")
def _(ws):
    return G.investigation_queue(ws.cases).select("case_id", "assignee", "severity_percent", "incident_id")


@query("g11_load_duration", """WITH t AS (SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS load FROM orders GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS period, row_number() OVER (ORDER BY load DESC, d) AS position, load>=0.8*(SELECT max(load) FROM t) AS is_peak, (SELECT count(*) FROM t WHERE load>=0.8*(SELECT max(load) FROM t)) AS peak_periods FROM t""")
def _(ws):
    df = ws.table("orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    return G.load_duration(df, F.date_format("ts", "yyyy-MM-dd")).drop("load")


@query("g12_peak_hour_stats", "WITH h AS (SELECT hour(ts) AS h, sum(value) AS v FROM events GROUP BY 1) SELECT CAST(arg_max(h, v) AS INTEGER) AS peak_hour, round(max(v), 2) AS peak, round(avg(v), 2) AS average, round(min(v), 2) AS lowest FROM h")
def _(ws):
    s = G.peak_hour_stats(ws.measurements())
    return s.select("peak_hour", *[F.round(c, 2).alias(c) for c in ("peak", "average", "lowest")])


@query("g13_hour_weekday_heatmap", """WITH c AS (SELECT CAST(isodow(ts)-1 AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, sum(value) AS v FROM events GROUP BY 1,2),
 f AS (SELECT CAST(g//24 AS INTEGER) AS "day", CAST(g%24 AS INTEGER) AS "hour", coalesce(v,0) AS v FROM range(168) r(g) LEFT JOIN c ON d=g//24 AND h=g%24)
SELECT "day", "hour", round(v,2) AS "value", round((v-(SELECT min(v) FROM f))/((SELECT max(v) FROM f)-(SELECT min(v) FROM f)), 4) AS intensity, round((SELECT sum(v) FROM f WHERE "day"<5)/120, 2) AS weekday_avg,
 round((SELECT sum(v) FROM f WHERE "day">=5)/48, 2) AS weekend_avg, round((SELECT avg(v) FROM f WHERE "hour" BETWEEN 9 AND 17), 2) AS working_hours_avg FROM f""")
def _(ws):
    m = G.hour_weekday_heatmap(ws.measurements())
    return m.select("day", "hour", F.round("value", 2).alias("value"), F.round("intensity", 4).alias("intensity"),
                    *[F.round(c, 2).alias(c) for c in ("weekday_avg", "weekend_avg", "working_hours_avg")])


@query("g14_share_of_total", "SELECT event_type AS key, round(sum(value)/(SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY 1")
def _(ws):
    return G.share_of_total(ws.measurements()).select("key", F.round("share", 6).alias("share"))


@query("g15_peak_summary", "SELECT round(avg(value), 4) AS avg_peak, max(value) AS max_peak, count(*) FILTER (value>100) AS high_severity FROM events")
def _(ws):
    df = ws.measurements().withColumn("severity", F.when(F.col("value") > 100, "high").otherwise("medium"))
    return G.peak_summary(df).withColumn("avg_peak", F.round("avg_peak", 4))


@query("g15_series_summary", "SELECT round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 4) AS average, max(l_quantity) AS maximum FROM lineitem")
def _(ws):
    s = G.series_summary(ws.table("lineitem").select(F.col("l_quantity").alias("value")))
    return s.select(F.round("total", 2).alias("total"), F.round("average", 4).alias("average"), "maximum")


# --- X: the streaming functions applied to whole tables (they take both kinds of frames) ---


@query("x02_stream_detect", with_(EV, AL) + "SELECT alert_id, host FROM al")
def _(ws):
    return X.stream_detect(ws.events).select("alert_id", "host")


@query("x06_stream_windows", with_(EV, AL) + f"SELECT {us_stamp('us-us%900000000')} AS start, rule_id, host AS entity, count(*) AS n FROM al GROUP BY ALL")
def _(ws):
    return X.stream_windows(ws.live_alerts, 900).select(stamp("start"), "rule_id", "entity", "n")


@query("x06_stream_sessions", with_(EV, AL) + f"""SELECT {us_stamp('min(us)')} AS start, rule_id, usr AS entity, count(*) AS n FROM (
 SELECT *, sum(CASE WHEN g IS NULL OR g>=900000000 THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id, usr ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, us-lag(us) OVER (PARTITION BY rule_id, usr ORDER BY us, event_id) AS g FROM al)) GROUP BY rule_id, usr, s""")
def _(ws):
    return X.stream_sessions(ws.live_alerts, 900).select(stamp("start"), "rule_id", "entity", "n")
