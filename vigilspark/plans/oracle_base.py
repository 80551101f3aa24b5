"""Common table expressions for the DuckDB side of the comparison.

Written as plain pairwise SQL: an independent definition of what the operators compute.
"""

EV = """
ev AS (
  SELECT event_id AS n, user_id AS u, 'evt-'||event_id AS event_id, ts AS tm, epoch_us(ts) AS us,
    CASE WHEN event_type='purchase' THEN 'dataset_activity' ELSE 'app' END AS source,
    CASE event_type WHEN 'error' THEN 'authentication_failure' WHEN 'click' THEN 'process_start'
      WHEN 'view' THEN 'network_connection' WHEN 'signup' THEN 'privilege_escalation'
      ELSE CASE event_id%5 WHEN 0 THEN 'dataset_exported' WHEN 1 THEN 'sensitive_column_access'
        WHEN 2 THEN 'dataset_bulk_access' WHEN 3 THEN 'dataset_modified' ELSE 'dataset_schema_changed' END
      END AS event_type,
    CAST(least(15, floor(value/10)) AS INTEGER) AS severity,
    CASE WHEN event_type='click' AND event_id%2=0 THEN 'powershell -enc run'
      WHEN event_type='click' THEN 'start process' ELSE 'activity' END AS message,
    'host-'||(user_id%5) AS host, 'user-'||(user_id%20) AS usr,
    CASE WHEN user_id%7=0 THEN '203.0.113.50' ELSE '10.0.0.'||(user_id%250) END AS source_ip,
    CASE WHEN event_type='view' OR (event_type='purchase' AND event_id%5=0)
      THEN CASE WHEN event_id%3=0 THEN '198.51.100.99' ELSE '192.0.2.1' END END AS destination_ip,
    CASE WHEN event_type='purchase' THEN 200*CAST(regexp_extract(props,'[0-9]+') AS BIGINT) END AS records,
    CASE WHEN event_type='purchase' THEN 'ds-'||(user_id%3) END AS ds,
    CASE WHEN event_type='purchase' THEN 'table '||(user_id%3) END AS ds_name,
    CASE WHEN event_type='purchase' THEN CASE WHEN user_id%3=0 THEN 'HIGH' ELSE 'LOW' END END AS ds_level,
    CASE WHEN event_type='purchase' AND event_id%5=1 THEN '["account_number","email"]' END AS cols,
    CASE event_id%11 WHEN 0 THEN 'evil.synthetic.example' WHEN 1 THEN 'Safe.Synthetic.Example.'
      WHEN 2 THEN 'not a domain' END AS dom,
    CASE event_id%13 WHEN 0 THEN 'https://malware.synthetic.example/x?id='||(event_id%50)
      WHEN 1 THEN 'https://www.example.org/'||(event_id%50) END AS url,
    CASE event_id%17 WHEN 0 THEN sha256(CAST(event_id AS VARCHAR)) WHEN 1 THEN repeat('a',64)
      WHEN 2 THEN repeat('f',32) END AS fhash,
    CASE event_id%19 WHEN 0 THEN 'api_key.example.org' WHEN 1 THEN 'srv.example.net' END AS hostname
  FROM events)"""

RULES = {
    "builtin-001": "severity >= 10",
    "builtin-002": "event_type='process_start' AND (contains(lower(message),'/tmp/') OR contains(lower(message),'\\temp\\') "
                   "OR contains(lower(message),'powershell -enc') OR contains(lower(message),'cmd.exe /c') OR "
                   "contains(lower(message),'cmd /c') OR contains(lower(message),'/dev/shm/'))",
    "builtin-003": "event_type IN ('authentication_failure','login_failure')",
    "builtin-004": "event_type='network_connection' AND coalesce(destination_ip,'')<>''",
    "builtin-005": "event_type IN ('privilege_escalation','runas','sudo') OR contains(lower(message),'privilege')",
    "dataset-001": "source='dataset_activity' AND (event_type IN ('dataset_bulk_access','bulk_access') OR records>=10000)",
    "dataset-002": "source='dataset_activity' AND (cols IS NOT NULL OR event_type='sensitive_column_access')",
    "dataset-003": "source='dataset_activity' AND (event_type IN ('dataset_exported','dataset_export') OR coalesce(destination_ip,'')<>'')",
    "dataset-004": "source='dataset_activity' AND NOT (source_ip LIKE '10.%' OR source_ip LIKE '192.168.%' OR source_ip LIKE '172.%' OR source_ip LIKE '127.%')",
    "dataset-005": "source='dataset_activity' AND event_type IN ('dataset_modified','dataset_deleted') AND records>=5000",
    "dataset-006": "source='dataset_activity' AND event_type IN ('dataset_schema_changed','schema_changed')",
}
SEVERITY = {
    "builtin-001": "severity", "builtin-002": "10", "builtin-003": "6", "builtin-004": "6", "builtin-005": "12",
    "dataset-001": "8", "dataset-002": "9", "dataset-003": "10", "dataset-004": "7", "dataset-005": "11", "dataset-006": "8",
}
MITRE = {
    "builtin-001": "", "builtin-002": "T1059", "builtin-003": "T1110", "builtin-004": "T1071", "builtin-005": "T1548",
    "dataset-001": "T1530", "dataset-002": "T1530", "dataset-003": "T1567", "dataset-004": "", "dataset-005": "T1485",
    "dataset-006": "T1098",
}
NAMES = {
    "builtin-001": "High Severity Event", "builtin-002": "Suspicious Process Execution",
    "builtin-003": "Authentication Failure", "builtin-004": "Network Connection Anomaly",
    "builtin-005": "Privilege Escalation Indicator", "dataset-001": "Bulk Sensitive Dataset Access",
    "dataset-002": "Sensitive Column Access", "dataset-003": "Suspicious Dataset Export",
    "dataset-004": "Unusual or New Dataset Actor", "dataset-005": "Mass Dataset Modification",
    "dataset-006": "Unexpected Dataset Schema Change",
}
AL = "al AS (\n" + "\n  UNION ALL ".join(
    f"SELECT 'alert-'||substr(sha256(event_id||':{r}'),1,16) AS alert_id, event_id, n, u, tm, us, source, host, usr, "
    f"source_ip, destination_ip, '{r}' AS rule_id, '{NAMES[r]}' AS rule_name, {i} AS rule_order, {SEVERITY[r]} AS severity, "
    f"'{MITRE[r]}' AS mitre, {'ds' if r.startswith('dataset') else 'NULL'} AS ds, "
    f"{'ds_name' if r.startswith('dataset') and r != 'dataset-004' else 'NULL'} AS ds_name FROM ev WHERE {c}"
    for i, (r, c) in enumerate(RULES.items())
) + ")"

CO = """
rn AS (SELECT DISTINCT rule_id AS r FROM (VALUES ('builtin-001'),('builtin-002'),('builtin-003'),('builtin-004'),
  ('builtin-005'),('dataset-001'),('dataset-002'),('dataset-003'),('dataset-004'),('dataset-005'),('dataset-006')) v(rule_id)),
pr AS (
  SELECT * FROM (VALUES
    ('auth_attack_sequence','builtin-003','builtin-003'),
    ('process_network_sequence','builtin-002','builtin-004'), ('process_network_sequence','builtin-004','builtin-002'),
    ('privilege_escalation_sequence','builtin-005','builtin-002'), ('privilege_escalation_sequence','builtin-005','builtin-003'),
    ('privilege_escalation_sequence','builtin-002','builtin-005'), ('privilege_escalation_sequence','builtin-003','builtin-005'),
    ('data_exfiltration_sequence','dataset-003','dataset-001'), ('data_exfiltration_sequence','dataset-003','dataset-002'),
    ('access_anomaly_sequence','dataset-001','dataset-004'), ('access_anomaly_sequence','dataset-002','dataset-004'),
    ('mass_modification_sequence','dataset-006','dataset-005')) v(ct, trig, part)
  UNION ALL SELECT 'same_entity', a.r, b.r FROM rn a, rn b WHERE a.r<>b.r
    AND (a.r,b.r) NOT IN (('builtin-002','builtin-004'),('builtin-004','builtin-002'),('builtin-005','builtin-002'),
      ('builtin-002','builtin-005'),('builtin-005','builtin-003'),('builtin-003','builtin-005'))),
ct AS (SELECT ct, cr, CAST(w AS BIGINT) AS w FROM (VALUES ('auth_attack_sequence','corr-rule-001',900),('process_network_sequence','corr-rule-002',1800),
  ('privilege_escalation_sequence','corr-rule-003',1800),('same_entity','corr-rule-004',1800),
  ('data_exfiltration_sequence','corr-dset-001',1800),('access_anomaly_sequence','corr-dset-002',900),
  ('mass_modification_sequence','corr-dset-003',3600)) v(ct, cr, w)),
pa AS (
  SELECT al.*, ct.ct, ct.cr, ct.w,
    CASE ct.ct WHEN 'auth_attack_sequence' THEN 'user:'||usr WHEN 'process_network_sequence' THEN 'host:'||host
      WHEN 'privilege_escalation_sequence' THEN 'user:'||usr WHEN 'same_entity' THEN 'host:'||host
      WHEN 'mass_modification_sequence' THEN 'dataset:'||ds ELSE 'user:'||usr||':dataset:'||ds END AS ent
  FROM al, ct WHERE EXISTS (SELECT 1 FROM pr WHERE pr.ct=ct.ct AND (pr.trig=al.rule_id OR pr.part=al.rule_id))),
pp AS (
  SELECT a.ct, a.ent, a.alert_id AS a, h.alert_id AS h, h.event_id AS he, h.us AS hus, h.severity AS hsev, h.rule_id AS hrule,
    h.mitre AS hmitre
  FROM pa a JOIN pr ON pr.ct=a.ct AND pr.trig=a.rule_id
  JOIN pa h ON h.ct=a.ct AND h.ent=a.ent AND h.rule_id=pr.part AND h.alert_id<>a.alert_id
    AND h.us>=a.us-a.w*1000000 AND (h.us<a.us OR (h.us=a.us AND h.event_id<=a.event_id))),
ag AS (
  SELECT ct, a, count(*) AS partners, max(hsev) AS hs, min(h) AS minh, min(hus) AS minus,
    list(DISTINCT hrule) AS hr, list(DISTINCT hmitre) AS hm
  FROM pp GROUP BY ct, a),
mt AS (
  SELECT p.*, g.partners, g.partners+1 AS cnt, least(g.minh, p.alert_id) AS founder, least(g.minus, p.us) AS first_us,
    list_sort(list_distinct(list_append(g.hr, p.rule_id))) AS rules,
    list_sort(list_filter(list_distinct(list_concat(list_append(g.hm, p.mitre),
      CASE WHEN p.ct='privilege_escalation_sequence' THEN ['T1548'] ELSE [] END)), lambda x: x<>'')) AS mit,
    CAST(CASE p.ct WHEN 'auth_attack_sequence' THEN least(15, 8+(g.partners-1)*2) WHEN 'process_network_sequence' THEN 12
      WHEN 'privilege_escalation_sequence' THEN 14 WHEN 'same_entity' THEN greatest(p.severity, g.hs)
      WHEN 'data_exfiltration_sequence' THEN least(15, 12+g.partners-1) WHEN 'access_anomaly_sequence' THEN 11 ELSE 12 END AS INTEGER) AS msev,
    row_number() OVER (PARTITION BY p.ct, p.ent ORDER BY p.us, p.event_id, p.rule_order) AS ord
  FROM pa p JOIN ag g ON g.ct=p.ct AND g.a=p.alert_id),
mx AS (
  SELECT mt.*,
    CASE ct WHEN 'auth_attack_sequence' THEN 'Authentication Attack Sequence against '||ent
      WHEN 'process_network_sequence' THEN 'Suspicious Process and Network Connection on '||ent
      WHEN 'privilege_escalation_sequence' THEN 'Privilege Escalation Sequence on '||ent
      WHEN 'same_entity' THEN 'Multiple Security Alerts on '||ent
      WHEN 'data_exfiltration_sequence' THEN 'Data Exfiltration Sequence: '||ent
      WHEN 'access_anomaly_sequence' THEN 'Access Anomaly Sequence: '||ent
      ELSE 'Mass Modification Sequence: '||ds_name END AS title,
    CASE ct WHEN 'auth_attack_sequence' THEN 'Multiple authentication failure alerts ('||cnt||') observed for '||ent||' within 15 minutes.'
      WHEN 'process_network_sequence' THEN 'Suspicious process execution followed by network connection observed on '||ent||' within 30 minutes.'
      WHEN 'privilege_escalation_sequence' THEN 'Privilege escalation activity correlated with suspicious process or authentication event on '||ent||' within 30 minutes.'
      WHEN 'same_entity' THEN 'Multiple distinct security alerts ('||cnt||') observed on '||ent||' within 30 minutes.'
      WHEN 'data_exfiltration_sequence' THEN 'Dataset access sequence detected for '||ent||': '||partners||' access alert(s) followed by export of '''||ds_name||''' within 30 minutes.'
      WHEN 'access_anomaly_sequence' THEN 'Unusual actor '||ent||' performed sensitive or bulk dataset access within 15 minutes of anomalous actor detection.'
      ELSE 'Dataset '''||ds_name||''' experienced mass record modification followed by schema change within 60 minutes.' END AS descr,
    array_to_string(CASE ct WHEN 'auth_attack_sequence' THEN ['T1110'] WHEN 'process_network_sequence' THEN ['T1059','T1071']
      WHEN 'data_exfiltration_sequence' THEN ['T1530','T1567'] WHEN 'access_anomaly_sequence' THEN ['T1530']
      WHEN 'mass_modification_sequence' THEN ['T1485'] ELSE mit END, ',') AS techs
  FROM mt),
e1 AS (SELECT *, us-lag(us) OVER (PARTITION BY ct, ent ORDER BY ord) AS gap FROM mx),
e2 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap>w*1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY ct, ent ORDER BY ord ROWS UNBOUNDED PRECEDING) AS ep FROM e1),
ma AS (
  SELECT e.ct, e.ent, e.ep, e.ord, e.alert_id AS m, e.event_id AS me FROM e2 e
  UNION ALL SELECT e.ct, e.ent, e.ep, e.ord, p.h, p.he FROM e2 e JOIN pp p ON p.ct=e.ct AND p.a=e.alert_id),
fo AS (SELECT ct, ent, ep, m, me, min(ord) AS ord FROM ma GROUP BY ALL),
gr AS (SELECT DISTINCT ct, ent, ep, ord FROM fo),
hd AS (
  SELECT e.ct, e.ent, e.ep, min(e.ord) AS o1, max(CASE WHEN gr.ord IS NOT NULL THEN e.ord END) AS o2,
    max(CASE WHEN gr.ord IS NOT NULL THEN e.msev END) AS severity, max(e.us) AS last_us, count(*) AS triggers
  FROM e2 e LEFT JOIN gr USING (ct, ent, ep, ord) GROUP BY ALL),
mc AS (SELECT ct, ent, ep, count(*) AS alert_count, count(DISTINCT me) AS event_count FROM fo GROUP BY ALL),
co AS (
  SELECT 'corr-'||substr(sha256(h.ct||':'||h.ent||':'||f.founder),1,16) AS cid, f.cr, h.ct, h.ent, h.ep, f.title, l.descr,
    h.severity, f.first_us, h.last_us, c.alert_count, c.event_count, h.triggers, f.techs, f.founder, f.event_id AS fe, f.ord AS o1,
    array_to_string(l.rules, ',') AS last_rules
  FROM hd h JOIN e2 f ON f.ct=h.ct AND f.ent=h.ent AND f.ord=h.o1
  JOIN e2 l ON l.ct=h.ct AND l.ent=h.ent AND l.ord=h.o2
  JOIN mc c ON c.ct=h.ct AND c.ent=h.ent AND c.ep=h.ep),
mb AS (SELECT co.cid, co.ct, co.ent, fo.m AS alert_id, fo.me AS event_id FROM fo JOIN co USING (ct, ent, ep)),
oc AS (
  SELECT DISTINCT e.event_id, co.cid, CASE WHEN e.ord=co.o1 THEN 'created' ELSE 'updated' END AS outcome
  FROM gr JOIN e2 e USING (ct, ent, ep, ord) JOIN co ON co.ct=e.ct AND co.ent=e.ent AND co.ep=e.ep)"""


def iso(us: str) -> str:
    """ISO text of epoch microseconds, fraction only when there is one."""
    return (
        f"(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S')||CASE WHEN {us}%1000000=0 THEN '' ELSE "
        f"'.'||lpad(CAST({us}%1000000 AS VARCHAR),6,'0') END||'+00:00')"
    )


def stamp(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S.%f')"


IN = f"""
inc AS (
  SELECT 'inc-'||substr(sha256('incident:'||cid),1,16) AS iid, co.*, 'Security Incident: '||title AS ititle,
    'Correlated security incident ('||ct||') affecting '||ent||'. Encompasses '||alert_count||' alert(s) observed between '
      ||{iso('first_us')}||' and '||{iso('last_us')}||'. MITRE ATT&CK techniques: '
      ||CASE WHEN techs='' THEN 'None' ELSE replace(techs, ',', ', ') END||'. Initial severity: '||severity||'/15.' AS idescr
  FROM co)"""

RK = """
rf AS (
  SELECT inc.*, lower(ct||' '||ent||' '||ititle||' '||idescr||' '||ct||' '||title) AS txt,
    len(list_distinct(string_split(techs, ','))) * CAST(techs<>'' AS INTEGER) AS mcount,
    (last_us-first_us)/1e6 AS span FROM inc),
rk0 AS (
  SELECT rf.*,
    CAST(contains(txt,'auth') OR contains(txt,'login') AS DOUBLE) AS f_auth,
    CAST(contains(txt,'process') OR contains(txt,'exec') OR contains(txt,'.sh') AS DOUBLE) AS f_proc,
    CAST(contains(txt,'network') OR contains(txt,'connection') OR contains(txt,'outbound') AS DOUBLE) AS f_net,
    CAST(contains(txt,'privilege') OR contains(txt,'escalat') OR contains(txt,'root') AS DOUBLE) AS f_priv,
    CAST(contains(txt,'dataset') OR contains(txt,'bulk_access') OR contains(txt,'sensitive_column') OR contains(txt,'exfiltrat')
      OR contains(txt,'export') OR contains(txt,'schema_change') OR contains(txt,'data_access') OR contains(txt,'data_exfil') AS DOUBLE) AS f_ds,
    CAST(contains(txt,'sensitive_data') OR contains(txt,'sensitive_column') AS DOUBLE) AS f_sens,
    CAST(contains(txt,'bulk_access') OR contains(txt,'export') OR contains(txt,'exfil') AS DOUBLE) AS f_bulk,
    CAST(contains(txt,'exfiltrat') OR contains(txt,'data_exfil') OR (contains(txt,'dataset') AND (contains(txt,'network') OR contains(txt,'export'))) AS DOUBLE) AS f_exf,
    CAST(contains(txt,'unusual') OR contains(txt,'anomaly') AS DOUBLE) AS f_nov,
    CAST(contains(txt,'bulk_access') OR contains(txt,'bulk_sensitive') AS DOUBLE) AS f_bai
  FROM rf),
rk1 AS (
  SELECT *, -8.4927 + severity*0.1914::DOUBLE + severity*0.1799::DOUBLE + alert_count*0.2331::DOUBLE + event_count*0.139::DOUBLE
    + 1*0.5197::DOUBLE + mcount*0.3145::DOUBLE + f_auth*0.6734::DOUBLE + f_proc*0.9374::DOUBLE + f_net*0.669::DOUBLE + f_priv*1.0103::DOUBLE
    + span*0.0005::DOUBLE + 2*0.3415::DOUBLE AS z FROM rk0),
rk2 AS (SELECT *, CASE WHEN z>=40 THEN 1.0 WHEN z<=-40 THEN 0.0 ELSE 1.0/(1.0+exp(-z)) END AS p FROM rk1),
rk AS (
  SELECT *, CAST(round_even(p*100, 0) AS INTEGER) AS score, 'risk-'||substr(sha256('risk:'||iid),1,16) AS rid FROM rk2),
rl AS (SELECT *, CASE WHEN score<25 THEN 'low' WHEN score<50 THEN 'medium' WHEN score<75 THEN 'high' ELSE 'critical' END AS lvl FROM rk)"""

IO = r"""
raw_ioc AS (
  SELECT event_id, 0 AS pos, 'source_ip' AS fld, 'ip' AS k, source_ip AS v FROM ev
  UNION ALL SELECT event_id, 1, 'destination_ip', 'ip', destination_ip FROM ev
  UNION ALL SELECT event_id, 2, 'metadata:domain', 'domain', dom FROM ev
  UNION ALL SELECT event_id, 2+CAST(dom IS NOT NULL AS INTEGER), 'metadata:file_hash', 'hash', fhash FROM ev
  UNION ALL SELECT event_id, 2+CAST(dom IS NOT NULL AS INTEGER)+CAST(fhash IS NOT NULL AS INTEGER), 'metadata:hostname', 'domain', hostname FROM ev WHERE NOT contains(hostname,'api_key')
  UNION ALL SELECT event_id, 2+CAST(dom IS NOT NULL AS INTEGER)+CAST(fhash IS NOT NULL AS INTEGER)+CAST(hostname IS NOT NULL AND NOT contains(hostname,'api_key') AS INTEGER), 'metadata:url', 'url', url FROM ev),
ioc AS (
  SELECT * FROM (SELECT event_id, pos, fld, v,
    CASE k WHEN 'ip' THEN 'ipv4' WHEN 'domain' THEN CASE WHEN regexp_matches(lower(rtrim(v,'.')), '^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*\.[a-z]{2,}$') THEN 'domain' END
      WHEN 'url' THEN CASE WHEN regexp_matches(v, '^https?://\S{1,1000}$') THEN 'url' END
      ELSE CASE length(v) WHEN 64 THEN 'sha256' WHEN 40 THEN 'sha1' WHEN 32 THEN 'md5' END END AS ty,
    CASE k WHEN 'domain' THEN lower(rtrim(v,'.')) WHEN 'hash' THEN upper(v) ELSE v END AS nv
    FROM raw_ioc WHERE v IS NOT NULL) WHERE ty IS NOT NULL)"""

FEED = """
fd AS (SELECT * FROM (VALUES ('ipv4','203.0.113.50','malicious','command_and_control'),('ipv4','198.51.100.99','malicious','scanning'),
  ('ipv4','203.0.113.100','malicious','data_exfiltration'),('ipv4','192.0.2.1','benign',''),('ipv4','192.0.2.10','benign',''),
  ('domain','evil.synthetic.example','malicious','command_and_control'),('domain','malware.synthetic.example','malicious','malware_distribution'),
  ('domain','phishing.synthetic.example','malicious','phishing'),('domain','safe.synthetic.example','benign',''),
  ('domain','trusted.synthetic.example','benign',''),('hash',repeat('A',64),'malicious','trojan'),('hash',repeat('B',40),'malicious','trojan'),
  ('hash',repeat('C',32),'malicious','trojan'),('hash',repeat('D',64),'benign',''),('hash',repeat('E',40),'benign',''),
  ('hash',repeat('F',32),'benign','')) v(ft, fv, cls, cat))"""

II = """
imem AS (SELECT DISTINCT 'inc-'||substr(sha256('incident:'||cid),1,16) AS iid, event_id FROM mb),
ii AS (
  SELECT iid, ty, nv, min((event_id, pos, fld, v)) AS f FROM imem JOIN ioc USING (event_id) GROUP BY ALL),
en AS (
  SELECT iid, ty, nv, f, coalesce((SELECT CASE WHEN bool_or(cls='malicious') THEN 'malicious' ELSE 'benign' END FROM fd
      WHERE CASE WHEN ty='url' THEN ft='domain' AND contains(nv, fv) WHEN ty IN ('sha256','sha1','md5') THEN ft='hash' AND fv=nv
        ELSE ft=ty AND fv=nv END HAVING count(*)>0), 'unknown') AS cls,
    'ti-'||substr(sha256('ti:'||iid||':'||nv),1,16) AS eid
  FROM ii),
enc AS (
  SELECT en.*, CASE WHEN cls<>'malicious' THEN '' WHEN ty='url' THEN 'malicious_activity'
    ELSE coalesce((SELECT max(cat) FROM fd WHERE fv=nv AND fd.cls='malicious'), 'malicious_activity') END AS cat
  FROM en),
ts AS (
  SELECT iid, count(*) AS total, count(*) FILTER (cls='malicious') AS bad, count(*) FILTER (cls='suspicious') AS odd,
    count(*) FILTER (cls='benign') AS good, count(*) FILTER (cls NOT IN ('malicious','suspicious','benign')) AS other
  FROM enc GROUP BY iid)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
