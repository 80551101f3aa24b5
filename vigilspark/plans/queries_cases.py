"""Queries C (correlation), I (incidents), R (risk), T (intel)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import correlate as C
from ..operators import evaluate as E
from ..operators import incidents as I
from ..operators import intel as T
from ..operators import risk as R
from ..session import stage
from .oracle_base import AL, CO, EV, FEED, II, IN, IO, RK, iso, stamp as us_stamp, with_
from .registry import joined, query, stamp

BASE = with_(EV, AL, CO)
BASE_I = with_(EV, AL, CO, IN)
BASE_R = with_(EV, AL, CO, IN, RK)
BASE_T = with_(EV, AL, CO, IO, FEED, II)

MATCH_SQL = BASE + "SELECT alert_id, ent AS entity_key, cnt AS alert_count, msev AS severity, title, descr AS description, techs AS mitre_techniques, array_to_string(rules, ',') AS matched_rules FROM mx"
MATCH_COLUMNS = ["alert_id", "entity_key", "alert_count", "severity", "title", "description"]


def matches(ws, rules):
    parts = stage(C.participations(ws.live_alerts, rules), "participations")
    return C.correlation_matches(C.score_participations(parts), rules)


for _no, _rule in enumerate(C.all_rules(), 1):
    @query(f"c{_no:02d}_{_rule.correlation_type}", MATCH_SQL + f" WHERE ct='{_rule.correlation_type}'")
    def _(ws, rule=_rule):
        return matches(ws, [rule]).select(*MATCH_COLUMNS, joined("mitre_techniques"), joined("matched_rules"))


@query("c08_correlation_matches", BASE + "SELECT ct AS correlation_type, alert_id, cnt AS alert_count, msev AS severity FROM mx")
def _(ws):
    return matches(ws, C.all_rules()).select("correlation_type", "alert_id", "alert_count", "severity")


@query("c08_endpoint_rules", BASE + "SELECT ct AS correlation_type, count(*) AS n, sum(cnt)::BIGINT AS alerts FROM mx WHERE cr LIKE 'corr-rule-%' GROUP BY 1")
def _(ws):
    return matches(ws, C.endpoint_rules()).groupBy("correlation_type").agg(F.count("*").alias("n"), F.sum("alert_count").alias("alerts"))


CORRELATION_SQL = BASE + f"""SELECT cid AS correlation_id, cr AS rule_id, ct AS correlation_type, ent AS entity_key, title, descr AS description, severity,
  {us_stamp('first_us')} AS first_seen, {us_stamp('last_us')} AS last_seen, alert_count, event_count, triggers AS trigger_count, techs AS mitre_techniques FROM co"""


def correlation_rows(df):
    return df.select(
        "correlation_id", "rule_id", "correlation_type", "entity_key", "title", "description", "severity", stamp("first_seen"),
        stamp("last_seen"), "alert_count", "event_count", "trigger_count", joined("mitre_techniques"),
    )


@query("c09_correlation_episodes", CORRELATION_SQL)
def _(ws):
    return correlation_rows(C.correlate(ws.live_alerts).correlations)


@query("c09_correlation_members", BASE + "SELECT cid AS correlation_id, alert_id, event_id FROM mb")
def _(ws):
    return ws.members.select("correlation_id", "alert_id", "event_id")


@query("c09_correlation_evidence", BASE + "SELECT cid AS correlation_id, '[\"'||replace(last_rules, ',', '\",\"')||'\"]' AS rules FROM co WHERE ct IN ('same_entity','privilege_escalation_sequence')")
def _(ws):
    e = F.col("evidence")
    return ws.correlations.where(F.col("correlation_type").isin("same_entity", "privilege_escalation_sequence")).select(
        "correlation_id", F.coalesce(e["distinct_rules"], e["rules_correlated"]).alias("rules")
    )


@query("c10_correlation_ids", BASE + "SELECT cid AS correlation_id, founder AS founding_alert_id FROM co")
def _(ws):
    return ws.correlations.select("correlation_id", "founding_alert_id")


@query("c11_correlation_outcomes", BASE + "SELECT event_id, cid AS correlation_id, outcome FROM oc")
def _(ws):
    return ws.outcomes.select("event_id", "correlation_id", "outcome")


@query("u02_custom_correlation_rule", with_(EV, AL) + """SELECT a.alert_id, 1+count(*) AS alert_count FROM al a JOIN al h ON a.rule_id='builtin-004' AND h.rule_id='builtin-003'
  AND h.host=a.host AND h.us BETWEEN a.us-600000000 AND a.us AND (h.us<a.us OR h.event_id<=a.event_id) GROUP BY 1""")
def _(ws):
    rule = C.CorrelationRule(
        "corr-custom-1", "failure_then_connection", 600, lambda: F.concat(F.lit("host:"), "host"),
        {"builtin-004": ("builtin-003",)}, "Connection after failures on {entity}", "{n} alerts on {entity}.", lambda n: F.lit(9), ("T1110",),
    )
    return matches(ws, [rule]).select("alert_id", "alert_count")


# --- I ----------------------------------------------------------------------------------


@query("i01_build_incidents", BASE_I + "SELECT iid AS incident_id, ititle AS title, CAST(severity AS INTEGER) AS severity, 'open' AS status, cid AS correlation_ids, ct||','||ent AS tags, alert_count, techs AS mitre_techniques FROM inc")
def _(ws):
    return ws.incidents.select("incident_id", "title", "severity", "status", joined("correlation_ids"), joined("tags"), "alert_count", joined("mitre_techniques"))


@query("i02_incident_description", BASE_I + "SELECT iid AS incident_id, idescr AS description FROM inc")
def _(ws):
    return ws.incidents.select("incident_id", "description")


@query("i03_merge_incidents", BASE_I + f"""SELECT iid AS incident_id, 'acknowledged' AS status, {us_stamp('first_us - 60000000')} AS first_seen, {us_stamp('last_us')} AS last_seen,
  alert_count+1 AS alert_count, event_count+1 AS event_count, CASE WHEN techs='' THEN 'T0001' ELSE 'T0001,'||techs END AS mitre_techniques FROM inc""")
def _(ws):
    # the stored state: acknowledged, one minute wider, with one alert and technique of its own
    stored = ws.incidents.withColumns({
        "status": F.lit("acknowledged"), "first_seen": F.col("first_seen") - F.expr("INTERVAL 60 SECONDS"),
        "mitre_techniques": F.array(F.lit("T0001")),
    })
    own = ws.incidents.select("incident_id", F.lit("alert-own").alias("alert_id"), F.lit("evt-own").alias("event_id"))
    merged, _ = I.merge_incidents(stored, own, ws.incidents, ws.incident_members)
    return merged.select("incident_id", "status", stamp("first_seen"), stamp("last_seen"), "alert_count", "event_count", joined("mitre_techniques"))


@query("i04_set_incident_status", BASE_I + """, ch AS (SELECT iid, n.event_id AS seq, n.tm, CASE n.n%3 WHEN 0 THEN 'closed' WHEN 1 THEN 'resolved' ELSE 'investigating' END AS st
   FROM (SELECT DISTINCT 'inc-'||substr(sha256('incident:'||cid),1,16) AS iid, event_id FROM mb) m JOIN ev n ON n.event_id=m.event_id)
SELECT iid AS incident_id, arg_max(st, (tm, st)) AS status FROM ch GROUP BY 1""")
def _(ws):
    n = F.col("n")
    numbers = ws.events.select("event_id", F.col("timestamp").alias("ts"), F.substring("event_id", 5, 20).cast("bigint").alias("n"))
    changes = ws.incident_members.select("incident_id", "event_id").repartition("event_id").distinct().join(numbers, "event_id").select(
        "incident_id", "ts", F.when(n % 3 == 0, "closed").when(n % 3 == 1, "resolved").otherwise("investigating").alias("status"),
        F.lit("analyst").alias("actor"),
    )
    return I.set_incident_status(ws.incidents, changes)[0].select("incident_id", "status")


@query("i05_incident_by_correlation", BASE_I + "SELECT iid AS incident_id FROM inc WHERE cid=(SELECT min(cid) FROM co)")
def _(ws):
    first = ws.correlations.agg(F.min("correlation_id")).first()[0]
    return I.incident_by_correlation(ws.incidents, first).select("incident_id")


# --- R ----------------------------------------------------------------------------------

FEATURES_SQL = BASE_R + """SELECT iid AS incident_id, CAST(severity AS DOUBLE) AS incident_severity, CAST(severity AS DOUBLE) AS correlation_severity,
  CAST(alert_count AS DOUBLE) AS alert_count, CAST(event_count AS DOUBLE) AS event_count, 1.0::DOUBLE AS correlation_count, CAST(mcount AS DOUBLE) AS mitre_count,
  f_auth AS has_auth_attack, f_proc AS has_suspicious_process, f_net AS has_network_activity, f_priv AS has_privilege_escalation,
  span AS time_span_seconds, 2.0::DOUBLE AS entity_diversity, f_ds AS has_dataset_activity, f_sens AS has_sensitive_data_access, f_bulk AS has_bulk_export,
  f_exf AS has_dataset_exfiltration, 0.0::DOUBLE AS dataset_sensitivity, 0.0::DOUBLE AS records_accessed_normalized, 0.0::DOUBLE AS records_modified_normalized,
  0.0::DOUBLE AS export_volume_normalized, 0.0::DOUBLE AS sensitive_columns_count, f_nov AS actor_novelty, f_bai AS bulk_access_indicator FROM rk0"""


@query("r01_to_r23_features", FEATURES_SQL)
def _(ws):
    df = R.add_features(ws.incidents, ws.correlations)
    return df.select("incident_id", *[F.col(f"f_{n}").alias(n) for n in fv.FEATURES])


@query("r14_r17_to_r21_evidence_features", with_(EV) + """SELECT event_id, CASE WHEN ds_level='HIGH' THEN 1.0::DOUBLE ELSE 0.0 END AS sensitive, CASE WHEN ds_level='HIGH' THEN 0.5::DOUBLE ELSE 0.0 END AS level,
  round(least(1.0::DOUBLE, coalesce(records,0)/100000.0::DOUBLE),6) AS accessed, CASE WHEN cols IS NULL THEN 0.0::DOUBLE ELSE 2.0 END AS columns FROM ev""")
def _(ws):
    # events as incidents whose evidence was carried over
    m = F.col("metadata")
    df = ws.events.select(
        "event_id", "severity", F.lit(1).alias("alert_count"), F.lit(1).alias("event_count"),
        F.array(F.lit("x")).alias("correlation_ids"), F.array().cast("array<string>").alias("mitre_techniques"),
        F.array(F.lit("x")).alias("tags"), F.lit("t").alias("title"), F.lit("d").alias("description"),
        F.col("timestamp").alias("first_seen"), F.col("timestamp").alias("last_seen"),
        F.map_filter(F.create_map(
            F.lit("dataset_sensitivity"), m["sensitivity"], F.lit("records_accessed"), m["records_accessed"],
            F.lit("sensitive_columns"), m["sensitive_columns"],
        ), lambda k, v: v.isNotNull()).alias("evidence"),
    )
    return R.add_features(df, None).select(
        "event_id", F.col("f_has_sensitive_data_access").alias("sensitive"), F.col("f_dataset_sensitivity").alias("level"),
        F.round("f_records_accessed_normalized", 6).alias("accessed"), F.col("f_sensitive_columns_count").alias("columns"),
    )


@query("r24_reason_codes", BASE_R + """SELECT iid AS incident_id, array_to_string(list_sort(CASE WHEN len(r)=0 THEN ['BASELINE_RISK_FACTORS'] ELSE r END), ',') AS reasons FROM (
  SELECT iid, list_filter([CASE WHEN f_priv>=1 THEN 'PRIVILEGE_ESCALATION' END, CASE WHEN f_proc>=1 THEN 'SUSPICIOUS_PROCESS_ACTIVITY' END,
   CASE WHEN f_net>=1 THEN 'NETWORK_ACTIVITY' END, CASE WHEN f_auth>=1 THEN 'AUTHENTICATION_ATTACK' END, CASE WHEN mcount>=2 THEN 'MULTIPLE_MITRE_TECHNIQUES' END,
   CASE WHEN alert_count>=3 THEN 'HIGH_ALERT_VOLUME' END, CASE WHEN severity>=10 THEN 'HIGH_CORRELATION_SEVERITY' END, CASE WHEN severity>=10 THEN 'HIGH_INCIDENT_SEVERITY' END,
   CASE WHEN f_exf>=1 THEN 'DATASET_EXFILTRATION_RISK' END, CASE WHEN f_sens>=1 THEN 'SENSITIVE_DATASET_ACCESS' END, CASE WHEN f_bulk>=1 THEN 'BULK_DATA_EXPORT' END,
   CASE WHEN f_nov>=1 THEN 'UNUSUAL_ACTOR_DETECTED' END], lambda x: x IS NOT NULL) AS r FROM rk0)""")
def _(ws):
    return ws.risks.select("incident_id", joined("reasons"))


@query("r25_risk_probability", BASE_R + "SELECT iid AS incident_id, round(p, 3) AS probability FROM rl")
def _(ws):
    features = {n: F.col(f"f_{n}") for n in fv.FEATURES}
    return R.add_features(ws.incidents, ws.correlations).select("incident_id", F.round(R.risk_probability(features), 3).alias("probability"))


CONTRIBUTIONS = ", ".join(f"round({n}*{float(fv.ARTIFACT_V1['weights'].get(n, 0.0))!r}::DOUBLE, 4) AS {n}" for n in fv.FEATURES)


@query("r26_feature_contributions", f"SELECT incident_id, {CONTRIBUTIONS} FROM ({FEATURES_SQL})")
def _(ws):
    c = F.col("feature_contributions")
    return ws.risks.select("incident_id", *[c[n].alias(n) for n in fv.FEATURES])


@query("r27_score_and_level", BASE_R + "SELECT lvl AS risk_level, min(score) AS lowest, max(score) AS highest, count(*) AS n FROM rl GROUP BY 1")
def _(ws):
    return ws.risks.groupBy("risk_level").agg(F.min("risk_score").alias("lowest"), F.max("risk_score").alias("highest"), F.count("*").alias("n"))


@query("r28_score_incidents", BASE_R + "SELECT rid AS assessment_id, iid AS incident_id, score AS risk_score, lvl AS risk_level FROM rl")
def _(ws):
    return R.score_incidents(ws.incidents, ws.correlations).select("assessment_id", "incident_id", "risk_score", "risk_level")


@query("u03_custom_risk_model", BASE_R + "SELECT iid AS incident_id, CAST(round_even(least(1.0, alert_count/50.0)*100, 0) AS INTEGER) AS risk_score FROM rl")
def _(ws):
    scored = R.score_incidents(ws.incidents, ws.correlations, model=lambda f: F.least(F.lit(1.0), f["alert_count"] / 50.0))
    return scored.select("incident_id", "risk_score")


@query("r29_train_risk_model")
def _(ws):
    rows = ws.table("lineitem").select(
        "l_quantity", "l_discount", "l_tax", F.when((F.col("l_returnflag") == "R") | (F.col("l_quantity") > 40), 1).otherwise(0).alias("label"),
    )
    model = E.train_risk_model(rows, ["l_quantity", "l_discount", "l_tax"])
    scored = rows.withColumn("z", sum((F.col(k) * w for k, w in model["weights"].items()), F.lit(model["intercept"])))
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.avg(R.sigmoid(F.col("z"))).alias("mean_probability"))


SD = """WITH sd AS (SELECT doc_id AS id, quality AS label, (n_chars%101)/100::DOUBLE AS score, CASE WHEN n_chars%101>=50 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id)),
rr AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r, sum(label) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS s FROM sd)
"""


@query("r30_binary_metrics", SD + """SELECT tp, tn, fp, fn, round((tp+tn)/(tp+tn+fp+fn), 6) AS accuracy, round(tp/(tp+fp), 6) AS "precision", round(tp/(tp+fn), 6) AS recall, round(2*tp/(2*tp+fp+fn), 6) AS f1
FROM (SELECT count(*) FILTER (label=1 AND prediction=1) AS tp, count(*) FILTER (label=0 AND prediction=0) AS tn, count(*) FILTER (label=0 AND prediction=1) AS fp, count(*) FILTER (label=1 AND prediction=0) AS fn FROM sd)""")
def _(ws):
    m = E.binary_metrics(ws.scored_documents())
    return m.select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("r31_roc_auc", SD + "SELECT round(sum(CASE WHEN label=0 THEN s ELSE 0 END)/(sum(label)*count(*) FILTER (label=0)), 6) AS roc_auc FROM rr")
def _(ws):
    return E.roc_auc(ws.scored_documents()).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("r32_average_precision", SD + "SELECT round(sum(CASE WHEN label=1 THEN s/r END)/sum(label), 6) AS average_precision FROM rr")
def _(ws):
    return E.average_precision(ws.scored_documents()).select(F.round("average_precision", 6).alias("average_precision"))


CLASSES = ["de", "en", "es", "fr"]
MULTI = """WITH x AS (SELECT lang AS t, (['de','en','es','fr'])[CAST(doc_id%4 AS INTEGER)+1] AS p FROM documents WHERE lang IN ('de','en','es','fr')),
c AS (SELECT unnest(['de','en','es','fr']) AS "class"),
m AS (SELECT "class", (SELECT count(*) FROM x WHERE t="class") AS support, (SELECT count(*) FROM x WHERE p="class") AS guessed, (SELECT count(*) FROM x WHERE t="class" AND p="class") AS tp,
  (SELECT count(*) FROM x WHERE t="class" AND p='de') AS as_de, (SELECT count(*) FROM x WHERE t="class" AND p='en') AS as_en,
  (SELECT count(*) FROM x WHERE t="class" AND p='es') AS as_es, (SELECT count(*) FROM x WHERE t="class" AND p='fr') AS as_fr FROM c),
q AS (SELECT *, CASE WHEN guessed>0 THEN tp/guessed ELSE 0 END AS pr, CASE WHEN support>0 THEN tp/support ELSE 0 END AS rc FROM m)
SELECT "class", support, as_de, as_en, as_es, as_fr, round(pr,6) AS "precision", round(rc,6) AS recall, round(CASE WHEN pr+rc>0 THEN 2*pr*rc/(pr+rc) ELSE 0 END,6) AS f1,
  round((SELECT sum(tp)/sum(support) FROM m),6) AS accuracy, round((SELECT avg(pr) FROM q),6) AS macro_precision FROM q"""


@query("r33_multiclass_metrics", MULTI)
def _(ws):
    names = F.array(*[F.lit(c) for c in CLASSES])
    df = ws.table("documents").where(F.col("lang").isin(*CLASSES)).select(
        F.col("lang").alias("truth"), F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("predicted")
    )
    m = E.multiclass_metrics(df, CLASSES)
    return m.select("class", "support", *[f"as_{c}" for c in CLASSES], *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_precision")])


@query("r34_stratified_split", """WITH x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:'||doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN r<=round_even(n*0.75, 0) THEN 'train' ELSE 'test' END AS split FROM x""")
def _(ws):
    return E.stratified_split(ws.table("documents").select("doc_id", "lang"), "lang", "doc_id")


@query("r35_class_imbalance", """WITH x AS (SELECT o_orderpriority AS "class", count(*) AS n FROM orders GROUP BY 1) SELECT "class", n, round((SELECT max(n)/min(n) FROM x),6) AS ratio, (SELECT max(n)/min(n)>2 FROM x) AS imbalanced FROM x""")
def _(ws):
    return E.class_imbalance(ws.table("orders"), "o_orderpriority").withColumn("ratio", F.round("ratio", 6))


# --- T ----------------------------------------------------------------------------------

IOC_SQL = with_(EV, IO) + "SELECT event_id, ty AS ioc_type, nv AS normalized_value FROM ioc"

for _name, _types in (
    ("t01_extract_ip_iocs", ["ipv4", "ipv6"]), ("t02_extract_domain_iocs", ["domain"]), ("t03_extract_url_iocs", ["url"]),
    ("t04_extract_hash_iocs", ["sha256", "sha1", "md5"]),
):
    @query(_name, IOC_SQL + " WHERE ty IN (" + ",".join(f"'{t}'" for t in _types) + ")")
    def _(ws, types=_types):
        return T.extract_iocs(ws.events).where(F.col("ioc_type").isin(*types)).select("event_id", "ioc_type", "normalized_value")


@query("t03_page_urls", r"SELECT page_id, url AS normalized_value FROM pages WHERE regexp_matches(url, '^https?://\S{1,1000}$')")
def _(ws):
    found = ws.table("pages").select("page_id", F.lit("url").alias("key"), F.col("url").alias("value"))
    return T.classify_iocs(found).select("page_id", "normalized_value")


@query("t05_credential_filter", with_(EV) + "SELECT count(*) FILTER (hostname='srv.example.net') AS kept, count(*) FILTER (contains(hostname,'api_key')) AS dropped FROM ev")
def _(ws):
    host = F.col("metadata")["hostname"]
    allowed = T.allowed_field(F.lit("hostname"), host)
    return ws.events.agg(F.count_if(allowed).alias("kept"), F.count_if(host.isNotNull() & ~allowed).alias("dropped"))


@query("t06_dedup_iocs", with_(EV, IO) + """SELECT 'ioc-'||substr(sha256('ioc:'||ty||':'||nv),1,16) AS ioc_id, ty AS ioc_type, nv AS normalized_value, 'event:'||f[1]||':'||f[3] AS source_context
FROM (SELECT ty, nv, min(row(event_id, pos, fld, v)) AS f FROM ioc GROUP BY ALL)""")
def _(ws):
    return T.dedup_iocs(T.extract_iocs(ws.events)).select("ioc_id", "ioc_type", "normalized_value", "source_context")


@query("t07_incident_iocs", BASE_T + "SELECT iid AS incident_id, ty AS ioc_type, nv AS normalized_value FROM ii")
def _(ws):
    return T.incident_iocs(ws.incident_members, ws.events).select("incident_id", "ioc_type", "normalized_value")


@query("t08_ti_lookup", with_(EV, IO, FEED, """q AS (SELECT DISTINCT ty, nv FROM ioc)""") + """SELECT ty AS ioc_type, nv AS normalized_value,
  coalesce((SELECT CASE WHEN bool_or(cls='malicious') THEN 'malicious' ELSE 'benign' END FROM fd WHERE CASE WHEN ty='url' THEN ft='domain' AND contains(nv,fv)
    WHEN ty IN ('sha256','sha1','md5') THEN ft='hash' AND fv=nv ELSE ft=ty AND fv=nv END HAVING count(*)>0), 'unknown') AS classification FROM q""")
def _(ws):
    return T.ti_lookup(T.dedup_iocs(T.extract_iocs(ws.events)), ws.feed).select("ioc_type", "normalized_value", "classification")


@query("t09_enrich_incidents", BASE_T + """SELECT eid AS enrichment_id, iid AS incident_id, ty AS ioc_type, nv AS ioc_value, cls AS classification, CASE cls WHEN 'malicious' THEN 94 WHEN 'benign' THEN 90 ELSE 0 END AS confidence,
  CASE cls WHEN 'malicious' THEN 3 WHEN 'benign' THEN 2 ELSE 0 END AS source_count, cat AS threat_category FROM enc""")
def _(ws):
    return ws.enrichments.select("enrichment_id", "incident_id", "ioc_type", "ioc_value", "classification", "confidence", "source_count", "threat_category")


@query("t10_ti_summary", BASE_T + "SELECT iid AS incident_id, total AS total_indicators, bad AS malicious_count, good AS benign_count, other AS unknown_count FROM ts")
def _(ws):
    return T.ti_summary(ws.enrichments).select("incident_id", "total_indicators", "malicious_count", "benign_count", "unknown_count")


@query("t11_find_by_ioc", BASE_T + "SELECT eid AS enrichment_id, iid AS incident_id, cls AS classification FROM enc WHERE ty='ipv4' AND nv='198.51.100.99' ORDER BY eid")
def _(ws):
    return T.find_by_ioc(ws.enrichments, "ipv4", "198.51.100.99").select("enrichment_id", "incident_id", "classification")


@query("u04_custom_intel_provider", with_(EV, IO) + "SELECT DISTINCT ty AS ioc_type, nv AS normalized_value, CASE WHEN nv IN (SELECT source_ip FROM ev WHERE event_type='authentication_failure') THEN 'malicious' ELSE 'unknown' END AS classification FROM ioc WHERE ty='ipv4'")
def _(ws):
    # a provider is any table in the feed's form; here the addresses of failed logins
    feed = ws.events.where("event_type = 'authentication_failure'").select(
        F.lit("ipv4").alias("ioc_type"), F.col("source_ip").alias("ioc_value"), F.lit("malicious").alias("classification"), F.lit("brute_force").alias("threat_category"),
    ).distinct()
    iocs = T.dedup_iocs(T.extract_iocs(ws.events)).where("ioc_type = 'ipv4'")
    return T.ti_lookup(iocs, feed).select("ioc_type", "normalized_value", "classification")


_ = iso
