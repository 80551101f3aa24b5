"""Security assessment of profiled datasets (Q01-Q12). One projection over the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import short_id
from .profile import _any, normal_name

FINDING = (
    "struct<finding_id:string,severity:string,title:string,description:string,affected_columns:array<string>,"
    "recommendation:string,evidence_summary:string>"
)
CHECK = "struct<check_name:string,passed:boolean,severity:string,detail:string>"


def _names(test: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter("columns", test), lambda c: c["name"])


def list_text(names: Column) -> Column:
    """['a', 'b']"""
    return F.concat(
        F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]")
    )


def _secret(c: Column) -> Column:
    return _any(normal_name(c["name"]), fv.SECRET_FIELD_PATTERNS)


def _high_risk(c: Column) -> Column:
    return _any(normal_name(c["name"]), fv.HIGH_RISK_FIELD_PATTERNS)


def _pii(c: Column) -> Column:
    return _any(normal_name(c["name"]), fv.PII_FIELD_PATTERNS) & ~_high_risk(c) & ~_secret(c)


def _null_heavy(c: Column) -> Column:
    return c["is_sensitive"] & (F.coalesce(c["null_ratio"], F.lit(0.0)) >= 0.5)


def _duplicates(c: Column) -> Column:
    identifier = F.coalesce(F.lower(c["pii_type"]).isin(*fv.IDENTIFIER_KINDS), F.lit(False)) | F.lower(c["name"]).contains("id")
    return c["is_sensitive"] & identifier & (F.coalesce(c["duplicate_ratio"], F.lit(0.0)) >= 0.6)


def _untyped(c: Column) -> Column:
    return c["is_sensitive"] & F.coalesce(F.lower(c["data_type"]).isin("", "unknown", "object"), F.lit(True))


def _suspicious(c: Column) -> Column:
    return _any(c["name"], [fv.SUSPICIOUS_FIELD_PATTERN])


def column_groups(catalog: DataFrame) -> DataFrame:
    """Adds the column lists the findings are about."""
    return catalog.withColumns({
        "secret_columns": _names(_secret),
        "high_risk_columns": _names(_high_risk),
        "pii_columns": _names(_pii),
        "null_heavy_columns": _names(_null_heavy),
        "duplicate_columns": _names(_duplicates),
        "untyped_columns": _names(_untyped),
        "suspicious_columns": _names(_suspicious),
    })


def _n(names: Column) -> Column:
    return F.size(names).cast("string")


def _text(template: str, **parts: Column) -> Column:
    out: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        out += [F.lit(head), parts[key]]
    return F.concat(*out, F.lit(rest))


def _finding(prefix: str, severity: Column, title: Column, description: Column, columns: Column, advice: str, summary: Column) -> Column:
    return F.struct(
        F.concat(F.lit(f"find-{prefix}-"), F.substring("dataset_id", 1, 8)).alias("finding_id"),
        severity.alias("severity"), title.alias("title"), description.alias("description"),
        columns.alias("affected_columns"), F.lit(advice).alias("recommendation"), summary.alias("evidence_summary"),
    ).cast(FINDING)


# fixed values: wording of the findings on a list of columns, in check order
_LISTS = [
    # (list, id, severity, title, description, recommendation, summary, check, failed detail, passed detail)
    ("secret_columns", "secret", "CRITICAL", "Secret-like or credential field detected",
     "Columns with names matching secret/credential patterns were found: {cols}. These may contain passwords, API "
     "keys, or tokens. Raw values have NOT been read or stored — this finding is based solely on column naming "
     "heuristics.",
     "Remove credential columns from this dataset. Secrets should never be stored in data files. Rotate any exposed "
     "credentials immediately.",
     "{n} column(s) with secret-like names detected. [REDACTED SECRET-LIKE VALUE DETECTED] — raw values are never "
     "stored.",
     "Secret-like field scan", "Detected: {cols}", "No secret-like column names found"),
    ("high_risk_columns", "highrisk", "HIGH", "Highly sensitive identifier fields detected",
     "Columns with high-risk sensitivity patterns (financial identifiers, government IDs, medical records) detected: "
     "{cols}. Detection is heuristic — based on column naming only.",
     "Apply strict access controls, encryption at rest, and audit logging for datasets containing financial or "
     "government identifier fields. Consider pseudonymization or tokenization where appropriate.",
     "{n} high-risk column(s) by name heuristic",
     "High-risk identifier scan", "Detected: {cols}", "No high-risk identifier column names found"),
    ("pii_columns", "pii", "MEDIUM", "Probable PII fields detected (heuristic)",
     "Columns with names matching probable PII patterns (email, phone, address, customer ID, name) detected: {cols}. "
     "This is a heuristic scan — actual PII presence depends on data content.",
     "Ensure data subjects have consented to storage and processing. Apply data minimization — only retain fields "
     "necessary for the stated purpose. Consider anonymization or pseudonymization for analysis datasets.",
     "{n} probable PII column(s) by name heuristic",
     "PII heuristic scan", "Probable PII columns: {cols}", "No probable PII column names detected"),
    ("null_heavy_columns", "null-sensitive", "MEDIUM", "Null-heavy sensitive columns",
     "Sensitive columns with a high null ratio in the sampled rows: {cols}. Incomplete sensitive identifiers can "
     "indicate quality issues or partial masking.",
     "Review collection completeness for sensitive fields. Do not backfill with real production values in shared "
     "datasets.",
     "{n} sensitive column(s) with sampled null_ratio >= 0.5",
     "Null-heavy sensitive column scan", "Null-heavy sensitive columns: {cols}",
     "No sampled sensitive column exceeded the null-ratio threshold"),
    ("duplicate_columns", "dup-id", "LOW", "Duplicate-heavy sensitive identifiers",
     "Sensitive identifier columns with high duplicate ratios in the sample: {cols}. This may indicate reused IDs, "
     "test data, or a non-unique key.",
     "Confirm identifier uniqueness requirements. Synthetic or demo datasets may legitimately reuse values.",
     "{n} identifier column(s) with sampled duplicate_ratio >= 0.6",
     "Duplicate identifier scan", "Duplicate-heavy identifiers: {cols}",
     "No sampled sensitive identifier exceeded the duplicate-ratio threshold"),
    ("untyped_columns", "schema-gap", "LOW", "Sensitive columns with unresolved data types",
     "Sensitive columns with unknown or object data types: {cols}. Untyped sensitive columns may indicate schema "
     "inconsistency or data quality issues.",
     "Define explicit data types for all sensitive columns. Enforce schema validation at ingestion time.",
     "{n} sensitive column(s) with unresolved types",
     "Schema type consistency", "Untyped sensitive columns: {cols}", "All sensitive columns have resolved data types"),
]


def _check(name: str, passed: Column, severity: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"), passed.alias("passed"), severity.alias("severity"), detail.alias("detail")
    ).cast(CHECK)


def findings() -> Column:
    """All findings of a catalog row with column groups (Q01-Q09)."""
    out: list[Column] = []
    for key, prefix, severity, title, description, advice, summary, *_ in _LISTS:
        names = F.col(key)
        parts = {"cols": list_text(names), "n": _n(names)}
        out.append(F.when(F.size(names) > 0, _finding(
            prefix, F.lit(severity), F.lit(title), _text(description, **parts), names, advice, _text(summary, **parts)
        )))
    width = F.col("column_count").cast("string")
    empty = F.array().cast("array<string>")
    out.append(F.when(F.col("column_count") > fv.WIDE_SCHEMA_COLUMNS, _finding(
        "schema-wide", F.lit("LOW"), F.lit("Unusually wide schema detected"),
        _text("Dataset has {w} columns which is unusually wide. Wide schemas may indicate excessive data collection or "
              "schema sprawl.", w=width), empty,
        "Review whether all columns are necessary. Apply data minimization principles — collect only what is needed.",
        _text("Column count: {w}", w=width),
    )))
    odd = F.col("suspicious_columns")
    out.append(F.when(F.size(odd) > 0, _finding(
        "schema-naming", F.lit("MEDIUM"), F.lit("Suspicious column naming patterns"),
        _text("Columns with names suggesting raw exports, dumps, or unfiltered data: {c}. These may indicate "
              "unprocessed or improperly sanitized data.", c=list_text(odd)), odd,
        "Review columns with 'dump', 'raw', 'backup', 'export' naming. Ensure datasets shared beyond the origin system "
        "are properly filtered and sanitized.",
        _text("Suspicious naming: {c}", c=list_text(odd)),
    )))
    level, sensitive = F.col("sensitivity"), F.col("sensitive_columns")
    out.append(F.when(level.isin("HIGH", "CRITICAL"), _finding(
        "sensitivity", level, _text("Dataset classified as {l} sensitivity", l=level),
        _text("Dataset '{d}' has been heuristically classified as {l} sensitivity based on {n} detected sensitive "
              "column(s): {c}.", d=F.col("name"), l=level, n=_n(sensitive), c=list_text(F.slice(sensitive, 1, 5))),
        F.slice(sensitive, 1, 10),
        "Apply strict data governance: encryption at rest and in transit, role-based access control, comprehensive "
        "audit logging, and regular access reviews.",
        _text("Sensitivity: {l}, Sensitive columns: {n}", l=level, n=_n(sensitive)),
    )))
    return F.array_compact(F.array(*out))


def checks(score: Column, level: Column) -> Column:
    """Pass/fail rows in order (Q10)."""
    out: list[Column] = []
    none = F.lit(None).cast("string")
    for key, _, severity, *_rest, name, failed, passed in _LISTS:
        names = F.col(key)
        ok = F.size(names) == 0
        out.append(_check(name, ok, F.when(~ok, severity), F.when(ok, F.lit(passed)).otherwise(_text(failed, cols=list_text(names)))))
    width, wide = F.col("column_count").cast("string"), F.col("column_count") > fv.WIDE_SCHEMA_COLUMNS
    out.append(_check("Schema anomaly scan", ~wide, F.when(wide, "LOW"), F.when(
        wide, _text("Wide schema: {w} columns", w=width)).otherwise(_text("Schema width normal: {w} columns", w=width))))
    sensitivity, sensitive = F.col("sensitivity"), F.col("sensitive_columns")
    out.append(_check(
        "Sensitivity classification", sensitivity.isin("LOW", "MEDIUM"),
        F.when(sensitivity == "LOW", "INFO").otherwise(sensitivity),
        _text("Overall sensitivity: {l}, sensitive columns: {n}", l=sensitivity, n=_n(sensitive)),
    ))
    yes = F.lit(True)
    out.append(_check("Format validation", yes, none, _text("Format {f} successfully validated", f=F.upper("format"))))
    out.append(_check("Schema inspection", yes, none, _text("{w} columns profiled, {n} sensitive", w=width, n=_n(sensitive))))
    out.append(_check("Sensitive-field analysis", yes, none, _text(
        "{n} probable sensitive column(s) classified heuristically", n=_n(sensitive))))
    out.append(_check("Risk scoring", yes, none, _text("Deterministic score {s}/100 ({l})", s=score.cast("string"), l=level)))
    return F.array(*out)


def _count(severity: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["severity"] == severity))


def security_score() -> Column:
    lost = F.lit(0)
    for severity, points in fv.FINDING_DEDUCTION.items():
        lost = lost + _count(severity) * points
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("int")


def security_level(score: Column) -> Column:
    return F.when(score >= 80, "LOW").when(score >= 60, "MEDIUM").when(score >= 40, "HIGH").otherwise("CRITICAL")


def contributing_factors() -> Column:
    top = F.size(F.filter("columns", lambda c: c["sensitivity"].isin("HIGH", "CRITICAL")))
    financial = F.exists(
        "columns", lambda c: F.coalesce(c["pii_type"].isin(*fv.FINANCIAL_KINDS), F.lit(False)) | _high_risk(c)
    )

    def titled(*words: str) -> Column:
        def test(f: Column) -> Column:
            hit = F.lit(False)
            for w in words:
                hit = hit | F.lower(f["title"]).contains(w)
            return hit
        return F.exists("findings", test)

    out = [
        F.when(top > 0, F.concat(top.cast("string"), F.lit(" highly sensitive column(s)"))),
        F.when(financial, "financial identifiers detected"),
        F.when(titled("secret", "credential"), "possible secret-like field"),
        F.when(titled("schema", "naming"), "schema anomaly"),
    ]
    for severity, word in (("CRITICAL", "critical"), ("HIGH", "high-severity"), ("MEDIUM", "medium-severity"), ("LOW", "low-severity")):
        n = _count(severity)
        out.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word} finding(s) detected"))))
    found = F.array_compact(F.array(*out))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No significant security concerns found")))


def assess_datasets(catalog: DataFrame, now: Column | None = None) -> DataFrame:
    """One assessment per dataset (Q12)."""
    judged = column_groups(catalog).withColumn("findings", findings())
    judged = judged.withColumn("score", security_score()).withColumn("risk_level", security_level(F.col("score")))
    return judged.select(
        short_id("assess-", F.col("dataset_id"), length=12).alias("assessment_id"), "dataset_id",
        F.col("name").alias("dataset_name"), "findings", "score", "risk_level",
        contributing_factors().alias("contributing_factors"),
        checks(F.col("score"), F.col("risk_level")).alias("checks"),
        _count("CRITICAL").alias("critical_findings"), _count("HIGH").alias("high_findings"),
        _count("MEDIUM").alias("medium_findings"), _count("LOW").alias("low_findings"),
        _count("INFO").alias("info_findings"),
        (F.current_timestamp() if now is None else now).alias("assessed_at"),
    )


def finding_rows(assessments: DataFrame) -> DataFrame:
    return assessments.select("dataset_id", F.posexplode("findings").alias("position", "f")).select(
        "dataset_id", "position", "f.*"
    )


def check_rows(assessments: DataFrame) -> DataFrame:
    return assessments.select("dataset_id", F.posexplode("checks").alias("position", "c")).select(
        "dataset_id", "position", "c.*"
    )
