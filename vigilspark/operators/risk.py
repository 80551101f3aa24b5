"""Risk scoring (R01-R28) and the custom-model hook (U03). Columns only."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import short_id, words_in

RiskModel = Callable[[Mapping[str, Column]], Column]
WEIGHT_SETS = {"artifact_v1": fv.ARTIFACT_V1, "default_v2": fv.DEFAULT_V2}


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _evidence(key: str) -> Column:
    return F.col("evidence").getItem(key)


def _count(key: str) -> Column:
    return F.greatest(F.lit(0), F.coalesce(_evidence(key).try_cast("bigint"), F.lit(0))).cast("double")


def risk_features() -> dict[str, Column]:
    """R01-R23 over incident columns plus ``corr_severity``, ``corr_type``, ``corr_title``."""
    text = F.lower(
        F.concat_ws(
            " ", F.array_join("tags", " "), "title", "description",
            F.when(F.col("corr_type").isNotNull(), F.concat_ws(" ", "corr_type", "corr_title")),
        )
    )
    level = F.upper(F.coalesce(_evidence("dataset_sensitivity"), F.lit("")))
    words = {name: _flag(words_in(text, found)) for name, found in fv.TEXT_FEATURES.items()}
    severity = F.greatest(F.lit(0), F.least(F.lit(15), F.col("severity"))).cast("double")
    span = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6
    has = text.contains
    level_weight = F.lit(0.0)
    for name, weight in fv.SENSITIVITY_WEIGHT.items():
        level_weight = F.when(level == name, F.lit(weight)).otherwise(level_weight)
    columns = F.from_json(_evidence("sensitive_columns"), "array<string>")
    values = {
        "incident_severity": severity,
        "correlation_severity": F.coalesce(
            F.greatest(F.lit(0), F.least(F.lit(15), F.col("corr_severity"))).cast("double"), severity
        ),
        "alert_count": F.col("alert_count").cast("double"),
        "event_count": F.col("event_count").cast("double"),
        "correlation_count": F.greatest(F.lit(1), F.size("correlation_ids")).cast("double"),
        "mitre_count": F.size(F.array_distinct("mitre_techniques")).cast("double"),
        "time_span_seconds": F.coalesce(F.greatest(F.lit(0.0), span), F.lit(0.0)),
        "entity_diversity": F.greatest(F.lit(1), F.least(F.lit(20), F.size(F.array_distinct("tags")))).cast("double"),
        "has_sensitive_data_access": _flag(
            level.isin("HIGH", "CRITICAL") | has("sensitive_data") | has("sensitive_column")
        ),
        "has_dataset_exfiltration": _flag(
            has("exfiltrat") | has("data_exfil") | (has("dataset") & (has("network") | has("export")))
        ),
        "dataset_sensitivity": level_weight,
        "records_accessed_normalized": F.least(F.lit(1.0), _count("records_accessed") / 100000.0),
        "records_modified_normalized": F.least(F.lit(1.0), _count("records_modified") / 100000.0),
        "export_volume_normalized": F.least(F.lit(1.0), _count("export_size_bytes") / 1e9),
        "sensitive_columns_count": F.least(
            F.lit(10), F.greatest(F.lit(0), F.coalesce(F.size(columns), F.lit(0)))
        ).cast("double"),
        **words,
    }
    return {name: values[name] for name in fv.FEATURES}


def add_features(incidents: DataFrame, correlations: DataFrame | None) -> DataFrame:
    """Incident rows with one column per feature, named ``f_<feature>``."""
    if correlations is None:
        joined = (
            incidents.withColumn("corr_severity", F.lit(None).cast("int"))
            .withColumn("corr_type", F.lit(None).cast("string")).withColumn("corr_title", F.lit(None).cast("string"))
        )
    else:
        first = correlations.select(
            F.col("correlation_id").alias("_cid"), F.col("severity").alias("corr_severity"),
            F.col("correlation_type").alias("corr_type"), F.col("title").alias("corr_title"),
        )
        joined = incidents.join(first, F.get("correlation_ids", 0) == F.col("_cid"), "left").drop("_cid")
    return joined.withColumns({f"f_{k}": v for k, v in risk_features().items()})


def reason_codes(features: Mapping[str, Column]) -> Column:
    found = F.array_sort(F.array_compact(F.array(*[
        F.when(features[name] >= limit, F.lit(code)) for code, name, limit in fv.REASON_THRESHOLDS
    ])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fv.NO_REASON)))


def linear_score(features: Mapping[str, Column], weights: Mapping) -> Column:
    z = F.lit(float(weights["intercept"]))
    for name in fv.FEATURES:
        z = z + features[name] * F.lit(float(weights["weights"].get(name, 0.0)))
    return z


def sigmoid(z: Column) -> Column:
    return F.when(z >= 40, 1.0).when(z <= -40, 0.0).otherwise(1.0 / (1.0 + F.exp(-z)))


def risk_probability(features: Mapping[str, Column], weights: Mapping = fv.ARTIFACT_V1) -> Column:
    return sigmoid(linear_score(features, weights))


def feature_contributions(features: Mapping[str, Column], weights: Mapping = fv.ARTIFACT_V1) -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(n) for n in fv.FEATURES]),
        F.array(*[F.round(features[n] * F.lit(float(weights["weights"].get(n, 0.0))), 4) for n in fv.FEATURES]),
    )


def risk_score(probability: Column) -> Column:
    """0..100, ties to even."""
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability)) * 100).cast("int")


def risk_level(score: Column) -> Column:
    return F.when(score < 25, "low").when(score < 50, "medium").when(score < 75, "high").otherwise("critical")


def assessment_id(incident_id: Column) -> Column:
    return short_id("risk-", "risk:", incident_id)


def score_incidents(
    incidents: DataFrame,
    correlations: DataFrame | None = None,
    weights: Mapping | str = "artifact_v1",
    model: RiskModel | None = None,
    now: Column | None = None,
) -> DataFrame:
    """One assessment per incident. ``model`` maps feature columns to a probability column
    (a weights expression, a pandas UDF over the features, ...) and replaces the weights."""
    chosen = WEIGHT_SETS[weights] if isinstance(weights, str) else weights
    df = add_features(incidents, correlations)
    features = {n: F.col(f"f_{n}") for n in fv.FEATURES}
    df = df.withColumn("p", model(features) if model else risk_probability(features, chosen))
    score = risk_score(F.col("p"))
    return df.select(
        assessment_id(F.col("incident_id")).alias("assessment_id"), "incident_id",
        score.alias("risk_score"), risk_level(score).alias("risk_level"), F.round("p", 4).alias("probability"),
        F.lit(fv.MODEL_NAME).alias("model_name"), F.lit(fv.MODEL_VERSION).alias("model_version"),
        F.lit(fv.FEATURE_VERSION).alias("feature_version"),
        (F.current_timestamp() if now is None else now).alias("scored_at"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in fv.FEATURES]), F.array(*features.values())).alias("features"),
        reason_codes(features).alias("reasons"),
        feature_contributions(features, chosen).alias("feature_contributions"),
    )
