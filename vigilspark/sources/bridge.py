"""Maps the shared ``events`` test table to normalized security events.

Pure projection: every column comes from the row itself, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_security_events(table(spark, sf_dir, "events"))


def to_security_events(raw: DataFrame) -> DataFrame:
    n, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    is_data = kind == "purchase"
    data_type = (
        F.when(n % 5 == 0, "dataset_exported")
        .when(n % 5 == 1, "sensitive_column_access")
        .when(n % 5 == 2, "dataset_bulk_access")
        .when(n % 5 == 3, "dataset_modified")
        .otherwise("dataset_schema_changed")
    )
    records = (F.get_json_object("props", "$.k").cast("long") * 200).cast("string")
    has_target = (kind == "view") | (is_data & (n % 5 == 0))
    metadata = F.create_map(
        F.lit("records_accessed"), F.when(is_data, records),
        F.lit("records_modified"), F.when(is_data, records),
        F.lit("dataset_id"), F.when(is_data, F.concat(F.lit("ds-"), u % 3)),
        F.lit("dataset_name"), F.when(is_data, F.concat(F.lit("table "), u % 3)),
        F.lit("sensitivity"), F.when(is_data, F.when(u % 3 == 0, "HIGH").otherwise("LOW")),
        F.lit("sensitive_columns"),
        F.when(is_data & (n % 5 == 1), F.lit('["account_number","email"]')),
        F.lit("domain"),
        F.when(n % 11 == 0, "evil.synthetic.example")
        .when(n % 11 == 1, "Safe.Synthetic.Example.")
        .when(n % 11 == 2, "not a domain"),
        F.lit("url"),
        F.when(n % 13 == 0, F.concat(F.lit("https://malware.synthetic.example/x?id="), n % 50))
        .when(n % 13 == 1, F.concat(F.lit("https://www.example.org/"), n % 50)),
        F.lit("file_hash"),
        F.when(n % 17 == 0, F.sha2(n.cast("string"), 256))
        .when(n % 17 == 1, F.repeat(F.lit("a"), 64))
        .when(n % 17 == 2, F.repeat(F.lit("f"), 32)),
        F.lit("hostname"),
        F.when(n % 19 == 0, "api_key.example.org").when(n % 19 == 1, "srv.example.net"),
    )
    return raw.select(
        F.concat(F.lit("evt-"), n).alias("event_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(is_data, "dataset_activity").otherwise("app").alias("source"),
        F.when(kind == "error", "authentication_failure")
        .when(kind == "click", "process_start")
        .when(kind == "view", "network_connection")
        .when(kind == "signup", "privilege_escalation")
        .otherwise(data_type)
        .alias("event_type"),
        F.least(F.lit(15), F.floor(F.col("value") / 10)).cast("int").alias("severity"),
        F.when((kind == "click") & (n % 2 == 0), "powershell -enc run")
        .when(kind == "click", "start process")
        .otherwise("activity")
        .alias("message"),
        F.concat(F.lit("host-"), u % 5).alias("host"),
        F.concat(F.lit("user-"), u % 20).alias("user"),
        F.when(u % 7 == 0, "203.0.113.50").otherwise(F.concat(F.lit("10.0.0."), u % 250)).alias("source_ip"),
        F.when(has_target, F.when(n % 3 == 0, "198.51.100.99").otherwise("192.0.2.1")).alias("destination_ip"),
        F.map_filter(metadata, lambda k, v: v.isNotNull()).alias("metadata"),
    )
