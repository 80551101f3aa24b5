"""Sinks (S08-S10): insert-if-absent and upsert of whole frames, and the audit log.

Stored tables are merged into by bucket (``buckets.py``).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import short_id

AUDIT_COLUMNS = ["audit_id", "timestamp", "actor", "action", "target", "result", "metadata_json"]


class Written(NamedTuple):
    """``table``: the table after the write. ``outcomes``: one row per incoming key."""

    table: DataFrame
    outcomes: DataFrame


def one_of_each(new: DataFrame, key: str, order: str | None, pick) -> DataFrame:
    """One row a key: ``pick`` by the order column, or by all columns that can be ordered; never an arbitrary one."""
    by = [order] if order else []
    by += [f.name for f in new.schema.fields if f.name not in (key, order) and "map<" not in f.dataType.simpleString()]
    row = F.struct(*new.columns)
    best = pick(row, F.struct(*by)) if by else F.first(row)
    return new.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def insert_if_absent(new: DataFrame, stored: DataFrame | None, key: str, order: str | None = None) -> Written:
    """Rows with a new key are added; a known key keeps its old row untouched.

    Of several new rows of a key the first by ``order`` is inserted.
    """
    unique = one_of_each(new, key, order, F.min_by)
    if stored is None:
        return Written(unique, unique.select(key, F.lit("created").alias("outcome")))
    added = unique.join(stored.select(key), key, "left_anti")
    known = stored.select(key, F.lit(True).alias("known"))
    outcomes = unique.select(key).join(known, key, "left").select(
        key, F.when(F.col("known"), "duplicate").otherwise("created").alias("outcome")
    )
    return Written(stored.unionByName(added.select(*stored.columns)), outcomes)


def upsert(new: DataFrame, stored: DataFrame | None, key: str, mutable: Sequence[str], order: str | None = None) -> Written:
    """Known keys get the new values of the mutable columns only; others are added.

    Of several new rows of a key the last by ``order`` counts.
    """
    unique = one_of_each(new, key, order, F.max_by)
    if stored is None:
        return Written(unique, unique.select(key, F.lit("created").alias("outcome")))
    joined = stored.withColumn("_old", F.lit(True)).alias("o").join(
        unique.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer"
    )
    columns = []
    for c in stored.columns:
        if c == key:
            columns.append(F.col(key))
        elif c in mutable:
            columns.append(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("_old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    outcomes = joined.where("_new").select(
        key, F.when(F.col("_old"), "updated").otherwise("created").alias("outcome")
    )
    return Written(joined.select(*columns), outcomes)


def audit_rows(
    outcomes: DataFrame, key: str, entity: str, at=None, actor: str = "system", details: Sequence[str] = ()
) -> DataFrame:
    """Audit entries ``<entity>.<outcome>`` for the outcomes of a stage.

    The audit key is a hash of action, target, actor and time, so a rerun of the same
    stage at the same time writes the same keys.
    """
    moment = F.current_timestamp() if at is None else at
    action = F.concat(F.lit(f"{entity}."), F.col("outcome"))
    return outcomes.select(
        short_id("audit-", action, ":", F.col(key), ":", F.lit(actor), ":", moment.cast("string"), length=32).alias("audit_id"),
        moment.alias("timestamp"),
        F.lit(actor).alias("actor"),
        action.alias("action"),
        F.col(key).alias("target"),
        F.lit("accepted").alias("result"),
        F.to_json(F.struct(key, "outcome", *details)).alias("metadata_json"),
    )


def append_audit(parts: Sequence[DataFrame], path: str | None = None) -> DataFrame:
    """Union of the stages' audit rows, appended to ``path`` if one is given.

    Entries whose id is in the log already are not appended again; only the dates that the new
    entries have are looked at.
    """
    log = parts[0].select(*AUDIT_COLUMNS)
    for part in parts[1:]:
        log = log.unionByName(part.select(*AUDIT_COLUMNS))
    if path is not None:
        log = log.dropDuplicates(["audit_id"]).withColumn("day", F.to_date("timestamp"))
        known = _audit_log(log.sparkSession, path)
        if known is not None:
            days = [r[0] for r in log.select("day").distinct().collect()]
            log = log.join(known.where(F.col("day").isin(days)).select("audit_id"), "audit_id", "left_anti")
        log.write.mode("append").partitionBy("day").parquet(path)
        log = log.drop("day")
    return log


def _audit_log(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(folder) else None
