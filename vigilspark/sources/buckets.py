"""Tables that are merged into bucket by bucket.

A row's bucket is a hash of its key and a folder of the table. A merge reads the buckets that its
keys fall into, joins there, and overwrites just these (dynamic partition overwrite), so its cost
follows the batch and not the table. Every row names the batch that brought it. A batch
that is merged again, after a job died half way, finds its own rows and gives the same table and outcomes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .sinks import one_of_each

BUCKETS = 1000
#: Names of the table's own columns.
BUCKET, BROUGHT = "bucket", "brought_by"


@dataclass(frozen=True)
class Merged:
    #: (key, outcome): created, updated or duplicate.
    outcomes: DataFrame
    #: Buckets that were written.
    buckets: list[int]


class BucketTable:
    """``path`` holds one folder a bucket; ``schema`` is that of the rows without the table's own columns.

    The number of buckets belongs to the table and must stay; take it so that a bucket is a few files' worth.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = BUCKETS):
        if {BUCKET, BROUGHT} & set(schema.names):
            raise ValueError(f"columns {BUCKET} and {BROUGHT} are the table's own")
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def _stored(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(BROUGHT, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        try:
            return self.spark.read.schema(full).option("basePath", self.path).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def merge(self, new: DataFrame, batch: str | int, mutable: Sequence[str] | None = None, order: str | None = None) -> Merged:
        """Adds rows with new keys. With ``mutable``, known keys get the new values of these columns (S09), else they stay.

        Of several new rows of a key the last by ``order`` counts, the first where known keys stay. Null keys are
        keys like others. ``batch`` names the batch; merged again, it creates what it created before.
        """
        pick = F.min_by if mutable is None else F.max_by
        unique = one_of_each(new.select(*self.schema.names), self.key, order, pick)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        unique = stage(unique.withColumn(BUCKET, bucket), "merge")
        touched = sorted(r[0] for r in unique.select(BUCKET).distinct().collect())  # at most as many as there are buckets
        if not touched:
            return Merged(unique.select(self.key, F.lit("created").alias("outcome")), [])
        there = self._stored().where(F.col(BUCKET).isin(touched)).withColumn("_old", F.lit(True)).alias("o")
        here = unique.withColumn("_new", F.lit(True)).alias("n")
        both = there.join(here, (F.col(f"o.{BUCKET}") == F.col(f"n.{BUCKET}")) & F.col(f"o.{self.key}").eqNullSafe(F.col(f"n.{self.key}")), "full_outer")
        newer = F.col("_new") & F.lit(mutable is not None)
        columns = [
            F.when(newer if c in (mutable or ()) else F.col("_old").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in self.schema.names
        ]
        mine = F.col("_old").isNull() | (F.col(f"o.{BROUGHT}") == str(batch))
        outcome = F.when(F.col("_new"), F.when(mine, "created").otherwise("duplicate" if mutable is None else "updated")).alias("_outcome")
        rows = both.select(
            *columns, F.coalesce(F.col(f"o.{BROUGHT}"), F.lit(str(batch))).alias(BROUGHT), F.coalesce(F.col(f"o.{BUCKET}"), F.col(f"n.{BUCKET}")).alias(BUCKET), outcome
        )
        rows = stage(rows, "merged")
        # one task a bucket's rows would be one file each; larger ones are split by the writer's own size limits
        rows.drop("_outcome").repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return Merged(rows.where("_outcome is not null").select(self.key, F.col("_outcome").alias("outcome")), touched)
