"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side is at most so many rows of a few fixed-width columns; beyond it a shuffle join runs.
BROADCAST_ROWS = 500_000
#: Documents handed to Python at once, so that long texts don't fill a worker's memory.
ARROW_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under names of our own; a null text counts as the empty text."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows of texts apart: id and text, as a struct that sorts by id (null ids last) and is never null.

    The text is given by two 64-bit hashes; a null text counts as the empty one.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return F.struct(docs[id_col].isNull().alias("no_id"), docs[id_col].alias("id"), F.xxhash64(text).alias("hash"), F.xxhash64(F.lit(1), text).alias("more"))


def remainder(id_col: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids count as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))
    return (F.crc32(text) % of).cast("int")


def per_document(docs: DataFrame, fn: Callable[[], Callable[[list], dict[str, Iterable]]], schema: str) -> DataFrame:
    """Map (doc_id, text) batch by batch; ``fn()`` is called once a task and gives the function of a list of texts.

    The function's columns follow doc_id, in the order of ``schema`` (Spark DDL without doc_id).
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = fn()
        for batch in batches:
            columns = of_texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values())],
                names=["doc_id", *columns],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {schema}")


def small_side(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the counted ``rows`` are within ``bound``; else Spark shuffles."""
    return F.broadcast(df) if rows <= bound else df


class Memo(dict):
    """Results of a pure function by key, ``most`` at once. When half of them are new since the last
    time, those before are forgotten unless they are asked for again, so frequent keys stay."""

    def __init__(self, fn: Callable, most: int):
        super().__init__()
        self.fn, self.half, self.before = fn, max(1, most // 2), {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value
