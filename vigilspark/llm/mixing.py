"""Mixing sources to target weights.

Words are summed by source; the sources' weights divide the total, no source is repeated more than
``most`` times, and what such a source can't take goes to the others by weight. A source's rate is
its target over its size: each document is taken floor(rate) times, and once more if a draw, hashed
from its id and text, falls below the fraction. So reruns agree, and no document depends on another.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import small_side

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"
#: Bytes that part words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def n_words(data: bytes) -> int:
    """Words of UTF-8 text: a word begins wherever no blank follows a blank or the start."""
    blank = BLANK[np.frombuffer(data, np.uint8)]
    return int(np.count_nonzero(blank[:-1] & ~blank[1:])) + (not blank[0]) if len(data) else 0


def _draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash; equal rows draw alike."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, source, draw, size): each row's words and its draw; a null text has none."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), _draw(docs[id_col], text, seed).alias("draw"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([n_words(t.encode()) if t else 0 for t in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes], names=["doc_id", "source", "draw", "size"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, draw double, size bigint")


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, their number from 0 in code-point order, null last; ranges are counted
    first, so no task sees all of them."""
    ranges = stage(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranges.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("its"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return ranges.withColumn("inside", F.row_number().over(inside)).join(shift, F.col("part") == F.col("its")).select(
        "source", "source_size", (F.col("before") + F.col("inside") - 1).alias("place")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows with ``source`` and ``size``.

    In code-point order, null last, sources weigh ``weights``, repeating. The level is the
    words for a weight of 1: sources whose ``most`` sizes lie at or below their weight's share are full; the
    rest of the total over the rest of the weights is the next level. It only rises, and
    ends where no further source fills up. Sizes of nothing give targets of 0; no rows give no rows.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("bigint")
    sources = stage(_numbered(summed).withColumn("weight", weight), "weighted")
    wide = "decimal(20,0)"

    def full(rest: int, shares: int) -> Column:
        return F.col("source_size").cast(wide) * F.lit(Decimal(most * shares)) <= F.col("weight").cast("decimal(4,0)") * F.lit(Decimal(rest))

    total, whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, shares = total, whole
    while shares:
        taken, gone = sources.where(full(rest, shares)).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (total - most * taken, whole - gone) == (rest, shares):
            break
        rest, shares = total - most * taken, whole - gone
    share = (F.col("weight").cast(wide) * F.lit(Decimal(rest))).cast("double") / F.lit(float(max(shares, 1)))
    target = F.when(full(rest, shares), (F.col("source_size") * most).cast("double")).otherwise(share)
    return stage(sources.select("source", "source_size", target.alias("target")), "targets")


def _copies(draw: Column, most: int) -> Column:
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def _with_targets(rows: DataFrame, source: Column, targets: DataFrame) -> DataFrame:
    """Each row's source joined; broadcast only if the counted sources are few, else Spark splits hot sources."""
    named = targets.withColumnRenamed("source", "its_source")
    return rows.join(small_side(named, targets.count()), source.eqNullSafe(F.col("its_source"))).drop("its_source")


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), copies, taken (size times copies).

    Sizes are written once, as they serve the sums and the rows. Repeated rows draw alike, null ids draw
    by their text. Other columns are ignored. An empty table gives no rows.
    """
    rows = stage(sized(docs, id_col, text_col, source_col, seed), "sized")
    placed = _with_targets(rows, F.col("source"), source_targets(rows, weights, most))
    return placed.withColumn("copies", _copies(F.col("draw"), most)).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, copy_col: str = "copy",
) -> DataFrame:
    """The mix itself: all columns of ``docs``, each row as often as the plan has it, numbered from 1 in ``copy_col``.

    The rows' own columns may have any names but ``copy_col``: they travel inside a struct.
    """
    targets = source_targets(sized(docs, id_col, text_col, source_col, seed), weights, most)
    rows = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[source_col].cast("string").alias("source"), _draw(docs[id_col], docs[text_col], seed).alias("draw")
    )
    placed = _with_targets(rows, F.col("source"), targets).withColumn("copies", _copies(F.col("draw"), most)).where("copies > 0")
    return placed.select("row.*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias(copy_col))
