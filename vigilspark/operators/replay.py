"""Replay of status logs as a parallel prefix over transition functions.

Each request acts on the state as a small function (state before -> state after), and functions
compose. The log is range partitioned by entity and order, so one with most of the rows spreads over
many tasks, and cut into chunks by row number. A chunk's functions compose to one; chunks' functions
compose level by level, a bounded number at a time, until an entity has one. On the way back
each chunk learns its start state, down to the single requests. No array is longer than a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Binary digits of the members of a chunk, and of the chunks that are composed at once.
CHUNK_BITS = 9
#: Rows in a partition, as ``monotonically_increasing_id`` numbers them.
ROW_BITS = 33


@dataclass(frozen=True)
class Replay:
    #: Every row with the states ``_old`` and ``_new``.
    rows: DataFrame
    #: (entity, state) after the last row.
    final: DataFrame


def _placed(rows: DataFrame, entity: str, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with a number ``_at`` that rises with (entity, order), and its binary digits."""
    ranges = rows.repartitionByRange(entity, *order).sortWithinPartitions(entity, *order)
    placed = stage(ranges.withColumn("_at", F.monotonically_increasing_id()), "log")
    inside = F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    last, part = placed.agg(F.coalesce(F.max(inside), F.lit(0)), F.coalesce(F.max(F.shiftright("_at", ROW_BITS)), F.lit(0))).first()
    bits = last.bit_length()
    return placed.withColumn("_at", F.shiftleft(F.shiftright("_at", ROW_BITS), bits) + inside), bits + part.bit_length()


def _walk(members: Column, start: Column, step) -> Column:
    """The state before each of ``members``."""
    return F.aggregate(
        members, F.struct(start.alias("state"), F.array().cast("array<int>").alias("starts")),
        lambda a, x: F.struct(step(a["state"], x).alias("state"), F.array_append(a["starts"], a["state"]).alias("starts")),
    )["starts"]


def replay(rows: DataFrame, entity: str, order: Sequence[str], code: str, step_table: Sequence[int], width: int, start: int, chunk_bits: int = CHUNK_BITS) -> Replay:
    """Follow ``code`` (below ``width``; negative: no effect) through ``step_table[state * width + code]`` from ``start``.

    Rows of an entity apply in ``order``; equal ones in any. Null is an entity like any other. Columns whose
    names begin with an underscore are reserved.
    """
    table, states = F.array(*map(F.lit, step_table)), range(len(step_table) // width)

    def by_code(state: Column, member: Column) -> Column:
        return F.when(member[code] >= 0, F.get(table, state * width + member[code])).otherwise(state)

    def by_act(state: Column, member: Column) -> Column:
        return F.get(member["_act"], state)

    def act(step) -> Column:
        return F.array(*[F.aggregate("_members", F.lit(s), step) for s in states])

    placed, bits = _placed(rows, entity, order)
    member = F.struct("_at", *[c for c in rows.columns if c != entity])
    levels: list[DataFrame] = []
    level, step = placed.select(entity, "_at", member.alias("_member")), by_code
    while True:
        level = level.groupBy(entity, F.shiftright("_at", chunk_bits).alias("_at")).agg(F.array_sort(F.collect_list("_member")).alias("_members"))
        level = stage(level.withColumn("_act", act(step)), "chunks")
        levels.append(level)
        bits -= chunk_bits
        if bits <= 0:
            break
        level, step = level.select(entity, "_at", F.struct("_at", "_act").alias("_member")), by_act
    top = levels.pop()
    final = top.select(entity, F.get("_act", F.lit(start)).alias("state"))
    started = top.withColumn("_start", F.lit(start))
    while levels:
        before = F.arrays_zip(F.col("_members._at").alias("_at"), _walk(F.col("_members"), F.col("_start"), by_act).alias("_start"))
        known = started.select(F.col(entity).alias("_of"), F.explode(before).alias("_x")).select("_of", "_x.*")
        lower = levels.pop().withColumnRenamed("_at", "_its")
        started = lower.join(known, F.col(entity).eqNullSafe(F.col("_of")) & (F.col("_its") == F.col("_at"))).select(entity, "_members", "_start")
    walked = started.select(entity, F.explode(F.arrays_zip(F.col("_members").alias("_member"), _walk(F.col("_members"), F.col("_start"), by_code).alias("_old"))).alias("_x"))
    decided = walked.select(entity, "_x._member.*", "_x._old").drop("_at").withColumn("_new", by_code(F.col("_old"), F.struct(code)))
    return Replay(decided.select(*rows.columns, "_old", "_new"), final)
