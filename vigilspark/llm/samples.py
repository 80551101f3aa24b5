"""Bounded samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import texts_of

#: Texts longer than this share of the code points are drawn only after all others.
SHARE = 1 / 16


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, eligible: Column, classes: list, rows: int, chars: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> list[tuple[str, object]]:
    """(text, label) of at most ``rows`` rows and ``chars`` code points for each of ``classes``, on the driver.

    Rows are taken in the order of a hash of their id, so the choice doesn't depend on how the data are
    parted; the bounds make it a few thousand texts, however large the input. Texts longer than
    ``SHARE`` of ``chars`` come after the others. A text that doesn't fit into what is left of
    ``chars`` is passed over, and those after it are still drawn. If no text of a class fits, its shortest
    one is drawn whole, so no class that has texts is without a sample. ``eligible`` is a
    condition on ``id``. Null ids, labels and texts take no part; of a repeated id the largest label
    and the first text by sort order are used.
    """
    texts = texts_of(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & (F.col("text") != "")).withColumnRenamed("doc_id", "id")
    marks = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("id is not null and label is not null").where(eligible)
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    sized = texts.where(eligible).groupBy("id").agg(F.max(F.length("text")).alias("size"))
    known = sized.join(marks, "id")
    size = F.col("size")
    turn = F.when(size <= chars * SHARE, 0).when(size <= chars, 1).otherwise(size)  # what can't fit is last, the shortest first
    drawn: list[tuple[str, object]] = []
    for value in classes:
        first = known.where(F.col("label") == F.lit(value)).orderBy(turn, F.xxhash64("id"), "id").limit(rows)
        within, left = [], chars
        for row in first.select("id", "size").collect():  # at most ``rows`` rows
            if row["size"] <= left or not within:
                within.append((row["id"],))
                left -= row["size"]
        if not within:
            continue
        ids = docs.sparkSession.createDataFrame(within, StructType([first.schema["id"]]))
        found = texts.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        drawn += [(r["text"], value) for r in sorted(found.collect(), key=lambda r: r["id"])]
    return drawn
