"""Quality scores by Bradley-Terry pairwise ranking.

Pairs of a better and a worse document are preferences; the difference of their features, weighted,
is the log-odds that the better one is preferred. The weighted sum itself is then a document's score,
and the cut between good and bad is a quantile of the labelled documents' scores.

All labelled documents take part in the fit. Their features lie in blocks of ``BLOCK_ROWS`` rows, whose rows are
paired with one another; a Newton step adds up the gradients and curvatures of all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import per_document, remainder, texts_of

#: Rows of a block on average.
BLOCK_ROWS = 1024
#: Preference pairs: each row is in so many on average, and in some at least.
PAIRS = 16
#: Newton steps at most, and the decrease that a further one must promise.
STEPS, ENOUGH = 40, 1e-7
#: Bytes that have a feature each: all ASCII characters but letters; digits, small and large letters have one together.
MARKS = [b for b in range(128) if not chr(b).isalnum()]
DIGITS, UPPER, LOWER = slice(48, 58), slice(65, 91), slice(97, 123)
#: The score that stands for the cut.
CUT = 0.3


def features(text: str) -> np.ndarray:
    """What the text is made of: characters by kind, words, repetitions."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    alike = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    return np.array(
        [
            *np.sqrt(counts[MARKS] / size),
            math.sqrt(counts[DIGITS].sum() / size),
            math.sqrt(counts[UPPER].sum() / size),
            math.sqrt(counts[LOWER].sum() / size),
            math.sqrt(counts[128:].sum() / size),
            math.log1p(len(text)),
            math.log1p(len(words)),
            len(text) / n / 10,
            math.sqrt(alike / n),
            distinct / n,
            math.log(n / max(1, distinct)),
            1 - len(set(lines)) / m,
            math.log1p(n / m),
        ]
    )


def _cycled(ids: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    """``n`` of ``ids``, each equally often but for one time."""
    return np.concatenate([draw.permutation(ids) for _ in range(-(-n // len(ids)))])[:n]


def pair_sums(z: np.ndarray, y: np.ndarray, weights: np.ndarray, block: int = 0, pairs: int = PAIRS) -> np.ndarray:
    """Number of pairs within a block, their loss, its gradient and its curvature, one after another."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = max(pairs * len(y) // 2, len(y)) if len(good) and len(bad) else 0
    if not n:
        return np.zeros(2 + len(weights) + len(weights) ** 2)
    draw = np.random.default_rng([7, block])
    difference = z[_cycled(good, n, draw)] - z[_cycled(bad, n, draw)]
    margin = np.clip(difference @ weights, -500, 500)
    wrong = 1 / (1 + np.exp(margin))
    curvature = (difference * (wrong * (1 - wrong))[:, None]).T @ difference
    return np.concatenate([[n, np.logaddexp(0, -margin).sum()], -difference.T @ wrong, curvature.ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], size: int, l2: float = 1e-4) -> np.ndarray:
    """Weights with the least mean loss and penalty; ``sums`` gives the sums over all pairs at given weights."""
    weights, least, best = np.zeros(size), math.inf, np.zeros(size)
    for _ in range(STEPS):
        found = sums(weights)
        n = found[0]
        if not n:
            break
        loss = found[1] / n + l2 / 2 * weights @ weights
        if loss > least:  # too far
            weights = (weights + best) / 2
            continue
        least, best = loss, weights
        gradient = found[2 : 2 + size] / n + l2 * weights
        step = np.linalg.solve(found[2 + size :].reshape(size, size) / n + l2 * np.eye(size), gradient)
        if gradient @ step < ENOUGH:
            break
        weights = weights - step
    return best


def _scale(n: float, square: np.ndarray) -> np.ndarray:
    scale = np.sqrt(square / n)
    scale[scale < 1e-6] = np.inf  # features are stored with single precision
    return scale


def fit(sample: list[tuple[str, int]]) -> tuple[np.ndarray, float, float]:
    """``quality_model`` of texts that are in memory, as one block."""
    if not sample:
        return np.zeros(len(features(""))), 0.0, 1.0
    x = np.array([features(t) for t, _ in sample])
    y = np.array([label for _, label in sample])
    scale = _scale(len(x), ((x - x.mean(0)) ** 2).sum(0))
    weights = newton(lambda w: pair_sums((x - x.mean(0)) / scale, y, w), x.shape[1]) / scale
    scores = np.sort(x @ weights)
    below = int((y == 0).sum())  # the quantile at this share; between two scores, their middle
    low, high = scores[max(below - 1, 0)], scores[min(below, len(scores) - 1)]
    return weights, float((low + high) / 2), float(scores.std()) or 1.0


def labelled_features(docs: DataFrame, labels: DataFrame, hold_of: int, held: int) -> DataFrame:
    """(id, label, features) of every document with a label and a text that isn't held out.

    Of a repeated id the largest label and the smallest features are used; null ids and labels take no part.
    """
    texts = texts_of(docs).where(F.col("doc_id").isNotNull() & (F.col("text") != "")).where(remainder("doc_id", hold_of) != held)

    def start():
        def of(texts: list[str]) -> dict:
            found = np.array([features(t) for t in texts], np.float32)
            ends = np.arange(len(texts) + 1, dtype=np.int32) * found.shape[1]
            return {"features": pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))}

        return of

    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).where("id is not null and label in (0, 1)")
    marks = marks.groupBy("id").agg(F.max("label").cast("int").alias("label"))
    made = per_document(texts, start, "features array<float>").groupBy(F.col("doc_id").alias("id")).agg(F.min("features").alias("features"))
    return made.join(marks, "id").select("id", "label", "features")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _totals(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], add: Callable = np.add) -> np.ndarray | None:
    """``fn`` of all batches, added up: in the tasks, then one small array a task on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                total = fn(batch) if total is None else add(total, fn(batch))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    total = None
    for row in df.mapInArrow(run, "total binary").toLocalIterator():
        one = np.frombuffer(row["total"])
        total = one if total is None else add(total, one)
    return total


def _moments(batch: pa.RecordBatch) -> np.ndarray:
    x = _matrix(batch.column(0))
    return np.concatenate([[len(x)], x.mean(0), ((x - x.mean(0)) ** 2).sum(0)])


def _add_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row count, means and squared deviations of two sets of rows together."""
    n, size = a[0] + b[0], len(a) // 2
    apart = b[1 : 1 + size] - a[1 : 1 + size]
    return np.concatenate([[n], a[1 : 1 + size] + apart * b[0] / n, a[1 + size :] + b[1 + size :] + apart**2 * a[0] * b[0] / n])


def _at_rank(scores: DataFrame, rank: int, few: int = 1000, bins: int = 1000) -> float:
    """The score at this place in ascending order, from 0, by counting in ever narrower ranges."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while True:
        width = (high - low) / bins
        if not width or low + width == low:
            return low
        bin_ = F.least(F.floor((F.col("score") - low) / width), F.lit(bins - 1))
        counts = scores.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for row in sorted(counts.collect(), key=lambda r: r["bin"]):  # at most ``bins`` rows
            if rank < row["n"]:
                break
            rank -= row["n"]
        low, high = row["low"], row["high"]
        if low == high:
            return low
        scores = scores.where(F.col("score").between(low, high))
        if row["n"] <= few:
            return sorted(r["score"] for r in scores.collect())[rank]


def quality_model(docs: DataFrame, labels: DataFrame, hold_of: int = 5, held: int = 0) -> tuple[np.ndarray, float, float]:
    """(weights, cut, spread), fitted on all labelled documents that aren't held out (``held=-1``: all are used).

    Scores above the cut are better than the quantile at the share of label 0. Rows of the rarer label
    come into several blocks where they are too few for each block to have some.
    """
    known = stage(labelled_features(docs, labels, hold_of, held), "quality-features")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    size, n = len(features("")), sum(counts.values())
    if not n:
        return np.zeros(size), 0.0, 1.0
    moments = _totals(known.select("features"), _moments, _add_moments)
    mean, scale = moments[1 : 1 + size], _scale(n, moments[1 + size :])
    weights = np.zeros(size)
    if len(counts) == 2:
        blocks = -(-n // BLOCK_ROWS)
        rare = min(counts, key=counts.get)
        copies = min(blocks, -(-blocks * PAIRS // counts[rare]))
        turns = F.when(F.col("label") == rare, F.lit(copies)).otherwise(1)
        spread = known.withColumn("turn", F.explode(F.sequence(F.lit(1), turns))).select(
            F.pmod(F.xxhash64("id") + F.col("turn"), F.lit(blocks)).cast("long").alias("block"), "id", "label", "features"
        )

        def pack(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("id")
            x = rows["features"].combine_chunks()
            return pa.table({
                "block": pa.array([rows["block"][0].as_py()], pa.int64()),
                "labels": pa.array([rows["label"].to_numpy().astype(np.int8).tobytes()], pa.binary()),
                "features": pa.array([x.flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
            })

        packed = stage(spread.groupBy("block").applyInArrow(pack, "block long, labels binary, features binary"), "quality-blocks")

        def sums(weights: np.ndarray) -> np.ndarray:
            def of(batch: pa.RecordBatch) -> np.ndarray:
                total = 0
                for row in batch.to_pylist():
                    y = np.frombuffer(row["labels"], np.int8)
                    z = (np.frombuffer(row["features"], np.float32).reshape(len(y), -1) - mean) / scale
                    total = total + pair_sums(z, y, weights, row["block"])
                return total

            return _totals(packed, of)

        weights = newton(sums, size) / scale

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_matrix(batch.column(0)) @ weights)], names=["score"])

    scores = stage(known.select("features").mapInArrow(score, "score double"), "quality-scores")
    below = counts.get(0, 0)  # the quantile at this share; between two scores, their middle
    low, high = (_at_rank(scores, k) for k in (max(below - 1, 0), min(below, n - 1)))
    return weights, (low + high) / 2, scores.agg(F.stddev_pop("score")).first()[0] or 1.0


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1; the quantile cut is at ``CUT``).

    A null text is the empty text and is scored by its features like any other. Rows are kept as they
    come, repeated and null ids included; other columns are ignored. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        weights, cut, spread = shared.value
        at_cut = math.log(CUT / (1 - CUT))

        def of(texts: list[str]) -> dict:
            raw = np.array([features(t) @ weights for t in texts])
            logits = np.clip(4 * (raw - cut) / spread + at_cut, -500, 500)
            return {"score": pa.array(1 / (1 + np.exp(-logits)), pa.float64())}

        return of

    return per_document(texts_of(docs, id_col, text_col), start, "score double")
