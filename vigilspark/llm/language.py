"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three lower-cased characters fall into bins. Document frequencies are counted over
all documents that may be learned from. The weights are trained by follow-the-regularised-leader with
elastic-net penalties, one document at a time, so most stay zero; a temperature, chosen on
documents that the weights were not trained on, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_document, remainder, texts_of
from .samples import labelled_sample

#: Bound of the fitting sample: rows of each language, and their code points; at most so many languages.
SAMPLE_ROWS, SAMPLE_CHARS, MOST_LANGUAGES = 600, 2_000_000, 200
BINS = 1 << 14
ORDERS = (1, 2, 3)
#: Code points turned into n-grams at once.
CHUNK = 1 << 18
UNKNOWN = "und"
#: Fixed odd multipliers that spread n-grams over the bins.
SPREAD = tuple(np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def counts(text: str) -> np.ndarray:
    """How often each bin occurs in the whole text; pieces overlap, so no n-gram is lost or counted twice."""
    found = np.zeros(BINS, np.int64)
    text = text.lower()
    for k in range(0, len(text), CHUNK):
        points = np.frombuffer(text[k : k + CHUNK + ORDERS[-1] - 1].encode("utf-32-le", "replace"), np.uint32)
        own = min(CHUNK, len(text) - k)
        gram = np.zeros(len(points), np.uint32)
        for order in ORDERS:
            n = len(points) - order + 1
            if n <= 0:
                break
            gram = gram[:n] * np.uint32(0x01000193) + points[order - 1 :]
            bins = (gram[:own] * SPREAD[order - 1]) >> np.uint32(32 - 14)
            found += np.bincount(bins, minlength=BINS)
    return found


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents in which each bin occurs, and all documents; one row a bin and task is summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += counts(text) > 0
                n += 1
        bins = np.flatnonzero(seen)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(bins, -1)), pa.array(np.append(seen[bins], n))], names=["bin", "n"])

    summed = texts.select("text").mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    found, total = np.zeros(BINS, np.int64), 0
    for row in summed.collect():  # at most BINS + 1 rows
        if row["bin"] < 0:
            total = row["n"]
        else:
            found[row["bin"]] = row["n"]
    return found, total


def weighted(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and TF-IDF values of unit length."""
    bins = np.flatnonzero(found)
    values = np.log1p(found[bins]) * idf[bins]
    return bins, values / max(1e-12, float(np.sqrt(values @ values)))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  #: bins x languages, and the biases in the last row
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        bins, values = weighted(counts(text), self.idf)
        return softmax((values @ self.weights[bins] + self.weights[-1]) / self.temperature)


def train(
    documents: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, languages: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3,
) -> np.ndarray:
    """Follow the regularised leader, proximal form: z gathers gradients, n their squares; weights are derived as they are needed."""
    z, n = np.zeros((BINS + 1, languages)), np.zeros((BINS + 1, languages))

    def derived(rows: np.ndarray) -> np.ndarray:
        zr = z[rows]
        return np.where(np.abs(zr) <= l1, 0.0, -(zr - np.sign(zr) * l1) / ((beta + np.sqrt(n[rows])) / alpha + l2))

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(documents)):
            bins, values = documents[k]
            rows, x = np.append(bins, BINS), np.append(values, 1.0)
            w = derived(rows)
            p = softmax(x @ w)
            p[classes[k]] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    return derived(np.arange(BINS + 1))


def calibrate(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search of its logarithm."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(logits)), classes], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def language_model(docs: DataFrame, hold_of: int = 4, held: int = 2, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fitted on documents that are not held out and have a language; None if there are none.

    Document frequencies are over all of them, the weights over at most ``rows`` rows and ``chars``
    code points of each language, the temperature over every fifth of these, which the weights don't see.
    """
    eligible = remainder("id", hold_of) != held
    known = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("lang is not null and text is not null and id is not null").where(eligible)
    languages = [r[0] for r in known.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if not languages:
        return None
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    frequencies, total = document_frequencies(known)
    idf = np.log((1 + total) / (1 + frequencies)) + 1
    sample = labelled_sample(docs, docs, lang_col, eligible, languages, rows, chars, id_col, text_col)
    vectors = [weighted(counts(text), idf) for text, _ in sample]
    classes = np.array([languages.index(lang) for _, lang in sample], int)
    fold = np.arange(len(vectors)) % 5 == 4
    weights = train([v for v, f in zip(vectors, fold) if not f], classes[~fold], len(languages))
    logits = np.array([v @ weights[b] + weights[-1] for (b, v), f in zip(vectors, fold) if f]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, calibrate(logits, classes[fold]))


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (the calibrated probability of lang_pred).

    A null text, and one without any letter, gets ``und`` with score 0, as does every text when no
    model could be fitted. Rows are kept as they come, repeated and null ids included; other columns
    are ignored. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        fitted = shared.value

        def of(texts: list[str]) -> dict:
            names, scores = [], []
            for text in texts:
                if fitted is None or not has_letter(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = fitted.probabilities(text)
                names.append(fitted.languages[int(p.argmax())])
                scores.append(float(p.max()))
            return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

        return of

    return per_document(texts_of(docs, id_col, text_col), start, "lang_pred string, score double")
