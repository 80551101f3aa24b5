"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from its distinct words; the document is
toxic unless all its sentences are not (noisy-or). Only documents are labelled; the fit finds which
sentences, and so which words and word beginnings, account for the labels, and the same scores
locate the offending sentences.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, per_document, remainder, texts_of
from .samples import labelled_sample

#: Bound of the fitting sample: labelled rows of each label, and their code points.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 8_000_000
BINS = 1 << 18
#: Lengths of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
#: A feature is learned only if so many documents of the sample have it.
LEAST_DOCS = 3
#: Weights that small at the end are the penalty's noise.
NEGLIGIBLE = 0.2
SENTENCE = re.compile(r"[^.!?\n]+")
STRIP = "\"'()[]{}<>.,;:!?*#$%&|~-_/\\"
MEMO = 400_000


def features(word: str) -> list[int]:
    """Bins of the word and of its beginnings."""
    word = word.strip(STRIP).lower()
    if not word:
        return [0] * (1 + len(BEGINNINGS))
    return [_bin("w" + word), *(_bin(f"{n}{word[:n]}") if len(word) >= n else 0 for n in BEGINNINGS)]


def _bin(feature: str) -> int:
    return 1 + zlib.crc32(feature.encode()) % (BINS - 1)


def sentences(text: str) -> list[str]:
    return SENTENCE.findall(text) or [""]


def fit(sample: list[tuple[str, int]], rounds: int = 120, rate: float = 0.1, l1: float = 0.03) -> tuple[np.ndarray, float]:
    """Weights by bin (bin 0: none) and the bias, by Adam on the noisy-or likelihood, with an L1 penalty of ``l1`` over the square root of the sample's size.

    Both labels weigh the same, whatever their numbers."""
    words: dict[str, int] = {}
    of_word, word_sentence, sentence_doc = array("i"), array("i"), array("i")
    for d, (text, _) in enumerate(sample):
        for sentence in sentences(text):
            own = {words.setdefault(w, len(words)) for w in sentence.split()}
            of_word.extend(own)
            word_sentence.extend([len(sentence_doc)] * len(own))
            sentence_doc.append(d)
    weights, bias = np.zeros(BINS), -4.0
    labels = np.array([float(y) for _, y in sample])
    if not len(of_word) or labels.min(initial=1) == labels.max(initial=0):
        share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
        return weights, math.log(share / (1 - share))
    bins = np.fromiter((b for w in words for b in features(w)), np.int32, len(words) * (1 + len(BEGINNINGS))).reshape(len(words), -1)
    distinct = len(words)
    del words
    of_word, word_sentence, sentence_doc = (np.frombuffer(x, np.int32) for x in (of_word, word_sentence, sentence_doc))
    documents = np.zeros(BINS, np.int32)
    for own in np.split(of_word, np.searchsorted(sentence_doc[word_sentence], np.arange(1, len(labels)))):
        documents[np.unique(bins[own])] += 1
    frequent = documents >= LEAST_DOCS
    used, bins = np.unique(np.where(frequent[bins], bins, 0), return_inverse=True)
    bins = bins.reshape(distinct, -1)
    balance = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    value = np.zeros(len(used) + 1)
    value[-1] = bias
    for penalty in (l1 / math.sqrt(len(labels)), 0.0):  # first choose the features, then fit the chosen ones without shrinking them
        mean, square = np.zeros_like(value), np.zeros_like(value)
        free = np.append(np.abs(value[:-1]) >= NEGLIGIBLE, True) if penalty == 0 else np.ones(len(value), bool)
        value *= free
        if penalty == 0:  # only words that have a chosen feature matter from here on
            telling = (free[bins] & (used[bins] > 0)).any(1)[of_word]
            of_word, word_sentence = of_word[telling], word_sentence[telling]
        for k in range(1, rounds + 1):
            own = np.where(used == 0, 0.0, value[:-1])
            z = value[-1] + np.bincount(word_sentence, own[bins].sum(1)[of_word], len(sentence_doc))
            none = np.bincount(sentence_doc, np.logaddexp(0, z), len(labels))  # minus the log of "no sentence is toxic"
            slope = np.where(labels == 1, -1 / np.expm1(np.clip(none, 1e-9, 500)), 1.0) * balance
            of_sentence = slope[sentence_doc] / (1 + np.exp(-np.clip(z, -500, 500)))
            of_words = np.bincount(of_word, of_sentence[word_sentence], distinct)
            gradient = np.append(np.bincount(bins.ravel(), np.repeat(of_words, bins.shape[1]), len(used)), of_sentence.sum())
            gradient[:-1] += penalty * np.sign(value[:-1])
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            value -= free * rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-6)
    weights[used] = value[:-1]
    weights[0] = 0
    return weights, float(value[-1])


class Scorer:
    def __init__(self, bins: np.ndarray, values: np.ndarray, bias: float, memo: int = MEMO):
        self.weights, self.bias = np.zeros(BINS), bias
        self.weights[bins] = values
        self.words = Memo(lambda w: float(self.weights[features(w)].sum()), memo)

    def sentence(self, sentence: str) -> float:
        return self.bias + sum(map(self.words.__getitem__, set(sentence.split())))

    def score(self, text: str) -> float:
        """Noisy-or of the sentences' probabilities."""
        total = 0.0
        for z in map(self.sentence, sentences(text)):
            total += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(max(z, -700.0)))
        return -math.expm1(-total)

    def offending(self, text: str, least: float) -> list[dict]:
        """Sentences whose own probability reaches ``least``: start and end (code points) and the probability.

        If none does, the most probable ones, as many as reach it together (noisy-or), or all.
        """
        every = []
        for m in SENTENCE.finditer(text):
            p = 1 / (1 + math.exp(-max(min(self.sentence(m[0]), 700.0), -700.0)))
            every.append({"start": m.start(), "end": m.end(), "score": p})
        found = [s for s in every if s["score"] >= least]
        if not found:
            none = 1.0
            for s in sorted(every, key=lambda s: -s["score"]):
                found.append(s)
                none *= 1 - s["score"]
                if 1 - none >= least:
                    break
        return sorted(found, key=lambda s: s["start"])


_SCORERS: dict[bytes, Scorer] = {}
SPANS = "array<struct<start:int,end:int,score:double>>"


def eligible_labels(hold_of: int, held: int) -> Column:
    return F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder("doc_id", hold_of) != held)


def toxicity_model(docs: DataFrame, labels: DataFrame, hold_of: int = 4, held: int = 2, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[np.ndarray, np.ndarray, float]:
    """(bins, weights, bias) fitted on at most ``rows`` rows and ``chars`` code points of each label, none of them held out.

    ``held=-1`` holds none out. Without labels of both kinds every text gets the labels' mean. All labels that aren't
    held out are counted for the proportion of toxic ones.
    """
    sample = labelled_sample(docs, labels, "toxic", remainder("id", hold_of) != held, [0, 1], rows, chars)
    weights, bias = fit(sample)
    bins = np.flatnonzero(weights)
    counts = dict(labels.where(eligible_labels(hold_of, held)).groupBy(F.col("toxic").cast("int")).count().collect())
    # the fit weighs both labels alike; the corpus has them in other proportions, which moves the bias by their log odds
    odds = math.log(counts[1] / counts[0]) if counts.get(0) and counts.get(1) and len(bins) else 0.0
    return bins, weights[bins], bias + odds


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, score (0 to 1), offending (of texts whose score reaches ``threshold``, the sentences
    whose own score reaches it, or else the most probable ones that reach it together).

    A null text is the empty text: one sentence without words, so the bias alone scores it. Rows are
    kept as they come, repeated and null ids included; other columns are ignored. Nothing is
    shuffled; the model has at most ``BINS`` weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        bins, values, bias = shared.value
        key = bins.tobytes() + values.tobytes() + repr(bias).encode()
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(bins, values, bias)

        def of(texts: list[str]) -> dict:
            scores = list(map(scorer.score, texts))
            spans = [scorer.offending(t, threshold) if s >= threshold else [] for t, s in zip(texts, scores)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return {"score": pa.array(scores, pa.float64()), "offending": pa.array(spans, kind)}

        return of

    return per_document(texts_of(docs, id_col, text_col), start, f"score double, offending {SPANS}")


def keep_civil(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``threshold``; all columns stay. A null text is scored as the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([scorer.score(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
