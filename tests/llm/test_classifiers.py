"""Held-out accuracy on the given tables, and what the fits promise."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.llm import language, quality, queries, toxicity
from vigilspark.llm.common import remainder

SF = "/root/testdata/sf0.1"


def held(i, of, is_):
    return zlib.crc32(str(i).encode()) % of == is_


@pytest.fixture(scope="module")
def truth(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return {r["doc_id"]: r for r in docs.join(labels, "doc_id", "left").collect()}


def test_remainder(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 5, -7, 10**12)], "id bigint").select("id", remainder("id", 4).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in rows)


def test_language_held_out(spark, truth):
    rows = queries.op2_language(spark, SF).collect()
    assert len(rows) == len(truth)
    test = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in test} == {i for i in truth if held(i, 4, 2)}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in test]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_held_out(spark, truth):
    rows = [r for r in queries.op7_quality(spark, SF).collect() if r["held_out"] and truth[r["doc_id"]]["quality"] is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]]["quality"] for r in rows]) > 0.98
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_held_out(spark, truth):
    rows = [r for r in queries.op8_toxicity(spark, SF).collect() if r["held_out"] and truth[r["doc_id"]]["toxic"] is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]]["toxic"] for r in rows]) > 0.98


def test_offending_sentences_are_located(spark):
    """Only documents are labelled; the sentence with the word that makes them toxic is found."""
    draw = np.random.default_rng(1)
    calm = [f"calm{k}" for k in range(60)]

    def text(bad):
        parts = [" ".join(draw.choice(calm, 8)) for _ in range(6)]
        if bad:
            parts[draw.integers(6)] += " vile thing"
        return ". ".join(parts) + "."

    sample = [(text(k % 2), k % 2) for k in range(400)]
    weights, bias = toxicity.fit(sample)
    bins = np.flatnonzero(weights)
    docs = spark.createDataFrame([(k, text(k % 2)) for k in range(40)] + [(90, None), (91, "")], "doc_id bigint, text string")
    for row in toxicity.score_toxicity(docs, (bins, weights[bins], bias)).join(docs, "doc_id").collect():
        spans = [row["text"][s["start"] : s["end"]] for s in row["offending"]]
        assert bool(spans) == (row["doc_id"] % 2 == 1 and row["doc_id"] < 90) and all("vile" in s for s in spans) and len(spans) <= 1


def test_weaker_sentences_are_located_together(spark):
    weights = np.zeros(toxicity.BINS)
    for word, p in (("mean", 0.2), ("bad", 0.18), ("vile", 0.6)):
        weights[toxicity.features(word)[0]] = np.log(p / (1 - p)) + 6
    bins = np.flatnonzero(weights)
    texts = ["it is mean. calm day. it is bad. calm", "it is mean. calm day", "it is mean. so vile. it is bad", "calm", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, (bins, weights[bins], -6.0)).collect()}
    assert [rows[k]["score"] >= 0.3 for k in range(6)] == [True, False, True, False, False, False]
    located = [[(texts[k] or "")[s["start"] : s["end"]].strip() for s in rows[k]["offending"]] for k in range(6)]
    assert located == [["it is mean", "it is bad"], [], ["so vile"], [], [], []]


def test_frequencies_and_samples(spark):
    docs = spark.createDataFrame([(i, "ab" if i % 2 else "zz zz", "x" if i % 2 else "y") for i in range(50)] + [(60, "lost", None), (None, "lost", "x"), (61, None, "x")], "doc_id bigint, text string, lang string")
    found, total = language.document_frequencies(docs.where("doc_id < 50"))
    assert total == 50 and set(found) == {0, 25}
    model = language.language_model(docs, rows=10)
    assert model.languages == ["x", "y"]
    drawn = language.labelled_sample(docs, docs, "lang", F.col("id") > 5, ["x", "y"], 7, 10**6)
    assert len(drawn) == 14 and all(t == {"x": "ab", "y": "zz zz"}[v] for t, v in drawn)
    assert len(language.labelled_sample(docs, docs, "lang", F.lit(True), ["y"], 100, 23)) == 4  # bounded by code points


def test_long_texts_dont_empty_a_class(spark):
    order = [r["id"] for r in spark.range(40).orderBy(F.xxhash64("id"), "id").collect()]
    long = {order[0]: "a" * 101, order[1]: "b" * 90, order[2]: "c" * 90}  # one that never fits, two of which one would fill the bound
    docs = spark.createDataFrame([(i, long.get(i, f"t{i:03d}"), "x") for i in order], "doc_id bigint, text string, lang string")
    draw = lambda docs, rows, chars: language.labelled_sample(docs, docs, "lang", F.lit(True), ["x"], rows, chars)
    assert {t for t, _ in draw(docs, 100, 100)} == {f"t{i:03d}" for i in order[3:28]}
    assert {t for t, _ in draw(docs, 5, 100)} == {f"t{i:03d}" for i in order[3:8]}
    assert {t for t, _ in draw(docs, 100, 240)} == {f"t{i:03d}" for i in order[3:]} | {"b" * 90}  # 148 + 90; the first doesn't fit any more
    only = docs.where(F.length("text") > 4)
    assert [t for t, _ in draw(only, 100, 150)] == ["a" * 101]
    assert draw(only, 100, 50) in ([("b" * 90, "x")], [("c" * 90, "x")])  # the shortest, as none fits


def test_ngrams_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Zwölf Boxkämpfer 日本語 " * 30
    whole = language.counts(text)
    monkeypatch.setattr(language, "CHUNK", 17)
    assert (language.counts(text) == whole).all() and whole.sum() == 3 * len(text) - 3


def test_temperature_lowers_the_loss():
    draw = np.random.default_rng(2)
    classes = draw.integers(0, 3, 400)
    logits = 8 * draw.normal(size=(400, 3))
    logits[np.arange(400), classes] += 4
    t = language.calibrate(logits, classes)
    loss = lambda t: -np.log(language.softmax(logits / t)[np.arange(400), classes]).mean()
    assert t > 1.5 and loss(t) < loss(1.0) and loss(t) <= min(loss(t * 1.1), loss(t / 1.1)) + 1e-9


def test_training_is_sparse():
    draw = np.random.default_rng(3)
    bins = [np.sort(draw.choice(900, 30, replace=False)) + 10 for _ in range(200)]
    classes = draw.integers(0, 2, 200)
    documents = [(np.append(b, c), np.append(np.full(30, 0.1), 0.9)) for b, c in zip(bins, classes)]
    weights = language.train(documents, classes, 2)
    assert np.count_nonzero(weights) < 1400 and all((weights[c] > 0).argmax() == c for c in (0, 1))


def test_ranking_prefers_the_better():
    good = [(f"Words that make sense, number {k}. And more of them.", 1) for k in range(60)]
    bad = [("$$$ buy *** now ### " * (k % 7 + 1), 0) for k in range(60)]
    weights, cut, _ = quality.fit(good + bad)
    scores = [quality.features(t) @ weights for t, _ in good + bad]
    assert min(scores[:60]) > cut > max(scores[60:])


def test_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for docs in (odd_documents, no_documents):
        n = docs.count()
        model = language.language_model(docs)
        assert model is None
        rows = language.identify(docs, model).collect()
        assert len(rows) == n and {r["lang_pred"] for r in rows} <= {"und"}
        taught = language.language_model(odd_documents.withColumn("lang", F.lit("xx")))
        rows = language.identify(docs, taught).collect()
        assert len(rows) == n and all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (0, 1, 2, 4))
        for labelled in (labels, labels.limit(0)):
            scores = [r["score"] for r in quality.score_quality(docs, quality.quality_model(docs, labelled)).collect()]
            scores += [r["score"] for r in toxicity.score_toxicity(docs, toxicity.toxicity_model(docs, labelled)).collect()]
            assert len(scores) == 2 * n and all(0 <= s <= 1 for s in scores)
        kept = toxicity.keep_civil(docs, toxicity.toxicity_model(docs, labels), 2.0)
        assert kept.columns == docs.columns and kept.count() == n


def test_quality_is_fitted_on_all_labelled_documents(spark, monkeypatch):
    """Every labelled document moves the moments, takes part in pairs and counts for the cut."""
    monkeypatch.setattr(quality, "BLOCK_ROWS", 500)
    text = lambda k: ("#" if k % 400 == 0 else "") + "word " * (k % 50 + 1) + f"x{k}"
    docs = spark.range(8000).rdd.map(lambda r: (r.id, text(r.id))).toDF("doc_id bigint, text string")
    labels = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 400 != 0).cast("int").alias("quality"))
    paired, whole = [], quality.newton

    def watched(sums, size):
        paired.append(sums(np.zeros(size))[0])
        return whole(sums, size)

    monkeypatch.setattr(quality, "newton", watched)
    weights, cut, _ = quality.quality_model(docs, labels, held=-1)
    assert paired[0] >= quality.PAIRS // 2 * 8000  # 20 rows of the rarer label are paired with all others
    scores = [quality.features(text(k)) @ weights for k in range(8000)]
    assert max(scores[::400]) < cut + 1e-4 and sum(s < cut - 1e-4 for s in scores) <= 20
    alike, n = quality.labelled_features(docs.union(docs), labels, 5, -1), 8000
    assert alike.count() == n


def test_score_at_a_rank(spark):
    values = sorted(float(v) for v in np.random.default_rng(5).normal(size=3000).round(2))
    scores = spark.createDataFrame([(v,) for v in values], "score double")
    assert [quality._at_rank(scores, k, few=10, bins=8) for k in (0, 1, 1500, 2999)] == [values[k] for k in (0, 1, 1500, 2999)]
