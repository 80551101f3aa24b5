"""Ranked search against scores of all documents; SQL does the same in the correctness run."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vigilspark.llm import lexical
from vigilspark.llm.lexical import Items, Search, count_terms, hierarchy, pieces, ranked_search, similar_order

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c in counts) + 1))) for t in own}
        scored = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed):
    draw = random.Random(seed)
    names = [f"T{k}é" if k % 5 == 0 else f"w{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    return [(i, "-".join(draw.choices(names, weights, k=draw.choice([0, 3, 20, 90])))) for i in range(n)]


@pytest.mark.parametrize("k, items_at_once", [(5, 512), (50, 3)])
def test_equals_all_scores(spark, monkeypatch, k, items_at_once):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", items_at_once)
    docs = corpus(900, 1)
    docs += [(2000 + i, docs[7][1]) for i in range(300)] + [(None, docs[7][1]), (5, docs[7][1]), (5, docs[7][1]), (3000, None), (3001, " , ")]
    items = [(i, t) for i, t in corpus(12, 2)] + [(100, docs[7][1]), (101, ""), (102, None), (None, "w1 w2"), (None, "w3"), (103, "none of these")]
    found = ranked_search(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), k
    )
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, k)


def test_bounds_hold_and_prune():
    """Node maxima bound every pair below them; documents unlike an item are never scored."""
    draw = np.random.default_rng(3)
    matrix = draw.integers(0, 9, (70, 30)).astype(float)
    levels = hierarchy(matrix, 16)
    assert len(levels[0]) == 1 and all((matrix[16 * i : 16 * i + 16] <= leaf).all() for i, leaf in enumerate(levels[-1]))
    order = similar_order(matrix, 16)
    assert sorted(order) == list(range(70))
    block = [(0, ["a"]), (1, ["b"])]
    search = Search(Items(block, {b"a": 0, b"b": 1}, np.array([5.0, 7.0]), 100, 1000), 3, np.zeros(2))
    ids, sizes = list(range(1600)), np.full(1600, 10)
    near = np.arange(1600) < 40  # only these have a term
    search.add(ids, sizes, near.astype(int), np.zeros(40, int), np.ones(40, int))
    assert [i for _, i in search.best[0]] == [0, 1, 2] and not search.best[1]
    assert search.scored <= 2 * 64  # of 3200 pairs


def test_pieces_and_terms():
    data = b"aa bb " + b"c" * 50 + b" d"
    assert b" ".join(pieces(data, 5)) == data and max(map(len, pieces(data, 5))) == 50
    draw = random.Random(4)
    for _ in range(300):
        text = "".join(draw.choices("aAzZ09_-\x00\x7f é😀 \x80", k=draw.randint(0, 14)))
        assert count_terms(text) == Counter(t.encode() for t in terms(text))


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "word another", 9), (2, "日本語 w5", 9)], "item_id bigint, text string, doc_id bigint")
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    found = ranked_search(odd_documents, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, [(1, "word another"), (2, "日本語 w5")], 50)
    assert ranked_search(no_documents, items).count() == 0 and ranked_search(odd_documents, items.limit(0)).count() == 0
