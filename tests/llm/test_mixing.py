"""Mixing against a plain water level and the plan against the rows it emits."""

import random
import re

import pytest

from vigilspark.llm.mixing import mix_documents, mix_plan, n_words, sized, source_targets


def level(sizes, weights, most=3):
    """Excess reshared by weight until no source is above its limit."""
    full, total = set(), sum(sizes)
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        shares = sum(w for i, w in enumerate(weights) if i not in full)
        targets = [most * n if i in full else rest * weights[i] / shares for i, n in enumerate(sizes)]
        above = {i for i, n in enumerate(sizes) if i not in full and targets[i] >= most * n}
        if not above or not shares:
            return targets
        full |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    draw = random.Random(seed)
    names = sorted({"".join(draw.choices("abZ é😀", k=draw.randint(0, 3))) for _ in range(40)}) + [None]
    sizes = [draw.choice([0, 1, 5, 1000, 10**6]) * draw.randint(1, 9) for _ in names]
    rows = [(s, n) for s, n in zip(names, sizes)] + [(names[0], 0)]
    found = {r["source"]: r for r in source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    wanted = level(sizes, [1 + k % 3 for k in range(len(names))])
    assert [found[s]["source_size"] for s in names] == sizes
    assert [found[s]["target"] for s in names] == pytest.approx(wanted)
    assert sum(wanted) == pytest.approx(sum(sizes))


def test_words():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choices(" \t\n\x0b\x0c\r\x1c\x85aé😀 ", k=draw.randint(0, 12)))
        assert n_words(text.encode()) == len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_mix_comes_near_its_targets_and_agrees(spark):
    draw = random.Random(2)
    rows = [(i, " ".join("w" * draw.randint(1, 30)), "hot" if i % 3 else f"s{i % 7}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    plan = mix_plan(docs).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, mix_plan(docs.repartition(3)).collect()))
    of = {i: s for i, _, s in rows}
    taken, target = {}, {}
    for r in plan:
        assert r["taken"] <= 3 * r["size"]
        taken[of[r["doc_id"]]] = taken.get(of[r["doc_id"]], 0) + r["taken"]
        target[of[r["doc_id"]]] = r["target"]
    assert all(taken[s] == pytest.approx(target[s], rel=0.15) for s in target)
    emitted = {}
    for r in mix_documents(docs).collect():
        emitted.setdefault(r["doc_id"], []).append(r["copy"])
    assert {i: sorted(c) for i, c in emitted.items()} == {r["doc_id"]: list(range(1, r["copies"] + 1)) for r in plan if r["copies"]}


def test_odd_rows(spark, odd_documents, no_documents):
    plan = mix_plan(odd_documents).collect()
    assert len(plan) == odd_documents.count() and {r["source_size"] for r in plan} == {sum(r["size"] for r in plan)}
    assert all(r["taken"] == r["size"] for r in plan)  # one source takes its own total
    assert mix_documents(odd_documents).columns == [*odd_documents.columns, "copy"]
    assert mix_plan(no_documents).count() == 0 and mix_documents(no_documents).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id bigint, text string, source string")
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in mix_plan(nothing).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert sized(nothing).count() == 2
