"""Merges by bucket against a dictionary."""

import random
from pathlib import Path

from tests.conftest import rows
from vigilspark.sources.buckets import BucketTable

SCHEMA = "id string, at int, v string"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_merges_equal_a_dictionary(spark, tmp_path):
    draw = random.Random(1)
    table = BucketTable(spark, str(tmp_path / "t"), "id", frame(spark, []).schema, 16)
    wanted = {}
    for batch in range(4):
        data = [(draw.choice([f"k{draw.randrange(60)}", None]), 100 * batch + k, f"b{batch}") for k in range(40)]
        change = batch % 2 == 1
        done = table.merge(frame(spark, data), batch, ["v"] if change else None, "at")
        last = {}
        for key, at, v in data:
            if change or key not in last:
                last[key] = (at, v)
        outcomes = {k: "created" if k not in wanted else "updated" if change else "duplicate" for k in last}
        assert {r["id"]: r["outcome"] for r in done.outcomes.collect()} == outcomes
        for key, (at, v) in last.items():
            if key not in wanted:
                wanted[key] = (at, v)
            elif change:
                wanted[key] = (wanted[key][0], v)  # only v is mutable
        assert {r["id"]: (r["at"], r["v"]) for r in table.read().collect()} == wanted


def test_a_small_batch_touches_few_buckets_and_again_nothing_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, "id", frame(spark, []).schema, 200)
    table.merge(frame(spark, [(f"k{k}", k, "old") for k in range(2000)]), 0)
    before = files(path)
    batch = [(f"k{k}", k, "new") for k in range(5)] + [(f"n{k}", k, "new") for k in range(5)]
    done = table.merge(frame(spark, batch), 1, ["v"])
    after = files(path)
    assert len(done.buckets) <= 10 and len({Path(f).parent for f in after.keys() - before.keys()}) <= 10
    assert len(before.keys() & after.keys()) >= len(before) - 10  # the other buckets' files are the same
    assert len({Path(f).parent for f in before.keys() - after.keys()}) <= 10
    once, said = rows(table.read()), rows(done.outcomes)
    again = table.merge(frame(spark, batch), 1, ["v"])
    assert rows(table.read()) == once and rows(again.outcomes) == said
    assert table.merge(frame(spark, []), 2).buckets == [] and rows(table.read()) == once
