"""Column profiles against values looked at one by one."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vigilspark.operators import profile as P

DATA = [
    (1, "10", "a@mail.example", "", 1.5), (2, " 7 ", None, None, 2.5), (3, "1_000", " ", "  x ", None), (4, "-3", "b@mail.example", "x", 2.5), (5, None, "plain", "", 4.0),
    (6, "10", "a@mail.example", "x", 1.5),
]
SCHEMA = "k int, number string, contact string, `odd name` string, amount double"


def facts(values):
    filled = [str(v).strip() for v in values if v is not None and str(v).strip()]
    n = len(values)
    integer = bool(filled) and all(re.fullmatch(r"[+-]?\d+(_\d+)*", v) for v in filled)
    real = bool(filled) and all(re.fullmatch(r"[+-]?(\d+(_\d+)*\.?\d*)", v) for v in filled)
    return (n, round(1 - len(filled) / n, 4), round(1 - len(set(filled)) / len(filled), 4) if filled else 0.0, "integer" if integer else "float" if real else "string")


@pytest.mark.parametrize("sample_values", [None, 20])
def test_facts(spark, sample_values):
    df = spark.createDataFrame(DATA, SCHEMA).repartition(3)
    found = {r["name"]: r for r in P.column_facts(df, F.col("k"), sample_values).collect()}
    assert [r["position"] for r in sorted(found.values(), key=lambda r: r["position"])] == list(range(5))
    for i, name in enumerate(["k", "number", "contact", "odd name", "amount"]):
        r = found[name]
        assert (r["sampled_rows"], r["null_ratio"], r["duplicate_ratio"], r["inferred_type"]) == facts([d[i] for d in DATA])
    assert found["contact"]["value_kind"]["pii_type"] == "email" and found["odd name"]["value_kind"] is None


def test_first_values_decide_in_samples(spark):
    rows_ = [(k, "plain" if k < 4 else "a@mail.example") for k in range(10)]
    df = spark.createDataFrame(rows_, "k int, v string").repartition(4)
    kinds = [{r["name"]: r["value_kind"] for r in P.column_facts(df, F.col("k"), n).collect()}["v"] for n in (4, 5, None)]
    assert kinds[0] is None and kinds[1]["pii_type"] == kinds[2]["pii_type"] == "email"


def test_no_text_is_shuffled(spark):
    df = spark.range(2000).select("id", F.repeat(F.lit("secret words "), F.col("id").cast("int") % 5).alias("text"))
    found = P.column_facts(df, F.col("id"), None)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("t1#" in line for line in exchanged)


def test_catalog(spark, tmp_path):
    spark.createDataFrame(DATA, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    one = P.profile_dataset(df, "t.parquet", "parquet", ["k"], None)
    assert [(r["size_bytes"], r["record_count"], r["column_count"]) for r in one.collect()] == [(size, 6, 5)]
    assert P.profile_dataset(spark.createDataFrame(DATA, SCHEMA), "t.parquet", "parquet", ["k"], None).first()["size_bytes"] == 0
    other = P.profile_dataset(df, "t.parquet", "parquet", ["k"], None, name="a")
    assert rows(P.profile_catalog([one, other]), "name") == rows(P.profile_catalog([other, one]), "name") == [("a",)]
    assert P.profile_columns(df.limit(0), ["k"]).count() == 0
