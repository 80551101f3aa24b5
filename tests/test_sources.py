import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vigilspark.sources import readers, sinks


def test_one_row_a_key_is_chosen_by_order(spark):
    new = spark.createDataFrame([("k", 1, "first"), ("k", 3, "last"), ("k", 2, "middle")], "id string, at int, v string")
    assert rows(sinks.insert_if_absent(new, None, "id", "at").table) == [("k", 1, "first")]
    stored = spark.createDataFrame([("k", 0, "old"), ("o", 0, "other")], "id string, at int, v string")
    assert rows(sinks.upsert(new, stored, "id", ["at", "v"], "at").table) == [("k", 3, "last"), ("o", 0, "other")]
    assert rows(sinks.insert_if_absent(new, stored, "id", "at").table) == rows(stored)


def test_audit_is_appended_once(spark, tmp_path):
    outcomes = spark.createDataFrame([("a", "created"), ("b", "updated")], "id string, outcome string")
    at = F.lit("2026-01-01 10:00:00").cast("timestamp")
    for _ in range(3):
        sinks.append_audit([sinks.audit_rows(outcomes, "id", "case", at)], str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


@pytest.mark.parametrize("text", ["[{\"a\":1},{\"a\":2}]", "\n" * 6000 + "  [{\"a\":1},{\"a\":2}]", "{\"a\":1}\n{\"a\":2}\n", "﻿\n {\"a\":1}\n{\"a\":2}"])
def test_json_is_told_by_its_first_character(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    found = {r["first"] for r in readers._heads(spark, str(tmp_path)).collect()}
    assert found == {text.strip("﻿ \n")[0]}
    if not text.startswith("﻿"):
        assert readers.read_json_auto(spark, str(tmp_path)).select("a").orderBy("a").collect() == [(1,), (2,)]


def test_other_text_is_no_json(spark, tmp_path):
    (tmp_path / "x.json").write_text("a,b\n1,2")
    with pytest.raises(ValueError, match="valid JSON"):
        readers.read_json_auto(spark, str(tmp_path))


def test_csv_is_split_unless_values_hold_line_breaks(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b\n1,\"x \"\"y\"\"\"\n2,\n")
    assert rows(readers.read_csv_headered(spark, str(tmp_path / "p.csv"))) == [("1", 'x "y"'), ("2", "")]
    (tmp_path / "m.csv").write_text("a,b\n1,\"x\ny\"\n")
    assert rows(readers.read_csv_headered(spark, str(tmp_path / "m.csv"), multi_line=True)) == [("1", "x\ny")]


def test_file_verdicts(spark, tmp_path):
    for name, data in {
        "ok.json": b" " * 500 + json.dumps({"a": 1}).encode(), "bad.json": b"a,b", "empty.csv": b"", "x.exe": b"MZ", "fake.parquet": b"a,b",
        "p.csv": b"PAR1xx", "j.csv": b"  [1]", "ok.csv": b"a,b\n", "blank.json": b"   ",
    }.items():
        (tmp_path / name).write_bytes(data)
    found = {r["file_name"]: r["problem"] for r in readers.validate_files(spark, str(tmp_path)).collect()}
    assert found == {
        "ok.json": "", "bad.json": "not json", "empty.csv": "empty", "x.exe": "unsupported extension", "ok.csv": "", "empty.csv": "empty", "blank.json": "not json",
        "fake.parquet": "not parquet: missing magic bytes", "p.csv": "parquet content in csv", "j.csv": "json content in csv",
    }
    assert readers.validate_files(spark, str(tmp_path), max_bytes=100).where("problem = 'too large'").count() == 1


def test_no_length_is_refused_by_default(spark, tmp_path):
    for name, data in {"big.json": b"[", "big.parquet": b"PAR1", "fake.parquet": b"a,b", "big.csv": b"a,b"}.items():
        (tmp_path / name).write_bytes(data)
        with open(tmp_path / name, "r+b") as f:
            f.truncate((1 << 31) + 5)  # sparse
    found = {r["file_name"]: (r["problem"], r["size_bytes"]) for r in readers.validate_files(spark, str(tmp_path)).collect()}
    size = (1 << 31) + 5
    assert found == {"big.json": ("", size), "big.parquet": ("", size), "fake.parquet": ("not parquet: missing magic bytes", size), "big.csv": ("", size)}
    assert {r["problem"] for r in readers.validate_files(spark, str(tmp_path), max_bytes=1 << 31).collect()} == {"too large"}


def test_opening_bytes_tell_what_the_whole_tells(spark, tmp_path, monkeypatch):
    for name, data in {
        "a b%20.json": b" " * 500 + b"{}", "far.json": b"\n" * (1 << 21) + b"[1]", "bad.json": b" " * 70 + b"a,b", "blank.json": b" " * 200,
        "late.parquet": b" " * 64 + b"PAR1", "ok.parquet": b"PAR1" + bytes(100), "p.csv": b"PAR1xx", "j.csv": b"  [1]", "ok.csv": b"a,b\n", "x.exe": b"MZ",
        "_hidden.csv": b"a", "none.json": b"",
    }.items():
        (tmp_path / name).write_bytes(data)
    columns = ["file_name", "extension", "size_bytes", "accepted", "problem"]
    heads = rows(readers.validate_files(spark, str(tmp_path)), *columns)
    firsts = rows(readers._heads(spark, str(tmp_path)).where("first <> ''"), "first", "whole_line")
    monkeypatch.setattr(readers, "file_heads", lambda *_: None)  # as for a store that only Spark reads
    assert rows(readers.validate_files(spark, str(tmp_path)), *columns) == heads and len(heads) == 11
    assert rows(readers._heads(spark, str(tmp_path)).where("first <> ''"), "first", "whole_line") == firsts


@pytest.mark.parametrize("text, whole", [
    ('{"a": 1}\n{"a": 2}\n', True), ('{"a": 1}', True), ('{\n"a": 1}', False), ('\n\n {"a": "}\\"{", "b": [\n1]}', False), ('{"a": "\\\\"}\r\n{"a": ""}', True),
])
def test_lines_or_one_object(spark, tmp_path, text, whole):
    (tmp_path / "x.json").write_text(text)
    assert [r["whole_line"] for r in readers._heads(spark, str(tmp_path)).collect()] == [whole]
    assert readers.read_json_auto(spark, str(tmp_path)).where("a is not null").count() == text.count('"a"')


def test_malformed_json_fails_or_is_kept(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a": }\n{"a": 3}\n')
    with pytest.raises(ValueError, match="Malformed"):
        readers.read_json_auto(spark, str(tmp_path))
    kept = readers.read_json_auto(spark, str(tmp_path), on_error="keep").cache()
    assert kept.count() == 3 and kept.where("_corrupt_record is not null").count() == 1
