"""Filters as trees, named files in two phases, the laid-out result table, flat records."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paperloom.plans import extraction, predicates
from paperloom.sources import sinks, store

ROWS = [(1, "a", {"n": "5", "t": "xy"}, (True, dt.date(2024, 1, 1))), (2, None, {"n": "12"}, (False, None)), (3, "b", {}, (None, dt.date(2025, 1, 1)))]
SCHEMA = "id int, name string, fields map<string,string>, meta struct<ok:boolean,day:date>"


@pytest.mark.parametrize(
    "tree,want",
    [
        ({"field": "name", "op": "=", "value": "a"}, [1]),
        ({"field": "name", "op": "is null"}, [2]),
        ({"not": {"field": "name", "op": "=", "value": "a"}}, [2, 3]),
        ({"field": "fields.n", "op": ">", "value": 7}, [2]),
        ({"field": "fields.t", "op": "contains", "value": "x"}, [1]),
        ({"field": "meta.ok", "op": "=", "value": True}, [1]),
        ({"field": "meta.day", "op": ">=", "value": "2024-06-01"}, [3]),
        ({"field": "id", "op": "in", "value": [1, 3]}, [1, 3]),
        ({"field": "id", "op": "not in", "value": [1]}, [2, 3]),
        ({"or": [{"field": "id", "op": "<", "value": 2}, {"and": [{"field": "id", "op": ">", "value": 2}, {"field": "name", "op": "starts", "value": "b"}]}]}, [1, 3]),
    ],
)
def test_trees(spark, tree, want):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(r["id"] for r in df.filter(predicates.compile_filter(tree, df.schema)).collect()) == want
    reply = f"Here it is:\n```json\n{json.dumps(tree)}\n```"
    assert sorted(r["id"] for r in predicates.filter_by_reply(df, reply).collect()) == want


@pytest.mark.parametrize(
    "tree",
    [None, [], {}, {"and": []}, {"and": [1]}, {"field": "no", "op": "=", "value": 1}, {"field": "id", "op": "=", "value": "x"}, {"field": "id", "op": "like", "value": 1}, {"field": "name.x", "op": "=", "value": "a"},
     {"field": "id", "op": "in", "value": []}, {"field": "id", "op": "is null", "value": 1}, {"not": {"field": "id"}}, {"and": [{"field": "id", "op": "=", "value": 1}], "or": []}, {"field": "id; drop", "op": "=", "value": 1}],
)
def test_invalid_trees_keep_the_input(spark, tree):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(predicates.InvalidFilter):
        predicates.compile_filter(tree, df.schema)
    assert predicates.filter_by_reply(df, json.dumps(tree)).count() == 3
    assert predicates.filter_by_reply(df, "ERROR: down").count() == 3


def test_tree_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.filter(predicates.compile_filter({"field": "id", "op": ">", "value": 1}, df.schema)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,1)" in plan and "ReadSchema: struct<id:int>" in plan


def files_of(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_named_files_commit_or_leave_nothing(spark, tmp_path):
    at = tmp_path / "out"
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}.txt", b"x" * i) for i in range(12)], "name string, content binary").repartition(4)
    sinks.write_files(spark, rows, str(at))
    assert files_of(at) == sorted(f"d{i % 3}/f{i}.txt" for i in range(12)) and (at / "d2" / "f5.txt").read_bytes() == b"xxxxx"
    assert [p.name for p in at.iterdir()] == sorted(["d0", "d1", "d2"], key=[p.name for p in at.iterdir()].index)
    before = files_of(at)
    for bad in ("../out.txt", "/etc/x", "a//b", "", None):
        with pytest.raises(Exception, match="not a file name"):
            sinks.write_files(spark, spark.createDataFrame([("fine.txt", b"1"), (bad, b"2")], "name string, content binary").coalesce(1), str(at))
    with pytest.raises(Exception, match="several rows"):
        sinks.write_files(spark, spark.createDataFrame([("twice.txt", b"1"), ("twice.txt", b"2")], "name string, content binary").repartition(2), str(at))
    assert files_of(at) == before, "failed jobs leave no file"
    sinks.write_files(spark, rows.withColumn("content", F.lit(b"new")).limit(1), f"file://{at}")
    assert files_of(at) == before


def test_named_exports(spark, tmp_path):
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    fields = '{"native_json": {"b": 1, "a": "é"}, "native_layout_text": "line 1\\nline 2", "english_layout_text": ["x"]}'
    df = spark.createDataFrame([("inv 1.png", fields, "the report\n")], "file string, fields string, report string").withColumn("payload", F.struct("file"))
    for made in (sinks.json_files(df, "payload", "file", at), sinks.report_files(df, "report", "file", at), sinks.debug_files(df, "fields", "file")):
        sinks.write_files(spark, made, str(tmp_path / "out"))
    names = files_of(tmp_path / "out")
    assert names == sorted(["inv_1_png_layout_data_20240102_030405.json", "inv_1_png_report_20240102_030405.txt", *(f"inv_1/{n}" for n in sinks.DEBUG_FILES.values())])
    read = {n: (tmp_path / "out" / n).read_text(encoding="utf-8") for n in names}
    assert json.loads(read["inv_1/native_json.json"]) == {"a": "é", "b": 1} and "\n" in read["inv_1/native_json.json"]
    assert read["inv_1/native_layout_text.txt"] == "line 1\nline 2" and read["inv_1/english_json_en.json"] == "{}" and json.loads(read["inv_1/english_layout_text_en.txt"]) == ["x"]
    assert read["inv_1_png_report_20240102_030405.txt"] == "the report\n"


def test_result_table(spark, tmp_path):
    table = store.ResultTable(spark, str(tmp_path / "t"), buckets=3)
    rows = [(f"{i:024x}", dt.datetime(2024, 1, 1 + i // 10, 12, i % 10), i) for i in range(55)]
    docs = spark.createDataFrame(rows, "_id string, created_at timestamp, n int")
    table.save(docs.filter("n < 40"))
    table.save(docs.filter("n >= 40"))
    plan = table.get(f"{7:024x}")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(_id" in plan
    assert table.get(f"{7:024x}").first()["n"] == 7 and table.get("nothing").count() == 0
    assert table.days()[0] == "2024-01-06" and len(table.days()) == 6
    recent = table.history(8)
    assert [r["_id"] for r in recent.collect()] == [f"{i:024x}" for i in range(54, 46, -1)] and recent.columns == ["_id", "created_at", "n"]
    assert "day" in table.newest(8)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert table.delete(f"{7:024x}") is True and table.delete(f"{7:024x}") is False and table.delete("nothing") is False
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    gone, fresh = set(stamps) - set(after), set(after) - set(stamps)
    assert len({p.parent for p in gone | fresh}) == 1 and all(after[p] == t for p, t in stamps.items() if p in after), "one bucket of one day is rewritten"
    assert sorted(r["n"] for r in table.rows().collect()) == [i for i in range(55) if i != 7]
    for i in range(50, 55):
        assert table.delete(f"{i:024x}")
    assert table.rows().count() == 49 and [r["n"] for r in table.history(3).collect()] == [49, 48, 47]


def test_flat_records(spark):
    rows = [(1, '{"Total": 5, "Who": "x", "k": [1]}', "s"), (2, '{"Total": 2.5, "id": 9, "_source": "own"}', "t"), (3, "not json", "u"), (4, None, "v"), (5, '{"Who": 3}', "w")]
    out = extraction.flat_records(spark.createDataFrame(rows, "id int, fields string, _source string"))
    assert set(out.columns) == {"id", "Total", "Who", "k", "_source"} and out.columns[0] == "id" and out.columns[-1] == "_source"
    got = {r["id"]: r for r in out.collect()}
    assert (float(got[1]["Total"]), float(got[2]["Total"])) == (5.0, 2.5) and got[3]["Total"] is None and got[2]["_source"] == "t"
    assert dict(out.dtypes)["k"].startswith("array") and dict(out.dtypes)["Who"] == "variant"
    empty = extraction.flat_records(spark.createDataFrame([], "id int, fields string, _source string"))
    assert empty.columns == ["id", "_source"]
