import json

import duckdb
import pytest
from pyspark.sql import functions as F

from concord.llm import toolcalls as S
from concord.llm.queries import ORACLES, QUERIES

CALLS = "conv_id long, position long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, position long, call_id string, content string"
ADD = {"add": {"type": "object", "required": ["x", "y"], "additionalProperties": False,
               "properties": {"x": {"type": "integer"}, "y": {"type": "integer", "maximum": 9}}}}


def _link(spark, calls, results):
    rows = S.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), ADD).collect()
    return sorted(rows, key=lambda r: (-1 if r["conv_id"] is None else r["conv_id"], r["ord"]))


def test_links_by_identifier_and_occurrence(spark):
    calls = [(1, k, "a", "add", '{"y":2,"x":%d}' % k, []) for k in range(3)] + [(2, 0, "a", "add", '{"x":1,"y":1}', []), (2, 1, None, "add", "{}", [])]
    results = [(1, 10, "a", "r0"), (1, 11, "a", "r1"), (2, 5, None, "lost"), (3, 0, "a", "stray")]
    rows = _link(spark, calls, results)
    assert [(r["conv_id"], r["ord"], r["status"], json.loads(r["json"])["result"]) for r in rows] == [
        (1, 0, "linked", "r0"), (1, 1, "linked", "r1"), (1, 2, "unanswered", None),
        (2, 0, "unanswered", None), (2, 1, "unanswered", None), (2, 2, "orphan", "lost"), (3, 0, "orphan", "stray")]
    assert rows[0]["json"] == '{"arguments":{"x":0,"y":2},"id":"a","name":"add","result":"r0"}'


def test_topological_order_and_cycles(spark):
    ok = '{"x":1,"y":1}'
    calls = [(1, 0, "c", "add", ok, ["b"]), (1, 1, "b", "add", ok, ["a"]), (1, 2, "a", "add", ok, []), (1, 3, "d", "add", ok, ["gone"]),
             (2, 0, "p", "add", ok, ["q"]), (2, 1, "q", "add", ok, ["p"]), (2, 2, "s", "add", ok, ["s"]), (2, 3, "z", "add", ok, [])]
    rows = _link(spark, calls, [])
    assert [r["call_id"] for r in rows[:4]] == ["a", "d", "b", "c"]
    assert [(r["call_id"], r["error"]) for r in rows[4:]] == [("z", None), ("p", "cyclic"), ("q", "cyclic"), ("s", "cyclic")]
    assert rows[1]["error"] == "unknown dependency"


@pytest.mark.parametrize("value,error", [
    ({"x": 1, "y": 2}, None), ({"x": 1}, "$.y: missing"), ({"x": "1", "y": 2}, "$.x: not integer"), ({"x": 1, "y": 10}, "$.y: too large"),
    ({"x": True, "y": 1}, "$.x: not integer"), ({"x": 1, "y": 1, "z": 0}, "$.z: unknown"), ([], "$: not object"), (None, "$: not object")])
def test_schemas(value, error):
    assert S.schema_error(value, ADD["add"]) == error


def test_reads_fenced_calls_and_tool_messages(spark):
    text = 'x ```tool_call\n{"id":7,"name":"add","arguments":{"y":2,"x":1},"after":["a"]}\n``` ```tool_call\nno json\n``` ```tool_call\n{"name":"é","arguments":NaN}\n```'
    rows = [(1, 1, "assistant", text), (1, 2, "tool", '{"tool_call_id":7,"content":{"b":1,"a":"é"}}'), (1, 3, "tool", "plain"), (1, 4, "tool", None),
            (None, None, None, None), (2, 0, "user", text)]
    calls, results = S.read_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r["call_id"], r["name"], r["arguments"], r["after"]) for r in calls.collect()] == [("7", "add", '{"x":1,"y":2}', ["a"])]
    assert sorted((repr(r["call_id"]), r["content"]) for r in results.collect() if r["content"]) == [("'7'", '{"a":"é","b":1}'), ("None", "plain")]


def test_dialogues_equal_sql(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'hi "x"\n\\ é'), (1, 2, "assistant", "yo"), (1, 3, "user", ""), (1, 5, "user", None),
            (2, 0, "assistant", "first"), (2, 1, "user", "q"), (2, 2, "assistant", None), (2, 4, "user", "gap"), (3, 0, "tool", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ord", F.lit(9))
    con = duckdb.connect()
    con.register("conversations", df.drop("ord").toPandas())
    want = con.execute(ORACLES["op9_tool_call_linking"]).fetchall()
    got = S.reply_calls(spark, df)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert S.reply_calls(spark, df.limit(0)).count() == 0


def test_whole_table_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.execute(ORACLES["op9_tool_call_linking"]).fetchall()
    assert sorted(map(repr, map(tuple, QUERIES["op9_tool_call_linking"](spark, d).collect()))) == sorted(map(repr, want))
