import json

import pytest
from pyspark.sql import functions as F

from sonarlake.llm import tool_calls as tc
from sonarlake.llm.common import table


def test_levels_of_a_graph_with_a_cycle(spark):
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "x")]
    keys = spark.createDataFrame([(k,) for k in "abcdefxyz"], "key string")
    got = {r.key: r.level for r in tc.topological_levels(keys, spark.createDataFrame(edges, "key string, dep string")).collect()}
    assert got == {"a": 0, "f": 0, "b": 1, "c": 1, "d": 2, "e": 3, "x": None, "y": None, "z": None}


def call(i, name, arguments, after=()):
    return json.dumps({"id": i, "name": name, "arguments": arguments if isinstance(arguments, str) else json.dumps(arguments), "after": list(after)})


def test_linking_validation_and_odd_messages(spark):
    ok = {"query": "ä\n\"q\"", "limit": 3}
    rows = [(1, 5, "call", call("a", "search", ok)), (1, 3, "call", call("b", "search", {"query": 1, "more": 2}, ["a", "gone"])), (1, 9, "call", call("a", "note", {})),
            (1, 6, "tool", json.dumps({"tool_call_id": "a", "content": "r1"})), (1, 7, "tool", json.dumps({"tool_call_id": "a", "content": "r2"})),
            (1, 7, "tool", json.dumps({"tool_call_id": "zz", "content": "orphan"})), (1, 8, "call", "no json"), (1, None, "call", None), (None, 1, "call", call("n", "note", {})),
            (2, 0, "call", call("a", "convert", '{"unit":"m","value":2.50}', ["b"])), (2, 0, "call", call("b", "convert", "[1]", ["a"])), (2, 1, "call", call("c", "what", "{")),
            (2, 1, "call", call("c", "what", "{")), (2, 2, "call", call("d", "other", {"z": [1, {"b": 1, "a": None}], "A": True}))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, level int")
    got = {(r.conv_id, r.call_id): r for r in tc.link_calls(df).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "d")}
    a, b = got[1, "a"], got[1, "b"]
    assert (a.level, a.position, a.status, a.errors) == (0, 0, "linked", "") and (b.level, b.position, b.status) == (1, 1, "unanswered")
    assert b.errors == "limit is missing; more is unknown; query is no string"
    assert a.record == '{"arguments":{"limit":3,"query":"ä\\n\\"q\\""},"id":"a","name":"search","position":0,"result":"r1","valid":true}'
    assert [got[2, k].level for k in "abcd"] == [None, None, 0, 0] and sorted(got[2, k].position for k in "abcd") == [0, 1, 2, 3]
    assert got[2, "b"].errors == "arguments are no object" and got[2, "c"].errors == "arguments are not JSON" and got[2, "d"].errors == "tool is unknown"
    assert '"arguments":{"A":true,"z":[1,{"a":null,"b":1}]}' in got[2, "d"].record
    assert tc.link_calls(df.limit(0)).count() == 0


def test_messages_of_follows_the_turns(spark):
    told = tc.messages_of(table(spark, "/root/testdata/sf0.001", "conversations"))
    assert told.filter(F.col("role") == tc.RESULT).count() == table(spark, "/root/testdata/sf0.001", "conversations").count()
    for r in told.filter(F.col("role") == tc.CALL).limit(20).collect():
        json.loads(json.loads(r.text)["arguments"])


@pytest.mark.parametrize("name", ["op6_divergence_rules", "op8_arc_to_warc", "op9_tool_call_links"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from sonarlake.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    plain = lambda v: round(v, 7) if isinstance(v, float) else v
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(x) for x in r) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == want
