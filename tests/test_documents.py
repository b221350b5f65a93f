"""Documents of unknown shape against a walk in Python."""

import json
import random

from pyspark.sql import functions as F

from graphloom.operators import documents
from graphloom.operators.documents import ITEM, Rule


def walk(value, path=(), at=()):
    kind = {dict: "object", list: "array", type(None): "null", bool: "boolean", int: "bigint", str: "string"}[type(value)]
    yield path, at, kind, None if kind in ("object", "array", "null") else str(value).lower() if kind == "boolean" else str(value)
    if kind == "object":
        for k, v in value.items():
            yield from walk(v, (*path, k), at)
    elif kind == "array":
        for i, v in enumerate(value, 1):
            yield from walk(v, (*path, ITEM), (*at, i))


def grown(rnd, depth):
    kinds = ["x", 7, None, True, "", "é\n"] + ([{}, []] + ["o", "a"] * 3 if depth else [])
    value = rnd.choice(kinds)
    if value == "o":
        return {k: grown(rnd, depth - 1) for k in rnd.sample(["a", "b", "pos", "key", "value", "c d", "[]x"], rnd.randint(0, 4))}
    return [grown(rnd, depth - 1) for _ in range(rnd.randint(0, 4))] if value == "a" else value


def test_values_at_every_depth(spark):
    rnd = random.Random(6)
    docs = [(i, json.dumps(grown(rnd, 6))) for i in range(80)] + [(100, None), (101, "{no json"), (102, ""), (None, '{"a": [1]}'), (5, '{"again": 1}')]
    df = spark.createDataFrame(docs, "key long, doc string").withColumns({"path": F.lit(1), "held": F.lit("x"), "kind": F.lit(2)})
    got = sorted(repr((r["key"], tuple(r["path"]), tuple(r["at"]), r["kind"], r["text"])) for r in documents.flatten(df, "doc", "key").collect())
    want = []
    for i, doc in docs:
        try:
            want += [(i, *v) for v in walk(json.loads(doc))]
        except (TypeError, ValueError):
            want.append((i, (), (), "invalid", None))
    number = lambda r: r.replace("'tinyint'", "'bigint'")
    assert [number(r) for r in got] == sorted(repr(w) for w in want)
    assert max(len(w[1]) for w in want) >= 5
    assert documents.flatten(df.limit(0), "doc", "key").count() == 0


def test_levels_of_a_document_are_opened_in_one_pass(spark, monkeypatch):
    """No table for each level of documents of up to LEVELS levels, and one for each so many of deeper ones; brackets in texts are none."""
    put, names = documents.Tables.put, []
    monkeypatch.setattr(documents.Tables, "put", lambda self, name, df: names.append(name) or put(self, name, df))
    deep = lambda n: json.dumps(eval("[" * n + "{'a': '[[{'}" + "]" * n))
    odd = json.dumps({"a\\": ["\\", "\"[[[[[[[[[{{{", {"b": "]}\\\""}]})
    for docs, tables in (([deep(5), odd, "[]", None], ["texts"]), ([deep(5), deep(6), deep(19), odd, "{no"], ["texts", "values0", "values1", "values2", "values3"])):
        names.clear()
        got = sorted(repr((r["key"], tuple(r["path"]), tuple(r["at"]), r["kind"], r["text"])) for r in documents.flatten(spark.createDataFrame(list(enumerate(docs)), "key long, doc string"), "doc", "key").collect())
        want = [(i, *v) for i, d in enumerate(docs) for v in ([((), (), "invalid", None)] if d in ("{no", None) else walk(json.loads(d)))]
        assert got == sorted(repr(w) for w in want)
        assert names == tables


def test_fields_of_ragged_rows(spark):
    docs = ['{"a":1,"b":null,"c":""}', '{"a":"x","c":[],"d":{}}', '{"a":[{"k":1},{"k":2}],"d":{"e":[]}}', '{"a":[1,2]}', "[1]", "7", None, "nope"]
    got = [tuple(r) for r in documents.profile(spark.createDataFrame([(d, 1) for d in docs], "json string, field int"), "json").collect()]
    assert got == [("a", 8, 4, 0, 0, 4, "array[bigint:2]=1;array[object:2]=1;bigint=1;string=1"), ("b", 8, 7, 1, 0, 0, "null=1"), ("c", 8, 6, 0, 2, 0, "array[0]=1;string=1"), ("d", 8, 6, 0, 1, 1, "object=2")]
    assert documents.profile(spark.createDataFrame([("[]",)], "json string"), "json").count() == 0


def test_nodes_and_edges_by_paths(spark):
    docs = [
        (2, '{"kinds":{"Gene":{"ids":["x","y"],"attributes":{"core":["n","m"]}}},"links":{"L":{"from":"Gene","sources":["s2","s1"]}}}'),
        (1, '{"kinds":{"Gene":{"ids":["y"]},"Cell":{"ids":[null,"z"],"deep":{"er":{"still":["w"]}}}},"links":{"L":{"from":"Cell","sources":["s1"]}}}'),
    ]
    rules = [
        Rule("kinds.*", "Kind"), Rule("kinds.*.ids.[]", "Id", "HAS_ID", "Kind"), Rule("kinds.*.attributes.*.[]", "Attribute", "HAS", "Kind"), Rule("kinds.*.deep.er.still.[]", "Deep", "HAS", "Kind", own=1),
        Rule("links.*", "Link"), Rule("links.*.from", "Kind2", "FROM", "Link", own=1), Rule("links.*.sources.[]", "Source", "ALLOWS", "Link", own=1),
    ]
    flat = documents.flatten(spark.createDataFrame(docs, "id long, doc string"), "doc", "id")
    nodes, edges = documents.graph_of(flat, "id", rules)
    assert {tuple(r) for r in nodes.collect()} == {
        ("Kind", "Gene", None), ("Kind", "Cell", None), ("Id", "Gene|x", 1), ("Id", "Gene|y", 1), ("Id", "Cell|z", 2), ("Attribute", "Gene|core|n", 1), ("Attribute", "Gene|core|m", 2), ("Deep", "w", 1),
        ("Link", "L", None), ("Kind2", "Gene", None), ("Kind2", "Cell", None), ("Source", "s1", 1), ("Source", "s2", 1),
    }
    assert {tuple(r) for r in edges.where("type in ('ALLOWS', 'HAS')").collect()} == {
        ("ALLOWS", "Link", "L", "Source", "s1"), ("ALLOWS", "Link", "L", "Source", "s2"),
        ("HAS", "Kind", "Gene", "Attribute", "Gene|core|n"), ("HAS", "Kind", "Gene", "Attribute", "Gene|core|m"), ("HAS", "Kind", "Cell", "Deep", "w"),
    }
