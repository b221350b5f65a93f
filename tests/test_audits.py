"""The masked audit against brute force, and output that is checked while it is written."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from graphloom.operators import masks
from graphloom.operators.masks import Edges, Kind, Linked, Nodes, Table
from graphloom.sources import checked

RULES = [
    Nodes("outside", "a"), Nodes("b alone", "b", "near"), Nodes("a not pointed at", "a", "loop"),
    Edges("from outside", "near", "source"), Edges("to one alone", "near", "target", "loop"), Edges("loops out", "loop", "either"), Edges("loops with an end not near", "loop", "either", "near"),
    Linked("b near outside", "near", "target"), Linked("a near a b without loop", "near", "source", "far"), Linked("loop to outside", "loop", "source"),
]


def brute(nodes, core, kinds):
    """Counts of ``RULES`` from sets."""
    edges = {k: {(s, t) for s, t in rows} for k, (_, _, rows) in kinds.items()}
    label = {k: (a, b) for k, (a, b, _) in kinds.items()}
    touched = {k: {(label[k][0], s) for s, _ in e if s is not None} | {(label[k][1], t) for _, t in e if t is not None} for k, e in edges.items()}

    def has(lab, key, bit):
        return key is not None and (lab, key) in (core if bit == "core" else touched[bit])

    out = {}
    for r in RULES:
        if isinstance(r, Nodes):
            out[r.name] = sum(not has(r.label, k, r.lack) for k in nodes[r.label])
            continue
        (a, b), e = label[r.kind], edges[r.kind]
        if isinstance(r, Edges):
            ends = {"source": lambda s, t: not has(a, s, r.lack), "target": lambda s, t: not has(b, t, r.lack)}
            ends["either"] = lambda s, t: ends["source"](s, t) or ends["target"](s, t)
            out[r.name] = sum(ends[r.end](s, t) for s, t in e)
        else:
            out[r.name] = len({s if r.end == "source" else t for s, t in e if (s if r.end == "source" else t) is not None and not has(*((b, t) if r.end == "source" else (a, s)), r.lack)})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_masks_are_brute_force(spark, seed):
    rnd = random.Random(seed)
    some = lambda n: [rnd.choice([None, *range(n)]) for _ in range(60)]
    a, b = [(i, i is not None and i % 3 == 0) for i in (*some(20), 99)], [(str(i),) if i is not None else (None,) for i in some(15)]
    near, loop, far = list(zip(some(25), map(lambda x: x if x is None else str(x), some(18)))), list(zip(some(20), some(22))), [(1, 2), (1, 2), (None, None)]
    ta = spark.createDataFrame(a, "key long, mask boolean")
    tables = [
        Table(ta, {"a": "key"}, core={"a": F.col("mask")}), Table(spark.createDataFrame(b, "source string"), {"b": "source"}),
        Table(spark.createDataFrame([(*x, 0) for x in near + near[:9]], "s long, t string, kind int"), {}, (Kind("near", ("a", "s"), ("b", "t")),)),
        Table(spark.createDataFrame([(*x, "l") for x in loop] + [(*x, "f") for x in far], "s int, t int, end string"), {}, (Kind("loop", ("a", "s"), ("a", "t"), F.col("end") == "l"), Kind("far", ("b", "s"), ("a", "t"), F.col("end") == "f"))),
    ]
    text = lambda x: None if x is None else str(x)
    nodes = {"a": {text(k) for k, _ in a if k is not None}, "b": {k for (k,) in b if k is not None}}
    core = {("a", text(k)) for k, inside in a if k is not None and inside}
    kinds = {"near": ("a", "b", [(text(s), t) for s, t in near]), "loop": ("a", "a", [(text(s), text(t)) for s, t in loop]), "far": ("b", "a", [(text(s), text(t)) for s, t in far])}
    got = {r["rule"]: r["violations"] for r in masks.audit(tables, RULES).collect()}
    assert got == brute(nodes, core, kinds)


def test_each_table_is_scanned_once_and_empty_tables_count_nothing(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "s long, t long").write.parquet(f"{tmp_path}/e")
    spark.createDataFrame([(1,)], "k long").write.parquet(f"{tmp_path}/n")
    tables = [Table(spark.read.parquet(f"{tmp_path}/n"), {"x": "k"}), Table(spark.read.parquet(f"{tmp_path}/e"), {"y": "t"}, (Kind("p", ("x", "s"), ("y", "t")), Kind("q", ("y", "t"), ("x", "s"))))]
    plan = masks.ends(tables, {"core": 2, "p": 4, "q": 8})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    none = [Table(t.rows.limit(0), t.nodes, t.kinds) for t in tables]
    rules = [Nodes("n", "x"), Edges("e", "p", "source"), Edges("both", "p", "either"), Linked("l", "q", "target")]
    assert {r["violations"] for r in masks.audit(none, rules).collect()} == {0} and masks.audit(none, rules).count() == 4
    with pytest.raises(ValueError, match="no such"):
        masks.audit(none, [Edges("e", "unknown", "source")])


def all_checks():
    return checked.Checks(measures={"value": F.sum("value"), "low": F.sum(F.when(F.col("tier") == "low", F.col("value"))), "rest": F.sum(F.when(F.col("tier") != "low", F.col("value")))}, layers={"tier": ["high", "low", "é"]}, sums={"value": ["low", "rest"]}, unique=("id",))


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(1, "high", 5), (2, "low", 7), (3, "low", None), (4, "é", 1)], "id long, tier string, value int")



def test_checked_output_and_its_metadata(spark, rows, tmp_path):
    path = f"{tmp_path}/out"
    found = checked.write(rows, path, all_checks(), ["tier"], {"source": "ünit"})
    assert found == {"rows": 4, "tier=high": 1, "tier=low": 2, "tier=é": 1, "value": 13, "low": 7, "rest": 6, "source": "ünit"} == checked.metadata(spark, path)
    text = (Path(path) / checked.METADATA).read_text()
    assert list(json.loads(text)) == sorted(json.loads(text)) and text.startswith("{\n  ")
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError, match="already"):
        checked.write(rows, path, all_checks())


def test_checked_output_reads_its_input_once(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/in")
    plan = checked.observed(spark.read.parquet(f"{tmp_path}/in"), all_checks(), Observation())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


FAILURES = {
    "rows is 4": lambda: checked.Checks(layers={"tier": ["high", "low"]}),
    "a is 4, b is 3": lambda: checked.Checks(measures={"a": F.count("*"), "b": F.count("value")}, sums={"a": ["b"]}),
    "breaks the rule: has a value": lambda: checked.Checks(require={"has a value": F.col("value") > 0}),
    "breaks the rule: tier is unique": lambda: checked.Checks(unique=("tier",)),
}


@pytest.mark.parametrize("error", FAILURES)
def test_output_that_fails_its_checks_does_not_stay(spark, rows, tmp_path, error):
    path = f"{tmp_path}/out"
    with pytest.raises(Exception, match=error):
        checked.write(rows, path, FAILURES[error]())
    assert not Path(path).exists()


def test_checked_output_of_no_rows(spark, rows, tmp_path):
    found = checked.write(rows.limit(0), f"{tmp_path}/none", all_checks())
    assert found["rows"] == found["tier=low"] == 0 and found["value"] is None


def test_ends_are_shuffled_by_number(spark):
    """Rows that are shuffled have no text but their keys; kinds and labels come back after that, and nodes and edges of the same keys stay apart."""
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 2)], "a int, b int")
    kinds = (Kind("p", ("x", "a"), ("y", "b")), Kind("q", ("y", "b"), ("x", "a"), F.col("b").isNotNull()))
    got = masks.ends([Table(rows, {"x": "a", "y": "b"}, kinds, {"x": F.col("a") == 1})], {"core": 2, "p": 4, "q": 8})
    assert "hashpartitioning(what#" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, map(tuple, got.select("kind", "source", "source_key", "target", "target_key", "mask").collect()))) == sorted(map(repr, [
        (None, "x", "1", None, None, 3), (None, "x", "2", None, None, 1), (None, "y", "1", None, None, 1), (None, "y", "2", None, None, 1),
        ("p", "x", "1", "y", "1", 0), ("p", "x", "2", "y", None, 0), ("p", "x", None, "y", "2", 0), ("q", "y", "1", "x", "1", 0), ("q", "y", "2", "x", None, 0),
    ]))
