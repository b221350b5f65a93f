"""Joins by time, state across batches and mergeable summaries against brute force."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.operators import summaries, times
from graphloom.streaming import landing, latest

T0 = datetime.datetime(2020, 1, 1)


def moment(seconds):
    return None if seconds is None else T0 + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize("hot", [4096, 0.001])
def test_facts_that_hold(spark, monkeypatch, hot):
    rnd = random.Random(3)
    monkeypatch.setattr(times, "HOT", hot)
    key = lambda: rnd.choice([None, 1, 1, 1, 2])
    events = [(i % 150, key(), rnd.choice([None, rnd.uniform(-1000, 1000), 50.0])) for i in range(200)]
    facts = [(i, key(), s, s + rnd.choice([0, 1, 10, 64, 5000, -3])) for i in range(90) for s in [rnd.choice([50.0, rnd.uniform(-1000, 1000)])]] + [(900, 1, None, 5.0), (901, 1, 5.0, None), (902, None, -5000.0, 5000.0)]
    e = spark.createDataFrame([(i, k, moment(a)) for i, k, a in events], "e long, k int, moment timestamp")
    f = spark.createDataFrame([(i, k, moment(s), moment(u)) for i, k, s, u in facts], "f long, k int, since timestamp, until timestamp")
    got = sorted((r["k"], r["e"], r["f"]) for r in times.valid_at(e, f, "k", "moment", "since", "until", 16.0, salts=3).collect())
    want = sorted((k, i, j) for i, k, a in events if k is not None and a is not None for j, k2, s, u in facts if k2 == k and s is not None and u is not None and s <= a < u)
    assert got == want and got
    assert times.valid_at(e, f.limit(0), "k", "moment", "since", "until", 16.0).count() == 0 == times.valid_at(e.limit(0), f, "k", "moment", "since", "until", 16.0).count()
    with pytest.raises(ValueError, match="both sides"):
        times.valid_at(e, f.withColumnRenamed("f", "e"), "k", "moment", "since", "until", 16.0)


@pytest.mark.parametrize("width", [7.0, 100000.0])
def test_last_fact_before(spark, width):
    rnd = random.Random(4)
    events = [(i % 120, rnd.choice([None, 1, 1, 2, 9]), rnd.choice([None, rnd.randint(-60, 60)])) for i in range(160)]
    facts = [(rnd.choice([None, i]), rnd.choice([None, 1, 2]), rnd.choice([None, rnd.randint(-50, 70)])) for i in range(60)]
    e = spark.createDataFrame([(i, k, moment(a)) for i, k, a in events], "e long, k int, moment timestamp")
    f = spark.createDataFrame([(i, k, moment(s)) for i, k, s in facts], "f long, k int, since timestamp")
    got = sorted(repr((r["e"], r["k"], r["moment"], r["f"], r["since"])) for r in times.as_of(e, f, "k", "moment", "since", width).collect())
    want = []
    for i, k, a in events:
        known = [(s, j is not None, j) for j, k2, s in facts if k is not None and k2 == k and a is not None and s is not None and s <= a]
        best = max(known, key=lambda x: (x[0], x[1], x[2] or 0), default=(None, None, None))
        want.append(repr((i, k, moment(a), best[2], moment(best[0]))))
    assert got == sorted(want)
    assert times.as_of(e, f.limit(0), "k", "moment", "since", width).where("f is null").count() == len(events)


def test_no_pairs_are_tried(spark):
    e = spark.createDataFrame([(1, 1, T0)], "e long, k int, moment timestamp")
    f = spark.createDataFrame([(1, 1, T0, moment(5))], "f long, k int, since timestamp, until timestamp")
    for df in (times.valid_at(e, f, "k", "moment", "since", "until", 1.0), times.as_of(e, f.drop("until"), "k", "moment", "since", 1.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_last_rows_across_batches(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randint(0, 500)]), i, rnd.choice([None, "x", "é"])) for i in range(90)]
    rows += rows[:20]
    for n in range(3):
        part = [(k, moment(s), i, v) for k, s, i, v in rows[n::3]]
        spark.createDataFrame(part, "k string, moment timestamp, n long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
    schema = spark.read.parquet(f"{tmp_path}/landed").schema
    stream = landing.landed(spark, f"{tmp_path}/landed", schema, 1)
    latest.write(latest.last_rows(stream, ["k"], ["moment", "n"], "moment"), f"{tmp_path}/rows", f"{tmp_path}/progress").awaitTermination()
    emitted = spark.read.parquet(f"{tmp_path}/rows").collect()
    assert len({r["batch_id"] for r in emitted}) >= 2 and len(emitted) <= 9  # a key changes once in a batch at most
    best = {}
    for k, s, i, v in rows:
        best[k] = max(best.get(k, ((False, 0, -1), None)), (((s is not None), s or 0, i), v), key=lambda x: x[0])
    last = {}
    for r in sorted(emitted, key=lambda r: r["batch_id"]):
        last[r["k"]] = (r["n"], r["v"])
    assert last == {k: (rank[2], v) for k, (rank, v) in best.items()}


def test_last_rows_of_keys_without_expiry_need_no_python(spark, tmp_path):
    """No call of Python for each key: the plan of a batch is an aggregation of Spark."""
    spark.createDataFrame([("a", moment(1), 1)], "k string, moment timestamp, n long").write.parquet(f"{tmp_path}/landed")
    stream = landing.landed(spark, f"{tmp_path}/landed", spark.read.parquet(f"{tmp_path}/landed").schema, 1)
    plan = latest.last_rows(stream, ["k"], ["moment", "n"], "moment")._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    for n, part in enumerate([[("a", 0, 1)], [("b", 1000, 2)], [("c", 2000, 3)], [("a", 2000, 4), ("b", 5, 5)]]):
        spark.createDataFrame([(k, moment(s), i) for k, s, i in part], "k string, moment timestamp, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
        schema = spark.read.parquet(f"{tmp_path}/landed").schema
        stream = landing.landed(spark, f"{tmp_path}/landed", schema, 1)
        latest.write(latest.last_rows(stream, ["k"], ["moment", "n"], "moment", "10 seconds", 60.0), f"{tmp_path}/rows", f"{tmp_path}/progress").awaitTermination()
    got = sorted((r["k"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    assert got == [("a", 1), ("a", 4), ("b", 2), ("c", 3)]  # the row of b that is older than the watermark is dropped


def test_subtotals_tell_nulls_from_totals(spark):
    df = spark.createDataFrame([("x", "p", 1), ("x", None, 2), (None, "p", 4), (None, None, 8)], "a string, b string, n int")
    got = {(r["level"], r["a"], r["b"]): r["s"] for r in summaries.subtotals(df, ["a", "b"], {"s": F.sum("n")}).collect()}
    assert got == {("", "x", "p"): 1, ("", "x", None): 2, ("", None, "p"): 4, ("", None, None): 8, ("b", "x", None): 3, ("b", None, None): 12, ("a", None, "p"): 5, ("a", None, None): 10, ("a,b", None, None): 15}
    plan = summaries.subtotals(df, ["a", "b"], {"s": F.sum("n")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_merged_sketches(spark):
    rows = [(layer, f"v{i}") for layer, of in (("A", range(0, 6000)), ("B", range(3000, 9000)), ("C", range(100))) for i in of] + [("A", None), ("C", "v1")]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["layer", "value"]))
    table = summaries.sketches(df, ["layer"], "value")
    assert {r["layer"]: r["exact"] for r in table.collect()} == {"A": 6000, "B": 6000, "C": 100}
    got = {r["layers"]: (r["exact"], r["within"]) for r in summaries.merged(table, "layer", ["A", "B", "C", "none"], df, "value").collect()}
    assert got["A,B"] == (9000, True) and got["A,B,C,none"] == (9000, True) and got["B,C"] == (6100, True) and got["C"] == (100, True) and all(w for _, w in got.values())
