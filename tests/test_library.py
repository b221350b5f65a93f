"""The graph-building operators on small rows with results worked out by hand."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import scalars as S
from graphloom.operators import dedupe, graph, joins, profile
from graphloom.sources import readers, writers
from graphloom.streaming import landing


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_scalars(spark):
    got = one(spark, "a string, b string, c string, d string", (" umls:umls_c1 ", "x; y,;z ;", "1.0", ""),
              S.without_prefixes("a", "UMLS:", "UMLS_"), S.joined_list(S.split_list("b", ";,")), S.safe_number("c", "int"), S.strict_number("c"),
              S.namespaced("N:", "d"), S.namespaced("N:", "c"), S.default_blank("d", F.lit("?")), S.missing_fields("a", "d"), S.slug(F.lit("A/b C")), S.without_suffix(F.lit("p - x"), " - x"))
    assert got == ("C1", "x;y;z", None, 1.0, "", "N:1.0", "?", "d", "a/b_c", "p")
    with pytest.raises(Exception):
        one(spark, "a string", ("q",), S.strict_number("a"))
    assert one(spark, "a string, b string", (None, "0"), S.first_present(("p", "a"), ("q", "b")))[0] == ("q", "0")
    assert one(spark, "a string", (" a \n\t b ",), S.clean_text("a")) == ("a b",)
    nested = spark.createDataFrame([((1, None), {"b": 1, "a": 2}, [], 5)], "s struct<y:int,x:string>, m map<string,int>, l array<string>, n int")
    assert tuple(nested.select(*(S.json_text(nested, c) for c in ("s", "m", "l")), S.list_text(nested, "l"), S.list_text(nested, "n")).first()) == ('{"x":null,"y":1}', '{"a":2,"b":1}', "", "", "5")


def test_dedupe(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "x"), ("b", 1, "")], "k string, s int, v string").repartition(3)
    assert rows(dedupe.last_wins(df, ["k"], ["s"])) == [("a", 3, "y"), ("b", 1, "")]
    assert rows(dedupe.first_wins(df, ["k"], ["s"])) == [("a", 1, "x"), ("b", 1, "")]
    assert rows(dedupe.ordered_merge(df, ["k"], "v", ["s"])) == [("a", "x;y"), ("b", "")]  # a key with blanks only stays
    assert rows(dedupe.set_join(df.where("v != ''"), ["k"], "v")) == [("a", "x;y")]
    pairs = spark.createDataFrame([("B", "A", 1, 9), ("A", "B", 2, 8), (None, "B", 0, 7), ("A", None, 0, 7)], "a string, b string, s int, w int")
    assert rows(dedupe.undirected_edges(pairs, "a", "b", ["s"]).select("edge_id", "a", "b", "w")) == [("A|B", "A", "B", 9)]


def test_joins(spark):
    genes = spark.createDataFrame([(1, "a;b"), (2, "b"), (3, "")], "g int, ids string")
    index = spark.createDataFrame([("a", "P1"), ("b", "P2"), ("b", "P3")], "id string, p string")
    assert rows(joins.fanout(genes, [S.split_list("ids"), S.split_list("ids")], index, "id").select("g", "p")) == [(1, "P1"), (1, "P2"), (1, "P3"), (2, "P2"), (2, "P3")]
    r = spark.createDataFrame([(1, "x"), (9, "y"), (8, "z")], "i int, n string")
    a, b = spark.createDataFrame([(1, "A")], "i int, v string"), spark.createDataFrame([("x", "B"), ("y", "C")], "n string, v string")
    got = joins.fallback(r, a, b, "i", "n", "v").select("i", "v", "mapping_input", "mapping_status")
    assert rows(got) == [(1, "A", "id", "mapped"), (8, None, "", "missing"), (9, "C", "name", "mapped")]
    st = spark.createDataFrame([("s1", 1), ("s2", 2), ("s4", 4)], "s string, o int")
    assert rows(joins.next_stage(st, "s", "o")) == [("s1", "s2", 1)]
    spelt = spark.createDataFrame([("a",), ("p:b",), ("z",)], "i string")
    named = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, v string")
    assert rows(joins.by_spelling(spelt, named, "k", [F.col("i"), F.regexp_replace("i", "^p:", "")], "v")) == [("a", "A"), ("p:b", "B"), ("z", "")]
    assert rows(joins.in_scope(spelt, None, "i")) == rows(spelt) and rows(joins.in_scope(spelt, spelt.limit(1), "i")) == [("a",)]


def test_upsert_keeps_unlisted_columns_and_is_idempotent(spark):
    table = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, v string, w string")
    batch = spark.createDataFrame([(2, "old", 1), (2, None, 2), (3, "c", 1)], "k int, v string, s int")
    got = graph.upsert(table, batch.select("k", "v", "s"), "k", ["s"]).select("k", "v", "w")
    assert rows(got) == [(1, "a", "p"), (2, None, "q"), (3, "c", None)]
    clean = dedupe.last_wins(batch, ["k"], ["s"]).select("k", "v")
    once = graph.upsert(table, clean, "k")
    assert rows(graph.upsert(once, clean, "k")) == rows(once)
    with pytest.raises(ValueError):
        graph.require_unique(batch, "k")
    plain = spark.createDataFrame([(1, "b"), (1, "c"), (None, "d"), (4, "e"), (4, "e")], "k int, v string")
    assert rows(graph.upsert(table, plain, "k").select("k", "v")) == [(1, "c"), (2, "b"), (4, "e")]
    stamped = graph.upsert(table, plain, "k", stamp=("at", F.lit("now")))
    assert rows(stamped.select("k", "at")) == [(1, "now"), (2, None), (4, "now")]
    nodes = spark.createDataFrame([(1,), (2,)], "a int")
    edges = spark.createDataFrame([("x", 1, 2), ("y", 1, 9), ("z", None, 2)], "id string, a int, b int")
    assert rows(graph.upsert_edges(edges.limit(0), edges, "id", nodes, nodes.toDF("b"), "a", "b")) == [("x", 1, 2)]
    assert rows(graph.backfill(spark.createDataFrame([(1, "", "k"), (2, "b", None), (3, None, "q")], "k int, v string, w string"), spark.createDataFrame([(1, "n", "n"), (2, "n", "n")], "k int, v string, w string"), "k", "v", "w")) == [(1, "n", "k"), (2, "b", "n"), (3, None, "q")]


def test_tiers_audits_profiles(spark):
    df = spark.createDataFrame([("a", 0.6, 5), ("b", 0.6, 4), ("c", 0.3, None), ("d", 0.29, 9), (None, 0.9, 9)], "id string, s double, n int")
    got = graph.tiered(df, F.col("s"), F.col("n"), (0.6, 5), 0.3, S.missing_fields("id")).select("id", "tier", "tier_reason")
    assert rows(got) == [("a", "high", "score_and_support"), ("b", "medium", "score"), ("c", "medium", "score"), ("d", "candidate", "low_score"), (None, "rejected", "missing:id")]
    scoped = graph.tiered(df, F.col("s"), F.col("n"), (0.6, 5), 0.3, S.missing_fields("id"), (F.col("id"), df.where("id in ('a', 'c')"))).select("id", "tier", "tier_reason")
    assert rows(scoped) == [("a", "high", "score_and_support"), ("b", "rejected", "out_of_scope:b"), ("c", "medium", "score"), ("d", "rejected", "out_of_scope:d"), (None, "rejected", "missing:id")]
    assert rows(graph.violations({"x": df, "y": df.limit(0)})) == [("x", 5), ("y", 0)]
    assert rows(profile.field_profile(df)) == [("id", 5, 4, 1), ("n", 5, 4, 1), ("s", 5, 5, 0)]
    kinds = spark.createDataFrame([("null",), ("[]",), ('[{"a":1}]',), ("[1,2]",), ('{"a":1}',)], "j string")
    assert [r[0] for r in kinds.select(profile.json_type("j")).collect()] == ["null", "array[0]", "array[object:1]", "array[bigint:2]", "object"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/page_0000.json").write_text('{"status": "OK",\n "payload": [{"id": "1"}, {"id": "2"}]}')
    record = T.StructType([T.StructField("id", T.StringType())])
    assert [(r.position, r.id) for r in readers.json_pages(spark, str(tmp_path / "pages"), record).collect()] == [(0, "1"), (1, "2")]
    table = spark.createDataFrame([("1", None, 'say "x"'), ("2", " b ", "c\td")], "a string, b string, c string")
    writers.tsv(table.coalesce(1), str(tmp_path / "t"), ["c", "b", "a"])
    assert rows(readers.tsv(spark, str(tmp_path / "t"), ["c", "b", "a"])) == [("c\td", " b ", "2"), ('say "x"', "", "1")]
    writers.jsonl(table, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert writers.metadata(table.agg(F.count("*").alias("n"))) == '{\n  "n": 2\n}'
    writers.by_tier(table, str(tmp_path / "tiers"), "a")
    assert spark.read.parquet(str(tmp_path / "tiers")).where("a = 2").count() == 1
    (tmp_path / "p.txt").write_text("a\tb\tc\n\nx\tmore\ty\tz\nshort\n")
    assert rows(readers.positional(spark, str(tmp_path / "p.txt"), ["a", "b", "c"])) == [("a", "b", "c"), ("x", "more", "y")]
    assert ("x", "more\ty\tz") in rows(readers.pairs(spark, str(tmp_path / "p.txt"), "l", "r"))
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips/one.zip", "w") as z:
        z.writestr("m.tsv", b"a\tb\r\nc\xff\td\n")
    assert [r.line for r in readers.zipped_lines(spark, str(tmp_path / "zips")).orderBy("line_no").collect()] == ["a\tb", "c�\td"]
    assert rows(readers.fields(readers.zipped_lines(spark, str(tmp_path / "zips")), "line", ["x", "y"])) == [("a", "b"), ("c\ufffd", "d")]
    (tmp_path / "xz").mkdir()
    with zipfile.ZipFile(tmp_path / "xz/x.zip", "w") as z:
        z.writestr("x.xml", '<r xmlns="http://n"><m><id>1</id></m>\n<m><id>2</id><o/></m></r>')
    assert rows(readers.zipped_xml(spark, str(tmp_path / "xz"), "m", record)) == [("1",), ("2",)]
    assert list(writers.exists(spark, str(tmp_path / "xz"), str(tmp_path / "none")).values()) == [True, False]
    with zipfile.ZipFile(tmp_path / "zips/one.zip", "a") as z:
        z.writestr("other.tsv", b"x\ty\n")
    assert [r.line for r in readers.zipped_lines(spark, str(tmp_path / "zips"), "other.tsv").collect()] == ["x\ty"]
    with pytest.raises(Exception, match="2 members"):
        readers.zipped_lines(spark, str(tmp_path / "zips")).collect()
    with gzip.open(tmp_path / "x.xml.gz", "wt") as f:
        f.write('<r xmlns="http://n"><m><id>1</id></m><m><id>2</id></m></r>')
    assert rows(readers.xml_records(spark, str(tmp_path / "x.xml.gz"), "m", record)) == [("1",), ("2",)]


def test_stream_keeps_the_last_row_of_each_key(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, s int, v string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = landing.append_latest(landing.landed(spark, str(tmp_path / "in"), df.schema), ["k"], ["s"], str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("k", "s", "v")) == [(1, 2, "b"), (2, 1, "c")]


def test_edges_are_grouped_in_tasks_that_do_not_grow(spark, monkeypatch):
    from graphloom.operators import joins

    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    rows = spark.range(2000).selectExpr("id % 700 as a", "id % 900 as b", "id as n")
    edges = dedupe.undirected_edges(rows, "a", "b", ["n"])
    most = edges.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert edges.count() == len({(min(i % 700, i % 900), max(i % 700, i % 900)) for i in range(2000)}) and most < 200
    assert joins.spread(rows, "a", task_rows=1000) is rows
