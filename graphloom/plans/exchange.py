"""Registered queries of sources, sinks and streams: tables go out in an exchange format and come back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import dedupe
from ..sources import readers, writers
from ..sources.shared import new_folder
from ..streaming import landing
from .queries import QUERIES, SQL, C, _tiered, query


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS segment FROM customer")
def tsv_round_trip(t):
    """Null cells come back blank."""
    out = t("customer").select("c_custkey", "c_name", F.nullif(C("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    spark, path = out.sparkSession, new_folder(out.sparkSession, "tsv")
    writers.tsv(out, path, out.columns)
    return readers.tsv(spark, path, out.columns)


@query("SELECT event_id, event_type, CASE WHEN value >= 50 THEN value END AS value, props FROM events")
def jsonl_round_trip(t):
    out = t("events").select("event_id", "event_type", F.when(C("value") >= 50, C("value")).alias("value"), "props")
    spark, path = out.sparkSession, new_folder(out.sparkSession, "jsonl")
    writers.jsonl(out, path)
    return spark.read.schema(out.schema).json(path)


@query("SELECT o_orderstatus AS stage, o_orderkey // 100 AS page, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus, o_orderkey // 100 ORDER BY o_orderkey) - 1 AS position FROM orders")
def json_pages_scan(t):
    """Pages of at most 100 records in a folder for each stage, read back record by record."""
    record = F.struct("o_orderkey", "o_totalprice")
    # a key range holds at most 100 orders, so a page stays small
    pages = t("orders").groupBy(C("o_orderstatus").alias("stage"), F.expr("o_orderkey div 100").alias("page")).agg(F.sort_array(F.collect_list(record)).alias("payload"))
    spark, path = pages.sparkSession, new_folder(pages.sparkSession, "pages")
    writers.json_pages(pages, path, "stage")
    fields = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])
    found = readers.json_page_lines(spark, path, fields, T.StructType([T.StructField("stage", T.StringType()), T.StructField("page", T.LongType())]))
    return found.select("stage", "page", "o_orderkey", "o_totalprice", C("position").cast("long").alias("position"))


@query("SELECT tier, count(*) AS n, max(o_totalprice) AS most FROM (" + SQL["tier_orders"].replace("lines, tier,", "o_totalprice, tier,") + ") WHERE tier = 'high' GROUP BY 1")
def tier_folders(t):
    """One folder for each tier, of which the filter reads one."""
    out = _tiered(t).select("o_orderkey", "o_totalprice", "tier")
    spark, path = out.sparkSession, new_folder(out.sparkSession, "tiers")
    writers.by_tier(out, path)
    return spark.read.parquet(path).where("tier = 'high'").groupBy("tier").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand FROM part WHERE p_brand <> 'Brand#11'")
def positional_scan(t):
    """Lines of three fields, short ones (which have two) left out, the first two taken."""
    line = F.concat_ws("\t", C("p_partkey").cast("string"), "p_brand", F.when(C("p_brand") != "Brand#11", C("p_name")))
    spark, path = t("part").sparkSession, new_folder(t("part").sparkSession, "lines")
    t("part").select(line.alias("value")).write.text(path)
    return readers.positional(spark, path, ["id", "brand", "name"]).select("id", "brand")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || chr(9) || p_brand AS rest FROM part")
def pairs_scan(t):
    """Lines cut at the first tab only."""
    spark, path = t("part").sparkSession, new_folder(t("part").sparkSession, "pairs")
    t("part").select(F.concat_ws("\t", C("p_partkey").cast("string"), "p_name", "p_brand").alias("value")).write.text(path)
    return readers.pairs(spark, path, "id", "rest")


@query("SELECT s_suppkey, s_name AS name, CASE WHEN s_acctbal > 0 THEN 'rich & <sound>' ELSE '' END AS note FROM supplier")
def xml_round_trip(t):
    """Elements with text to escape; white space is cleaned, and a missing child is blank."""
    note = F.when(C("s_acctbal") > 0, F.lit(" rich &\n <sound> "))
    out = t("supplier").select("s_suppkey", C("s_name").alias("name"), note.alias("note"))
    spark, path = out.sparkSession, new_folder(out.sparkSession, "xml")
    out.write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(path)
    return readers.xml_records(spark, path, "supplier", out.schema).select("s_suppkey", S.clean_text("name").alias("name"), S.clean_text("note").alias("note"))


@query("SELECT c_custkey, 'q=' || url_encode(c_name) || '&nation=' || c_nationkey AS params FROM customer")
def url_params(t):
    params = F.concat(F.lit("q="), F.url_encode("c_name"), F.lit("&nation="), C("c_nationkey").cast("string"))
    return t("customer").select("c_custkey", params.alias("params"))


@query(SQL["dedupe_last_wins"])
def stream_latest(t):
    """Events as a stream of landed files; the last row of each key of all batches."""
    events = t("events")
    spark, path, keys, order = events.sparkSession, new_folder(events.sparkSession, "stream"), ["user_id", "event_type"], ["ts", "event_id"]
    landed = new_folder(spark, "landed")
    events.write.parquet(landed)
    stream = landing.append_latest(landing.landed(spark, landed, events.schema), keys, order, f"{path}/rows", f"{path}/progress")
    stream.awaitTermination()
    return dedupe.last_wins(spark.read.schema(events.schema).parquet(f"{path}/rows").select(events.columns), keys, order)


__all__ = ["QUERIES", "SQL"]
