"""Registered queries of page archives and zip archives, written from tables and read back by Spark's data sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import paged, readers, zips
from ..sources.shared import new_folder
from .queries import query

C = F.col
_PAGE = 100  # records of a page
#: Orders of a stage by key, in pages; the crawl of stage F is told of too few records, that of O has an empty page in between
_PAGED = f"""(SELECT o_orderstatus AS stage, o_orderkey, o_totalprice, n // {_PAGE} + CASE WHEN o_orderstatus = 'O' AND n >= 30 * {_PAGE} THEN 1 ELSE 0 END AS page, n % {_PAGE} AS position,
 CASE WHEN o_orderstatus = 'F' THEN total // 2 ELSE total END AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_orderstatus) AS total FROM orders))"""
_REACHED = f"""(SELECT p.* FROM {_PAGED} p JOIN (SELECT stage, page, sum(count(*)) OVER (PARTITION BY stage ORDER BY page) - count(*) AS before, min(total) AS told FROM {_PAGED} GROUP BY stage, page) USING (stage, page)
 WHERE before < told AND NOT (stage = 'O' AND page > 30))"""


def _pages(t) -> DataFrame:
    """Envelopes of the orders of each status, a hundred to a page."""
    stages = t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("total"))
    # numbers in a stage: by ranges of keys first, so that no task has to number a whole stage
    ranged = t("orders").select("o_orderstatus", "o_orderkey", "o_totalprice", F.expr("o_orderkey div 4096").alias("range"))
    before = ranged.groupBy("o_orderstatus", "range").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(W.partitionBy("o_orderstatus").orderBy("range").rowsBetween(W.unboundedPreceding, -1))).drop("n").fillna(0, ["before"])
    in_range = F.row_number().over(W.partitionBy("o_orderstatus", "range").orderBy("o_orderkey")) - 1
    rows = ranged.withColumn("at", in_range).join(before, ["o_orderstatus", "range"]).withColumn("n", C("at") + C("before")).join(stages, "o_orderstatus")
    later = F.when((C("o_orderstatus") == "O") & (C("n") >= 30 * _PAGE), 1).otherwise(0)
    page = rows.groupBy(C("o_orderstatus").alias("stage"), (F.floor(C("n") / _PAGE) + later).cast("int").alias("page"), F.when(C("o_orderstatus") == "F", F.expr("total div 2")).otherwise(C("total")).alias("total"))
    full = page.agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("payload"))
    gap = stages.where(f"o_orderstatus = 'O' and total > {30 * _PAGE}").select(C("o_orderstatus").alias("stage"), F.lit(30).alias("page"), "total", F.array().cast("array<struct<o_orderkey:bigint,o_totalprice:double>>").alias("payload"))
    return full.unionByName(gap).select("stage", "page", F.struct(C("total").alias("totalElements"), C("page").alias("currentPageNumber")).alias("paging"), "payload", F.lit("OK").alias("status"), F.lit(200).alias("httpStatus"))


_RECORD = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])


@query(f"SELECT stage, page, position, o_orderkey, o_totalprice FROM {_REACHED}")
def page_archive(t):
    """A crawl's pages, one file each, read up to where its stop rules end it: at the total it is told, or at an empty page."""
    pages = _pages(t)
    path = new_folder(pages.sparkSession, "archive")
    paged.write(pages, path)
    found = paged.read(pages.sparkSession, path, _RECORD, task_rows=2000)
    return found.select("stage", C("page").cast("long").alias("page"), C("position").cast("long").alias("position"), "o_orderkey", "o_totalprice")


@query(f"SELECT stage, count(*) AS n, min(o_totalprice) AS least, max(page) AS last_page FROM {_REACHED} WHERE stage IN ('F', 'P') AND page < 3 AND o_totalprice > 200000 GROUP BY 1")
def page_archive_filtered(t):
    """The same pages without an index, three of each of two stages, and of their records those above a score; no other file is opened."""
    pages = _pages(t)
    path = new_folder(pages.sparkSession, "archive")
    paged.write(pages, path, index=False)
    found = paged.read(pages.sparkSession, path, _RECORD, stages=["F", "P"], where=[("o_totalprice", ">", 200000.0)], max_pages=3)
    return found.groupBy("stage").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max("page").cast("long").alias("last_page"))


@query("""SELECT 'parts-' || p_partkey // 500 || '.zip' AS archive, lower(replace(p_brand, '#', '')) || '.txt' AS member, CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand FROM part WHERE p_partkey % 7 <> 0""")
def zip_members(t):
    """Archives of several members, a task for each; lines with too few fields are left out."""
    line = F.concat_ws("\t", C("p_partkey").cast("string"), "p_brand", F.when(C("p_partkey") % 7 != 0, C("p_name")), F.lit("more"))
    short = F.when(C("p_partkey") % 7 != 0, line).otherwise(F.concat_ws("\t", C("p_partkey").cast("string"), "p_brand"))
    rows = t("part").select(F.concat(F.lit("parts-"), F.expr("p_partkey div 500"), F.lit(".zip")).alias("archive"), F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".txt")).alias("member"), C("p_partkey").alias("at"), short.alias("text"))
    path = new_folder(rows.sparkSession, "zips")
    zips.write(rows, path)
    found = zips.lines(rows.sparkSession, path, "*.txt")
    kept = readers.fields(found.withColumn("text", F.concat_ws("\t", F.substring_index("archive", "/", -1), "member", "text")), "text", ["archive", "member", "id", "brand", "name"])
    return kept.select("archive", "member", "id", "brand")


@query("SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def zip_ranges(t):
    """Large members that are stored without compression are read in byte ranges, each line by the range that it starts in."""
    rows = t("lineitem").select(F.concat(F.expr("l_orderkey div 32768"), F.lit(".zip")).alias("archive"), F.concat("l_linestatus", F.lit(".tsv")).alias("member"), C("l_orderkey").alias("at"), F.concat_ws("\t", "l_orderkey", "l_returnflag").alias("text"))
    path = new_folder(rows.sparkSession, "zips")
    zips.write(rows, path, compress=False)
    parts = F.split("text", "\t")
    found = zips.lines(rows.sparkSession, path, "O.tsv", split=1 << 16).select(parts[1].alias("flag"), parts[0].cast("long").alias("key"))
    return found.groupBy("flag").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("SELECT s_suppkey, s_name AS name, CASE WHEN s_acctbal > 0 THEN 'a & <b>' END AS note FROM supplier")
def zip_elements(t):
    """Elements of XML members, a missing child being null; there is an archive for each fifty suppliers."""
    note = F.when(C("s_acctbal") > 0, F.lit("<note>a &amp; &lt;b&gt;</note>")).otherwise("")
    element = F.concat(F.lit("<supplier><s_suppkey>"), C("s_suppkey"), F.lit("</s_suppkey><name>"), C("s_name"), F.lit("</name>"), note, F.lit("</supplier>"))
    names = t("supplier").select(F.concat(F.expr("s_suppkey div 50"), F.lit(".zip")).alias("archive"), F.lit("suppliers.xml").alias("member"), C("s_suppkey").alias("at"), element.alias("text"))
    nations = names.select("archive", "member").distinct()
    root = nations.select("archive", "member", F.lit(-1).cast("long").alias("at"), F.lit('<suppliers xmlns="urn:x">').alias("text")).unionByName(nations.select("archive", "member", F.lit(1 << 62).cast("long").alias("at"), F.lit("</suppliers>").alias("text")))
    path = new_folder(names.sparkSession, "zips")
    zips.write(names.unionByName(root), path)
    fields = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("name", T.StringType()), T.StructField("note", T.StringType())])
    return zips.elements(names.sparkSession, path, "supplier", fields, "*.xml").select("s_suppkey", "name", "note")
