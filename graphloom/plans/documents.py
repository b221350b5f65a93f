"""Registered queries of documents whose fields only the data know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents
from ..operators.documents import Rule
from .queries import query

C = F.col


def _order_documents(t) -> DataFrame:
    """(o_orderkey, doc): a document of four levels for each order, whose lines are fields named by their parts; lines of one part are in one list."""
    flags = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_returnflag"))), lambda x: F.struct(x["l_suppkey"].alias("by"), x["l_returnflag"].alias("flag")))
    parts = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(flags.alias("lines"))
    lines = parts.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(C("l_partkey").cast("string"), F.struct("lines")))).alias("parts"))
    whole = t("orders").join(lines, C("o_orderkey") == C("l_orderkey"))
    meta = F.struct(C("o_custkey").alias("customer"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return whole.select("o_orderkey", F.to_json(F.struct(meta.alias("meta"), "parts")).alias("doc"))


_RULES = [
    Rule("meta.customer", "Customer"), Rule("meta.tags.[]", "Tag"),
    Rule("parts.*", "Part"), Rule("parts.*.lines.[].by", "Supplier", "SUPPLIED_BY", "Part", own=1), Rule("parts.*.lines.[].flag", "Flag", "FLAGGED", "Part", own=1),
]
_PLACED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_returnflag) AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""SELECT 'Customer' AS label, CAST(o_custkey AS VARCHAR) AS key, CAST(NULL AS INTEGER) AS position FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL
UNION ALL SELECT 'Tag', tag, arg_min(position, o_orderkey * 10 + position) FROM (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS tag, CAST(unnest([1, 2]) AS INTEGER) AS position FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) GROUP BY tag
UNION ALL SELECT 'Part', CAST(l_partkey AS VARCHAR), NULL FROM lineitem GROUP BY ALL
UNION ALL SELECT 'Supplier', CAST(l_suppkey AS VARCHAR), CAST(arg_min(place, (l_orderkey, CAST(l_partkey AS VARCHAR), place)) AS INTEGER) FROM {_PLACED} GROUP BY l_suppkey
UNION ALL SELECT 'Flag', l_returnflag, CAST(arg_min(place, (l_orderkey, CAST(l_partkey AS VARCHAR), place)) AS INTEGER) FROM {_PLACED} GROUP BY l_returnflag""")
def document_nodes(t):
    """Nodes of nested documents by patterns of their paths; a node that many documents write has the position that the first gave it."""
    return documents.graph_of(documents.flatten(_order_documents(t), "doc", "o_orderkey"), "o_orderkey", _RULES)[0]


@query("""SELECT DISTINCT 'SUPPLIED_BY' AS type, 'Part' AS source, CAST(l_partkey AS VARCHAR) AS source_key, 'Supplier' AS target, CAST(l_suppkey AS VARCHAR) AS target_key FROM lineitem
UNION ALL SELECT DISTINCT 'FLAGGED', 'Part', CAST(l_partkey AS VARCHAR), 'Flag', l_returnflag FROM lineitem""")
def document_edges(t):
    return documents.graph_of(documents.flatten(_order_documents(t), "doc", "o_orderkey"), "o_orderkey", _RULES)[1]


@query("""WITH p AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
o AS (SELECT l_orderkey, count(*) AS parts, sum(n) AS lines FROM p GROUP BY 1)
SELECT 'object' AS kind, 0 AS depth, count(*) AS n FROM o UNION ALL SELECT 'object', 1, 2 * count(*) FROM o UNION ALL SELECT 'array', 2, count(*) FROM o UNION ALL SELECT 'scalar', 2, count(*) FROM o
UNION ALL SELECT 'object', 2, CAST(sum(parts) AS BIGINT) FROM o UNION ALL SELECT 'scalar', 3, 2 * count(*) FROM o UNION ALL SELECT 'array', 3, CAST(sum(parts) AS BIGINT) FROM o
UNION ALL SELECT 'object', 4, CAST(sum(lines) AS BIGINT) FROM o UNION ALL SELECT 'scalar', 5, CAST(2 * sum(lines) AS BIGINT) FROM o""")
def document_levels(t):
    """How many values of each kind the documents have at each depth."""
    flat = documents.flatten(_order_documents(t), "doc", "o_orderkey")
    kind = F.when(C("kind").isin("object", "array"), C("kind")).otherwise("scalar")
    return flat.groupBy(kind.alias("kind"), F.size("path").alias("depth")).agg(F.count("*").alias("n"))


_RAGGED = """SELECT o_orderkey, o_orderstatus, o_totalprice, substr(o_orderpriority, 1, 1) AS p FROM orders"""


@query(f"""WITH o AS ({_RAGGED}), f AS (
SELECT 'id' AS field, 'bigint' AS type, 'filled' AS state FROM o
UNION ALL SELECT 'p' || p, 'bigint', 'filled' FROM o
UNION ALL SELECT 'status', CASE o_orderstatus WHEN 'F' THEN 'null' ELSE 'string' END, CASE o_orderstatus WHEN 'F' THEN 'nulls' WHEN 'P' THEN 'empty' ELSE 'filled' END FROM o WHERE o_totalprice > 50000
UNION ALL SELECT 'tags', CASE WHEN o_totalprice > 200000 THEN 'array[string:2]' ELSE 'array[0]' END, CASE WHEN o_totalprice > 200000 THEN 'filled' ELSE 'empty' END FROM o
UNION ALL SELECT 'parts', 'array[object:1]', 'filled' FROM o WHERE p = '2'),
g AS (SELECT field, type, count(*) AS n, count(*) FILTER (state = 'nulls') AS nulls, count(*) FILTER (state = 'empty') AS empty FROM f GROUP BY field, type)
SELECT field, (SELECT count(*) FROM o) AS rows, CAST((SELECT count(*) FROM o) - sum(n) AS BIGINT) AS absent, CAST(sum(nulls) AS BIGINT) AS nulls, CAST(sum(empty) AS BIGINT) AS empty,
CAST(sum(n) - sum(nulls) - sum(empty) AS BIGINT) AS filled, string_agg(type || '=' || n, ';' ORDER BY type) AS types FROM g GROUP BY field""")
def ragged_profile(t):
    """Fields differ by row and one is named by its value; absent, null, empty and filled ones are told apart."""
    status = F.when(C("o_orderstatus") == "F", "null").when(C("o_orderstatus") == "P", '""').otherwise(F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    fields = F.concat_ws(
        ",", F.concat(F.lit('"id":'), "o_orderkey"), F.concat(F.lit('"p'), F.substring("o_orderpriority", 1, 1), F.lit('":1')),
        F.when(C("o_totalprice") > 50000, F.concat(F.lit('"status":'), status)), F.when(C("o_totalprice") > 200000, '"tags":["a","b"]').otherwise('"tags":[]'),
        F.when(F.startswith("o_orderpriority", F.lit("2")), '"parts":[{"k":null}]'),
    )
    return documents.profile(t("orders").select(F.concat(F.lit("{"), fields, F.lit("}")).alias("doc")), "doc")
