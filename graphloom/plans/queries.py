"""Registered queries: each operator over whole tables, with the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dedupe, graph, joins, profile

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C = F.col
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(sql: str | None = None):
    """Registers a function of a table reader (name -> DataFrame) under its name."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINES = "(SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)"
TIERED = f"""(SELECT o.*, coalesce(n, 0) AS lines,
 CASE WHEN o_totalprice >= 200000 AND coalesce(n, 0) >= 4 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'candidate' END AS tier,
 CASE WHEN o_totalprice >= 200000 AND coalesce(n, 0) >= 4 THEN 'score_and_support' WHEN o_totalprice >= 100000 THEN 'score' ELSE 'low_score' END AS tier_reason
 FROM orders o LEFT JOIN {LINES} l ON o_orderkey = l_orderkey)"""


def _tiered(t) -> DataFrame:
    kept = joins.keep_missing(t("orders"), t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "lines")
    return graph.tiered(kept, C("o_totalprice"), C("lines"), (200000.0, 4), 100000.0)


@query(f"SELECT o_orderpriority AS priority, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'medium') AS medium, count(*) FILTER (tier = 'candidate') AS candidate FROM {TIERED} GROUP BY 1")
def tier_pivot(t):
    return profile.pivot_counts(_tiered(t).withColumnRenamed("o_orderpriority", "priority"), "priority", "tier", ["high", "medium", "candidate"])


@query(f"SELECT o_orderkey AS order_id, lines, tier, tier_reason, tier AS evidence_level FROM {TIERED}")
def tier_orders(t):
    return _tiered(t).select(C("o_orderkey").alias("order_id"), "lines", "tier", "tier_reason", C("tier").alias("evidence_level"))


@query(f"SELECT o_orderkey, tier FROM {TIERED} WHERE tier IN ('high', 'medium')")
def tier_filter(t):
    return _tiered(t).where(C("tier").isin("high", "medium")).select("o_orderkey", "tier")


@query(f"SELECT (SELECT count(*) FROM {TIERED}) AS in_tiers, (SELECT count(*) FROM orders) AS raw_rows, (SELECT count(*) FROM {TIERED}) = (SELECT count(*) FROM orders) AS conserved")
def conservation_check(t):
    tiers = _tiered(t).groupBy("tier").count().agg(F.sum("count").alias("in_tiers"))
    raw = t("orders").agg(F.count("*").alias("raw_rows"))
    both = tiers.withColumn("k", F.lit(1)).join(raw.withColumn("k", F.lit(1)), "k")
    return both.select("in_tiers", "raw_rows", (C("in_tiers") == C("raw_rows")).alias("conserved"))


@query("SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, 'TPCH' AS source, CAST(9606 AS BIGINT) AS taxon FROM customer")
def scan_project(t):
    return t("customer").select(C("c_custkey").alias("customer_id"), C("c_name").alias("name"), C("c_mktsegment").alias("segment"), F.lit("TPCH").alias("source"), F.lit(9606).cast("long").alias("taxon"))


@query("SELECT 'CUST:' || c_custkey AS node_id, 'NATION:' || c_nationkey AS nation_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'SEG:' || c_mktsegment ELSE '' END AS segment_id FROM customer")
def id_namespacing(t):
    return t("customer").select(S.namespaced("CUST:", "c_custkey").alias("node_id"), S.namespaced("NATION:", "c_nationkey").alias("nation_id"), S.namespaced("SEG:", F.when(C("c_mktsegment") == "BUILDING", C("c_mktsegment"))).alias("segment_id"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(upper(trim(c_name)), '^CUSTOMER', ''), '^#', '') AS bare, regexp_replace(c_name, '1$', '') AS stem FROM customer")
def id_normalize(t):
    return t("customer").select("c_custkey", S.without_prefixes("c_name", "CUSTOMER", "#").alias("bare"), S.without_suffix("c_name", "1").alias("stem"))


@query("SELECT p_partkey, replace(lower(p_name), ' ', '_') AS slug FROM part")
def slug_lower_replace(t):
    return t("part").select("p_partkey", S.slug("p_name").alias("slug"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ';'), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts, CAST(len(list_filter(string_split(p_name, ' '), lambda x: trim(x) <> '')) AS BIGINT) AS n FROM part")
def split_list_filter(t):
    parts = S.split_list("p_name", "; ")
    return t("part").select("p_partkey", S.joined_list(parts, "|").alias("parts"), F.size(parts).cast("long").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_extract(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT o_orderkey, TRY_CAST(CASE WHEN regexp_full_match(substr(o_orderpriority, 1, 2), '[0-9]+') THEN substr(o_orderpriority, 1, 2) END AS BIGINT) AS bad, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS rank, coalesce(TRY_CAST(substr(o_orderpriority, 3) AS DOUBLE), 0.0) AS filled FROM orders")
def safe_cast(t):
    return t("orders").select("o_orderkey", S.safe_number(F.substring("o_orderpriority", 1, 2), "bigint").alias("bad"), S.strict_number(F.substring("o_orderpriority", 1, 1), "bigint").alias("rank"), F.coalesce(S.safe_number(F.substring("o_orderpriority", 3, 99)), F.lit(0.0)).alias("filled"))


@query("SELECT event_id, nullif(CASE WHEN event_type = 'click' THEN '' ELSE event_type END, '') AS kind, coalesce(nullif(CASE WHEN event_type = 'click' THEN '' ELSE event_type END, ''), 'none') AS kind_or_none FROM events")
def blank_default(t):
    cell = F.when(C("event_type") == "click", "").otherwise(C("event_type"))
    return t("events").select("event_id", S.blank_to_null(cell).alias("kind"), S.default_blank(cell, F.lit("none")).alias("kind_or_none"))


@query("""WITH w AS (SELECT user_id, max(value) FILTER (event_type = 'purchase') AS p, max(value) FILTER (event_type = 'click') AS c, max(value) FILTER (event_type = 'view') AS v FROM events GROUP BY 1)
SELECT user_id, CASE WHEN p IS NOT NULL THEN 'purchase' WHEN c IS NOT NULL THEN 'click' WHEN v IS NOT NULL THEN 'view' END AS name, coalesce(p, c, v) AS value FROM w""")
def first_nonblank_priority(t):
    wide = t("events").groupBy("user_id").agg(*(F.max(F.when(C("event_type") == k, C("value"))).alias(k) for k in ("purchase", "click", "view")))
    return wide.withColumn("first", S.first_present(*((k, k) for k in ("purchase", "click", "view")))).select("user_id", "first.name", "first.value")


@query("SELECT c_custkey, a.code FROM customer JOIN (VALUES ('building', 'B'), ('machinery', 'M'), ('household', 'H')) a(name, code) ON lower(c_mktsegment) = a.name")
def dict_lookup_casefold(t):
    customers = t("customer")
    alias = customers.sparkSession.createDataFrame([("building", "B"), ("machinery", "M"), ("household", "H")], "name string, code string")
    return customers.join(alias, F.lower("c_mktsegment") == C("name")).select("c_custkey", "code")


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 50000 THEN 'score' END, CASE WHEN o_orderstatus = 'F' THEN 'status' END) AS missing FROM orders")
def required_missing_list(t):
    cells = t("orders").select("o_orderkey", F.when(C("o_totalprice") >= 50000, C("o_totalprice")).alias("score"), F.when(C("o_orderstatus") != "F", C("o_orderstatus")).otherwise("").alias("status"))
    return cells.select("o_orderkey", S.missing_fields("score", "status").alias("missing"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1'))")
def equality_semi_filter(t):
    chosen = t("part").where(F.startswith("p_brand", F.lit("Brand#1"))).select(C("p_partkey").alias("l_partkey"))
    return t("lineitem").where("l_returnflag = 'R'").join(chosen, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT event_id, value FROM events WHERE coalesce(value, 0.0) >= 50.0")
def numeric_floor(t):
    """A missing value counts as 0, so a floor above it is a plain comparison, which the scan takes."""
    return t("events").where(C("value") >= 50.0).select("event_id", "value")


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND upper(replace(o_orderpriority, '1-URGENT', 'building')) = upper(c_mktsegment)")
def exact_ci_match(t):
    """The name that was asked for and the name of the answer, in any case."""
    asked = t("orders").select("o_orderkey", "o_custkey", F.replace("o_orderpriority", F.lit("1-URGENT"), F.lit("building")).alias("asked"))
    return asked.join(t("customer"), (C("o_custkey") == C("c_custkey")) & (F.upper("asked") == F.upper("c_mktsegment"))).select("o_orderkey", "c_custkey")


@query("SELECT user_id, event_type, event_id, ts, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_last_wins(t):
    return dedupe.last_wins(t("events"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, md5(text) AS text_md5 FROM documents GROUP BY text")
def dedupe_first_wins(t):
    return dedupe.first_wins(t("documents").withColumn("text_md5", F.md5("text")).select("doc_id", "lang", "source", "text_md5"), ["text_md5"], ["doc_id"])


@query("SELECT user_id, string_agg(event_type, ';' ORDER BY ts, event_id) AS event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1) GROUP BY 1")
def ordered_merge_distinct(t):
    return dedupe.ordered_merge(t("events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("""SELECT edge_id, l_suppkey, l_partkey FROM (SELECT least(l_suppkey, l_partkey) || '|' || greatest(l_suppkey, l_partkey) AS edge_id, least(l_suppkey, l_partkey) AS l_suppkey, greatest(l_suppkey, l_partkey) AS l_partkey FROM lineitem) GROUP BY ALL""")
def undirected_edges(t):
    return dedupe.undirected_edges(t("lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"), "l_suppkey", "l_partkey", ["l_orderkey", "l_linenumber"]).select("edge_id", "l_suppkey", "l_partkey")


@query("SELECT l_suppkey, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS p_brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def set_join_sorted(t):
    return dedupe.set_join(t("lineitem").join(t("part"), C("l_partkey") == C("p_partkey")).select("l_suppkey", "p_brand"), ["l_suppkey"], "p_brand")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def inner_lookup(t):
    return t("orders").join(t("customer"), C("o_custkey") == C("c_custkey")).join(t("nation"), C("c_nationkey") == C("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("""WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part), i AS (SELECT word, count(*) AS n_parts FROM w GROUP BY 1)
SELECT p_partkey, word, n_parts FROM w JOIN i USING (word) WHERE word <> ''""")
def fanout_join(t):
    words = S.split_list("p_name", " ")
    index = t("part").select("p_partkey", F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("n_parts"))
    return joins.fanout(t("part").select("p_partkey", "p_name"), [S.split_list("p_name", " ")], index, "word").select("p_partkey", "word", "n_parts")


@query("""SELECT c_custkey, c_name, coalesce(a.nation, b.nation) AS nation, CASE WHEN a.nation IS NOT NULL THEN 'id' WHEN b.nation IS NOT NULL THEN 'name' ELSE '' END AS mapping_input,
CASE WHEN coalesce(a.nation, b.nation) IS NOT NULL THEN 'mapped' ELSE 'missing' END AS mapping_status FROM customer
LEFT JOIN (SELECT c_custkey, c_nationkey AS nation FROM customer WHERE c_acctbal > 0) a USING (c_custkey) LEFT JOIN (SELECT c_name, c_nationkey AS nation FROM customer WHERE c_mktsegment = 'BUILDING') b USING (c_name)""")
def fallback_join(t):
    known = t("customer").withColumnRenamed("c_nationkey", "nation")
    return joins.fallback(t("customer").select("c_custkey", "c_name"), known.where("c_acctbal > 0"), known.where("c_mktsegment = 'BUILDING'"), "c_custkey", "c_name", "nation")


@query("SELECT o_orderkey, coalesce(a.c_acctbal, b.s_acctbal) AS balance FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) a ON o_custkey = a.c_custkey LEFT JOIN supplier b ON o_custkey = b.s_suppkey")
def or_priority_join(t):
    rich = t("customer").where("c_acctbal > 0")
    found = t("orders").join(rich, C("o_custkey") == C("c_custkey"), "left").join(t("supplier"), C("o_custkey") == C("s_suppkey"), "left")
    return found.select("o_orderkey", F.coalesce("c_acctbal", "s_acctbal").alias("balance"))


@query(f"SELECT o_orderkey, coalesce(n, 0) AS lines, CASE WHEN n > 0 THEN 'mapped' ELSE 'missing' END AS mapping_status FROM orders LEFT JOIN {LINES} ON o_orderkey = l_orderkey")
def left_keep_missing(t):
    return joins.keep_missing(t("orders").select("o_orderkey"), t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "lines")


SPELT = "(SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'path:' || c_name ELSE upper(c_name) END AS spelt FROM customer)"


@query(f"SELECT c_custkey, coalesce(a.c_mktsegment, b.c_mktsegment, '') AS c_mktsegment FROM {SPELT} LEFT JOIN (SELECT c_name, c_mktsegment FROM customer WHERE c_nationkey < 20) a ON a.c_name = spelt LEFT JOIN (SELECT c_name, c_mktsegment FROM customer WHERE c_nationkey < 20) b ON upper(b.c_name) = upper(regexp_replace(spelt, '^path:', ''))")
def lookup_two_spellings(t):
    """Ids as they are written, or else without their prefix and in one case."""
    rows = t("customer").select("c_custkey", F.when(C("c_acctbal") > 0, F.concat(F.lit("path:"), "c_name")).otherwise(F.upper("c_name")).alias("spelt"))
    names = t("customer").where("c_nationkey < 20").select("c_name", "c_mktsegment")
    both = names.union(names.select(F.upper("c_name"), "c_mktsegment")).dropDuplicates(["c_name"])
    return joins.by_spelling(rows, both, "c_name", [C("spelt"), F.upper(F.regexp_replace("spelt", "^path:", ""))], "c_mktsegment").drop("spelt")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_scope(t):
    return t("documents").join(t("labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_scope(t):
    return t("orders").join(t("lineitem"), C("o_orderkey") == C("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000) ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def edge_resolution(t):
    sources = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    targets = t("customer").where("c_acctbal > 1000").withColumnRenamed("c_custkey", "o_custkey")
    return joins.resolve_edges(t("orders").select("o_orderkey", "o_custkey"), sources, targets, "o_orderkey", "o_custkey")


@query("WITH s AS (SELECT l_orderkey || '-' || l_linenumber AS line, l_orderkey, l_linenumber FROM lineitem) SELECT a.line AS source, b.line AS target, CAST(1 AS BIGINT) AS delta FROM s a JOIN s b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
def stage_progression(t):
    """Each line of an order and the one after it."""
    stages = t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), "l_orderkey", "l_linenumber")
    return joins.next_stage(stages, "line", "l_linenumber", "l_orderkey")


@query("SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'supplier', count(*) FROM supplier")
def global_counts(t):
    return graph.violations({n: t(n) for n in ("customer", "orders", "lineitem", "supplier")}).select(C("rule").alias("label"), C("violations").alias("n"))


@query("SELECT count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_quantity >= 25) AS large, count(*) AS n FROM lineitem")
def cond_count(t):
    return t("lineitem").agg(F.count_if(C("l_returnflag") == "R").alias("returned"), F.count_if(C("l_quantity") >= 25).alias("large"), F.count("*").alias("n"))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def group_count(t):
    return t("customer").groupBy(C("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def pivot_count(t):
    return profile.pivot_counts(t("orders").withColumnRenamed("o_orderstatus", "status"), "status", "o_orderpriority", PRIORITIES)


@query("SELECT s_nationkey, count(DISTINCT s_suppkey) AS suppliers, min(s_acctbal) AS least, max(s_acctbal) AS most FROM supplier GROUP BY 1")
def distinct_and_range(t):
    return t("supplier").groupBy("s_nationkey").agg(F.countDistinct("s_suppkey").alias("suppliers"), F.min("s_acctbal").alias("least"), F.max("s_acctbal").alias("most"))


@query("WITH x AS (SELECT nullif(o_orderstatus, 'F') AS status, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price, o_orderkey AS k FROM orders) SELECT 'status' AS field, count(*) AS rows, count(status) AS present, count(*) - count(status) AS empty FROM x UNION ALL SELECT 'price', count(*), count(price), count(*) - count(price) FROM x UNION ALL SELECT 'k', count(*), count(k), count(*) - count(k) FROM x")
def field_profile(t):
    cells = t("orders").select(F.nullif(C("o_orderstatus"), F.lit("F")).alias("status"), F.when(C("o_totalprice") > 100000, C("o_totalprice")).alias("price"), C("o_orderkey").alias("k"))
    return profile.field_profile(cells)


@query("SELECT 'Order' AS src, 'PLACED_BY' AS type, 'Customer' AS dst, count(*) AS edges FROM orders UNION ALL SELECT 'Supplier', 'IN', 'Nation', count(*) FROM supplier UNION ALL SELECT 'Customer', 'IN', 'Nation', count(*) FROM customer")
def endpoint_pattern(t):
    return graph.endpoint_patterns({("Order", "PLACED_BY", "Customer"): t("orders"), ("Supplier", "IN", "Nation"): t("supplier"), ("Customer", "IN", "Nation"): t("customer")})


@query("SELECT p_brand, p_name, p_partkey FROM part ORDER BY p_brand, p_name, p_partkey LIMIT 20")
def sort_two_keys_topk(t):
    return t("part").select("p_brand", "p_name", "p_partkey").orderBy("p_brand", "p_name", "p_partkey").limit(20)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') ASC NULLS LAST, o_orderkey) AS place FROM orders")
def nulls_last_order(t):
    order = W.partitionBy("o_custkey").orderBy(F.nullif(C("o_orderstatus"), F.lit("F")).asc_nulls_last(), "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT 'C' || c_custkey AS node_id, c_name AS name, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name, NULL, 'supplier' FROM supplier")
def union_sources(t):
    c = t("customer").select(F.concat(F.lit("C"), "c_custkey").alias("node_id"), C("c_name").alias("name"), C("c_mktsegment").alias("segment"), F.lit("customer").alias("source"))
    s = t("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node_id"), C("s_name").alias("name"), F.lit("supplier").alias("source"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_custkey, CASE WHEN b.o_orderkey IS NOT NULL THEN 'U' ELSE a.o_orderstatus END AS o_orderstatus
FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT * FROM orders WHERE o_totalprice < 150000) b ON a.o_orderkey = b.o_orderkey""")
def node_upsert(t):
    base = t("orders").where("o_orderstatus != 'P'").select("o_orderkey", "o_custkey", "o_orderstatus")
    batch = t("orders").where("o_totalprice < 150000").select("o_orderkey", F.lit("U").alias("o_orderstatus"))
    return graph.upsert(base, batch, "o_orderkey")


@query("""SELECT o_orderkey || '>' || o_custkey AS edge_id, o_orderkey, o_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS touched FROM orders JOIN customer ON o_custkey = c_custkey""")
def edge_upsert(t):
    edges = t("orders").select(F.concat_ws(">", "o_orderkey", "o_custkey").alias("edge_id"), "o_orderkey", "o_custkey", F.lit(0).alias("touched"))
    building = t("customer").where("c_mktsegment = 'BUILDING'").select(C("c_custkey").alias("o_custkey"))
    batch = edges.join(building, "o_custkey", "left_semi").select("edge_id", "o_orderkey", "o_custkey", F.lit(1).alias("touched"))
    return graph.upsert(edges, batch, "edge_id", ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def constraint_violations(t):
    return graph.duplicate_keys(t("lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT 'orders_without_lines' AS rule, count(*) AS violations FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'documents_without_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'lines_of_unknown_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'customers_outside_asia', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""")
def scope_audit(t):
    asia = t("nation").join(t("region").where("r_name = 'ASIA'"), C("n_regionkey") == C("r_regionkey"), "left_semi")
    return graph.violations({
        "orders_without_lines": t("orders").join(t("lineitem"), C("o_orderkey") == C("l_orderkey"), "left_anti"),
        "documents_without_label": t("documents").join(t("labels"), "doc_id", "left_anti"),
        "lines_of_unknown_part": t("lineitem").join(t("part"), C("l_partkey") == C("p_partkey"), "left_anti"),
        "customers_outside_asia": t("customer").join(asia, C("c_nationkey") == C("n_nationkey"), "left_anti"),
    })


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_xref(t):
    return t("orders").join(t("lineitem"), C("o_orderkey") == C("l_orderkey"), "left_anti").select("o_custkey").distinct()


@query("SELECT doc_id AS document_id, lang AS language, coalesce(CAST(quality AS VARCHAR), 'unlabelled') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def rename_prune_backfill(t):
    found = t("documents").withColumnsRenamed({"lang": "language"}).join(t("labels"), "doc_id", "left")
    return found.select(C("doc_id").alias("document_id"), "language", F.coalesce(C("quality").cast("string"), F.lit("unlabelled")).alias("quality"))


@query("SELECT 'PRIORITY' AS type, o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') UNION ALL SELECT 'NORMAL', o_orderkey, o_custkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def edge_type_split(t):
    urgent = C("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return t("orders").where("o_orderpriority is not null").select(F.when(urgent, "PRIORITY").otherwise("NORMAL").alias("type"), "o_orderkey", "o_custkey")


@query("SELECT p_partkey, CAST(i AS BIGINT) AS position, string_split(p_name, ' ')[i] AS word, CAST(chr(39) || replace(string_split(p_name, ' ')[i], chr(39), chr(92) || chr(39)) || chr(39) AS VARCHAR) AS quoted FROM part, unnest(generate_series(1, len(string_split(p_name, ' ')))) u(i)")
def posexplode_schema(t):
    each = t("part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "word"))
    quoted = F.concat(F.lit("'"), F.replace("word", F.lit("'"), F.lit("\\'")), F.lit("'"))
    return each.select("p_partkey", (C("at") + 1).cast("long").alias("position"), "word", quoted.alias("quoted"))


@query("SELECT CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'bigint' ELSE 'other' END AS type, count(*) AS n FROM events GROUP BY 1")
def json_types(t):
    return t("events").select(profile.json_type(F.get_json_object("props", "$.k")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT n_name AS nation FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey")
def union_distinct(t):
    keys = t("customer").select(C("c_nationkey").alias("n_nationkey")).union(t("supplier").select("s_nationkey")).distinct()
    return t("nation").join(keys, "n_nationkey", "left_semi").select(C("n_name").alias("nation")).distinct()


@query("SELECT l_partkey, l_suppkey, count(*) AS merged FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2")
def keyless_edge_upsert(t):
    lines = joins.spread(t("lineitem").select("l_partkey", "l_suppkey"), "l_partkey")  # ends and edges are grouped in tasks that do not grow with the table
    found = joins.resolve_edges(lines, t("part").withColumnRenamed("p_partkey", "l_partkey"), t("supplier").where("s_acctbal > 0").withColumnRenamed("s_suppkey", "l_suppkey"), "l_partkey", "l_suppkey")
    return found.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("merged"))


@query("""SELECT r_name AS region, p_brand AS brand, count(*) AS paths, count(DISTINCT c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def traceability(t):
    """Paths of several hops from a region to a brand."""
    where = t("customer").join(t("nation"), C("c_nationkey") == C("n_nationkey")).join(t("region"), C("n_regionkey") == C("r_regionkey"))
    lines = t("lineitem").join(t("part"), C("l_partkey") == C("p_partkey")).groupBy("l_orderkey", "p_brand").agg(F.count("*").alias("n"))
    paths = t("orders").join(where, C("o_custkey") == C("c_custkey")).join(lines, C("o_orderkey") == C("l_orderkey"))
    each = paths.groupBy(C("r_name").alias("region"), C("p_brand").alias("brand"), "c_custkey").agg(F.sum("n").alias("n"))
    return each.groupBy("region", "brand").agg(F.sum("n").alias("paths"), F.count("*").alias("customers"))


@query("SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS BIGINT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def map_explode(t):
    return t("events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")))


@query("""SELECT field, type, count(*) AS n FROM (SELECT unnest(['event_type', 'value', 'props']) AS field, unnest(['string', CASE WHEN value >= 50 THEN 'double' ELSE 'null' END, CASE WHEN json_type(props) = 'OBJECT' THEN 'object' ELSE 'other' END]) AS type FROM events) GROUP BY 1, 2""")
def type_histogram(t):
    cells = t("events").select(F.col("event_type"), F.when(C("value") >= 50, C("value")).alias("value"), F.parse_json("props").alias("props"))
    return profile.type_histogram(cells)


ASIA = "(SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"
NEAR_ORDERS = f"(SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN {ASIA}))"
NEAR_SUPPLIERS = f"(SELECT s_suppkey FROM supplier WHERE s_nationkey IN {ASIA})"


def _near(t) -> tuple[DataFrame, DataFrame]:
    """Keys of the orders and the suppliers of Asia."""
    asia = t("nation").join(t("region").where("r_name = 'ASIA'"), C("n_regionkey") == C("r_regionkey"), "left_semi")
    customers = t("customer").join(asia, C("c_nationkey") == C("n_nationkey"), "left_semi")
    orders = t("orders").join(customers, C("o_custkey") == C("c_custkey"), "left_semi").select("o_orderkey")
    return orders, t("supplier").join(asia, C("s_nationkey") == C("n_nationkey"), "left_semi").select("s_suppkey")


@query(f"""SELECT 'edges_with_an_end_outside' AS rule, count(*) AS violations FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN {NEAR_ORDERS} OR l_suppkey NOT IN {NEAR_SUPPLIERS})
UNION ALL SELECT 'parts_without_a_supplier_inside', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN {NEAR_SUPPLIERS})
UNION ALL SELECT 'suppliers_of_an_order_outside', count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey NOT IN {NEAR_ORDERS}
UNION ALL SELECT 'lines_from_an_order_outside', count(*) FROM lineitem WHERE l_orderkey NOT IN {NEAR_ORDERS}
UNION ALL SELECT 'customers_without_an_order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def scope_layers(t):
    """Counters of edges by both ends, of nodes two hops away and of distinct nodes; the lines are grouped once for the first, third and fourth."""
    orders, suppliers = _near(t)
    near_order, near_supplier = orders.withColumn("near_order", F.lit(True)), suppliers.withColumn("near_supplier", F.lit(True))
    by_supplier = C("l_suppkey") == C("s_suppkey")
    pairs = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    marked = pairs.join(near_order, C("l_orderkey") == C("o_orderkey"), "left").join(near_supplier, by_supplier, "left")
    outside = C("near_order").isNull()
    each = marked.groupBy("l_suppkey").agg(F.count_if(outside | C("near_supplier").isNull()).alias("edges"), F.sum(F.when(outside, C("n")).otherwise(0)).alias("lines"), F.max(outside.cast("long")).alias("suppliers"))
    sums = each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("edges", "edges_with_an_end_outside"), ("suppliers", "suppliers_of_an_order_outside"), ("lines", "lines_from_an_order_outside"))))
    return sums.unpivot([], sums.columns, "rule", "violations").unionByName(graph.violations({
        "parts_without_a_supplier_inside": t("part").join(t("lineitem").join(suppliers, by_supplier, "left_semi"), C("p_partkey") == C("l_partkey"), "left_anti"),
        "customers_without_an_order": t("customer").join(t("orders"), C("c_custkey") == C("o_custkey"), "left_anti"),
    }))


@query(f"""SELECT l_returnflag AS layer, count(*) AS edges, count(DISTINCT l_partkey) AS parts, min(l_quantity) AS least, max(l_quantity) AS most,
count(*) FILTER (l_suppkey NOT IN {NEAR_SUPPLIERS}) AS from_outside FROM lineitem GROUP BY 1""")
def layer_statistics(t):
    """Edges, distinct ends, range of a measure and edges from outside the scope, for each layer."""
    marked = t("lineitem").join(_near(t)[1].withColumn("inside", F.lit(True)), C("l_suppkey") == C("s_suppkey"), "left")
    # by part first, so that the distinct count needs no second copy of the rows
    parts = marked.groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count_if(C("inside").isNull()).alias("out"))
    return parts.groupBy(C("l_returnflag").alias("layer")).agg(F.sum("n").alias("edges"), F.count("l_partkey").alias("parts"), F.min("lo").alias("least"), F.max("hi").alias("most"), F.sum("out").alias("from_outside"))


@query("""SELECT c_custkey, a.c_mktsegment AS before, CASE WHEN a.c_acctbal < 0 THEN 'OVERDUE' ELSE a.c_mktsegment END AS after_once, CASE WHEN a.c_acctbal < 0 THEN 'OVERDUE' ELSE a.c_mktsegment END AS after_twice FROM customer a""")
def upsert_twice(t):
    """A snapshot before an upsert, the table after it, and after the same upsert again."""
    table = t("customer").select("c_custkey", "c_mktsegment")
    batch = t("customer").where("c_acctbal < 0").select("c_custkey", F.lit("OVERDUE").alias("c_mktsegment"))
    once = graph.upsert(table, batch, "c_custkey")
    renamed = [df.withColumnRenamed("c_mktsegment", n) for df, n in ((table, "before"), (once, "after_once"), (graph.upsert(once, batch, "c_custkey"), "after_twice"))]
    return renamed[0].join(renamed[1], "c_custkey").join(renamed[2], "c_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_clerk = '' THEN 'rejected' WHEN c_custkey IS NULL THEN 'rejected' WHEN o_totalprice >= 200000 AND n >= 4 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'candidate' END AS tier,
CASE WHEN o_clerk = '' THEN 'missing:status' WHEN c_custkey IS NULL THEN 'out_of_scope:' || o_custkey WHEN o_totalprice >= 200000 AND n >= 4 THEN 'score_and_support' WHEN o_totalprice >= 100000 THEN 'score' ELSE 'low_score' END AS tier_reason
FROM (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS o_clerk FROM orders) LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN """ + LINES + """ ON o_orderkey = l_orderkey""")
def tier_rejections(t):
    """Rows with missing fields and rows outside the scope are rejected before any score counts."""
    rows = joins.keep_missing(t("orders"), t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "lines").withColumn("status", F.when(C("o_orderstatus") == "P", "").otherwise(C("o_orderstatus")))
    scope = t("customer").where("c_acctbal > 0").select("c_custkey")
    return graph.tiered(rows, C("o_totalprice"), C("lines"), (200000.0, 4), 100000.0, S.missing_fields("status"), (C("o_custkey"), scope)).select("o_orderkey", "tier", "tier_reason")


@query("SELECT user_id, event_type, coalesce(string_agg(DISTINCT nullif(CASE WHEN value < 50 THEN '' ELSE CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) END, ''), ';' ORDER BY nullif(CASE WHEN value < 50 THEN '' ELSE CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) END, '')), '') AS tens FROM events GROUP BY 1, 2")
def merge_with_blanks(t):
    """Keys whose values are all blank keep a blank; ordered by the values, so that SQL has the same order."""
    cells = t("events").select("user_id", "event_type", F.when(C("value") < 50, "").otherwise(F.floor(C("value") / 10).cast("string")).alias("tens")).withColumn("at", C("tens"))
    return dedupe.ordered_merge(cells, ["user_id", "event_type"], "tens", ["at"])


@query("""SELECT least(a, b) || '|' || greatest(a, b) AS edge_id, count(*) AS n FROM (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT nullif(l_suppkey, 1) AS a, nullif(l_partkey, 2) AS b FROM lineitem) WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY 1""")
def undirected_edges_with_gaps(t):
    """Rows that lack an end are no edges."""
    rows = t("lineitem").select(F.nullif(C("l_suppkey"), F.lit(1)).alias("a"), F.nullif(C("l_partkey"), F.lit(2)).alias("b"), "l_orderkey", "l_linenumber")
    return dedupe.undirected_edges(rows, "a", "b", ["l_orderkey", "l_linenumber"]).groupBy("edge_id").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT c_custkey, CASE WHEN k IS NOT NULL THEN status ELSE c_mktsegment END AS c_mktsegment, CASE WHEN k IS NOT NULL THEN 'run 2' END AS updated_at FROM customer LEFT JOIN b ON k = c_custkey""")
def upsert_repeated_keys(t):
    """A batch with many rows of a key and rows without one; the last by order counts, and what it touched is stamped."""
    table = t("customer").select("c_custkey", "c_mktsegment", F.lit(None).cast("string").alias("updated_at"))
    batch = t("orders").select(F.when(C("o_orderstatus") != "P", C("o_custkey")).alias("c_custkey"), C("o_orderstatus").alias("c_mktsegment"), "o_orderkey")
    return graph.upsert(table, batch, "c_custkey", ["o_orderkey"], ("updated_at", F.lit("run 2"))).select("c_custkey", "c_mktsegment", "updated_at")


@query("""WITH e AS (SELECT l_partkey || '>' || l_suppkey AS edge_id, l_partkey, l_suppkey, max(l_quantity) AS most FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL)
SELECT edge_id, l_partkey, l_suppkey, most FROM e UNION ALL SELECT l_partkey || '>' || l_suppkey, l_partkey, l_suppkey, 0.0 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') WHERE l_partkey || '>' || l_suppkey NOT IN (SELECT edge_id FROM e)""")
def edge_upsert_resolved(t):
    """Edges are merged by their id after both ends were found among the nodes."""
    lines = t("lineitem").select(F.concat_ws(">", "l_partkey", "l_suppkey").alias("edge_id"), "l_partkey", "l_suppkey", C("l_quantity").alias("most"), "l_returnflag")
    table = lines.where("l_returnflag = 'R'").select("edge_id", "l_partkey", "l_suppkey", F.lit(0.0).alias("most")).distinct()
    parts, suppliers = t("part").where("p_size > 10").select(C("p_partkey").alias("l_partkey")), t("supplier").where("s_acctbal > 0").select(C("s_suppkey").alias("l_suppkey"))
    return graph.upsert_edges(table, lines.drop("l_returnflag"), "edge_id", parts, suppliers, "l_partkey", "l_suppkey", ["most"])


@query("""SELECT 'buys: core not in the graph' AS rule, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'buys: order not in the graph', 0 UNION ALL SELECT 'holds: order not in the graph', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'holds: part not in the graph', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)
UNION ALL SELECT 'order without an edge', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10))
UNION ALL SELECT 'part without an edge', count(*) FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))""")
def graph_scope_audit(t):
    """The counters of a whole graph from its tables."""
    core = t("customer").where("c_acctbal > 0").select("c_custkey")
    nodes = {"order": t("orders").select("o_orderkey"), "part": t("part").where("p_size > 10").select("p_partkey")}
    edges = {"buys": ("core", "order", t("orders").select("o_custkey", "o_orderkey")), "holds": ("order", "part", t("lineitem").select("l_orderkey", "l_partkey"))}
    return graph.scope_audit(core, nodes, edges)


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END, ''), CASE WHEN c_acctbal > 0 THEN 'FILLED' END) AS segment FROM customer")
def backfill_by_key(t):
    table = t("customer").select("c_custkey", F.when(C("c_mktsegment") == "BUILDING", "").otherwise(C("c_mktsegment")).alias("segment"))
    return graph.backfill(table, t("customer").where("c_acctbal > 0").select("c_custkey", F.lit("FILLED").alias("segment")), "c_custkey", "segment")


@query("""SELECT c_custkey, '{"a":{"k":' || c_nationkey || ',"z":null},"b":[{"m":"' || c_mktsegment || '","n":1}]}' AS json, CASE WHEN c_acctbal > 0 THEN c_name || ';x' ELSE '' END AS list, CAST(c_nationkey AS VARCHAR) AS single FROM customer""")
def sorted_json_text(t):
    """Nested values as JSON with sorted keys at every level; lists and single values as text."""
    cells = t("customer").select("c_custkey", F.struct(F.array(F.struct(F.lit(1).alias("n"), C("c_mktsegment").alias("m"))).alias("b"), F.struct(F.lit(None).cast("string").alias("z"), C("c_nationkey").alias("k")).alias("a")).alias("j"), F.when(C("c_acctbal") > 0, F.array("c_name", F.lit("x"))).alias("list"), "c_nationkey")
    return cells.select("c_custkey", S.json_text(cells, "j").alias("json"), S.list_text(cells, "list").alias("list"), S.list_text(cells, "c_nationkey").alias("single"))


@query("SELECT word, min(p_partkey * 100 + i) AS first_at FROM (SELECT p_partkey, i, string_split(p_name, ' ')[i] AS word FROM part, unnest(generate_series(1, len(string_split(p_name, ' ')))) u(i)) GROUP BY 1")
def first_writer_position(t):
    """Where each word is written first, over parts and positions."""
    each = t("part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "word"))
    return dedupe.first_wins(each, ["word"], ["p_partkey", "at"]).select("word", (C("p_partkey") * 100 + C("at") + 1).alias("first_at"))
