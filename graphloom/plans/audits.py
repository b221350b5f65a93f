"""Registered queries of whole-graph audits and of checks made while writing."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph, masks
from ..operators.masks import Edges, Kind, Linked, Nodes, Table
from ..sources import checked, writers
from ..sources.shared import new_folder
from .queries import TIERED, _tiered, query

C = F.col
_ASIA = "(SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"
_LOCATED = "(SELECT DISTINCT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 1000)"
_GENES = f"(SELECT s_suppkey FROM {_LOCATED})"
_BESIDE = "(SELECT DISTINCT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem QUALIFY b IS NOT NULL)"
_SUPPLIED = "(SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"


@query(f"""SELECT 'nations outside' AS rule, count(*) AS violations FROM nation WHERE n_nationkey NOT IN {_ASIA}
UNION ALL SELECT 'follows: an end outside', count(*) FROM nation WHERE n_nationkey NOT IN {_ASIA} OR n_nationkey + 1 NOT IN {_ASIA}
UNION ALL SELECT 'suppliers without a nation', count(*) FROM supplier WHERE s_suppkey NOT IN {_GENES}
UNION ALL SELECT 'suppliers of a nation outside', count(DISTINCT s_suppkey) FROM {_LOCATED} WHERE s_nationkey NOT IN {_ASIA}
UNION ALL SELECT 'parts not supplied', count(*) FROM part WHERE p_partkey NOT IN {_SUPPLIED}
UNION ALL SELECT 'beside: an end not supplied', count(*) FROM {_BESIDE} WHERE a NOT IN {_SUPPLIED} OR b NOT IN {_SUPPLIED}
UNION ALL SELECT 'orders without a shipment', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)
UNION ALL SELECT 'ships: from a supplier without a nation', count(*) FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_quantity > 25) WHERE l_suppkey NOT IN {_GENES}
UNION ALL SELECT 'flagged: from a supplier without a nation', count(*) FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) WHERE l_suppkey NOT IN {_GENES}
UNION ALL SELECT 'expected: in a nation outside', count(*) FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') WHERE c_nationkey NOT IN {_ASIA}
UNION ALL SELECT 'customers without an order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'customers without a nation', count(*) FROM customer WHERE c_acctbal <= 0
UNION ALL SELECT 'customers of a nation outside', count(DISTINCT c_custkey) FROM customer WHERE c_acctbal > 0 AND c_nationkey NOT IN {_ASIA}""")
def masked_scope_audit(t):
    """Thirteen counters of five labels and eight kinds of edge, two of them two hops from the core; each table is scanned once."""
    lines = t("lineitem").withColumn("beside", F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    tables = [
        Table(t("nation").withColumn("next", C("n_nationkey") + 1), {"nation": "n_nationkey"}, (Kind("follows", ("nation", "n_nationkey"), ("nation", "next")),), {"nation": C("n_regionkey") == 2}),
        Table(t("supplier"), {"supplier": "s_suppkey"}, (Kind("located", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), C("s_acctbal") > 1000),)),
        Table(t("part"), {"part": "p_partkey"}),
        Table(t("orders"), {"order": "o_orderkey"}, (Kind("buys", ("customer", "o_custkey"), ("order", "o_orderkey"), C("o_orderstatus") == "P"),)),
        Table(t("customer"), {"customer": "c_custkey"}, (
            Kind("lives", ("customer", "c_custkey"), ("nation", "c_nationkey"), C("c_acctbal") > 0),
            Kind("expected", ("customer", "c_custkey"), ("nation", "c_nationkey"), C("c_mktsegment") == "BUILDING"),
        )),
        Table(lines, {}, (
            Kind("supplies", ("supplier", "l_suppkey"), ("part", "l_partkey"), C("l_returnflag") == "R"),
            Kind("ships", ("supplier", "l_suppkey"), ("order", "l_orderkey"), C("l_quantity") > 25),
            Kind("flagged", ("supplier", "l_suppkey"), ("flag", "l_returnflag")),
            Kind("beside", ("part", "l_partkey"), ("part", "beside"), C("beside").isNotNull()),
        )),
    ]
    return masks.audit(tables, [
        Nodes("nations outside", "nation"), Edges("follows: an end outside", "follows", "either"),
        Nodes("suppliers without a nation", "supplier", "located"), Linked("suppliers of a nation outside", "located", "source"),
        Nodes("parts not supplied", "part", "supplies"), Edges("beside: an end not supplied", "beside", "either", "supplies"),
        Nodes("orders without a shipment", "order", "ships"), Edges("ships: from a supplier without a nation", "ships", "source", "located"),
        Edges("flagged: from a supplier without a nation", "flagged", "source", "located"), Edges("expected: in a nation outside", "expected", "target"),
        Nodes("customers without an order", "customer", "buys"), Nodes("customers without a nation", "customer", "lives"), Linked("customers of a nation outside", "lives", "source"),
    ])


@query(f"""SELECT count(*) AS rows, count(*) FILTER (tier = 'high') AS "tier=high", count(*) FILTER (tier = 'medium') AS "tier=medium", count(*) FILTER (tier = 'candidate') AS "tier=candidate",
CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS VARCHAR) AS price, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (tier = 'high'), 0.00) AS VARCHAR) AS price_high,
CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (tier <> 'high') AS VARCHAR) AS price_rest, count(o_orderdate) AS dated, 'orders' AS source, true AS written FROM {TIERED}""")
def checked_tiers(t):
    """Tiers of orders, a folder each, with counts of the tiers, conserved sums, unique keys and required fields from the job that writes them; read from the metadata file."""
    price = C("o_totalprice").cast("decimal(18,2)")
    checks = checked.Checks(
        measures={"price": F.sum(price), "price_high": F.coalesce(F.sum(F.when(C("tier") == "high", price)), F.lit(0)), "price_rest": F.sum(F.when(C("tier") != "high", price)), "dated": F.count("o_orderdate")},
        layers={"tier": ["high", "medium", "candidate"]}, sums={"price": ["price_high", "price_rest"]}, require={"has a customer": C("o_custkey").isNotNull()}, unique=("o_orderkey",),
    )
    rows = _tiered(t)
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "checked")
    checked.write(rows, path, checks, ["tier"], {"source": "orders"})
    there = writers.exists(spark, path, f"{path}/tier=high", f"{path}/tier=medium", f"{path}/tier=candidate")
    found = checked.metadata(spark, path) | {"written": all(there.values())}
    return spark.createDataFrame([found])


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'OVERDUE' ELSE c_mktsegment END AS c_mktsegment, c_acctbal < 0 AS stamped, c_acctbal < 0 AS stamped_later, false AS changed_otherwise FROM customer""")
def upsert_stamped(t):
    """The same batch merged twice: its rows get the time of the merge, and the second merge changes nothing but that."""
    table = t("customer").select("c_custkey", "c_mktsegment", F.lit(None).cast("timestamp").alias("updated_at"))
    batch = t("customer").where("c_acctbal < 0").select("c_custkey", F.lit("OVERDUE").alias("c_mktsegment"))
    at = F.current_timestamp()
    once = graph.upsert(table, batch, "c_custkey", stamp=("updated_at", at - F.expr("interval 1 day")))
    twice = graph.upsert(once, batch, "c_custkey", stamp=("updated_at", at))
    both = once.toDF("c_custkey", "before", "first_at").join(twice, "c_custkey")
    changed = ~C("c_mktsegment").eqNullSafe(C("before"))
    return both.select("c_custkey", "c_mktsegment", C("first_at").isNotNull().alias("stamped"), F.coalesce(C("updated_at") > C("first_at"), F.lit(False)).alias("stamped_later"), changed.alias("changed_otherwise"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN p_size < 20 THEN NULL ELSE p_brand END, CASE WHEN p_size < 10 THEN '' ELSE p_type END, trim(CASE WHEN p_size < 30 THEN '  ' ELSE p_brand END)], lambda x: x IS NOT NULL AND x <> ''))), ';') AS refs,
p_size < 10 AS missing FROM part""")
def blank_cross_references(t):
    """Cross-references from several fields as one set: nulls, blanks and repeats are no references, and rows without any are marked."""
    refs = F.array(F.when(C("p_size") >= 20, C("p_brand")), F.when(C("p_size") < 10, "").otherwise(C("p_type")), F.trim(F.when(C("p_size") < 30, "  ").otherwise(C("p_brand"))))
    known = F.array_sort(F.array_distinct(F.filter(refs, lambda x: x.isNotNull() & (x != ""))))
    return t("part").select("p_partkey", F.array_join(known, ";").alias("refs"), (F.size(known) == 0).alias("missing"))
