"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, root): each id of ``links`` but the roots, with the least id of its component.

    Links may repeat, point either way or join an id to itself; links with a
    null end are ignored. An empty table gives an empty table. Every round
    hangs larger neighbours on the least neighbour of each id (a large star,
    then a small star), which takes O(log^2) rounds. A round is two
    aggregations with partial sums and two equi-joins whose hot keys adaptive
    execution can split; its links go to a written table, so a lost executor
    costs no more than a round, and those of the round before are deleted.
    """
    tables = Tables(links.sparkSession)
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = tables.put("links", edges)
    seen = _state(edges)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tables.put("links", small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
