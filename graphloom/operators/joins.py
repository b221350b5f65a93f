"""Joins that resolve rows against keyed tables. All conditions are equalities; Spark picks the strategy by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a task of ``spread``
TASK_ROWS = 500_000


def spread(rows: DataFrame, *keys: str, task_rows: int | None = None) -> DataFrame:
    """``rows`` by keys in tasks of about ``task_rows`` rows, where the session's number of tasks would give larger ones; counts ``rows`` first."""
    parts = -(-rows.count() // (task_rows or TASK_ROWS))
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def fanout(rows: DataFrame, lists: list[Column], index: DataFrame, key: str) -> DataFrame:
    """A row for each match of any distinct element of the lists with ``key`` of ``index``."""
    each = rows.withColumn(key, F.explode(F.array_distinct(F.concat(*lists))))
    return each.join(index, key)


def fallback(rows: DataFrame, by_id: DataFrame, by_name: DataFrame, id_key: str, name_key: str, value: str) -> DataFrame:
    """``value`` by id, else by name; ``mapping_input`` says which and ``mapping_status`` if any did.

    Both tables must be unique by their key. Rows without a match stay.
    """
    a = by_id.select(F.col(id_key), F.col(value).alias("_a"))
    b = by_name.select(F.col(name_key), F.col(value).alias("_b"))
    found = rows.join(a, id_key, "left").join(b, name_key, "left")
    return found.withColumns({
        value: F.coalesce("_a", "_b"),
        "mapping_input": F.when(F.col("_a").isNotNull(), "id").when(F.col("_b").isNotNull(), "name").otherwise(""),
        "mapping_status": F.when(F.coalesce("_a", "_b").isNotNull(), "mapped").otherwise("missing"),
    }).drop("_a", "_b")


def keep_missing(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Every row with the number of facts of its key, 0 included, and ``mapped`` or ``missing``."""
    counted = facts.groupBy(key).agg(F.count("*").alias(count))
    n = F.coalesce(count, F.lit(0).cast("long"))
    return rows.join(counted, key, "left").withColumns({count: n, "mapping_status": F.when(n > 0, "mapped").otherwise("missing")})


def resolve_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, source: str, target: str) -> DataFrame:
    """Edges of which both ends exist."""
    return edges.join(sources.select(source).distinct(), source, "left_semi").join(targets.select(target).distinct(), target, "left_semi")


def next_stage(stages: DataFrame, key: str, order: str, *group: str) -> DataFrame:
    """(source, target, delta) of each stage and the one right after it, in each group if there are any."""
    a = stages.select(F.col(key).alias("source"), F.col(order).alias("_at"), *group)
    b = stages.select(F.col(key).alias("target"), (F.col(order) - 1).alias("_at"), *group)
    return a.join(b, ["_at", *group]).select("source", "target", F.lit(1).cast("long").alias("delta"))


def by_spelling(rows: DataFrame, table: DataFrame, key: str, spellings: list[Column], value: str) -> DataFrame:
    """``value`` of the first of the spellings of a row's id that is a ``key`` of ``table``, which is unique by it; blank if none is."""
    found = rows
    for i, spelling in enumerate(spellings):
        side = table.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        found = found.withColumn(f"_s{i}", spelling).join(side, F.col(f"_s{i}") == F.col(f"_k{i}"), "left")
    first = F.coalesce(*(F.col(f"_v{i}") for i in range(len(spellings))), F.lit(""))
    return found.select(*rows.columns, first.alias(value))


def in_scope(rows: DataFrame, scope: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is in ``scope``, or all without one."""
    return rows if scope is None else rows.join(scope.select(key).distinct(), key, "left_semi")
