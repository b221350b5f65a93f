"""Node and edge tables: keyed upsert, uniqueness, tiers and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import last_wins
from .joins import resolve_edges


def upsert(table: DataFrame, batch: DataFrame, key: str, order: list[str] | None = None, stamp: tuple[str, Column] | None = None) -> DataFrame:
    """``table`` after a merge of ``batch`` by ``key``.

    New keys are added. Of known keys only the batch's columns are overwritten,
    nulls included; other columns stay. Of rows of a batch with one key the last
    by ``order`` counts, by default that of the greatest values. Rows of a batch
    without a key are left out. Merging a batch twice changes nothing but the
    ``stamp``, a column and its value that every row of the batch gets.
    """
    batch = batch.where(F.col(key).isNotNull())
    batch = last_wins(batch, [key], order or [c for c in batch.columns if c != key])
    if stamp:
        batch = batch.withColumn(*stamp)
    listed = [c for c in batch.columns if c != key]
    new = batch.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_b_{c}") for c in listed))
    both = table.join(new, key, "full")
    columns = table.columns + [c for c in listed if c not in table.columns]
    return both.select(*(F.when(F.col("_new"), F.col(f"_b_{c}")).otherwise(F.col(c) if c in table.columns else F.lit(None)).alias(c) if c in listed else F.col(c) for c in columns))


def upsert_edges(table: DataFrame, batch: DataFrame, key: str, sources: DataFrame, targets: DataFrame, source: str, target: str, order: list[str] | None = None, stamp: tuple[str, Column] | None = None) -> DataFrame:
    """``table`` of edges after a merge of those of ``batch`` whose ends are both nodes: columns ``source`` of ``sources`` and ``target`` of ``targets``."""
    return upsert(table, resolve_edges(batch, sources, targets, source, target), key, order, stamp)


def backfill(table: DataFrame, batch: DataFrame, key: str, *columns: str) -> DataFrame:
    """``table`` with the batch's values of ``columns`` where its own are null or blank; the batch's keys are unique."""
    new = batch.select(key, *(F.col(c).alias(f"_b_{c}") for c in columns))
    filled = table.join(new, key, "left")
    return filled.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_b_{c}")) for c in columns}).select(table.columns)


def duplicate_keys(table: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row, and how many."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(table: DataFrame, *keys: str) -> DataFrame:
    """``table``, or an error if a key repeats."""
    if not duplicate_keys(table, *keys).isEmpty():
        raise ValueError(f"({', '.join(keys)}) is not unique")
    return table


def tiered(df: DataFrame, score: Column, support: Column, high: tuple[float, int], medium: float, missing: Column | None = None, scope: tuple[Column, DataFrame] | None = None) -> DataFrame:
    """Adds tier and tier_reason: the first rule that holds.

    Rows with ``missing`` fields are rejected, then rows whose id is not in
    ``scope`` (the id, and a table whose first column has the ids that count),
    with what is missing or the id as the reason.
    """
    rows, names, none = df, df.columns, F.lit(None).cast("string")
    lacks = none if missing is None else F.when(missing != "", F.concat(F.lit("missing:"), missing))
    outside = none
    if scope:
        inside = scope[1].select(F.col(scope[1].columns[0]).alias("_scope"), F.lit(True).alias("_inside")).distinct()
        rows = df.withColumn("_id", scope[0]).join(inside, F.col("_id") == F.col("_scope"), "left")
        outside = F.when(F.col("_inside").isNull(), F.concat(F.lit("out_of_scope:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    rejected = F.coalesce(lacks, outside)
    is_high = (score >= high[0]) & (F.coalesce(support, F.lit(0)) >= high[1])
    return rows.withColumns({
        "tier": F.when(rejected.isNotNull(), "rejected").when(is_high, "high").when(score >= medium, "medium").otherwise("candidate"),
        "tier_reason": F.when(rejected.isNotNull(), rejected).when(is_high, "score_and_support").when(score >= medium, "score").otherwise("low_score"),
    }).select(*names, "tier", "tier_reason")


def scope_audit(core: DataFrame, nodes: dict[str, DataFrame], edges: dict[str, tuple[str, str, DataFrame]]) -> DataFrame:
    """(rule, violations): what of a graph is not held by its core.

    ``core`` has the key of each node of the label ``core`` that counts, ``nodes``
    the keys of each label, ``edges`` for each type the labels of its ends and a
    table of both keys. For each label: nodes that no edge joins to another
    label's node of the graph. For each end of each type: edges whose end is not
    among the nodes, or for the label ``core`` not in the core.
    """
    known = {label: df.toDF("k").distinct() for label, df in (nodes | {"core": core}).items()}
    checks = {}
    for kind, (a, b, df) in edges.items():
        pair = df.toDF("a", "b")
        for end, label in (("a", a), ("b", b)):
            checks[f"{kind}: {label} not in the graph"] = pair.join(known[label], pair[end] == F.col("k"), "left_anti")
    for label in nodes:
        held = [df.toDF("a", "b").join(known[y], F.col("b" if y == b else "a") == F.col("k"), "left_semi").select("a" if x == a else "b") for a, b, df in edges.values() for x, y in ((a, b), (b, a)) if x == label and x != y]
        rows = known[label]
        for h in held:
            rows = rows.join(h.toDF("h"), F.col("k") == F.col("h"), "left_anti")
        checks[f"{label} without an edge"] = rows
    return violations(checks)


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations): the rows of each check, usually an anti-join, as one table."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def endpoint_patterns(edges: dict[tuple[str, str, str], DataFrame]) -> DataFrame:
    """(src, type, dst, edges): how many edges join each pair of labels."""
    parts = [df.select(F.lit(s).alias("src"), F.lit(t).alias("type"), F.lit(d).alias("dst")) for (s, t, d), df in edges.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("src", "type", "dst").agg(F.count("*").alias("edges"))
