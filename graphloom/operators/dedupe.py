"""Deterministic policies for rows that share a key. Order always comes from explicit columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import spread


def _pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    # the limit on the rank leaves one row of a key in each task before the shuffle
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole last row of each key, null order values first; each task sends one row of a key at most."""
    return _pick(df, keys, [F.col(c).desc_nulls_last() for c in order])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole first row of each key, null order values first."""
    return _pick(df, keys, [F.col(c).asc_nulls_first() for c in order])


def ordered_merge(df: DataFrame, keys: list[str], value: str, order: list[str], separator: str = ";") -> DataFrame:
    """Distinct values that are not blank, joined in the order they first appear; a key with blanks only is blank."""
    filled = df.withColumn(value, F.nullif(F.col(value), F.lit("")))
    first = filled.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    present = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("_at", value)))  # nulls are not collected
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(present), lambda x: x[value]), separator).alias(value))


def set_join(df: DataFrame, keys: list[str], value: str, separator: str = ";") -> DataFrame:
    """Distinct values in order, joined."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)), separator).alias(value))


def undirected_edges(df: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """One edge for each unordered pair: the ends in order, the id ``low|high``, other columns of the first row.

    Rows without both ends are no edges and are left out.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    lo, hi = F.least(a, b), F.greatest(a, b)
    canonical = both.withColumns({"edge_id": F.concat_ws("|", lo.cast("string"), hi.cast("string")), "_lo": lo, "_hi": hi})
    kept = first_wins(spread(canonical, "edge_id"), ["edge_id"], order)  # sorted in tasks that do not grow with the table
    return kept.withColumns({a: F.col("_lo"), b: F.col("_hi")}).drop("_lo", "_hi")
