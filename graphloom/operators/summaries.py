"""Summaries that add up: totals by several groupings at once, and distinct counts that can be merged."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Standard error of a sketch of 2^k buckets is below 1.04 / sqrt(2^k); an estimate is within five of it all but always
_ERROR, _TIMES = 1.04, 5


def subtotals(df: DataFrame, columns: list[str], measures: dict[str, Column]) -> DataFrame:
    """``measures`` by all ``columns``, by each alone and in all, from one shuffle.

    ``level`` says of which columns a row is a total: their names joined by
    ``,``, blank for none. So a null that is a value is told from one that stands for all.
    """
    sets = [[C(c) for c in columns], *([C(c)] for c in columns), []]
    names = F.concat_ws(",", *(F.when(F.grouping(c) == 1, F.lit(c)) for c in columns))
    return df.groupingSets(sets, *columns).agg(names.alias("level"), *(m.alias(n) for n, m in measures.items()))


def sketches(df: DataFrame, layers: list[str], value: str, k: int = 12) -> DataFrame:
    """(layers, sketch, exact): a mergeable HyperLogLog sketch of 2^``k`` buckets of the distinct values of each layer, with the exact count. Nulls are no values."""
    each = df.groupBy(*layers, value).agg(F.lit(1).alias("_one"))
    return each.groupBy(*layers).agg(F.hll_sketch_agg(value, k).alias("sketch"), F.count(value).alias("exact"))


def merged(table: DataFrame, layer: str, values: list[str], exact: DataFrame, value: str, k: int = 12) -> DataFrame:
    """(layers, estimate, exact, within): for every union of the ``values`` of a layer its estimate, from sketches alone, beside the exact count.

    ``exact`` has (layer, value); its values are grouped once, into which layers
    have them, and counted for all unions together. ``within``: the estimate is
    no further off than five standard errors.
    """
    unions = [set(u) for n in range(1, len(values) + 1) for u in combinations(values, n)]
    if len(unions) > 1 << 12:
        raise ValueError("more unions than can be listed")
    member = F.explode(F.array(*(F.lit(",".join(v for v in values if v in u)) for u in unions)))
    in_union = lambda name: F.array_contains(F.split(C(name), ","), C(layer))
    estimates = table.select(layer, "sketch", member.alias("layers")).where(in_union("layers")).groupBy("layers").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    held = exact.where(C(value).isNotNull()).groupBy(value).agg(F.collect_set(layer).alias("_in"))  # as many as there are layers
    patterns = held.groupBy(F.array_sort("_in").alias("_in")).agg(F.count("*").alias("_n"))
    counts = patterns.select("_in", "_n", member.alias("layers")).where(F.arrays_overlap(F.split("layers", ","), C("_in"))).groupBy("layers").agg(F.sum("_n").alias("exact"))
    bound = _TIMES * _ERROR / (1 << k) ** 0.5
    both = estimates.join(counts, "layers", "left").withColumn("exact", F.coalesce("exact", F.lit(0)))
    return both.select("layers", "estimate", "exact", (F.abs(C("estimate") - C("exact")) <= F.greatest(C("exact") * bound, F.lit(1))).alias("within"))
