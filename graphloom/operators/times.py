"""Joins of facts and events by time. All are equality joins and windows of bounded groups; no pair is tried that cannot meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C = F.col
HOT = 4096  # a bin with a 4096th of all points is hot: there are at most so many
SALTS = 16


def _seconds(c: str) -> Column:
    return F.unix_micros(C(c).cast("timestamp")) / 1_000_000


def valid_at(events: DataFrame, facts: DataFrame, key: str, at: str, start: str, end: str, width: float, salts: int = SALTS) -> DataFrame:
    """Each event with each fact of its ``key`` that holds at its time: ``start`` <= ``at`` < ``end``.

    A fact is put into bins as wide as the power of two times ``width`` seconds
    that is not below its length, so into two at most, however long it is. An
    event looks into one bin of each width that any fact has. Bins with very
    many events are cut by a hash of the event, and their facts repeated for
    each part. Facts without a key or a time, and those that end before they
    start, never hold; columns of both sides must differ but for the key.
    """
    own, other = [c for c in events.columns if c != key], [c for c in facts.columns if c != key]
    if set(own) & set(other):
        raise ValueError(f"both sides have {sorted(set(own) & set(other))}")
    length = _seconds(end) - _seconds(start)
    level = F.greatest(F.ceil(F.log2(length / width)), F.lit(0)).cast("int")
    sized = facts.where(C(start).isNotNull() & (C(start) < C(end)) & C(key).isNotNull()).withColumn("_level", level)
    step = F.pow(F.lit(2.0), C("_level")) * width
    bins = F.sequence(F.floor(_seconds(start) / step).cast("long"), F.floor(_seconds(end) / step).cast("long"))
    binned = sized.withColumn("_bin", F.explode(bins))
    levels = [r["_level"] for r in sized.select("_level").distinct().collect()]  # one for each power of two: some 60 at most
    asked = events.where(C(at).isNotNull() & C(key).isNotNull())
    if not levels:
        return asked.join(facts, key).limit(0)
    asked = asked.withColumn("_level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("_bin", F.floor(_seconds(at) / step).cast("long"))
    place = [key, "_level", "_bin"]
    counts = asked.groupBy(*place).agg(F.count("*").alias("_n"))
    least = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(C("_n") > least // HOT + 1000).select(*place, F.lit(True).alias("_hot")))  # HOT rows at most
    cut = F.pmod(F.xxhash64(*[C(c) for c in own]), F.lit(salts)).cast("int")
    left = asked.join(hot, place, "left").withColumn("_salt", F.when(C("_hot"), cut).otherwise(0)).drop("_hot")
    right = binned.join(hot, place, "left").withColumn("_salt", F.explode(F.when(C("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    met = left.join(right, [*place, "_salt"])
    return met.where((C(start) <= C(at)) & (C(at) < C(end))).select(key, *own, *other)


def as_of(events: DataFrame, facts: DataFrame, key: str, at: str, since: str, width: float) -> DataFrame:
    """Each event with the last fact of its ``key`` that came no later (``since`` <= ``at``), null without one.

    Facts and events are in one relation, cut by key and by spans of ``width``
    seconds, and one ordered window runs over each span. What a span inherits is
    the last fact of the spans before it, a window over one row for each span.
    So no key, however common, is one task. Of facts with one time the greatest
    by its other columns counts. Events without a key or time have no fact.
    """
    own, other = [c for c in events.columns if c != key], [c for c in facts.columns if c != key]
    if set(own) & set(other):
        raise ValueError(f"both sides have {sorted(set(own) & set(other))}")
    span = lambda c: F.floor(_seconds(c) / width).cast("long")
    fact = F.struct(since, *[c for c in other if c != since])
    known = facts.where(C(key).isNotNull() & C(since).isNotNull()).select(key, span(since).alias("_span"), C(since).alias("_at"), fact.alias("_fact"))
    asked = events.select(key, F.coalesce(span(at), F.lit(0)).alias("_span"), C(at).alias("_at"), F.struct(*own).alias("_event"))
    last = known.groupBy(key, "_span").agg(F.max("_fact").alias("_last"))
    # spans that have events, with what was last known before them
    spans = last.unionByName(asked.select(key, "_span").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType)))
    spans = spans.groupBy(key, "_span").agg(F.max("_last").alias("_last"))
    before = W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    inherited = spans.select(key, "_span", F.last("_last", True).over(before).alias("_before"))
    none_fact, none_event = (F.lit(None).cast(df.schema[c].dataType) for df, c in ((known, "_fact"), (asked, "_event")))
    both = known.withColumn("_event", none_event).unionByName(asked.withColumn("_fact", none_fact))
    upto = W.partitionBy(key, "_span").orderBy(C("_at").asc_nulls_first(), C("_event").isNotNull(), "_fact").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_now", F.last("_fact", True).over(upto)).where("_event is not null")
    found = seen.join(inherited.withColumnRenamed(key, "_key").withColumnRenamed("_span", "_of"), C(key).eqNullSafe(C("_key")) & (C("_span") == C("_of")), "left")
    held = F.when(C(key).isNotNull() & C("_at").isNotNull(), F.coalesce("_now", "_before"))
    return found.select(key, "_event.*", held.alias("_held")).select(key, *own, *(C("_held")[c].alias(c) for c in other))
