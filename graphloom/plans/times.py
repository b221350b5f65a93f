"""Registered queries of joins by time, of state across batches, and of summaries that add up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe, summaries, times
from ..sources.shared import new_folder
from ..streaming import landing, latest
from .queries import SQL, TIERED, _tiered, query

C = F.col
DAY = 86400.0


def _facts(t):
    """Orders as facts of a customer that hold from their date for as many days as their price says."""
    days = F.floor(C("o_totalprice") / 10000).cast("int")
    return t("orders").select(C("o_custkey").alias("user_id"), "o_orderkey", C("o_orderdate").alias("since"), F.timestamp_add("DAY", days, C("o_orderdate")).alias("until"))


_FACTS = "(SELECT o_custkey AS user_id, o_orderkey, o_orderdate AS since, o_orderdate + to_days(CAST(floor(o_totalprice / 10000) AS INTEGER)) AS until FROM orders)"
#: Events lie in one month of 2024; their ids move them to the days of 1995 to 2001 that orders have, so that facts and events meet
_MOVED = "(SELECT event_id, user_id, event_type, ts + to_days(CAST(-(8200 + event_id % 2400) AS INTEGER)) AS moment FROM events)"


def _events(t):
    return t("events").select("event_id", "user_id", "event_type", F.timestamp_add("DAY", -(C("event_id") % 2400 + 8200).cast("int"), C("ts")).alias("moment"))


@query(f"SELECT e.user_id, event_id, event_type, o_orderkey FROM {_MOVED} e JOIN {_FACTS} f ON e.user_id = f.user_id AND since <= moment AND moment < until")
def facts_valid_at(t):
    """Events with the facts that hold at their time, by bins of the facts' lengths."""
    return times.valid_at(_events(t), _facts(t), "user_id", "moment", "since", "until", 7 * DAY).select("user_id", "event_id", "event_type", "o_orderkey")


@query(f"""SELECT event_id, moment, count(*) AS facts FROM (SELECT event_id, moment, 1 AS one FROM {_MOVED}) e JOIN (SELECT since, until FROM {_FACTS}) f ON since <= moment AND moment < until AND until < since + INTERVAL 3 DAY GROUP BY ALL""")
def facts_valid_at_one_key(t):
    """The same where all rows have one key: bins with many events are cut."""
    facts = _facts(t).where(C("until") < F.timestamp_add("DAY", F.lit(3), C("since"))).select(F.lit(1).alias("one"), "since", "until")
    found = times.valid_at(_events(t).select("event_id", "moment", F.lit(1).alias("one")), facts, "one", "moment", "since", "until", DAY)
    return found.groupBy("event_id", "moment").agg(F.count("*").alias("facts"))


@query(f"""SELECT e.user_id, event_id, o_orderkey, since FROM {_MOVED} e ASOF LEFT JOIN (SELECT user_id, since, max(o_orderkey) AS o_orderkey FROM {_FACTS} GROUP BY ALL) f ON e.user_id = f.user_id AND e.moment >= f.since""")
def facts_as_of(t):
    """Events with the last fact of their user before them."""
    return times.as_of(_events(t), _facts(t).drop("until"), "user_id", "moment", "since", 90 * DAY).select("user_id", "event_id", "o_orderkey", "since")


@query(SQL["dedupe_last_wins"])
def stream_last_rows(t):
    """The last row of each key by state that lives across batches; rows come late and again."""
    events = t("events")
    spark, path, keys, order = events.sparkSession, new_folder(events.sparkSession, "state"), ["user_id", "event_type"], ["ts", "event_id"]
    again = events.where("event_id % 10 = 0")
    events.unionByName(again).repartition(12, F.xxhash64("event_id", "ts")).write.parquet(f"{path}/landed")  # twelve files, four to a batch
    rows = latest.last_rows(landing.landed(spark, f"{path}/landed", events.schema, 4), keys, order, "ts")
    latest.write(rows, f"{path}/rows", f"{path}/progress").awaitTermination()
    return dedupe.last_wins(spark.read.schema(events.schema).parquet(f"{path}/rows").select(events.columns), keys, order)


_STAGED = f"(SELECT nullif(o_orderstatus, 'P') AS stage, tier, o_totalprice, o_custkey FROM {TIERED})"


@query(f"""SELECT stage, tier, CASE WHEN grouping(stage) = 1 AND grouping(tier) = 1 THEN 'stage,tier' WHEN grouping(stage) = 1 THEN 'stage' WHEN grouping(tier) = 1 THEN 'tier' ELSE '' END AS level,
count(*) AS n, max(o_totalprice) AS most FROM {_STAGED} GROUP BY GROUPING SETS ((stage, tier), (stage), (tier), ())""")
def tier_subtotals(t):
    """Tiers by stage with totals of both; a stage that is null is told from the total of all stages."""
    staged = _tiered(t).select(F.nullif(C("o_orderstatus"), F.lit("P")).alias("stage"), "tier", "o_totalprice")
    return summaries.subtotals(staged, ["stage", "tier"], {"n": F.count("*"), "most": F.max("o_totalprice")})


@query("""WITH u AS (SELECT unnest(['A', 'N', 'R', 'A,N', 'A,R', 'N,R', 'A,N,R']) AS layers)
SELECT layers, count(DISTINCT l_partkey) AS exact, true AS within FROM u JOIN lineitem ON list_contains(string_split(layers, ','), l_returnflag) GROUP BY 1""")
def merged_distinct_counts(t):
    """Distinct parts of every union of layers from the layers' sketches, each held against the exact count."""
    lines = t("lineitem").select("l_returnflag", "l_partkey")
    table = summaries.sketches(lines, ["l_returnflag"], "l_partkey")
    return summaries.merged(table, "l_returnflag", ["A", "N", "R"], lines, "l_partkey").select("layers", "exact", "within")
