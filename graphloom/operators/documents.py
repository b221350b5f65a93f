"""Documents whose fields only the data know: every value with its path, a profile of fields, and nodes and edges by path patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables
from .profile import json_type

C = F.col
ITEM = "[]"  # stands in a path for an element of a list
LEVELS = 6  # of containers, which are opened in one pass


def _entries(df: DataFrame, value: str) -> DataFrame:
    """A row for each field or element of a variant: the columns of ``df`` with its ``pos``, ``key`` (null in lists) and ``value``."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(C(value).outer()))


def _kind(value: Column) -> Column:
    """object, array, null, or the type of a scalar."""
    kind = F.schema_of_variant(value)
    return F.when(F.is_variant_null(value), "null").when(F.startswith(kind, F.lit("OBJECT")), "object").when(F.startswith(kind, F.lit("ARRAY")), "array").otherwise(F.lower(kind))


def _opened(level: DataFrame) -> DataFrame:
    """The values of ``level``, and those inside its containers that are still held; only new containers are held then."""
    open_ = level.select("*", F.explode(F.when(C("held").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("inside"))
    each = open_.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.when(C("inside"), C("held")).outer())).where(~C("inside") | C("pos").isNotNull())
    listed, new = C("kind") == "array", lambda x, old: F.when(C("inside"), x).otherwise(old)
    path, at = F.concat("path", F.array(F.when(listed, ITEM).otherwise(C("key")))), F.when(listed, F.concat("at", F.array(C("pos") + 1))).otherwise(C("at"))
    return _valued(each.select("_doc", new(path, C("path")).alias("path"), new(at, C("at")).alias("at"), C("value"), new(_kind(C("value")), C("kind")).alias("kind"), new(F.lit(None), C("text")).alias("text")))


def _valued(level: DataFrame) -> DataFrame:
    """``value`` of new rows becomes ``text`` of scalars, and is ``held`` of containers."""
    container = C("kind").isin("object", "array")
    text = F.when(container | C("kind").isin("null", "invalid") | C("value").isNull(), C("text")).otherwise(C("value").cast("string"))
    return level.select("_doc", "path", "at", F.when(container, C("value")).alias("held"), "kind", text.alias("text"))


def _deeper(doc: str) -> Column:
    """Whether a JSON text has containers in more than ``LEVELS`` levels: brackets outside of strings are left after so many rounds without the innermost ones."""
    bare = F.replace(F.replace(C(doc), F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    left = F.regexp_replace(F.regexp_replace(bare, '"[^"]*+"', ""), r"[^\[\]{}]++", "")
    for _ in range(LEVELS):
        left = F.regexp_replace(left, r"\{\}|\[\]", "")
    return F.coalesce(left != "", F.lit(False))


def flatten(docs: DataFrame, doc: str, key: str) -> DataFrame:
    """(``key``, path array<string>, at array<int>, kind, text): every value at every depth of the JSON texts ``doc``, the whole document first.

    ``path`` has the names of fields, and ``ITEM`` for elements of lists; ``at``
    their 1-based positions in lists, in order. ``text`` is of scalars only. A
    text that is no JSON, or null, has one row of kind ``invalid``; of fields that repeat in an
    object the last counts. Fields are no list: their order is that of their
    names. The texts are written once. Those of up to ``LEVELS`` levels are
    opened in one pass, without a table of their values; what others
    hold is written after so many levels, for as many rounds as the deepest has.
    """
    tables = Tables(docs.sparkSession)
    none = [F.array().cast(f"array<{t}>").alias(n) for t, n in (("string", "path"), ("int", "at"))]
    texts = tables.put("texts", docs.select(C(key).alias("_doc"), C(doc).alias("doc")).withColumn("deep", _deeper("doc")))

    def whole(some: DataFrame) -> DataFrame:
        parsed = some.select("_doc", *none, F.try_parse_json("doc").alias("value"))
        return _valued(parsed.select("*", F.when(C("value").isNull(), "invalid").otherwise(_kind(C("value"))).alias("kind"), F.lit(None).cast("string").alias("text")))

    def opened(level: DataFrame) -> DataFrame:
        for _ in range(LEVELS):
            level = _opened(level)
        return level

    # no value can be lost, should a text be deeper than its brackets say
    done = F.when(C("held").isNotNull(), F.raise_error(F.lit("a document is deeper than its brackets")).cast("boolean")).otherwise(True)
    found = opened(whole(texts.where("not deep"))).where(done).drop("held")
    level, rounds = whole(texts.where("deep")), 0
    while not level.isEmpty():
        values = tables.put(f"values{rounds}", opened(level))
        # a container that is still held is given by the round that opens it
        found = found.unionByName(values.where("held is null").drop("held"))
        level, rounds = values.where("held is not null"), rounds + 1
    return found.withColumnRenamed("_doc", key)


def profile(docs: DataFrame, doc: str) -> DataFrame:
    """(field, rows, absent, nulls, empty, filled, types): of each field that any of the JSON objects ``doc`` has, sorted by field.

    ``nulls`` are JSON nulls, ``empty`` blank texts, lists and objects without
    anything in them. ``types`` has, sorted, each type's name (lists with their
    element's type and length) with how many values have it. Documents that are no object
    have no fields, and count as rows. One pass, and no list of fields is needed.
    """
    parsed = docs.select(F.try_parse_json(doc).alias("held"))
    total = parsed.agg(F.count("*").alias("rows"))
    fields = _entries(parsed, "held").where(C("key").isNotNull()).select(C("key").alias("field"), F.to_json("value").alias("json"), _kind(C("value")).alias("kind"))
    empty = C("json").isin('""', "[]", "{}")
    typed = fields.groupBy("field", json_type("json").alias("type")).agg(F.count("*").alias("n"), F.count_if(C("kind") == "null").alias("nulls"), F.count_if(empty).alias("empty"))
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit("="), x["n"].cast("string"))), ";")
    each = typed.groupBy("field").agg(F.sum("n").alias("present"), F.sum("nulls").alias("nulls"), F.sum("empty").alias("empty"), types.alias("types"))
    with_total = each.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
    filled = C("present") - C("nulls") - C("empty")
    return with_total.select("field", "rows", (C("rows") - C("present")).alias("absent"), "nulls", "empty", filled.alias("filled"), "types").orderBy("field")


@dataclass(frozen=True)
class Rule:
    """What a path means: a node ``label``, and an edge ``edge`` to it from the node of the rule ``parent``.

    ``path`` is dotted; ``*`` takes any name, ``[]`` any element of a list. A
    node's key has what the path's stars took and, for a scalar, its text,
    joined by ``|``; ``own`` counts the last so many of these parts only (all by
    default), so that what several owners share is one node.
    """

    path: str
    label: str
    edge: str | None = None
    parent: str | None = None
    own: int | None = None


def graph_of(flat: DataFrame, key: str, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, key, position) and edges (type, source, source_key, target, target_key) of the values of ``flatten``.

    ``position`` is the last place in a list on the way to the node, null if
    there is none; of several that write one node, that of the first by
    ``key`` of the document and then by path. All rules are matched in one pass.
    """
    by_label = {r.label: r for r in rules}

    def parts(steps: list[str], scalar: bool) -> list[Column]:
        return [F.get("path", F.lit(i)) for i, s in enumerate(steps) if s == "*"] + ([C("text")] if scalar else [])

    def keyed(rule: Rule, stars: list[Column]) -> Column:
        own = stars[-rule.own :] if rule.own else stars
        return F.concat_ws("|", *own)

    found = []
    for r in rules:
        steps = r.path.split(".")
        fits = F.size("path") == len(steps)
        for i, s in enumerate(steps):
            if s != "*":
                fits = fits & (F.get("path", F.lit(i)) == s)
            else:
                fits = fits & (F.get("path", F.lit(i)) != ITEM)
        mine = parts(steps, False)
        target = F.when(C("text").isNotNull(), keyed(r, [*mine, C("text")])).otherwise(keyed(r, mine))
        source = F.lit(None).cast("string")
        if r.parent:
            above = by_label[r.parent]
            source = keyed(above, parts(above.path.split("."), False))
        position = F.when(F.size("at") > 0, F.element_at("at", -1))
        found.append(F.when(fits & (C("kind") != "null"), F.struct(F.lit(r.label).alias("label"), target.alias("node"), position.alias("position"), F.lit(r.edge).cast("string").alias("type"), F.lit(r.parent).cast("string").alias("source"), source.alias("source_key"))))
    rows = flat.select(C(key).alias("_doc"), "path", "at", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
    first = F.min_by("position", F.struct("_doc", "path", "at"))
    nodes = rows.groupBy("label", C("node").alias("key")).agg(first.alias("position"))
    edges = rows.where("type is not null").select("type", "source", "source_key", C("label").alias("target"), C("node").alias("target_key")).distinct()
    return nodes, edges
