"""Audit of a whole graph in one pass: membership of nodes as bit masks.

Nodes, core and edges become one relation of ends, each table read once. One
grouping gives every node a mask: whether it is listed, whether it is in the
core, which kinds of edge touch it, and how many edges of each kind begin or
end there. Counters of nodes, and of edges by one end, are sums over these
masks. Counters that need both ends, or a node two hops away, look up the few
nodes that lack the bit, one more time for each end. No rule has a join of
its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables

C = F.col
CORE = "core"


@dataclass(frozen=True)
class Kind:
    """A kind of edge between two columns of a table: from ``source`` (label, column) to ``target`` (label, column), where ``where`` holds."""

    name: str
    source: tuple[str, str]
    target: tuple[str, str]
    where: Column | None = None


@dataclass(frozen=True)
class Table:
    """What a table tells of a graph: ``nodes`` as label -> column, its kinds of edge, and of which labels its nodes are in the core (label -> condition)."""

    rows: DataFrame
    nodes: dict[str, str] = field(default_factory=dict)
    kinds: tuple[Kind, ...] = ()
    core: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Nodes:
    """Counts listed nodes of ``label`` that lack ``bit``: ``core``, or a kind of edge that touches them."""

    name: str
    label: str
    lack: str = CORE


@dataclass(frozen=True)
class Edges:
    """Counts edges of ``kind`` whose ``end`` (source, target or either) lacks ``bit``."""

    name: str
    kind: str
    end: str
    lack: str = CORE


@dataclass(frozen=True)
class Linked:
    """Counts the different nodes at the ``end`` (source or target) of ``kind`` whose neighbour there lacks ``bit``, two hops from where the bit was set."""

    name: str
    kind: str
    end: str
    lack: str = CORE


def ends(tables: list[Table], bits: dict[str, int]) -> DataFrame:
    """(kind, source, source_key, target, target_key, mask): a row for each listed node, with its mask, and for each edge, each table scanned once."""
    text, none = (lambda c: C(c).cast("string")), F.lit(None).cast("string")
    what = list(dict.fromkeys([(None, label, None) for t in tables for label in t.nodes] + [(k.name, k.source[0], k.target[0]) for t in tables for k in t.kinds]))
    number = {w: F.lit(i).alias("what") for i, w in enumerate(what)}
    out = None
    for t in tables:
        rows = []
        for label, column in t.nodes.items():
            mask = F.lit(1).cast("long")
            if label in t.core:
                mask = mask + F.when(t.core[label], bits[CORE]).otherwise(0)
            rows.append(F.when(C(column).isNotNull(), F.struct(number[None, label, None], text(column).alias("source_key"), none.alias("target_key"), mask.alias("mask"))))
        for k in t.kinds:
            edge = F.struct(number[k.name, k.source[0], k.target[0]], text(k.source[1]).alias("source_key"), text(k.target[1]).alias("target_key"), F.lit(0).cast("long").alias("mask"))
            rows.append(edge if k.where is None else F.when(k.where, edge))
        one = t.rows.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
        out = one if out is None else out.unionByName(one)
    # kinds and labels are grouped and shuffled by their number, and named after that
    each = out.groupBy("what", "source_key", "target_key").agg(F.bit_or("mask").alias("mask"))
    named = lambda i: F.element_at(F.array(*(F.lit(w[i]).cast("string") for w in what)), C("what") + 1)
    return each.select(named(0).alias("kind"), named(1).alias("source"), "source_key", named(2).alias("target"), "target_key", "mask")


def audit(tables: list[Table], rules: list[Nodes | Edges | Linked]) -> DataFrame:
    """(rule, violations) of each rule, 0 included.

    A node counts once for its label and key, an edge once for its kind and two
    ends, however often they are listed. An end that is null or in no table of
    nodes has no bit but those of the edges that touch it; a null end has none
    at all, and counts as no node. Keys of all types are compared as text.
    """
    kinds = {k.name: k for t in tables for k in t.kinds}
    bits = {name: 2 << i for i, name in enumerate((CORE, *kinds))}
    if len(bits) > 61:
        raise ValueError("more kinds of edge than a mask has bits")
    labels = {label for t in tables for label in t.nodes} | {end[0] for k in kinds.values() for end in (k.source, k.target)}
    for r in rules:
        if r.lack not in bits or getattr(r, "kind", CORE) not in bits or getattr(r, "label", next(iter(labels))) not in labels:
            raise ValueError(f"{r.name}: no such kind or label")
    first = tables[0].rows.sparkSession
    held = Tables(first)
    found = held.put("ends", ends(tables, bits))

    # what each end says of its node, and the edges that begin and end there
    by_degree = [r for r in rules if isinstance(r, Edges) and r.end != "either"]
    touched = F.when(C("key").isNotNull() & C("kind").isNotNull(), F.element_at(F.create_map(*(x for k in kinds for x in (F.lit(k), F.lit(bits[k])))), C("kind"))).otherwise(0).cast("long") if kinds else F.lit(0).cast("long")
    sides = F.inline(F.array(F.struct(F.lit("source").alias("end"), C("source").alias("label"), C("source_key").alias("key")), F.struct(F.lit("target").alias("end"), C("target").alias("label"), C("target_key").alias("key"))))
    each = found.select("kind", "mask", sides).where("label is not null").withColumn("mask", C("mask").bitwiseOR(touched))
    degrees = {(r.kind, r.end): f"_{i}" for i, r in enumerate(by_degree)}
    masks = each.groupBy("label", "key").agg(F.bit_or("mask").alias("mask"), *(F.count_if((C("kind") == k) & (C("end") == end)).alias(c) for (k, end), c in degrees.items()))
    masks = held.put("masks", masks)

    def lacks(bit: str, mask: str = "mask") -> Column:
        return F.coalesce(C(mask), F.lit(0)).bitwiseAND(bits[bit]) == 0

    counts = []
    for r in rules:
        if isinstance(r, Nodes):
            counts.append(F.count_if((C("label") == r.label) & (C("mask").bitwiseAND(1) == 1) & lacks(r.lack)).alias(r.name))
        elif r in by_degree:
            counts.append(F.coalesce(F.sum(F.when((C("label") == getattr(kinds[r.kind], r.end)[0]) & lacks(r.lack), C(degrees[r.kind, r.end]))), F.lit(0)).alias(r.name))
    parts = [masks.agg(*counts).unpivot([], [r.name for r in rules if isinstance(r, Nodes) or r in by_degree], "rule", "violations")] if counts else []

    both = [r for r in rules if not isinstance(r, Nodes) and r not in by_degree]
    if both:
        parts.append(_two_ended(found, masks, both, bits))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = held.put("audit", out)
    held.keep("audit")
    return out


def _two_ended(found: DataFrame, masks: DataFrame, rules: list[Edges | Linked], bits: dict[str, int]) -> DataFrame:
    """Rules that need both ends of an edge: nodes that lack a bit of one of them, usually few, are looked up from each end."""
    wanted = 0
    for bit in {r.lack for r in rules}:
        wanted |= bits[bit]
    kinds = {r.kind for r in rules}
    edges = found.where(C("kind").isin(*kinds)).select("kind", "source", "source_key", "target", "target_key")
    odd = masks.where((C("mask").bitwiseAND(wanted) != wanted) & C("key").isNotNull())
    marked = edges
    for end in ("source", "target"):
        side = odd.select(C("label").alias(end), C("key").alias(f"{end}_key"), C("mask").alias(f"{end}_mask"))
        marked = marked.join(side, [end, f"{end}_key"], "left")

    def lacks(end: str, bit: str) -> Column:  # a node that is not looked up has all bits, a null end none
        return C(f"{end}_key").isNull() | (F.coalesce(C(f"{end}_mask"), F.lit(-1)).bitwiseAND(bits[bit]) == 0)

    items = []
    for r in rules:
        if isinstance(r, Edges):
            hit, item = lacks("source", r.lack) | lacks("target", r.lack), F.to_json(F.struct("source_key", "target_key"))
        else:
            other = "target" if r.end == "source" else "source"
            hit, item = lacks(other, r.lack) & C(f"{r.end}_key").isNotNull(), C(f"{r.end}_key")
        items.append(F.when((C("kind") == r.kind) & hit, F.struct(F.lit(r.name).alias("rule"), item.alias("item"))))
    hits = marked.select(F.inline(F.filter(F.array(*items), lambda r: r.isNotNull()))).distinct()
    return hits.agg(*(F.count_if(C("rule") == r.name).alias(r.name) for r in rules)).unpivot([], [r.name for r in rules], "rule", "violations")
