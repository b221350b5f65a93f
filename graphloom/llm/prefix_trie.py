"""Trie of conversations: one node for each distinct sequence of first turns.

A prefix is known by a digest of its turns. A count-min sketch of all digests
of fixed size screens them: where its estimate is one, no other conversation
begins so, and that prefix and all longer ones of the conversation, its tail,
are nodes of their own that need no shuffle. Only prefixes that may be shared
are grouped exactly, and an estimate that was too high costs nothing but that.

Sums over subtrees come from the conversations, without a walk from level to
level. The smallest member of a node owns it; what a conversation owns is its
path from some depth on. So every distinct node below a node is counted once by
letting each owner add the part of its path that it owns to all nodes above,
one grouping of the same prefixes.

Texts never leave their task: turns travel as digests and lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables

DEPTH = 3  # rows of the sketch
MOST_WIDTH = 1 << 22  # counters of a row at most: the sketch has 3 MiB at two bits each
_CELLS = 1 << 16  # counters of a block of the sketch
HOT = 4096  # a node with a 4096th of all memberships is hot: there are at most so many
_CHUNK = 1 << 16  # characters of a piece of an id list
C = F.col


def turn_digest(role: Column, text: Column) -> Column:
    """A digest of 128 bits of a turn's role and text, in hex."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)


def turn_lists(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv, turns array<struct<digest, bytes>>): the turns of each conversation in order.

    They go by ``turn`` (null first), ties by role and then by the text's
    digest; repeated rows are turns of their own. A null role or text is empty.
    Rows without a conversation id belong to none and are left out. A
    conversation is one row of some 60 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(C(id_col).isNotNull()).select(C(id_col).alias("conv"), "turn", role.alias("role"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "bytes")))
    return rows.groupBy("conv").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(lists: DataFrame, tables: Tables, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin as the first of their family does.

    Conversation c gets the first h turns of conversation c - c % ``family``
    (all if it has fewer, none if it is not there), then its own turns after
    its first h, where h is the CRC-32 of the decimal c, modulo ``most``.
    """
    lists = tables.put("lists", lists)
    own = lists.withColumns({"head": C("conv") - C("conv") % family, "h": (F.crc32(C("conv").cast("string").cast("binary")) % most).cast("int")})
    heads = lists.where(C("conv") % family == 0).select(C("conv").alias("head"), F.slice("turns", 1, most - 1).alias("first"))
    both = own.join(heads, "head", "left")
    after = F.slice("turns", C("h") + 1, F.greatest(F.size("turns") - C("h"), F.lit(0)))
    none = F.slice("turns", 1, 0)
    return both.select("conv", F.concat(F.slice(F.coalesce("first", none), F.lit(1), C("h")), after).alias("turns"))


def _path(digests: list[bytes]) -> list[bytes]:
    """A digest of each prefix."""
    out, now = [], b""
    for d in digests:
        now = hashlib.blake2b(now + d, digest_size=16).digest()
        out.append(now)
    return out


_PATHS = "conv bigint, n int, hi array<bigint>, lo array<bigint>, bytes array<bigint>"


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list of a column begins, with the end, and all values."""
    ends = column.offsets.to_numpy()
    return ends - ends[0], column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False)


def paths(lists: DataFrame) -> DataFrame:
    """(``_PATHS``): for each conversation its number of turns, the two halves of each prefix's digest and each turn's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column("digests")
            rows = [_path([bytes.fromhex(d) for d in row]) for row in digests.to_pylist()]
            n = np.array([len(r) for r in rows], np.int32)
            halves = np.frombuffer(b"".join(b"".join(r) for r in rows), ">i8").astype(np.int64).reshape(-1, 2)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            hi, lo = (pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(halves[:, i]))) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(n), hi, lo, batch.column("bytes")], ["conv", "n", "hi", "lo", "bytes"])

    base = lists.select(C("conv").cast("long"), F.transform("turns", lambda t: t["digest"]).alias("digests"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))
    return base.mapInArrow(run, _PATHS)


def _slots(hi: np.ndarray, lo: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The counter of each digest in each row of the sketch."""
    a, b = hi.view(np.uint64), lo.view(np.uint64) | np.uint64(1)
    for row in range(DEPTH):
        yield ((a + np.uint64(row) * b) >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)


def sketch(path_rows: DataFrame, width: int) -> np.ndarray:
    """Count-min sketch (DEPTH x width) of all prefixes' digests, whose counters stop at 2.

    Each task counts in a sketch of its own and gives it in blocks, which are
    added up by block; what comes to the driver has a fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((DEPTH, width), np.uint8)
        for batch in batches:
            _, hi = _flat(batch.column("hi"))
            _, lo = _flat(batch.column("lo"))
            for row, slot in enumerate(_slots(hi, lo, width)):
                at, n = np.unique(slot, return_counts=True)
                counts[row, at] = np.minimum(counts[row, at] + np.minimum(n, 2), 2)
        yield from _blocks(counts.reshape(-1, min(_CELLS, width)), range(counts.size))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                new = _unpacked(data)
                sums[block] = np.minimum(sums[block] + new, 2) if block in sums else new
        yield from _blocks(list(sums.values()), list(sums))

    schema = "block int, data binary"
    parts = path_rows.select("hi", "lo").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros((DEPTH * width // min(_CELLS, width), min(_CELLS, width)), np.uint8)
    for block, data in parts.collect():  # 3 MiB at most
        out[block] = _unpacked(data)
    return out.reshape(DEPTH, width)


def _blocks(blocks, names) -> Iterator[pa.RecordBatch]:
    """Blocks that are not empty, two bits a counter."""
    kept = [(name, np.packbits(np.unpackbits(b[:, None], axis=1)[:, 6:].reshape(-1)).tobytes()) for name, b in zip(names, blocks) if b.any()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int32()), pa.array([d for _, d in kept], pa.binary())], ["block", "data"])


def _unpacked(data: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, 2)
    return bits[:, 0] * np.uint8(2) + bits[:, 1]


def screened(path_rows: DataFrame, width: int | None = None) -> DataFrame:
    """``path_rows`` with ``tail``: the first depth whose prefix the sketch proves to be this conversation's alone, n + 1 if there is none."""
    if width is None:
        total = path_rows.agg(F.sum("n")).first()[0] or 0
        width = min(max(1 << (8 * total).bit_length(), 1 << 10), MOST_WIDTH)
    sent = path_rows.sparkSession.sparkContext.broadcast(np.packbits(sketch(path_rows, width) >= 2, axis=1))  # one bit a counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = sent.value
        for batch in batches:
            ends, hi = _flat(batch.column("hi"))
            _, lo = _flat(batch.column("lo"))
            maybe = np.ones(len(hi), bool)
            for row, slot in enumerate(_slots(hi, lo, width)):
                maybe &= (many[row, slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
            # how many proven prefixes there are before each; a conversation's first is where that grows
            alone = np.concatenate([[0], np.cumsum(~maybe)])
            first = np.searchsorted(alone, alone[ends[:-1]], "right") - 1
            tail = np.minimum(first, ends[1:]) - ends[:-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail.astype(np.int32))], [*batch.schema.names, "tail"])

    return path_rows.mapInArrow(run, f"{_PATHS}, tail int")


def _shared(rows: DataFrame, **more: Column) -> DataFrame:
    """A row for each conversation and prefix before its tail, the root included, with ``more`` in terms of its depth ``d``."""
    each = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.least("n", C("tail") - 1))))
    half = {h: F.when(C("d") > 0, F.get(h, C("d") - 1)).otherwise(0).cast("long") for h in ("hi", "lo")}
    return each.select("conv", "d", *(v.alias(k) for k, v in (half | more).items()))


def _suffixes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rest``: at index d the bytes of the turns from d on, in one pass over each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, sizes = _flat(batch.column("bytes"))
            rest = []
            for a, b in zip(ends[:-1], ends[1:]):
                own = np.cumsum(sizes[a:b][::-1])[::-1]
                rest.append(np.concatenate([own[:1], own]) if len(own) else np.zeros(1, np.int64))
            flat = np.concatenate(rest) if rest else np.zeros(0, np.int64)
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int32)), pa.array(flat))
            kept = [n for n in batch.schema.names if n != "bytes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), column], [*kept, "rest"])

    return rows.mapInArrow(run, "conv bigint, n int, hi array<bigint>, lo array<bigint>, tail int, rest array<bigint>")


def _parents(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(owner, parent) of each row (owner, hi, lo): the owner of that node.

    Many rows can ask for one node, such as the root or a common first turn.
    Nodes with a ``HOT``-th of all memberships are at most ``HOT`` rows and are
    sent to all tasks; the others meet by a shuffle.
    """
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    least = total // HOT + 1
    named = nodes.select("hi", "lo", C("owner").alias("parent"), "n_convs")
    hot = F.broadcast(named.where(C("n_convs") >= least).drop("n_convs"))
    cold = named.where(C("n_convs") < least).drop("n_convs")
    return asked.join(hot, ["hi", "lo"]).unionByName(asked.join(hot, ["hi", "lo"], "left_anti").join(cold, ["hi", "lo"])).select("owner", "parent")


def _id_lists(ends: DataFrame) -> DataFrame:
    """(hi, lo, sha): SHA-256 of the comma-joined ids of each node's rows (hi, lo, conv), in numerical order.

    Rows are dealt out by ranges of node and id, so that a node with many ids
    has many tasks, each of which joins its ids to pieces of text. Only these
    go to one task for each node, which hashes them one after another.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, first, size = None, [], 0, 0
        for batch in batches:
            out = []
            for hi, lo, conv in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "conv"))):
                if (hi, lo) != node or size > _CHUNK:
                    if held:
                        out.append((*node, first, ",".join(held)))
                    node, held, first, size = (hi, lo), [], conv, 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield _table(out, ("hi", "lo", "first"), "ids")
        yield _table([(*node, first, ",".join(held))] if held else [], ("hi", "lo", "first"), "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids"))):
                if (hi, lo) != node:
                    out += [(*node, sha.hexdigest())] if node else []
                    node, sha = (hi, lo), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _table(out, ("hi", "lo"), "sha")
        yield _table([(*node, sha.hexdigest())] if node else [], ("hi", "lo"), "sha")

    pieces = ends.repartitionByRange("hi", "lo", "conv").sortWithinPartitions("hi", "lo", "conv").mapInArrow(join, "hi bigint, lo bigint, first bigint, ids string")
    return pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(digest, "hi bigint, lo bigint, sha string")


def _table(rows: list[tuple], numbers: tuple[str, ...], text: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * (len(numbers) + 1)
    types = [pa.int64()] * len(numbers) + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [*numbers, text])


def trie(lists: DataFrame, width: int | None = None) -> DataFrame:
    """One row for each distinct sequence of first turns of ``lists`` (conv, turns), the root of no turns included.

    Columns: ``conv_id`` smallest member; ``depth``; ``parent_conv_id``, the
    parent's smallest member (root: null); ``n_convs`` members; ``n_children``;
    ``n_leaves`` childless nodes in the subtree; ``saved_tokens``, bytes that
    sharing saves in the subtree, for each node its last text's bytes times its
    members but one; ``ends_sha256`` over the ids of the members that end here.
    A conversation without turns ends at the root. An empty table has no nodes.

    Two prefixes are one node if their digests of 128 bits are equal. ``width``
    of the sketch, a power of two from 8 on, changes the work, never the result.
    """
    tables = Tables(lists.sparkSession)
    raw = tables.put("paths", paths(lists))
    rows = tables.put("screened", _suffixes(screened(raw, width)))
    tables.drop("paths")

    member = _shared(rows, rest=F.get("rest", C("d")), end=(C("d") == C("n")).cast("long"))
    nodes = tables.put("nodes", member.groupBy("hi", "lo", "d").agg(F.count("*").alias("n_convs"), F.min("conv").alias("owner"), F.sum("rest").alias("whole"), F.sum("end").alias("ends")))

    # what each conversation owns begins at depth ``own``; ``leaf``: its last node is its own and has no child
    first = nodes.groupBy(C("owner").alias("conv")).agg(F.min("d").alias("first"), F.bool_or(C("ends") == C("n_convs")).alias("ended"))
    has_tail = C("tail") <= C("n")
    owning = rows.join(first, "conv", "left").withColumns({"own": F.coalesce("first", F.when(has_tail, C("tail"))), "leaf": F.coalesce("ended", F.lit(False)) | has_tail})
    owning = tables.put("owning", owning.where(C("own").isNotNull()).drop("first", "ended"))
    child = ((C("d") < C("n")) & (C("d") + 1 >= C("own"))).cast("long")
    below = _shared(owning, owned=F.get("rest", F.greatest("d", "own")), child=child, leaf=C("leaf").cast("long"))
    sums = below.groupBy("hi", "lo").agg(F.sum("owned").alias("owned"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"))

    before = C("own") - 1
    asked = owning.where("own > 0").select(C("conv").alias("owner"), *(F.when(before > 0, F.get(h, before - 1)).otherwise(0).cast("long").alias(h) for h in ("hi", "lo")))
    parents = tables.put("parents", _parents(asked, nodes).withColumnRenamed("owner", "conv"))
    tops = tables.put("tops", owning.select("conv", "own").join(parents, "conv", "left"))

    at_end = F.least("n", C("tail") - 1)
    end_half = [F.when(at_end > 0, F.get(h, at_end - 1)).otherwise(0).cast("long").alias(h) for h in ("hi", "lo")]
    shas = _id_lists(tables.put("ends", rows.where(~has_tail).select(*end_half, "conv")))

    none = F.sha2(F.lit("").cast("binary"), 256)
    parent = F.when(C("d") == C("own"), C("parent")).otherwise(C("conv_id"))
    columns = ["conv_id", C("d").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    grouped = nodes.join(sums, ["hi", "lo"]).join(shas, ["hi", "lo"], "left").withColumns({"saved_tokens": C("whole") - C("owned"), "ends_sha256": F.coalesce("sha", none), "conv_id": C("owner")})
    grouped = grouped.join(tops.withColumnRenamed("conv", "conv_id"), "conv_id").select(columns)

    tails = rows.where(has_tail).select("conv", "n", "tail").join(tops, "conv").withColumn("d", F.explode(F.sequence("tail", "n")))
    one, last = F.lit(1).cast("long"), C("d") == C("n")
    alone = tails.withColumns({
        "conv_id": C("conv"), "n_convs": one, "n_children": F.when(last, 0).otherwise(1).cast("long"), "n_leaves": one, "saved_tokens": F.lit(0).cast("long"),
        "ends_sha256": F.when(last, F.sha2(C("conv").cast("string").cast("binary"), 256)).otherwise(none),
    }).select(columns)
    result = tables.put("trie", grouped.unionByName(alone))
    tables.keep("trie")
    return result
