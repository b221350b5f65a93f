"""Near-duplicate documents by SimHash and a hierarchical index in Gray order.

Fingerprints of 64 bits are built from the XXH64 hashes of word shingles. Two
fingerprints link if they differ in at most ``max_bits`` bits, and documents
fall into the components of these links.

Links are found without comparing all pairs. Of ``max_bits + 1`` blocks of bits
two linked fingerprints share one whole, so each distinct fingerprint is sent
to one group per block. In a group the fingerprints are sorted by Gray rank,
in which neighbours differ in few bits, and a tree over that order keeps in
each upper node the bits that all members share (mask and pattern). Pairs of
nodes are taken from the top: the differences in shared bits accumulate on the
way down, and a pair of whole nodes is dropped once they exceed ``max_bits``,
or once all their members are known to be in one component. Only links of a
spanning forest leave a task, at most one row for each row it read.

A group of more than ``group_limit`` fingerprints is split again: its members
share the bits of their block, so linked ones share one of ``max_bits + 1`` parts
of the bits left. Every split sends a fingerprint to as many groups as there are
parts, and in the end the bits left allow no more fingerprints than the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables
from .common import row_key
from .components import connected_components
from .textbytes import LOWER, NOT_SPACE, SLICE_BYTES, Words, mix, pieces, slices, text_bytes, words_of

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
GROUP_LIMIT = 20_000
RUN_ROWS = 200_000
#: Shingles whose bits are counted at once
BLOCK = 1 << 16


def text_fingerprints(column: pa.Array, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit; texts without words (or null) give zero.

    A column of one text of more than ``SLICE_BYTES`` is read in pieces of that size,
    so memory grows by a few bytes for each of the text; a single word is never cut.
    """
    raw, off = text_bytes(column)
    if len(off) != 2 or len(raw) <= SLICE_BYTES:
        return _majority(*_bit_counts(words_of(raw, off, NOT_SPACE, LOWER), words, seed))
    ones, shingles, carried = np.zeros((1, 64), np.int64), np.zeros(1, np.int64), b""
    for a, b in pieces(raw, NOT_SPACE, SLICE_BYTES):
        part = np.concatenate([np.frombuffer(carried, np.uint8), raw[a:b]])
        w = words_of(part, np.array([0, len(part)]), NOT_SPACE, LOWER)
        if len(w.start) >= words or (b == len(raw) and not shingles[0]):
            more, n = _bit_counts(w, words, seed)
            ones, shingles = ones + more, shingles + n
        # the next shingle begins with the last words of this piece
        at = max(len(w.start) - words + 1, 0)
        carried = b"".join(w.data[s:e].tobytes() + b" " for s, e in zip(w.start[at:], w.end[at:]))
    return _majority(ones, shingles)


def _bit_counts(w: Words, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, in how many shingles' hashes each of the 64 bits is set, and its shingles."""
    ones, n_shingles = np.zeros((len(w.counts), 64), np.int64), np.zeros(len(w.counts), np.int64)
    if not len(w.start):
        return ones, n_shingles
    # words with one space between: the first separator after a word stays, as a space
    is_word = NOT_SPACE[w.data]
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]
    place = np.cumsum(keep) - 1
    packed = np.where(is_word, w.data, 32)[keep].astype(np.uint8).tobytes()
    start, end = place[w.start], place[w.end - 1] + 1
    n, first = w.counts, w.first[:-1]
    has = np.flatnonzero(n > 0)
    n_shingles[has] = shingles = np.maximum(n[has] - words + 1, 1)
    begin = np.concatenate([[0], np.cumsum(shingles)])
    head = np.repeat(first[has] - begin[:-1], shingles) + np.arange(begin[-1])
    tail = head + np.repeat(np.minimum(words, n[has]) - 1, shingles)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(head), BLOCK):
        j = min(i + BLOCK, len(head))
        hashes = np.fromiter((digest(packed[s:e], seed) for s, e in zip(start[head[i:j]].tolist(), end[tail[i:j]].tolist())), np.uint64, j - i)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, b = int(np.searchsorted(begin, i, "right")) - 1, int(np.searchsorted(begin, j))  # the texts of this block
        ones[has[a:b]] += np.add.reduceat(bits, np.maximum(begin[a:b] - i, 0), axis=0, dtype=np.int64)
    return ones, n_shingles


def _majority(ones: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, row_key, fingerprint): one row for each row of ``docs``; the fingerprint is a long with the 64 bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = text_fingerprints(part.column("text"), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row_key"), pa.array(found)], ["id", "row_key", "fingerprint"])

    base = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {kind}, row_key bigint, fingerprint bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each bit pattern in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Trees over fingerprints in Gray order, one for each group, laid out in one array.

    A group gets a run of slots of the next power of two, aligned to its size,
    so that a node of level l is ``slot >> l`` and its children are found by
    shifting. ``shared`` masks the bits equal in all members, ``pattern`` has
    their values, ``size`` counts members.
    """

    def __init__(self, group: np.ndarray, value: np.ndarray):
        order = np.lexsort((gray_rank(value), group))
        group, value = group[order], value[order]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.diff(np.append(begin, len(group)))
        depth = np.array([int(c - 1).bit_length() for c in count])
        by_depth = np.argsort(-depth, kind="stable")
        room = np.int64(1) << depth[by_depth]
        at = np.zeros(len(begin), np.int64)
        at[by_depth] = np.cumsum(room) - room
        slot = np.arange(len(group)) - np.repeat(begin, count) + np.repeat(at, count)
        top = int(depth.max())
        total = -(-int(room.sum()) >> top) << top
        low, high, size = (np.full(total, x, t) for x, t in ((~np.uint64(0), np.uint64), (np.uint64(0), np.uint64), (0, np.int64)))
        low[slot] = high[slot] = value
        size[slot] = 1
        self.value, self.row, self.roots, self.levels = low.copy(), np.full(total, -1), {}, []
        self.row[slot] = order
        for level in range(top + 1):
            self.roots[level] = at[depth == level] >> level
            self.levels.append((low | ~high, low, size))
            if level < top:
                low, high, size = low.reshape(-1, 2), high.reshape(-1, 2), size.reshape(-1, 2)
                low, high, size = low[:, 0] & low[:, 1], high[:, 0] | high[:, 1], size.sum(axis=1)

    def forest(self, max_bits: int, chunk: int = 1 << 18) -> np.ndarray:
        """Component label of each slot: the least slot that its links reach."""
        label = np.arange(len(self.value))
        spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        work = [(level, nodes, nodes) for level, nodes in self.roots.items() if level and len(nodes)]
        while work:
            level, a, b = work.pop()
            if len(a) > chunk:
                work += [(level, a[chunk:], b[chunk:])]
                a, b = a[:chunk], b[:chunk]
            shared, pattern, size = self.levels[level]
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & shared[a] & shared[b])
            keep = (apart <= max_bits) & (size[a] > 0) & (size[b] > 0)
            if level and keep.any():
                if level not in spans:
                    by_node = label[: len(label) >> level << level].reshape(-1, 1 << level)
                    filled = self.row[: by_node.size].reshape(by_node.shape) >= 0
                    spans[level] = (np.where(filled, by_node, len(label)).min(axis=1), np.where(filled, by_node, -1).max(axis=1))
                least, most = spans[level]
                keep &= np.minimum(least[a], least[b]) != np.maximum(most[a], most[b])
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                if _join(label, a, b):
                    spans.clear()
                continue
            own = a[a == b]
            a, b = a[a != b], b[a != b]
            pairs = [(2 * own, 2 * own + 1)] + [(2 * a + i, 2 * b + j) for i in (0, 1) for j in (0, 1)]
            work.append((level - 1, np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])))
            if len(own) and level > 1:  # inside a node first: what it joins need not be compared again
                work.append((level - 1, np.concatenate([2 * own, 2 * own + 1]), np.concatenate([2 * own, 2 * own + 1])))
        return label


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    changed = False
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return changed
        changed = True
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def _index_links(group: np.ndarray, value: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    index = GrayIndex(group, value)
    label = index.forest(max_bits)
    away = np.flatnonzero((index.row >= 0) & (label != np.arange(len(label))))
    return index.value[away], index.value[label[away]]


def _parts(shared: int, parts: int) -> list[int]:
    """Masks of the bits outside ``shared``, in so many parts; none if there are too few bits."""
    left = [b for b in range(64) if not shared >> b & 1]
    edge = [len(left) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in left[i:j]) for i, j in zip(edge, edge[1:])] if len(left) >= parts else []


def _split(groups: DataFrame, parts: int) -> DataFrame:
    """(fingerprint, shared, grp): each row of ``groups`` once for each part of the bits that its group does not share yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, shared, group = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            for mask in np.unique(shared).tolist():
                own = shared == mask
                for i, part in enumerate(_parts(mask, parts)):
                    grp = mix(mix(group[own] ^ np.uint64(i + 1)) + (value[own] & np.uint64(part)))
                    columns = value[own], np.full(own.sum(), mask | part, np.uint64), grp
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["fingerprint", "shared", "grp"])

    return groups.select("fingerprint", "shared", "grp").mapInArrow(run, "fingerprint bigint, shared bigint, grp bigint")


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``distinct`` that span every component."""
    tables, turn = Tables(distinct.sparkSession), 0
    large, small = distinct.select("fingerprint", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("grp")), []
    while True:
        rows = tables.put(f"groups{turn}", _split(large, max_bits + 1))
        size = rows.groupBy("grp").count()
        small.append(rows.join(size.where(f"count > 1 and count <= {group_limit}"), "grp").select("grp", "fingerprint"))
        # groups of fewer bits than parts hold a few fingerprints at most and stay as they are
        large = rows.join(size.where(f"count > {group_limit}"), "grp")
        stuck = F.bit_count("shared") > 64 - (max_bits + 1)
        small.append(large.where(stuck).select("grp", "fingerprint"))
        large = large.where(~stuck)
        if size.where(f"count > {group_limit}").isEmpty():
            break
        turn += 1
    dealt = reduce(DataFrame.unionByName, small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links(group, value):
            a, b = _index_links(group, value, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            if sum(len(g) for g, _ in held) >= RUN_ROWS:
                group, value = (np.concatenate(x) for x in zip(*held))
                whole = int(np.searchsorted(group, group[-1]))  # rows come sorted: the last group may go on
                held = [(group[whole:], value[whole:])]
                if whole:
                    yield links(group[:whole], value[:whole])
        if held and sum(len(g) for g, _ in held):
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(id, fingerprint, component): one row for each row of ``docs``.

    ``component`` is the least id in the row's component. Null and empty texts
    and texts of white space have fingerprint zero and link like any other;
    texts shorter than a shingle are one shingle. Repeated rows each return.
    A null id takes no part in the least id and is null only where a component
    has no other. An empty table gives no rows. Other columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    prints, rooted = _rooted(docs, tables, id_col, text_col, words, max_bits, group_limit)
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of = tables.put("components", rooted.join(least, "root").select("fingerprint", "component"))
    tables.keep("prints", "components")
    return prints.join(of, "fingerprint").select("id", "fingerprint", "component")


def _rooted(docs: DataFrame, tables: Tables, id_col: str, text_col: str, words: int, max_bits: int, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """(id, row_key, fingerprint) of each row, and (fingerprint, least, root): the least id and the component of each fingerprint."""
    prints = tables.put("prints", fingerprints(docs, id_col, text_col, words))
    distinct = tables.put("distinct", prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    roots = connected_components(tables.put("near", fingerprint_links(distinct.select("fingerprint"), max_bits, group_limit)))
    return prints, distinct.join(roots, distinct.fingerprint == roots.id, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row of ``docs`` for each component, with its columns as they are.

    It is the row of least id, rows without an id after all others; of rows
    with one id and several texts that of least ``row_key``, and of rows that
    repeat both any one. A row whose id another text has too stays if it is no
    near copy.
    """
    tables = Tables(docs.sparkSession)
    prints, rooted = _rooted(docs, tables, id_col, text_col, words, max_bits, group_limit)
    first = prints.join(rooted, "fingerprint").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("at"))
    kept = tables.put("kept", first.select(F.col("at.id").alias("_id"), F.col("at.row_key").alias("_row_key")))
    tables.keep("kept")
    keyed = docs.withColumn("_key", row_key(id_col, text_col))
    chosen = keyed.join(kept, (F.col("_key") == F.col("_row_key")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    return chosen.dropDuplicates(["_key", id_col]).select(*(F.col(f"`{c}`") for c in docs.columns))
