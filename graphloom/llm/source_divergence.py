"""How far the sources of each language differ in their words.

Terms are counted once, in tasks that add up their own texts before the
shuffle. The kept terms of a language get ids in chunks, and each (chunk,
source, count) becomes a bitmap of the ids that have that count there. For two
sources, AND and popcount of their bitmaps give how many terms have count a in
one and b in the other; each such cell is multiplied by f(a, b), and cells with
a zero are what the others leave. As sums over chunks add up, no task needs
more than the bitmaps of two blocks of sources in one chunk.

A bitmap of few ids is kept as their list, as in compressed bitmaps: two lists
meet by search, a list and a bitmap by testing bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import Tables

CHUNK = 1 << 15  # ids of a chunk, about
SOURCES = 32  # sources of a block
UNIT = 1_000_000_000
_DENSE = 16  # a bitmap of more ids than one for so many of the chunk's is kept as bits
_HELD = 1 << 18  # counts that a task holds at most before it sends them on
_SLICE = 1 << 22  # bytes of a text that are counted at once
C = F.col

#: A-Z become a-z, bytes that belong to no term become spaces
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a slice at a time."""
    at = 0
    while at < len(data):
        to = at + _SLICE
        while to < len(data) and _TERM_BYTES[data[to]] != 32:
            to += 1
        yield data[at:to].translate(_TERM_BYTES).split(b" ")
        at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each source of a language, and the documents that have it.

    A term is a run of letters a-z, after A-Z are lower-cased, and of other
    characters beyond ASCII. Null text, language or source is empty. Repeated
    rows are documents of their own. Each task sends a term of a source once for
    each ``_HELD`` counts, and a text is read a slice at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        have = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                n, seen = counts.setdefault((lang, source), (Counter(), Counter()))
                before, here = len(n), set()
                for some in _terms(text.as_py().encode()):
                    n.update(some)
                    here.update(some)
                seen.update(here)
                have += len(n) - before
            if have > _HELD:
                yield _counted(counts)
                counts, have = {}, 0
        yield _counted(counts)

    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = texts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(counts: dict) -> pa.RecordBatch:
    rows = [(lang, source, n, docs) for (lang, source), (n, docs) in counts.items()]
    sizes = [len(n) - (b"" in n) for _, _, n, _ in rows]
    terms = [t for _, _, n, _ in rows for t in n if t]
    columns = [
        pa.array(np.repeat(np.array([r[i] for r in rows] or [""], object), sizes or [0]), pa.string()) for i in (0, 1)
    ] + [pa.array(terms, pa.binary()).cast(pa.string()), pa.array([c for _, _, n, _ in rows for t, c in n.items() if t], pa.int64()), pa.array([docs[t] for _, _, n, docs in rows for t in n if t], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), exactly, whatever the counts; null without terms."""
    wide = (n + 1).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + terms).cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """Counts of a corpus and what its sources differ in; ``close`` deletes its tables.

    ``kept``: (lang, term, all, chunk, at), the terms that at least ``least`` documents of
    a language have, with their occurrences and ids. ``groups``: (lang, source,
    total, terms, block, blocks, chunks) for each source of a language, those without terms included.
    """

    def __init__(self, docs: DataFrame, least: int = 3, chunk: int = CHUNK, sources: int = SOURCES):
        self.tables = tables = Tables(docs.sparkSession)
        counts = tables.put("counts", term_counts(docs))
        by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(C("docs") >= least)
        kept = tables.put("kept", by_lang.drop("docs"))
        self.langs = tables.put("langs", kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total")))
        chunks = F.greatest(F.ceil(C("terms") / chunk), F.lit(1)).cast("int")
        dealt = kept.join(self.langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), chunks).cast("int"))
        self.kept = tables.put("ids", dealt.withColumn("at", F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1))
        tables.drop("kept")

        self.found = tables.put("found", counts.drop("docs").join(self.kept.drop("terms", "lang_total"), ["lang", "term"]))
        tables.drop("counts")
        seen = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        totals = self.found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        block = F.floor((F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1) / sources).cast("int")
        groups = seen.join(totals, ["lang", "source"], "left").join(self.langs.drop("lang_total"), "lang", "left").fillna(0, ["total", "terms"])
        groups = groups.withColumns({"block": block, "blocks": F.ceil(F.count("*").over(W.partitionBy("lang")) / sources).cast("int"), "chunks": chunks})
        self.groups = tables.put("groups", groups)

    def bitmaps(self) -> DataFrame:
        """(lang, chunk, source, n, terms, dense, ids): for each count of a source in a chunk how many terms have it, and which, as bits or a list of 16-bit ids."""
        sizes = self.kept.groupBy("lang", "chunk").agg(F.count("*").alias("size"))
        levels = self.found.groupBy("lang", "chunk", "source", "n").agg(F.collect_list("at").alias("at")).join(sizes, ["lang", "chunk"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dense, data, n = [], [], []
                for at, size in zip(batch.column("at"), batch.column("size").to_pylist()):
                    ids = np.sort(at.values.to_numpy())
                    dense.append(len(ids) * _DENSE > size)
                    n.append(len(ids))
                    data.append(_bits(ids, size).tobytes() if dense[-1] else ids.astype("<u4").tobytes())
                names = ["lang", "chunk", "source", "n"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(dense, pa.bool_()), pa.array(data, pa.binary())], [*names, "terms", "dense", "ids"])

        return levels.select("lang", "chunk", "source", "n", "at", "size").mapInArrow(run, "lang string, chunk int, source string, n bigint, terms bigint, dense boolean, ids binary")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): for each other source of the language the sum of f over all its kept terms."""
        sizes = self.kept.groupBy("lang", "chunk").agg(F.count("*").alias("size"))
        held = self.bitmaps().groupBy("lang", "chunk", "source").agg(F.collect_list(F.struct("n", "dense", "ids")).alias("levels"))
        each = self.groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), C("chunks") - 1)))
        rows = each.join(sizes, ["lang", "chunk"], "left").join(held, ["lang", "chunk", "source"], "left")
        other = F.explode(F.sequence(F.lit(0), C("blocks") - 1)).alias("other")
        dealt = rows.select("lang", "chunk", "source", "block", "total", "terms", F.coalesce("size", F.lit(0)).alias("size"), "levels", other)
        dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

        def run(rows: pa.Table) -> pa.Table:
            held = [_Counts(r) for r in rows.to_pylist()]
            lang = rows.column("lang")[0].as_py()
            out: list[tuple] = []
            for i, a in enumerate(held):
                for b in held[:i]:
                    if a.block != b.block or rows.column("low")[0] == rows.column("high")[0]:
                        here, back = a.against(b)
                        out += [(lang, a.source, b.source, here), (lang, b.source, a.source, back)]
            columns = list(zip(*out)) or [(), (), (), ()]
            return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "item", "value"])

        parts = dealt.groupBy("lang", "chunk", "low", "high").applyInArrow(run, "lang string, source string, item string, value bigint")
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self, most: int = 200) -> DataFrame:
        """(lang, source, item, value, rank): the ``most`` terms that a source has more of than its language, by f."""
        p, q = share(C("n"), C("total"), C("terms")), share(C("all"), C("lang_total"), C("terms"))
        rows = self.found.join(self.langs, "lang").join(self.groups.select("lang", "source", "total"), ["lang", "source"])
        more = rows.select("lang", "source", C("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        return ranked(more.select("lang", "source", "item", divergence(C("p"), C("q")).alias("value"))).where(C("rank") <= most)

    def close(self, *keep: str) -> None:
        self.tables.keep(*keep)


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` of each item in its source, by value from the greatest on, ties by the item's bytes."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(C("value").desc(), "item")))


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of 64-bit words."""
    words = np.zeros((size + 63) // 64 * 64, np.uint8)
    words[ids] = 1
    return np.packbits(words, bitorder="little").view(np.uint64)


class _Counts:
    """One source's bitmaps in one chunk, level by level, with the share p of each level; level 0 is the count 0."""

    def __init__(self, row: dict):
        self.source, self.block, self.size = row["source"], row["block"], row["size"]
        levels = sorted(row["levels"] or [], key=lambda level: level["n"])
        whole = row["total"] + row["terms"]
        self.p = np.array([1 + UNIT * (n + 1) // whole for n in (0, *(x["n"] for x in levels))] if whole else [1] * (len(levels) + 1), np.int64)
        dense = [(i, x) for i, x in enumerate(levels, 1) if x["dense"]]
        few = [(i, np.frombuffer(x["ids"], "<u4")) for i, x in enumerate(levels, 1) if not x["dense"]]
        self.dense = np.array([i for i, _ in dense], np.int64)
        self.words = np.array([np.frombuffer(x["ids"], np.uint64) for _, x in dense], np.uint64).reshape(len(dense), (self.size + 63) // 64)
        ids = np.concatenate([np.zeros(0, np.uint32), *(x for _, x in few)])
        level = np.repeat(np.array([i for i, _ in few], np.int64), [len(x) for _, x in few])
        order = np.argsort(ids)
        self.ids, self.level = ids[order].astype(np.int64), level[order]
        self.n = np.zeros(len(levels) + 1, np.int64)  # terms of each level
        self.n[self.dense] = np.bitwise_count(self.words).sum(1)
        self.n += np.bincount(self.level, minlength=len(self.n))
        self.n[0] = self.size - self.n.sum()

    def cells(self, other: _Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Joint cells that are not empty: a level of this source, one of the other, and how many terms have both."""
        wide = len(other.n)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i, words in zip(self.dense, self.words):
            both = np.bitwise_count(other.words & words).sum(1, dtype=np.int64) if len(other.words) else np.zeros(0, np.int64)
            found.append((i * wide + other.dense[both > 0], both[both > 0]))
        at = np.minimum(np.searchsorted(other.ids, self.ids), max(len(other.ids) - 1, 0))
        met = other.ids[at] == self.ids if len(other.ids) else np.zeros(len(self.ids), bool)
        keys = [self.level[met] * wide + other.level[at[met]] if len(other.ids) else np.zeros(0, np.int64)]
        keys += [i * wide + other.level[_has(words, other.ids)] for i, words in zip(self.dense, self.words)]
        keys += [self.level[_has(words, self.ids)] * wide + j for j, words in zip(other.dense, other.words)]
        found.append(np.unique(np.concatenate(keys), return_counts=True))
        key, n = (np.concatenate(x) for x in zip(*found))
        a, b = key // wide, key % wide
        # what a level has beyond these cells has the count 0 in the other source
        rest_a = self.n - np.bincount(a, n, len(self.n)).astype(np.int64)
        rest_b = other.n - np.bincount(b, n, wide).astype(np.int64)
        rest_a[0] = self.size - n.sum() - rest_a[1:].sum() - rest_b[1:].sum()
        zero_a, zero_b = np.arange(len(rest_a)), np.arange(1, wide)
        return np.concatenate([a, zero_a, 0 * zero_b]), np.concatenate([b, 0 * zero_a, zero_b]), np.concatenate([n, rest_a, rest_b[1:]])

    def against(self, other: _Counts) -> tuple[int, int]:
        """Sums of f over the chunk's terms, of this source against the other and back."""
        a, b, n = self.cells(other)
        p, q = self.p[a], other.p[b]
        square = (p - q) ** 2
        return int((square // q * n).sum()), int((square // p * n).sum())


def _has(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the ids are in the bitmap."""
    return (words[ids >> 6] >> (ids & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def audit(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of all sources of each language.

    Part ``pair``: each other source of the language. Part ``term``: terms that
    the source has more of than the language. An empty table gives no rows, a
    language without kept terms pairs of value 0, a language with one source no
    pairs. Other columns are ignored, whatever their names.
    """
    found = Audit(docs, least)
    pairs = ranked(found.pairs()).withColumn("part", F.lit("pair"))
    both = pairs.unionByName(found.terms(most).withColumn("part", F.lit("term")))
    out = found.tables.put("audit", both.select("lang", "source", "part", "item", "value", "rank"))
    found.close("audit")
    return out
