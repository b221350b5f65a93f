"""Benchmark decontamination by winnowed fingerprints.

A benchmark item of ``window`` words or more has every run of ``window``
consecutive words as a window; a shorter item is one window as a whole. A word
of a document is hit if it lies inside an occurrence of a window.

Every text is hashed in k-grams of words, and a k-gram is kept as a fingerprint
if its hash is the minimum of some ``window - k + 1`` consecutive k-grams. Any
shared span as long as a window holds ``window - k + 1`` k-grams and so a kept
one, at the same place on either side: no occurrence can be missed. Documents'
and items' fingerprints are joined, and each hit is extended to either side
over the words kept with it, so that hashes only propose and words decide.
Items shorter than a window form a class for each length (12 at most) with
k-grams no longer than the item.

Equal fingerprints with equal words around them are one row with its places, in a
document as well as among the items, so that a word or a phrase that repeats does
not multiply. Each place is extended as far as any item lets it, and the runs of
hit words are merged in one pass over each document's sorted places.

Documents are first held against a bitmap of the items' fingerprints. Its size
is fixed, whatever the benchmark's; it only thins what is sent to the join.

A text takes some 10 times its bytes in its task, for the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written
from .textbytes import ALNUM, LOWER, Words, find_words, grams, mix, slices

WINDOW = 13
GRAM = 6
#: log2 of the bits of the bitmap: 512 KiB, at most 65,536 rows of one long to the driver
BITMAP_LOG2 = 22
_NONE = ~np.uint64(0)

HITS = "array<struct<key:bigint,need:int,places:array<int>,gram:string,left:array<string>,right:array<string>>>"


def _gram_of(need: int) -> int:
    return min(GRAM, need)


def _slide(x: np.ndarray, width: int, pick, pad, ahead: bool) -> np.ndarray:
    """``pick`` over ``width`` values from each position on (ahead), or up to each position."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        moved = np.full(len(x), pad, dtype=x.dtype)
        if ahead:
            moved[: max(len(x) - step, 0)] = out[step:]
        else:
            moved[step:] = out[: max(len(x) - step, 0)]
        out, have = pick(out, moved), have + step
    return out


def winnow(w: Words, hashes: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the fingerprints for windows of ``need`` words, and their keys."""
    k = _gram_of(need)
    h = grams(hashes, k)
    left = np.repeat(w.first[1:], w.counts) - np.arange(len(h))  # words from here to the text's end
    h[left < k] = _NONE
    low = _slide(h, need - k + 1, np.minimum, _NONE, True)
    kept = (_slide(low, need - k + 1, np.maximum, np.uint64(0), False) == h) & (left >= k)
    at = np.flatnonzero(kept)
    return at, mix(h[at] + np.uint64(need)).view(np.int64)


def _hits(w: Words, at: np.ndarray, keys: np.ndarray, need: int) -> list[tuple[int, dict]]:
    """(text, fingerprint) for each distinct fingerprint of a text with the words around it, with all its places."""
    k, reach = _gram_of(need), need - _gram_of(need)
    doc = np.searchsorted(w.first, at, "right") - 1
    found: dict[tuple, list[int]] = {}
    for i, key, d in zip(at.tolist(), keys.tolist(), doc.tolist()):
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        a, b = max(lo, i - reach), min(hi, i + k + reach)
        words = tuple(w.data[s:e].tobytes() for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist()))
        found.setdefault((d, key, i - a, words), []).append(i - lo)
    out = []
    for (d, key, ahead, words), places in found.items():
        text = [x.decode("utf-8", "replace") for x in words]
        out.append((d, {"key": key, "need": need, "places": places, "gram": " ".join(text[ahead : ahead + k]), "left": text[:ahead][::-1], "right": text[ahead + k :]}))
    return out


def _scan(df: DataFrame, extra: str, needs, bitmap=None) -> DataFrame:
    """Adds n_words and hits to ``df`` (columns of ``extra``, then text), one row for each of its rows."""
    names = [x.split()[0] for x in extra.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                w = find_words(part.column("text"), ALNUM, LOWER)
                hashes, found = w.hashes(), [[] for _ in range(part.num_rows)]
                for need in sorted(needs) if needs is not None else range(1, WINDOW + 1):
                    at, keys = winnow(w, hashes, need)
                    if needs is None:  # items: those of this length, or the full windows
                        n = np.repeat(w.counts, w.counts)[at]
                        mine = n >= need if need == WINDOW else n == need
                    else:
                        place = keys.view(np.uint64) >> np.uint64(64 - BITMAP_LOG2)
                        mine = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    for d, hit in _hits(w, at[mine], keys[mine], need):
                        found[d].append(hit)
                columns = [part.column(n) for n in names] + [pa.array(w.counts.astype(np.int64)), pa.array(found, _HITS_ARROW)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "hits"])

    return df.select(*names, "text").mapInArrow(run, f"{extra}, n_words bigint, hits {HITS}")


_HITS_ARROW = pa.list_(pa.struct([("key", pa.int64()), ("need", pa.int32()), ("places", pa.list_(pa.int32())), ("gram", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))


def _bitmap(prints: DataFrame) -> bytes:
    place = F.shiftrightunsigned("key", 64 - BITMAP_LOG2)
    words = prints.select(F.shiftrightunsigned(place, 6).alias("i"), place.bitwiseAND(F.lit(63)).cast("int").alias("b")).groupBy("i").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits"))
    out = np.zeros(1 << BITMAP_LOG2 - 6, dtype=np.int64)
    for i, bits in words.collect():  # one row for each 64 bits of the bitmap at most
        out[i] = bits
    return out.tobytes()


def _same(a: str, b: str):
    """How many leading elements of two arrays are equal."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(equal).cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, row_key, n_words, n_hit, items, spans): a row for each row of ``docs``.

    ``items`` are the ids, as sorted strings, of the benchmark items with a
    window in the document, ``spans`` the maximal runs of hit words as
    (first word, word after the last). Null and empty texts have no words and
    no hits, and an item without words has no window. With an empty benchmark
    nothing is hit, an empty table gives no rows. Repeated rows each return; the
    same id with another text is another document. A null id is kept as it is;
    an item with a null id counts towards n_hit, not towards ``items``.
    """
    spark = docs.sparkSession
    items = _scan(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).distinct(), "item string", None)
    prints = items.select("item", F.explode("hits").alias("h")).groupBy("h.key", "h.need", "h.gram", "h.left", "h.right").agg(F.collect_set("item").alias("item"))
    prints = written(prints, "bench")
    needs = [r[0] for r in prints.select("need").distinct().collect()]  # 13 values at most
    bitmap = spark.sparkContext.broadcast(_bitmap(prints.select("key").distinct()))
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    found = written(_scan(base, f"id {kind}, row_key bigint", needs, bitmap), "hits")
    rows = found.groupBy("id", "row_key").agg(F.max("n_words").alias("n_words"), F.count("*").alias("times"))
    bench = prints.select("key", "need", F.col("item").alias("items"), *(F.col(c).alias(f"b_{c}") for c in ("gram", "left", "right")))
    met = found.select("id", "row_key", F.explode("hits").alias("h")).select("id", "row_key", "h.*").join(bench, ["key", "need"]).where(F.col("gram") == F.col("b_gram"))
    met = met.withColumns({"before": _same("left", "b_left"), "after": F.least("need", F.lit(GRAM)) + _same("right", "b_right")}).where("before + after >= need")
    hits = met.groupBy("id", "row_key").agg(F.collect_set(F.struct("places", "before", "after")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.select(F.col("id").alias("_id"), F.col("row_key").alias("_key"), "hits", "items")
    both = rows.join(hits, (F.col("row_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<string>")
    merged = _merged(both.withColumn("items", F.coalesce("items", none)), kind)
    return merged.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_each", "times")


def _merged(by_doc: DataFrame, kind: str) -> DataFrame:
    """Adds n_hit and spans: the union of the places' reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, spans = [], []
            for hits in (x or [] for x in batch.column("hits").to_pylist()):
                starts = np.array([p - h["before"] for h in hits for p in h["places"]], np.int64)
                ends = np.array([p + h["after"] for h in hits for p in h["places"]], np.int64)
                order = np.argsort(starts, kind="stable")
                starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(order) else ends
                new = np.concatenate([[True], starts[1:] > ends[:-1]])[: len(starts)]
                first, last = starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] if len(ends) else ends
                n_hit.append(int((last - first).sum()))
                spans.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist())])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "row_key", "n_words", "times", "items")] + [pa.array(n_hit, pa.int64()), pa.array(spans, span)], ["id", "row_key", "n_words", "times", "items", "n_hit", "spans"])

    return by_doc.select("id", "row_key", "n_words", "times", "hits", "items").mapInArrow(run, f"id {kind}, row_key bigint, n_words bigint, times bigint, items array<string>, n_hit bigint, spans array<struct<start:bigint,end:bigint>>")


def is_contaminated() -> Column:
    """One word in twenty, or more, is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns as they are; rows that repeat stay or go together."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = contamination(docs, benchmark, **options).where(is_contaminated()).select(F.col("id").alias("_id"), F.col("row_key").alias("_row_key"))
    bad = written(bad, "contaminated")
    same = (row_key(id_col, text_col) == F.col("_row_key")) & F.col(id_col).eqNullSafe(F.col("_id"))
    return docs.join(bad, same, "left_anti")
