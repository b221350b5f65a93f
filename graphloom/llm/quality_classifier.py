"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector for all
grades and ordered thresholds. x has a one for each hash bucket of the words of
a text, and for its bin of a few style measures. The expected grade and the
probability of the top grade select texts.

Grades: 0 low quality, 1 good but toxic, 2 good and not toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textbytes import ALNUM, LOWER, NOT_SPACE, SLICE_BYTES, pieces, slices, sums_by, text_bytes, words_of

BUCKETS_LOG2 = 18
TRAIN_DOCS = 12_000
#: A bucket is used if it occurs in so many training documents, and if their mean grade
#: is so many standard errors from the mean of all: noise in rare words stays out
MIN_DOCS = 5
MIN_Z = 5.0
MIN_TAIL = 0.5
_STYLE_BINS = 8
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_PUNCT = np.isin(np.arange(256), list(b"!?.,;:"))


@dataclass
class Model:
    """``weights`` by bucket, style bins at the end; ``thresholds`` ascending."""

    weights: np.ndarray
    thresholds: np.ndarray


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of each text, end to end, and where each text's begin.

    A column of one text of more than ``SLICE_BYTES`` is read in pieces of that size.
    """
    raw, off = text_bytes(column)
    if len(off) != 2 or len(raw) <= SLICE_BYTES:
        key, counts = _tally(raw, off)
    else:
        key, counts = np.zeros(0, np.int64), np.zeros((6, 1), np.int64)
        for a, b in pieces(raw, NOT_SPACE, SLICE_BYTES):
            found, more = _tally(raw[a:b], np.array([0, b - a]))
            key, counts = np.union1d(key, found), counts + more
    buckets, n = 1 << BUCKETS_LOG2, len(off) - 1
    symbols, upper, punct, size, low, words = counts
    size = np.maximum(size, 1)
    distinct = np.bincount(key // buckets, minlength=n)
    ratios = [symbols / size, upper / size, punct / size, distinct / np.maximum(low, 1), np.minimum(np.log2(1.0 + words) / 16, 1)]
    edges = [(0.005, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3), (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6), (0.005, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4), (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8), (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)]
    style = np.stack([np.searchsorted(e, r, "right") + i * _STYLE_BINS for i, (e, r) in enumerate(zip(edges, ratios))], axis=1)
    of = np.concatenate([key // buckets, np.repeat(np.arange(n), style.shape[1])])
    ids = np.concatenate([key % buckets, buckets + style.ravel()])
    order = np.argsort(of, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)


def _tally(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (text, bucket) keys of the words, and by text: symbols, capitals, punctuation, bytes, words by letters and by spaces."""
    low = words_of(raw, off, ALNUM, LOWER)
    buckets = 1 << BUCKETS_LOG2
    key = np.unique(low.doc().astype(np.int64) * buckets + (low.hashes() & np.uint64(buckets - 1)).astype(np.int64))
    words = words_of(raw, off, NOT_SPACE)
    by_text = [sums_by(flags[words.data], off) for flags in (_SYMBOL, _UPPER, _PUNCT)]
    return key, np.stack([*by_text, np.diff(off), low.counts, words.counts])


N_FEATURES = (1 << BUCKETS_LOG2) + 5 * _STYLE_BINS


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def likelihood(p: np.ndarray, features: int, ids: np.ndarray, rows: np.ndarray, grade: np.ndarray, grades: int, decay: float) -> tuple[float, np.ndarray]:
    """Log-likelihood a row, less a penalty on the weights, and its gradient. ``p`` has the weights, the first threshold and logs of the steps to the others."""
    w, cut = p[:features], _thresholds(p[features:])
    z = np.bincount(rows, weights=w[ids], minlength=len(grade))
    below = np.concatenate([np.zeros((len(z), 1)), _sigmoid(cut[None] - z[:, None]), np.ones((len(z), 1))], axis=1)
    slope = below * (1 - below)
    at = np.arange(len(z))
    prob = np.maximum(below[at, grade + 1] - below[at, grade], 1e-9)
    dz = -(slope[at, grade + 1] - slope[at, grade]) / prob
    dcut = np.array([(np.where(grade == k, slope[:, k + 1], 0) / prob - np.where(grade == k + 1, slope[:, k + 1], 0) / prob).sum() for k in range(grades - 1)])
    dgap = np.exp(p[features + 1 :]) * np.cumsum(dcut[::-1])[::-1][1:]
    gradient = np.concatenate([np.bincount(ids, weights=dz[rows], minlength=features), dcut.sum(keepdims=True), dgap]) / len(z)
    gradient[:features] -= decay * w
    return float(np.log(prob).mean() - decay * (w @ w) / 2), gradient


def train(ids: np.ndarray, first: np.ndarray, grade: np.ndarray, grades: int = 3, rounds: int = 400, decay: float = 3e-5) -> Model:
    """Maximum likelihood with an L2 penalty, all rows a round (Adam)."""
    rows = np.repeat(np.arange(len(grade)), np.diff(first))
    seen = np.bincount(ids, minlength=N_FEATURES)
    mean = np.bincount(ids, weights=grade[rows].astype(float), minlength=N_FEATURES) / np.maximum(seen, 1)
    z = np.abs(mean - grade.mean()) * np.sqrt(seen) / max(grade.std(), 1e-9)
    used = np.flatnonzero((seen >= MIN_DOCS) & (z >= MIN_Z))
    use = np.isin(ids, used)
    ids, rows, n = np.searchsorted(used, ids[use]), rows[use], len(used)
    share = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(0.001, 0.999)
    cut = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(n), cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        grad = likelihood(p, n, ids, rows, grade, grades, decay)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(N_FEATURES, np.float32)
    weights[used] = p[:n]
    return Model(weights, _thresholds(p[n:]))


def _thresholds(p: np.ndarray) -> np.ndarray:
    """The first, then steps upwards: always in order."""
    return np.cumsum(np.concatenate([p[:1], np.exp(p[1:])]))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model from the documents that ``labels`` (doc_id, quality, toxic) grades.

    The sample is the ``train_docs`` labelled ids of least hash, and of the rows of
    an id that repeats the one whose text has the least hash. Labels without
    an id or a quality are left out; a null ``toxic`` is 0. With no labelled
    document every text has the top grade.
    """
    graded = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) != 0, 1).otherwise(2)
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(graded).alias("grade"))
    sample = written(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = features(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), lists], ["doc_id", "grade", "ids"])

    # one row of an id that repeats: the bound on the sample is one on rows
    used = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(F.max("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text"))
    found = used.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, ids array<int>").toArrow()
    if not found.num_rows:
        return Model(np.zeros(N_FEATURES, np.float32), np.array([-40.0, -39.0]))
    found = found.sort_by([("doc_id", "ascending")]).combine_chunks()
    lists = found.column("ids").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return train(lists.flatten().to_numpy().astype(np.int64), first, found.column("grade").to_numpy())


def score(docs: DataFrame, model: Model, min_tail: float = MIN_TAIL) -> DataFrame:
    """(doc_id, expected_grade, p_top, kept): one row for each row of ``docs``.

    Null and empty texts have no word features and are scored by style alone.
    Repeated rows each return; an empty table gives no rows; other columns are
    ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = features(part.column("text"))
                rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
                z = np.bincount(rows, weights=m.weights[ids], minlength=len(first) - 1)
                above = 1 - _sigmoid(m.thresholds[None] - z[:, None])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(above.sum(1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= min_tail)], ["doc_id", "expected_grade", "p_top", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_top double, kept boolean")
