"""Quality rules: base counts, and line labels from a linear-chain CRF.

Each line of a text is content or boilerplate. A conditional random field with
binary features of lines, a weight for each label and feature, and weights for
each pair of neighbouring labels scores whole label sequences; Viterbi decoding
finds the best one for all lines of a text. A text is kept if it passes the
base rules and the words of its content lines are at least ``min_share`` of its
words.

The CRF is trained here on labelled documents, whose labels say nothing of their
lines. Lines start with their document's label and without weights for
neighbours. Then labels and weights are learnt in turns: the weights label the
lines, where a good document must keep ``min_share`` of its words as content and
a bad one must not, and these labels train the weights anew. So a clean line of
a bad document becomes content, and the weights for neighbours are learnt from
texts that switch. At most ``train_docs`` documents and ``train_lines`` lines of
each, in three runs spread over the text, are used for training (never for
counts or decoding, which cover all lines of all texts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textbytes import NOT_SPACE, find_words, grams, mix, slices, span_hashes, sums_before, sums_by

MIN_WORDS = 50
MIN_SHARE = 0.5
TRAIN_DOCS = 4_000
TRAIN_LINES = 48
#: What each feature of a line is
FEATURES = ("always", "no words", "3 words or fewer", "4 to 9 words", "symbols over 2 %", "symbols over 10 %", "capitals over half", "exclamation marks over 5 %",
            "bars over 10 % of words", "words equal to the one before over 20 %", "repeated triples over 30 %", "equal to an earlier line", "ends like a sentence", "digits over 30 %", "long words")
_N = len(FEATURES)
#: Used where there is no labelled row: every line is content
PRIOR = np.concatenate([np.eye(1, _N)[0], np.zeros(4)])

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_HEAD = (np.arange(256) & 0xC0) != 0x80


class Lines:
    """Counts by text, and lines with their features, of a column of texts.

    A text takes some 12 times its bytes: repeats are found by a hash of each word and line.
    """

    def __init__(self, column: pa.Array):
        w = find_words(column, NOT_SPACE)
        data, off = w.data, w.offsets
        n = len(off) - 1
        breaks = np.flatnonzero(data == 10)
        doc = np.concatenate([np.arange(n), np.searchsorted(off, breaks, "right") - 1])
        start = np.concatenate([off[:-1], breaks + 1])
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int64)
        end = np.append(start[1:] - 1, 0)
        end[self.first[1:] - 1] = off[1:]
        span = np.stack([start, end])
        in_line = np.searchsorted(w.start, span)
        words = in_line[1] - in_line[0]
        hashes = w.hashes()

        def by_line(flags):
            return sums_before(flags, end) - sums_before(flags, start)

        def by_words(flags):
            return sums_before(flags, in_line[1]) - sums_before(flags, in_line[0])

        word_doc = w.doc()
        salt = mix(np.arange(1, n + 1, dtype=np.uint64))
        left = np.repeat(w.first[1:], w.counts) - np.arange(len(hashes))
        triple = np.flatnonzero(left >= 3)
        again = _occurs_again(grams(hashes, 3)[triple] ^ salt[word_doc[triple]])[0]
        cover = np.zeros(len(hashes) + 2, bool)
        for j in range(3):
            cover[triple[again] + j] = True
        cover = cover[: len(hashes)]
        full = np.flatnonzero(words > 0)
        repeat = np.zeros(len(start), bool)
        repeat[full] = _occurs_again(span_hashes(data, start[full], end[full]) ^ salt[doc[full]])[1]
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])

        self.words, self.counts = words, w.counts
        self.word_chars = sums_by(NOT_SPACE[data] & _HEAD[data], off)
        self.symbols = sums_by(_SYMBOL[data], off)
        self.dup_lines = sums_by(repeat, self.first)
        self.repeat_words = sums_by(cover, w.first)

        size = np.maximum(end - start, 1)
        at_least = np.maximum(words, 1)
        last = np.zeros(len(start), np.uint8)
        last[full] = data[w.end[in_line[1][full] - 1] - 1]
        symbols, chars = by_line(_SYMBOL[data]), by_line(NOT_SPACE[data])
        self.features = np.stack([
            np.ones(len(start), bool), words == 0, (words > 0) & (words <= 3), (words > 3) & (words < 10), 50 * symbols > size, 10 * symbols > size,
            2 * by_line(_UPPER[data]) > np.maximum(by_line(_LETTER[data]), 1), 20 * by_line(data == 33) > size, 10 * by_line(data == 124) > at_least,
            5 * by_words(same) > at_least, 10 * by_words(cover) > 3 * at_least, repeat, np.isin(last, list(b".!?")), 10 * by_line(_DIGIT[data]) > 3 * size, chars > 12 * at_least,
        ], axis=1).astype(np.float64)


def _occurs_again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which occurred earlier."""
    order = np.argsort(keys, kind="stable")
    near = keys[order][1:] == keys[order][:-1]
    before, after = np.concatenate([[False], near])[: len(keys)], np.concatenate([near, [False]])[: len(keys)]
    again, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order], earlier[order] = before | after, before
    return again, earlier


def viterbi(emit: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best label (0 or 1) of each line; text d has the lines ``first[d]:first[d + 1]``.

    All texts advance a line at a time together. Equal scores go to label 0.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, sizes = first[:-1][order], n[order]
    label = np.zeros(len(emit), np.int8)
    back = np.zeros((len(emit), 2), np.int8)
    score = np.zeros((len(order), 2))
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")
    for t in range(steps):
        m = active[t]
        at = begin[:m] + t
        if t == 0:
            score[:m] = emit[at]
            continue
        come = score[:m, :, None] + move[None]
        back[at] = come.argmax(axis=1)
        score[:m] = come.max(axis=1) + emit[at]
    now = score.argmax(axis=1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        label[at] = now[:m]
        if t:
            now[:m] = back[at, now[:m]]
    return label


def _unpack(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return theta[:_N], theta[_N:].reshape(2, 2)


def decode(lines: Lines, theta: np.ndarray) -> np.ndarray:
    """1 for boilerplate, 0 for content, of each line."""
    content, move = _unpack(theta)
    score = lines.features @ content
    return viterbi(np.stack([score, np.zeros_like(score)], axis=1), lines.first, move)


def likelihood(theta: np.ndarray, x: np.ndarray, real: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Log-likelihood a line, less a penalty, of labels ``y`` (sequences padded; ``real`` marks lines), and its gradient."""
    d, t = real.shape
    content, move = _unpack(theta)
    pair = real[:, 1:]
    steps = np.bincount((2 * y[:, :-1] + y[:, 1:])[pair], minlength=4)
    want = np.concatenate([(x * (real & (y == 0))[:, :, None]).sum((0, 1)), steps])
    emit = np.stack([x @ content, np.zeros((d, t))], axis=2)
    alpha, beta = np.zeros((d, t, 2)), np.zeros((d, t, 2))
    alpha[:, 0] = emit[:, 0]
    for i in range(1, t):
        nxt = emit[:, i] + np.logaddexp(alpha[:, i - 1, 0, None] + move[0], alpha[:, i - 1, 1, None] + move[1])
        alpha[:, i] = np.where(real[:, i, None], nxt, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        ahead = emit[:, i + 1] + beta[:, i + 1]
        nxt = np.logaddexp(ahead[:, 0, None] + move[:, 0], ahead[:, 1, None] + move[:, 1])
        beta[:, i] = np.where(real[:, i + 1, None], nxt, 0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    one = np.exp(alpha[:, :, 0] + beta[:, :, 0] - total[:, None]) * real
    two = np.exp(alpha[:, :-1, :, None] + move + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]) * pair[:, :, None, None]
    scale = real.sum()
    gradient = (want - np.concatenate([np.einsum("dt,dtf->f", one, x), two.sum((0, 1)).ravel()])) / scale - decay * theta
    return float((want @ theta - total.sum()) / scale - decay * (theta @ theta) / 2), gradient


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray, start: np.ndarray | None = None, rounds: int = 80, decay: float = 1e-3, moves: bool = True) -> np.ndarray:
    """CRF weights from line sequences with labels (0 content, 1 boilerplate) by gradient ascent (Adam); ``moves`` False keeps weights for neighbours as they are."""
    n = np.diff(first)
    real = np.arange(int(n.max())) < n[:, None]
    x, y = np.zeros((*real.shape, _N)), np.zeros(real.shape, int)
    x[real], y[real] = features, labels
    theta = np.zeros(_N + 4) if start is None else start
    m, v = np.zeros(_N + 4), np.zeros(_N + 4)
    for step in range(1, rounds + 1):
        grad = likelihood(theta, x, real, y, decay)[1]
        grad[_N:] *= moves
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def relabel(theta: np.ndarray, features: np.ndarray, first: np.ndarray, words: np.ndarray, doc: np.ndarray, bad: np.ndarray, min_share: float) -> np.ndarray:
    """Best labels of the lines of sequences with which each document (``doc`` of each sequence) has the content share that its label asks for."""
    of = np.repeat(doc, np.diff(first))
    have = np.bincount(of, weights=words, minlength=len(bad))
    content, move = _unpack(theta)
    score, push, step = features @ content, np.zeros(len(bad)), 1.0
    for _ in range(8):
        label = viterbi(np.stack([score + push[of], np.zeros(len(of))], axis=1), first, move)
        share = np.bincount(of, weights=words * (label == 0), minlength=len(bad))
        wrong = (share >= min_share * have) == bad
        if not wrong.any():
            return label
        push[wrong] += np.where(bad[wrong], -step, step)
        step *= 2
    return np.where(wrong[of], bad[of], label).astype(np.int8)


def _runs(n: int, most: int) -> list[tuple[int, int]]:
    """Three runs of lines spread over a text of n lines, ``most`` lines in all; the whole text if it has no more."""
    size = most // 3
    return [(0, n)] if n <= most or not size else [(0, size), ((n - size) // 2, (n - size) // 2 + size), (n - size, n)]


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES, min_share: float = MIN_SHARE, turns: int = 3) -> np.ndarray:
    """CRF weights from the documents that ``labels`` (doc_id, quality) grades.

    The sample is the ``train_docs`` labelled ids of least hash, and of the rows
    of an id that repeats the one whose text has the least hash; labels without
    an id or a grade are left out, and no labelled document gives ``PRIOR``.
    """
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = written(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(part.column("text"))
                packed, words, sizes = [], [], []
                for a, b in zip(lines.first[:-1].tolist(), lines.first[1:].tolist()):
                    spans = [(a + i, a + j) for i, j in _runs(b - a, train_lines)]
                    packed.append(b"".join(np.packbits(lines.features[i:j].astype(bool), axis=1).tobytes() for i, j in spans))
                    words.append([int(w) for i, j in spans for w in lines.words[i:j]])
                    sizes.append([j - i for i, j in spans])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(packed, pa.binary()), pa.array(words, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))], ["doc_id", "quality", "lines", "words", "sizes"])

    used = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    found = used.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, lines binary, words array<bigint>, sizes array<bigint>").toArrow()
    if not found.num_rows:
        return PRIOR
    found = found.sort_by([("doc_id", "ascending")])
    width = (_N + 7) // 8
    features = np.unpackbits(np.frombuffer(b"".join(found.column("lines").to_pylist()), np.uint8).reshape(-1, width), axis=1)[:, :_N].astype(np.float64)
    sizes = found.column("sizes").combine_chunks()
    words = found.column("words").combine_chunks().flatten().to_numpy().astype(float)
    first = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy())])
    doc, bad = np.repeat(np.arange(found.num_rows), sizes.value_lengths().to_numpy()), found.column("quality").to_numpy() == 0
    weights = train(features, first, np.repeat(bad[doc], np.diff(first)), moves=False)
    for _ in range(turns):
        weights = train(features, first, relabel(weights, features, first, words, doc, bad, min_share), weights, 30)
    return weights


SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_lines bigint, n_content_words bigint, line_labels string, kept boolean"


def judge(docs: DataFrame, weights: np.ndarray, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (else doc_id) of each row of ``docs``, and ``SCHEMA``.

    Null and empty texts have no words and one empty line, and fail the base
    rules. ``line_labels`` has a C or a B for each line. Repeated rows each
    return; an empty table gives no rows; other columns are ignored.
    """
    keep = keep or ["doc_id"]
    weights = np.asarray(weights)
    text = f"k{keep.index('text')}" if "text" in keep else "text"  # sent once
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x = Lines(part.column(text))
                bad = decode(x, weights)
                content = sums_by(np.where(bad == 0, x.words, 0), x.first)
                failed = (x.counts < min_words) | (100 * x.repeat_words > 50 * x.counts)
                marks = np.where(bad == 0, 67, 66).astype(np.uint8).tobytes().decode()
                marks = [marks[a:b] for a, b in zip(x.first[:-1], x.first[1:])]
                columns = [x.counts, x.word_chars, x.symbols, x.dup_lines, x.repeat_words, failed, np.diff(x.first), content, marks, ~failed & (content >= min_share * x.counts)]
                yield pa.RecordBatch.from_arrays([part.column(f"k{i}") for i in range(len(keep))] + [pa.array(c) for c in columns], [*(f"k{i}" for i in range(len(keep))), *names])

    types = [docs.schema[c].dataType.simpleString() for c in keep]
    base = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), *([] if "text" in keep else ["text"]))
    found = base.mapInArrow(run, ", ".join(f"k{i} {t}" for i, t in enumerate(types)) + ", " + SCHEMA)
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *names)


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are, even if they are named like ``SCHEMA``'s."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    plain = [f"c{i}" if c in names else c for i, c in enumerate(docs.columns)]
    kept = judge(docs.toDF(*plain), fit(docs, labels), keep=plain).where("kept")
    return kept.select(*plain).toDF(*docs.columns)
