"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

Texts are cut before each run of spaces, where no piece of the vocabulary can
reach across, and each distinct chunk of a slice is segmented once. Chunks of
one length advance together, a character a step: the hashes of the substrings
that end there probe the sorted keys of the pieces, and the maximum over the
substring lengths stores a backpointer for every chunk. A long chunk without
spaces is first cut wherever no piece holds the two neighbouring characters, as
no piece can reach across. What is longer than ``LONG_CHUNK`` even then probes
all its substrings of a length at once and takes its maxima one by one.

Scores: a unigram model's own log-probabilities (``scores="model"``). The
scores of a BPE model are merge ranks and no probabilities, so by default a
piece of rank r gets the log-probability of Zipf's law, ln(1 / ((r + 2.7) H)).
The result is the best segmentation under these scores, which is not always
the one that replaying BPE merges gives. Characters that are no piece fall
back to bytes. The dummy prefix of the format is added and taken off, so
decoding gives back every text, runs of spaces and control characters included.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import text_bytes

SPACE = "▁"
SLICE_CHARS = 2 << 20
#: Distinct chunks that a task remembers between slices
REMEMBER = 100_000
#: Chunks from this length are cut between characters that no piece joins
CUT_CHUNK = 32
LONG_CHUNK = 1024
_CHUNK = re.compile(" *[^ ]+| +")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _salt(length: int) -> np.uint64:
    return np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))


@dataclass
class Vocabulary:
    """Pieces by id; ``byte_ids[b]`` is the piece of byte b. Its size is that of the model file."""

    pieces: list[str]
    scores: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray

    @staticmethod
    def load(path: str, scores: str = "zipf") -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        own = np.array([m.get_score(i) for i in range(n)])
        usable = np.array([not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)])
        byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if scores == "zipf":
            rank = np.zeros(n)
            rank[np.argsort(-own, kind="stable")] = np.arange(n)
            own = -np.log(rank + 2.7) - np.log(np.sum(1 / (np.arange(n) + 2.7)))
        return Vocabulary(pieces, own, usable, byte_ids)


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v = v
        ids = [i for i in range(len(v.pieces)) if v.usable[i]]
        by_length: dict[int, list[int]] = {}
        for i in ids:
            by_length.setdefault(len(v.pieces[i]), []).append(i)
        keys, own = [], []
        for length, group in by_length.items():
            codes = np.frombuffer("".join(v.pieces[i] for i in group).encode("utf-32-le"), "<u4").reshape(-1, length)
            keys.append(_prefix_sums(codes)[:, -1] + _salt(length))
            own += group
        keys, own = np.concatenate(keys), np.array(own)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], own[order].astype(np.int32), v.scores[own[order]]
        self.lengths = sorted(by_length, reverse=True)
        self.byte_score = float(v.scores[v.usable].min()) - 10.0
        joined = {a << 32 | b for i in ids for a, b in zip(map(ord, v.pieces[i]), map(ord, v.pieces[i][1:]))}
        self.joined = np.array(sorted(joined), np.int64)  # pairs of characters that some piece holds
        self.known: dict[str, bytes] = {}  # ids of a chunk as little-endian 32-bit integers
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_place(self.keys)] = True

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin."""
        chunks: list[str] = []
        counts = []
        for text in texts:
            found = _CHUNK.findall(" " + text) if text else []
            if any(len(c) >= CUT_CHUNK for c in found):
                found = [part for c in found for part in (self._cut(c) if len(c) >= CUT_CHUNK else (c,))]
            chunks += found
            counts.append(len(found))
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = [c for c in dict.fromkeys(chunks) if c not in self.known]
        self._segment(new)
        parts = [self.known[c] for c in chunks]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        total = np.concatenate([[0], np.cumsum(sizes)])
        return np.frombuffer(b"".join(parts), "<i4"), total[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def _cut(self, chunk: str) -> list[str]:
        """The parts of a chunk between neighbours that no piece holds."""
        plain = chunk.replace(SPACE, "\uffff").replace(" ", SPACE)
        codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pairs = codes[:-1] << 32 | codes[1:]
        at = np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)
        cuts = [0, *(np.flatnonzero(self.joined[at] != pairs) + 1).tolist(), len(chunk)]
        return [chunk[a:b] for a, b in zip(cuts, cuts[1:])]

    def _single(self, chunk: str) -> bytes:
        """Ids of one long chunk: the same search, with the probes of a length for all places at once."""
        plain = chunk.replace(SPACE, "\uffff").replace(" ", SPACE)
        n = len(plain)
        codes = np.frombuffer(plain.encode("utf-32-le"), "<u4").reshape(1, n)
        sums = _prefix_sums(codes)[0]
        undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for length in self.lengths:
            if length <= n:
                key = (sums[length:] - sums[:-length]) * undo[: n + 1 - length] + _salt(length)
                begin = np.flatnonzero(self.maybe[_place(key)])
                at = np.minimum(np.searchsorted(self.keys, key[begin]), len(self.keys) - 1)
                real = self.keys[at] == key[begin]
                hits.append((np.stack([begin[real] + length, np.full(real.sum(), length)]), at[real]))
        where, at = np.concatenate([h[0] for h in hits], axis=1), np.concatenate([h[1] for h in hits])
        order = np.argsort(where[0], kind="stable")  # at each end the longest first
        first = np.searchsorted(where[0][order], np.arange(n + 2)).tolist()
        length, score, piece = where[1][order].tolist(), self.scores[at[order]].tolist(), self.ids[at[order]].tolist()
        sizes = [self.byte_score * len(c.encode()) for c in plain]
        best, back, took = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        for e in range(1, n + 1):
            top = best[e - 1] + sizes[e - 1]
            for i in range(first[e], first[e + 1]):
                s = best[e - length[i]] + score[i]
                if s > top:
                    top, back[e], took[e] = s, length[i], piece[i]
            best[e] = top
        out: list[int] = []
        e = n
        while e:
            out += [took[e]] if took[e] >= 0 else self.v.byte_ids[list(chunk[e - 1].encode())[::-1]].tolist()
            e -= back[e]
        return np.array(out[::-1], "<i4").tobytes()

    def _segment(self, chunks: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            n = len(c)
            if n > LONG_CHUNK:
                self.known[c] = self._single(c)
                continue
            room = n if n <= 32 else -(-n // 8) * 8 if n <= 128 else 1 << (n - 1).bit_length()
            by_length.setdefault(room, []).append(c)
        for room, group in by_length.items():
            step = max(1, (1 << 18) // room)
            for at in range(0, len(group), step):
                self._viterbi(group[at : at + step], room)

    def _viterbi(self, group: list[str], room: int) -> None:
        """Segments chunks of ``room`` characters; longer rooms hold several lengths, padded at the end."""
        # a literal lower block is no space: it goes to a character that no piece has
        plain = [c.replace(SPACE, "￿").replace(" ", SPACE) for c in group]
        size = np.array([len(c) for c in plain])
        codes = np.frombuffer("".join(c.ljust(room, "\0") for c in plain).encode("utf-32-le"), "<u4").reshape(len(group), room)
        sums = _prefix_sums(codes)
        undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(room, _INVERSE)]), dtype=np.uint64)
        n_bytes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        best = np.zeros((room + 1, len(group)))
        back = np.ones((room + 1, len(group)), np.int16)
        piece = np.full((room + 1, len(group)), -1, np.int32)
        last = len(self.keys) - 1
        for e in range(1, room + 1):
            top = best[e - 1] + self.byte_score * n_bytes[:, e - 1]
            for length in self.lengths:  # equal scores: the longest piece
                if length > e:
                    continue
                b = e - length
                key = (sums[:, e] - sums[:, b]) * undo[b] + _salt(length)
                hit = np.flatnonzero(self.maybe[_place(key)])  # spares most of the searches
                at = np.minimum(np.searchsorted(self.keys, key[hit]), last)
                real = self.keys[at] == key[hit]
                hit, at = hit[real], at[real]
                if not len(hit):
                    continue
                score = best[b, hit] + self.scores[at]
                better = score > top[hit]
                won = hit[better]
                top[won], back[e, won], piece[e, won] = score[better], length, self.ids[at[better]]
            best[e] = top
        # walk back, all chunks together
        where, rows = size.copy(), np.arange(len(group))
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            p = where[rows]
            taken.append((rows, p, piece[p, rows]))
            where[rows] = p - back[p, rows]
            rows = rows[where[rows] > 0]
        row, end, got = (np.concatenate(x) for x in zip(*taken))
        order = np.lexsort((end, row))
        row, end, got = row[order], end[order], got[order]
        if (got < 0).any():
            texts = [group[r][e - 1].encode() if g < 0 else b"?" for r, e, g in zip(row.tolist(), end.tolist(), got.tolist())]
            times = np.array([len(t) for t in texts])
            flat = np.repeat(got, times)
            flat[flat < 0] = self.v.byte_ids[np.frombuffer(b"".join(t for t, g in zip(texts, got) if g < 0), np.uint8)]
            row, got = np.repeat(row, times), flat
        first = (4 * np.searchsorted(row, np.arange(len(group) + 1))).tolist()
        raw = got.astype("<i4").tobytes()
        for c, a, b in zip(group, first, first[1:]):
            self.known[c] = raw[a:b]


def _place(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64)


def _prefix_sums(codes: np.ndarray) -> np.ndarray:
    n = codes.shape[1]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _BASE)]), dtype=np.uint64)[:n]
    out = np.zeros((codes.shape[0], n + 1), np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power, axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


class Decoder:
    def __init__(self, v: Vocabulary):
        raw = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            raw[i] = bytes([b])
        self.size = np.array([len(r) for r in raw])
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """Texts whose ids are ``ids[first[d]:first[d + 1]]``; no ids are an empty text."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.arange(ends[-1]) + np.repeat(self.begin[ids] - ends[:-1], size)
        data, off = self.data[flat], ends[first]
        keep = np.ones(len(data), bool)
        keep[off[:-1][np.diff(first) > 0]] = False  # the dummy prefix
        kept = np.concatenate([[0], np.cumsum(keep)])
        off = kept[off]
        # bytes that are no UTF-8 (ids that no text encodes to) become replacement characters
        data = data[keep].tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        return pa.array(texts, pa.string())


def _slices(batch: pa.RecordBatch, weights: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    total = np.concatenate([[0], np.cumsum(weights)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, ids, n_tokens, ids_crc32): one row for each row of ``docs``, with the text as well for ``keep_text``.

    Null and empty texts have no ids. ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers. Repeated rows each return; an empty
    table gives no rows; other columns are ignored. Whole texts are encoded.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the model file
    kind = docs.schema[id_col].dataType.simpleString()
    text_out = ", text string" if keep_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            for part in _slices(batch, np.diff(text_bytes(batch.column("text"))[1]), SLICE_CHARS):
                ids, first = encoder.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                raw = ids.astype("<u4")
                crc = pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(first[:-1], first[1:])], pa.int64())
                columns, names = [part.column("id"), lists, pa.array(np.diff(first)), crc], ["id", "ids", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [part.column("text")] * keep_text, names + ["text"] * keep_text)

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens bigint, ids_crc32 bigint{text_out}").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as ``out_col`` in place of the ids; null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    others = [c for c in encoded.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            for part in _slices(batch, np.maximum(batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 1), SLICE_CHARS // 3):
                lists = part.column("ids")
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                out = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), first)
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}") for i in range(len(others))), out], [*(f"k{i}" for i in range(len(others))), "out"])

    base = encoded.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(others)), F.col(ids_col).alias("ids"))
    schema = "".join(f"k{i} {encoded.schema[c].dataType.simpleString()}, " for i, c in enumerate(others))
    return base.mapInArrow(run, f"{schema}out string").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(others)), F.col("out").alias(out_col))
