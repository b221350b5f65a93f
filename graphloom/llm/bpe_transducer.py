"""BPE encoding and decoding as streaming transducers of a tokenizer's file.

Encoding reads symbols from left to right and puts out a token once no later
symbol can change it. How many symbols that takes follows from the merge list
alone (:func:`sufficient_lookahead`), so a word of any length is encoded with a
window of that many symbols and a block. Decoding is a state machine from bytes
to text that holds back at most the bytes of one unfinished character.

A text leaves as rows of at most ``PART`` ids, so no row grows with its text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .token_files import _declared

PART = 1 << 16  # ids of a row at most
SLICE = 1 << 16  # characters that are normalised at once
BLOCK = 1 << 10  # symbols that are read at once beyond the lookahead
LONG = 1 << 10  # a pre-token of more characters is never held whole; more than 6
_SHORT = 40  # symbols up to which a search of all pairs is quicker than a heap
_REMEMBER = 1 << 18  # words whose ids a worker keeps
_NEVER = 1 << 60

#: Classes of the declared split pattern below U+0250; other characters are looked up, see ``_Declared.shape``
_LETTER, _DIGIT = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\\x09-\\x0d \x85\xa0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
_RUNS = {True: re.compile(f"[{_LETTER}]+"), False: re.compile(f"[^{_SPACE}{_LETTER}{_DIGIT}]+")}
_HIGH = re.compile("[ɐ-\U0010ffff]")
_GAP = re.compile("[\t-\r ](?=[^\t-\r ]*$)")  # the last white space


def sufficient_lookahead(merges: list[tuple[str, str]], size) -> int | None:
    """How many symbols after a token settle it; None if the list gives no bound.

    Let two words begin with the same symbols, and merge both in the order of
    the rules. They agree up to a border, which moves left only if a rule
    (u, v) joins the token u before the border to the token v behind it in one
    of the words; then it moves by the symbols of u. The next such rule
    (u', v') comes later in the list, and its v' was grown from u to the right:
    u is v' or is met on the way down its first parts, where it was merged no
    earlier than the rule before. So the border moves at most by the largest
    sum over such chains of rules, found in one pass over the list.

    The argument needs each rule's parts to be made by earlier rules and each
    token by one rule; ``size`` gives the symbols of a token.
    """
    made: dict[str, int] = {}
    for rank, (u, v) in enumerate(merges):
        if u + v in made:
            return None
        made[u + v] = rank
    if any(made.get(part, -1) >= rank for rank, rule in enumerate(merges) for part in rule):
        return None
    chains: dict[str, tuple[list[int], list[int]]] = {}  # of each u: ranks of its rules, and the longest chain up to each
    longest = 0
    for rank, (u, v) in enumerate(merges):
        before, token, joined = 0, v, _NEVER
        while True:
            ranks, sums = chains.get(token, ((), ()))
            k = bisect_right(ranks, joined)
            before = max(before, sums[k - 1] if k else 0)
            if token not in made:
                break
            joined = made[token]
            token = merges[joined][0]
        here = size(u) + before
        ranks, sums = chains.setdefault(u, ([], []))
        ranks.append(rank)
        sums.append(max(here, sums[-1] if sums else 0))
        longest = max(longest, here)
    return longest


class Merges:
    """The merge list of a tokenizer's file, over ids."""

    def __init__(self, model: dict):
        odd = {k: model.get(k) for k in ("unk_token", "continuing_subword_prefix", "dropout", "byte_fallback", "ignore_merges") if model.get(k)}
        if model.get("type", "BPE") != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {model.get('type')} {odd}")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[u], self.vocab[v]): r for r, (u, v) in enumerate(rules)}
        self.product = [self.vocab[u + v] for u, v in rules]
        self.length = {i: self._size(t) for t, i in self.vocab.items()}
        self.longest = max(self.length.values(), default=1)
        self.lookahead = sufficient_lookahead(rules, self._size)

    def _size(self, token: str) -> int:
        return len(token) - len(self.end) if self.end and token.endswith(self.end) and token != self.end else len(token)

    def symbol(self, char: str, last: bool) -> int | None:
        return self.vocab.get(char + self.end if last else char)

    def tokens(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges: always the pair of the lowest rank, the leftmost of equal ones."""
        return self._few(list(symbols)) if len(symbols) <= _SHORT else self._many(symbols)

    def _few(self, ids: list[int]) -> list[int]:
        rank = self.rank.get
        ranks = [rank(p, _NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NEVER:
                break
            i = ranks.index(low)
            ids[i] = new = self.product[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((new, ids[i + 1]), _NEVER)
            if i:
                ranks[i - 1] = rank((ids[i - 1], new), _NEVER)
        return ids

    def _many(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        ids, right, left = [*symbols, -1], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or self.rank.get((ids[i], ids[j])) != low:
                continue  # the pair is no longer there
            ids[i], ids[j] = self.product[low], -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a in (left[i], i):
                b = right[a] if a >= 0 else n
                if b < n and (found := self.rank.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (found, a))
        return [x for x in ids[:n] if x >= 0]


class Transducer:
    """Tokens of one word whose symbols come bit by bit.

    Where the last token that settled ends, the rest of the word is a word of
    its own: no merge crosses a border of the result. So only the symbols
    behind it are held, at most the lookahead, a block and one token. A merge
    list without a bound has the word held until its end.
    """

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, []

    def feed(self, symbols: list[int]) -> Iterator[list[int]]:
        ahead = self.merges.lookahead
        for at in range(0, len(symbols), BLOCK):
            self.held += symbols[at : at + BLOCK]
            if ahead is None or len(self.held) < ahead + BLOCK:
                continue
            settled, done = [], 0
            for token in self.merges.tokens(self.held):
                if done + self.merges.length[token] > len(self.held) - ahead:
                    break
                settled.append(token)
                done += self.merges.length[token]
            del self.held[:done]
            yield settled

    def finish(self) -> list[int]:
        out, self.held = self.merges.tokens(self.held), []
        return out


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that a canonical composition joins to one before them, but for combining ones."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    found = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(found | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def _stands_alone(char: str) -> bool:
    """Whether the normal form of a text is that of what is before ``char`` and that of the rest."""
    if char < "\x80":
        return True
    first = unicodedata.normalize("NFD", char)[0]
    return not unicodedata.combining(first) and first not in _joining()


def slices(text: str, size: int = SLICE) -> Iterator[tuple[str, bool]]:
    """``text`` in pieces that can be normalised apart, and whether white space or the text's end ends each.

    A piece has at most ``size`` characters, unless more of them in a row all
    join their neighbours.
    """
    at = 0
    while at < len(text):
        to, whole = at + size, True
        if to < len(text):
            gap = _GAP.search(text[at:to])
            whole = gap is not None
            if whole:
                to = at + gap.end()
            else:
                back = next((c for c in range(to, at, -1) if _stands_alone(text[c])), None)
                to = back or next((c for c in range(to + 1, len(text)) if _stands_alone(text[c])), len(text))
                whole = to >= len(text)
        yield text[at:to], whole
        at = to


class Encoder:
    """Ids of texts, as the tokenizers library gives them without special tokens, truncation and padding.

    Added tokens inside a text are found first. If the file declares the form
    that ``token_files`` looks up runs of, texts are normalised and split in
    slices, and nothing held grows with the text but the text itself. With
    another file each text is normalised and split whole.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        library = Tokenizer.from_str(tokenizer_json)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.merges = Merges(spec["model"])
        self.streamed = _declared(spec)
        added = sorted(spec.get("added_tokens", []), key=lambda t: -len(t["content"]))
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or (t["normalized"] and spec.get("normalizer")) for t in added):
            raise ValueError("added tokens that take in their neighbours are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.marks = re.compile("|".join(re.escape(t) for t in self.added)) if added else None
        self.kinds: dict[int, str] = {}
        self.known: dict[str, bytes] = {}
        chars = byte_chars()
        self.inner, self.outer = ([self.merges.symbol(c, last) for c in chars] for last in (False, True))

    def ids(self, text: str | None) -> Iterator[bytes]:
        """The ids, as little-endian unsigned 32-bit integers, in bits of bounded size."""
        text, at = text or "", 0
        for mark in self.marks.finditer(text) if self.marks else ():
            yield from self._plain(text[at : mark.start()])
            yield _packed([self.added[mark[0]]])
            at = mark.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[bytes]:
        yield from self._in_slices(text) if self.streamed else self._at_once(text)

    def _at_once(self, text: str) -> Iterator[bytes]:
        if not text:
            return
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        words = self.splitter.pre_tokenize_str(text) if self.splitter else [(text, None)]
        yield self._look_up([w for w, _ in words])

    def _of_word(self, word: str) -> list[int | None]:
        """The symbols of a word; those of a text in slices are of its bytes."""
        if self.streamed:
            data = word.encode()
            return [*map(self.inner.__getitem__, data[:-1]), self.outer[data[-1]]]
        return [*(self.merges.symbol(c, False) for c in word[:-1]), self.merges.symbol(word[-1], True)]

    def _symbols(self, symbols: list[int | None]) -> Iterator[bytes]:
        word = Transducer(self.merges)
        for settled in word.feed([s for s in symbols if s is not None]):
            yield _packed(settled)
        yield _packed(word.finish())

    # texts in slices

    def _normal(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if _HIGH.search(text) else text.lower()  # lower characters have no other normal form

    def _shape(self, text: str) -> str:
        """``text`` with one character below U+0250 of the same class for each higher one."""
        if not _HIGH.search(text):
            return text
        for c in set(text):
            if c >= "ɐ" and ord(c) not in self.kinds:
                n = len(self.splitter.pre_tokenize_str(f"a{c}{c}a"))  # a letter makes one word of all, a digit four, white space two
                self.kinds[ord(c)] = {1: "\xe4", 4: "0", 2: " "}.get(n, ".")
        return text.translate(self.kinds)

    def _in_slices(self, text: str) -> Iterator[bytes]:
        carry, going, word = "", None, Transducer(self.merges)  # going: the class of a long word that is not at its end
        for piece, whole in slices(text):
            s = carry + self._normal(piece)
            shape, at, carry = self._shape(s), 0, ""
            if going is not None:
                run = _RUNS[going].match(shape)
                at = run.end() if run else 0
                ended = at < len(s) or whole
                yield from self._long(word, s[:at], ended)
                if not ended:
                    continue
                going = None
            if whole:
                yield self._look_up(_WORDS.findall(s, at) if shape is s else [s[m.start() : m.end()] for m in _WORDS.finditer(shape, at)])
                continue
            done = []
            for m in _WORDS.finditer(shape, at):
                if m.end() <= len(s) - 3 or (m.end() < len(s) and m.end() - m.start() > 3):
                    done.append(s[m.start() : m.end()])
                    continue
                carry = s[m.start() :]  # what comes next may change this word
                break
            yield self._look_up(done)
            if len(carry) > LONG:
                going = _RUNS[True].match(shape[-len(carry) :]) is not None
                yield from self._long(word, carry, False)
                carry = ""
        if going is not None:
            yield from self._long(word, "", True)
        elif carry:
            yield self._look_up(_WORDS.findall(self._shape(carry)) if not _HIGH.search(carry) else [carry[m.start() : m.end()] for m in _WORDS.finditer(self._shape(carry))])

    def _long(self, word: Transducer, text: str, ended: bool) -> Iterator[bytes]:
        """Feeds a long word; its last byte waits, as it is another symbol at the word's end."""
        data = getattr(word, "waiting", b"") + text.encode()
        word.waiting = b"" if ended else data[-1:]
        for settled in word.feed([s for s in map(self.inner.__getitem__, data[:-1]) if s is not None]):
            yield _packed(settled)
        if ended:
            last = [self.outer[b] for b in data[-1:]]
            for settled in word.feed([s for s in last if s is not None]):
                yield _packed(settled)
            yield _packed(word.finish())

    def _look_up(self, words: list[str]) -> bytes:
        """Ids of whole words; those met before are remembered, unless they are long."""
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > _REMEMBER:
            known.clear()
            new = set(words)
        of_word, few = self._of_word, self.merges._few
        for w in new:
            symbols = of_word(w)
            known[w] = _packed(few(symbols)) if len(symbols) <= _SHORT and None not in symbols else b"".join(self._symbols(symbols))
        out = b"".join(map(known.__getitem__, words))
        for w in [w for w in new if len(w) > _SHORT]:
            del known[w]
        return out


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()  # executors are little-endian machines


def byte_chars() -> list[str]:
    """The character for each byte in byte-level vocabularies: itself if it is visible, else the next one from U+0100."""
    seen = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(seen)]
    chars = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class Decoder:
    """Text of ids that come bit by bit: the bytes of each go to a state machine that puts out whole characters.

    A file without a decoder has its tokens joined by spaces. One with a
    byte-level decoder has its tokens' bytes, and what is not UTF-8 is replaced.
    """

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not supported")
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        byte = {c: b for b, c in enumerate(byte_chars())}
        self.gap = b" " if kind is None else b""
        self.pieces = {i: t.encode() if kind is None or not all(c in byte for c in t) else bytes(byte[c] for c in t) for i, t in names.items()}
        self.start()

    def start(self) -> None:
        self.state, self.any = codecs.getincrementaldecoder("utf-8")("replace"), False

    def text(self, ids: list[int], last: bool) -> str:
        """The text that these ids settle; ids that are no tokens have none."""
        try:
            pieces = [self.pieces[i] for i in ids]
        except KeyError:
            pieces = [self.pieces[i] for i in ids if i in self.pieces]
        data = self.gap.join(pieces)
        if self.any and pieces:
            data = self.gap + data
        self.any |= bool(pieces)
        return self.state.decode(data, last)


@lru_cache(maxsize=1)
def _encoder(tokenizer_json: str) -> Encoder:
    """One for the tasks of a worker, which so share the words it remembers."""
    return Encoder(tokenizer_json)


@lru_cache(maxsize=1)
def _decoder(tokenizer_json: str) -> Decoder:
    return Decoder(tokenizer_json)


def encode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, last, ids): the ids of each text, in rows of at most ``PART``.

    A row's parts follow one another, from 0 up to the ``last``, in one task. A
    null or empty text has one part without ids. Repeated rows and repeated or
    null ids are rows like any other. An empty table gives no rows; other
    columns are ignored, whatever their names. Memory of a task: the texts of
    an Arrow batch, ``_REMEMBER`` words, and a few slices.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    key = to_arrow_type(docs.schema[id_col].dataType)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # as large as the tokenizer's file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        rows: list[tuple] = []
        have = 0
        for batch in batches:
            names = batch.column("id")
            for i, text in enumerate(batch.column("text")):
                held, size, part = [], 0, 0
                for some in encoder.ids(text.as_py()):
                    held.append(some)
                    size += len(some)
                    while size >= 4 * PART:
                        data = b"".join(held)
                        rows.append((names[i], part, False, data[: 4 * PART]))
                        held, size, part, have = [data[4 * PART :]], size - 4 * PART, part + 1, have + PART
                        if have >= 16 * PART:
                            yield _parts(rows, key)
                            rows, have = [], 0
                rows.append((names[i], part, True, b"".join(held)))
                have += size // 4 + 64
                if have >= 16 * PART:
                    yield _parts(rows, key)
                    rows, have = [], 0
        yield _parts(rows, key)

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {kind}, part int, last boolean, ids array<int>").withColumnRenamed("id", id_col)


def _parts(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(r[3]) // 4 for r in rows], dtype=np.int64)]).astype(np.int32)
    flat = np.frombuffer(b"".join(r[3] for r in rows), "<i4")
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array([r[0].as_py() for r in rows], key), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.bool_()), ids], ["id", "part", "last", "ids"])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def decode(parts: DataFrame, tokenizer_json: str, id_col: str = "doc_id") -> DataFrame:
    """``parts`` as ``encode`` gives them with a column ``decoded``, the text of each, special tokens kept.

    A character whose bytes two parts share belongs to the later one. Parts
    that do not follow one another are an error: put a table that was shuffled
    in order by id and part first. An empty table gives no rows.
    """
    kind = parts.schema[id_col].dataType.simpleString()
    sent = parts.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, follows = _decoder(sent.value), _Order()
        for batch in batches:
            texts = []
            for name, part, last, ids in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist(), batch.column("last").to_pylist(), _lists(batch.column("ids"))):
                if follows(name, part, last):
                    decoder.start()
                texts.append(decoder.text(ids.tolist(), last))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])
        follows.end()

    base = parts.select(F.col(id_col).alias("id"), "part", "last", "ids")
    return base.mapInArrow(run, f"id {kind}, part int, last boolean, ids array<int>, decoded string").withColumnRenamed("id", id_col)


class _Order:
    """Checks that parts follow one another; says which begin a text."""

    def __init__(self):
        self.open = None

    def __call__(self, name, part: int, last: bool) -> bool:
        if (part == 0) != (self.open is None) or (part and self.open != (name, part - 1)):
            raise ValueError(f"part {part} of {name} does not follow {self.open}")
        self.open = None if last else (name, part)
        return part == 0

    def end(self) -> None:
        if self.open is not None:
            raise ValueError(f"the parts behind {self.open} are missing")


def digests(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text: of its ids, as little-endian unsigned 32-bit integers, and of what they decode to.

    Both transducers run one behind the other on bits of a text's ids, so
    neither its ids nor its decoded text are ever whole. Odd rows are as for
    ``encode``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    key = to_arrow_type(docs.schema[id_col].dataType)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(sent.value), _decoder(sent.value)
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0
                decoder.start()
                for some in encoder.ids(text.as_py()):
                    of_ids.update(some)
                    of_text.update(decoder.text(np.frombuffer(some, "<u4").tolist(), False).encode())
                    n += len(some) // 4
                of_text.update(decoder.text([], True).encode())
                out.append((name, n, of_ids.hexdigest(), of_text.hexdigest()))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (key, pa.int64(), pa.string(), pa.string()))], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
