"""Token-id files: adaptive context-mixing range coding in independent blocks.

A row of a token file holds a run of whole documents in id order: how many ids
each document has, and its ids as blocks of ``BLOCK_IDS``. Every block starts
from the same empty model and carries its own length and CRC-32, so a block can
be read, and its damage found, without any other.

An id is predicted by the ids that last followed the two ids before it (order
2) and the one before it (order 1), each with a count of how often it was
right. Which of the two is right, or else the id's upper three bits, is one
symbol, whose probabilities mix those seen at these counts with those seen at
any (order 0). An id that neither gives goes on with its middle five bits, from
adaptive probabilities after the upper ones, and its low byte. All symbols
drive one 64-bit range coder.

Blocks do not depend on each other, so a task codes thousands side by side:
step t codes id t of every block with the same few numpy operations.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import new_folder

BLOCK_IDS = 2048
ROW_IDS = 8 * BLOCK_IDS
LANES = 4096
END_ID = 2
#: The symbols of the coder are made for ids of 16 bits
MOST_IDS = 1 << 16
#: Runs of text that a worker remembers the ids of, about 200 MB
_REMEMBER = 1 << 20
#: About so many runs of text, of eight bytes each, are looked up together
_RUNS = 1 << 19
_GAPS = re.compile(rb"[ \t-\r]")
_MARK = "\x1f"
#: A run of Latin letters (but U+0130, whose lower case has a mark), then ASCII punctuation (no apostrophe, which may start a suffix)
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u023f]+)([!#$%&*+,./:;<=>?@^_|~-]*)")
#: Kinds of bytes: ASCII white space, of the letters of ``_WORD`` (U+00D7 and U+00F7 too), its punctuation, others
_GAP, _LETTER, _TAIL, _ODD = range(4)
#: Words of these letters are as they are under the normaliser
_SMALL = re.compile(b"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The letter that stands for each byte in a byte-level model: itself if it prints, else the next one from U+0100 on
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_KINDS = np.full(256, _ODD, np.uint8)
for _bytes, _kind in ((b" \t\n\v\f\r", _GAP), (bytes([*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]), _LETTER), (b"!#$%&*+,./:;<=>?@^_|~-", _TAIL)):
    _KINDS[list(_bytes)] = _kind
_KINDS = _KINDS.tobytes()
#: Fixed value: the pre-tokens under which a run can be looked up in parts
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TABLE_BITS = 10
_TABLE = 1 << _TABLE_BITS
_FIRST, _MIDDLE = 10, 32  # symbols: order 2, order 1 or one of 8 upper parts; the middle part
_FIRST_BITS, _MIDDLE_BITS = np.uint64(15), np.uint64(14)
_LOW32 = np.uint64(0xFFFFFFFF)
_U8, _U32 = np.uint64(8), np.uint64(32)


class _Range:
    """One carry-less range coder of 64 bits for each lane; ``data`` None encodes, else decodes its words.

    A lane puts out the upper 32 bits once they are settled. Where its range
    gets below 32 bits before that, the range is cut at the next multiple of
    2^32, which settles them. So a symbol moves a lane by one word at most.
    """

    def __init__(self, lanes: int, room: int, data: np.ndarray | None = None):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.reading = data is not None
        self.words = data.reshape(-1) if self.reading else np.zeros(lanes * room, np.uint32)
        self.base = np.arange(lanes) * room
        self.at = self.base.copy()
        if self.reading:
            self.value = self.words[self.at].astype(np.uint64) << _U32 | self.words[self.at + 1]
            self.at += 2

    def share(self, lanes, bits: np.uint64) -> np.ndarray:
        """Range of one count of 2^bits."""
        return self.range[lanes] >> bits

    def peek(self, lanes, share: np.ndarray, bits: np.uint64) -> np.ndarray:
        return np.minimum((self.value[lanes] - self.low[lanes]) // share, np.uint64((1 << int(bits)) - 1))

    def code(self, lanes, below: np.ndarray, size: np.ndarray, share: np.ndarray) -> None:
        """Narrows the range of ``lanes`` (a slice or indexes) to ``size`` counts from ``below``."""
        low, span = self.low[lanes] + share * below, share * size
        go = np.flatnonzero(((low ^ (low + span)) <= _LOW32) | (span <= _LOW32))
        if len(go):
            l, s = low[go], span[go]
            short = (l ^ (l + s)) > _LOW32
            s[short] = (~l[short] + np.uint64(1)) & _LOW32
            own = go if isinstance(lanes, slice) else lanes[go]
            place = self.at[own]
            if self.reading:
                self.value[own] = self.value[own] << _U32 | self.words.take(place, mode="clip")  # a damaged lane can read on
            else:
                self.words[place] = l >> _U32
            self.at[own] = place + 1
            low[go], span[go] = l << _U32, s << _U32
        self.low[lanes], self.range[lanes] = low, span

    def finish(self) -> list[bytes]:
        """The bytes of each lane."""
        for part in (self.low >> _U32, self.low & _LOW32):
            self.words[self.at] = part
            self.at += 1
        return [self.words[i:j].astype("<u4").tobytes() for i, j in zip(self.base, self.at)]


class _Sums:
    """Adaptive probabilities of a few symbols in each of many contexts, kept as sums before each symbol.

    Each symbol has ``least`` for good; ``one`` more is shared out by what was seen.
    """

    def __init__(self, contexts: int, symbols: int, width: int, one: int, least: int):
        place = np.minimum(np.arange(width), symbols)
        self.upto = np.tile((place * one // symbols + place * least).astype(np.int16), (contexts, 1))
        self.whole = self.upto.view(f"V{2 * width}").reshape(-1)  # a context as one value, which is quicker to put
        self.certain = ((place > np.arange(symbols)[:, None]) * one + place * least).astype(np.int16)

    def learn(self, context, seen: np.ndarray, symbol: np.ndarray, rate: int) -> None:
        """Moves the sums ``seen`` of each context by 2^-rate of the way to its ``symbol``; they stay in order."""
        new = self.certain.take(symbol, axis=0)
        new -= seen
        new >>= rate
        new += seen
        self.whole[context] = new.view(self.whole.dtype).reshape(-1)


def _bounds(upto: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum before each row's symbol, and the symbol's own share."""
    at = np.arange(0, upto.size, upto.shape[1]) + symbol
    flat = upto.reshape(-1)
    below = flat.take(at).astype(np.uint64)
    return below, flat.take(at + 1) - below


def _find(upto: np.ndarray, value: np.ndarray, half: int) -> np.ndarray:
    """The symbol of at most 2 * half in whose share each value falls."""
    flat, first, value = upto.reshape(-1), np.arange(0, upto.size, upto.shape[1]), value.astype(np.uint16)
    at = first.copy()
    while half:
        at += half * (flat.take(at + half) <= value)
        half >>= 1
    return at - first


class _Model:
    """What one lane has seen, for all lanes."""

    def __init__(self, lanes: int):
        self.after1, self.after2 = np.zeros(lanes * _TABLE, np.uint32), np.zeros(lanes * _TABLE, np.uint32)
        one = ((1 << int(_FIRST_BITS)) - _FIRST) // 2
        self.first, self.any_first = _Sums(lanes * 16, _FIRST, 16, one, 0), _Sums(lanes, _FIRST, 16, one, 1)
        self.middle = _Sums(lanes * 8, _MIDDLE, _MIDDLE + 1, (1 << int(_MIDDLE_BITS)) - _MIDDLE, 1)
        self.before1, self.before2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.tables, self.firsts, self.middles = (np.arange(lanes) * n for n in (_TABLE, 16, 8))

    def step(self, coder: _Range, m: int, t: int, ids: np.ndarray | None) -> np.ndarray:
        """Codes id t of each of the first m lanes; ids None reads them."""
        tables, some = self.tables[:m], slice(0, m)
        slow, quick = (min(max(t.bit_length() - back, 2), 6) for back in (2, 4))  # less is learned from each id as more are known
        b1, b2 = self.before1[:m], self.before2[:m]
        slot1 = tables + ((b1 * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TABLE_BITS))
        slot2 = tables + (((b1 * np.uint32(0x85EBCA6B)) ^ (b2 * np.uint32(0xC2B2AE35))) >> np.uint32(32 - _TABLE_BITS))
        e1, e2 = self.after1.take(slot1), self.after2.take(slot2)
        p1, p2 = e1 >> np.uint32(2), e2 >> np.uint32(2)
        known = self.firsts[:m] + ((e2 & np.uint32(3)) * np.uint32(4) + (e1 & np.uint32(3)))
        seen, any_seen = self.first.upto.take(known, axis=0), self.any_first.upto[:m]
        mixed = (seen + any_seen).view(np.uint16)
        share = coder.share(some, _FIRST_BITS)
        if ids is None:
            first = _find(mixed, coder.peek(some, share, _FIRST_BITS), 8)
            out = np.where(first == 0, p2, p1)
        else:
            first, out = np.where(ids == p2, 0, np.where(ids == p1, 1, (ids >> np.uint32(13)) + np.uint32(2))), ids
        coder.code(some, *_bounds(mixed, first), share)
        self.first.learn(known, seen, first, quick)
        self.any_first.learn(some, any_seen, first, slow)
        new = np.flatnonzero(first > 1)
        if len(new):
            # the middle part and, inside its share, the low byte
            x = None if ids is None else ids[new].astype(np.int64)
            upper = first[new] - 2
            context = self.middles.take(new) + upper
            seen = self.middle.upto.take(context, axis=0)
            upto = seen.view(np.uint16)
            share = coder.share(new, _MIDDLE_BITS + _U8)
            value = coder.peek(new, share, _MIDDLE_BITS + _U8) if x is None else None
            middle = _find(upto, value >> _U8, 16) if x is None else x >> 8 & 31
            below, size = _bounds(upto, middle)
            low = (value - (below << _U8)) // size if x is None else (x & 255).astype(np.uint64)
            coder.code(new, (below << _U8) + low * size, size, share)
            self.middle.learn(context, seen, middle, slow)
            if x is None:
                out[new] = upper << 13 | middle << 8 | low.astype(np.int64)
        fresh = out.astype(np.uint32) << np.uint32(2)
        for table, slot, entry in ((self.after1, slot1, e1), (self.after2, slot2, e2)):
            table[slot] = np.where(entry & ~np.uint32(3) == fresh, np.minimum(entry + np.uint32(1), entry | np.uint32(3)), fresh)
        self.before2[:m], self.before1[:m] = b1.copy(), out
        return out


def _left(n: np.ndarray) -> list[int]:
    """How many lanes have an id for each step, of lanes with ``n`` ids in falling order."""
    return np.searchsorted(-n, -np.arange(int(n[0])), "left").tolist()


def encode_blocks(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Payload of each block; block i has the next ``sizes[i]`` of the ids. Ids of ``MOST_IDS`` and more are an error."""
    if len(ids) and int(ids.max()) >= MOST_IDS:
        raise ValueError(f"id {int(ids.max())} does not fit: the coder's ids are below {MOST_IDS}")
    order = np.argsort(-sizes, kind="stable")
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out: list[bytes] = [b""] * len(sizes)
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        n = sizes[lanes]
        coder, model = _Range(len(lanes), 2 * int(n[0]) + 16), _Model(len(lanes))
        steps = np.zeros((len(lanes), int(n[0])), np.uint32)
        for row, i, k in zip(steps, begin[lanes].tolist(), n.tolist()):
            row[:k] = ids[i : i + k]
        steps = np.ascontiguousarray(steps.T)
        for t, m in enumerate(_left(n)):
            model.step(coder, m, t, steps[t, :m])
        for lane, data in zip(lanes.tolist(), coder.finish()):
            out[lane] = data
    return out


def decode_blocks(payloads: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids of all blocks end to end."""
    order = np.argsort(-sizes, kind="stable")
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(begin[-1], np.uint32)
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        n = sizes[lanes]
        room = max(len(payloads[i]) for i in lanes.tolist()) + 16 & ~3
        data = np.frombuffer(b"".join(payloads[i].ljust(room, b"\0") for i in lanes.tolist()), "<u4")
        coder, model = _Range(len(lanes), room // 4, data), _Model(len(lanes))
        steps = np.zeros((int(n[0]), len(lanes)), np.uint32)
        for t, m in enumerate(_left(n)):
            steps[t, :m] = model.step(coder, m, t, None)
        for row, i, k in zip(np.ascontiguousarray(steps.T), begin[lanes].tolist(), n.tolist()):
            out[i : i + k] = row[:k]
    return out


class TextEncoder:
    """Ids of whole texts from a tokenizer file, with an end id after each.

    The tokenizers library encodes every run of characters between ASCII white
    space; runs that come again are looked up. A run of letters and punctuation
    behind them is looked up as those two, in lower case, and new words of
    ``_SMALL`` letters are encoded by the tokenizer's model alone. All give
    the ids of the whole text for a tokenizer whose file declares what follows:
    NFC, white space as spaces, lower case; pre-tokens of letters or of
    punctuation, never of white space; a byte-level model that merges inside a
    pre-token only. NFC joins no character with white space or punctuation, and
    commutes with lower case for the letters of ``_WORD``. Two probes check the
    same on samples. Any other tokenizer gets the whole texts.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model  # kept, as each access makes one anew
        self.seen: dict[bytes, bytes] = {}
        mark = self._ids([_MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.parted = _declared(json.loads(tokenizer_json)) and self.mark is not None and self._parted()
        whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.worded = self.parted and not any(_WORD.fullmatch("a" + t) for t in whole) and self._worded()

    def _parted(self) -> bool:
        """Whether each kind of ASCII white space, before, after and between runs of any kind, changes no id."""
        runs = ["a", "Ab", "word", "7", "42", ".", "!?", "'s", "n't", "\u00e9", "e\u0301", "\u0301x", "\u00df\u03a3", "\u4e2d", "\U0001f600", "\u00a0b", "<|x|>", "\x1c"]
        alone = self._ids(runs)
        for gap in (" ", "\t", "\n", "\x0b", "\x0c", "\r", "  \n"):
            for order in (range(len(runs)), range(len(runs) - 1, -1, -1)):
                if self._ids([gap + gap.join(runs[i] for i in order) + gap])[0] != [x for i in order for x in alone[i]]:
                    return False
        return True

    def _worded(self) -> bool:
        """Whether letters give the ids of their lower case, and those before and of punctuation behind them."""
        words = ["a", "Ab", "WORD", "don", "S", "RE", "stra\u00dfe", "\u00c9TAT", "na\u00efve", "\u0131I", "\u0141\u00f3d\u017a", "\u01c5", "\u024f"]
        tails = [*"!#$%&*+,./:;<=>?@^_|~-", "...", "?!", ".,;:", "$$$", "***", "&&", "--", "|>", "</", "_-"]
        low = [w.encode().lower().decode() for w in words]
        if self._ids(words) != self._ids(low):
            return False
        if any(self._word(w.encode()) != np.array(ids, np.uint32).tobytes() for w, ids in zip(low, self._ids(low)) if _SMALL.fullmatch(w.encode())):
            return False
        end = self._ids(tails)
        return all(self._ids([w + t for t in tails]) == [ids + e for e in end] for w, ids in zip(words, self._ids(low)))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: list[bytes]) -> None:
        """Ids of new runs: words in lower case are a pre-token each, so the model alone has them."""
        rest = runs
        if self.worded:
            rest = []
            for r in runs:
                if r.isalpha() and r.islower() or _SMALL.fullmatch(r):  # most are ASCII, as these methods of bytes ask
                    self.seen[r] = self._word(r)
                else:
                    rest.append(r)
        self._library(rest)

    def _word(self, word: bytes) -> bytes:
        shown = word.decode("latin-1")
        return array("I", [t.id for t in self.model.tokenize(shown if word.isascii() else shown.translate(_BYTES))]).tobytes()

    def _library(self, runs: list[bytes]) -> None:
        """Ids by the library: of many runs in one text, with a mark between that no other run gives."""
        odd = [r for r in runs if _MARK.encode() in r]
        runs = [r for r in runs if _MARK.encode() not in r]
        for r, ids in zip(odd, self._ids([r.decode() for r in odd])):
            self.seen[r] = np.array(ids, np.uint32).tobytes()
        for at in range(0, len(runs), 4096):
            part = runs[at : at + 4096]
            ids = np.array(self._ids([f" {_MARK} ".encode().join(part).decode()])[0], np.uint32)
            cuts = np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]])
            if len(cuts) != len(part) + 1:
                raise ValueError("the tokenizer gives the mark's id for other text")
            flat = ids.tobytes()
            self.seen.update((r, flat[4 * i + 4 : 4 * j]) for r, i, j in zip(part, cuts[:-1].tolist(), cuts[1:].tolist()))

    def _tokens(self, text: bytes) -> tuple[np.ndarray, pa.BinaryArray]:
        """Where the runs of some text begin, those of a word and punctuation as two, and their bytes, such words in lower case."""
        data, kind = np.frombuffer(text, np.uint8), np.frombuffer(bytearray(text.translate(_KINDS)), np.uint8)
        lead = np.flatnonzero((data == 0xC3) | (data == 0xC4))
        lead, after = lead[:-1] if len(lead) and lead[-1] == len(data) - 1 else lead, data.take(lead + 1, mode="clip")
        kind[lead[np.isin(data[lead].astype(np.int32) << 8 | after[: len(lead)], (0xC397, 0xC3B7, 0xC4B0))]] = _ODD
        inside = kind != _GAP
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, end = edge[::2], edge[1::2]
        if self.worded:
            before = np.empty_like(kind)
            before[0], before[1:] = _GAP, kind[:-1]
            odd = kind[first] != _LETTER
            odd[np.searchsorted(first, np.flatnonzero((kind == _ODD) | (kind == _LETTER) & (before == _TAIL)), "right") - 1] = True
            run = lambda at: np.searchsorted(first, at, "right") - 1
            tail = np.flatnonzero((kind == _TAIL) & (before == _LETTER))
            tail = tail[~odd[run(tail)]]
            upper = np.flatnonzero(data - np.uint8(65) < 26)
            data = data.copy()
            data[upper[~odd[run(upper)]]] += 32
            begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
            begins[first] = begins[tail] = ends[end] = ends[tail] = True
            first, end = np.flatnonzero(begins), np.flatnonzero(ends)
        offsets = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32)
        return first, pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])

    def _look_up(self, runs: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs end to end, and how many ids are before each run and in all."""
        held = runs.dictionary_encode()
        _, offsets, data = held.dictionary.buffers()
        cuts, data = np.frombuffer(offsets, np.int32)[: len(held.dictionary) + 1].tolist(), bytes(data or b"")
        words = [data[i:j] for i, j in zip(cuts, cuts[1:])]
        found = list(map(self.seen.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if new:
            if len(self.seen) + len(new) > _REMEMBER:
                self.seen.clear()
            self._learn(new)
            found = [self.seen[w] if ids is None else ids for w, ids in zip(words, found)]
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = held.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(n.take(which))])
        place = np.repeat((np.cumsum(n) - n).take(which) - upto[:-1], np.diff(upto))
        place += np.arange(len(place))
        return np.frombuffer(b"".join(found), np.uint32).take(place), upto

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, ``end_id`` after each, and how many each has."""
        if not self.parted:
            end = np.array([end_id], np.uint32).tobytes()
            found = [np.array(ids, np.uint32).tobytes() + end for ids in self._ids([t or "" for t in texts])]
            n = np.fromiter(map(len, found), np.int64, len(found)) // 4
            return np.frombuffer(b"".join(found), np.uint32), n
        held = [(t or "").encode() for t in texts]
        text_ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
        whole = b"\n".join([*held, b""])
        ids, ends, have, at = [], [], 0, 0
        while at < len(whole):  # in pieces that end at white space, whatever the length of a text
            gap = _GAPS.search(whole, at + 8 * _RUNS)
            to = gap.end() if gap else len(whole)
            first, runs = self._tokens(whole[at:to])
            some, upto = self._look_up(runs)
            here = text_ends[np.searchsorted(text_ends, at, "right") : np.searchsorted(text_ends, to, "right")] - at
            ends.append(have + upto[np.searchsorted(first, here)])
            ids.append(some)
            have, at = have + len(some), to
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ends = np.concatenate(ends)
        return np.insert(np.concatenate(ids), ends, np.uint32(end_id)), np.diff(ends, prepend=0) + 1


def _declared(spec: dict) -> bool:
    """Whether the tokenizer's file has the form under which runs can be looked up."""
    normal, before, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in normal.get("normalizers", [])]
    parts = [(x["type"], x.get("pattern"), x.get("invert"), x.get("use_regex"), x.get("add_prefix_space")) for x in before.get("pretokenizers", [])]
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        and parts == [("Split", {"Regex": _SPLIT}, True, None, None), ("ByteLevel", None, None, False, False)]
        and (model.get("type"), model.get("dropout"), model.get("ignore_merges", False)) == ("BPE", None, False)
        and all(t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    )


@lru_cache(maxsize=1)
def _encoder(tokenizer_json: str) -> TextEncoder:
    """One for the tasks of a worker, which so share what it remembers."""
    return TextEncoder(tokenizer_json)


_FILE = "shard int, local_start bigint, n_ids bigint, docs array<struct<doc_id:{},n:bigint>>, blocks array<struct<n:int,crc:bigint,data:binary>>"


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Writes the ids of all texts, in ascending id order, as a token file (Parquet rows) at ``path``.

    Null and empty texts are the end id alone. A null id comes first, ties go
    by text, and repeated rows are written as often as they come. An empty
    table writes a file without rows. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = to_arrow_type(docs.schema[id_col].dataType)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # as large as the tokenizer's file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, start = _encoder(sent.value), TaskContext.get().partitionId(), 0
        names, held, counts, have = [], [], [], 0

        def flush():
            nonlocal start
            ids, n = np.concatenate(held), np.concatenate(counts)
            total = np.concatenate([[0], np.cumsum(n)])
            cut, rows = 0, []
            while cut < len(n):  # whole documents, one at least
                to = max(cut + 1, int(np.searchsorted(total, total[cut] + ROW_IDS, "right")) - 1)
                rows.append((cut, to))
                cut = to
            sizes = [[min(BLOCK_IDS, total[b] - i) for i in range(total[a], total[b], BLOCK_IDS)] for a, b in rows]
            flat = np.array([s for row in sizes for s in row], np.int64)
            at = np.concatenate([[0], np.cumsum(flat)])
            data = encode_blocks(ids, flat)
            crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(at[:-1], at[1:])]
            docs_out, blocks_out, k = [], [], 0
            for (a, b), row in zip(rows, sizes):
                docs_out.append([{"doc_id": d, "n": int(c)} for d, c in zip(names[a:b], n[a:b])])
                blocks_out.append([{"n": int(s), "crc": crc[k + i], "data": data[k + i]} for i, s in enumerate(row)])
                k += len(row)
            firsts = [start + int(total[a]) for a, _ in rows]
            start += int(total[-1])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(rows), pa.int32()), "local_start": pa.array(firsts, pa.int64()), "n_ids": pa.array([int(total[b] - total[a]) for a, b in rows], pa.int64()), "docs": pa.array(docs_out, _docs(arrow)), "blocks": pa.array(blocks_out, _BLOCKS)})

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, n = encoder.encode(part.column("text").to_pylist(), end_id)
                names += part.column("id").to_pylist()
                held.append(ids)
                counts.append(n)
                have += len(ids)
                if have >= LANES * BLOCK_IDS:
                    yield from flush()
                    names, held, counts, have = [], [], [], 0
        if held:
            yield from flush()

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    base.mapInArrow(run, _FILE.format(kind)).write.parquet(path)


_BLOCKS = pa.list_(pa.struct([("n", pa.int32()), ("crc", pa.int64()), ("data", pa.binary())]))


def _docs(kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([("doc_id", kind), ("n", pa.int64())]))


def read_tokens(spark, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, for ``keep_ids``, ids) of each document of a token file.

    ``start`` counts the ids of all documents before it. A block whose ids do
    not have its checksum is an error that names its row.
    """
    rows = spark.read.parquet(path)
    id_type = rows.schema["docs"].dataType.elementType["doc_id"].dataType
    kind, arrow = id_type.simpleString(), to_arrow_type(id_type)
    shards = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each partition written
    offsets = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("offset"))
    schema = f"shard int, doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LANES // 8):
                yield out(batch.slice(at, LANES // 8))

    def out(part: pa.RecordBatch) -> pa.RecordBatch:
        blocks = part.column("blocks").to_pylist()
        flat = [b for row in blocks for b in row]
        sizes = np.array([b["n"] for b in flat], np.int64)
        ids = decode_blocks([b["data"] for b in flat], sizes)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for b, i, j in zip(flat, at[:-1], at[1:]):
            if zlib.crc32(ids[i:j].astype("<u4").tobytes()) != b["crc"]:
                raise ValueError(f"damaged block of {b['n']} ids in a row of shards {part.column('shard').unique().to_pylist()}")
        docs = [(s, d["doc_id"], d["n"]) for s, row in zip(part.column("shard").to_pylist(), part.column("docs").to_pylist()) for d in row]
        n = np.array([d[2] for d in docs], np.int64)
        ends = np.cumsum(n)
        first = np.concatenate([[0], ends])[:-1] if len(n) else n
        # row starts are known; inside a row documents follow each other
        per_row = part.column("docs").value_lengths().to_numpy()
        row_first = first[np.concatenate([[0], np.cumsum(per_row)])[:-1]]
        start = first + np.repeat(part.column("local_start").to_numpy() - row_first, per_row)
        crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(first, ends)]
        columns = {"shard": pa.array([d[0] for d in docs], pa.int32()), "doc_id": pa.array([d[1] for d in docs], arrow), "start": pa.array(start), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}
        if keep_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(first, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_pydict(columns)

    found = rows.select("shard", "local_start", "docs", "blocks").mapInArrow(run, schema)
    return found.join(offsets, "shard").withColumn("start", F.col("start") + F.col("offset")).drop("shard", "offset")


def new_path(spark) -> str:
    """A path for a new token file in the shared folder."""
    return new_folder(spark, "tokens")
