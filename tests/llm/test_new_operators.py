"""BPE transducer, prefix trie and source divergence against the library, brute force and odd rows."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import bpe_transducer as B
from graphloom.llm import prefix_trie, registry, source_divergence
from graphloom.sources.shared import Tables

ODD = ["a", "b", "th", "e", "'", "s", "ll", "'ll", " ", "\n", "é", "é", "́", "ᄀ", "ᅡ", "ᆨ", "가", "Σ", "İ", "1", "٤", "!", "<|endoftext|>", "<|", "中", "\U0001f600", "\x1c", "　", "\xa0", "\x85", "A", "ing"]


def spec(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("size, long", [(5, 8), (64, 100), (B.SLICE, B.LONG)])
def test_ids_are_the_librarys(monkeypatch, name, size, long):
    monkeypatch.setattr(B, "LONG", long)
    monkeypatch.setattr(B, "BLOCK", 40)
    monkeypatch.setattr(B.slices, "__defaults__", (size,))
    encoder, library, decoder, rnd = B.Encoder(spec(name)), Tokenizer.from_str(spec(name)), B.Decoder(spec(name)), random.Random(size)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + ["".join(rnd.choice("abcdehinrst") for _ in range(n)) for n in (300, 5000)] + ["'" * 3000, "́" * 500, "中" * 3000, "'s" * 900]
    for text in texts:
        encoder.known.clear()
        ids = np.frombuffer(b"".join(encoder.ids(text)), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        cut = rnd.randint(0, len(ids))
        decoder.start()
        assert decoder.text(ids[:cut], False) + decoder.text(ids[cut:], True) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=14), st.text("ab", max_size=120), st.integers(1, 9))
def test_lookahead_settles_tokens_of_any_merge_list(rules, word, step):
    tokens, merges = ["a", "b"], []
    for i, j in rules:  # each joins two tokens made before, to one not made yet
        u, v = tokens[i % len(tokens)], tokens[j % len(tokens)]
        if u + v not in tokens and len(u + v) < 30:
            tokens.append(u + v)
            merges.append((u, v))
    m = B.Merges({"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges})
    assert m.lookahead is not None
    whole = m._few([m.vocab[c] for c in word])
    assert m._many([m.vocab[c] for c in word]) == whole
    for n in range(len(word) + 1):  # tokens that a prefix settles are those of the word
        settled, done = [], 0
        for t in m._few([m.vocab[c] for c in word[:n]]):
            done += m.length[t]
            if done > n - m.lookahead:
                break
            settled.append(t)
        assert settled == whole[: len(settled)]


def test_a_list_without_a_bound_holds_the_word():
    late = B.Merges({"vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, "merges": [("ab", "c"), ("a", "b")]})
    assert late.lookahead is None
    word = B.Transducer(late)
    assert list(word.feed([0, 1, 2] * 2000)) == [] and word.finish() == [4] * 2000


def test_window_stays_constant():
    m = B.Merges(json.loads(spec("word_bpe_49k.json"))["model"])
    word, rnd, most = B.Transducer(m), random.Random(1), 0
    for _ in word.feed([m.vocab[rnd.choice("abcdefghi")] for _ in range(50_000)]):
        most = max(most, len(word.held))
    assert m.lookahead < 200 and most < m.lookahead + B.BLOCK + m.longest


def test_bpe_of_odd_rows_and_long_texts(spark):
    long = " ".join(random.Random(3).choice(["word", "Ünder", "12", "!?"]) for _ in range(150_000))
    rows = [(1, None, 0), (2, "", 0), (2, "Twice", 0), (2, "Twice", 0), (None, "no id", 0), (5, long, 0), (6, "a" * 90_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").withColumn("ids", F.lit(1))
    tokenizer = spec("word_bpe_49k.json")
    parts = B.encode(docs, tokenizer)
    assert parts.where("doc_id = 5").count() > 2 and parts.agg(F.max(F.size("ids"))).first()[0] <= B.PART
    library = Tokenizer.from_str(tokenizer)
    want, pieces = [], []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        pieces.append((i, ids, library.decode(ids, skip_special_tokens=False)))
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(pieces[-1][2].encode()).hexdigest()))
    got = B.digests(docs, tokenizer).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    whole, ids, text = [], [], ""
    for r in B.decode(parts, tokenizer).collect():
        ids, text = (ids if r["part"] else []) + r["ids"], (text if r["part"] else "") + r["decoded"]
        if r["last"]:
            whole.append((r["doc_id"], ids, text))
    assert sorted(map(repr, whole)) == sorted(map(repr, pieces))
    assert B.digests(docs.limit(0), tokenizer).count() == B.decode(B.encode(docs.limit(0), tokenizer), tokenizer).count() == 0
    with pytest.raises(Exception, match="does not follow"):
        B.decode(parts.where("part <> 1"), tokenizer).collect()


def test_op11_is_the_library_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_str(spec("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in registry.op11_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def brute_trie(rows, family=5, most=9):
    turns = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
        if conv is not None:
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, role, tie), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        built[c] = tuple(own.get(c - c % family, [])[:h] + own[c][h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[:-1] == p for q in members if q) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(who) if built[c] == path)
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("width", [None, 8, 64])
def test_trie_is_that_of_brute_force(spark, width):
    rnd = random.Random(8)
    rows = [(c, rnd.choice([None, 0, 1, 2, 3, 4, 5]), rnd.choice(["user", "assistant", None]), rnd.choice(["x", "yé", None, ""])) for c in [*range(60), 101, 12345] for _ in range(rnd.randint(1, 9))]
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(3)]  # copies
    rows += [(None, 0, "user", "no id"), *rows[:10]]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"conv": F.lit(1), "n": F.lit("x")})
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_lists(turns), Tables(spark)), width)
    got = sorted(repr(tuple(r)) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())
    assert got == brute_trie(rows)


def test_trie_of_an_empty_table_and_of_conversations_without_turns(spark):
    turns = spark.createDataFrame([(12, 0, "user", "a")], "conv_id long, turn int, role string, text string")
    assert prefix_trie.trie(prefix_trie.turn_lists(turns.limit(0))).count() == 0
    none = prefix_trie.turn_lists(turns).withColumn("turns", F.slice("turns", 1, 0))
    row = prefix_trie.trie(none).collect()
    assert [tuple(r)[:7] for r in row] == [(12, 0, None, 1, 0, 1, 0)]


def test_a_proven_prefix_is_one_of_its_conversation_only(spark):
    rnd = random.Random(2)
    rows = [(c, t, "user", rnd.choice("abcd")) for c in range(80) for t in range(4)]
    lists = prefix_trie.turn_lists(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    for width in (8, 256, 1 << 14):
        seen = {}
        found = prefix_trie.screened(prefix_trie.paths(lists), width).collect()
        for r in found:
            for d, key in enumerate(zip(r["hi"], r["lo"]), 1):
                seen.setdefault(key, []).append(d < r["tail"])
        assert all(len(v) == 1 or all(v) for v in seen.values())  # what is shared is in no tail
    assert all(len(v) > 1 or not any(v) for v in seen.values())  # a wide sketch proves all that is not


def brute_divergence(rows, least=3, most=200):
    words = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {w[0] for w in words}:
        docs, group, whole = {}, {}, {}
        for _, source, ws in (w for w in words if w[0] == lang):
            group.setdefault(source, {})
            for w in set(ws):
                docs[w] = docs.get(w, 0) + 1
        kept = {w for w, n in docs.items() if n >= least}
        for _, source, ws in (w for w in words if w[0] == lang):
            for w in ws:
                if w in kept:
                    group[source][w] = group[source].get(w, 0) + 1
                    whole[w] = whole.get(w, 0) + 1
        share = lambda c: {w: 1 + 10**9 * (c.get(w, 0) + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in group.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in group:
            pairs = sorted(((sum(f(p[s][w], p[o][w]) for w in kept), o) for o in group if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][w], q[w]), w) for w in kept if group[s].get(w) and p[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", w, v, i) for i, (v, w) in enumerate(terms[:most], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("chunk, sources", [(source_divergence.CHUNK, source_divergence.SOURCES), (7, 2), (1, 1)])
def test_divergence_is_that_of_brute_force(spark, chunk, sources):
    rnd = random.Random(4)
    words = [f"w{c}" for c in "abcdefghij"] + ["The", "THE", "été", "ÉTÉ", "xé", "don't", "中文"] + [f"{a}{b}" for a in "klm" for b in "nopqrstu"]
    rows = [(rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s2", "s3", "ä", None]), " ".join(words[min(int(rnd.expovariate(0.15)), len(words) - 1)] for _ in range(rnd.randint(0, 60)))) for _ in range(120)]
    rows += [("fr", "lonely", "one two"), ("it", "s1", None), ("it", "s2", ""), ("en", "none", "123"), *rows[:5]]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit(1), "n": F.lit(2), "chunk": F.lit("x")})
    found = source_divergence.Audit(docs, chunk=chunk, sources=sources)
    pairs, terms = source_divergence.ranked(found.pairs()), found.terms()
    got = [repr((r["lang"], r["source"], part, r["item"], r["value"], r["rank"])) for part, df in (("pair", pairs), ("term", terms)) for r in df.collect()]
    assert sorted(got) == brute_divergence(rows)
    found.close()


def test_divergence_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert source_divergence.audit(docs).count() == 0


def test_terms_of_a_long_text_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(source_divergence, "_SLICE", 7)
    text = ("Wort wört " * 50 + "x" * 40).encode()
    assert [t for some in source_divergence._terms(text) for t in some if t] == [b"wort", "wört".encode()] * 50 + [b"x" * 40]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=90))
def test_cells_of_bitmaps_and_lists(counts):
    def source(i):
        levels = []
        for n in sorted({c[i] for c in counts} - {0}):
            ids = np.array([at for at, c in enumerate(counts) if c[i] == n])
            dense = n % 2 == 1
            levels.append({"n": n, "dense": dense, "ids": source_divergence._bits(ids, len(counts)).tobytes() if dense else ids.astype("<u4").tobytes()})
        return source_divergence._Counts({"source": str(i), "block": 0, "size": len(counts), "levels": levels, "total": 9, "terms": 9})

    a, b = source(0), source(1)
    found = {}
    for i, j, n in zip(*(x.tolist() for x in a.cells(b))):
        key = ((0, *sorted({c[0] for c in counts} - {0}))[i], (0, *sorted({c[1] for c in counts} - {0}))[j])
        found[key] = found.get(key, 0) + n
    assert {k: n for k, n in found.items() if n} == {k: counts.count(k) for k in set(counts)}
