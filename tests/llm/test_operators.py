"""The operators against brute force, round trips and held-out rows, and on null, empty, repeated and clashing rows."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from graphloom.llm import chat_format, decontaminate, html_extract, line_dedup, quality_classifier, quality_rules, registry, sentencepiece_codec, simhash, textbytes, token_files, url_filter
from graphloom.llm.components import connected_components

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, short, long and repeated texts, a null id, and columns named like the operators' own."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    texts = [None, "", "  \n\t ", "One", "a b", "Ünï cödé 😀 text", long, "same line\nsame line\nother", "same line\nsame line\nother", "the cat sat on the mat and then it went away"]
    rows = [(i, t, "k", True, 1) for i, t in enumerate(texts)] + [(3, "One", "k", True, 1), (None, "no id here", "k", False, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, kept boolean, n_words int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def print_of(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_simhash_equals_brute_force(docs, odd):
    for table in (docs, odd.where("doc_id is not null")):
        rows = table.select("doc_id", "text").collect()
        want, sets = {r.doc_id: print_of(r.text) for r in rows}, Sets()
        ids = sorted(want)
        for i, a in enumerate(ids):
            for b in ids[:i]:
                if (want[a] ^ want[b]).bit_count() <= 3:
                    sets.join(a, b)
        got = simhash.near_duplicates(table).collect()
        assert len(got) == len(rows)
        assert all((r.fingerprint & (1 << 64) - 1, r.component) == (want[r.id], sets.find(r.id)) for r in got)


@pytest.mark.parametrize("limit", [20_000, 40])
def test_links_of_dense_fingerprints(spark, limit):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fingerprint bigint"), group_limit=limit)
    got = {r.id: r.root for r in connected_components(links).collect()}
    sets = Sets()
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                sets.join(signed[i], signed[j])
    assert all(got.get(s, s) == sets.find(s) for s in signed)


def test_drop_near_duplicates_keeps_one_of_each(odd):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 3, 4, 5, 6, 7, 9]
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0
    again = odd.where("doc_id = 6 or doc_id = 9").withColumn("doc_id", F.lit(7).cast("long")).unionByName(odd).unionByName(odd).withColumnRenamed("doc_id", "row_key")
    kept = simhash.drop_near_duplicates(again, id_col="row_key")  # ids that several texts share, under another name
    assert kept.columns == again.columns
    texts = lambda df: sorted(r.text or "" for r in df.select("text").collect())
    assert texts(kept) == texts(simhash.drop_near_duplicates(odd)) and kept.where("row_key = 7").count() == 2
    other = odd.where("doc_id = 5").withColumn("doc_id", F.lit(4).cast("long")).unionByName(odd.where("doc_id = 4"))
    assert simhash.drop_near_duplicates(other).count() == 2


def contaminated_by_hand(rows, items):
    windows = {}
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    out = {}
    for doc, text in rows:
        words, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        out[doc, text] = (len(words), len(hit), sorted(found))
    return out


def test_decontamination_equals_brute_force(spark, docs, odd):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    short = spark.createDataFrame([(900, "The CAT sat"), (901, "mat"), (902, None), (903, ""), (904, "a a a a"), (905, "the cat sat on the mat and then it went away")], bench.schema)
    items = bench.unionByName(short)
    repeats = spark.createDataFrame([(50, "a a a a a b the cat sat! on a mat"), (51, "x " * 40)], "doc_id bigint, text string")
    for table in (docs.select("doc_id", "text"), odd.select("doc_id", "text").unionByName(repeats)):
        want = contaminated_by_hand([tuple(r) for r in table.collect()], [tuple(r) for r in items.collect()])
        text = {(r.doc_id, r.row_key): r.text for r in table.withColumn("row_key", F.xxhash64("doc_id", "text")).collect()}
        got = decontaminate.contamination(table, items).collect()
        assert len(got) == table.count()
        for r in got:
            assert (r.n_words, r.n_hit, r.items) == want[r.id, text[r.id, r.row_key]]
            assert sum(s.end - s.start for s in r.spans) == r.n_hit
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(odd.limit(0), items).count() == 0
    null = spark.createDataFrame([(None, "the cat sat on the mat and then")], bench.schema)
    got = decontaminate.contamination(odd, null).where("n_hit > 0").collect()
    assert [(r.id, r.n_hit, r.items) for r in got] == [(9, 8, [])]


def test_quality_counts_equal_brute_force(docs, odd):
    for table in (docs, odd):
        got = quality_rules.judge(table, quality_rules.PRIOR, keep=["text"]).collect()
        for r in got:
            text = r.text or ""
            words, seen, dup = WORD.findall(text), set(), 0
            for line in text.split("\n"):
                if WORD.search(line):
                    dup += line in seen
                    seen.add(line)
            times, cover = collections.Counter(zip(words, words[1:], words[2:])), set()
            for i in range(len(words) - 2):
                if times[tuple(words[i : i + 3])] > 1:
                    cover.update((i, i + 1, i + 2))
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover))
            assert r.n_lines == text.count("\n") + 1 == len(r.line_labels)
            assert r.base_failed == (len(words) < 50 or 100 * len(cover) > 50 * len(words))


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(1)
    sizes = [1, 5, 0, 7, 3]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emit, move = rng.normal(size=(first[-1], 2)), rng.normal(size=(2, 2))
    got = quality_rules.viterbi(emit, first, move)
    for a, b in zip(first, first[1:]):
        n = b - a
        total = lambda y: sum(emit[a + i, y[i]] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1))
        every = [[m >> i & 1 for i in range(n)] for m in range(1 << n)]
        assert n == 0 or total(list(got[a:b])) == pytest.approx(max(map(total, every)))


def test_rules_and_classifier_on_labelled_rows(spark, docs, odd):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    train, test = labels.where("doc_id % 4 != 0"), labels.where("doc_id % 4 = 0").toPandas().set_index("doc_id")
    weights = quality_rules.fit(more, train)
    kept = quality_rules.judge(more, weights).toPandas().set_index("doc_id").loc[test.index]
    good = (test.quality == 1) & ~kept.base_failed
    assert kept.kept[good].mean() > 0.97 and kept.kept[test.quality == 0].mean() < 0.1
    dropped = quality_rules.drop_rejected(odd, train)
    assert dropped.columns == odd.columns and dropped.dtypes == odd.dtypes
    model = quality_classifier.fit(more, train)
    assert (np.diff(model.thresholds) > 0).all()
    scored = quality_classifier.score(more, model).toPandas().set_index("doc_id").loc[test.index]
    assert scored.kept[(test.quality == 1) & (test.toxic == 0)].mean() > 0.95 and scored.kept[test.quality == 0].mean() < 0.2
    assert quality_classifier.score(odd, model).count() == odd.count()
    assert quality_classifier.score(odd, quality_classifier.fit(more, train.limit(0))).where("not kept").count() == 0
    assert quality_rules.judge(odd.limit(0), weights).count() == 0


def near(a, b):
    if a == b or 5 > max(len(a), len(b)) or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def lines_by_hand(rows):
    lines, sets = sorted({x for _, t in rows for x in (t or "").split("\n") if WORD.search(x)}), Sets()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if near(a, b):
                sets.join(a, b)
    seen, out = set(), {}
    for doc, text in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            if WORD.search(line):
                if sets.find(line) in seen:
                    continue
                seen.add(sets.find(line))
            kept.append(line)
        out[doc] = None if text is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("hot", [64, 1])
def test_line_dedup_equals_brute_force(spark, hot):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)) + "z" for n in (3, 4, 5, 9, 20, 21, 60)]

    def edited(x):
        i, how = rng.randrange(len(x)), rng.randrange(3)
        return x[:i] + ("q" if how else "") + x[i + (how != 1) :]

    rows = [(i, "\n".join(edited(b) if rng.random() < 0.6 else b for b in rng.sample(base, 4)) + rng.choice(["", "\n\n", "\n \nend"])) for i in range(60)]
    rows += [(90, None), (91, "")]
    table = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id bigint, text string, h1 string, pos int").repartition(3)
    got = line_dedup.drop_lines(table, hot_limit=hot)
    assert got.columns == table.columns
    assert {r.doc_id: r.text for r in got.collect()} == lines_by_hand(rows)


def test_line_dedup_with_two_edits_and_odd_rows(spark, odd):
    table = spark.createDataFrame([(1, "a long enough line"), (2, "a lonk enouxh line"), (3, "a lokk enouxh lime")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(table, threshold=2).collect()}
    assert got == {1: "a long enough line", 2: "", 3: ""}
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(table).collect()} == {r.doc_id: r.text for r in table.collect()}
    left = line_dedup.drop_lines(odd, counts=True)
    assert left.count() == odd.count() and left.where("doc_id = 8 and text = '' and n_dropped = 3").count() == 1
    assert left.where("doc_id = 7").first().text == "same line\nother"
    assert line_dedup.drop_lines(odd.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
    return row[-1]


@pytest.mark.parametrize("hot", [64, 2])
def test_one_edit_links_lines_that_share_a_sentence_with_many(spark, hot):
    """Pairs whose other segments changed, lost a full stop or were cut elsewhere, in groups of any size."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9)))
    sentence = lambda k: " ".join(word() for _ in range(k)).capitalize()
    common = "This one sentence is the same in every line of the page"
    rows, pairs = [], []
    for i in range(100):
        k = rnd.choice([1, 1, 1, 2, 4])
        before, after = [sentence(5) for _ in range(k)], [sentence(5) for _ in range(k)]
        line = ". ".join([*before, common, *after]) + "."
        at = [line.index(". "), line.rindex(". ")][i % 2] if i < 60 else rnd.randrange(len(line))
        other = line[:at] + rnd.choice(["", "", "x", line[at] + "x"] if i >= 60 else [""]) + line[at + 1 :]
        rows += [(2 * i, line), (2 * i + 1, other)]
        pairs.append(line != other)
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), hot_limit=hot).collect()}
    assert sum(pairs) > 95 and all(got[2 * i] == rows[2 * i][1] for i in range(100)) and not any(got[2 * i + 1] for i in range(100))


@pytest.mark.parametrize("hot", [64, 1])
def test_one_edit_at_every_length(spark, hot):
    """Lengths on both sides of each step, edits at every place; no line has another within an edit but its own."""
    rnd = random.Random(13)
    rows = []
    for n in range(6, 60):
        line = "".join(rnd.choices("abcdefghij ", k=n - 1)) + "z"
        for at in (0, n // 2 - 1, n // 2, n - 1):
            for kind in range(3):
                base = f"{len(rows):05d}"[::-1] * (n // 5 + 1)
                base = base[:n] if n < 12 else base[: n // 3] + line[n // 3 :]
                other = (base[:at] + base[at + 1 :], base[:at] + "#" + base[at + 1 :], base[:at] + "#" + base[at:])[kind]
                rows += [(len(rows), base), (len(rows) + 1, other)]
    near = lambda x, y: abs(len(x) - len(y)) <= 1 and _distance(x, y) == 1 and max(len(x), len(y)) >= 5
    texts = [t for _, t in rows]
    wanted = {i + 1 for i in range(0, len(rows), 2) if near(texts[i], texts[i + 1])}
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), hot_limit=hot).collect()}
    assert len(wanted) > 600 and not any(got[i] for i in wanted)


def _distance(x, y):
    """0, 1 or 2 for more, of texts that differ by one character in length at most."""
    if x == y:
        return 0
    i = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    return 1 if x[i + 1 :] == y[i + 1 :] or x[i:] == y[i + 1 :] or x[i + 1 :] == y[i:] else 2


@pytest.mark.parametrize("hot", [64, 3])
def test_long_lines_link_within_a_twentieth(spark, hot):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=n)) for n in (9, 20, 45, 90)] + ["".join(rng.choices("的一是不了人我在有他这中大来上", k=120))]

    def changed(x):
        for _ in range(rng.randint(0, len(x) // 16)):
            i = rng.randrange(len(x))
            x = x[:i] + rng.choice(["", "q", "q" + x[i]]) + x[i + 1 :]
        return x

    rows = [(i, changed(base[i % 5])) for i in range(60)]
    sets = Sets()
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if a == rows[j][1] or 20 * edits(a, rows[j][1]) <= max(len(a), len(rows[j][1])) >= 40:
                sets.join(i, j)
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), hot_limit=hot).collect()}
    want = {i: t if sets.find(i) == i else "" for i, t in rows}
    if hot == 64:
        assert got == want
    else:  # lines that share one hot run and nothing else do not meet
        assert all(got[i] == t or want[i] == "" for i, t in rows) and sum(got[i] != want[i] for i, _ in rows) <= 4
    assert sum(t == "" for t in got.values()) > 20


@pytest.mark.parametrize("block", [1024, 7])
def test_links_of_lines_that_share_one_sentence_with_many(spark, monkeypatch, block):
    """Pairs of three edits whose only common segment is in four hundred lines, of which no third one links to both."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rnd = random.Random(14)
    common = "This one sentence is the same in every line of the page, "
    rows = []
    for i in range(200):
        words = ["".join(rnd.choices("bcdfghjklmpqvwxyz", k=5)) for _ in range(8)]
        other = [w[:2] + "#" + w[3:] if j % 3 == 1 else w for j, w in enumerate(words)]
        rows += [(2 * i, common + " ".join(words)), (2 * i + 1, common + " ".join(other))]
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(edits(rows[2 * i][1], rows[2 * i + 1][1]) == 3 for i in range(200))
    assert got == {i: "" if i % 2 else t for i, t in rows}


def test_links_of_very_long_lines_and_of_one_shared_segment(spark):
    """Lines of some 1,700 characters link by a twentieth, up to 85 edits; lines of seventeen segments that share only one link too."""
    rnd = random.Random(16)
    sentence = lambda: " ".join("".join(rnd.choices("bcdfghjklmpqvwxyz", k=5)) for _ in range(6))
    rows, within = [], []
    for n_sentences, changed, each in ((48, 20, 2), (48, 26, 3), (48, 24, 4), (17, 16, 1)):
        sentences = [sentence() for _ in range(n_sentences)]
        other = [s if j >= changed else "#" * each + s[each:] for j, s in enumerate(sentences)]
        rows += [(len(rows), ". ".join(sentences)), (len(rows) + 1, ". ".join(other))]
        within.append(20 * edits(rows[-1][1], rows[-2][1]) <= max(len(rows[-1][1]), len(rows[-2][1])))
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert within == [True, True, False, True]
    assert got == {i: "" if i % 2 and within[i // 2] else t for i, t in rows}


def test_pivots_leave_out_pairs_and_no_link(spark, monkeypatch):
    """Near copies of one line, some at their limit: every link is among the pairs left, each pair is there once, and a pivot leaves fewer."""
    rnd = random.Random(17)
    words, lines = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(40)], []
    for i in range(24):
        changed = rnd.sample(range(40), rnd.choice([1, 1, 2, 6, 8]))
        lines.append(" ".join("#" * 4 + chr(65 + i) if j in changed else w for j, w in enumerate(words)))
    rows = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "h1 bigint, line string, n int")
    counted = [" | ".join(f"shiftleft(bigint(length(line) - length(replace(line, '{c}', ''))), {8 * i})" for i, c in enumerate(some)) for some in line_dedup.COUNTED]
    near = rows.selectExpr("h1", "n", "true as home", *(f"{x} as counted{i}" for i, x in enumerate(counted)), "explode(array(7L, 8L)) as grp")
    tables, pairs = line_dedup.Tables(spark), []
    for pivot_from in (2, 25):
        monkeypatch.setattr(line_dedup, "PIVOT_FROM", pivot_from)
        apart = line_dedup._apart(near, spark.createDataFrame([], "id bigint, root bigint"), tables)
        others = line_dedup._met_in_large_groups(apart, rows.select("h1", "line"), tables).collect()
        pairs.append({(r.a, r.b) for r in others})
        assert len(others) == len(pairs[-1]) and all(r.shared == 1 for r in others)
    links = {(i, j) for j in range(24) for i in range(j) if 20 * edits(lines[i], lines[j]) <= len(lines[i])}
    assert links and links <= pairs[0] < pairs[1]


def test_short_rests_of_two_edits_in_a_large_group(spark):
    rnd = random.Random(15)
    ends = rnd.sample([a + b + c for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvw"], 60)
    rows = [(2 * i, "one beginning " + e * 3) for i, e in enumerate(ends)]
    rows += [(2 * i + 1, t[:-1] + "##") for i, (_, t) in enumerate(rows)]
    want = lines_linked(rows, 2)
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=2, hot_limit=1).collect()}
    assert got == want and sum(t == "" for t in got.values()) >= 60


def lines_linked(rows, threshold):
    sets = Sets()
    for i, a in rows:
        for j, b in rows:
            if j < i and (a == b or edits(a, b) <= threshold and 5 * edits(a, b) <= max(len(a), len(b))):
                sets.join(i, j)
    return {i: t if sets.find(i) == i else "" for i, t in rows}


def test_sentencepiece_round_trip_and_best_score(spark, docs, odd):
    v = registry.piece_vocabulary()
    for table in (docs, odd):
        got = sentencepiece_codec.decode(sentencepiece_codec.encode(table, v, keep_text=True), v)
        assert got.where("decoded != coalesce(text, '')").count() == 0 and got.count() == table.count()
    encoder, decoder = sentencepiece_codec.Encoder(v), sentencepiece_codec.Decoder(v)
    texts = ["  two  spaces ", "tab\tnew\nline\x00", "▁ literal ▁", "日本語のテキスト", "😀é", "x" * 300, "", None, " "]
    ids, first = encoder.encode(texts)
    assert decoder.decode(ids, first).to_pylist() == [t or "" for t in texts]
    score = {p: s for p, s, u in zip(v.pieces, v.scores, v.usable) if u}
    for word in {w for r in docs.limit(40).collect() for w in r.text.split()[:40]}:
        s = "▁" + word
        best = [0.0] + [-1e18] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = best[e - 1] + encoder.byte_score * len(s[e - 1].encode())
            for b in range(max(0, e - 16), e):
                if s[b:e] in score:
                    best[e] = max(best[e], best[b] + score[s[b:e]])
        ids, _ = encoder.encode([word])
        mine = sum(score[v.pieces[i]] if v.pieces[i] in score else encoder.byte_score for i in ids)
        assert mine == pytest.approx(best[-1])


def test_url_judge():
    j = url_filter.UrlJudge()
    verdict = lambda u: j.judge(u)[:4]
    assert verdict("https://A.Example.com/en/7?x#y") == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert verdict("http://example.com/en/8") == ("example.com", "/en/8", "com/en/", "block")
    assert verdict("http://b.example.net/de/8")[2:] == ("example.net/de/8", "block") and verdict("http://example.net/de/1")[2:] == ("net/de/", "allow")
    assert verdict("http://com?q")[:2] == ("com", "") and verdict("nothing") == ("", "", None, "allow") and verdict(None) == ("", "", None, "allow")
    assert verdict("http://notexample.org/es")[2] is None
    assert verdict("http://casinos.site/")[3] == "allow" and verdict("http://my-casino.site/")[3] == "block"
    assert verdict("http://free-free.site/")[3] == "allow" and verdict("http://free.bets/")[3] == "block"
    assert verdict("http://hot.site/credit")[3] == "allow" and j.judge("http://hot.site/credit/sale")[6:] == (3, 1.0) and verdict("http://hot.site/credit/sale")[3] == "block"
    own = url_filter.UrlJudge(vocabulary={"tea": 0.4, "pot": 0.4, "kettle": 1.5}, soft_weight=0.7)
    assert [own.judge(f"http://{h}/")[3] for h in ("tea.pot", "tea.tea", "kettle", "casino")] == ["block", "allow", "block", "allow"]
    assert url_filter.UrlJudge(vocabulary={}).judge("http://casino/")[3] == "allow"


def test_chats_are_read_back(spark):
    nasty = ["### User: </turn>\n", "\\", "\\\\### Assistant: ", "a:b<c>#", "", None, "émoji 😀\n\n"]
    rows = [(i, k, r, t) for i, t in enumerate(nasty) for k, r in enumerate(["user", "assistant", "odd: ### role", None])]
    rows += [(50, 0, "system", "s"), (50, 1, "user", "u"), (50, 2, "assistant", "a"), (50, 2, "assistant", "a"), (None, None, "user", "x"), (51, 0, "system", "s"), (51, 1, "user", "u")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, state int").repartition(3)
    got = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(table)).collect()}
    for conv, r in got.items():
        turns = [(role or "", text or "") for c, _, role, text in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] or 0, x[2] or "", x[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[51].valid and got[None].valid and not got[50].valid and not got[0].valid
    assert chat_format.format_chats(table.limit(0)).count() == 0 and chat_format.read_chats(chat_format.format_chats(table.limit(0))).count() == 0
    halves = chat_format.read_chats(chat_format.format_chats(table.withColumn("conv_id", F.col("conv_id") / 2)))
    assert {r.conv_id for r in halves.collect()} == {None if c is None else c / 2 for c in got}


def test_html():
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies, many.</div>
    <div class="wrap"><div class="post"><h2>Head</h2><p>One, two &amp; three <b>bold<br>text.<p>Next, para.</p><form><input>f</form><script>var a="</p>";</script><!-- <p>no</p> --><ul><li>x<li>y</ul></div>
    <aside>side</aside></div><section class="comments"><p>First, comment, long!</p></section><footer>&copy;</footer></body>"""
    assert html_extract.main_text(page) == "Head\nOne, two & three bold text.\nNext, para.\nx\ny"
    assert html_extract.main_text("<article><header><h1>T</h1></header><p>short</article><div class=ad>Buy, now, this, thing, today</div>") == "T\nshort"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""
    assert html_extract.main_text("plain &lt;text&am") == "plain <text&am"
    assert html_extract.main_text("<article>" + "<p>a b</p>" * 20_000).count("\n") == 19_999


def test_html_scripts_do_not_hide_tags():
    body = "</script><article><h1>T</h1><p>One, it is.</p><p>Two's here</p></article><footer>f</footer>"
    for script in ("for(i=0; i<n; i++) { // don't stop\n}", "<!-- if (a<b) 'x", 'a<b && "'):
        assert html_extract.main_text("<script>" + script + body) == "T\nOne, it is.\nTwo's here"
    assert html_extract.main_text("<p don't>One, two</p><p title='a>b' class=\"x>y\">Don't</p>") == "One, two\nDon't"


def test_html_keeps_articles_in_layout_names_and_beside_the_best():
    m = html_extract.main_text
    assert m('<body><div class="content has-sidebar"><p>One, two, three.</p><p>Four, five.</p></div><div class="sidebar widget-area"><p>Buy</p></div>') == "One, two, three.\nFour, five."
    assert m('<body><div class="post-header"><h1>T</h1></div><div class="post-body"><p>One, two, three, four.</p><p>Five, six, seven.</p></div>') == "T\nOne, two, three, four.\nFive, six, seven."
    assert m('<body><div id="header"><div><h1>T</h1><p>One, two, three, four, five.</p><p>Six, seven, eight.</p></div></div><div>x</div>').startswith("T\nOne")
    assert m("<div><h1>T</h1><div class=body><p>One, two, three, four, five, six, seven, eight.</p><p>Nine, ten.</p></div><ul><li>x<li>y</ul><table><tr><td>z</table><ul><li><a href=/>link</a></ul></div>") == "T\nOne, two, three, four, five, six, seven, eight.\nNine, ten.\nx\ny\nz"
    assert m("<main><p>lead</p></main>" + "<article><p>One, two.</p></article>" * 2) == "lead\nOne, two.\nOne, two."
    assert m('<div class=post><p>Short, text.</p></div><div class="comment-body"><p>A long, long, long comment.</p><p>More, and more.</p></div>') == "Short, text."


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t")], "page_id bigint, url string, html string, text string")
    assert sorted((r.url or "", r.text, r.n_chars) for r in html_extract.extract(pages).collect()) == [("", "", 0), ("u", "a", 1), ("u", "a", 1)]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_token_files(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for n, table in enumerate((docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"]))):
        token_files.write_tokens(table, f"{tmp_path}/{n}", open(path).read())
        start, got = 0, {r.doc_id: r for r in token_files.read_tokens(spark, f"{tmp_path}/{n}", keep_ids=True).collect()}
        for r in sorted(table.collect(), key=lambda r: r.doc_id):
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
            g = got[r.doc_id]
            assert (g.start, g.n_tokens, g.ids_crc32, list(g.ids)) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
            start += len(ids)
    token_files.write_tokens(odd, f"{tmp_path}/odd", open(path).read())  # a null id, and a row that repeats
    got = token_files.read_tokens(spark, f"{tmp_path}/odd").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    named = odd.withColumn("doc_id", F.lit(1.5))
    token_files.write_tokens(named, f"{tmp_path}/named", open(path).read())
    assert token_files.read_tokens(spark, f"{tmp_path}/named").where("doc_id = 1.5").count() == odd.count()
    with pytest.raises(ValueError, match="65536"):
        token_files.encode_blocks(np.array([65536], np.uint32), np.array([1]))
    token_files.write_tokens(docs.limit(0), f"{tmp_path}/none", open(path).read())
    assert token_files.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_looked_up_runs_give_the_ids_of_whole_texts(monkeypatch):
    source = open(public_tokenizers.path("word_bpe_49k.json")).read()
    pick = random.Random(5)
    parts = ["don't", "CAN'T", "'s", "x.", "...", "!?", "12345", "\u00bd", "e\u0301", "\u0301", "\u03a3\u03a3", "\u0130", "\u6f22\u5b57", "\U0001f600", "\ufeffa", "\x00", "\x1c", "\x1f", "a\x1fb", "<|endoftext|>", "<|x|>"]
    gaps = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "", "\u00a0", "\u3000", "\x85", "\u200b"]
    texts = [None, "", " \n", *("".join(pick.choice(parts) + pick.choice(gaps) for _ in range(30)) for _ in range(300))]
    encoder = token_files.TextEncoder(source)
    assert encoder.parted
    expected = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for remember, runs in ((1 << 20, 1 << 17), (40, 50)):  # the second forgets all the time
        monkeypatch.setattr(token_files, "_REMEMBER", remember)
        monkeypatch.setattr(token_files, "_RUNS", runs)
        ids, n = encoder.encode(texts, 2)
        assert n.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]
    keeps_space = json.loads(source)
    keeps_space["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    whole = token_files.TextEncoder(json.dumps(keeps_space))
    assert not whole.parted
    ids, n = whole.encode(["a  b c", None], 2)
    assert ids.tolist() == [*whole.tokenizer.encode("a  b c", add_special_tokens=False).ids, 2, 2]


def test_a_word_is_encoded_once_whatever_its_case_and_punctuation(monkeypatch):
    """Words go to the model alone, once; only other runs go through the library's normaliser and pre-tokens."""
    encoder = token_files.TextEncoder(open(public_tokenizers.path("word_bpe_49k.json")).read())
    asked, library = [], encoder._library
    monkeypatch.setattr(encoder, "_library", lambda runs: (asked.extend(runs), library(runs)))
    texts = ["Word word. WORD!", "tr\u00e8s Tr\u00e8s, \u00f0\u00df\u00ed\u00ff don't x9", None, "\t", "word\n" * 9]
    ids, n = encoder.encode(texts, 2)
    expected = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert n.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]
    assert set(encoder.seen) == {b"word", b".", b"!", "tr\u00e8s".encode(), b",", "\u00f0\u00df\u00ed\u00ff".encode(), b"don't", b"x9"}
    assert sorted(asked) == [b"!", b",", b".", b"don't", b"x9"]


def test_words_and_punctuation_give_the_ids_of_whole_runs():
    source = open(public_tokenizers.path("word_bpe_49k.json")).read()
    pick = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCRSTVL\u00c0\u00dd\u00df\u00e9\u00ff\u0130\u0131\u0149\u0178\u017f\u0192\u01c0\u01c5\u01f1\u0218\u024f"
    tails = "!#$%&*+,./:;<=>?@^_|~-"
    runs = ["".join(pick.choices(letters, k=pick.randint(1, 9))) + "".join(pick.choices(tails, k=pick.randint(0, 3))) for _ in range(4000)]
    runs += ["<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>", "a<|EndOfText|>.", "endoftext|>", "don't.", "IT'S", "a\u0301.", "\u00d7.", "\u4e2d.", "\u2026.", "3.", "."]
    encoder = token_files.TextEncoder(source)
    assert encoder.worded
    ids, n = encoder.encode(runs, 2)
    assert ids.tolist() == [i for r in runs for i in [*encoder.tokenizer.encode(r, add_special_tokens=False).ids, 2]]
    for change in ("case", "token"):
        other = json.loads(source)
        if change == "case":
            other["normalizer"]["normalizers"] = other["normalizer"]["normalizers"][:2]
        else:
            other["added_tokens"].append({**other["added_tokens"][0], "id": 49408, "content": "ab"})
        assert not token_files.TextEncoder(json.dumps(other)).worded


def test_coder_at_its_edges():
    draw = np.random.default_rng(3)
    for ids in (draw.integers(0, 65536, 9000), np.zeros(9000, int), np.full(9000, 65535), draw.integers(0, 3, 9000)):
        sizes = np.array([2048, 1, 2048, 7, 2048, 2048, 800])
        assert (token_files.decode_blocks(token_files.encode_blocks(ids.astype(np.uint32), sizes), sizes) == ids).all()
    assert len(token_files.decode_blocks([], np.zeros(0, np.int64))) == 0


def test_damaged_block_is_found():
    ids = np.arange(3000, dtype=np.uint32) * 7 % 49000
    sizes = np.array([2048, 952])
    data = token_files.encode_blocks(ids, sizes)
    assert (token_files.decode_blocks(data, sizes) == ids).all()
    bad = bytearray(data[0])
    bad[100] ^= 255
    got = token_files.decode_blocks([bytes(bad), data[1]], sizes)
    assert (got[2048:] == ids[2048:]).all() and (got[:2048] != ids[:2048]).any()


def test_words_of_bytes():
    texts = ["Ab c", None, "", "é\tx", "x"]
    w = textbytes.find_words(pa.array(texts), textbytes.NOT_SPACE, textbytes.LOWER)
    assert w.counts.tolist() == [2, 0, 0, 2, 1]
    h = w.hashes()
    assert h[3] == h[4] and len(set(h.tolist())) == 4


def test_pipeline_stages_take_effect(spark):
    sf = DATA
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns and out.count() <= now.count()
        now = out
    assert corpus_pipeline.run(spark, sf).count() == now.count() > 0


def test_pipeline_of_odd_rows_and_of_none(spark):
    """Nulls, repeats, blank texts and columns named like the operators' own go through all stages."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    odd = [(900, None, None, None, None), (901, "", "en", None, 0), (902, " \n\t", "en", "s", 3), (None, "no id", None, "s", 5), (3, "the id of another", "en", "s", 17), (904, "one word " * 30_000, "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns))
    docs = docs.union(docs.where("doc_id in (1, 2, 901)"))  # repeated rows
    clash = ["kept", "h1", "id", "_key", "root", "fingerprint", "n_words", "part", "pos"]
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(clash)})
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, DATA)
            path = common_folder(spark)
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
            assert out.columns == docs.columns and out.count() <= now.count()
            now = out
        last = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
        assert last.count() == now.count() and (empty or now.count() > 20)
        assert now.where("text is null or trim(text) = ''").count() == 0  # such documents have no words


def common_folder(spark):
    from graphloom.sources.shared import new_folder

    return new_folder(spark, "stage")


FOREIGN_NAMES = "post-comments entry-comments sponsored-content reader-comments user-comments comment-thread disqus_thread discussion ad-slot google-ads newsletter-signup related-posts cookie-law-info gdpr-overlay page-footer site-info adSlot relatedPosts promo-box story-comments comments-area sponsoredContent".split()
OWN_NAMES = "ad-hoc share-price comment-on-policy story text article-body load headline lead no-comments has-ads notice-board-history relatedness".split()
STORY = "<p>Some text of the real story, with commas, and more of it, so that it scores well enough to be the best of all parts on this page.</p>"


def test_html_parts_by_what_their_names_say():
    kept = []
    for name in FOREIGN_NAMES + OWN_NAMES:
        page = f'<body><div class="wrapper"><div class="story"><h1>Title</h1>{STORY * 6}</div><div class="{name}"><p>Beside it, a sentence of some length.</p></div></div></body>'
        kept += [name] if "Beside it" in html_extract.main_text(page) else []
        whole = f'<body><div id="{name}"><h1>Title</h1>{STORY * 6}</div><div class="x"><p>Short.</p></div></body>'  # most of the page's prose
        wholly = name in ("comments-area", "comment-thread")  # says nothing but that, so it goes even then
        assert wholly or html_extract.main_text(whole).count("real story") == 6, name
    assert kept == OWN_NAMES


def test_html_articles_in_wrappers_of_their_own():
    page = f'<body><div class="a"><article><h1>One</h1>{STORY * 5}</article></div><div class="b"><article><h2>Two</h2>{STORY * 4}</article></div><div class="c"><article><p>A teaser.</p></article></div><div class="comments"><article>{STORY * 4}</article></div></body>'
    text = html_extract.main_text(page)
    assert text.split("\n")[0] == "One" and "Two" in text and "teaser" not in text and text.count("real story") == 9
