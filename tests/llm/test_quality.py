"""Line labels of the quality rules and the ordinal classifier: gradients, mixed documents, odd labels."""

import itertools
import random

import numpy as np
import pytest

from graphloom.llm import quality_classifier, quality_rules

SF = "/root/testdata/sf0.1"
GOOD = "The ending was there and an other of the things that heeded then, one by one in the house."
JUNK = "Then$$$ the&&& other*** of%%% an### ending$$$ was&&& there*** and%%% that### heeded$$$ then&&& one***"


def test_likelihood_is_that_of_all_sequences_and_has_its_gradient():
    rng = np.random.default_rng(4)
    n = quality_rules._N
    sizes = np.array([1, 4, 3])
    real = np.arange(4) < sizes[:, None]
    x = rng.integers(0, 2, (3, 4, n)).astype(float) * real[:, :, None]
    y = rng.integers(0, 2, (3, 4))
    theta = rng.normal(size=n + 4)

    def score(d, labels):
        content, move = theta[:n], theta[n:].reshape(2, 2)
        return sum(x[d, i] @ content for i, v in enumerate(labels) if v == 0) + sum(move[a, b] for a, b in zip(labels, labels[1:]))

    every = [np.logaddexp.reduce([score(d, labels) for labels in itertools.product((0, 1), repeat=int(sizes[d]))]) for d in range(3)]
    want = sum(score(d, y[d, : sizes[d]]) - every[d] for d in range(3)) / sizes.sum() - 0.01 * (theta @ theta) / 2
    value, gradient = quality_rules.likelihood(theta, x, real, y, 0.01)
    assert value == pytest.approx(want)
    for i in range(n + 4):
        step = np.eye(n + 4)[i] * 1e-5
        ahead, behind = (quality_rules.likelihood(theta + s, x, real, y, 0.01)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((ahead - behind) / 2e-5, abs=1e-6)


def test_lines_of_mixed_documents_get_their_own_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    weights = quality_rules.fit(docs, labels.where("doc_id % 4 != 0"))
    pick, words = random.Random(2), "the ending was there and other things heeded then one by house in with reason from them often under these".split()
    clean = lambda: " ".join(pick.choices(words, k=14)).capitalize() + "."
    junk = lambda: " ".join(w + pick.choice(["$$$", "&&&", "***"]) for w in pick.choices(words, k=14))
    want = ["CCCBBB" * 2, "CCBBBCC", "B" * 9]
    lines = [[clean() if c == "C" else junk() for c in t] for t in want]
    got = quality_rules.judge(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(lines)], "doc_id bigint, text string"), weights)
    got = {r.doc_id: r for r in got.collect()}
    assert [got[i].line_labels for i in range(3)] == want
    assert got[0].n_content_words == 6 * 14
    assert got[0].kept == (2 * got[0].n_content_words >= got[0].n_words) and not got[2].kept
    bad = labels.where("doc_id % 4 = 0 and quality = 0")
    held = quality_rules.judge(docs.join(bad, "doc_id", "left_semi"), weights).where("n_lines > 1")
    assert held.where("line_labels like '%C%' and line_labels like '%B%'").count() > 0.1 * held.count()


def test_fit_takes_odd_labels_and_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, GOOD), (1, None), (2, JUNK), (2, JUNK), (3, GOOD), (None, JUNK), (4, "\n".join([GOOD] * 200))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 0), (2, None, 1), (3, None, 0), (None, 0, 0), (4, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    weights = quality_rules.fit(docs, labels)
    assert np.isfinite(weights).all()
    assert (quality_rules.fit(docs, labels.limit(0)) == quality_rules.PRIOR).all() and (quality_rules.fit(docs.limit(0), labels) == quality_rules.PRIOR).all()
    model = quality_classifier.fit(docs, labels)
    assert np.isfinite(model.thresholds).all() and quality_classifier.score(docs, model).count() == 7
    assert quality_classifier.score(docs.limit(0), model).count() == 0


def test_runs_of_long_texts_are_spread():
    assert quality_rules._runs(48, 48) == [(0, 48)]
    assert quality_rules._runs(200, 48) == [(0, 16), (92, 108), (184, 200)]


def test_ordinal_likelihood_has_its_gradient():
    rng = np.random.default_rng(7)
    ids, first = rng.integers(0, 6, 40), np.arange(0, 41, 4)
    grade = rng.integers(0, 3, 10)
    rows = np.repeat(np.arange(10), 4)
    p = np.concatenate([rng.normal(size=6), [-0.4, 0.3]])

    def by_hand(p):
        cut = np.array([p[6], p[6] + np.exp(p[7])])
        z = np.array([p[:6][ids[a:b]].sum() for a, b in zip(first, first[1:])])
        upto = lambda k, v: 1.0 if k == 2 else 0.0 if k < 0 else 1 / (1 + np.exp(v - cut[k]))
        return np.mean([np.log(upto(g, v) - upto(g - 1, v)) for g, v in zip(grade, z)]) - 0.02 * (p[:6] @ p[:6]) / 2

    value, gradient = quality_classifier.likelihood(p, 6, ids, rows, grade, 3, 0.02)
    assert value == pytest.approx(by_hand(p))
    for i in range(8):
        step = np.eye(8)[i] * 1e-5
        assert gradient[i] == pytest.approx((by_hand(p + step) - by_hand(p - step)) / 2e-5, abs=1e-6)
