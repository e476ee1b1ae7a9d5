"""Features of whole words, and risk and slope against sums written out one text at a time."""

from __future__ import annotations

import math
import random

import numpy as np

from meterloom.llm import toxicity

ABUSE, KIND = "你这个人真是又蠢又坏没有人愿意和你说话请你马上离开这里", "你这个人真是又好又善每个人愿意和你说话请你明天再来这里"


def _shares(a: str, b: str) -> float:
    a, b = set(toxicity.features(a.encode()).tolist()), set(toxicity.features(b.encode()).tolist())
    return len(a & b) / len(a | b)


def test_whole_words_tell_texts_apart():
    same = "prefixprefixprefixprefix"
    assert _shares(same + "a" * 10, same + "b" * 10) < 0.75
    assert _shares(ABUSE, KIND) < 0.7 and _shares(ABUSE, ABUSE) == 1
    assert _shares("Word WORD word", "word") == 1 and not len(toxicity.features(b" 12 .,"))
    # a run inside a longer sentence is found wherever it stands
    inner, outer = (set(toxicity.features(t.encode()).tolist()) for t in ("又蠢又坏", "他们说" + "又蠢又坏" + "的话"))
    assert len(inner & outer) >= 5


def test_long_texts_without_spaces():
    whole = toxicity.features((KIND * 40000 + ABUSE).encode())  # 3 MB, one word
    runs = set(toxicity.features(("x" + "又蠢又坏").encode()).tolist()) & set(whole.tolist())
    assert len(runs) >= 5
    assert len(toxicity.features(b"a" * 2_500_000)) >= 4


def test_learns_abuse_without_spaces(corpus, documents):
    def sentence(i, toxic):
        r = random.Random(i)
        filler = "".join(chr(0x4E00 + r.randrange(600)) for _ in range(30))
        return filler[:17] + ("蠢货滚开" if toxic else "") + filler[17:]

    rows = [(i, sentence(i, i % 4 == 0)) for i in range(400)]
    labels = corpus.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(rows), labels)
    new = [(i, sentence(i, i % 4 == 0)) for i in range(1000, 1080)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents(new), model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i, _ in new)
    kept = {r["doc_id"] for r in toxicity.clean(documents(new + new[:2] + [(None, new[0][1]), (None, None)]), model).collect()}
    assert kept == {i for i, _ in new if i % 4} | {None}


def _risk(weights, bias, scales, positives, unlabelled, prior):
    def logit(t):
        return bias + sum(weights[f] * scales[f] for f in t)

    confirmed = prior * sum(math.log1p(math.exp(-logit(t))) for t in positives) / len(positives)
    clean = sum(math.log1p(math.exp(logit(t))) for t in unlabelled) / len(unlabelled)
    return confirmed, clean - prior * sum(math.log1p(math.exp(logit(t))) for t in positives) / len(positives)


def test_risk_and_slope_equal_brute_force():
    r = random.Random(4)
    draw = lambda n, chance: [np.flatnonzero([r.random() < chance for _ in range(6)]) for _ in range(n)]
    positives, unlabelled = draw(12, 0.6) + [np.empty(0, np.int64)], draw(30, 0.2)
    signs = set()
    for case in range(20):
        prior = 0.1 if case % 2 else 0.9
        scales = np.array([r.uniform(0.5, 2) for _ in range(6)])
        weights, bias = np.array([r.uniform(0, 2) for _ in range(6)]), r.uniform(-3, 3)
        args = scales, toxicity.Texts.of(positives), toxicity.Texts.of(unlabelled), prior
        confirmed, clean, slope = toxicity.risk(weights, bias, *args)
        assert np.allclose((confirmed, clean), _risk(weights, bias, scales, positives, unlabelled, prior))
        signs.add(clean < 0)

        def target(w, b):
            first, second = _risk(w, b, scales, positives, unlabelled, prior)
            return -second if clean < 0 else first + second

        for i in range(7):
            step = np.zeros(7)
            step[i] = 1e-5
            change = target(weights + step[:6], bias + step[6]) - target(weights - step[:6], bias - step[6])
            assert abs(change / 2e-5 - slope[i]) < 1e-6
    assert signs == {True, False}


def test_training_lowers_the_risk():
    positives, unlabelled = [np.array([0, 1])] * 20, [np.array([0, 1])] * 10 + [np.array([2])] * 90
    scales = np.ones(3)
    weights, bias = toxicity.train(scales, positives, unlabelled, 0.1)
    start = _risk(np.zeros(3), math.log(0.1 / 0.9), scales, positives, unlabelled, 0.1)
    end = _risk(weights, bias, scales, positives, unlabelled, 0.1)
    assert end[0] + max(0, end[1]) < 0.5 * (start[0] + max(0, start[1]))
    assert weights[2] == 0 and weights[0] > 0
