"""Candidate search of the decontamination against brute force, outside Spark."""

from __future__ import annotations

import numpy as np
import pytest

from meterloom.llm import decontaminate as d


def _texts(rng, n, vocabulary):
    words = np.array([f"w{i}" for i in range(vocabulary)])
    return [list(rng.choice(words, rng.integers(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("vocabulary", [4, 40, 4000])
def test_matches_equal_alignment_with_every_item(vocabulary, monkeypatch):
    rng = np.random.default_rng(vocabulary)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(vocabulary)], rng.integers(1, 30)))) for i in range(25)]
    items = d.items_of(rows)
    seeds = d.seeded(items, np.ones(len(items.grams), np.int64))
    for words in _texts(rng, 25, vocabulary):
        for i in rng.integers(0, len(rows), 2):
            copy = rows[i][1].split()
            copy[rng.integers(len(copy))] = "changed"
            at = rng.integers(len(words) + 1)
            words[at:at] = copy
        raw = " ".join(words).encode()
        hashes = d._tokens(raw)[2]
        want = {}
        for k, own in enumerate(items.words):
            score = d.align(own, hashes)[0] / (d.MATCH * len(own))
            if score >= d.THRESHOLD:
                want[k] = score
        whole = d.matches(raw, seeds)
        assert {m[0]: m[1] for m in whole} == want
        monkeypatch.setattr(d, "EXPANDED", 3)
        assert d.matches(raw, seeds) == whole
        monkeypatch.undo()


def test_promising_parts_hold_every_sum():
    rng = np.random.default_rng(3)
    for _ in range(300):
        inside = rng.random(rng.integers(1, 60)) < rng.choice([0.1, 0.4, 0.9])
        span, least = int(rng.integers(1, 20)), float(rng.integers(1, 20))
        parts = d._promising(inside, span, least)
        for i in range(len(inside)):
            for j in range(i + 1, min(len(inside), i + span) + 1):
                if (3 * inside[i:j].sum() - (j - i)) >= least:
                    assert any(a <= i and j <= b for a, b in parts)
        assert all(b < a for (_, b), (a, _) in zip(parts, parts[1:]))
