"""Periodic runs, spelling variants and repeated passages against brute-force versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterloom.llm import periodic, spelling, substrings
from meterloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return sha256(text.encode()).hexdigest()


@pytest.fixture
def table(corpus, tmp_path):
    """Folder whose documents are the given rows, with other columns beside them."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, n long, word string, bundle int"
        data = [(i, t, "en", "s", None, 7, "x", 3) for i, t in rows]
        corpus.createDataFrame(data, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make


def rows_of(corpus, name, folder):
    return [r.asDict() for r in QUERIES[name](corpus, folder).collect()]


def stored():
    table = pq.read_table(f"{SF}/documents.parquet")
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


# ---- periodic runs -------------------------------------------------------------------


def all_runs(w):
    """Every maximal interval of every period, smallest period first."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected_runs(doc_id, text):
    w = WORD.findall(text or "")
    h, n = crc32(b"" if doc_id is None else str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(all_runs(w), key=lambda r: (r[0], r[2]))
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": best[0],
        "length": best[1],
        "period": best[2],
        "exponent_milli": 1000 * best[1] // best[2] if runs else None,
        "runs_sha256": sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        "collapsed_sha256": sha(" ".join(x for k, x in enumerate(w) if k not in gone)),
    }


def test_runs_of_stored_documents(corpus):
    got = {r["doc_id"]: r for r in rows_of(corpus, "op11_periodic_runs", SF)}
    short = [(i, t) for i, t in stored() if len(t) < 6000]
    assert len(got) == len(stored()) and len(short) > 150
    for i, t in short:
        assert got[i] == expected_runs(i, t)
    assert sum(r["n_runs"] > 0 for r in got.values()) > 5


def test_runs_of_edge_cases(corpus, table):
    long = " ".join(["a"] * 30_000 + ["b"])
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "x " * 23), (5, "x " * 24), (6, "a b c d e f g h " * 3),
        (7, "a b c d e f g h i " * 3 + "z"), (8, "ß 日本 " * 20 + "ß"), (8, "ß 日本 " * 20 + "ß"), (None, "q r " * 15),
        (30, "p " * 24 + "x y " * 12), (31, long), (12, "one two three"), (47, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 9),
    ]
    rows += [(i, " ".join(f"v{k}" for k in range(60))) for i in range(100, 140)]  # some are planted
    got = rows_of(corpus, "op11_periodic_runs", table(rows))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["collapsed_sha256"])
    small = [(i, t) for i, t in rows if i != 31]
    assert sorted((r for r in got if r["doc_id"] != 31), key=key) == sorted((expected_runs(i, t) for i, t in small), key=key)
    (big,) = [r for r in got if r["doc_id"] == 31]
    assert (big["n_runs"], big["length"], big["period"]) == (1, 30_000, 1)
    assert big["collapsed_sha256"] == sha("a b")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=9).flatmap(lambda b: st.integers(0, 14).map(lambda k: b * k)), max_size=6))
def test_runs_of_built_texts(pieces):
    words = [str(x).encode() for piece in pieces for x in piece]
    ids = periodic.word_ids(words)
    got = periodic.find_runs(ids, np.zeros(len(ids), np.int64)) if len(ids) else np.empty((3, 0))
    assert sorted((int(s), int(e - s), int(q)) for s, e, q in got.T) == all_runs(words)


def test_runs_of_an_empty_table(corpus, table):
    assert rows_of(corpus, "op11_periodic_runs", table([])) == []


# ---- spelling variants ---------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected_variants(rows):
    counts = Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    holes = defaultdict(set)  # words by themselves and by what one deletion leaves
    for w in counts:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes[k].add(w)
    partners = defaultdict(set)
    for group in holes.values():
        for a in group:
            partners[a] |= {b for b in group if b != a and near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(partners[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(partners[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def variants_of(corpus, folder):
    rows = rows_of(corpus, "op12_spelling_variants", folder)
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows)


def test_variants_of_stored_documents(corpus):
    got, want = variants_of(corpus, SF), expected_variants(stored())
    assert got == want and sum(r[4] > 0 for r in got) > 100


def test_variants_of_edge_cases(corpus, table):
    rng = random.Random(5)
    made = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(400)]
    chain = "casses " * 3 + "cassen " * 6 + "casten " * 14 + "karten " * 50 + "kasten " * 30
    rows = [(1, None), (2, ""), (3, "Ärger ärger Ärger ÄRGER " * 2), (4, chain), (4, chain), (None, chain)]
    rows += [(10 + i, " ".join(rng.choices(made, k=300))) for i in range(20)]
    rows += [(99, "x" * 40_000 + " " + "x" * 40_000 + " " + "x" * 40_000 + " " + ("x" * 39_999 + " ") * 6)]
    assert variants_of(corpus, table(rows)) == expected_variants(rows)


def test_variants_are_the_same_in_tiles(corpus, table, monkeypatch):
    rng = random.Random(6)
    made = sorted({"anfang" + "".join(rng.choice("abc") for _ in range(rng.randrange(3, 6))) for _ in range(200)})
    rows = [(i, " ".join(rng.choices(made, k=400))) for i in range(10)]
    monkeypatch.setattr(spelling, "_TILE", 20)
    assert variants_of(corpus, table(rows)) == expected_variants(rows)


def test_variants_of_an_empty_table(corpus, table):
    assert variants_of(corpus, table([(1, None), (2, "kurz ab")])) == []


# ---- repeated passages ---------------------------------------------------------------


def expected_removal(rows):
    first = {}
    rank = lambda i: float("inf") if i is None else i
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, rank(i)), rank(i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < rank(i) for j in range(13)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


def removal_of(corpus, folder):
    rows = rows_of(corpus, "op13_substring_dedup", folder)
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in rows), key=str)


def test_removal_from_stored_documents(corpus):
    got = removal_of(corpus, SF)
    assert got == expected_removal(stored()) and sum(r[2] for r in got) > 500


def test_removal_of_edge_cases(corpus, table):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n))
    line = text(40)
    rows = [(1, None), (2, ""), (3, "a b c"), (None, line), (None, line), (None, text(20) + " " + line)]
    rows += [(5, text(5) + " " + line), (6, line + " " + text(30)), (6, line + " " + line), (7, line), (7, line)]
    rows += [(20 + i, f"{text(rng.randrange(30))} {line[rng.randrange(40):]}\t{text(30)} Ñandú {line}") for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice("ab") for _ in range(80))) for i in range(40)]
    rows += [(300, text(60_000) + " " + "y" * 300_000 + " " + line), (301, "y" * 300_000 + " " + line)]
    assert removal_of(corpus, table(rows)) == expected_removal(rows)


def test_factors_name_their_source(documents):
    passage = " ".join(f"w{k}" for k in range(30))
    other = " ".join(f"v{k}" for k in range(20))
    rows = [(9, f"start {passage} middle {other} end"), (4, passage), (2, other), (30, passage)]
    got = {r["doc_id"]: r for r in substrings.deduplicated(documents(rows)).collect()}
    assert [tuple(f) for f in got[9]["factors"]] == [(1, 30, 4), (32, 20, 2)]
    assert got[9]["kept"] == "start middle end" and got[30]["kept"] == "" and got[4]["factors"] == []


def test_removal_from_an_empty_table(corpus, table):
    assert removal_of(corpus, table([])) == []
