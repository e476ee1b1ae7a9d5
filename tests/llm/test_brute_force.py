"""Main results against plain versions that know nothing of blocks, hashes of arrays or tasks."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterloom.llm import attribution, fingerprints, neardup, packing, pii, toxicity
from meterloom.llm.queries import QUERIES
from meterloom.llm.tokens import encoder, vocabulary_path

EDGES = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (5, "one"), (None, "null id text"), (6, "é" * 3000)]
LONG = "".join(f"word{i % 9973} né{i % 89} " for i in range(160_000))  # over 2 MB


def text(seed, n=60, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


# ---- fingerprints --------------------------------------------------------------------


def _shingles(t, width=5):
    found = re.findall("[^\x20\x09-\x0d]+", t)
    found = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in found]
    return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


def _hashed(t):
    """Hash of every shingle: each is hashed as a text of its own."""
    return {int(fingerprints.encode(fingerprints.sketch(" ".join(s).encode())), 16) for s in _shingles(t)}


def _sketch(t):
    hashes = sorted(_hashed(t))
    return hashes[: max(sum(h <= (2**64 - 1) // 8 for h in hashes), 32)]


def _likeness(a, b):
    """Share of the smaller one's retained hashes, below the lower threshold, that the other has."""

    def limit(kept):
        if len(kept) < 32:
            return 2**64 - 1
        return max((2**64 - 1) // 8, kept[-1] if len(kept) == 32 else 0)

    low = min(limit(a), limit(b))
    a, b = ({h for h in s if h <= low} for s in (a, b))
    return len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b)


def test_fingerprints_equal_brute_force(documents):
    rows = [(i, text(i % 30, 20 + 45 * (i % 13))) for i in range(60)] + [(90, None), (91, ""), (92, "Ä É one TWO"), (93, LONG[:300_000])]
    got = {r["doc_id"]: r for r in fingerprints.against_next(documents(rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, own), (_, following) in zip(order, order[1:] + order[:1]):
        k = len(own) // 3
        changed = own[: len(own) - k] + following[:k]
        kept, other, beside = _sketch(own), _sketch(changed), _sketch(following)
        assert got[i]["fingerprint"] == "".join(f"{h:016x}" for h in kept)
        assert got[i]["edited_fingerprint"] == "".join(f"{h:016x}" for h in other)
        assert got[i]["near_edited"] == pytest.approx(_likeness(kept, other))
        assert got[i]["near_next"] == pytest.approx(_likeness(kept, beside))


# ---- personal data -------------------------------------------------------------------


def _personal(t):
    """The base spans by the plain patterns of the definition."""
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_base_spans_equal_plain_patterns(corpus, tmp_path):
    r = random.Random(3)
    pieces = ["a.b@c-d.e", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-112", "+49 (30) 1234-567", "é", " ", "-", "0", "x"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randrange(14)))) for i in range(1500)]
    rows += [(9000, None), (9001, ""), (9002, LONG + " mail bob@x.org" + LONG)]
    corpus.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in QUERIES["op6_pii"](corpus, str(tmp_path)).collect():
        own = _personal(dict(rows)[row["doc_id"]] or "")
        assert row["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        kinds = Counter(s.split(":")[0] for s in own.split(",") if s)
        assert [row[f"n_{k}"] for k in pii.BASE] == [kinds[k] for k in pii.BASE]
        assert set(filter(None, own.split(","))) <= set(row["spans"].split(","))


def test_context_is_whole_words():
    assert pii.score("script 10.0.0.1", "ip", 7, 15) == pii.PRIOR["ip"]
    assert pii.score("Ip: 10.0.0.1", "ip", 4, 12) == pii.PRIOR["ip"] + pii.BOOST
    assert not pii.spans("an antisocial remark 123-45-6789 on socialism")
    assert [k for k, *_ in pii.spans("his SOCIAL number 123-45-6789")] == ["ssn"]
    assert [k for k, *_ in pii.spans("123-45-6789 (SSNs)")] == ["ssn"]
    # words cut by the window's edges count for nothing
    far = "antisocial" + " " * (pii.REACH - 6)
    assert not pii.spans(far + "123-45-6789") and not pii.spans("123-45-6789" + " " * (pii.REACH - 6) + "socialist")


# ---- tokens --------------------------------------------------------------------------


def _shortest_pack_first(lengths, size=1024):
    """Filling levels of packs when each length, longest first, goes to the emptiest pack it fits."""
    packs = []
    for n in sorted(lengths, reverse=True):
        free = [i for i, used in enumerate(packs) if used + n <= size]
        if free:
            packs[min(free, key=lambda i: packs[i])] += n
        else:
            packs.append(n)
    return sorted(packs)


def test_packing_equals_brute_force(documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    rows = [(10 + i, text(i, 10 + 29 * i % 900)) for i in range(90)] + EDGES + [(900, LONG)]
    got = packing.pack(documents(rows)).collect()
    pieces = []
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            own = ids[at : at + 1024]
            pieces.append((d or -1, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)), len(ids)))
    assert Counter((r["doc_id"] or -1, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == Counter(pieces)
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert sorted(used.values()) == _shortest_pack_first([p[2] for p in pieces])


def _allocated(ends, sections, rule):
    """Owner and crossings byte by byte."""
    owner = [s for s, (a, b) in enumerate(zip([0, *sections], sections)) for _ in range(b - a)]
    n, crossing, split = [0] * len(sections), [0] * len(sections), [0.0] * len(sections)
    for a, b in zip([0, *ends], ends):
        shares = Counter(owner[a:b])
        best = max(shares, key=lambda s: (shares[s], -s))
        n[{"majority": best, "first": owner[a], "last": owner[b - 1]}[rule]] += 1
        for s, k in shares.items():
            crossing[s] += len(shares) > 1
            split[s] += k / (b - a)
    return n, crossing, split


def test_attribution_equals_brute_force(documents):
    r = random.Random(8)
    texts = ["".join(r.choice(["One. ", "two", "\n", "! x", "é? ", "...", " ", "\n\n ", "😀. "]) for _ in range(r.randrange(1, 60))) for _ in range(40)]
    rows = list(enumerate(texts, 10))
    for rule in attribution.RULES:
        for kind, cut in attribution.SECTIONS.items():
            got = attribution.by_section(documents(rows), kind, rule).orderBy("doc_id", "section").collect()
            for d, t in rows:
                raw, own = t.encode(), [x for x in got if x["doc_id"] == d]
                sections = [int(e) for e in cut(raw)]
                ids = encoder(vocabulary_path()).ids(t)
                n, crossing, split = _allocated([int(e) for e in encoder(vocabulary_path()).ends(ids)], sections, rule)
                assert [x["n_tokens"] for x in own] == n and [x["n_crossing"] for x in own] == crossing
                assert [x["split_tokens"] for x in own] == pytest.approx(split)
                assert [x["end"] for x in own] == [len(raw[:e].decode()) for e in sections]
    long = attribution.by_section(documents([(1, LONG)]), "line").collect()
    assert long[0]["n_tokens"] == long[0]["doc_tokens"] == len(encoder(vocabulary_path()).ids(LONG))


# ---- near duplicates and the pipeline ------------------------------------------------


def test_deduplicated_any_names_and_ids(corpus):
    rows = [("a", text(1), 1, 2, "p"), ("b", text(1), 3, 4, "q"), ("c", text(2), 5, 6, "r"), ("c", text(2), 7, 8, "s"), (None, None, 9, 9, None)]
    docs = corpus.createDataFrame(rows, "doc_id string, text string, _id long, _hash int, `key.row` string")
    for clash in ("whole", "row", "count", "node"):
        docs = docs.withColumn(clash, docs["text"])
    kept = neardup.deduplicated(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["None", "a", "c"]
    assert {r["doc_id"]: r["component_id"] for r in neardup.classes(docs).collect()} == {"a": "a", "b": "a", "c": "c", None: None}


def test_pipeline_equals_its_parts(corpus, tmp_path):
    import corpus_pipeline

    leak = text(77, 25, 5000)
    rows = [(i, text(i, 80, 3000)) for i in range(1, 200)]
    rows += [(1000 + i, text(1000 + i, 40, 3000) + " vile filth scum " * 4 + text(2000 + i, 40, 3000)) for i in range(70)]
    rows += [(260, text(7, 80, 3000)), (261, text(8, 80, 3000) + " tail"), (262, text(262, 40) + " " + leak + " " + text(263, 40))]
    rows += [(263, "mail bob@example.org now"), (264, None), (265, ""), (None, "no id at all")]
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    corpus.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    toxic = [(i, 1, int((i or 0) >= 1000)) for i, _ in rows if i is not None]
    corpus.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = corpus.read.parquet("/root/testdata/sf0.001/benchmark.parquet").schema
    item = [{"string": leak, "bigint": 1, "int": 1}.get(f.dataType.simpleString()) for f in columns]
    corpus.createDataFrame([tuple(item)], columns).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(corpus, str(tmp_path)).collect()
    seen = {r["doc_id"] for r in got}
    assert seen == {i for i, _ in rows if (i or 0) < 1000} - {260, 261, 262}
    for i, t in rows:
        if i in seen and i is not None:
            ids = [*encoder(vocabulary_path()).ids(pii.mask(t or "")), 0]
            own = [r for r in got if r["doc_id"] == i]
            assert [r["doc_tokens"] for r in own] == [len(ids)] and own[0]["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_long_text_scores(corpus, documents):
    model = toxicity.Model(toxicity.features(b"vile")[:1].astype(int), [9.0], -3.0)
    assert [r["score"] > 0.9 for r in toxicity.score(documents([(1, LONG + " vile"), (2, LONG)]), model).orderBy("doc_id").collect()] == [True, False]


def test_order_of_small_blocks(documents):
    rng = random.Random(11)
    ids = [rng.randrange(-500, 500) for _ in range(300)] + [None] * 60
    rows = [(i, None if n % 50 == 0 else text(n % 90, rng.randrange(1, 60))) for n, i in enumerate(ids)]
    for most in (500, 5_000, 10**9):
        got = fingerprints.in_order(documents(rows), most).withColumn("task", F.spark_partition_id()).collect()
        own = [r for r in got if not r["extra"]]
        known = {r["block"] for r in own}
        assert (len(known) > 60) == (most == 500)
        assert all(len({r["block"] for r in got if r["task"] == t}) == 1 for t in {r["task"] for r in got})
        order = sorted(own, key=lambda r: (-r["block"], r["doc_id"] is None, -(r["doc_id"] or 0), r["rank"], r["text"]))
        least = sorted(own, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["rank"], r["text"]))
        assert order == least  # blocks follow the order of ids
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in own) == sorted((i is None, i or 0, t or "") for i, t in rows)
        nexts = {r["block"]: r for r in got if r["extra"]}
        assert set(nexts) == known
        for block in known:
            last = max(k for k, r in enumerate(order) if r["block"] == block)
            after = order[(last + 1) % len(order)]
            assert (nexts[block]["doc_id"], nexts[block]["text"]) == (after["doc_id"], after["text"])
