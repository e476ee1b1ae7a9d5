"""Repeated passages, by relative Lempel-Ziv parsing of documents against indexed blocks.

Every window of 13 words is a place where a factor may begin.  The reference, which is
the corpus itself, is indexed in blocks: each holds a range of hashed windows with the
smallest document of each.  A document is parsed greedily from its first word on: a
factor begins at the first window that a block holds for a smaller document, and goes on
as long as the next window is held for the same source.  Shorter matches are literals.
Where a factor ends, the windows across its boundary are looked up on their own, so the
next factor may overlap the last one and no repeated window is missed.

Three passes over documents dealt into bundles by id, all from one shuffle of the texts:

1. Each bundle sends the seeds of its windows (the least hash of a window's 7-word
   grams, about one for four windows) to the index blocks, once however often they occur
   in the bundle; it learns, as bits, which occur in other bundles.
2. It sends the windows of those seeds, once each with its smallest document here, and
   learns the smallest document anywhere.
3. It parses its documents and returns factors and kept texts.

A passage in a third of all documents is thus one entry of each bundle.  Windows are
equal if they agree in a 64-bit hash, a 64-bit seed and so the index block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import mix, parts, raw_texts, words

#: Words of a window, fixed by the contract.
WINDOW = 13

_SEED = 7
_TASK_CHARS = 16_000_000  # characters of the texts of one task
_BUNDLES = 2  # bundles of a task; each writes to as many index blocks as there are tasks
_NO_ID = np.iinfo(np.int64).max  # rows without id come after all others
_STEP = np.uint64(0x9E3779B97F4A7C15)

_MESSAGE = "bundle int, block int, seeds binary, windows binary, documents binary"
SCHEMA = (
    "doc_id long, n_words long, factors array<struct<start:int,length:int,source:long>>, kept string"
)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


_MESSAGE_ARROW = _schema(_MESSAGE)
_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("factors", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64())]))),
        ("kept", pa.string()),
    ]
)


# ---- a bundle of documents -----------------------------------------------------------


class Bundle(NamedTuple):
    """Windows of some documents in order of id; ``first`` is the smallest document here."""

    ids: np.ndarray  # of documents
    texts: list[bytes]
    doc: np.ndarray  # document of each window
    place: np.ndarray  # its first word
    which: np.ndarray  # number of its distinct window
    window: np.ndarray  # hash of each distinct window
    seed: np.ndarray
    first: np.ndarray  # smallest id that holds it


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each stretch of ``width`` words."""
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _STEP + hashes[k : n + k]
    return mix(out)


def _windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes = words(raw, lower=False)[2]
    if len(hashes) < WINDOW:
        return hashes[:0], hashes[:0]
    grams, many = _rolled(hashes, _SEED), len(hashes) - WINDOW + 1
    seeds = grams[:many].copy()
    for k in range(1, WINDOW - _SEED + 1):
        np.minimum(seeds, grams[k : many + k], out=seeds)
    return _rolled(hashes, WINDOW), seeds


def bundle(table: pa.Table) -> Bundle:
    ids = table["doc_id"].to_pylist()
    number = np.array([_NO_ID if i is None else i for i in ids], np.int64)
    texts = raw_texts(table["text"].combine_chunks())
    # In a fixed order, that all passes number the windows alike.
    order = sorted(range(len(texts)), key=lambda r: (number[r], texts[r]))
    number, texts = number[order], [texts[r] for r in order]
    found = [_windows(raw) for raw in texts]
    sizes = np.array([len(w) for w, _ in found], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    window = np.concatenate([w for w, _ in found] or [np.empty(0, np.uint64)])
    seed = np.concatenate([s for _, s in found] or [np.empty(0, np.uint64)])
    window, at, which = np.unique(window, return_index=True, return_inverse=True)
    return Bundle(number, texts, doc, place, which, window, seed[at], number[doc[at]])


def _by_block(seed: np.ndarray, blocks: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Order by index block, and the stretch of each block in it."""
    block = (seed % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block = block[order]
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(starts[1:], len(block))
    return order, [(int(block[a]), slice(a, b)) for a, b in zip(starts, ends)]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed differences; ascending ones take a byte or two."""
    return zlib.compress(np.diff(values, prepend=0).astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i8"))


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=size).astype(bool)


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(_MESSAGE_ARROW)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _MESSAGE_ARROW)], schema=_MESSAGE_ARROW)


# ---- the three passes ----------------------------------------------------------------


def _send_seeds(blocks: int):
    def send(table: pa.Table) -> pa.Table:
        seeds = np.unique(bundle(table).seed)
        number = table["bundle"][0].as_py()
        order, cuts = _by_block(seeds, blocks)
        return _messages([(number, b, seeds[order[s]].tobytes(), None, None) for b, s in cuts])

    return send


def _answer_seeds(table: pa.Table) -> pa.Table:
    """Which of each bundle's seeds other bundles sent too."""
    sent = [np.frombuffer(x, np.uint64) for x in table["seeds"].to_pylist()]
    _, which, often = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    shared = np.split(often[which] > 1, np.cumsum([len(x) for x in sent])[:-1])
    heads = zip(table["bundle"].to_pylist(), table["block"].to_pylist())
    return _messages([(n, b, _bits(mask), None, None) for (n, b), mask in zip(heads, shared)])


def _asked(own: Bundle, answers: pa.Table, blocks: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Per index block, its answer on seeds and the numbers of the windows to ask about."""
    seeds, number = np.unique(own.seed, return_inverse=True)
    order, cuts = _by_block(seeds, blocks)
    said = dict(zip(answers["block"].to_pylist(), answers["seeds"].to_pylist()))
    shared = np.zeros(len(seeds), bool)
    for block, cut in cuts:
        if block in said:  # a block that was asked about no window answers nothing later
            shared[order[cut]] = _mask(said[block], cut.stop - cut.start)
    asked = np.flatnonzero(shared[number])
    # By smallest document, so that their ids take little room.
    asked = asked[np.lexsort((asked, own.first[asked]))]
    order, cuts = _by_block(own.seed[asked], blocks)
    for block, cut in cuts:
        yield block, said[block], asked[order[cut]]


def _send_windows(blocks: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages([])
        own, number = bundle(table), table["bundle"][0].as_py()
        return _messages(
            [
                (number, block, seeds, own.window[asked].tobytes(), _packed(own.first[asked]))
                for block, seeds, asked in _asked(own, answers, blocks)
            ]
        )

    return send


def _answer_windows(table: pa.Table) -> pa.Table:
    """The windows that a smaller document of another bundle holds, and that document."""
    windows = [np.frombuffer(x, np.uint64) for x in table["windows"].to_pylist()]
    ids = np.concatenate([_unpacked(x) for x in table["documents"].to_pylist()])
    _, which = np.unique(np.concatenate(windows), return_inverse=True)
    least = np.full(int(which.max(initial=-1)) + 1, _NO_ID)
    np.minimum.at(least, which, ids)
    source, cuts = least[which], np.cumsum([len(x) for x in windows])[:-1]
    smaller = np.split(source < ids, cuts)
    heads = zip(table["bundle"].to_pylist(), table["block"].to_pylist(), table["seeds"].to_pylist())
    return _messages(
        [
            (n, b, seeds, _bits(mask), _packed(part[mask]))
            for (n, b, seeds), mask, part in zip(heads, smaller, np.split(source, cuts))
        ]
    )


def factors_of(repeated: np.ndarray, source: np.ndarray) -> list[dict]:
    """Greedy factors of one document from its windows and their smallest documents."""
    at = np.flatnonzero(repeated)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(source[at]) != 0)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    return [
        {"start": int(at[a]), "length": int(at[b] - at[a]) + WINDOW, "source": int(source[at[a]])}
        for a, b in zip(head, last)
    ]


def without(tokens: list[bytes], factors: list[dict]) -> list[bytes]:
    """Words that no factor covers."""
    kept, at = [], 0
    for f in factors:
        kept += tokens[at : f["start"]]
        at = max(at, f["start"] + f["length"])
    return kept + tokens[at:]


def _parse(blocks: int):
    def parse(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _OUT.empty_table()
        own = bundle(table)
        source = own.first.copy()
        said = {b: (w, d) for b, w, d in zip(*(answers[c].to_pylist() for c in ("block", "windows", "documents")))}
        for block, _, asked in _asked(own, answers, blocks):
            mask, ids = said[block]
            source[asked[_mask(mask, len(asked))]] = _unpacked(ids)
        source = source[own.which]
        repeated = source < own.ids[own.doc]
        cuts = np.searchsorted(own.doc, np.arange(len(own.texts) + 1))
        rows = []
        for k, raw in enumerate(own.texts):
            a, b = cuts[k], cuts[k + 1]
            tokens = raw.split()  # bytes split at 0x20 and 0x09-0x0D
            factors = factors_of(repeated[a:b], source[a:b])
            doc_id = None if own.ids[k] == _NO_ID else int(own.ids[k])
            rows.append((doc_id, len(tokens), factors, b" ".join(without(tokens, factors))))
        ids, sizes, factors, kept = zip(*rows)
        kept = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table([pa.array(ids, pa.int64()), sizes, pa.array(factors, _OUT.field(2).type), kept], schema=_OUT)

    return parse


def deduplicated(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, factors, kept)`` of every row of ``docs(doc_id, text)``.

    ``factors`` are the stretches copied from smaller documents, by start; ``source`` is
    the smallest document with each of their windows, and factors of different sources
    may overlap.  ``kept`` are the words outside of factors, joined by one space.

    Null and empty texts have no words and an empty ``kept``.  Rows of one id are no
    sources of each other, so repeated rows are treated alike.  Rows without id come after
    all others and take nothing from each other.  Texts under 13 words lose nothing.  An
    empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    chars = narrow.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = blocks = int(max(parts(spark), chars // _TASK_CHARS))
    bundles = tasks * _BUNDLES
    number = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(bundles))
    dealt = narrow.withColumn("bundle", number.cast("int")).repartition(tasks, "bundle")
    own = dealt.groupBy("bundle")

    def back(answers: DataFrame):
        return own.cogroup(answers.repartition(tasks, "bundle").groupBy("bundle"))

    seeds = own.applyInArrow(_send_seeds(blocks), _MESSAGE)
    seeds = seeds.groupBy("block").applyInArrow(_answer_seeds, _MESSAGE)
    windows = back(seeds).applyInArrow(_send_windows(blocks), _MESSAGE)
    windows = windows.groupBy("block").applyInArrow(_answer_windows, _MESSAGE)
    return back(windows).applyInArrow(_parse(blocks), SCHEMA)
