"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are the query set; it is taken in blocks of bounded size, and each block meets
all documents in two scans without a shuffle of texts.  The first counts in how many
documents each n-gram of the items occurs.  From an item's length follows how many of its
n-grams every alignment of ``THRESHOLD`` leaves intact (see ``intact``); some of the most
frequent are left out, all others that occur are seeds.  The second scan aligns an item
where enough of its seeds lie close together and the item's words, in any order, could
reach the score, so no alignment that reaches the threshold is missed.  Edits and
paraphrases cost alignment score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import PUNCTUATION, batches, code_point_starts, raw_texts, shingles, words

WIDTH = 3  # words of an n-gram at most
THRESHOLD = 0.6
MATCH, MISMATCH, GAP = 2, 1, 1
BLOCK_CHARS = 8_000_000  # characters of test items that one block may hold
EXPANDED = 1 << 20  # places of seeds that a text is held against at once
_BITS = 20


@dataclass
class Items:
    """A block of test items: ids, word hashes, and n-grams (sorted) with their places."""

    ids: list
    words: list[np.ndarray]
    widths: np.ndarray  # words of an item's n-grams
    need: np.ndarray  # n-grams that an alignment has at least
    grams: np.ndarray
    first: np.ndarray  # bounds of an n-gram's places
    item: np.ndarray
    at: np.ndarray

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among a text's words at which an n-gram of the block starts, and which."""
        if not hasattr(self, "_widths"):
            self._widths = [int(w) for w in np.unique(self.widths)]
        found = [self.find(shingles(hashes, w)) for w in self._widths if w <= len(hashes)]
        if len(found) == 1:
            return found[0]
        return tuple(np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in (0, 1))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that hold an n-gram of the block, and which."""
        hit = np.flatnonzero(self.filter()[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        where = np.searchsorted(self.grams, hashes[hit])
        where[where == len(self.grams)] = 0
        same = self.grams[where] == hashes[hit] if len(self.grams) else np.zeros(0, bool)
        return hit[same], where[same]

    def filter(self) -> np.ndarray:
        if not hasattr(self, "_filter"):
            self._filter = np.zeros(1 << _BITS, bool)
            self._filter[(self.grams & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        return self._filter

    def spans(self, threshold: float) -> np.ndarray:
        """Words of a text that an alignment of each item takes at most."""
        if not hasattr(self, "_spans"):
            self._spans = np.array([len(w) + _slack(len(w), threshold) for w in self.words], np.int64)
        return self._spans

    def longest(self, threshold: float) -> int:
        return int(self.spans(threshold).max(initial=0))


def _tokens(raw: bytes):
    return words(raw, between=PUNCTUATION)


def _slack(length: int, threshold: float) -> int:
    """Words that an alignment of an item may have to skip in the text."""
    return int(MATCH * length * (1 - threshold) / GAP + 1e-9)


def intact(length: int, threshold: float) -> tuple[int, int]:
    """Width, and how many of an item's n-grams of that width every match leaves intact.

    An alignment with ``h`` equal words affords MATCH h - threshold MATCH length edits; so
    many edits cut it into one run more, and a run of r words has r - width + 1 n-grams.
    The widest n-gram with such a guarantee counts; single words always have one.
    """
    full = threshold * MATCH * length
    for width in range(min(WIDTH, length), 0, -1):
        least = min(
            h - (width - 1) * (int((MATCH * h - full) / min(GAP, MISMATCH) + 1e-9) + 1)
            for h in range(max(1, math.ceil(threshold * length - 1e-9)), length + 1)
        )
        if least >= 1:
            break
    return width, max(least, 1)


def items_of(rows: list[tuple], threshold: float = THRESHOLD) -> Items:
    """A block from ``(item_id, text)`` rows; items without words are left out."""
    ids, tokens, widths, need, grams, owner, place = [], [], [], [], [], [], []
    for item_id, text in rows:
        hashes = _tokens((text or "").encode())[2]
        if len(hashes):
            width, least = intact(len(hashes), threshold)
            found = shingles(hashes, width)
            grams.append(found)
            owner.append(np.full(len(found), len(ids)))
            place.append(np.arange(len(found)))
            ids.append(item_id)
            tokens.append(hashes)
            widths.append(width)
            need.append(least)
    empty = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    grams, owner, place = (np.concatenate(x or e) for x, e in ((grams, empty[0]), (owner, empty[1]), (place, empty[1])))
    order = np.argsort(grams, kind="stable")
    distinct, first = np.unique(grams[order], return_index=True)
    bounds = np.append(first, len(grams))
    return Items(ids, tokens, np.array(widths, np.int64), np.array(need, np.int64), distinct, bounds, owner[order], place[order])


def seeded(items: Items, documents: np.ndarray) -> Items:
    """The block with seeds only: n-grams that occur, without the most frequent of each item.

    Half of the n-grams that a match is sure to have may go; it still has the others.
    """
    which = np.repeat(np.arange(len(items.grams)), np.diff(items.first))
    keep = np.zeros(len(which), bool)
    need = items.need.copy()
    rarity = documents[which]
    order = np.lexsort((items.at, rarity, items.item))
    for of_item in np.split(order, np.flatnonzero(np.diff(items.item[order])) + 1):
        one = items.item[of_item[0]]
        spare = int(need[one]) // 2
        need[one] -= spare
        keep[of_item[: len(of_item) - spare]] = True
    kept = np.flatnonzero(keep & (rarity > 0))
    grams, first = np.unique(which[kept], return_index=True)
    bounds = np.append(first, len(kept))
    return Items(items.ids, items.words, items.widths, need, items.grams[grams], bounds, items.item[kept], items.at[kept])


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: score, first and last position in ``window`` (end exclusive), matches.

    One pass per item word; gaps in the window are a running maximum.  Of equal scores the
    first cell in item order, then window order, counts.
    """
    n = len(window)
    steps = np.arange(n) * GAP
    places = np.arange(n)
    score, start, hits = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64)
    best = (0, 0, 0, 0)
    for word in item:
        same = window == word
        diagonal = np.concatenate(([0], score[:-1])) + np.where(same, MATCH, -MISMATCH)
        before = np.concatenate(([0], score[:-1])) > 0
        diagonal_start = np.where(before, np.concatenate(([0], start[:-1])), places)
        diagonal_hits = np.where(before, np.concatenate(([0], hits[:-1])), 0) + same
        up = score - GAP
        from_up = up > diagonal
        cell = np.where(from_up, up, diagonal)
        cell_start, cell_hits = np.where(from_up, start, diagonal_start), np.where(from_up, hits, diagonal_hits)
        run = cell + steps
        top = np.maximum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == top, places, 0))
        score = np.maximum(top - steps, 0)
        start, hits = cell_start[source], cell_hits[source]
        at = int(np.argmax(score))
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at + 1, int(hits[at]))
    return best


def _candidates(seeds: Items, where: np.ndarray, gram: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Items with enough seeds close together, and the diagonals of such seeds; both sorted.

    Seeds are expanded to their places in items piece by piece of the text, about
    ``EXPANDED`` places at once; a piece also sees the seeds that a match starting in it
    may still reach.
    """
    order = np.argsort(where, kind="stable")
    where, gram = where[order], gram[order]
    counts = seeds.first[gram + 1] - seeds.first[gram]
    total = np.concatenate(([0], np.cumsum(counts)))
    spans, items, diagonals = seeds.spans(threshold), [], []
    at = 0
    while at < len(where):
        to = max(at + 1, int(np.searchsorted(total, total[at] + EXPANDED, "right")) - 1)
        edge = where[to] if to < len(where) else where[-1] + 1
        to = int(np.searchsorted(where, edge, "left")) if edge > where[at] else int(np.searchsorted(where, where[at], "right"))
        edge = where[to] if to < len(where) else where[-1] + 1
        end = int(np.searchsorted(where, edge + seeds.longest(threshold), "left"))
        many = counts[at:end]
        place = np.repeat(where[at:end], many)
        offset = np.arange(len(place)) - np.repeat(total[at:end] - total[at], many)
        slot = np.repeat(seeds.first[gram[at:end]], many) + offset
        item = seeds.item[slot]
        enough = np.bincount(item, minlength=len(seeds.ids))[item] >= seeds.need[item]
        place, slot, item = place[enough], slot[enough], item[enough]
        order = np.lexsort((place, item))
        place, slot, item = place[order], slot[order], item[order]
        # a match's first seed has the others it needs within the words that a match may span
        last = np.arange(len(item)) + seeds.need[item] - 1
        there = last < len(item)
        last[~there] = 0
        there &= (item[last] == item) & (place[last] - place < spans[item]) & (place < edge)
        items.append(item[there])
        diagonals.append((place - seeds.at[slot])[there])
        at = to
    item, diagonal = np.concatenate(items), np.concatenate(diagonals)
    order = np.lexsort((diagonal, item))
    return item[order], diagonal[order]


def _joined(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Unions of intervals that touch or overlap; ``low`` ascending."""
    top = np.maximum.accumulate(high)
    new = np.flatnonzero(np.append(True, low[1:] > top[:-1]))
    return list(zip(low[new].tolist(), top[np.append(new[1:], len(low)) - 1].tolist()))


def _promising(inside: np.ndarray, span: int, least: float) -> list[tuple[int, int]]:
    """Parts of a window that may hold an alignment of score ``least``, from ``inside`` alone.

    ``inside`` tells the words that occur in the item.  A match scores MATCH at most for
    each of them and loses at least one for every other word, so its words, ``span`` at
    most, have a sum of that size whatever their order.
    """
    sums = np.concatenate(([0], np.cumsum(np.where(inside, MATCH, -min(GAP, MISMATCH)))))
    before = np.concatenate((np.full(span, sums.max()), sums))  # lowest of the last span + 1 sums
    lowest, wide = before, 1
    while wide < span + 1:
        step = min(wide, span + 1 - wide)
        lowest = np.minimum(lowest[:-step], lowest[step:])
        wide += step
    ends = np.flatnonzero(sums - lowest >= least)
    return _joined(np.maximum(ends - span, 0), ends) if len(ends) else []


def matches(raw: bytes, seeds: Items, threshold: float = THRESHOLD) -> list[tuple]:
    """``(item number, score, start byte, end byte, matched words)`` of the items in a text.

    The best alignment of every item whose score reaches ``threshold``; of equal ones that
    of the earliest stretch of text where the item's words lie close enough.
    """
    starts, ends, hashes = _tokens(raw)
    where, gram = seeds.hits(hashes)
    if not len(where):
        return []
    item, diagonal = _candidates(seeds, where, gram, threshold)
    if not len(item):
        return []
    vocabulary, codes = np.unique(hashes, return_inverse=True)
    known = np.zeros(len(vocabulary) + 1, bool)
    out = []
    bounds = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
    for begin, end in zip(bounds[:-1], bounds[1:]):
        one = item[begin]
        own = seeds.words[one]
        slack, full = _slack(len(own), threshold), MATCH * len(own)
        near = np.unique(diagonal[begin:end])
        code = np.searchsorted(vocabulary, own)
        code[code == len(vocabulary)] = 0
        code = np.where(vocabulary[code] == own, code, len(vocabulary))
        known[code] = True
        known[-1] = False
        best = None
        for low, high in _joined(near - slack, near + len(own) + slack):
            low, high = max(0, low), min(len(hashes), high)
            for a, b in _promising(known[codes[low:high]], len(own) + slack, threshold * full - 1e-9):
                score, first, last, hits = align(own, hashes[low + a : low + b])
                if score >= threshold * full and (best is None or score > best[0]):
                    best = (score, low + a + first, low + a + last, hits)
        known[code] = False
        if best:
            out.append((int(one), best[0] / full, int(starts[best[1]]), int(ends[best[2] - 1]), best[3]))
    return out


def blocks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most: int = BLOCK_CHARS
) -> Iterator[Items]:
    """The test items with their seeds, in blocks of about ``most`` characters.

    A block's items and the document counts of its n-grams pass the driver; both are
    bounded by ``most``.  Each block costs one scan of the documents here.
    """
    rows = benchmark.select("item_id", F.col("text").alias("item_text"))
    size = rows.agg(F.sum(F.length("item_text"))).first()[0] or 0
    many = -(-size // most)
    texts = docs.select("text")
    for k in range(many):
        part = rows.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(many)) == k)
        items = items_of([tuple(r) for r in part.orderBy("item_id", "item_text").collect()], threshold)
        if items.ids:
            yield seeded(items, _document_counts(texts, items))


def _document_counts(texts: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each n-gram of the block occurs, summed up in each task first."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(items.grams), np.int64)
        for batch in batches(iterator):
            for raw in raw_texts(batch.column("text")):
                counts[np.unique(items.hits(_tokens(raw)[2])[1])] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["gram", "n"])

    rows = texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(items.grams), np.int64)
    out[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, score, start, end, matched_words``: test items found in documents.

    One row for each document row and item whose best alignment reaches ``threshold`` of
    the full score; start and end are code points of the passage.  Null and empty texts
    and items match nothing; repeated rows and repeated items are reported each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    item_type = pa.int64() if item_kind in ("bigint", "int") else pa.string()
    schema = f"doc_id {kind}, item_id {'bigint' if item_type == pa.int64() else 'string'}, score double, start long, end long, matched_words long"
    rows = docs.select("doc_id", "text")

    def found(seeds: Items):
        def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(iterator):
                of, out = [], []
                for i, raw in enumerate(raw_texts(batch.column("text"))):
                    for item, score, low, high, hits in matches(raw, seeds, threshold):
                        points = code_point_starts(raw)
                        of.append(i)
                        out.append((seeds.ids[item], score, *np.searchsorted(points, (low, high)).tolist(), hits))
                columns = list(zip(*out)) or [()] * 5
                types = (item_type, pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(of, pa.int64())), *map(pa.array, columns, types)],
                    names=["doc_id", "item_id", "score", "start", "end", "matched_words"],
                )

        return rows.mapInArrow(run, schema)

    parts = [found(seeds) for seeds in blocks(rows, benchmark, threshold, most)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with their columns, in whose text no test item is found."""

    def without(rows: DataFrame, seeds: Items) -> DataFrame:
        def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(iterator):
                keep = [not matches(raw, seeds, threshold) for raw in raw_texts(batch.column("text"))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    return reduce(without, blocks(docs, benchmark, threshold, most), docs)
