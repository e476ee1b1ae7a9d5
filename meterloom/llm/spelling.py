"""Spelling variants: words one edit apart, found by a scan of the sorted vocabulary.

One edit leaves either the first half or the last half of a word as it was, so the
vocabulary is dealt out twice, by first halves and (reversed) by last halves.  A task
sorts its words; a range of the sorted list that shares a prefix has one row of the
banded edit matrix (three cells) against a query.  The scan goes down the ranges that
adjacent common prefixes (LCPs) delimit: the row of a longer prefix is made from that of
the shared prefix, and a range whose row holds no value under two is skipped as a whole.
All queries of a task take each step together.

Only counts and the best neighbour of a word leave a task, never pairs.  A half that too
many words share is cut into tiles by hash, every pair of words meeting in one of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import arrow_batch, batches, parts, raw_texts
from meterloom.session import stage

# Fixed values of the contract.
LEAST_LENGTH = 5
LEAST_COUNT = 3
DROP_MODULUS = 97
RATIO = 2

_RUNS = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_FLUSH = 1 << 17  # distinct words counted in a task before they are passed on
_TILE = 20_000  # words of one half compared in one task
_QUERIES = 1 << 12  # queries scanned together
_HIGH = 2  # stands for every distance over one

_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


# ---- vocabulary ----------------------------------------------------------------------


def counted_words(doc_id: int | None, raw: bytes) -> Counter:
    """Occurrences of a text's words of five letters or more after the contract's deletions."""
    found = Counter(_RUNS.findall(raw.lower().decode(errors="replace")))  # bytes lower only A-Z
    seed = crc32(b":", crc32(b"" if doc_id is None else str(doc_id).encode()))
    hit = [(run, h) for run in found if (h := crc32(run.encode(), seed)) % DROP_MODULUS == 0]
    taken = [(run, h, found.pop(run)) for run, h in hit]
    for run, h, n in taken:
        if len(run) > LEAST_LENGTH:
            at = h % len(run)
            found[run[:at] + run[at + 1 :]] += n
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of the words that count, each once."""

    def count(iterator):
        total: Counter = Counter()
        for batch in batches(iterator):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))):
                total.update(counted_words(doc_id, raw))
            if len(total) > _FLUSH:
                yield arrow_batch(_COUNTED, {"word": list(total), "n": list(total.values())})
                total.clear()
        yield arrow_batch(_COUNTED, {"word": list(total), "n": list(total.values())})

    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    words = narrow.mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- scan of a sorted list -----------------------------------------------------------


class _Sorted:
    """Distinct words of two lengths in order, with the ranges that share each prefix."""

    def __init__(self, letters: np.ndarray) -> None:
        self.letters = letters
        self.width = letters.shape[1]
        differ = letters[1:] != letters[:-1]
        lcp = np.append(-1, np.where(differ.any(axis=1), differ.argmax(axis=1), self.width))
        # Ranges of depth d start where fewer than d letters are shared with the word before.
        self.starts = [np.flatnonzero(lcp < d) for d in range(self.width + 1)]

    def children(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per range of ``depth``: first range of depth + 1 inside it, and how many there are."""
        inner = self.starts[depth + 1]
        first = np.searchsorted(inner, self.starts[depth])
        return first, np.diff(np.append(first, len(inner)))


def _scan(words: _Sorted, queries: np.ndarray, length: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) exactly one edit apart that share their first ``half`` letters.

    ``queries`` are positions in the list of words of ``length`` letters; the others have one more.
    """
    letters, pairs = words.letters, [np.empty((2, 0), np.int64)]
    number = np.searchsorted(words.starts[half], queries, "right") - 1
    query, node = queries, number
    # Cells j = depth - 1, depth, depth + 1 of the row of the prefix that both share.
    row = np.tile(np.array([1, 0, 1], np.uint8), (len(query), 1))
    for depth in range(half, words.width):
        first, many = words.children(depth)
        copies = many[node]
        step = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        node = np.repeat(first[node], copies) + step
        query, row = np.repeat(query, copies), np.repeat(row, copies, axis=0)
        at = words.starts[depth + 1][node]
        letter = letters[at, depth]
        real = letter > 0  # a word that ended has no longer prefix
        node, query, row, at, letter = node[real], query[real], row[real], at[real], letter[real]
        # The new row's cells are j = depth, depth + 1, depth + 2, compared with query letters j - 1.
        own = letters[query]
        costs = np.ones((len(query), 3), np.uint8)
        for c, j in enumerate((depth, depth + 1, depth + 2)):
            if 1 <= j <= length:
                costs[:, c] = own[:, j - 1] != letter
        new = row + costs
        new[:, :2] = np.minimum(new[:, :2], row[:, 1:] + 1)
        new[:, 1] = np.minimum(new[:, 1], new[:, 0] + 1)
        new[:, 2] = np.minimum(new[:, 2], new[:, 1] + 1)
        for c, j in enumerate((depth, depth + 1, depth + 2)):
            if j > length:
                new[:, c] = _HIGH
        np.minimum(new, _HIGH, out=new)
        # Words that end here: of equal length in cell 1, one letter longer in cell 0.
        cell = length - depth
        if cell in (0, 1):
            ends = (new[:, cell] == 1) & (letters[at, depth + 1] == 0 if depth + 1 < words.width else True)
            pairs.append(np.stack([query[ends], at[ends]]))
        alive = new.min(axis=1) < _HIGH
        node, query, row = node[alive], query[alive], new[alive]
    found = np.concatenate(pairs, axis=1)
    return found[0], found[1]


def _credits(
    words: list[bytes], asks: np.ndarray, listed: np.ndarray, length: int, backwards: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (word, near word) of positions in ``words``, in both directions where both are found once."""
    half = length // 2
    keyed = np.array([w[::-1] for w in words] if backwards else words, f"S{length + 1}")
    order = np.argsort(keyed)
    ranges = _Sorted(keyed[order].view(np.uint8).reshape(len(words), length + 1))
    asked = np.flatnonzero(asks[order])
    for a in range(0, len(asked), _QUERIES):
        query, near = _scan(ranges, asked[a : a + _QUERIES], length, length - half if backwards else half)
        query, near = order[query], order[near]
        query, near = query[listed[near]], near[listed[near]]
        if backwards:  # what shares the first half too has been found forwards
            new = [words[q][:half] != words[w][:half] for q, w in zip(query, near)]
            query, near = query[new], near[new]
        yield query, near
        longer = np.array([len(words[w]) > length for w in near], bool)
        yield near[longer], query[longer]


def _neighbours(
    words: list[bytes], n: np.ndarray, asks: np.ndarray, listed: np.ndarray, length: int, backwards: bool
) -> dict:
    """Columns of `_NEAR` for the words of one list that have near words in it."""
    found = list(_credits(words, asks, listed, length, backwards))
    word, near = np.concatenate([w for w, _ in found] or [[]]), np.concatenate([v for _, v in found] or [[]])
    word, near = word.astype(np.int64), near.astype(np.int64)
    text = np.array(words, f"S{length + 1}")
    order = np.lexsort((text[near], -n[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    return {
        "word": [words[w].decode("latin-1") for w in word[first]],
        "n_near": np.diff(np.append(first, len(word))),
        "form_n": n[near[first]],
        "form": [words[w].decode("latin-1") for w in near[first]],
    }


# ---- the whole vocabulary ------------------------------------------------------------


def _halves() -> Column:
    """The lists a word belongs to: its own length as query, the next shorter one as partner."""
    size = F.length("word")
    cells = []
    for shorter in (0, 1):
        length = size - shorter
        half = F.floor(length / 2).cast("int")
        for backwards in (False, True):
            text = F.reverse("word") if backwards else F.col("word")
            cell = F.struct(
                F.lit(backwards).alias("backwards"),
                length.alias("length"),
                F.substring(text, F.lit(1), length - half if backwards else half).alias("half"),
                F.lit(not shorter).alias("asks"),
            )
            cells.append(F.when(length >= LEAST_LENGTH, cell))
    return F.array_compact(F.array(*cells))


_LIST = ["backwards", "length", "half"]


def _tiled(words: DataFrame) -> DataFrame:
    """Rows of every list; lists of more than ``_TILE`` words are cut so that each pair meets once."""
    rows = words.select("word", "n", F.explode(_halves()).alias("h")).select("word", "n", "h.*")
    crowded = rows.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > _TILE)
    slices = F.coalesce(F.ceil(F.col("size") / _TILE), F.lit(1)).cast("int")
    rows = rows.join(crowded, _LIST, "left").withColumn("slices", slices)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    # Slice number of the queries, of the list, and whether the row asks and is found there.
    both = F.array(F.struct(F.col("own").alias("q"), F.col("own").alias("w"), F.col("asks").alias("asks"), F.lit(True).alias("listed")))
    others = F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda t: t != F.col("own"))
    asking = F.transform(others, lambda t: F.struct(F.col("own").alias("q"), t.alias("w"), F.lit(True).alias("asks"), F.lit(False).alias("listed")))
    listed = F.transform(others, lambda t: F.struct(t.alias("q"), F.col("own").alias("w"), F.lit(False).alias("asks"), F.lit(True).alias("listed")))
    tiles = F.concat(both, listed, F.when(F.col("asks"), asking).otherwise(F.slice(asking, 1, 0)))
    return rows.select("word", "n", *_LIST, F.explode(tiles).alias("t")).select("word", "n", *_LIST, "t.*")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, form_n, form)``: how many words are near, and the most frequent of them.

    ``words`` has distinct words of letters up to U+00FF with their counts.
    """

    def scan(iterator):
        received = list(batches(iterator))
        if not received:
            return
        table = pa.Table.from_batches(received)
        word = [w.encode("latin-1") for w in table["word"].to_pylist()]
        n, asks, listed = (table[c].to_numpy() for c in ("n", "asks", "listed"))
        sets = [table[c].to_numpy() for c in ("backwards", "length", "q", "w")]
        order = np.lexsort(sets)
        change = np.any([np.diff(s[order].astype(np.int64), prepend=-1) != 0 for s in sets], axis=0)
        for rows in np.split(order, np.flatnonzero(change)[1:]):
            backwards, length = bool(sets[0][rows[0]]), int(sets[1][rows[0]])
            own = [word[r] for r in rows]
            yield arrow_batch(_NEAR, _neighbours(own, n[rows], asks[rows], listed[rows], length, backwards))

    rows = _tiled(words)
    size = words.count()
    tasks = max(parts(words.sparkSession), 4 * size // 100_000)
    dealt = rows.repartition(tasks, *_LIST, "q", "w")
    found = dealt.mapInArrow(scan, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form")
    )


def variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``docs(doc_id, text)``.

    A word has five letters or more and occurs three times or more.  Its ``form`` is the
    near word of largest ``n`` (ties: the smallest in code-point order) where that is twice
    the word's own, and ``root`` the end of the chain of forms.

    Null and empty texts have no words; a null id counts as empty text before the colon of
    the contract's deletions; repeated rows count each time; an empty table gives no rows;
    other columns are left out.  Counts at least double along a chain, so six rounds of
    pointer doubling reach every root.
    """
    words = stage(vocabulary(docs), "spelling-words")
    valid = F.col("form_n") >= RATIO * F.col("n")
    linked = stage(
        words.join(near_words(words), "word", "left").select(
            "word",
            F.when(valid, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(valid, F.col("form_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    chain = linked.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = stage(chain.join(further, "root", "left"), "spelling-roots")
        chain = joined.select("word", F.coalesce("_next", "root").alias("root"))
        if joined.where("_next IS NOT NULL").isEmpty():
            break
    return linked.join(chain, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
