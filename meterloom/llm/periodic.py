"""Periodic runs of words, found in a grammar of each document.

Re-Pair replaces repeated pairs of word ids by nonterminals, the more frequent of two
overlapping pairs first, until no pair of a document repeats; what is left is joined
in a balanced tree.  A run lies across the boundary of exactly one lowest node of the
derivation, so runs are looked for at the boundary of each nonterminal once, carried
to every place it is derived at, and merged into maximal intervals.

All documents of a batch share the array operations; a document's symbols are its own.

At a boundary, a run of at least 24 words and three periods reaches 12 words and one
and a half periods to one side, so the five words around the boundary recur one period
away.  Recurrences in the nonterminal are the candidates; how far they hold is a binary
search over prefix hashes (two primes), so a text of one repeated word costs
``n log n`` as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meterloom.llm.common import arrow_batch, batches, mix, raw_texts

# Fixed values of the contract: the shortest run in words and in periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3

_ANCHOR = 5
_GROUP_WORDS = 200_000  # documents searched together; a longer one is searched alone
_CHUNK = 1 << 20  # candidates examined at once
_PRIMES = (2147483629, 2147483587)
_BASE = 1_000_003

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
_OUT = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)


# ---- grammar -------------------------------------------------------------------------


def derivation(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows ``rule, start, split, end`` of every derivation node of at least 24 words.

    ``ids`` are word ids from 0, different in different documents; ``doc`` numbers the
    document of every word in ascending order.  Nodes of one rule derive equal words.
    """
    symbol, at = ids.astype(np.int64), np.arange(len(ids) + 1)
    fresh = np.ones(len(ids), bool)  # whether the pair from here on may repeat
    count, nodes = int(ids.max(initial=-1)) + 1, []
    while True:
        seen = np.bincount(symbol, minlength=count) > 1
        left, right = symbol[:-1], symbol[1:]
        pairs = np.flatnonzero(fresh[:-1] & seen[left] & seen[right] & (doc[at[:-2]] == doc[at[1:-1]]))
        _, which, often = np.unique(left[pairs] * count + right[pairs], return_inverse=True, return_counts=True)
        again = often[which] > 1
        pairs, which = pairs[again], which[again]
        if not len(pairs):
            break
        priority = np.zeros(len(symbol) + 1, np.int64)  # a zero behind and, at -1, before all
        shuffled = (which.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        priority[pairs] = (often[which].astype(np.int64) << 32) + shuffled.astype(np.int64) + 1
        chosen = _tops(priority)
        rule = np.full(len(symbol), -1, np.int64)
        rule[pairs] = which
        used, new = np.unique(rule[chosen], return_inverse=True)
        nodes.append(np.stack([count + new, at[chosen], at[chosen + 1], at[chosen + 2]]))
        # Pairs seen once stay so; those beside a new symbol are to be counted.
        fresh = priority[:-1] > 0
        fresh[chosen], fresh[np.maximum(chosen - 1, 0)] = True, True
        symbol[chosen] = count + new
        count += len(used)
        stay = np.ones(len(symbol), bool)
        stay[chosen + 1] = False
        symbol, fresh, at = symbol[stay], fresh[stay], at[np.append(stay, True)]
    nodes.append(_balanced(at, doc, count))
    found = np.concatenate(nodes, axis=1)
    return found[:, found[3] - found[1] >= LEAST_WORDS]


def _tops(priority: np.ndarray) -> np.ndarray:
    """Positions of the pairs to replace: of neighbours the greater, of equal ones every other."""
    edges = np.flatnonzero(np.diff(priority, prepend=priority[0] - 1))
    value = priority[edges]
    before, behind = np.append(0, value[:-1]), np.append(value[1:], 0)
    top = (value > 0) & (value > before) & (value > behind)
    size = np.diff(np.append(edges, len(priority)))
    starts, counts = edges[top], (size[top] + 1) // 2
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + 2 * step


def _balanced(at: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """Nodes that join the remaining symbols of each document two by two."""
    nodes = [np.empty((4, 0), np.int64)]
    while True:
        of = doc[at[:-1]]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        left = np.flatnonzero((place[:-1] % 2 == 0) & (of[:-1] == of[1:]))
        if not len(left):
            return np.concatenate(nodes, axis=1)
        nodes.append(np.stack([count + np.arange(len(left)), at[left], at[left + 1], at[left + 2]]))
        count += len(left)
        at = np.delete(at, left + 1)


# ---- runs at a boundary --------------------------------------------------------------


class _Prefixes:
    """Hashes of any stretch of words, by prefix sums modulo two primes."""

    def __init__(self, ids: np.ndarray) -> None:
        random = mix(ids.astype(np.uint64) + np.uint64(1))
        self.primes = [np.int64(p) for p in _PRIMES]
        self.power, self.sums = [], []
        for prime, bits in zip(self.primes, (random >> np.uint64(32), random & np.uint64(0xFFFFFFFF))):
            power = np.ones(1, np.int64)
            while len(power) <= len(ids):
                power = np.concatenate([power, power * np.int64(pow(_BASE, len(power), int(prime))) % prime])
            values = (bits % np.uint64(prime - 1)).astype(np.int64) + 1
            self.power.append(power)
            self.sums.append(np.append(0, np.cumsum(values * power[: len(ids)] % prime)))

    def equal(self, start: np.ndarray, length: np.ndarray, shift: np.ndarray) -> np.ndarray:
        same = np.ones(len(start), bool)
        for prime, power, sums in zip(self.primes, self.power, self.sums):
            here = (sums[start + length] - sums[start]) % prime * power[shift] % prime
            there = (sums[start + length + shift] - sums[start + shift]) % prime
            same &= here == there
        return same

    def ahead(self, start: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``start`` on, at most ``most``, equal those ``shift`` later."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(start, half, shift)
            low, high = np.where(open_ & same, half, low), np.where(open_ & ~same, half - 1, high)
        return low

    def back(self, end: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``end``, at most ``most``, equal those ``shift`` later."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(end - half, half, shift)
            low, high = np.where(open_ & same, half, low), np.where(open_ & ~same, half - 1, high)
        return low


def _crossing(ids: np.ndarray, start: np.ndarray, split: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows ``node, from, to, period`` of the runs across the split of each node, inside it."""
    none = np.empty((4, 0), np.int64)
    if len(ids) < LEAST_WORDS or not len(start):
        return none
    n = len(ids) - _ANCHOR + 1
    spread = mix(ids.astype(np.uint64))
    gram = np.zeros(n, np.uint64)
    for k in range(_ANCHOR):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + spread[k : n + k]
    order = np.argsort(gram, kind="stable")
    group = np.cumsum(np.diff(gram[order], prepend=gram[order[:1]]) != 0)
    place = group * n + order  # ascending, positions of equal grams in order
    number = np.empty(n, np.int64)
    number[order] = group
    widest = (end - start) // LEAST_PERIODS
    found, prefixes = [none], None
    for later in (True, False):
        anchor = split - 1 if later else split - _ANCHOR + 1
        node = np.flatnonzero((anchor >= start) & (anchor + _ANCHOR <= end))
        i = anchor[node]
        base = number[i] * n
        if later:
            low = np.searchsorted(place, base + i, "right")
            high = np.searchsorted(place, base + np.minimum(i + widest[node], end[node] - _ANCHOR), "right")
        else:
            low = np.searchsorted(place, base + np.maximum(i - widest[node], start[node]), "left")
            high = np.searchsorted(place, base + i, "left")
        sizes = np.maximum(high - low, 0)
        total = np.cumsum(sizes)
        if not sizes.sum():
            continue
        prefixes = prefixes or _Prefixes(ids)
        cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], _CHUNK), "right"), len(node)))
        for a, b in zip(np.append(0, cuts[:-1]), cuts):
            if (many := sizes[a:b]).sum():
                inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                x = np.repeat(node[a:b], many)
                period = np.abs(order[np.repeat(low[a:b], many) + inner] - np.repeat(i[a:b], many))
                at = split[x] if later else split[x] - period
                to = at + period + prefixes.ahead(at, period, end[x] - at - period)
                since = at - prefixes.back(at, period, at - start[x])
                run = to - since >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
                found.append(np.stack([x, since, to, period])[:, run])
    runs = np.concatenate(found, axis=1)
    # Multiples of the smallest period give the same interval.
    runs = runs[:, np.lexsort((runs[3], runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[:3, 1:] != runs[:3, :-1]).any(axis=0)
    return runs[:, new]


def find_runs(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows ``start, end, period`` of all maximal runs, by start, then period."""
    nodes = derivation(ids, doc)
    rule, start, split, end = nodes[:, np.argsort(nodes[0], kind="stable")]
    first = np.flatnonzero(np.diff(rule, prepend=-1))
    places = np.diff(np.append(first, len(rule)))
    node, since, to, period = _crossing(ids, start[first], split[first], end[first])
    # Every place where a rule is derived has the rule's runs.
    many = places[node]
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    shift = start[np.repeat(first[node], many) + step] - np.repeat(start[first[node]], many)
    since, to, period = np.repeat(since, many) + shift, np.repeat(to, many) + shift, np.repeat(period, many)
    return _merged(since, to, period)


def _merged(since: np.ndarray, to: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Unions of intervals of one period that share at least a period."""
    order = np.lexsort((since, period))
    since, to, period = since[order], to[order], period[order]
    if not len(since):
        return np.empty((3, 0), np.int64)
    # Intervals of a smaller period end before: with this offset one running maximum serves all.
    lift = np.cumsum(np.diff(period, prepend=period[0]) != 0) * (int(to.max()) + 1)
    reach = np.maximum.accumulate(to + lift)
    new = np.ones(len(since), bool)
    new[1:] = (since[1:] + lift[1:] > reach[:-1] - period[1:]) | (period[1:] != period[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(since)) - 1
    out = np.stack([since[head], reach[last] - lift[last], period[head]])
    return out[:, np.lexsort((out[2], out[0]))]


# ---- documents -----------------------------------------------------------------------


def word_ids(tokens: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int64, len(tokens))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers after the contract's repetition, null where the text stays as it is."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place >= a, a + (place - a) % p, place)


def _described(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """Result columns of one document with runs ``(start, length, period)``."""
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    if runs:
        keep = np.ones(len(tokens), bool)
        for s, length, q in runs:
            keep[s + q : s + length] = False
        tokens = [tokens[i] for i in np.flatnonzero(keep)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        head = (len(runs), *best, 1000 * best[1] // best[2])
    else:
        head = (0, None, None, None, None)
    return (*head, sha256(listed.encode()).hexdigest(), sha256(b" ".join(tokens)).hexdigest())


def _groups(texts: list[bytes], ids: list, plant: bool) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for raw, doc_id in zip(texts, ids):
        tokens = raw.split()  # bytes split at 0x20 and 0x09-0x0D
        if plant and (places := planted(doc_id, len(tokens))) is not None:
            tokens = [tokens[i] for i in places]
        if group and size + len(tokens) > _GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(tokens)
        size += len(tokens)
    if group:
        yield group


def _search(group: list[list[bytes]]) -> Iterator[tuple]:
    sizes = np.array([len(t) for t in group])
    starts = np.cumsum(sizes) - sizes
    numbers, offset = [], 0
    for tokens in group:
        own = word_ids(tokens) + offset
        offset += len(tokens)
        numbers.append(own)
    ids = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(group)), sizes)
    since, to, period = find_runs(ids, doc) if len(ids) else np.empty((3, 0), np.int64)
    of = doc[since] if len(since) else since
    low, high = np.searchsorted(of, np.arange(len(group))), np.searchsorted(of, np.arange(len(group)), "right")
    for k, tokens in enumerate(group):
        a, b = low[k], high[k]
        runs = [(int(s - starts[k]), int(e - s), int(q)) for s, e, q in zip(since[a:b], to[a:b], period[a:b])]
        yield _described(tokens, runs)


def runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Periodic runs of the words of every text: one row per row of ``docs(doc_id, text)``.

    ``n_runs``, the run with the greatest exponent (``start, length, period,
    exponent_milli``; ties: smallest start, then period; nulls without a run) and digests
    of all runs and of the text without the words that repeat a run's first period.
    ``plant`` first repeats parts of every tenth text as the query's contract asks.

    Null and empty texts have no words and no runs.  Repeated rows and ids each get
    their row; a null id stays null (planted as the empty text).  An empty table gives no
    rows, other columns are left out.  A text is searched in one task, in memory
    proportional to its words.
    """

    def search(iterator):
        for batch in batches(iterator):
            ids = batch.column("doc_id").to_pylist()
            rows = [r for g in _groups(raw_texts(batch.column("text")), ids, plant) for r in _search(g)]
            columns = dict(zip(_OUT.names[1:], map(list, zip(*rows))))
            yield arrow_batch(_OUT, {"doc_id": ids, **columns})

    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return narrow.mapInArrow(search, SCHEMA)
