"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes, counted by Spark over the
training documents: every position gives one (context, byte) gram as a 64-bit number, and
the grams of shorter contexts are its suffixes.  A byte seen n times of total in its context
has probability (n - 1/2) / total there; one not seen escapes to the next shorter context
with probability distinct / (2 total), and bytes seen in the longer one are excluded there; below the empty context all remaining byte values are
equally likely.  Start and end of a text are the byte FF, which UTF-8 never uses.

A text is scored with the whole trie.  It goes to the tasks in blocks of at most
``MOST_GRAMS`` grams; contexts that end alike share a block, so a block holds every escape
chain of its positions, and each block scans the texts once.

Beside it stands the add-one word model.  Counts of the most frequent words go to the
tasks, as many as ``MOST_WORDS``; rarer words meet their counts in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import batches, folded, held_out, raw_texts, words
from meterloom.session import stage

ORDER = 5
MOST_GRAMS = 3_000_000
MOST_WORDS = 1_000_000
MODULUS, HELD_OUT = 7, 2
_END = 1  # stands for the end token among the word hashes
_EDGE = 0xFF
_FLUSH = 1_500_000  # distinct keys a task gathers before it passes them on
_CHUNK = 1 << 20  # bytes of text worked on at once


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) grams at every byte and end of the texts, and the text of each."""
    edge = np.full(ORDER, _EDGE, np.uint8)
    pieces = []
    for raw in texts:
        pieces += [edge, folded(raw), edge[:1]]
    data = np.concatenate(pieces).astype(np.uint64)
    gram = data[: len(data) - ORDER].copy()
    for i in range(1, ORDER + 1):
        gram = (gram << np.uint64(8)) | data[i : len(data) - ORDER + i]
    sizes = np.array([len(raw) + 1 for raw in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    # a text's grams begin ORDER places after those of the text before it end
    place = np.arange(len(owner)) + owner * ORDER
    return gram[place], owner


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``_CHUNK`` bytes, with the number of the first."""
    first, size = 0, 0
    for i, raw in enumerate(texts):
        size += len(raw)
        if size >= _CHUNK or i + 1 == len(texts):
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    together, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return together, np.bincount(inverse, np.concatenate(counts), len(together)).astype(np.int64)


def count(texts: DataFrame) -> DataFrame:
    """``kind, key, n``: words (kind 0, by hash) and byte grams (kind 1) of all texts."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}

        def passed(kind: int) -> pa.RecordBatch:
            keys, n = _merge(*held[kind])
            held[kind] = ([], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n)],
                names=["kind", "key", "n"],
            )

        for batch in batches(iterator):
            for _, texts_ in _chunks(raw_texts(batch.column("text"))):
                tokens = np.concatenate([words(raw)[2] for raw in texts_] + [np.full(len(texts_), _END, np.uint64)])
                for kind, found in ((0, tokens), (1, _grams(texts_)[0])):
                    keys, n = np.unique(found, return_counts=True)
                    held[kind][0].append(keys)
                    held[kind][1].append(n)
                    if sum(map(len, held[kind][0])) > _FLUSH:
                        merged = _merge(*held[kind])
                        held[kind] = ([merged[0]], [merged[1]])
                        if len(merged[0]) > _FLUSH // 2:
                            yield passed(kind)
        for kind in (0, 1):
            if held[kind][0]:
                yield passed(kind)

    rows = texts.select("text").mapInArrow(run, "kind byte, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


# ---- the trie ------------------------------------------------------------------------


def _suffix(column, size: int):
    """The last ``size`` bytes of a gram or context."""
    return column.bitwiseAND(F.lit((1 << 8 * size) - 1).cast("long")) if size else F.lit(0).cast("long")


def levels(grams: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per context length from 0: grams ``gram, n`` and contexts ``context, total, distinct, seen``.

    ``seen`` is the count that the next shorter context gives to the bytes seen here.
    """
    out = []
    longest = grams.select(F.col("key").alias("gram"), "n")
    for size in range(ORDER + 1):
        here = longest.groupBy(_suffix(F.col("gram"), size + 1).alias("gram")).agg(F.sum("n").alias("n"))
        here = stage(here, f"grams-{size}")
        if size:
            shorter = out[-1][0].select(F.col("gram").alias("short"), F.col("n").alias("short_n"))
            joined = here.join(shorter, _suffix(F.col("gram"), size) == F.col("short"))
        else:
            joined = here.withColumn("short_n", F.lit(0).cast("long"))
        contexts = joined.groupBy(F.shiftright("gram", 8).alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("short_n").alias("seen")
        )
        out.append((here, stage(contexts, f"contexts-{size}")))
    return out


class _Table:
    """Open-addressed hash table of 64-bit keys to float32, filled and read by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, 2**64 - 1, np.uint64)  # no gram has this value
        self._values = np.zeros(1 << bits, np.float32)
        place, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self._keys[place[left]] == np.uint64(2**64 - 1)]
            self._keys[place[free]] = keys[free]
            done = self._keys[place[left]] == keys[left]
            self._values[place[left[done]]] = values[left[done]]
            left = left[~done]
            place[left] = (place[left] + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether each key is there."""
        place = self._home(keys)
        met = self._keys[place]
        there = met == keys
        out = np.where(there, self._values[place], np.float32(0))
        left = np.flatnonzero(~there & (met != np.uint64(2**64 - 1)))
        while len(left):
            place[left] = (place[left] + 1) & self._mask
            met = self._keys[place[left]]
            hit = met == keys[left]
            there[left[hit]] = True
            out[left[hit]] = self._values[place[left[hit]]]
            left = left[~hit & (met != np.uint64(2**64 - 1))]
        return out, there


@dataclass
class Trie:
    """A block of the trie as sorted arrays per context length."""

    longest: np.ndarray  # grams with a context of full length
    log: np.ndarray  # and their log10 probabilities
    grams: list[tuple[np.ndarray, np.ndarray]]  # gram, count; of shorter contexts
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # context, total, distinct, seen
    block: int
    blocks: int

    def fall_back(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of grams whose byte is new to the full context."""
        log = np.zeros(len(grams))
        open_ = np.arange(len(grams))  # grams whose byte is not found yet
        excluded, excluded_mass = np.zeros(len(grams)), np.zeros(len(grams))
        for size in range(ORDER, -1, -1):
            own = grams[open_] & np.uint64((1 << 8 * (size + 1)) - 1)
            at, there = _lookup(self.contexts[size][0], own >> np.uint64(8))
            total, distinct, seen = (np.where(there, c[at] if len(c) else 0, 0) for c in self.contexts[size][1:])
            rest, kinds = total - excluded_mass[open_], distinct - excluded[open_]
            usable = there & (kinds > 0)
            hit, n = np.zeros(len(own), bool), np.zeros(len(own))
            if size < ORDER and len(self.grams[size][0]):
                spot, hit = _lookup(self.grams[size][0], own)
                hit, n = hit & usable, self.grams[size][1][spot]
            with np.errstate(divide="ignore", invalid="ignore"):
                found = np.log10((n - 0.5) / rest)
                escape = np.log10(kinds / (2 * rest))
            log[open_] += np.where(hit, found, np.where(usable, escape, 0.0))
            excluded[open_] = np.where(there, distinct, excluded[open_])
            excluded_mass[open_] = np.where(there, seen, 0)
            open_ = open_[~hit]
        log[open_] -= np.log10(np.maximum(1, 256 - excluded[open_]))
        return log

    def here(self, grams: np.ndarray) -> np.ndarray:
        """Which grams belong to this block, by the last two bytes of their contexts."""
        return _block_of(grams, self.blocks) == self.block


def _block_of(grams: np.ndarray, blocks: int) -> np.ndarray:
    return ((grams >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(blocks)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _arrays(df: DataFrame, **kinds: str) -> tuple[np.ndarray, ...]:
    """Columns of a block as arrays of the given kinds, sorted by the first.

    Tasks sort and pack them, so the driver gets bytes of their final size.
    """
    first, *_ = kinds

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            packed = [batch.column(c).to_numpy(zero_copy_only=False).astype(kind).tobytes() for c, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=list(kinds))

    packed = df.select(*kinds).orderBy(first).mapInArrow(run, ", ".join(f"{c} binary" for c in kinds)).collect()
    return tuple(np.frombuffer(b"".join(r[c] for r in packed), kind) for c, kind in kinds.items())


def tries(grams: DataFrame, most: int = MOST_GRAMS) -> Iterator[Trie]:
    """The trie in as many blocks as keep every block within ``most`` grams on average."""
    every = levels(grams)
    blocks = max(1, -(-every[ORDER][0].count() // most))
    for block in range(blocks):

        def own(df, column, size, context):
            # contexts of two bytes and more lie in one block, shorter ones in all
            ends = F.col(column) if context else F.shiftright(column, 8)
            return df if size < 2 or blocks == 1 else df.where(_suffix(ends, 2) % blocks == block)

        contexts = [
            _arrays(own(c, "context", size, True), context="i8", total="i8", distinct="i4", seen="i8")
            for size, (_, c) in enumerate(every)
        ]
        contexts = [(c.view(np.uint64), *rest) for c, *rest in contexts]
        shorter = [_arrays(own(g, "gram", size, False), gram="i8", n="i8") for size, (g, _) in enumerate(every[:-1])]
        shorter = [(g.view(np.uint64), n) for g, n in shorter]
        top = every[-1][1].select(F.col("context").alias("of"), "total")
        seen = own(every[-1][0], "gram", ORDER, False).join(top, F.shiftright("gram", 8) == F.col("of"))
        gram, log = _arrays(seen.select("gram", F.log10((F.col("n") - 0.5) / F.col("total")).alias("log")), gram="i8", log="f4")
        yield Trie(gram.view(np.uint64), log, shorter, contexts, block, blocks)


# ---- scores --------------------------------------------------------------------------


def _identity(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def ppm_scores(docs: DataFrame, trie: Trie) -> DataFrame:
    """``doc_id, text_hash, score``: log10 probability of the block's bytes in every text.

    Written at once, so that the tasks' copy of the block can go.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(trie)
    del trie

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        table = _Table(trie.longest, trie.log)
        for batch in batches(iterator):
            raws = raw_texts(batch.column("text"))
            total = np.zeros(len(raws))
            for first, texts in _chunks(raws):
                grams, owner = _grams(texts)
                if trie.blocks > 1:
                    keep = trie.here(grams)
                    grams, owner = grams[keep], owner[keep]
                value, there = table.get(grams)
                log = value.astype(np.float64)
                new = np.flatnonzero(~there)
                if len(new):
                    distinct, inverse = np.unique(grams[new], return_inverse=True)
                    log[new] = trie.fall_back(distinct)[inverse]
                total[first : first + len(texts)] += np.bincount(owner, log, len(texts))
            hashes = [_identity(raw) for raw in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(hashes, pa.int64()), pa.array(total)],
                names=["doc_id", "text_hash", "score"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_hash long, score double")
    written = stage(rows, "block-scores")
    shared.destroy()
    return written


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Words (sorted) and counts of all words with at least the returned count, ``most`` at most."""
    of_counts = counts.groupBy("n").agg(F.count("*").alias("many")).orderBy(F.desc("n"))
    least, total = None, 0
    for row in of_counts.toLocalIterator():  # one row per distinct count
        if total + row["many"] > most:
            break
        least, total = row["n"], total + row["many"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64), 2**62
    keys, n = _arrays(counts.where(F.col("n") >= least), key="i8", n="i8")
    keys = keys.view(np.uint64)
    order = np.argsort(keys)  # by unsigned value
    return keys[order], n[order], least


def word_scores(docs: DataFrame, counts: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """``doc_id, text_hash, n_tokens, n_known, train_tokens, base_score`` of every text.

    Equal rows (same id and text) share their rare words' join.
    """
    counts = counts.select("key", "n")
    n_all, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    keys, numbers, least = _frequent(counts, most)
    whole, none = len(keys) == n_distinct, not len(keys)
    base = np.log10(n_all + n_distinct + 1)
    shared = docs.sparkSession.sparkContext.broadcast((keys, np.log10(numbers + 1.0)))
    del keys, numbers
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = shared.value
        for batch in batches(iterator):
            raws = raw_texts(batch.column("text"))
            tokens = [np.append(words(raw)[2], np.uint64(_END)) for raw in raws]
            sizes = np.array([len(t) for t in tokens])
            owner = np.repeat(np.arange(len(raws)), sizes)
            distinct, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
            at, there = _lookup(keys, distinct)
            value = np.where(there, 0.0 if none else logs[at], 0.0)
            known = np.bincount(owner, there[inverse], len(raws)).astype(np.int64)
            score = np.bincount(owner, value[inverse], len(raws)) - base * sizes
            rare = [[] for _ in raws]
            if not whole:
                for i in np.unique(owner[~there[inverse]]):
                    own = tokens[i][~there[inverse[owner == i]]]
                    word, times = np.unique(own, return_counts=True)
                    rare[i] = [{"word": w, "times": t} for w, t in zip(word.view(np.int64).tolist(), times.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([_identity(raw) for raw in raws], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(score, pa.float64()),
                    pa.array(rare, pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())]))),
                ],
                names=["doc_id", "text_hash", "n_tokens", "n_known", "base_score", "rare"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, text_hash long, n_tokens long, n_known long, base_score double,"
        " rare array<struct<word:bigint,times:bigint>>",
    )
    plain = stage(rows.withColumn("train_tokens", F.lit(int(n_all))), "word-scores")
    shared.destroy()
    if whole:
        return plain.drop("rare")
    wanted = (
        plain.where(F.size("rare") > 0)
        .dropDuplicates(["doc_id", "text_hash"])
        .select(F.col("doc_id").alias("rare_id"), F.col("text_hash").alias("rare_hash"), F.explode("rare").alias("r"))
        .select("rare_id", "rare_hash", "r.word", "r.times")
    )
    found = (
        wanted.join(counts.where(F.col("n") < least), F.col("word") == F.col("key"))
        .groupBy("rare_id", "rare_hash")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rise"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("rare_id")) & (F.col("text_hash") == F.col("rare_hash"))
    return plain.join(found, same, "left").select(
        "doc_id",
        "text_hash",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("rise", F.lit(0.0))).alias("base_score"),
        "train_tokens",
    )


def score(docs: DataFrame, train: DataFrame, most_grams: int = MOST_GRAMS, most_words: int = MOST_WORDS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Learns from the texts of ``train``; null texts are empty (an end token, an end byte).
    Without training texts every byte has probability 1/256.  Repeated rows stay.
    """
    rows = docs.select("doc_id", "text")
    counts = stage(count(train), "language-counts")
    base = word_scores(rows, counts.where("kind = 0"), most_words)
    blocks = [ppm_scores(rows, trie) for trie in tries(counts.where("kind = 1"), most_grams)]
    if len(blocks) == 1:
        scores = blocks[0].dropDuplicates(["doc_id", "text_hash"])
    else:  # equal rows have equal scores in a block
        once = [b.groupBy("doc_id", "text_hash").agg(F.max("score").alias("score")) for b in blocks]
        scores = reduce(DataFrame.unionByName, once).groupBy("doc_id", "text_hash").agg(F.sum("score").alias("score"))
    scores = scores.withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    return base.join(scores, same).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def training(docs: DataFrame) -> DataFrame:
    """The documents to learn from; a null id is not held out."""
    return docs.where(~held_out("doc_id", MODULUS, HELD_OUT))
