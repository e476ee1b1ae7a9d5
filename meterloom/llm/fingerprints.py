"""Threshold-scaled document sketches.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, so
sketches of any two documents, however unequal, are samples of the same part of the
range: intersections and containments follow by counting, and the union of two sketches
is the sketch of the union.  A document with fewer than ``floor`` such hashes keeps its
``floor`` smallest instead, and one with fewer shingles keeps them all; its sketch then
is complete up to a higher threshold, and two sketches are compared below the lower of
their thresholds.  Below ``floor`` hashes the fixed fraction thus gives way to a fixed
number, by the document's size; `merge` and `containment` allow for it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import (
    arrow_batch,
    batches,
    code_point_starts,
    parts,
    raw_texts,
    shingles,
    words,
)

WIDTH, FRACTION, FLOOR = 5, 1 / 8, 32
BLOCK_BYTES = 64_000_000  # bytes of text in a block of the order, on average
_TOP = 2**64 - 1


def sketch(raw: bytes, width: int = WIDTH, fraction: float = FRACTION, floor: int = FLOOR) -> np.ndarray:
    """Sorted retained hashes of a text; empty for a text without words."""
    kept = np.unique(shingles(words(raw)[2], width))
    below = int(np.searchsorted(kept, np.uint64(int(_TOP * fraction)), "right"))
    return kept[: max(below, floor)]


def threshold(kept: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> int:
    """Hash value up to which a sketch is complete."""
    if len(kept) < floor:
        return _TOP
    return max(int(_TOP * fraction), int(kept[-1]) if len(kept) == floor else 0)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> np.ndarray:
    """Sketch of the union of two documents' shingles, from their sketches alone."""
    both = np.union1d(a, b)
    limit = min(threshold(a, fraction, floor), threshold(b, fraction, floor))
    both = both[both <= np.uint64(limit)]
    below = int(np.searchsorted(both, np.uint64(int(_TOP * fraction)), "right"))
    return both[: max(below, floor)]


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> float:
    """Estimated share of the smaller document's shingles that the other has.

    Two empty sketches are equal (1); an empty and a filled one share nothing (0).
    """
    limit = np.uint64(min(threshold(a, fraction, floor), threshold(b, fraction, floor)))
    na, nb = int(np.searchsorted(a, limit, "right")), int(np.searchsorted(b, limit, "right"))
    if not na or not nb:
        return float(len(a) == len(b) == 0)
    return len(np.intersect1d(a[:na], b[:nb], assume_unique=True)) / min(na, nb)


def encode(kept: np.ndarray) -> str:
    """Sixteen hex digits per retained hash, ascending."""
    return kept.astype(">u8").tobytes().hex()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprint(
    docs: DataFrame, width: int = WIDTH, fraction: float = FRACTION, floor: int = FLOOR
) -> DataFrame:
    """``doc_id, n_shingles, fingerprint`` of every row; null text counts as empty.

    Repeated rows stay, equal texts get equal fingerprints, an empty text an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            counts, prints = [], []
            for raw in raw_texts(batch.column("text")):
                found = shingles(words(raw)[2], width)
                counts.append(len(np.unique(found)))
                prints.append(encode(sketch(raw, width, fraction, floor)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(prints, pa.string())],
                names=["doc_id", "n_shingles", "fingerprint"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles long, fingerprint string"
    )


# ---- each document against its edited text and the next document ---------------------

PAIRS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def edited(raw: bytes, following: bytes) -> bytes:
    """The last third of the code points replaced by as many first ones of ``following``."""
    at, other = code_point_starts(raw), code_point_starts(following)
    cut = len(at) // 3
    if not cut:
        return raw
    return raw[: at[len(at) - cut]] + (following if cut >= len(other) else following[: other[cut]])


def in_order(docs: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """Rows in blocks of descending doc_id, each block followed by the next block's first row.

    Blocks hold about equally many rows, on average at most ``most`` bytes of text, and each
    is a task of its own; they are cut at quantiles of the ids, so no task sees the whole
    order.  The copied row (``extra``) is the only one that two blocks share; after the
    lowest block comes the first row of all.  Rows of one doc_id are ordered by text; null
    ids come last, ordered by a hash of their text, then text, and are cut at the hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    no_id, size = F.col("doc_id").isNull(), F.octet_length("text")
    sizes = rows.agg(F.sum(size), F.sum(F.when(no_id, size)), F.count_if(no_id)).first()
    n = max(2 * parts(spark), -(-(sizes[0] or 0) // most))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    # null ids without any text stay together: there is nothing to split them by
    low = max(1, -(-(sizes[1] or 0) // most))
    rank = F.when(no_id, F.xxhash64("text")).otherwise(0) if sizes[2] else F.lit(0).cast("long")
    rows = rows.withColumn("rank", rank)
    of_rank = F.least(F.floor((F.col("rank") / 2.0**64 + 0.5) * low), F.lit(low - 1))
    block = F.when(no_id, -1 - of_rank).otherwise(_above(cuts))
    rows = rows.withColumn("block", block.cast("int"))
    # one row per block
    firsts = rows.groupBy("block").agg(F.max("doc_id").alias("doc_id"), F.min("rank").alias("rank")).collect()
    present = sorted((r["block"] for r in firsts), reverse=True)
    to = dict(zip(present, present[-1:] + present[:-1]))
    heads = spark.createDataFrame(
        [(r["block"], r["doc_id"], r["rank"], to[r["block"]]) for r in firsts],
        "b int, first long, first_rank long, to_block int",
    )
    is_first = (
        (F.col("block") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("rank") == F.col("first_rank"))
    )
    extra = (
        rows.join(F.broadcast(heads), is_first)
        .groupBy("to_block", "first", "first_rank")
        .agg(F.min("text").alias("text"))
        .select(
            F.col("first").alias("doc_id"),
            "text",
            F.col("first_rank").alias("rank"),
            F.col("to_block").alias("block"),
            F.lit(1).alias("extra"),
        )
    )
    return (
        rows.withColumn("extra", F.lit(0))
        .unionByName(extra)
        .repartitionById(len(cuts) + 1 + low, F.col("block") + low)
        .sortWithinPartitions("block", "extra", F.desc_nulls_last("doc_id"), "rank", "text")
    )


def _above(cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` lie below doc_id: first among every k-th, then between two of them."""
    k = max(1, math.isqrt(len(cuts)))
    array = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col("doc_id")))
    if not cuts:
        return F.lit(0)
    coarse = below(array(cuts[::k]))
    start = F.greatest(coarse - 1, F.lit(0)) * k
    return start + below(F.slice(array(cuts), start + 1, F.lit(k)))


def against_next(
    docs: DataFrame, width: int = WIDTH, fraction: float = FRACTION, floor: int = FLOOR
) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and the next document.

    Null and empty texts have an empty fingerprint; an only row is its own next.
    """

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (block, doc_id, raw, sketch) of the row that waits for its next
        for batch in batches(iterator):
            out: dict[str, list] = {name: [] for name in PAIRS.names}
            rows = zip(
                batch.column("block").to_pylist(),
                batch.column("extra").to_pylist(),
                batch.column("doc_id").to_pylist(),
                raw_texts(batch.column("text")),
            )
            for block, extra, doc, raw in rows:
                kept = sketch(raw, width, fraction, floor)
                if before is not None and before[0] == block:
                    _, own_id, own, own_kept = before
                    changed = edited(own, raw)
                    changed_kept = sketch(changed, width, fraction, floor)
                    values = (
                        own_id,
                        len(code_point_starts(own)),
                        hashlib.sha256(changed).hexdigest(),
                        encode(own_kept),
                        encode(changed_kept),
                        containment(own_kept, changed_kept, fraction, floor),
                        containment(own_kept, kept, fraction, floor),
                    )
                    for name, value in zip(PAIRS.names, values):
                        out[name].append(value)
                before = None if extra else (block, doc, raw, kept)
            yield arrow_batch(PAIRS, out)

    return in_order(docs).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double",
    )
