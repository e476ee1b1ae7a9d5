"""Helpers shared by the corpus operators: tables, text buffers, vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.session import configure

#: Rows of a batch sent to a Python worker: bounds its memory where texts are long.
BATCH_ROWS = 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separates at everything but ASCII letters, digits and non-ASCII characters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18  # bytes hashed at once; longer texts are cut at white space


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus queries: those of the package and small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str | Column) -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether the id's crc32 leaves ``remainder``; a null id is never held out."""
    return F.coalesce(id_crc(column) % modulus == remainder, F.lit(False))


def parts(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---- Arrow buffers -------------------------------------------------------------------


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def arrow_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


# ---- word hashes ---------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, _BLOCK + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)


def _long_hash(data: bytes) -> int:
    """Hash of a word longer than a block, folded block by block."""
    value = 0
    for at in range(0, len(data), _BLOCK):
        block = np.frombuffer(data, np.uint8)[at : at + _BLOCK].astype(np.uint64) + np.uint64(1)
        value = (value * _BASE + int((block * _UP[: len(block)]).sum(dtype=np.uint64))) & (2**64 - 1)
    return value


def words(
    raw: bytes, lower: bool = True, between: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte offsets) and 64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``.

    ``lower`` folds A-Z first; ``between`` tells the bytes that separate words.  A word's
    hash depends on its bytes alone.
    """
    data = np.frombuffer(raw, np.uint8)
    if lower:
        data = _LOWER[data]
    space = between[data]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    if len(data) <= _BLOCK:
        return starts, ends, mix(_span_hashes(data, starts, ends))
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        if ends[at] - low > _BLOCK:
            hashes[at] = _long_hash(data[low : ends[at]].tobytes())
            to = at + 1
        else:
            hashes[at:to] = _span_hashes(
                data[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low
            )
        at = to
    return starts, ends, mix(hashes)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _DOWN[starts]


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width``-word shingles in order; fewer words make one, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    take = min(width, n)
    out = hashes[: n - take + 1] + np.uint64(take)
    for i in range(1, take):
        out = out * np.uint64(_BASE) + hashes[i : n - take + 1 + i]
    return mix(out)


def code_point_starts(raw: bytes) -> np.ndarray:
    """Byte offset of every code point."""
    return np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)


def batches(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in iterator if b.num_rows)


def folded(raw: bytes) -> np.ndarray:
    """Bytes of a text with A-Z in lower case."""
    return _LOWER[np.frombuffer(raw, np.uint8)]
