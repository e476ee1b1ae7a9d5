"""Packing of documents into sequences, shortest pack first over the length histogram.

Documents are cut into full pieces and one remainder.  Only the histogram of piece
lengths (one count per length) goes to the driver, where lengths are placed longest first
into the shortest open pack, whole counts at a time.  The resulting patterns go back to
the pieces by each piece's rank among those of its length; ranks come from counts per
length and salt, so a length that a third of all pieces share is many small groups.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import batches, parts
from meterloom.llm.tokens import encoder, vocabulary_path
from meterloom.session import stage

SIZE, END = 1024, 0


def cut(docs: DataFrame, size: int = SIZE, path: str | None = None, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of every document.

    A document's ids are those of its whole text, then ``end``; null text is empty.
    """
    path = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches(iterator):
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    if keep_ids:
                        kept.append(piece.astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
            columns += [pa.array(kept, pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids,
    )


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Packs as ``(lengths, how many)``: longest lengths first, each into the shortest pack.

    Every step uses up either a length's count or a pattern's, so there are at most two
    steps and one more pattern per length.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by space left
    spaces: list[int] = []
    done = []

    def add(space: int, lengths: tuple[int, ...], count: int) -> None:
        if space == 0:
            done.append((lengths, count))
            return
        if space not in open_:
            open_[space] = []
            bisect.insort(spaces, space)
        open_[space].append((lengths, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if not spaces or spaces[-1] < length:
                add(size - length, (length,), left)
                break
            space = spaces[-1]
            lengths, count = open_[space].pop()
            if not open_[space]:
                del open_[space]
                spaces.pop()
            used = min(left, count)
            if used < count:
                add(space, lengths, count - used)
            add(space - length, (*lengths, length), used)
            left -= used
    return done + [p for space in spaces for p in open_[space]]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows ``first rank, first sequence, offset``: ranks from the first on sit
    in consecutive sequences at that offset, up to the next row's first rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, count in packs:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 among the pieces of a length, without a task per length."""
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts(pieces.sparkSession, 16)))
    salted = pieces.withColumn("salt", salt)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .select(
            F.col("length").alias("of_length"),
            F.col("salt").alias("of_salt"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        )
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return (
        salted.withColumn("own", F.row_number().over(inside) - 1)
        .join(counts, (F.col("length") == F.col("of_length")) & (F.col("salt") == F.col("of_salt")))
        .withColumn("rank", F.col("own") + F.col("before"))
        .drop("of_length", "of_salt", "before", "own", "salt")
    )


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``length``; pieces should be a written table."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = slots(patterns(histogram, size))
    rows = ranked(pieces)

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length):
                of = np.flatnonzero(length == one)
                table = where[int(one)]
                slot = table[np.searchsorted(table[:, 0], rank[of], "right") - 1]
                sequence[of] = slot[:, 1] + rank[of] - slot[:, 0]
                offset[of] = slot[:, 2]
            at = batch.schema.get_field_index("rank")
            batch = batch.set_column(at, "sequence_id", pa.array(sequence))
            yield batch.append_column("offset", pa.array(offset))

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return rows.select(*pieces.columns, F.col("rank").cast("long")).mapInArrow(
        run, ", ".join([*kinds, "sequence_id long", "offset long"])
    )


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``; sequences hold ``size`` ids at most.

    Empty and null texts are one piece of one id; repeated rows are packed each; no
    documents give no rows.
    """
    return place(stage(cut(docs, size, path, keep_ids=keep_ids), "pieces"), size)
