"""Token counts per section: whole documents are encoded once, tokens go to sections by span.

Tokens of a byte-level vocabulary cover a text without gaps, so their ends are running
sums of their sizes.  Both tokens and sections are sorted; the interval join of a
document is two binary searches per section, and it needs no shuffle.  A token that
crosses a boundary is allocated by a rule:

``majority``  to the section with most of its bytes, the earlier one on a tie
``first``     to the section with its first byte
``last``      to the section with its last byte

Beside the whole count, ``split_tokens`` gives each section its exact share of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import arrow_batch, batches, code_point_starts
from meterloom.llm.tokens import encoder, vocabulary_path

RULES = ("majority", "first", "last")


def line_ends(raw: bytes) -> np.ndarray:
    """Byte ends of the lines of a text, each with its line end."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def sentence_ends(raw: bytes) -> np.ndarray:
    """Byte ends of the sentences of a text: after a line end, or white space behind ``.!?``."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(1, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    stop = (data == 33) | (data == 46) | (data == 63)
    at_end = data == 10
    at_end[1:] |= space[1:] & stop[:-1]
    at_end[-1] = True
    return np.flatnonzero(at_end) + 1


SECTIONS = {"line": line_ends, "sentence": sentence_ends}


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "majority"):
    """Per section: tokens by ``rule``, tokens that cross one of its boundaries, byte shares.

    Sections are consecutive from byte 0 and cover all tokens; empty ones get nothing.
    """
    n = len(section_ends)
    if not len(token_ends):
        zero = np.zeros(n, np.int64)
        return zero, zero.copy(), np.zeros(n)
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    to = first if rule == "first" else last
    crossing = np.flatnonzero(first != last)
    if rule == "majority":
        to = first.copy()
    whole = np.bincount(first[first == last], minlength=n)
    cross, split = np.zeros(n, np.int64), whole.astype(float)
    two = crossing[last[crossing] == first[crossing] + 1]
    if len(two):
        a, b = first[two], last[two]
        size = token_ends[two] - starts[two]
        left = section_ends[a] - starts[two]
        cross += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        split += np.bincount(a, left / size, n) + np.bincount(b, (size - left) / size, n)
        if rule == "majority":
            to[two] = np.where(2 * left >= size, a, b)
    for t in crossing[last[crossing] > first[crossing] + 1]:  # rare: tokens over three sections
        bounds = np.arange(first[t], last[t] + 1)
        high = np.minimum(section_ends[bounds], token_ends[t])
        low = np.maximum(np.concatenate(([0], section_ends))[bounds], starts[t])
        shares = high - low
        cross[bounds[shares > 0]] += 1
        split[bounds] += shares / (token_ends[t] - starts[t])
        if rule == "majority":
            to[t] = bounds[np.argmax(shares)]
    return np.bincount(to, minlength=n), cross, split


_SCHEMA = pa.schema(
    [
        ("row", pa.int64()),
        ("section", pa.int64()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_crossing", pa.int64()),
        ("split_tokens", pa.float64()),
        ("doc_tokens", pa.int64()),
    ]
)


def by_section(
    docs: DataFrame, sections: str = "sentence", rule: str = "majority", path: str | None = None
) -> DataFrame:
    """Token counts of every line or sentence of every text.

    ``doc_id, section, start, end`` (code points, end exclusive, the white space that ends
    a section included), ``n_tokens, n_crossing, split_tokens, doc_tokens``.  A document's ``n_tokens`` add up
    to its ``doc_tokens``.  Null and empty texts have one empty section.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text, F.lit(None).cast("array<long>").alias("sizes"))
    return _counted(rows, rule, path, SECTIONS[sections])


def by_field(docs: DataFrame, fields: list[str], separator: str = "\n", rule: str = "majority", path: str | None = None) -> DataFrame:
    """Token counts of fields that are encoded as one text, joined by ``separator``.

    The section is the field's place in ``fields``; a separator belongs to the field
    before it.  Null fields are empty.
    """
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    joined = F.concat_ws(separator, *values)
    lengths = [F.octet_length(F.concat(v, F.lit(separator)) if i < len(fields) - 1 else v).cast("long") for i, v in enumerate(values)]
    return _counted(docs.select("doc_id", joined.alias("text"), F.array(*lengths).alias("sizes")), rule, path)


def _counted(rows: DataFrame, rule: str, path: str | None, cut=line_ends) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or vocabulary_path()
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches(iterator):
            out: dict[str, list] = {name: [] for name in _SCHEMA.names}
            for i, (text, sizes) in enumerate(zip(batch.column("text").to_pylist(), batch.column("sizes").to_pylist())):
                raw = text.encode()
                ends = cut(raw) if sizes is None else np.cumsum(sizes)
                points = np.searchsorted(code_point_starts(raw), ends, "left")
                tokens = encode.ends(encode.ids(text))
                counts, cross, split = allocate(tokens, ends, rule)
                out["row"].append(np.full(len(ends), i))
                out["section"].append(np.arange(len(ends)))
                out["start"].append(np.concatenate(([0], points[:-1])))
                out["end"].append(points)
                out["n_tokens"].append(counts)
                out["n_crossing"].append(cross)
                out["split_tokens"].append(split)
                out["doc_tokens"].append(np.full(len(ends), len(tokens)))
            made = arrow_batch(_SCHEMA, {k: np.concatenate(v) for k, v in out.items()})
            yield made.set_column(0, "doc_id", batch.column("doc_id").take(made.column("row")))

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long,"
        " split_tokens double, doc_tokens long",
    )
