"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds (email, ip, card, phone) are reported whenever pattern and checksum hold.
Further kinds (iban by mod-97, ssn by its number ranges) are reported when their score,
raised by context words shortly before or after the span, reaches a threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD, REACH = 0.6, 48

# Scores without context, and words that raise them.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "hostname", "address", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"),
}
BOOST = 0.25
# Context counts by whole words in any case, a plural s aside: "ip" is not in "script".
_CONTEXT = {
    kind: re.compile(rf"(?<![^\W\d_])({'|'.join(known)})s?(?![^\W\d_])", re.IGNORECASE) for kind, known in CONTEXT.items()
}

# An address is found from its @: the local part is the run of its characters before.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its first digit fails at each, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")
_IBAN_END = re.compile(r"(?![A-Za-z0-9])")
# Characters of an account number by country, from the public registry.
_IBAN_LENGTHS = """
15 NO 16 BE 18 DK FK FI FO GL NL SD 19 MK SI 20 AT BA EE KZ LT LU MN XK 21 CH CR HR LI LV
22 BG BH DE GB GE IE ME RS 23 AE GI IL IQ OM SO TL 24 AD CZ ES MD PK RO SA SE SK TN VG 25 LY PT ST
26 IS TR 27 BI DJ FR GR IT MC MR SM 28 AL AZ BY CY DO GT HN HU LB NI PL SV 29 BR EG PS QA UA 30 JO KW MU YE
31 MT SC 32 LC 33 RU
"""
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_NOT_DIGITS = re.compile("[^0-9]+")
_LENGTH_OF: dict[str, int] = {}
for _word in _IBAN_LENGTHS.split():
    if _word.isdigit():
        _size = int(_word)
    else:
        _LENGTH_OF[_word] = _size
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(_DOUBLED[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether country code and check digits, moved to the end, leave 1 modulo 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor = 0
    for m in _DOMAIN.finditer(text):
        start, size = m.start(), 64
        while True:  # widen until the run of local characters ends inside the window
            low = max(floor, m.start() - size)
            start = low + len(text[low : m.start()].rstrip(_LOCAL))
            if start > low or low == floor:
                break
            size *= 4
        if start < m.start():
            yield start, m.end()
            floor = m.end()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: of the country's length or the longest run, else, in other countries, any shorter one."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 4  # a failed candidate may hold the start of another
        ends = [i + 1 for i in range(m.start(), m.end()) if text[i] != " "]
        whole = [n for n in range(min(len(ends), 34), 14, -1) if _IBAN_END.match(text, ends[n - 1])]
        own = _LENGTH_OF.get(text[m.start() : m.start() + 2])
        for n in whole if own is None else [n for n in whole if n == own] + whole[:1]:
            if mod97(text[m.start() : ends[n - 1]].replace(" ", "")):
                yield m.start(), ends[n - 1]
                at = ends[n - 1]
                break


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind, per kind leftmost and not overlapping."""
    if "@" in text:
        yield from (("email", *span) for span in _emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 if len(p) <= 3 else int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                yield "phone", m.start(), m.end()
    yield from (("iban", *span) for span in _ibans(text))
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    """Prior of the kind, raised by each of its context words shortly before or after the span, to 1 at most."""
    stop = min(len(text), end + REACH)
    while end < stop < len(text) and text[stop].isalpha() and text[stop - 1].isalpha():
        stop -= 1  # a word that reaches beyond is not judged by its beginning
    near = (m for window in ((max(0, start - REACH), start), (end, stop)) for m in _CONTEXT[kind].finditer(text, *window))
    return min(1.0, PRIOR[kind] + BOOST * len({m.group(1).lower() for m in near}))


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by start, then kind as listed in ``KINDS``."""
    found = [(k, s, e, score(text, k, s, e)) for k, s, e in candidates(text)]
    kept = [x for x in found if x[0] in BASE or x[3] >= threshold]
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, spans`` of every row; null and empty texts have none, repeated rows stay."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            found = [
                [dict(zip(("kind", "start", "end", "score"), s)) for s in spans(t or "", threshold)]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {_SPAN_SQL}")


def mask(text: str, threshold: float = THRESHOLD) -> str:
    """Spans replaced by their kind in brackets; overlapping spans become one, named by the first."""
    out, at, shown = [], 0, 0
    for kind, start, end, _ in spans(text, threshold):
        if start >= at:
            out += [text[shown:start], f"[{kind.upper()}]"]
        at = shown = max(at, end)
    return "".join(out) + text[shown:] if out else text


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns with personal data masked in ``text``; null stays null."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            texts = [None if t is None else mask(t, threshold) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def joined(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
