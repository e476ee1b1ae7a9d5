"""Toxicity by non-negative positive-unlabelled learning.

Learns from documents confirmed as toxic and from unlabelled text.  With the share
``prior`` of toxic documents among all, the risk of a classifier is estimated as
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): the second part, the risk on clean
text, must not turn negative, and where a batch makes it so, the step goes the other way.

Features are hashed whole words, word beginnings and, in words beyond ASCII or of great
length, character runs that a text contains.  Only features that
confirmed texts have significantly more often than unlabelled ones, and whose estimated
precision prior * P(feature | toxic) / P(feature) is high enough, take part; they count
as evidence for toxicity only.  Training runs in numpy over a bounded sample (the ids with
the smallest hashes) of which just the chosen features reach the driver; scoring runs over
every whole text in tasks, with one weight for each chosen feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import batches, code_point_starts, folded, held_out, mix, raw_texts, words
from meterloom.session import stage

SPACE_BITS = 20
PREFIXES = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12)  # bytes of word beginnings beside the whole word
RUNS, LONG = (2, 3, 4), 24  # characters of runs inside words beyond ASCII or of more than LONG bytes
POSITIVES, UNLABELLED = 4000, 8000  # bounds of the training sample
LEAST_Z, LEAST_PRECISION, LEAST_DOCS = 4.0, 0.3, 3
THRESHOLD = 0.7
MODULUS, HELD_OUT = 3, 1

_BETWEEN = np.ones(256, bool)  # words are letters and all bytes beyond ASCII
_BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _tokens(raw: bytes) -> np.ndarray:
    """Feature numbers of all words, word beginnings and character runs of a text.

    Words of any length are hashed whole.  Scripts without spaces write whole sentences as one
    word, so words with characters beyond ASCII, and all of more than ``LONG`` bytes, give their
    runs of 2 to 4 characters too.
    """
    starts, ends, whole = words(raw, between=_BETWEEN)
    if not len(starts):
        return np.empty(0, np.uint32)
    data = folded(raw)
    length = ends - starts
    out = [_slot(whole, 0)]
    value = np.full(len(starts), 0x51ED270B, np.uint64)
    live = np.arange(len(starts))
    for i in range(PREFIXES[-1]):
        live = live[length[live] > i]
        value[live] = value[live] * np.uint64(0x9E3779B97F4A7C15) + data[starts[live] + i] + np.uint64(1)
        if i + 1 in PREFIXES:
            out.append(_slot(value[live], 1 + PREFIXES.index(i + 1)))
    before = np.concatenate([[0], np.cumsum(data >= 128)])
    chosen = (before[ends] > before[starts]) | (length > LONG)
    return np.concatenate(out + _runs(raw, data, starts, ends, chosen))


def _runs(raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of all runs of ``RUNS`` characters inside the chosen words."""
    if not chosen.any():
        return []
    at = code_point_starts(raw)
    size = np.diff(at, append=len(data))
    word = np.searchsorted(starts, at, "right") - 1
    inside = (word >= 0) & (at < ends[word]) & chosen[word]
    at, size, word = at[inside], size[inside], word[inside]
    char = data[at].astype(np.uint64)
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        char[more] = char[more] * np.uint64(256) + data[at[more] + i]
    out, value = [], char.copy()
    for n in range(2, RUNS[-1] + 1):
        value = value[:-1] * np.uint64(0x9E3779B97F4A7C15) + char[n - 1 :] + np.uint64(1)
        if n in RUNS:
            out.append(_slot(value[word[: len(value)] == word[n - 1 :]], 1 + len(PREFIXES) + RUNS.index(n)))
    return out


def _slot(value: np.ndarray, kind: int) -> np.ndarray:
    """Feature number; number 0 stands for no feature."""
    hashed = mix(value + np.uint64(kind * 0xD1B54A32D192ED03 & 2**64 - 1)) >> np.uint64(64 - SPACE_BITS)
    return np.maximum(hashed, np.uint64(1)).astype(np.uint32)


def features(raw: bytes) -> np.ndarray:
    """Distinct feature numbers of a text."""
    return np.unique(_tokens(raw))


@dataclass
class Model:
    """Chosen features with their weights, and the logit of a text without any."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(1 << SPACE_BITS, np.float64)
        table[self.numbers] = self.weights
        return table

    def score(self, raw: bytes, table: np.ndarray) -> float:
        found = _tokens(raw)
        hit = np.unique(found[table[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + table[hit].sum(), -50, 50))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class Texts:
    """Chosen features of texts, numbered from 0: feature and text of every entry, number of texts."""

    feature: np.ndarray
    text: np.ndarray
    n: int

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Texts:
        sizes = [len(t) for t in lists]
        return cls(np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(lists)), sizes), len(lists))

    def logits(self, values: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.text, values[self.feature], self.n)

    def gradient(self, slope: np.ndarray, scales: np.ndarray) -> np.ndarray:
        """Of the weights and the bias, from the slope by each text's logit."""
        return np.append(np.bincount(self.feature, slope[self.text] * scales[self.feature], len(scales)), slope.sum())


def risk(
    weights: np.ndarray, bias: float, scales: np.ndarray, positives: Texts, unlabelled: Texts, prior: float
) -> tuple[float, float, np.ndarray]:
    """``confirmed, clean, slope``: both parts of the risk with the logistic loss and the step's slope.

    ``confirmed`` is prior * R_p(+), ``clean`` is R_u(-) - prior * R_p(-).  The slope is that of
    their sum; where ``clean`` is below zero, that of ``-clean``, which leads back.
    """
    zp, zu = positives.logits(weights * scales, bias), unlabelled.logits(weights * scales, bias)
    confirmed = prior * np.logaddexp(0, -zp).mean()
    clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    slope = unlabelled.gradient(_sigmoid(zu) / unlabelled.n, scales) - positives.gradient(prior * _sigmoid(zp) / positives.n, scales)
    if clean < 0:
        return confirmed, clean, -slope
    return confirmed, clean, slope + positives.gradient(prior * (_sigmoid(zp) - 1) / positives.n, scales)


def train(
    scales: np.ndarray,
    positives: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    steps: int = 300,
    rate: float = 0.1,
    decay: float = 1e-3,
) -> tuple[np.ndarray, float]:
    """Weights (not negative) and bias that minimise the non-negative risk.

    A text is the list of its chosen features, numbered from 0; ``scales`` are their values.
    Steps use the whole sample; the result is the mean of the second half of them.
    """
    k = len(scales)
    p, u = Texts.of(positives), Texts.of(unlabelled)
    weights, bias = np.zeros(k), float(np.log(prior / (1 - prior)))
    mean, square, total, n = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1), 0
    for step in range(1, steps + 1):
        _, _, slope = risk(weights, bias, scales, p, u, prior)
        slope[:k] += decay * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = np.maximum(weights - move[:k], 0), bias - float(move[k])
        if step > steps // 2:
            total, n = total + np.append(weights, bias), n + 1
    return total[:k] / n, float(total[k] / n)


def _sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """``confirmed, drawn, numbers`` of the texts to learn from, at most the given numbers of each."""
    order = lambda c: (F.xxhash64(c), F.col(c))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("id")).distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).where("id IS NOT NULL")
    seen = ~held_out("id", MODULUS, HELD_OUT)
    drawn = ids.where(seen).distinct().orderBy(*order("id")).limit(unlabelled).withColumn("drawn", F.lit(True))
    known = ids.join(toxic.where(seen), "id", "left_semi").distinct().orderBy(*order("id")).limit(positives)
    chosen = known.withColumn("confirmed", F.lit(True)).join(drawn, "id", "full").select(
        "id", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.coalesce("drawn", F.lit(False)).alias("drawn")
    )

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            found = [features(raw).astype(np.int32) for raw in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("confirmed"), batch.column("drawn"), pa.array(found, pa.list_(pa.int32()))],
                names=["confirmed", "drawn", "numbers"],
            )

    # the chosen ids are bounded by the two parameters
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    return texts.select("confirmed", "drawn", "text").mapInArrow(run, "confirmed boolean, drawn boolean, numbers array<int>")


def _document_counts(sample: DataFrame) -> DataFrame:
    """``number, p, u``: confirmed and drawn texts with a feature, summed up in each task first."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, u = (np.zeros(1 << SPACE_BITS, np.int64) for _ in range(2))
        for batch in batches(iterator):
            for confirmed, drawn, numbers in zip(*(batch.column(c).to_pylist() for c in ("confirmed", "drawn")), batch.column("numbers")):
                numbers = numbers.values.to_numpy(zero_copy_only=False)
                p[numbers] += confirmed
                u[numbers] += drawn
        some = np.flatnonzero(p + u)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(p[some]), pa.array(u[some])], names=["number", "p", "u"])

    counts = sample.mapInArrow(run, "number long, p long, u long")
    return counts.groupBy("number").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> Model:
    """Model from the confirmed toxic and the unlabelled among documents that are not held out.

    ``prior`` is the share of toxic documents; by default that among the labelled rows that
    are not held out.  Without any confirmed text, every text scores the prior (0.0001 at
    least).  Null ids and null labels teach nothing.
    """
    if prior is None:
        rows = labels.where(~held_out("doc_id", MODULUS, HELD_OUT) & F.col("doc_id").isNotNull())
        prior = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    prior = float(np.clip(prior, 1e-4, 0.9))
    sample = stage(_sample(docs, labels, positives, unlabelled), "toxicity-sample")
    np_, nu = sample.agg(F.sum(F.col("confirmed").cast("long")), F.sum(F.col("drawn").cast("long"))).first()
    bias = float(np.log(prior / (1 - prior)))
    if not np_ or not nu:
        return Model(np.empty(0, np.int64), np.empty(0), bias)
    counts = _document_counts(sample).where(F.col("p") >= LEAST_DOCS)
    rate_p, rate_u = F.col("p") / F.lit(np_), F.col("u") / F.lit(nu)
    z = (rate_p - rate_u) / F.sqrt((F.col("p") + F.col("u") + 1) / F.lit(np_ + nu) * F.lit(1 / np_ + 1 / nu))
    precision = F.lit(prior) * rate_p * F.lit(nu) / (F.col("u") + 1)
    table = (
        counts.where((z > LEAST_Z) & (precision > LEAST_PRECISION))
        .select("number", F.log((rate_p + 1e-4) / (rate_u + 1e-4)).alias("scale"))
        .orderBy("number")
        .toPandas()
    )
    if table.empty:
        return Model(np.empty(0, np.int64), np.empty(0), bias)
    numbers, scales = table["number"].to_numpy(), table["scale"].to_numpy()

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            kept = []
            for row in batch.column("numbers"):
                own = row.values.to_numpy(zero_copy_only=False)
                at = np.searchsorted(numbers, own)
                at[at == len(numbers)] = 0
                kept.append(at[numbers[at] == own].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("confirmed"), batch.column("drawn"), pa.array(kept, pa.binary())],
                names=["confirmed", "drawn", "kept"],
            )

    rows = sample.mapInArrow(run, "confirmed boolean, drawn boolean, kept binary").collect()
    texts = [(r["confirmed"], r["drawn"], np.frombuffer(bytes(r["kept"]), np.int32)) for r in rows]
    weights, bias = train(scales, [t for c, _, t in texts if c], [t for _, d, t in texts if d], prior)
    return Model(numbers, weights * scales, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` (0 to 1) of every row; null and empty texts score the bias."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches(iterator):
            scores = [model.score(raw, table) for raw in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, that score below ``threshold``.

    Decided row by row: repeated rows and rows without an id stay or go by their text alone;
    null and empty texts score the bias, a score equal to the threshold goes.
    """

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches(iterator):
            keep = [model.score(raw, table) < threshold for raw in raw_texts(batch.column("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
