"""Near duplicates by minhash with tensored banding, links confirmed on whole shingle sets.

Two collections of ``TABLES`` tuples of ``ROWS`` minhashes each are combined: table (i, j)
is keyed by tuple i of the first and tuple j of the second collection.  That gives
TABLES x TABLES tables of 2 x ROWS hashes from only 2 x TABLES x ROWS minhashes (200 for
400 tables of 10).  Two sets of similarity s meet in some table with probability
(1 - (1 - s^ROWS)^TABLES)^2: 0.9993 at 0.8, 0.05 at 0.42.

A key pair is formed only where each half already met another document, so a document
without near duplicates costs its 40 halves and nothing more.  Documents with equal sets
count as one throughout.  In a bucket each member is first held against its most
connected member, one link per document is confirmed, and components are formed; then
only pairs of different components that still share a bucket are compared: by
join in small buckets, tile by tile in large ones.  So a group of copies
costs links in proportion to its size, and no link between components is left untested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import batches, mix, raw_texts, shingles, words
from meterloom.llm.components import components
from meterloom.session import stage

WIDTH, PERCENT = 5, 80  # words of a shingle; least similarity in hundredths
ROWS, TABLES = 5, 20
SMALL = 8  # members up to which a bucket's open pairs are joined row by row
TILE = 512  # members of a tile of larger buckets
_HASHES = 2 * ROWS * TABLES
# Estimates from 200 hashes deviate by 0.028 at 0.8; this margin is three and a half times that.
_MARGIN = 0.1

_seeds = mix(np.arange(1, 2 * _HASHES + 1, dtype=np.uint64))
_A = (_seeds[:_HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_seeds[_HASHES:] >> np.uint64(32)).astype(np.uint32)


def signature(found: np.ndarray) -> np.ndarray:
    """Minhashes of a non-empty set of 64-bit shingle hashes."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        h = x[at : at + 512, None] * _A
        h += _B
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def halves(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per tuple: the first collection's tuples, then the second's."""
    tuples = sig.reshape(2 * TABLES, ROWS).astype(np.uint64)
    keys = np.arange(2 * TABLES, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + tuples[:, i])
    return keys.view(np.int64)


_SKETCH = "text_hash long, n_shingles long, node long, halves array<long>, sig binary"


def sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Text hash, set size, node (64 bits of the set's digest), half keys and signature of every text.

    The signature keeps 16 bits of each minhash; a text without words has no node.  Ids keep their type.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            n, nodes, keys, sigs = [], [], [], []
            for raw in raw_texts(batch.column("text")):
                found = np.unique(shingles(words(raw)[2], width))
                n.append(len(found))
                if not len(found):
                    nodes.append(None)
                    keys.append(None)
                    sigs.append(None)
                    continue
                digest = hashlib.blake2b(found.tobytes(), digest_size=8).digest()
                nodes.append(int.from_bytes(digest, "little", signed=True))
                sig = signature(found)
                keys.append(halves(sig))
                sigs.append(sig.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(n, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sigs, pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "node", "halves", "sig"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, {_SKETCH}")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``node, shingles``: whole shingle sets as 64-bit hashes, of rows ``node, text``."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            found = [np.unique(shingles(words(raw)[2], width)).view(np.int64) for raw in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``u, v`` whose whole sets reach the similarity."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return (
        pairs.join(left, "u")
        .join(right, "v")
        .select("u", "v", both.alias("both"), (F.size("su") + F.size("sv")).alias("total"))
        .where(F.lit(100) * F.col("both") >= percent * (F.col("total") - F.col("both")))
        .select("u", "v")
    )


def _least_same(percent: int) -> int:
    return int(_HASHES * (percent / 100 - _MARGIN))


def _similar(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimated similarity lies within the margin."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            su, sv = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, _HASHES) for c in ("su", "sv")
            )
            yield batch.filter(pa.array((su == sv).sum(axis=1) >= _least_same(percent))).select(["u", "v"])

    return (
        pairs.join(signatures.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u")
        .join(signatures.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")
        .mapInArrow(run, "u long, v long")
    )


def buckets(nodes: DataFrame) -> DataFrame:
    """``key, first, node, n, size`` rows of every bucket in which a node meets another one.

    ``first`` is the key's half from the first collection.
    """
    half = nodes.select("node", F.posexplode("halves").alias("at", "half"))
    met = half.groupBy("half").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    live = (
        half.join(met.select("half"), "half")
        .groupBy("node")
        .agg(
            F.collect_set(F.when(F.col("at") < TABLES, F.col("half"))).alias("firsts"),
            F.collect_set(F.when(F.col("at") >= TABLES, F.col("half"))).alias("seconds"),
        )
        .where((F.size("firsts") > 0) & (F.size("seconds") > 0))
    )
    keyed = (
        live.join(nodes.select("node", "n"), "node")
        .select("node", "n", "seconds", F.explode("firsts").alias("first"))
        .select("node", "n", "first", F.explode(F.transform("seconds", lambda s: F.xxhash64("first", s))).alias("key"))
    )
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return keyed.join(sizes, "key")


def first_pairs(shared: DataFrame) -> DataFrame:
    """One pair ``u, v`` a node: the head of the most buckets it is in.

    A bucket's head is the member that meets most others over all its buckets: among the
    copies of a text that is the text itself, which is nearer to all than they are to
    each other.
    """
    weight = shared.groupBy(F.col("node").alias("of")).agg(F.sum("size").alias("weight"))
    weighed = shared.join(weight, F.col("node") == F.col("of"))
    heads = weighed.groupBy(F.col("key").alias("in_key")).agg(F.max(F.struct("weight", "node")).alias("head"))
    return (
        shared.join(heads, F.col("key") == F.col("in_key"))
        .where("node <> head.node")
        .groupBy("node", F.col("head.node").alias("v"))
        .agg(F.count("*").alias("tables"))
        .groupBy("node")
        .agg(F.max_by("v", F.struct("tables", "v")).alias("v"))
        .select(F.col("node").alias("u"), "v")
    )


def _family_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` between components among ``first, node, n, component`` rows.

    Rows that share ``first`` make a family, and so do those that others connect: members
    of one bucket are always in one.  Its largest component needs no
    comparison within itself; all other members are held against the whole family once,
    tile against tile: estimates first, then whole sets within the margin.  Only confirmed
    links leave a task.
    """
    lowest = members.groupBy("first").agg(F.min("node").alias("v"))
    edges = members.join(lowest, "first").select(F.col("node").alias("u"), "v")
    families = components(edges).withColumnRenamed("component", "family")
    rows = members.select("node", "n", "component").distinct().join(families, "node")
    parts_ = rows.groupBy("family", "component").agg(F.count("*").alias("many"))
    sizes = parts_.groupBy(F.col("family").alias("of")).agg(
        F.max_by("component", F.struct("many", "component")).alias("biggest"),
        F.max("many").alias("big"),
        F.sum("many").alias("all"),
    )
    minor_tiles = F.ceil((F.col("all") - F.col("big")) / TILE).cast("int")
    rows = rows.join(sizes.withColumn("minors", minor_tiles).withColumn("bigs", F.ceil(F.col("big") / TILE).cast("int")), F.col("family") == F.col("of"))
    minor = F.col("component") != F.col("biggest")
    hash_ = F.xxhash64("node")
    tile = F.when(minor, F.pmod(hash_, F.col("minors"))).otherwise(F.col("minors") + F.pmod(hash_, F.col("bigs"))).cast("int")
    last = F.when(minor, F.col("minors") + F.col("bigs")).otherwise(F.col("minors")) - 1
    rows = (
        rows.withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select(
            "family", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "n", "component"
        )
        .join(nodes.select("node", "sig"), "node")
        .join(sets, "node")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iat[0], pdf["high"].iat[0]
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), _HASHES)
        node, n, comp, tile, whole = (pdf[c].to_numpy() for c in ("node", "n", "component", "tile", "shingles"))
        right = np.flatnonzero(tile == high)
        out = []
        for a in np.flatnonzero(tile == low):
            open_ = right[(comp[right] != comp[a]) & ((node[right] > node[a]) if low == high else True)]
            open_ = open_[100 * np.minimum(n[open_], n[a]) >= percent * np.maximum(n[open_], n[a])]
            if not len(open_):
                continue
            near = open_[(sig[open_] == sig[a]).sum(axis=1) >= _least_same(percent)]
            for b in near:
                both = len(np.intersect1d(whole[a], whole[b], assume_unique=True))
                if 100 * both >= percent * (n[a] + n[b] - both):
                    out.append((node[a], node[b]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return rows.groupBy("family", "low", "high").applyInPandas(compare, "u long, v long")


def _open_links(shared: DataFrame, groups: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` between different components that share a bucket."""
    named = stage(
        shared.join(groups.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(
            "key", "first", "node", "n", "size", F.coalesce("component", "node").alias("component")
        ),
        "bucket-components",
    )
    mixed = (
        named.groupBy("key", "first", "size")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
    )
    few = named.where(F.col("size") <= SMALL).join(mixed.select("key"), "key")
    crowded = mixed.where(F.col("size") > SMALL).select("first").distinct()
    many = named.select("first", "node", "n", "component").distinct().join(crowded, "first", "left_semi")
    many = stage(many, "open-members")
    side = lambda a: few.select("key", F.col("node").alias(a), F.col("n").alias(f"n{a}"), F.col("component").alias(f"c{a}"))
    small = (
        side("u")
        .join(side("v"), "key")
        .where(
            (F.col("u") < F.col("v"))
            & (F.col("cu") != F.col("cv"))
            & (F.lit(100) * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
        )
        .select("u", "v")
        .distinct()
    )
    links = confirmed(_similar(small, nodes.select("node", "sig"), percent), sets, percent)
    return links if many.isEmpty() else links.unionByName(_family_links(many, nodes, sets, percent))


def linked(nodes: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``node, component`` of all nodes that are linked to another one.

    ``nodes``: ``node, n, halves, sig`` once each; ``texts``: ``node, text`` of the nodes.
    """
    shared = stage(buckets(nodes), "buckets")
    some = stage(shared.select("node").distinct(), "near")
    sets = stage(shingle_sets(texts.join(some, "node", "left_semi"), width), "sets")
    first = stage(confirmed(first_pairs(shared), sets, percent), "links")
    groups = stage(components(first), "components")
    more = stage(_open_links(shared, groups, nodes, sets, percent), "links")
    if more.isEmpty():
        return groups
    return stage(components(first.unionByName(more)), "components")


def _decisions(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, survivor`` of every row.

    The survivor of a component is its row of smallest id, then smallest text hash; only a
    component without any id has a survivor without one.  ``survivor`` holds for repeats of
    that row too, and for every text without shingles.
    """
    rows = stage(sketch(docs, width), "sketches")
    # a set's sketch and text come from the row of its smallest id, of several texts the one of smallest hash
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    owners = rows.where("n_shingles > 0").groupBy(F.col("node").alias("of")).agg(smallest.alias("least"))
    owners = owners.select("of", F.col("least.doc_id").alias("owner"), F.col("least.text_hash").alias("owner_hash"))
    owners = stage(owners, "owners")
    own = F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("text_hash") == F.col("owner_hash"))
    nodes = rows.join(owners, (F.col("node") == F.col("of")) & own, "left_semi")
    nodes = stage(nodes.select("node", F.col("n_shingles").alias("n"), "halves", "sig"), "nodes")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(owners.withColumnRenamed("of", "node"), own).select("node", "text")
    if nodes.count() > owners.count():  # repeated rows
        nodes, texts = nodes.dropDuplicates(["node"]), texts.dropDuplicates(["node"])
    groups = linked(nodes, texts, width, percent)
    named = owners.join(groups, F.col("of") == F.col("node"), "left").select(
        "of", "owner", "owner_hash", F.coalesce("component", "of").alias("component")
    )
    smallest = F.min(F.struct(F.col("owner").isNull().alias("no_id"), "owner", "owner_hash"))
    one = named.groupBy(F.col("component").alias("group")).agg(smallest.alias("first"))
    of = named.join(one, F.col("component") == F.col("group")).select("of", "first")
    alone = F.col("node").isNull()
    survivor = F.col("doc_id").eqNullSafe(F.col("first.owner")) & (F.col("text_hash") == F.col("first.owner_hash"))
    return rows.join(of, F.col("node") == F.col("of"), "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.owner")).alias("component_id"),
        (alone | survivor).alias("survivor"),
    )


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Rows with equal sets belong together, and so do all that confirmed links connect; the
    component is its smallest doc_id and only that document is kept.  Null and empty texts
    have no shingles, are linked with nothing and stay.  Rows without an id take part: one
    beside a document with an id is not kept, a component without any id is.
    """
    return (
        _decisions(docs, width, percent)
        .select("doc_id", "n_shingles", "component_id")
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each component.

    A row is known by its id, null or not, and its text, so different texts under one id
    are decided each for itself.  Of repeated rows any one stays; all rows whose text has
    no shingles do.  Ids may be of any type that can be ordered; other columns of any name.
    """
    rows = stage(_decisions(docs, width, percent), "decisions").where("n_shingles > 0")
    key = [F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")]
    own = F.col("whole.doc_id").eqNullSafe(F.col("key.id")) & (F.xxhash64("whole.text") == F.col("key.hash"))
    gone = rows.where("NOT survivor").select(*key).distinct()
    left = docs.alias("whole").join(gone.alias("key"), own, "left_anti")
    twice = rows.where("survivor").groupBy(*key).count().where("count > 1").drop("count")
    if twice.isEmpty():
        return left
    one = (
        left.alias("whole")
        .join(twice.alias("key"), own, "left_semi")
        .select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        .groupBy(F.col("row.doc_id"), F.xxhash64("row.text"))
        .agg(F.any_value("row").alias("row"))
    )
    return left.alias("whole").join(twice.alias("key"), own, "left_anti").unionByName(one.select("row.*"))
