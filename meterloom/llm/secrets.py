"""Secret scanning with multipart credential linking, in DataFrame functions only.

Patterns find three base kinds (assignments, access identifiers, hex runs) and four weak
kinds (user names, short passwords, 40-character keys, endpoints).  A weak span counts
only beside complementary parts: an interval join between identifiers, secrets and
endpoints with at most ``reach`` code points between them in one scope (text between blank
lines), not counting what parts cover, so long values use up nothing.  It runs as a range
frame over the sorted parts of a scope, so a scope full of parts costs no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REACH = 200

# The base patterns.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # runs are maximal, so 18 characters in all
HEX = r"[0-9a-f]{16,}"
BASE = ("assign", "access", "hex")

# Weak kinds: reported only when linked.
USER = (
    r"""(?i:user_?name|user|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?"""
    r"""[A-Za-z0-9@._-]{3,}"""
)
KEY = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\s"'<>]*"""
WEAK_LEAST = 6
KINDS = (*BASE, "user", "password", "key", "endpoint")
IDENTIFIER, SECRET = ("access", "user"), ("assign", "hex", "password", "key")

_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "user": USER, "key": KEY, "endpoint": ENDPOINT}
_LITERAL = {"access": "AKIA", "endpoint": "://"}
_BLANK_LINE = r"\n[ \t\r]*\n"


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind with the length and the blank lines of the text before each."""
    pattern = F.lit(_PATTERNS[kind])
    some = text.rlike(_PATTERNS[kind])
    if kind in _LITERAL:
        some = text.contains(_LITERAL[kind]) & some
    gaps = F.transform(
        F.split(text, _PATTERNS[kind], -1),
        lambda g: F.struct(
            F.length(g).alias("chars"), (F.size(F.split(g, _BLANK_LINE, -1)) - 1).alias("breaks")
        ),
    )
    return F.when(
        some,
        F.struct(
            F.lit(kind).alias("kind"),
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"),
            gaps.alias("gaps"),
        ),
    )


def find(docs: DataFrame) -> DataFrame:
    """Parts ``doc_id, text_hash, kind, start, end, scope`` of every text, weak ones unlinked.

    Equal rows (same id and text) give their parts once.  Short assignments become the
    weak kind ``password``; below ``WEAK_LEAST`` characters they are dropped.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = F.array(*[_found(F.col("text"), kind) for kind in _PATTERNS])
    hits = (
        docs.select("doc_id", text.alias("text"))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(kinds).alias("hit"))
        .where(F.col("hit").isNotNull())
        .select("doc_id", "text_hash", "hit.*")
    )
    once = hits.groupBy("doc_id", "text_hash", "kind").agg(
        F.first("matches").alias("matches"), F.first("gaps").alias("gaps")
    )
    rows = once.select(
        "doc_id",
        "text_hash",
        "kind",
        F.posexplode(
            F.arrays_zip(F.col("matches"), F.slice("gaps", F.lit(1), F.size("matches")).alias("gap"))
        ).alias("pos", "part"),
    ).select(
        "doc_id",
        "text_hash",
        "kind",
        "pos",
        F.col("part.matches").alias("match"),
        F.col("part.gap.chars").alias("chars"),
        F.col("part.gap.breaks").alias("breaks"),
    )
    along = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("pos")
    size = F.length("match")
    value = F.length(F.regexp_extract("match", ASSIGN, 2))
    end = F.sum(F.col("chars") + size).over(along)
    return (
        rows.select(
            "doc_id",
            "text_hash",
            F.when((F.col("kind") == "assign") & (value < ASSIGN_LEAST), "password")
            .otherwise(F.col("kind"))
            .alias("kind"),
            (end - size).alias("start"),
            end.alias("end"),
            F.sum("breaks").over(along).alias("scope"),
            F.when(F.col("kind") == "assign", value).otherwise(WEAK_LEAST).alias("value"),
            F.when(
                F.col("kind") == "key",
                F.col("match").rlike("[a-z]") & F.col("match").rlike("[A-Z]") & F.col("match").rlike("[0-9]"),
            )
            .otherwise(True)
            .alias("mixed"),
        )
        .where((F.col("value") >= WEAK_LEAST) & F.col("mixed"))
        .drop("value", "mixed")
    )


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Adds ``linked``: complementary parts lie within ``reach`` uncovered code points in the scope.

    Identifiers need a secret, secrets an identifier or an endpoint, endpoints both.
    """
    scope = Window.partitionBy("doc_id", "text_hash", "scope")
    before = scope.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    added = F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))
    over = F.coalesce(F.sum("added").over(before), F.lit(0)) - F.greatest(F.col("reached") - F.col("start"), F.lit(0))
    # uncovered code points before a part are as many at its start as at its end
    parts = parts.withColumn("reached", reached).withColumn("added", added).withColumn("clear", F.col("start") - over)
    near = scope.orderBy("clear").rangeBetween(-reach, reach)
    count = lambda kinds: F.sum(F.col("kind").isin(*kinds).cast("long")).over(near)
    kind = F.col("kind")
    return (
        parts.withColumns({"ids": count(IDENTIFIER), "secrets": count(SECRET), "ends": count(("endpoint",))})
        .withColumn(
            "linked",
            F.when(kind.isin(*IDENTIFIER), F.col("secrets") > 0)
            .when(kind.isin(*SECRET), (F.col("ids") > 0) | (F.col("ends") > 0))
            .otherwise((F.col("ids") > 0) & (F.col("secrets") > 0)),
        )
        .drop("ids", "secrets", "ends", "reached", "added", "clear")
    )


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Spans of every document: ``doc_id, spans`` with ``kind, start, end, linked``.

    One row per input row, also for null and empty texts (no spans) and repeated rows.
    Spans are ordered by start, then kind as listed in ``KINDS``; the base kinds always
    count, weak kinds only when linked.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    reported = (
        link(find(docs), reach)
        .where(F.col("kind").isin(*BASE) | F.col("linked"))
        .groupBy("doc_id", "text_hash")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "kind", "end", "linked"))),
                lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["linked"].alias("linked")),
            ).alias("spans")
        )
        .withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    )
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))
    return rows.join(
        reported,
        F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")),
        "left",
    ).select("doc_id", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:bigint,end:bigint,linked:boolean>>")).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
