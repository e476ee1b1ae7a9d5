"""One query per corpus operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import (
    attribution,
    decontaminate,
    fingerprints,
    neardup,
    packing,
    periodic,
    pii,
    ppm,
    secrets,
    spelling,
    substrings,
    toxicity,
    warc,
)
from meterloom.llm.common import held_out, prepare, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _counts(kinds: tuple[str, ...]) -> list:
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [count(kind) for kind in kinds]


@query
def op1_fingerprints(spark, sf_dir):
    return fingerprints.against_next(_documents(spark, sf_dir))


@query
def op2_secrets(spark, sf_dir):
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return secrets.scan(_documents(spark, sf_dir)).select(
        "doc_id",
        *_counts(secrets.BASE),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["linked"])).cast("long").alias("n_linked"),
    )


@query
def op3_decontamination(spark, sf_dir):
    return decontaminate.leaks(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


@query
def op4_toxicity(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out("doc_id", toxicity.MODULUS, toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op5_near_duplicates(spark, sf_dir):
    return neardup.classes(_documents(spark, sf_dir), width=2, percent=80)


@query
def op6_pii(spark, sf_dir):
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return pii.detect(_documents(spark, sf_dir)).select(
        "doc_id",
        *_counts(pii.BASE),
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"),
    )


@query
def op7_arc_to_warc(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op8_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir))


@query
def op9_ppm(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return ppm.score(docs, ppm.training(docs)).select(
        "doc_id",
        held_out("doc_id", ppm.MODULUS, ppm.HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query
def op10_token_attribution(spark, sf_dir):
    return attribution.by_section(_documents(spark, sf_dir))


@query
def op11_periodic_runs(spark, sf_dir):
    return periodic.runs(_documents(spark, sf_dir), plant=True)


@query
def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(_documents(spark, sf_dir))


@query
def op13_substring_dedup(spark, sf_dir):
    def removed(total, f):
        """Words up to the factor's end, each counted once, with the end reached so far."""
        end = F.greatest(total["end"], f["start"] + f["length"])
        return F.struct(
            (total["n"] + end - F.greatest(total["end"], f["start"])).alias("n"), end.alias("end")
        )

    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return substrings.deduplicated(_documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        F.aggregate("factors", none, removed, lambda t: t["n"]).cast("long").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
