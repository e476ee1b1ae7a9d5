"""Connected components by alternating star steps, each a join and a few small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.session import stage


def _minimum_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node with an edge ``u, v``; the component is its smallest node.

    In every round, first all larger neighbours of a node, then all smaller ones, are
    hung below the smallest node among them, so trees flatten in few rounds.  A node's
    neighbours are never gathered in one place: their minimum is an aggregate, joined back.
    """
    now = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_minimum_of(both), F.col("u") == F.col("w"))
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        small = large.join(_minimum_of(large), F.col("u") == F.col("w"))
        now = stage(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
        if (after := _state(now)) == state:
            break
        state = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
