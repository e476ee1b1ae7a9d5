"""Word counts over text lines, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions.text import words


def tokens(lines: DataFrame, text: str = "text") -> DataFrame:
    """One ``(word, 1)`` row per word."""
    return lines.select(F.explode(words(text)).alias("word"), F.lit(1).alias("count"))


def wordcount(lines: DataFrame, text: str = "text") -> DataFrame:
    """``(word, count)``.

    Counts combine before the shuffle, so a word that makes up much of the text
    costs one row per task.
    """
    return (
        lines.select(F.explode(words(text)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("count"))
    )
